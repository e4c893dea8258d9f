"""Readers. Every one has a fixed schema; rows of the wrong shape are left out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import strip


def text_files(spark: SparkSession, path: str, title_line: bool = True) -> DataFrame:
    """(rel_path, title, body) of all `*.txt` files below a folder. Files and folders that begin with `_` are skipped.

    `title_line` is a property of the source: whether the first line is a title or part of the text.
    """
    root = path.rstrip("/")
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value")
    tail = F.substring_index("p", f"{root.rsplit('/', 1)[-1]}/", -1)
    first = F.split_part("value", F.lit("\n"), F.lit(1))
    rest = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise(F.lit(""))
    return rows.select(tail.alias("rel_path"), strip(first).alias("title"), (rest if title_line else F.col("value")).alias("body"))


def token_lines(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """(tokens) of each line."""
    rows = spark.read.text(path).select(F.filter(F.split(strip(F.col("value")), r"(?U)\s+"), lambda t: t != "").alias("tokens"))
    return rows if keep_blank else rows.where("size(tokens) > 0")


def frequency_table(spark: SparkSession, path: str) -> DataFrame:
    """(word, cnt) of lines split at their last tab."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^(.*)\t(\d+)$", 1).alias("word"), F.expr("try_cast(regexp_extract(value, '^(.*)\\t(\\\\d+)$', 2) as bigint)").alias("cnt"))
    return rows.where("cnt is not null")


def word_set(spark: SparkSession, path: str) -> DataFrame:
    """(word), distinct, of a file of words between white space."""
    return spark.read.text(path).select(F.explode(F.split("value", r"(?U)\s+")).alias("word")).where("word <> ''").distinct()


CONLLU = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """Token rows of a CoNLL-U file: ten columns, of which the id is a number."""
    cells = spark.read.text(path).select(F.split("value", "\t").alias("c")).where("size(c) = 10")
    return cells.select(*[F.col("c")[i].alias(n) for i, n in enumerate(CONLLU)]).where(F.col("id").rlike("^[0-9]+$"))


def evaluation_tokens(rows: DataFrame) -> DataFrame:
    """(form, lemma) in lower case of words, without punctuation, symbols, numbers and names."""
    kept = rows.where(~F.col("upos").isin("PUNCT", "SYM", "NUM", "PROPN") & F.col("form").rlike(r"^\p{L}+$"))
    return kept.select(F.lower("form").alias("form"), F.lower("lemma").alias("lemma"))


def url_index(spark: SparkSession, path: str, fields: int = 2) -> DataFrame:
    """(url, ts) of an index of two fields, or (urlkey, ts, url) of one of three; other lines are left out."""
    names = {2: ("url", "ts"), 3: ("urlkey", "ts", "url")}[fields]
    cells = spark.read.text(path).select(F.split(strip(F.col("value")), r"(?U)\s+").alias("c")).where(F.size("c") == fields)
    return cells.select(*[F.col("c")[i].alias(n) for i, n in enumerate(names)])


def bucket_stats(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, before, after) of lines `<bucket>_vocab: a->b`."""
    pattern = r"^(.+)_vocab:\s*(\d+)\s*->\s*(\d+)"
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(*[F.regexp_extract("value", pattern, i).cast(t).alias(n) for i, (n, t) in enumerate((("bucket", "string"), ("before", "long"), ("after", "long")), 1)])


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of a text file of vectors; its first line, `N dim`, is left out by its number of fields."""
    cells = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("c")).where("size(c) > 2")
    return cells.select(F.col("c")[0].alias("word"), F.transform(F.slice("c", 2, F.size("c") - 1), lambda x: x.cast("float")).alias("vec"))


class PagedPosts(DataSource):
    """A paged REST source of posts: `spark.dataSource.register(PagedPosts)`, then format("paged_posts").option("url", ...).

    Pages are followed by their cursor, so one partition reads them. `fetch`, a class attribute, maps a URL to a JSON
    text; tests replace it.
    """

    fetch: Callable[[str], str] | None = None

    @classmethod
    def name(cls) -> str:
        return "paged_posts"

    def schema(self) -> str:
        return "id long, date string, title string, url string, content string, categories string"

    def reader(self, schema) -> DataSourceReader:
        return _PostReader(self.options["url"], type(self).fetch)


class _PostReader(DataSourceReader):
    def __init__(self, url: str, fetch: Callable[[str], str] | None):
        self.url, self.fetch = url, fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.fetch is None:
            raise ValueError("PagedPosts.fetch is not set")
        handle = None
        while True:
            page = json.loads(self.fetch(self.url + (f"&page_handle={handle}" if handle else "")))
            for p in page.get("posts", []):
                yield p["ID"], p.get("date", "")[:10], p.get("title"), p.get("URL"), p.get("content"), ";".join(p.get("categories") or {})
            handle = (page.get("meta") or {}).get("next_page")
            if not handle:
                return
