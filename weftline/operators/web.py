"""Crawl tables: URL indexes, work lists, completeness, extraction of pages."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import SharedTables

#: Where the content of a page starts and ends, in the order in which layouts are tried.
ARTICLE_LAYOUTS = ((r"<article[^>]*>", r"</article>"), (r"<main[^>]*>", r"</main>"), (r"<body[^>]*>", r"</body>"))


def newest_per_key(rows: DataFrame, key: list[str], stamp: str, first_seen: str) -> DataFrame:
    """The row with the largest stamp of each key; of equal stamps the one seen first.

    A struct maximum, pre-aggregated on the map side: a frequent key needs no sort of its rows.
    """
    best = F.max_by(F.struct(*rows.columns), F.struct(F.col(stamp), -F.col(first_seen)))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(best.alias("_best")).select("_best.*")


def url_key(url: Column) -> Column:
    """Without scheme, `www.`, port, query and fragment; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?i)^[a-z][a-z0-9+.\-]*://(www\.)?", ""), r"[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/:]*)", 1))
    return F.concat(host, F.regexp_replace(bare, r"^[^/]*", ""))


def url_fields(urls: DataFrame, url: str = "url", aliases: dict[str, str] | None = None) -> DataFrame:
    """Adds host, segments of the path, section (the first, renamed by `aliases`), item_id (digits before the first hyphen of the last) and has_query."""
    bare = F.regexp_replace(F.col(url), r"(?i)^[a-z][a-z0-9+.\-]*://", "")
    path = F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"^[^/]*", "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    section = F.try_element_at(segments, F.lit(1))
    for old, new in (aliases or {}).items():
        section = F.when(F.try_element_at(segments, F.lit(1)) == old, F.lit(new)).otherwise(section)
    last = F.try_element_at(segments, F.lit(-1))
    return (
        urls.withColumn("host", F.lower(F.regexp_extract(bare, r"^([^/:?#]*)", 1))).withColumn("segments", segments).withColumn("section", section)
        .withColumn("item_id", F.nullif(F.regexp_extract(last, r"^(\d+)-", 1), F.lit(""))).withColumn("has_query", F.contains(F.col(url), F.lit("?")))
    )


def work_list(index: DataFrame, url: str = "url", stamp: str = "ts", seen: str = "seq", sections: list[str] | None = None, least_segments: int = 3, skip: str | None = None, before: str | None = None) -> DataFrame:
    """An index to the newest snapshot of each item, in the order of `sections`, then by slug.

    Rows need a URL without query, enough path segments, a known section (if given) and an item id; `skip` is a
    pattern of URLs left out; `before` bounds the stamp.
    """
    rows = url_fields(index, url).where((F.col(url) != "") & ~F.col("has_query") & (F.size("segments") >= least_segments) & F.col("item_id").isNotNull())
    if sections:
        rows = rows.where(F.col("section").isin(*sections))
    if skip:
        rows = rows.where(~F.col(url).rlike(skip))
    if before:
        rows = rows.where(F.col(stamp) < before)
    order = F.array_position(F.array(*[F.lit(s) for s in sections or [""]]), F.col("section"))
    return newest_per_key(rows, ["section", "item_id"], stamp, seen).orderBy(order, F.element_at("segments", -1))


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't there yet."""
    return wanted.join(have.select(key), key, "left_anti")


def accepted(fetched: DataFrame, least_body: int = 2000, least_text: int = 200) -> tuple[DataFrame, DataFrame]:
    """Fetched items (code, body, text) as (ok, failed): status 200 and long enough bodies and texts."""
    good = F.coalesce((F.col("code") == 200) & (F.length("body") > least_body) & (F.length("text") > least_text), F.lit(False))
    return fetched.where(good), fetched.where(~good)


def crawl(start: DataFrame, links: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Pages reachable from `start` (url) over `links` (url, target), with the round in which each was found.

    Each round joins only the newest pages and anti-joins those seen; it ends when none is new. With `most_rounds`, it
    fails when pages are still new after so many. Each round is a table in spark.checkpoint.dir, as are the links, so plans stay short.
    """
    spark = start.sparkSession
    tables = SharedTables(spark, "crawl")
    links = tables.save(links.select("url", "target").distinct(), "links")
    front = tables.save(start.select("url").distinct().withColumn("depth", F.lit(0)), "seen/round=0")
    # The rounds are folders of one table: the plan doesn't grow with their number.
    seen = lambda: spark.read.schema(front.schema).parquet(f"{tables.root}/seen/round=*")
    for depth in itertools.count(1):
        new = front.join(links, "url").select(F.col("target").alias("url")).distinct().join(seen().select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))
        front = tables.save(new, f"seen/round={depth}")
        if front.isEmpty():
            return seen()
        if most_rounds is not None and depth >= most_rounds:
            raise ValueError("pages are still new after most_rounds")


def link_list(pages: DataFrame, page: str = "html", pattern: str | None = None) -> DataFrame:
    """Distinct link targets of all pages, sorted."""
    links = pages.select(F.explode(T.html_links(F.col(page))).alias("target"))
    return (links.where(F.col("target").rlike(pattern)) if pattern else links).distinct().orderBy("target")


def main_block(page: Column, layouts=ARTICLE_LAYOUTS) -> Column:
    """The part of a page between the start and the end of the first layout that it has, or null."""
    found = []
    for start, end in layouts:
        tail = F.regexp_extract(page, f"(?is){start}(.*)", 1)
        found.append(F.when(page.rlike(f"(?is){start}"), F.regexp_extract(tail, f"(?is)^(.*?)(?:{end}|$)", 1)))
    return F.coalesce(*found)


def extract_pages(pages: DataFrame, page: str = "html", layouts=ARTICLE_LAYOUTS, furniture: str | None = None, title_affix: str | None = None, entities: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """Adds title and body of each page: the main block as lines, without leading furniture lines.

    A page without any of the layouts isn't an article: its body is null. `entities` are those that are decoded, all by default.
    """
    lines = T.tag_lines(main_block(F.col(page), layouts), entities)
    if furniture:
        first = F.expr(f"try_element_at(filter(transform(_lines, (x, i) -> if(x rlike '{furniture}', null, i)), x -> x is not null), 1)")
        lines_col = F.slice("_lines", F.coalesce(first, F.size("_lines")) + 1, F.greatest(F.size("_lines"), F.lit(1)))
    else:
        lines_col = F.col("_lines")
    title = T.html_title(F.col(page))
    if title_affix:
        title = F.regexp_replace(title, title_affix, "")
    return pages.withColumn("title", T.decoded(title, entities)).withColumn("_lines", lines).withColumn("body", F.array_join(lines_col, "\n")).drop("_lines")


def existing_ids(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Distinct ids that file names begin with."""
    return files.select(F.nullif(F.regexp_extract(name, r"^(\d+)-", 1), F.lit("")).alias("item_id")).where("item_id is not null").distinct()


def per_host_newest(pages: DataFrame) -> DataFrame:
    """The page with the largest page_id of each host."""
    rows = url_fields(pages.select("page_id", "url")).select("page_id", "url", "host").withColumn("seq", F.lit(0))
    return newest_per_key(rows, ["host"], "page_id", "seq").drop("seq")
