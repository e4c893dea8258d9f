"""Writers. A dataset is written as a new version, never changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucketed_texts(docs: DataFrame, path: str, bucket: str = "bucket", rel_path: str = "rel_path") -> None:
    """Texts in a folder for each bucket, their paths flattened to names."""
    docs.withColumn("name", F.replace(F.col(rel_path), F.lit("/"), F.lit("__"))).write.mode("overwrite").partitionBy(bucket).parquet(path)


def tsv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated with a header; tabs and newlines inside strings become spaces. `append` resumes a log."""
    clean = [F.translate(c, "\t\n", "  ").alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    rows.select(*clean).write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def frequency_table(freq: DataFrame, path: str, least: int = 3) -> None:
    """Words of at least `least` occurrences, the most frequent first."""
    rows = freq.where(F.col("cnt") >= least).orderBy(F.desc("cnt"), "word").select(F.concat_ws("\t", "word", F.col("cnt").cast("string")))
    rows.write.mode("overwrite").text(path)


def decimal_of(x: Column) -> Column:
    """The shortest decimal that a float is read back from; where two of them are equally near, the exact one, a digit longer."""
    digits = lambda s: F.regexp_replace(F.regexp_replace(F.split_part(s, F.lit("E"), F.lit(1)), "[^0-9]", ""), "^0+|0+$", "")
    short, exact = x.cast("string"), x.cast("double").cast("string")
    return F.when((F.length(digits(exact)) == F.length(digits(short)) + 1) & digits(exact).endswith("5"), exact).otherwise(short)


def vector_lines(words: DataFrame) -> DataFrame:
    """(line) of the text format of vectors: `N dim`, then a word and its numbers a line."""
    head = words.agg(F.concat_ws(" ", F.count("*").cast("string"), F.coalesce(F.max(F.size("vec")), F.lit(0)).cast("string")).alias("line"), F.lit(0).alias("ord"))
    body = words.select(F.concat_ws(" ", "word", F.array_join(F.transform("vec", decimal_of), " ")).alias("line"), F.lit(1).alias("ord"))
    return head.union(body).orderBy("ord", "line").select("line")


def stats_lines(stats: DataFrame) -> DataFrame:
    """(line) `bucket_vocab: a->b`, sorted."""
    return stats.select(F.format_string("%s_vocab: %d->%d", "bucket", "before", "after").alias("line")).orderBy("line")
