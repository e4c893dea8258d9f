"""Sharding: proportional stratified interleaving without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace
from .similar import sized_broadcast

#: Rows that one sorted group holds; groups are cut from a uniform hash, so no source, however large, fills one task.
GROUP_ROWS = 4096
#: Runs that one sum of a prefix covers.
PREFIX = 4096


def _empty_text(text):
    return F.coalesce(F.col(text), F.lit(""))


def interleave(docs: DataFrame, shards: int = 8, seed: str = "weftline", text: str = "text", source: str = "source", key: str = "doc_id", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Puts every row of `docs` into one of `shards` shards, each with the mixture of sources of the whole.

    Rows of a source are shuffled by the MD5 of seed, key, checksum and size; row k of n (from 1) has the fractional rank
    (2k - 1) / 2n. All rows are ordered by it and cut into equal runs, so shard sizes differ by one row at most and
    every source has its share of each shard, but for rows of equal rank that a cut divides: one a source at most.

    Both rankings are counts of lower groups plus a position inside the group: sources are cut into groups by the
    hash, the whole by the fractional rank, each of about `group_rows` rows however the sources are skewed. The text
    is read once and only its size and checksum are shuffled. A source's count goes with its rows: the table of
    counts is broadcast if it has few enough rows, and joined by shuffle beyond that.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law `rows`, shard, slot (from 0, without gaps) and
    grown_shard (null: this law does not keep rows in place when shards are added).
    A null text counts as empty (size 1, checksum 0). A null source is a source of its own. Rows with a null key
    are shuffled by their place in the table as well; rows alike in key and text are interchangeable. An empty table
    gives no rows; other columns of `docs` are ignored.
    """
    if shards < 1 or group_rows < 1:
        raise ValueError("shards and group_rows must be positive")
    raw = _empty_text(text)
    slim = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("")).alias("src"),
    )
    # Checksum and size spread rows that repeat a key; a written row has a number of its own, which spreads those without a key.
    ws = Workspace(docs.sparkSession, "sharding")
    slim = ws.save(slim.withColumn("uid", F.monotonically_increasing_id()))
    slim = slim.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.when(F.col("doc_id").isNull(), F.col("uid").cast("string")), "text_crc32", "size")))
    per_source = ws.save(slim.groupBy("src").agg(F.count("*").alias("n")))
    total = docs.count()  # from the file footers
    groups = max(1, -(-total // group_rows))
    unit = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    n_groups = F.ceil(F.col("n") / group_rows)
    rows = slim.join(sized_broadcast(per_source), "src").withColumn("g", F.shiftright(unit * n_groups, 32))
    # Groups of a source and how many of its rows lie in lower ones.
    counts = rows.groupBy("src", "g").agg(F.count("*").alias("c"))
    before = counts.select("src", "g", (F.sum("c").over(Window.partitionBy("src").orderBy("g")) - F.col("c")).alias("below"))
    inside = Window.partitionBy("src", "g").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("i", F.row_number().over(inside)).join(before, ["src", "g"])
    ranked = ranked.withColumn("k", F.col("i") + F.col("below")).withColumn("frac", (2 * F.col("k") - 1) / (2 * F.col("n")))
    ranked = ranked.withColumn("b", F.least(F.floor(F.col("frac") * groups), F.lit(groups - 1)))
    run_counts = ranked.groupBy("b").agg(F.count("*").alias("c"))
    # Prefix sums in two levels: one task gets a row for each PREFIX runs of about group_rows documents.
    many = run_counts.withColumn("pb", F.expr(f"b div {PREFIX}"))
    tops = many.groupBy("pb").agg(F.sum("c").alias("c"))
    tops = tops.select("pb", (F.sum("c").over(Window.orderBy("pb")) - F.col("c")).alias("top"))
    runs = many.withColumn("start", F.sum("c").over(Window.partitionBy("pb").orderBy("b")) - F.col("c")).join(tops, "pb").select("b", (F.col("top") + F.col("start")).alias("start"))
    order = Window.partitionBy("b").orderBy("frac", "src", "h", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("j", F.row_number().over(order)).join(runs, "b").withColumn("pos", F.col("start") + F.col("j") - 1)
    shard = F.expr(f"pos * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("pos") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
