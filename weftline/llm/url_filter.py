"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Hex digits of the digest that the join compares first (32 bits).
PREFIX_DIGITS = 8


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def url_parts(url):
    """(host, path) columns of a URL column.

    The host runs from the first `://` to `/`, `?`, `#` or the end, with A-Z lower-cased; the path follows up to
    `?`, `#` or the end. Null, or no `://`: both are empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of `pages`.

    `rules` has host, path and verdict. A rule fits its host and all subdomains if the URL's path starts with the
    rule's path. Of several rules the one with the longest host wins, then the one with the longest path, then
    `block` before `allow`.
    Each URL is expanded only at the label counts and path lengths that occur among the rules, so every rule that
    fits is among its expressions. They meet the rules on 32 bits of a SHA-256 digest; the full digest and then the
    strings themselves confirm a match.

    A row of `pages` gives exactly one row, repeated rows too; other columns pass through. A null URL or one
    without `://` has an empty host and path, so only the default verdict applies. Rules with a null host or
    path never fit. Without rules every verdict is the default and every rule null.
    Columns of `pages` named host, path, rule or verdict are replaced.
    """
    rules = (
        rules.select(lower_ascii(F.col("host")).alias("host"), "path", F.col("verdict").alias("verdict"))
        .where("host is not null and path is not null and verdict is not null")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    )
    # Bounded: label counts and path lengths of URLs, not rules.
    shapes = [tuple(r) for r in rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("n")).distinct().collect()]
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = url_parts(F.col(url))
    base = pages.select(*keep, host.alias("host"), path.alias("path"))
    if not shapes:
        return base.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", r"\.")
    expressions = F.array(*[
        F.when((F.size(labels) >= k) & (F.length("path") >= n) & (F.col("host") != ""),
               F.struct(F.array_join(F.slice(labels, F.size(labels) - (k - 1), k), ".").alias("h"), F.col("path").substr(1, n).alias("p")))
        for k, n in sorted(shapes)
    ])
    # The row number only keeps a row's own expressions together; it is fixed by the input split.
    wide = (
        base.select(F.struct(*keep, "host", "path").alias("row"), F.monotonically_increasing_id().alias("uid"), F.array_compact(expressions).alias("es"))
        .select("row", "uid", F.explode_outer("es").alias("e"))
        .select("row", "uid", F.col("e.h").alias("h"), F.col("e.p").alias("p"), _digest(F.col("e.h"), F.col("e.p")).alias("d"))
        .withColumn("short", F.substring("d", 1, PREFIX_DIGITS))
    )
    table = rules.select(F.col("host").alias("rh"), F.col("path").alias("rp"), F.col("verdict").alias("rv"), _digest(F.col("host"), F.col("path")).alias("rd")).withColumn("rshort", F.substring("rd", 1, PREFIX_DIGITS))
    found = wide.join(table, (F.col("short") == F.col("rshort")) & (F.col("d") == F.col("rd")) & (F.col("h") == F.col("rh")) & (F.col("p") == F.col("rp")), "left")
    best = F.max(F.when(F.col("rh").isNotNull(), F.struct(F.length("rh").alias("a"), F.length("rp").alias("b"), F.col("rv"), F.concat("rh", "rp").alias("rule")))).alias("best")
    # All expressions of a row are in one task: the partial aggregate leaves one row each before the shuffle.
    return found.groupBy("uid").agg(F.first("row").alias("row"), best).select(
        *[F.col("row")[c].alias(c) for c in [*keep, "host", "path"]], F.col("best.rule").alias("rule"), F.coalesce(F.col("best.rv"), F.lit(default)).alias("verdict")
    )
