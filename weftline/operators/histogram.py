"""Histograms in one pass: bins whose width doubles as the range grows, so that those of any parts of a table can be added."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least exponent of two that a bin is wide: about the resolution of a double near 1.
FINEST = -40


def _fit(places: np.ndarray, counts: np.ndarray, exponent: int, bins: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Doubles the width until the bins between the first and the last are `bins` at most."""
    while places[-1] - places[0] >= bins:
        places, exponent = places >> 1, exponent + 1
    places, where = np.unique(places, return_inverse=True)
    return places, np.bincount(where, counts).astype(np.int64), exponent


def histogram(rows: DataFrame, value: str, by: str, bins: int = 64) -> DataFrame:
    """kind, low, high, n and density (n over all values of the class and the width) of the bins that have values.

    A bin is [k * 2**e, (k + 1) * 2**e), with the least e (from FINEST) for which the values of a class lie in `bins` bins. Each task keeps at most `bins` counts of a class and widens them as values come;
    what tasks found is widened to the widest and added. So the result doesn't depend on how rows are dealt. Nulls, infinities and NaN are left out; numbers beyond 2**20 * `bins` begin with wider bins.
    A class is a string; null is a class of its own.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            keys, inverse = np.unique(np.array([k if k is None else "s" + k for k in batch.column(0).to_pylist()], object).astype(str), return_inverse=True)
            x = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            for i, k in enumerate(keys.tolist()):
                own = np.sort(x[(inverse == i) & np.isfinite(x)])
                if not len(own):
                    continue
                exponent = held[k][2] if k in held else FINEST
                while max(abs(own[0]), abs(own[-1])) * 2.0**-exponent >= 2.0**62:
                    exponent += 1
                places, counts = np.unique(np.floor(own * 2.0**-exponent).astype(np.int64), return_counts=True)
                if k in held:
                    old, n, e = held[k]
                    old = old >> (exponent - e)
                    places, counts = np.concatenate([old, places]), np.concatenate([n, counts])
                    order = np.argsort(places, kind="stable")
                    places, counts = places[order], counts[order]
                held[k] = _fit(places, counts, exponent, bins)
        for k, (places, counts, e) in held.items():
            name = None if k == "None" else k[1:]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(places), pa.string()), pa.array(places), pa.array(counts), pa.array([e] * len(places), pa.int32())], ["kind", "place", "n", "e"])

    parts = rows.select(F.col(by).cast("string").alias("kind"), F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull()).mapInArrow(count, "kind string, place long, n long, e int")
    # At most `bins` rows of a class and task: widened to the widest, then as far as their common range asks for.
    widest = parts.groupBy("kind", "e").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.sum("n").alias("n"))
    widest = widest.groupBy("kind").agg(F.max("e").alias("top"), F.collect_list(F.struct("e", "lo", "hi")).alias("ends"), F.sum("n").alias("total"))
    lows, highs = (F.expr(f"{f}(transform(ends, x -> shiftright(x.{c}, top - x.e)))") for f, c in (("array_min", "lo"), ("array_max", "hi")))
    more = F.expr(f"element_at(filter(sequence(0, 62), d -> shiftright(hi, d) - shiftright(lo, d) < {bins}), 1)")
    widest = widest.select("kind", "top", "total", lows.alias("lo"), highs.alias("hi")).select(F.col("kind").alias("_kind"), "total", "top", more.alias("more"))
    wide = parts.join(widest, F.col("kind").eqNullSafe(F.col("_kind"))).withColumn("e2", F.col("top") + F.col("more"))
    out = wide.groupBy("kind", "e2", "total", F.expr("shiftright(place, e2 - e)").alias("k")).agg(F.sum("n").alias("n"))
    width = F.pow(F.lit(2.0), F.col("e2"))
    return out.select("kind", (F.col("k") * width).alias("low"), ((F.col("k") + 1) * width).alias("high"), "n", (F.col("n") / (F.col("total") * width)).alias("density"))
