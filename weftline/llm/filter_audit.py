"""Filter interaction audit: what each of five text filters removes, alone and behind the others in every order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, columns_of, slices, small_batches

#: Bytes of a word up to which it is hashed eight bytes at a time, with all words of a slice at once.
CHUNKED_BYTES = 256
FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """What a text must have to pass filters A to D; filter E is "no smaller doc_id has the same text"."""

    # Fixed values of the audit.
    least_words: int = 200
    least_distinct_percent: int = 50
    most_capitals_percent: int = 3
    symbols: str = "#$%&*|"


LETTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(LETTERS))


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


GAP, CAPITAL = _class(b" \t\n\v\f\r"), _class(bytes(range(65, 91)))
#: By how many bytes of a word an eight-byte window holds.
KEPT = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[first:first + size]; `data` has eight spare bytes behind its last word."""
    at_byte = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    hashes = size.astype(np.uint64) * FACTOR
    short = np.flatnonzero(size <= CHUNKED_BYTES)
    done = 0
    with np.errstate(over="ignore"):
        while len(short):
            chunk = at_byte[first[short] + done] & KEPT[np.minimum(size[short] - done, 8)]
            h = (hashes[short] ^ chunk) * FACTOR
            hashes[short] = h ^ (h >> np.uint64(29))
            done += 8
            short = short[size[short] > done]
    for i in np.flatnonzero(size > CHUNKED_BYTES).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(data[first[i]:first[i] + size[i]], digest_size=8).digest(), "little")
    return hashes


def distinct_words(data: np.ndarray, first: np.ndarray, size: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many different words each of `rows` texts has; word i lies at data[first[i]:first[i] + size[i]] in text row[i], and rows ascend.

    The hashes of a text's words are sorted; neighbours with the same hash are held against each other byte by byte, and
    a text in which two different words share a hash is counted from its words.
    """
    bits = np.uint64(max(1, int(rows - 1).bit_length()))
    keys = (row.astype(np.uint64) << (np.uint64(64) - bits)) | (word_hashes(data, first, size) >> bits)
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    a, b = order[same], order[same + 1]
    differ = size[a] != size[b]
    at_byte = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    left, done = np.flatnonzero(~differ), 0
    while len(left):
        rest = size[a[left]] - done
        wrong = ((at_byte[first[a[left]] + done] ^ at_byte[first[b[left]] + done]) & KEPT[np.minimum(rest, 8)]) != 0
        differ[left[wrong]] = True
        left = left[~wrong & (rest > 8)]
        done += 8
    count = np.bincount(row, minlength=rows) - np.bincount(row[a], minlength=rows)
    for r in np.unique(row[a[differ]]).tolist():
        mine = np.flatnonzero(row == r)
        count[r] = len({data[first[i]:first[i] + size[i]].tobytes() for i in mine.tolist()})
    return count


def text_counts(texts: pa.Array, symbols: str = Limits.symbols) -> dict[str, np.ndarray]:
    """words, distinct, capitals, chars (code points) and symbols of each text of an Arrow string array without nulls, and its SHA-256 as digest."""
    wide = pa.types.is_large_string(texts.type)
    starts = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0]:starts[-1]]
    starts -= starts[0]
    data = np.concatenate([body, np.zeros(8, np.uint8)])
    lo, hi = starts[:-1], starts[1:]

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[hi] - sums[lo]

    inside = ~GAP[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[starts] = True
    before, after = np.zeros(len(body), bool), np.zeros(len(body), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    begins = inside & (~before | edge[:-1])
    first = np.flatnonzero(begins)
    size = np.flatnonzero(inside & (~after | edge[1:])) - first + 1
    words = per_text(begins)
    row = np.repeat(np.arange(len(texts)), words)
    listed = _class(symbols.encode("ascii"))
    return {
        "words": words, "distinct": distinct_words(data, first, size, row, len(texts)), "capitals": per_text(CAPITAL[body]), "chars": per_text((body & 0xC0) != 0x80),
        "symbols": per_text(listed[body]), "digest": [hashlib.sha256(body[s:e]).digest() for s, e in zip(lo.tolist(), hi.tolist(), strict=True)],
    }


COUNTS = ("words", "distinct", "capitals", "chars", "symbols")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", symbols: str = Limits.symbols) -> DataFrame:
    """doc_id, part (string), and of each whole text words, distinct, capitals, chars, symbols (longs) and digest (SHA-256).

    Words are runs of other bytes than ASCII white space, told apart by case. A null text counts as empty, a null part as ''. No text is shuffled.
    """
    small_batches(docs.sparkSession)
    if not symbols.isascii():
        raise ValueError("symbols must be ASCII characters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, texts = columns_of(batch, ["doc_id", "part", "text"])
            for lo, hi in slices(texts):
                found = text_counts(texts.slice(lo, hi - lo), symbols)
                arrays = [pa.array(found[c], pa.int64()) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), parts.slice(lo, hi - lo), *arrays, pa.array(found["digest"], pa.binary())], ["doc_id", "part", *COUNTS, "digest"])

    slim = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(docs.dtypes)[key]}, part string, {', '.join(f'{c} long' for c in COUNTS)}, digest binary")


def failures(scanned: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, part, digest and failed: bits 0 to 3 for filters A to D."""
    tests = (
        F.col("words") < limits.least_words, 100 * F.col("distinct") < limits.least_distinct_percent * F.col("words"),
        100 * F.col("capitals") > limits.most_capitals_percent * F.col("chars"), F.col("symbols") > 0,
    )
    return scanned.select("doc_id", "part", "digest", sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0)).alias("failed"))


def outcome_cells(failed: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """part, failed (bits 0 to 4, the last for filter E), good, toxic and n: how many documents are alike in all of these.

    A text fails E if a row with a smaller id has it, whatever else became of that row; a row without id neither fails E nor makes others fail it.
    Rows of a digest are counted by id, then by part and labels, before all of them meet: what meets of the largest
    group of copies is one row for each part and label.
    """
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    plain = failed.where("doc_id is null").groupBy("part", "failed").agg(F.count("*").alias("n")).select("part", "failed", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    cell = ["part", "failed", "good", "toxic"]
    known = failed.where("doc_id is not null").join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    by_id = known.groupBy("doc_id", "digest", *cell).agg(F.count("*").alias("n"))
    copies = by_id.groupBy("digest", *cell).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"))
    stay = F.when(F.col("first") == F.min("first").over(Window.partitionBy("digest")), F.col("n_first")).otherwise(0)
    split = copies.withColumn("stay", stay).select(*cell, F.explode(F.array(F.struct(F.col("stay").alias("n"), F.lit(0).alias("e")), F.struct((F.col("n") - F.col("stay")).alias("n"), F.lit(16).alias("e")))).alias("x"))
    rows = split.select("part", (F.col("failed") + F.col("x.e")).alias("failed"), "good", "toxic", "x.n").union(plain)
    return rows.groupBy(*cell).agg(F.sum("n").alias("n")).where("n > 0")


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def replay(cells: pd.DataFrame) -> pd.DataFrame:
    """All orders of the filters over the cells of one part: masks of failed filters, with the number of documents that have each."""
    masks = np.arange(1 << len(LETTERS))
    count, good, toxic = (np.bincount(cells["failed"], cells["n"] * w, len(masks)).astype(np.int64) for w in (1, cells["good"], cells["toxic"]))
    rows, total = [], dict.fromkeys(LETTERS, 0)
    for order in ORDERS:
        earlier = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            fails, gone = masks & bit != 0, masks & earlier != 0
            removed = int(count[fails & ~gone].sum())
            total[letter] += removed
            earlier |= bit
            rows.append((order, step, letter, int(count[masks & earlier == 0].sum()), removed, int(count[fails & gone].sum()), int(count[bit]), int(good[fails & ~gone].sum()), int(toxic[fails & ~gone].sum())))
    out = pd.DataFrame(rows, columns=["filter_order", "step", "letter", *MEASURES[:-1]])
    return out.assign(shapley=out["letter"].map(total), part=cells["part"].iloc[0])[["part", "filter_order", "step", *MEASURES]]


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """What five filters remove from each part of `docs` in each of their 120 orders.

    A to D are Limits, E removes copies of the text of a smaller id. Returns part, filter_order, step (1 to 5) and, of the filter at that step,
    MEASURES: documents kept after it, removed by it, failing it but removed earlier, failing it alone, and of those removed the ones with
    `labels` quality 1 and toxic 1; shapley is what it removes in all orders together.

    Repeated rows count each. A null text is empty, so it fails A, and is a copy of other empty ones. A null or unknown id has no labels; of several labels
    of an id any 1 counts. A part without documents has no rows, so an empty table gives none; other columns are ignored.
    """
    scanned = Workspace(docs.sparkSession, "filter-audit").save(failures(scan(docs, key, text, part, limits.symbols), limits))
    kind = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)
    return outcome_cells(scanned, labels, key).groupBy("part").applyInPandas(replay, kind)
