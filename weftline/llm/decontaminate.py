"""Benchmark decontamination: Wu-Manber multi-pattern search for windows of benchmark words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import Workspace, columns_of, raw, slices, small_batches

WINDOW = 10
#: Benchmark text in one pattern set; a larger benchmark is searched in several, each broadcast by itself.
BLOCK_BYTES = 4 << 20
#: Entries of a shift table, as a power of two.
TABLE_BITS = 20
#: Bytes of a scanned run; all runs of a slice advance together.
RUN_BYTES = 1024
#: Zero bytes around a buffer, so that eight-byte loads never leave it.
PAD = 16

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, runs of ASCII letters, digits and all non-ASCII characters."""
    return text.translate(_WORD_BYTES).split()


def _load(buffer: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes (1, 2, 4, 8 or 16) from each position."""
    def eight(p):
        low = p & 7
        words, i = buffer.view(np.uint64), p >> 3
        shift = (low << 3).astype(np.uint64)
        # Two aligned loads make one at any byte; a shift by 64 would not be zero, hence in two steps.
        return (words[i] >> shift) | ((words[i + 1] << (np.uint64(56) - shift)) << np.uint64(8))

    h = eight(at)
    if size < 8:
        h &= np.uint64((1 << 8 * size) - 1)
    h = h * np.uint64(0x9E3779B97F4A7C15)
    if size == 16:
        h = (h ^ (h >> np.uint64(29))) + eight(at + 8) * np.uint64(0xC2B2AE3D27D4EB4F)
        h *= np.uint64(0x9E3779B97F4A7C15)
    return h


def _buffer(data: bytes) -> np.ndarray:
    """The bytes after PAD zeros, with at least PAD zeros behind, in a whole number of eight-byte words."""
    out = np.zeros((len(data) + 3 * PAD) // 8 * 8, np.uint8)
    out[PAD:PAD + len(data)] = np.frombuffer(data, np.uint8)
    return out


class Patterns:
    """Windows of benchmark items, by length class, each with its shift table and suffix buckets.

    A pattern is a window's words with one space before, between and after them, so that it only meets whole words.
    Patterns whose lengths differ by less than a factor of two form a class; its shortest one, of m bytes, bounds
    the shifts. The block size grows with m.
    """

    def __init__(self, items: Iterable[tuple[int, bytes]], window: int = WINDOW):
        blob, start, length, count, owner = [], [], [], [], []
        base, self.ids = 0, []
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            self.ids.append(item)
            ends = np.cumsum([len(w) + 1 for w in words])
            n = min(window, len(words))
            begins = np.concatenate([[0], ends[:-1]])[:len(words) - n + 1]
            stops = ends[n - 1:] + 1
            blob.append(b" " + b" ".join(words) + b" ")
            start.append(begins + base)
            length.append(stops - begins)
            count.append(np.full(len(begins), n))
            owner.append(np.full(len(begins), len(self.ids) - 1))
            base += len(blob[-1])
        self.blob = b"".join(blob)
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        self.start, self.length, self.count, self.owner = map(join, (start, length, count, owner))
        self.classes = []
        buffer = _buffer(self.blob)
        for low in (1 << k for k in range(1, 40)):
            mine = np.flatnonzero((self.length >= low) & (self.length < 2 * low))
            if len(mine):
                m = int(self.length[mine].min())
                block = next(b for b in (16, 8, 4, 2, 1) if b == 1 or m >= 2 * b)
                most = m - block + 1
                shifts = np.full(1 << TABLE_BITS, most, np.int32)
                for j in range(most):
                    np.minimum.at(shifts, self._slot(_load(buffer, self.start[mine] + (PAD + j), block)), most - 1 - j)
                suffix = _load(buffer, self.start[mine] + (PAD + m - block), block)
                order = np.argsort(suffix, kind="stable")
                self.classes.append((m, block, shifts, suffix[order], mine[order]))

    @classmethod
    def of(cls, state: dict) -> Patterns:
        """From what vars() gave: broadcasts hold no class that executors would have to import."""
        new = cls.__new__(cls)
        vars(new).update(state)
        return new

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(position, pattern) of every occurrence in a text."""
        buffer = _buffer(data)
        where, which = [], []
        for m, block, shifts, suffixes, patterns in self.classes:
            # Positions are those of a pattern's m-th byte; every run moves on by its own shift.
            at = np.arange(m - 1, len(data), RUN_BYTES)
            stop = np.minimum(at + RUN_BYTES, len(data))
            ends = []
            while len(at):
                shift = shifts[self._slot(_load(buffer, at + (PAD - block + 1), block))]
                ends.append(at[shift == 0])
                at = at + np.maximum(shift, 1)
                alive = at < stop
                if not alive.all():
                    at, stop = at[alive], stop[alive]
            end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
            # The bucket of the suffix block, then the bytes themselves.
            h = _load(buffer, end + (PAD - block + 1), block)
            lo, hi = np.searchsorted(suffixes, h, "left"), np.searchsorted(suffixes, h, "right")
            n = hi - lo
            pick = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            begin, pattern = np.repeat(end - (m - 1), n), patterns[pick]
            good = np.fromiter(
                (data.startswith(self.blob[s:s + k], b) for b, s, k in zip(begin.tolist(), self.start[pattern].tolist(), self.length[pattern].tolist(), strict=True)), bool, len(begin)
            )
            where.append(begin[good])
            which.append(pattern[good])
        return (np.concatenate(where), np.concatenate(which)) if where else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _judge(texts: list[bytes | None], patterns: Patterns | None) -> tuple[list[int], dict[int, tuple[np.ndarray, np.ndarray, list]]]:
    """Words of each text, and of those with hits (first words, lengths in words, items)."""
    words = [words_of(t) if t else [] for t in texts]
    n_words = [len(w) for w in words]
    if patterns is None:
        return n_words, {}
    parts = [b" " + b" ".join(w) + b" " if w else b"" for w in words]
    data = b"\n".join(parts)
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])[:-1]]).astype(np.int64)
    at, which = patterns.find(data)
    if not len(at):
        return n_words, {}
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    doc = np.searchsorted(starts, at, "right") - 1
    first = np.searchsorted(spaces, at) - np.searchsorted(spaces, starts[doc])
    order = np.argsort(doc, kind="stable")
    docs, cut = np.unique(doc[order], return_index=True)
    return n_words, {d: (first[mine], patterns.count[which[mine]], [patterns.ids[i] for i in np.unique(patterns.owner[which[mine]])]) for d, mine in zip(docs.tolist(), np.split(order, cut[1:]), strict=True)}


def _covered(n_words: int, first: np.ndarray, count: np.ndarray) -> int:
    """Words inside any of the spans."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + count, -1)
    return int((np.cumsum(step) > 0).sum())


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, bytes]]]:
    block, held = [], 0
    for i, t in benchmark.select(item, F.encode(text, "UTF-8")).where(F.col(item).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        block.append((i, bytes(t)))
        held += len(t)
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """Which benchmark items occur in each document, and how many of its words they cover.

    A window is `window` consecutive words of an item, or all words of a shorter item. Document words inside any
    occurrence of a window are hit.

    The windows are pattern sets of a bounded size, built and broadcast one at a time. With one set, documents are judged where
    they are read and nothing is shuffled. A larger benchmark is searched set by set: each scan writes the spans of the documents
    it hits and its broadcast is destroyed; then the spans of a document, which are bounded by its own words, are put together. So no
    process ever holds more than one set, and no group of documents can be too large for a task.

    Returns doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated, and the columns named in
    `carry`. Each row of `docs` gives one row. A null or empty text has no words and no hits; an item without id
    or words takes no part; items that repeat an id count once. Without documents or items nothing is hit.
    """
    spark = docs.sparkSession
    small_batches(spark)
    carried = [c for c in carry if c not in ("doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated")]
    blocks = _blocks(benchmark, item, item_text)
    some = [b for b in (next(blocks, None), next(blocks, None)) if b is not None]
    share = lambda b: spark.sparkContext.broadcast(vars(Patterns(b, window)))
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), F.xxhash64(key, text).alias("_uid"), *carried)
    one = share(some[0]) if len(some) == 1 else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns.of(one.value) if one else None
        for batch in batches:
            (texts,) = columns_of(batch, ["_text"])
            for lo, hi in slices(texts):
                n_words, found = _judge(raw(texts.slice(lo, hi - lo)), patterns)
                n_hit = [_covered(n, *found[d][:2]) if d in found else 0 for d, n in enumerate(n_words)]
                ids = [sorted({str(i) for i in found[d][2]}) if d in found else [] for d in range(len(n_words))]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*columns_of(part, ["doc_id", "_uid"]), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array([h > 0 for h in n_hit]), *columns_of(part, carried)],
                    ["doc_id", "_uid", "n_words", "n_hit", "n_items", "item_ids", "contaminated", *carried],
                )

    schema = StructType([StructField("doc_id", docs.schema[key].dataType), StructField("_uid", LongType())])
    for name, kind in (("n_words", LongType()), ("n_hit", LongType()), ("n_items", LongType()), ("item_ids", ArrayType(StringType())), ("contaminated", BooleanType())):
        schema = schema.add(name, kind)
    for c in carried:
        schema = schema.add(docs.schema[c])
    judged = slim.mapInArrow(scan, schema)
    if len(some) < 2:
        return judged.drop("_uid")

    ws = Workspace(spark, "decontaminate")
    hits = None
    for block in chain(some, blocks):
        now = share(block)

        def spans(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            patterns = Patterns.of(now.value)
            for batch in batches:
                for lo, hi in slices(batch.column(1)):
                    _, found = _judge(raw(batch.column(1).slice(lo, hi - lo)), patterns)
                    where = pa.array([lo + d for d in found], pa.int64())
                    lists = list(found.values())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(where), pa.array([x[0] for x in lists], pa.list_(pa.int64())), pa.array([x[1] for x in lists], pa.list_(pa.int64())), pa.array([[str(i) for i in x[2]] for x in lists], pa.list_(pa.string()))], ["_uid", "first", "count", "ids"]
                    )

        part = ws.save(slim.select("_uid", "_text").mapInArrow(spans, "_uid long, first array<long>, count array<long>, ids array<string>"))
        now.destroy()
        hits = part if hits is None else hits.union(part)
    span = F.arrays_zip("first", "count")
    whole = hits.groupBy("_uid").agg(F.flatten(F.collect_list(span)).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("_ids"))
    word = F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["count"] - 1)))
    whole = ws.save(whole.select("_uid", F.size(F.array_distinct(word)).cast("long").alias("_hit"), "_ids"))
    none = F.array().cast("array<string>")
    joined = judged.drop("n_hit", "n_items", "item_ids", "contaminated").join(whole, "_uid", "left")
    return joined.select("doc_id", "n_words", F.coalesce("_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.size("_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("_ids", none).alias("item_ids"), F.col("_hit").isNotNull().alias("contaminated"), *carried)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` without the documents that hold a window of a benchmark item; all columns stay."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.struct(*docs.columns).alias("row"))
    return decontaminate(rows, benchmark, window=window, carry=("row",)).where("not contaminated").select("row.*")


def items_digest(ids):
    """Lower-case SHA-256 of item ids joined by commas."""
    return F.sha2(F.array_join(ids, ","), 256)
