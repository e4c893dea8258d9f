"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, columns_of, raw, slices, small_batches
from .similar import Members, link, meet, mix, once, set_digest, sketch_of

#: A signature has POSITIONS minima of 16 bits, in CHUNKS chunks.
POSITIONS, CHUNKS = 32, 8
#: Positions in which the signatures of a link may differ. At a Jaccard coefficient of 0.85 more than 15 of 32 differ with
#: probability 4e-6, at 0.8 with 2e-4. With 15 errors or fewer one of the 8 chunks has at most one.
DISTANCE = 15
#: Words whose hashes a Python worker remembers.
MEMO_WORDS = 500_000

_RNG = np.random.default_rng(20240229)
_FLIP = _RNG.integers(0, 2**64, POSITIONS, np.uint64)
_TIMES = _RNG.integers(0, 2**64, POSITIONS, np.uint64) | np.uint64(1)


class Shingler:
    """Sets of hashed word shingles: A-Z lower-cased, words are runs without ASCII white space."""

    def __init__(self, width: int):
        self.width = width
        self.memo: dict[bytes, int] = {}

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Sorted distinct 64-bit hashes of each text's shingles; of fewer words than the width, all words are one shingle."""
        words = [t.lower().split() if t else [] for t in texts]
        missing = set().union(*words) - self.memo.keys()
        if len(self.memo) + len(missing) > MEMO_WORDS:
            self.memo, missing = {}, set().union(*words)
        self.memo |= {w: xxhash.xxh3_64_intdigest(w) for w in missing}
        counts = np.array([len(w) for w in words])
        get = self.memo.__getitem__
        h = np.fromiter((x for w in words for x in map(get, w)), np.uint64, int(counts.sum()))
        ends = np.cumsum(counts)
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(len(h) - self.width + 1, 0), np.uint64)
            for i in range(self.width if len(rolled) else 0):
                rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + h[i:len(h) - self.width + 1 + i]
            rolled = mix(rolled)
            out = []
            for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
                if n >= self.width:
                    out.append(np.unique(rolled[end - n:end - self.width + 1]))
                elif n:
                    short = np.uint64(n)
                    for x in h[end - n:end]:
                        short = short * np.uint64(0xA0761D6478BD642F) + x
                    out.append(mix(np.array([short], np.uint64)))
                else:
                    out.append(np.zeros(0, np.uint64))
        return out


def signature(elements: np.ndarray) -> bytes:
    """POSITIONS minima of a set, 16 bits of each."""
    low = np.full(POSITIONS, np.uint64(2**64 - 1))
    for i in range(0, len(elements), 8192):
        np.minimum(low, ((elements[i:i + 8192] ^ _FLIP[:, None]) * _TIMES[:, None]).min(1), out=low)
    return (mix(low) >> np.uint64(48)).astype("<u2").tobytes()


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of each signature: for each chunk, all variants with one position left open.

    Two signatures with at most one differing position in some chunk share a key, and no others do: a key is a
    bijection of the number of the variant and the bits themselves.
    """
    per = POSITIONS // CHUNKS
    out = []
    for c in range(CHUNKS):
        chunk = signatures[:, c * per:(c + 1) * per].astype(np.uint64)
        for open_ in range(per):
            key = np.full(len(chunk), np.uint64(c * per + open_))
            for k in range(per):
                if k != open_:
                    key = (key << np.uint64(16)) | chunk[:, k]
            out.append(mix(key))
    return np.stack(out, 1)


def decode(payloads: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in payloads]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, least: int = 85, also: DataFrame | None = None) -> DataFrame:
    """Groups of documents whose shingle sets are alike: 100 * intersection >= least * union, directly or over others.

    Texts with equal sets form one class at once. Classes meet by their signatures: split into chunks, with one error
    allowed in each, all pairs within DISTANCE positions share a key. Pairs within it and within the size bound are confirmed on their
    full sets. Components are found by contraction.

    Returns doc_id, n_shingles (the set's size), component_id (the smallest doc_id of its component) and kept
    (doc_id = component_id). Every row of `docs` gives one row; rows that repeat an id and a text are alike.
    Null, empty or wordless texts have 0 shingles and are linked with nothing: their component is their own id. A row
    without id takes part, but is never kept; a component without any id has a null component_id. Sets are compared
    and told apart by 64-bit hashes. `least` must be 80 or more, for which DISTANCE is laid out.

    `also` has other texts of documents in `docs`: each that differs from its document's text gives one more row, and rows of other ids are left out;
    no text is shuffled for that. A document's two texts that meet nothing else aren't compared with each other, so each may be a component of its own;
    which documents have only kept rows doesn't depend on them.
    """
    if not 80 <= least <= 100 or width < 1:
        raise ValueError("least must be in 80..100 and width positive")
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "near-dup")
    kind = dict(docs.dtypes)[key]

    def sign(batches: Iterator[pa.RecordBatch], among=None) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            if among is not None:
                batch = batch.filter(pa.array(Members.test(among.value, batch.column(2).to_numpy())))
            sizes, nodes, signatures = [], [], []
            for lo, hi in slices(batch.column(1)):
                for s in shingler.sets(raw(batch.column(1).slice(lo, hi - lo))):
                    sizes.append(len(s))
                    nodes.append(set_digest(s) if len(s) else None)
                    signatures.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "node", "signature"])

    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    row = f"doc_id {kind}, n_shingles long, node long, signature binary"
    signed = slim.mapInArrow(sign, row)
    if also is not None:
        others = also.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
        digest = lambda df: df.select("doc_id", F.xxhash64("text").alias("h"))
        both = digest(others).withColumn("o", F.lit(True)).union(digest(slim).withColumn("o", F.lit(False))).groupBy("doc_id", "h").agg(F.bool_or("o").alias("o"), F.bool_or(~F.col("o")).alias("d"))
        changed = ws.save(both.groupBy("doc_id").agg(F.bool_or(F.col("o") & ~F.col("d")).alias("differs"), F.bool_or("d").alias("is")).where("differs and is").select("doc_id"))
        among = spark.sparkContext.broadcast(Members(changed.select(F.xxhash64("doc_id").alias("h")), "h", changed.count()).map)
        further = others.select("doc_id", "text", F.xxhash64("doc_id")).mapInArrow(lambda batches: sign(batches, among), row)
        signed = signed.union(further.join(changed, "doc_id", "left_semi"))
        slim = slim.union(others)
    signed = ws.save(signed)
    classes = ws.save(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")))

    def entries(batch: pa.RecordBatch, _: set) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if batch.num_rows:
            signatures = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, POSITIONS)
            keys = chunk_keys(signatures)
            yield keys.ravel(), np.repeat(batch.column(0).to_numpy(), keys.shape[1]), np.repeat(sketch_of(signatures), keys.shape[1])

    def payloads_of(nodes: DataFrame, n: int) -> DataFrame:
        """Sets of the nodes: documents whose ids are wanted are shingled once more where they are read."""
        wanted = nodes.join(classes, "node").select(F.xxhash64("first").alias("h"))
        members = spark.sparkContext.broadcast(Members(wanted, "h", n).map)

        def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler, map_, sent = Shingler(width), members.value, set()
            for batch in batches:
                texts = batch.column(1).filter(pa.array(Members.test(map_, batch.column(0).to_numpy())))
                for lo, hi in slices(texts):
                    sets = {set_digest(s): s for s in shingler.sets(raw(texts.slice(lo, hi - lo))) if len(s)}
                    fresh = sets.keys() - sent
                    sent = (sent if len(sent) < MEMO_WORDS else set()) | fresh
                    yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.int64()), pa.array([sets[x].tobytes() for x in fresh], pa.binary())], ["node", "payload"])

        return once(slim.select(F.xxhash64("doc_id"), "text").mapInArrow(shingle, "node long, payload binary"), n, ws)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, POSITIONS) for c in columns_of(batch, ["sa", "sb"]))
                yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(1) <= DISTANCE))

    def pretest(pairs: DataFrame) -> DataFrame:
        side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("signature").alias(f"s{c}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {least} * greatest(na, nb)")
        return sized.select("a", "b", "sa", "sb").mapInArrow(close, "a long, b long")

    # Signatures within DISTANCE have sketches within it, so the sketches lose no pair.
    met = meet(classes.select("node", "signature"), entries, classes.count() * POSITIONS, DISTANCE, ws)
    if also is not None:
        met = ws.save(met.join(_own_pairs(met, classes), "a", "left_anti"))
    _, roots = link(met, payloads_of, decode, least, ws, pretest)
    ws.clear(signed, classes, roots)
    rooted = classes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least_ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least_ids, "root").select("node", "component_id")
    out = signed.drop("signature").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _own_pairs(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(a) of pairs of two texts of one document, and of no other, that met each other and nothing else."""
    pairs = met.select("a", "b").distinct()
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    single = ends.groupBy("node").agg(F.count("*").alias("c"), F.min("other").alias("other")).where("c = 1")
    owner = classes.where("first = last").select("node", "first")
    owned = single.join(owner, "node").select(F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y"), "node", "first")
    alone = owned.groupBy("x", "y").agg(F.count("*").alias("c"), F.min("first").alias("f0"), F.max("first").alias("f1")).where("c = 2 and f0 = f1")
    # Of both ends one is a.
    return alone.select(F.explode(F.array("x", "y")).alias("a"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, least: int = 80) -> DataFrame:
    """`docs` without the documents of each component but the one with the smallest id; all columns stay.

    Rows without id stay, as do all rows that repeat a kept id.
    """
    gone = near_duplicates(docs, key, text, width, least).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
