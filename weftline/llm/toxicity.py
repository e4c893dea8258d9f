"""Toxicity: subword embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .common import columns_of, slices, small_batches

#: Lengths of a word's character n-grams; the marked word itself is one more subword.
ORDERS = (3, 4, 5)
BITS, DIMENSIONS = 18, 4
#: Every bag also has a mark of its end, this often; it steadies the average of very short texts.
END, END_TIMES = zlib.crc32(b"</s>") & ((1 << BITS) - 1), 100
#: The labelled sample: documents of each label, chosen by hash, none longer than so many bytes.
DOCS_PER_LABEL, SAMPLE_BYTES = 1200, 65_536
STEPS, BATCH, RATE = 384, 128, 0.8
#: Weight decay at the full sample; it grows with the square of what a smaller one lacks, or rare words would decide there.
DECAY = 1e-7
#: Sampled documents that must have a subword for it to get a vector.
LEAST_DOCS = 3
#: Words whose contributions a Python worker remembers.
MEMO_WORDS = 400_000

_GAPS = bytes(b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words as UTF-8: runs of ASCII letters, digits and non-ASCII characters."""
    return text.lower().encode("utf-8", "replace").translate(_GAPS).split()


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the words, one after another, and how many each word has (at least one)."""
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    length = np.array([len(m) for m in marked], np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(length)
    word = np.repeat(np.arange(len(words)), length)
    room = ends[word] - np.arange(len(codes))
    found, owner = [np.array([zlib.crc32(w) & ((1 << BITS) - 1) for w in words], np.int64)], [np.arange(len(words))]
    mixed = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        mixed[:len(codes) - n + 1] = (mixed[:len(codes) - n + 1] ^ codes[n - 1:]) * np.uint32(0x9E3779B1)
        if n in ORDERS:
            at = np.flatnonzero(room >= n)
            h = mixed[at] ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            found.append(((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)).astype(np.int64))
            owner.append(word[at])
    flat, who = np.concatenate(found), np.concatenate(owner)
    return flat[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(words))


class Model:
    """Embeddings (buckets, dimensions), weights (dimensions, 2) and bias of the softmax."""

    def __init__(self, embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.embeddings, self.weights, self.bias = embeddings, weights, bias

    def values(self) -> tuple[np.ndarray, float]:
        """Average and softmax are linear up to the last step, so a bucket adds one number to the log-odds."""
        return self.embeddings @ (self.weights[:, 1] - self.weights[:, 0]), float(self.bias[1] - self.bias[0])


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fits embeddings and softmax together, by Adam on batches of documents.

    Both labels weigh alike, however rare one is. With one label only, or none, the bias alone decides.
    """
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.05, (1 << BITS, DIMENSIONS)).astype(np.float32)
    w = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(e * 0, w, np.array([0.0, -5.0 if not any(labels) else 5.0]))
    # Buckets that few documents have tell nothing about others; what stays is numbered from 0.
    seen = np.zeros(1 << BITS, np.int64)
    picks = []
    for text in texts:
        bag = sorted(set(words_of(text)))
        pick = np.append(subwords(bag)[0] if bag else np.zeros(0, np.int64), np.full(END_TIMES, END))
        mine, times = np.unique(pick, return_counts=True)
        seen[mine] += 1
        picks.append((mine.astype(np.int32), (times / len(pick)).astype(np.float32)))
    index, value, size = [], [], []
    for mine, share in picks:
        kept = seen[mine] >= LEAST_DOCS
        index.append(mine[kept])
        value.append(share[kept])
        size.append(int(kept.sum()))
    del picks
    val = np.concatenate(value)
    number = np.cumsum(seen >= LEAST_DOCS, dtype=np.int32) - 1
    used, col = np.flatnonzero(seen >= LEAST_DOCS), number[np.concatenate(index)]
    del index, value
    bounds = np.concatenate([[0], np.cumsum(size)])
    part = e[used]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (part, w, b)]
    # Batches hold both labels in the sample's proportion; those of one label weigh as much as those of the other.
    decay = np.float32(DECAY * max(1.0, 2 * DOCS_PER_LABEL / len(y)) ** 2)
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()).astype(np.float32)
    t = 0
    while t < STEPS:
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            if t == STEPS:
                break
            rate = RATE * (1 - t / STEPS)
            t += 1
            batch = batch[np.array(size)[batch] > 0]
            if not len(batch):
                continue
            pick = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in batch])
            n = (bounds[batch + 1] - bounds[batch]).astype(np.int64)
            begin, c, x = np.cumsum(n) - n, col[pick], val[pick]
            mean = np.stack([np.add.reduceat(x * part[c, k], begin) for k in range(DIMENSIONS)], 1)
            z = mean @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            g = (p * weight[batch, None] / len(batch)).astype(np.float32)
            back = np.repeat(g @ w.T, n, axis=0) * x[:, None]
            ge = np.stack([np.bincount(c, back[:, k], minlength=len(used)) for k in range(DIMENSIONS)], 1).astype(np.float32)
            for p_, g_, (m, v) in zip((part, w, b), (ge + decay * part, mean.T @ g, g.sum(0)), state, strict=True):
                m += 0.1 * (g_ - m)
                v += 0.01 * (g_ * g_ - v)
                p_ -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    out = np.zeros((1 << BITS, DIMENSIONS), np.float32)
    out[used] = part
    return Model(out, w, b)


class Scorer:
    """Scores of whole texts; the contributions of words are remembered."""

    def __init__(self, values: np.ndarray, bias: float):
        self.buckets, self.bias = values, bias
        self.memo: dict[bytes, tuple[float, int]] = {}

    def score(self, texts: list[str | None]) -> list[float]:
        split = [set(words_of(t)) if t else set() for t in texts]
        missing = list(set().union(*split) - self.memo.keys())
        if len(self.memo) + len(missing) > MEMO_WORDS:
            self.memo = {}
            missing = list(set().union(*split))
        if missing:
            flat, n = subwords(missing)
            sums = np.add.reduceat(self.buckets[flat], np.cumsum(n) - n)
            self.memo |= zip(missing, zip(sums.tolist(), n.tolist(), strict=True), strict=True)
        out = []
        for s in split:
            got = list(map(self.memo.__getitem__, s))
            size = sum(n for _, n in got) + END_TIMES
            z = self.bias + (sum(v for v, _ in got) + END_TIMES * float(self.buckets[END])) / size
            out.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
        return out


def held_out(key):
    """Rows whose labels are not learned: crc32 of the key as text is divisible by 5. A null key: false."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", docs_per_label: int = DOCS_PER_LABEL, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Trains on a bounded sample of labelled rows that are not held out.

    The sample has about `docs_per_label` documents of each label (0 and 1; others and nulls are ignored), chosen by
    hash, of at most `sample_bytes` bytes each. Labels are counted over all rows; only the sampled numbers are
    broadcast, so the documents aren't shuffled. Of rows of `labels` that repeat a key the largest label counts, of documents
    that repeat one the smallest text. Without documents or labels the model calls nothing toxic.
    """
    rows = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).where(F.col("_key").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_key")))
    n = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    share = F.when(F.col("_label") == 1, F.lit(docs_per_label / max(n.get(1, 0), 1))).otherwise(F.lit(docs_per_label / max(n.get(0, 0), 1)))
    # Twice the expected number at most, whatever the hash does.
    sample = rows.where(F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(1_000_003)) < F.lit(1_000_003) * share).groupBy("_key").agg(F.max("_label").alias("_label")).limit(4 * docs_per_label)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.octet_length("_text") <= sample_bytes)
    found = sorted((r[0], r[1], r[2]) for r in texts.join(F.broadcast(sample), "_key").groupBy("_key", "_label").agg(F.min("_text").alias("_text")).collect())
    return train([t for _, _, t in found], [y for _, y, _ in found])


def score_texts(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 at a score of 0.5 or more) to the columns named in `carry`.

    Only the text counts. A null or empty text, or one without words, gets the score of an
    empty bag. Every row
    gives one row. The model is of bounded size and broadcast; nothing is shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model.values())
    keep = [c for c in carry if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            texts = batch.column(0)
            scores = [x for lo, hi in slices(texts) for x in scorer.score(texts.slice(lo, hi - lo).to_pylist())]
            yield pa.RecordBatch.from_arrays([*columns_of(batch, keep), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32())], [*keep, "score", "predicted"])

    schema = StructType([docs.schema[c] for c in keep]).add("score", DoubleType()).add("predicted", IntegerType())
    return docs.select(F.col(text).alias("_text"), *keep).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without the documents that the model predicts to be toxic; all columns stay."""
    rows = docs.select(F.col(text).alias("text"), F.struct(*docs.columns).alias("row"))
    return score_texts(rows, model, carry=("row",)).where("predicted = 0").select("row.*")
