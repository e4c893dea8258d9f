"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, slices, small_batches

#: Lengths of the character n-grams, hashed together into 2 ** BITS buckets.
ORDERS = (1, 2, 3)
BITS = 16
#: Documents of each language that the model is fitted on: a stratified sample, chosen by hash.
DOCS_PER_LANGUAGE = 2000
#: Languages beyond which fit() fails; a language takes half a megabyte on the driver and in each worker.
LANGUAGES = 2000
#: Bytes of text scored at once.
SCORED_BYTES = 1 << 20
SMOOTHING = 0.5


def _buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of the n-gram at each character, by order, and where each text starts; 2 ** BITS where no n-gram starts."""
    gap = max(ORDERS)
    codes = np.frombuffer("".join(t.lower() + "\0" * gap for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t.lower()) + gap for t in texts])
    between = (ends[:, None] - np.arange(1, gap + 1)).ravel()
    mixed, out = np.zeros(len(codes), np.uint32), []
    for n in range(1, gap + 1):
        mixed[:len(codes) - n + 1] = (mixed[:len(codes) - n + 1] ^ codes[n - 1:]) * np.uint32(0x9E3779B1)
        if n in ORDERS:
            h = mixed ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            h = ((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)).astype(np.int32)
            h[between] = 1 << BITS
            out.append(h)
    return out, ends - [len(t.lower()) + gap for t in texts]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(key):
    """Rows kept for measuring: crc32 of the key as text leaves 1 on division by 3. A null key: false."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log-probabilities, (languages, buckets), of rows that are not held out.

    Fitted on about `docs_per_language` documents of each language; counts of whole texts are summed on the executors. What
    reaches the driver is bounded by languages times buckets; with more than `languages` of them, which no table of
    real languages has, it raises ValueError. Names differing in case are different languages. Rows that repeat others count
    as often as they come; null texts and null languages are left out. Without rows there is no language.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).where(F.col("_lang").isNotNull() & ~held_out(F.col("_key")))
    counts = {r[0]: r[1] for r in rows.groupBy("_lang").count().limit(languages + 1).collect()}
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages")
    if not counts:
        return [], np.zeros((0, (1 << BITS) + 1))
    # Whole languages up to the bound, else the rows whose hash is below the language's share.
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, docs_per_language / n))])
    sample = rows.where(F.pmod(F.xxhash64("_key"), F.lit(1_000_003)) < F.lit(1_000_003) * F.coalesce(F.try_element_at(share, F.col("_lang")), F.lit(0.0)))
    sample = sample.where("_text is not null").select("_text", "_lang")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, names = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                for name in sorted(set(names[lo:hi])):
                    mine = [t for t, x in zip(texts.slice(lo, hi - lo).to_pylist(), names[lo:hi], strict=True) if x == name]
                    for h in _buckets(mine)[0]:
                        total[name] = total.get(name, 0) + np.bincount(h, minlength=(1 << BITS) + 1)[:-1]
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["name", "bucket", "n"])

    found = sample.mapInArrow(tally, "name string, bucket long, n long").groupBy("name", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("name").to_pylist()))
    matrix = np.full((len(names), (1 << BITS) + 1), SMOOTHING)
    at = {name: i for i, name in enumerate(names)}
    np.add.at(matrix, (np.array([at[x] for x in found.column("name").to_pylist()], np.int64), found.column("bucket").to_numpy()), found.column("n").to_numpy())
    matrix[:, -1] = 0
    with np.errstate(divide="ignore"):
        matrix = np.log(matrix) - np.log(matrix.sum(1, keepdims=True))
    matrix[:, -1] = 0  # no n-gram
    return names, matrix


def score(texts: list[str | None], names: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """The likeliest language of each text and its posterior probability; languages weigh alike."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    real = [i for i, t in enumerate(texts) if t and has_letter(t)]
    if not names or not real:
        return langs, scores
    buckets, starts = _buckets([texts[i] for i in real])
    sums = np.array([sum(np.add.reduceat(row[h], starts, dtype=np.float64) for h in buckets) for row in matrix]).T
    best = sums.argmax(1)
    top = 1 / np.exp(sums - sums[np.arange(len(real)), best][:, None]).sum(1)
    for i, b, p in zip(real, best.tolist(), top.tolist(), strict=True):
        langs[i], scores[i] = names[b], p
    return langs, scores


def identify(docs: DataFrame, names: list[str], matrix: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Predicts the language of every whole text: doc_id, held_out, lang_pred and score.

    Nothing but the text decides; of equally likely languages the first in code point order is taken. A null text or one without a letter is `und` with score 0, as is every text if no
    language was learned. A null key is not held out. Every row gives one row; other columns are ignored.
    The matrix, of bounded size, is broadcast; texts are scored in batches without a shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((names, matrix))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            (texts,) = columns_of(batch, ["text"])
            langs: list[str] = []
            scores: list[float] = []
            for lo, hi in slices(texts, SCORED_BYTES):
                a, b = score(texts.slice(lo, hi - lo).to_pylist(), names, matrix)
                langs += a
                scores += b
            yield pa.RecordBatch.from_arrays([*columns_of(batch, ["doc_id", "held_out"]), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    slim = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return slim.mapInArrow(predict, f"doc_id {dict(docs.dtypes)[key]}, held_out boolean, lang_pred string, score double")
