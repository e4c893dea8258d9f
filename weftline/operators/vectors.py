"""Term weights, word vectors and their neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.tables import SharedTables

#: Fixed value: terms are two characters or more, lower-case letters first.
TERM = "[a-z][a-z0-9-]+"
#: Terms whose vectors the driver may hold, and words that CBoW may train.
DRIVER_TERMS, MOST_TERMS = 200_000, 1 << 31


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf)."""
    terms = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame, key: str = "doc_id", min_df: int = 5, max_df: int | None = None) -> DataFrame:
    """(term, df) of terms in at least min_df and at most max_df documents."""
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return df.where(F.col("df") <= max_df) if max_df else df


def tf_idf(docs: DataFrame, key: str = "doc_id", text: str = "text", min_df: int = 5, max_df: int | None = None, use_idf: bool = True) -> DataFrame:
    """(key, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), each document scaled to length 1.

    n counts all documents, those without terms as well.
    """
    counts = term_counts(docs, key, text)
    n = docs.agg(F.count("*").alias("n"))
    kept = counts.join(document_frequency(counts, key, min_df, max_df), "term").crossJoin(F.broadcast(n))
    raw = F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1) if use_idf else F.col("tf").cast("double")
    rows = kept.select(key, "term", raw.alias("raw"))
    return rows.withColumn("length", F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))).select(key, "term", (F.col("raw") / F.col("length")).alias("weight"))


#: Terms in a block of the basis, and documents in a task, about.
TERM_BLOCK, TASK_DOCS = 65_536, 32_768


def _block(path: str, b: int) -> np.ndarray:
    """A block of a basis, in the order of the terms' numbers."""
    files, root = fs.FileSystem.from_uri(path)
    table = pq.ParquetDataset(f"{root}/b={b}", filesystem=files, partitioning=None).read().sort_by("i")
    return np.stack([c.to_numpy() for c in table.drop_columns("i").columns], 1)


def _numbers(batch: pa.RecordBatch, skip: int) -> np.ndarray:
    return np.stack([batch.column(j).to_numpy() for j in range(skip, batch.num_columns)], 1)


def word_svd(weights: DataFrame, k: int, key: str = "doc_id", rounds: int = 8, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """The k largest singular values, and (word, vec), written: right singular vectors times values. Signs are arbitrary.

    Subspace iteration of k + 8 directions, for any number of terms: the basis is a table in blocks of about TERM_BLOCK terms. A task holds about TASK_DOCS documents
    and reads one block at a time; the blocks' products are summed by a shuffle. The driver gets matrices of directions x directions only.
    Tables are below spark.checkpoint.dir and deleted at the end, all but the result.
    """
    spark = weights.sparkSession
    tables, kept = SharedTables(spark, "svd"), SharedTables(spark, "svd-words")
    weights = tables.save(weights.select(key, "term", "weight"), "weights")
    count, docs = weights.select("term").distinct().count(), weights.select(key).distinct().count()
    if not 0 < k < min(count, docs):
        raise ValueError("k must be positive and below both dimensions")
    blocks = -(-count // TERM_BLOCK)
    place = Window.partitionBy("b").orderBy("term")
    terms = tables.save(weights.select("term").distinct().withColumn("b", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")).withColumn("i", F.row_number().over(place) - 1), "terms")
    pairs = weights.join(terms, "term").groupBy(key).agg(F.collect_list(F.struct("b", "i", "weight")).alias("w"))
    parts = max(1, -(-docs // TASK_DOCS))
    rows = tables.save(pairs.select(F.col("w.b").alias("b"), F.col("w.i").alias("i"), F.col("w.weight").alias("w")).repartition(parts), "rows")
    width = min(k + 8, count)

    def schema(n: int) -> str:
        return ", ".join(f"q{j} double" for j in range(n))

    def write(basis: DataFrame, name: str) -> str:
        basis.repartition("b").write.partitionBy("b").parquet(path := f"{tables.root}/{name}")
        return path

    def start(group: pa.Table) -> pa.Table:
        at = group.sort_by("i")
        x = np.random.default_rng([seed, at["b"][0].as_py()]).normal(size=(at.num_rows, width))
        return pa.table([at["b"], at["i"], *x.T], ["b", "i", *[f"q{j}" for j in range(width)]])

    def multiply(path: str, n: int, gram: bool) -> DataFrame:
        """Of a basis of n columns the products with the matrix and its transpose, one row for each task and term; or each task's n x n products of the documents' rows."""
        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [batch for batch in batches if batch.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            sizes = pc.list_value_length(table["b"]).to_numpy()
            b, i, w = (pc.list_flatten(table[c]).to_numpy() for c in ("b", "i", "w"))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(b, kind="stable")  # inside a block documents stay together
            b, i, w, doc = b[order], i[order], w[order], doc[order]
            cut = np.searchsorted(b, np.arange(blocks + 1))
            y = np.zeros((len(sizes), n))
            for c in range(blocks):
                basis = _block(path, c) if cut[c] < cut[c + 1] else None
                for lo in range(cut[c], cut[c + 1], 1 << 16):
                    hi = min(lo + (1 << 16), cut[c + 1])
                    first = np.flatnonzero(np.append(True, doc[lo + 1:hi] != doc[lo:hi - 1]))
                    y[doc[lo:hi][first]] += np.add.reduceat(basis[i[lo:hi]] * w[lo:hi, None], first)
            if gram:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (y.T @ y).T], [f"q{j}" for j in range(n)])
                return
            for c in range(blocks):
                by_term = cut[c] + np.argsort(i[cut[c]:cut[c + 1]], kind="stable")
                ids, out = np.unique(i[by_term]), None
                out = np.zeros((len(ids), n))
                for lo in range(0, len(by_term), 1 << 16):
                    at = by_term[lo:lo + (1 << 16)]
                    first = np.flatnonzero(np.append(True, i[at][1:] != i[at][:-1]))
                    out[np.searchsorted(ids, i[at][first])] += np.add.reduceat(y[doc[at]] * w[at, None], first)
                for lo in range(0, len(ids), 10_000):
                    some = out[lo:lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), c, np.int32)), pa.array(ids[lo:lo + 10_000].astype(np.int32)), *[pa.array(x) for x in some.T.copy()]], ["b", "i", *[f"q{j}" for j in range(n)]])

        made = rows.mapInArrow(product, schema(n) if gram else f"b int, i int, {schema(n)}")
        return made if gram else made.groupBy("b", "i").agg(*[F.sum(f"q{j}").alias(f"q{j}") for j in range(n)])

    def turned(basis: DataFrame, turn: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x) for x in (_numbers(batch, 2) @ turn).T.copy()]], ["b", "i", *[f"q{j}" for j in range(turn.shape[1])]])

        return basis.mapInArrow(run, f"b int, i int, {schema(turn.shape[1])}")

    def triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if batch.num_rows:
                x = _numbers(batch, 0)
                r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in r.T.copy()], [f"q{j}" for j in range(r.shape[1])])

    def read(path: str, n: int) -> DataFrame:
        return spark.read.schema(f"b int, i int, {schema(n)}").parquet(path).select("b", "i", *[f"q{j}" for j in range(n)])

    path, n = write(terms.groupBy("b").applyInArrow(start, f"b int, i int, {schema(width)}"), "basis"), width
    for t in range(rounds):
        raw = read(write(multiply(path, n, False), f"product{t}"), n)
        # The triangle of the tasks' triangles: the directions made orthonormal, dependent ones left out.
        r = np.linalg.qr(raw.drop("b", "i").mapInArrow(triangles, schema(n)).toPandas().to_numpy(), mode="r")
        _, sizes, turn = np.linalg.svd(r)
        good = sizes > sizes[0] * 1e-13
        path, n = write(turned(raw, turn[good].T / sizes[good]), f"basis{t}"), int(good.sum())
    square = multiply(path, n, True).toPandas().to_numpy()
    values, turn = np.linalg.eigh(square.reshape(-1, n, n).sum(0))
    order = np.argsort(-values)[:k]
    sigma = np.zeros(k)
    sigma[:len(order)] = np.sqrt(np.maximum(values[order], 0))
    last = np.zeros((n, k))
    last[:, :len(order)] = turn[:, order] * sigma[:len(order)]
    words = turned(read(path, n), last).join(terms, ["b", "i"]).select(F.col("term").alias("word"), F.array(*[f"q{j}" for j in range(k)]).alias("vec"))
    words = kept.save(words, "words")
    tables.delete()
    return sigma, words


def truncated_svd(weights: DataFrame, k: int, key: str = "doc_id", rounds: int = 8, seed: int = 0) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Terms in order, the k largest singular values, and the word vectors (terms x k), of word_svd() on the driver: at most DRIVER_TERMS terms."""
    sigma, words = word_svd(weights, k, key, rounds, seed)
    found = words.orderBy("word").limit(DRIVER_TERMS + 1).collect()
    if len(found) > DRIVER_TERMS:
        raise ValueError("too many terms for the driver; use word_svd")
    return [r.word for r in found], sigma, np.array([r.vec for r in found])


def as_dictionary(spark, terms: list[str], vectors: np.ndarray) -> DataFrame:
    """(word, vec)."""
    return spark.createDataFrame(pd.DataFrame({"word": terms, "vec": [v.tolist() for v in vectors]}), "word string, vec array<double>")


#: Queries that are broadcast at once, and vectors compared with them at once.
QUERY_BLOCK, WORD_BLOCK = 10_000, 1_024


def _units(lists: pa.Array) -> np.ndarray:
    """Rows of vectors of one length divided by their norms; NaN where that is 0 or a component is missing."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(1))[:, None]


def nearest(queries: DataFrame, words: DataFrame, k: int = 8, key: str = "word", vec: str = "vec") -> DataFrame:
    """(query, rank, key, cosine) of the k words nearest to each query, without itself; ties go to the smaller key.

    Queries are a stated set. Their unit vectors are written once and broadcast in blocks of about QUERY_BLOCK; every task multiplies its words with a block and keeps the best k rows a query, so the
    shuffle moves k rows a query and task. Null vectors take no part, and those without length have no cosine. All vectors must have the same length.
    """
    spark = words.sparkSession
    tables = SharedTables(spark, "nearest")
    asked = tables.save(queries.where(F.col(vec).isNotNull()).select(F.col(key).alias("query"), F.col(vec).cast("array<double>").alias("v")), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    rows = words.where(F.col(vec).isNotNull()).select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("v"))
    kind = dict(queries.dtypes)[key]
    out = None
    for i in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i).toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast((table["query"].combine_chunks(), _units(table["v"].combine_chunks()) if table.num_rows else None))

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            held = None  # the best k of each query so far: keys in their order, and cosines
            for batch in batches:
                for lo in range(0, batch.num_rows if q is not None else 0, WORD_BLOCK):
                    part = batch.slice(lo, WORD_BLOCK)
                    near = np.round(q @ _units(part.column(1)).T, 6)
                    keys = np.array(part.column(0).to_pylist(), object)
                    at = {x: j for j, x in enumerate(keys.tolist())}
                    own = np.array([at.get(n, -1) for n in names.to_pylist()])
                    hit = np.flatnonzero(own >= 0)
                    near[hit, own[hit]] = np.nan
                    every = np.broadcast_to(keys, near.shape)
                    if held is not None:
                        every, near = np.concatenate([held[0], every], 1), np.concatenate([held[1], near], 1)
                    held = _best(every, near, k)
            if held is not None:
                row, column = np.nonzero(~np.isnan(held[1]))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), pa.array(held[0][row, column].tolist(), names.type), pa.array(held[1][row, column])], ["query", "key", "cosine"])

        found = rows.mapInArrow(compare, f"query {kind}, key {kind}, cosine double")
        out = found if out is None else out.union(found)
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "key")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query", F.col("key").alias(key), "cosine", "rank")


def _best(keys: np.ndarray, cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest cosines of each row with their keys; of equal ones at the edge those with the smaller keys, NaN last."""
    score = np.where(np.isnan(cosines), -np.inf, cosines)
    n = min(k, score.shape[1])
    pick = np.argpartition(-score, n - 1, axis=1)[:, :n]
    edge = np.take_along_axis(score, pick, 1).min(1)
    for r in np.flatnonzero((score >= edge[:, None]).sum(1) > n).tolist():  # ties at the edge
        pick[r] = sorted(np.flatnonzero(score[r] >= edge[r]).tolist(), key=lambda j, r=r: (-score[r, j], keys[r, j]))[:n]
    return np.take_along_axis(keys, pick, 1), np.take_along_axis(cosines, pick, 1)


def pair_cosine(pairs: DataFrame, words: DataFrame, key: str = "word", vec: str = "vec") -> DataFrame:
    """Adds the cosine of columns a and b; null if a word is missing."""
    side = lambda c: words.select(F.col(key).alias(c), F.col(vec).alias(f"_{c}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", F.round(V.cosine(F.col("_a"), F.col("_b")), 6).alias("cosine"))


def group_heatmap(words: DataFrame, group: str, vec: str = "vec") -> DataFrame:
    """(a, b, cosine) of the mean vectors of all pairs of groups: the tidy data of a heat map."""
    mean = words.select(group, F.posexplode(vec).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lengths = mean.groupBy(group).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    m = mean.join(lengths, group).select(group, "i", (F.col("x") / F.col("n")).alias("x"))
    a, b = m.select(F.col(group).alias("a"), "i", F.col("x").alias("xa")), m.select(F.col(group).alias("b"), "i", F.col("x").alias("xb"))
    return a.join(b, "i").groupBy("a", "b").agg(F.round(F.sum(F.col("xa") * F.col("xb")), 6).alias("cosine"))


def component_norms(words: DataFrame, vec: str = "vec") -> DataFrame:
    """(component, norm): the spectrum."""
    return words.select(F.posexplode(vec).alias("component", "x")).groupBy("component").agg(F.round(F.sqrt(F.sum(F.col("x").cast("double") * F.col("x"))), 6).alias("norm"))


def ngram_vectors(tokens: DataFrame, dictionary: DataFrame, n: int, m: int, key: str = "doc_id") -> DataFrame:
    """(key, start, vector): the first m components of n words in a row, one after another. Windows with an unknown word are left out.

    `tokens` has key, tok_no and word.
    """
    known = tokens.join(dictionary.select("word", V.prefix(F.col("vec"), m).alias("v")), "word", "left")
    order = Window.partitionBy(key).orderBy("tok_no")
    parts = [F.col("v") if j == 0 else F.lead("v", j).over(order) for j in range(n)]
    rows = known.select(key, F.col("tok_no").alias("start"), F.array(*parts).alias("parts"))
    return rows.where(F.forall("parts", lambda p: p.isNotNull())).select(key, "start", F.flatten("parts").alias("vector")).where(F.size("vector") == n * m)


def clusters(words: DataFrame, k: int = 8, vec: str = "vec", seed: int = 0) -> DataFrame:
    """Adds cluster, by k-means."""
    rows = words.withColumn("features", array_to_vector(F.col(vec)))
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows).transform(rows).drop("features")


def principal_components(words: DataFrame, k: int = 2, vec: str = "vec") -> DataFrame:
    """Adds pc, the first k principal components of the centred vectors. Signs are arbitrary."""
    rows = words.withColumn("_x", array_to_vector(F.col(vec)))
    mean = np.array([r[0] for r in words.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).orderBy("i").select("x").collect()])
    model = PCA(k=k, inputCol="_x", outputCol="_y").fit(rows)
    shift = model.pc.toArray().T @ mean
    return model.transform(rows).withColumn("pc", F.zip_with(vector_to_array("_y"), F.array(*map(F.lit, shift.tolist())), lambda y, s: y - s)).drop("_x", "_y")


def reduce_dimension(words: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """Replaces vec by its projection on the `dim` principal directions of all vectors, the vectors themselves uncentred. Signs are arbitrary.

    Every partition adds up its vectors' products; the driver gets one matrix of components x components, however many words there are.
    """
    spark = words.sparkSession

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, product = 0, None, None
        for batch in batches:
            known = batch.column(0).drop_null()
            if len(known):
                x = known.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(known), -1)
                total, product = (x.sum(0), x.T @ x) if total is None else (total + x.sum(0), product + x.T @ x)
                n += len(x)
        if n:
            rows = np.vstack([product, total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array([n] * len(rows), pa.int64()), pa.array(list(rows))], ["i", "n", "x"])

    parts = words.select(vec).mapInArrow(add_up, "i long, n long, x array<double>")
    sums = parts.select("i", "n", F.posexplode("x").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas()
    size = int(sums["j"].max()) + 1 if len(sums) else 0
    if not 0 < dim <= size:
        raise ValueError("dim must be positive and at most the vectors' length")
    table = np.zeros((size + 1, size))
    table[sums["i"], sums["j"]] = sums["x"]
    n = int(sums["n"].iloc[0])
    values, directions = np.linalg.eigh(table[:size] / n - np.outer(table[size], table[size]) / n**2)
    shared = spark.sparkContext.broadcast(directions[:, np.argsort(-values)[:dim]])

    def project(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else (np.asarray(x, float) @ shared.value).tolist())

    return words.withColumn(vec, F.pandas_udf(project, "array<double>")(vec).cast("array<float>"))


def skip_gram(sentences: DataFrame, dim: int = 100, window: int = 5, min_count: int = 5, seed: int = 0) -> DataFrame:
    """(word, vec) by skip-gram."""
    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=min_count, seed=seed, inputCol="tokens", outputCol="_v").fit(sentences)
    return model.getVectors().select("word", vector_to_array("vector").alias("vec"))


#: Words in a block of parameters, tokens that a task trains on, negatives that it draws, and positions updated at once, about.
WORD_ROWS, TASK_TOKENS, POOL, AT_ONCE = 16_384, 1 << 19, 1 << 16, 64


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to the row of `to` at its place; places may repeat."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    to[at[first]] += np.add.reduceat(rows[order], first)


def _train(u: np.ndarray, v: np.ndarray, ids: np.ndarray, sizes: np.ndarray, pool: np.ndarray, window: int, negative: int, rate: float, at_once: int, rng: np.random.Generator) -> np.ndarray:
    """Trains u and v in place on sentences of `sizes` words, negatives from `pool`; how often each word was seen."""
    seen = np.zeros(len(u))
    ends = np.cumsum(sizes)
    lo, hi = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
    steps = np.concatenate([np.arange(-window, 0), np.arange(1, window + 1)])
    places = np.flatnonzero(hi - lo > 1)
    for k in range(0, len(places), at_once):
        p = places[k:k + at_once]
        beside = p[:, None] + steps
        ok = (np.abs(steps) <= rng.integers(1, window + 1, len(p))[:, None]) & (beside >= lo[p][:, None]) & (beside < hi[p][:, None])
        near, n = ids[beside[ok]], ok.sum(1)
        mean = np.add.reduceat(u[near], np.cumsum(n) - n) / n[:, None].astype(np.float32)
        targets = np.concatenate([ids[p][:, None], pool[rng.integers(0, len(pool), (len(p), negative))]], 1)
        out = v[targets]
        g = -1 / (1 + np.exp(-np.clip(np.einsum("ptd,pd->pt", out, mean), -30, 30)))
        g[:, 0] += 1
        g[:, 1:][targets[:, 1:] == targets[:, :1]] = 0
        g = (g * rate).astype(np.float32)
        back = np.einsum("pt,ptd->pd", g, out) / n[:, None].astype(np.float32)
        _add_rows(v, targets.ravel(), (g[:, :, None] * mean[:, None, :]).reshape(-1, u.shape[1]))
        _add_rows(u, near, np.repeat(back, n, 0))
        np.add.at(seen, near, 1)
        np.add.at(seen, ids[p], 1)
    return seen


def cbow(sentences: DataFrame, dim: int = 100, window: int = 5, min_count: int = 5, epochs: int = 5, negative: int = 5, rate: float = 0.05, seed: int = 0, start: DataFrame | None = None) -> DataFrame:
    """(word, vec), written, by continuous bag of words with negative sampling.

    Every task trains on its sentences, about TASK_TOKENS words, from the same parameters; words' parameters are averaged after each epoch, weighted
    by how often a task saw them. `start` (word, vec) continues an earlier training. The vocabulary is cut by `min_count` alone. Parameters are a table
    in blocks of about WORD_ROWS words: a task reads the rows of its words and of POOL negatives drawn anew, one block at a time, and the driver gets one number a block.
    Up to AT_ONCE positions are updated from the same parameters, fewer where a task has few words. Beyond MOST_TERMS words it fails.
    Tables are below spark.checkpoint.dir and deleted at the end, all but the result.
    """
    spark = sentences.sparkSession
    tables, kept = SharedTables(spark, "cbow"), SharedTables(spark, "cbow-words")
    tokens = tables.save(sentences.select("tokens"), "sentences")
    counts = tables.save(tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count), "counts")
    size = counts.count()
    if size > MOST_TERMS:
        tables.delete()
        raise ValueError("too many words; raise min_count")
    if not size:
        tables.delete()
        return spark.createDataFrame([], "word string, vec array<float>")
    blocks = -(-size // WORD_ROWS)
    place = Window.partitionBy("b").orderBy("word")
    words = counts.withColumn("b", F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int")).withColumn("i", (F.row_number().over(place) - 1).cast("int"))
    words = tables.save(words.withColumn("w", F.pow("n", F.lit(0.75))), "words")
    words.select("b", "i", "w").repartition("b").write.partitionBy("b").parquet(noise := f"{tables.root}/noise")
    shares = {r.b: r.w for r in words.groupBy("b").agg(F.sum("w").alias("w")).collect()}
    share = np.array([shares.get(b, 0.0) for b in range(blocks)])
    share /= share.sum()
    # Numbered before they are exploded: in one select each word would get a number.
    each = tokens.select(F.monotonically_increasing_id().alias("s"), "tokens").select("s", F.posexplode("tokens").alias("p", "word"))
    coded = each.join(words.select("word", (F.shiftleft(F.col("b").cast("long"), 32) + F.col("i")).alias("id")), "word")
    parts = max(1, -(-int(words.agg(F.sum("n")).first()[0]) // TASK_TOKENS))
    coded = coded.groupBy("s").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "id"))), lambda x: x["id"]).alias("ids"))
    coded = tables.save(coded.repartition(parts, "s").select(F.spark_partition_id().alias("part"), "ids"), "coded")
    names = [f"q{j}" for j in range(2 * dim)]
    schema = "b int, i int, " + ", ".join(f"{c} float" for c in names)

    def table(b: int, i: np.ndarray, x: np.ndarray) -> pa.Table:
        return pa.table([pa.array(np.full(len(i), b, np.int32)), pa.array(i.astype(np.int32)), *[pa.array(c) for c in x.astype(np.float32).T.copy()]], ["b", "i", *names])

    def begin(group: pa.Table) -> pa.Table:
        at = group.sort_by("i")
        b = at["b"][0].as_py()
        x = np.zeros((at.num_rows, 2 * dim), np.float32)
        x[:, :dim] = (np.random.default_rng([seed, b]).random((at.num_rows, dim)) - 0.5) / dim
        for row, vec in enumerate(at["vec"]):
            if vec.is_valid:
                x[row, :dim] = vec.as_py()
        return table(b, at["i"].to_numpy(), x)

    def write(rows: DataFrame, name: str) -> str:
        rows.repartition("b").write.partitionBy("b").parquet(path := f"{tables.root}/{name}")
        return path

    before = start.select("word", F.col("vec").cast("array<float>").alias("vec")) if start is not None else spark.createDataFrame([], "word string, vec array<float>")
    path = write(words.join(before, "word", "left").select("b", "i", "vec").groupBy("b").applyInArrow(begin, schema), "start")

    for epoch in range(epochs):
        def train(group: pa.Table) -> pa.Table:
            rng = np.random.default_rng([seed, epoch, group["part"][0].as_py()])
            sizes = pc.list_value_length(group["ids"]).to_numpy().astype(np.int64)
            ids = pc.list_flatten(group["ids"]).to_numpy()
            pool = []
            for b, n in enumerate(rng.multinomial(POOL, share).tolist()):
                if n:
                    sums = np.cumsum(_block(noise, b)[:, 0])
                    pool.append((b << 32) + np.minimum(np.searchsorted(sums, rng.random(n) * sums[-1], side="right"), len(sums) - 1))
            pool = np.concatenate(pool)
            known = np.unique(np.concatenate([ids, pool]))
            cut = np.searchsorted(known, np.arange(blocks + 1) << 32)
            x = np.empty((len(known), 2 * dim), np.float32)
            for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                x[cut[b]:cut[b + 1]] = _block(path, b)[known[cut[b]:cut[b + 1]] & 0xFFFFFFFF]
            u, v = x[:, :dim].copy(), x[:, dim:].copy()
            own = np.searchsorted(known, ids)
            seen = _train(u, v, own, sizes, np.searchsorted(known, pool), window, negative, rate * (1 - epoch / epochs), max(1, min(AT_ONCE, len(np.unique(own)) // 8)), rng)
            out = []
            for b in range(blocks):
                at = cut[b] + np.flatnonzero(seen[cut[b]:cut[b + 1]])
                if len(at):
                    out.append((b, (known[at] & 0xFFFFFFFF).astype(np.int64).tobytes(), seen[at].tobytes(), np.concatenate([u[at], v[at]], 1).tobytes()))
            return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)] if out else [pa.array([], pa.int32()), *[pa.array([], pa.binary())] * 3], ["b", "i", "n", "x"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The blocks of a partition, one after another; words that no task saw keep their parameters."""
            now, old = None, None
            for batch in batches:
                for b, i, n, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if b != now:
                        if now is not None:
                            yield from done(now, old, total, weight)
                        now, old = b, _block(path, b)
                        total, weight = np.zeros(old.shape), np.zeros(len(old))
                    if i is not None:
                        at, n = np.frombuffer(i, np.int64), np.frombuffer(n)
                        total[at] += np.frombuffer(x, np.float32).reshape(-1, 2 * dim) * n[:, None]
                        weight[at] += n
            if now is not None:
                yield from done(now, old, total, weight)

        def done(b: int, old: np.ndarray, total: np.ndarray, weight: np.ndarray) -> list[pa.RecordBatch]:
            hit = weight > 0
            old = old.copy()
            old[hit] = total[hit] / weight[hit][:, None]
            return table(b, np.arange(len(old)), old).to_batches(max_chunksize=4096)

        trained = coded.groupBy("part").applyInArrow(train, "b int, i binary, n binary, x binary")
        every = words.select("b").distinct().select("b", *[F.lit(None).cast("binary").alias(c) for c in ("i", "n", "x")])
        merged = trained.union(every).repartition(blocks, "b").sortWithinPartitions("b").mapInArrow(average, schema)
        path = write(merged, f"epoch{epoch}")
    last = spark.read.schema(schema).parquet(path).select("b", "i", F.array(*names[:dim]).alias("vec"))
    out = kept.save(last.join(words, ["b", "i"]).select("word", "vec"), "words")
    tables.delete()
    return out
