import numpy as np
import pytest

from weftline.operators import vectors


def corpus(spark):
    return spark.createDataFrame([(1, "pron1 say hello"), (2, "think pron1"), (3, "hello parrot pron1")], "doc_id int, text string")


def test_tf_idf_and_svd(spark):
    weights = vectors.tf_idf(corpus(spark), min_df=1)
    rows = weights.collect()
    terms = sorted({r.term for r in rows})
    assert terms == ["hello", "parrot", "pron1", "say", "think"]
    w = np.zeros((3, 5))
    for r in rows:
        w[r.doc_id - 1, terms.index(r.term)] = r.weight
    assert np.allclose((w**2).sum(1), 1) and w[:, 1].nonzero()[0].tolist() == [2]
    names, sigma, found = vectors.truncated_svd(weights, 2)
    assert names == terms and found.shape == (5, 2)
    u, s, vt = np.linalg.svd(w)
    assert np.allclose(sigma, s[:2])
    assert np.allclose(found @ found.T, (vt[:2].T * s[:2] ** 2) @ vt[:2])
    with pytest.raises(ValueError):
        vectors.truncated_svd(weights, 3)


def test_svd_queries_take_terms_of_five_documents(spark, tmp_path):
    from weftline import queries

    rng = np.random.default_rng(1)
    rows = [(i, " ".join("w" + str(j) for j in range(40) if rng.random() < 0.4 or (j < 2 and i < 5))) for i in range(45)]
    rows = [(i, t + (" rare" if i < 5 else "") + (" rarer" if i < 4 else "")) for i, t in rows]
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: r.vec for r in queries.svd_word_vectors(spark, str(tmp_path)).collect()}
    assert "rare" in got and "rarer" not in got and {len(v) for v in got.values()} == {32}
    assert queries.svd_singular_values(spark, str(tmp_path)).count() == 32


def test_max_df(spark):
    counts = vectors.term_counts(corpus(spark))
    assert {r.term for r in vectors.document_frequency(counts, min_df=2, max_df=2).collect()} == {"hello"}


def test_ngrams_reject_unknown_words(spark):
    dictionary = spark.createDataFrame([(w, [float(i), 9.0]) for i, w in enumerate(["parrot", "think", "say", "hello"])], "word string, vec array<double>")
    tokens = spark.createDataFrame([(1, i, w) for i, w in enumerate("parrot think and say hello hello".split())], "doc_id int, tok_no int, word string")
    got = vectors.ngram_vectors(tokens, dictionary, 2, 1).orderBy("start").collect()
    assert [r.vector for r in got] == [[0.0, 1.0], [2.0, 3.0], [3.0, 3.0]]
    assert vectors.ngram_vectors(tokens, dictionary, 9, 1).count() == 0


def test_pair_cosine_of_missing_words(spark):
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("z", [0.0, 0.0])], "word string, vec array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "q"), ("a", "z")], "a string, b string")
    assert {r.b: r.cosine for r in vectors.pair_cosine(pairs, words).collect()} == {"b": 0.707107, "q": None, "z": None}


def test_cbow_brings_like_words_together(spark):
    rng = np.random.default_rng(0)
    rows = [(["x" + str(rng.integers(3)) if s else "y" + str(rng.integers(3)) for _ in range(8)],) for s in rng.integers(0, 2, 300)]
    df = spark.createDataFrame(rows, "tokens array<string>").repartition(2)
    got = {r.word: np.array(r.vec) for r in vectors.cbow(df, dim=8, epochs=4, rate=0.1).collect()}
    cos = lambda a, b: got[a] @ got[b] / np.linalg.norm(got[a]) / np.linalg.norm(got[b])
    assert cos("x0", "x1") > cos("x0", "y1")


def test_cbow_keeps_every_word_or_fails(spark, tmp_path, monkeypatch):
    from weftline import queries

    df = spark.createDataFrame([("one two three",)] * 6, "text string").coalesce(1)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.cbow_vectors(spark, str(tmp_path)).collect()
    assert {r.word for r in got} == {"one", "two", "three"} and {len(r.vec) for r in got} == {100}
    monkeypatch.setattr(vectors, "MOST_TERMS", 2)
    with pytest.raises(ValueError):
        queries.cbow_vectors(spark, str(tmp_path))


def test_cbow_holds_no_vocabulary_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(vectors, "WORD_ROWS", 16)
    monkeypatch.setattr(vectors, "TASK_TOKENS", 400)
    monkeypatch.setattr(type(spark.range(0)), "toPandas", lambda self: pytest.fail("parameters went to the driver"))
    rng = np.random.default_rng(1)
    rows = [([f"{'xy'[s]}{rng.integers(30)}" for _ in range(10)],) for s in rng.integers(0, 2, 200)]
    df = spark.createDataFrame(rows, "tokens array<string>")
    got = {r.word: np.array(r.vec) for r in vectors.cbow(df, dim=8, epochs=2, min_count=1, window=3, start=spark.createDataFrame([("x1", [9.0] * 8)], "word string, vec array<double>")).collect()}
    assert got.keys() == {t for r in rows for t in r[0]} and all(np.isfinite(v).all() for v in got.values())
    assert got["x1"].mean() > 8 > got["x2"].mean()


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    words = spark.createDataFrame(rows, "word long, vec array<double>")
    whole = sorted(tuple(r) for r in vectors.nearest(words.where("word < 30"), words, 3).collect())
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "WORD_BLOCK", 11)
    assert sorted(tuple(r) for r in vectors.nearest(words.where("word < 30"), words, 3).collect()) == whole and len(whole) == 90
    x = np.array([v for _, v in rows])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = np.round(unit @ unit.T, 6)
    assert whole == sorted((q, i, near[q, i], rank) for q in range(30) for rank, i in enumerate(sorted((i for i in range(60) if i != q), key=lambda i: (-near[q, i], i))[:3], 1))


def test_nearest_of_odd_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [2.0, 0.0]), ("d", [0.0, 0.0]), ("e", None), ("f", [-1.0, 0.0]), ("g", [0.0, 3.0])]
    words = spark.createDataFrame(rows, "word string, vec array<float>").repartition(3)
    got = [(r.query, r.word, r.cosine, r["rank"]) for r in vectors.nearest(words.where("word in ('a', 'd', 'e')"), words, 3).orderBy("query", "rank").collect()]
    assert got == [("a", "b", 1.0, 1), ("a", "c", 1.0, 2), ("a", "g", 0.0, 3)]
    assert vectors.nearest(words.limit(0), words, 3).count() == 0


def test_reduced_vectors_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 1
    words = spark.createDataFrame([(f"w{i}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], "word string, vec array<float>").repartition(3)
    got = {r.word: r.vec for r in vectors.reduce_dimension(words, 3).collect()}
    assert got.pop("none") is None
    y = np.array([got[f"w{i}"] for i in range(200)])
    values, directions = np.linalg.eigh(np.cov(x.T))
    want = x @ directions[:, np.argsort(-values)[:3]]
    assert np.allclose(np.abs(y), np.abs(want), atol=1e-3)
    with pytest.raises(ValueError):
        vectors.reduce_dimension(words, 7)


def test_npy_shards(spark, tmp_path):
    from weftline.sources import npy

    rng = np.random.default_rng(4)
    rows = [("" if i == 5 else "日本" * (i % 3) + f"w {i}", rng.normal(size=7).astype(np.float32).tolist()) for i in range(9000)]
    words = spark.createDataFrame(rows, "word string, vec array<float>").repartition(3)
    path = str(tmp_path / "v")
    npy.write_vectors(words, path)
    for size in (npy.RANGE_ROWS, 100, 1):
        if size > 1:
            got = npy.read_vectors(spark, path, size)
            assert {r.word: r.vec for r in got.collect()} == dict(rows)
    assert got.rdd.getNumPartitions() >= 90
    # The shards are arrays for numpy, and what numpy saves is read.
    shard = next(p for p in (tmp_path / "v").glob("*.npy") if not p.name.endswith(".ends.npy"))
    assert np.load(shard).shape[1] == 7
    np.save(tmp_path / "v" / "part-x.npy", np.ones((2, 7)))
    np.save(tmp_path / "v" / "part-x.ends.npy", np.array([1, 3]))
    (tmp_path / "v" / "part-x.words").write_text("abc")
    more = npy.read_vectors(spark, path).where("vec[0] = 1 and vec[6] = 1").collect()
    assert {r.word: r.vec for r in more} == {"a": [1.0] * 7, "bc": [1.0] * 7}
    npy.write_vectors(words.limit(0), path)
    assert npy.read_vectors(spark, path).count() == 0
    with pytest.raises(Exception, match="one length"):
        npy.write_vectors(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "word string, vec array<float>").coalesce(1), path)
    assert not list((tmp_path / "v").glob("_staging*"))


def test_histogram(spark):
    from weftline.operators import histogram

    rng = np.random.default_rng(6)
    values = {"a": rng.normal(size=3000) * 1e3, "b": np.array([7.25]), None: rng.random(50), "big": np.array([1e300, -1e300, 0.0]), "same": np.zeros(9), "": np.array([1.0, 2.0])}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("a", float("nan")), ("a", float("inf")), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    for parts in (1, 7):
        got: dict = {}
        for r in histogram.histogram(df.repartition(parts), "x", "k", 16).collect():
            got.setdefault(r.kind, []).append((r.low, r.high, r.n, r.density))
        assert got.keys() == values.keys()
        for k, v in values.items():
            found = sorted(got[k])
            width = found[0][1] - found[0][0]
            assert sum(n for _, _, n, _ in found) == len(v) and abs(sum(d * (h - lo) for lo, h, _, d in found) - 1) < 1e-9
            for lo, h, n, _ in found:
                assert n == ((v >= lo) & (v < h)).sum() and h - lo == width and lo % width == 0
            spread = lambda w: np.floor(v.max() / w) - np.floor(v.min() / w)  # noqa: B023, E731
            assert spread(width) < 16 and (spread(width / 2) >= 16 or width <= 2.0**histogram.FINEST * max(1, np.abs(v).max() / 2.0**20))


def test_kmeans_gives_the_nearest_centre(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 5)) * 20
    x = np.array([centres[i % 4] + rng.normal(size=5) for i in range(200)])
    words = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "word int, vec array<double>")
    got = np.array([r.cluster for r in vectors.clusters(words, k=4).orderBy("word").collect()])
    means = np.array([x[got == c].mean(0) for c in range(4)])
    assert (np.argmin(((x[:, None] - means) ** 2).sum(2), 1) == got).all()
    assert all(len(set(got[i::4])) == 1 for i in range(4)) and len(set(got)) == 4


def test_principal_components_against_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 6)) @ rng.normal(size=(6, 6)) + 3
    words = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "word int, vec array<double>")
    got = np.array([r.pc for r in vectors.principal_components(words).orderBy("word").collect()])
    values, directions = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(0)) @ directions[:, np.argsort(-values)[:2]]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_skip_gram_brings_like_words_together(spark):
    rng = np.random.default_rng(0)
    rows = [(["x" + str(rng.integers(3)) if s else "y" + str(rng.integers(3)) for _ in range(8)],) for s in rng.integers(0, 2, 400)]
    got = {r.word: np.array(r.vec) for r in vectors.skip_gram(spark.createDataFrame(rows, "tokens array<string>")).collect()}
    cos = lambda a, b: got[a] @ got[b] / np.linalg.norm(got[a]) / np.linalg.norm(got[b])
    assert cos("x0", "x1") > cos("x0", "y1") and {len(v) for v in got.values()} == {100}


def test_svd_beyond_the_terms_of_the_driver(spark, monkeypatch):
    """More terms than the driver may hold, in several blocks and tasks, against numpy."""
    from weftline.operators import vectors as module

    rng = np.random.default_rng(5)
    w = np.where(rng.random((60, 45)) < 0.3, rng.random((60, 45)), 0)
    rows = [(int(d), f"t{t:02}", float(w[d, t])) for d, t in zip(*w.nonzero(), strict=True)]
    monkeypatch.setattr(module, "MOST_TERMS", 20)
    monkeypatch.setattr(module, "TERM_BLOCK", 10)
    monkeypatch.setattr(module, "TASK_DOCS", 16)
    sigma, words = module.word_svd(spark.createDataFrame(rows, "doc_id int, term string, weight double"), 3, rounds=30)
    _, s, vt = np.linalg.svd(w, full_matrices=False)
    got = {r.word: r.vec for r in words.collect()}
    found = np.array([got[f"t{t:02}"] for t in range(45)])
    assert np.allclose(sigma, s[:3]) and np.allclose(found @ found.T, (vt[:3].T * s[:3] ** 2) @ vt[:3], atol=1e-5)
