"""Near-dedup, line dedup, components and top-k search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import knn, line_dedup, near_dup, similar
from weftline.llm.common import Workspace
from weftline.llm.components import components


def roots_of(n, edges):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    order = rng.sample(range(200), 200)
    edges = [*zip(order[:80], order[1:81], strict=True), *((order[90], x) for x in order[91:140]), (5, 5), (order[0], order[1])]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    want = roots_of(200, edges)
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


def brute_near(rows, width, least):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    roots = roots_of(len(rows), edges)
    best: dict = {}
    for (d, _), r in zip(rows, roots, strict=True):
        if d is not None:
            best[r] = min(best.get(r, d), d)
    return [(d, len(s), (best.get(r) if s else d)) for (d, _), s, r in zip(rows, sets, roots, strict=True)]


@pytest.mark.parametrize("width,least", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, least):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 120))] for _ in range(25)]
    rows = []
    for i in range(220):
        words = list(base[i % 25])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words).upper() if i % 2 else "\t".join(words)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (None, rows[0][1]), (None, "alone here now"), (6, "a " * 40_000), (7, "a " * 40_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = near_dup.near_duplicates(docs, width=width, least=least).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_near(rows, width, least), key=key)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    kept = near_dup.drop_near_duplicates(docs, width=width, least=least)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(r.doc_id for r in got if r.kept)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_a_large_group_of_unlike_copies(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(rows, 3, 85)


def test_rows_that_repeat_an_id(spark):
    rows = [(1, "a b c d"), (1, "p q r s"), (2, "a b c d"), (2, "a b c d")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False)]


def test_keys_meet_exactly_at_one_error():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**16, (1, near_dup.POSITIONS)).astype("<u2")
    for errors in range(near_dup.DISTANCE + 1):
        b = a.copy()
        b[0, rng.choice(near_dup.POSITIONS, errors, replace=False)] ^= 1
        assert np.intersect1d(near_dup.chunk_keys(a), near_dup.chunk_keys(b)).size > 0
        assert similar.far(similar.sketch_of(a), similar.sketch_of(b))[0] <= errors
    b = a.copy()
    b[0, ::2] ^= 1
    assert np.intersect1d(near_dup.chunk_keys(a), near_dup.chunk_keys(b)).size == 0


def brute_lines(docs, width=5, least=80):
    lines = [(d, i, x.strip().lower()) for d, t in docs if t is not None for i, x in enumerate(t.split("\n"))]
    real = sorted(x for x in lines if x[2])
    sets = [{x[i:i + width] for i in range(len(x) - width + 1)} if len(x) >= width else {x} for _, _, x in real]
    edges = [(i, j) for i in range(len(real)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    roots = roots_of(len(real), edges)
    kept = {d: [] for d, _ in docs}
    for i, (d, n, _) in enumerate(real):
        if roots[i] == i:
            kept[d].append(n)
    for d, n, x in lines:
        if not x:
            kept[d].append(n)
    return {d: (0 if t is None else t.count("\n") + 1, sorted(kept[d])) for d, t in docs}


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60)]

    def change(x):
        y = list(x)
        for _ in range(rng.randint(0, 3)):
            y[rng.randrange(len(y))] = rng.choice("abcdefghÉ")
        return "".join(y)

    docs = [(i, "\n".join(change(rng.choice(base)) if rng.random() < 0.9 else rng.choice(["", "  ", "ab"]) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "\n"), (503, base[0] * 3000), (504, base[0] * 3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("clash"))
    got = {r.doc_id: (r.n_lines, r.kept) for r in line_dedup.keep_lines(frame).collect()}
    assert got == brute_lines(docs)
    out = {r.doc_id: r.text for r in line_dedup.drop_lines(frame).collect()}
    for d, t in docs:
        assert out[d] == (None if t is None else "\n".join(t.split("\n")[i] for i in got[d][1]))
    assert line_dedup.drop_lines(frame).columns == frame.columns
    assert line_dedup.keep_lines(frame.limit(0)).count() == 0


def test_queries_link_lines_with_a_changed_word(spark, tmp_path):
    import corpus_pipeline
    from weftline.llm import queries

    line = "the committee met on tuesday and agreed that the harbour should be closed until further notice"
    docs = [(1, line), (2, line.replace("met on", "sat on")), (3, line[:60]), (4, line[:30] + "#" + line[31:60])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_lines(docs, width=5)
    assert want[2] == want[4] == (1, []) != brute_lines(docs, width=10)[2]
    assert {r.doc_id: (r.n_lines, r.kept) for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id for r in corpus_pipeline.drop_repeated_lines(spark, frame, "").where("text <> ''").collect()} == {1, 3}


def test_lines_share_bands_and_sketches():
    """Of pairs at a Jaccard coefficient of 0.8 to 0.82 at least 99.5 % share a band and have near sketches, at any length."""
    rng = random.Random(11)
    for n in (60, 150, 600):
        pairs = []
        while len(pairs) < 1500:
            a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n))
            b = list(a)
            for i in rng.sample(range(n), max(1, round(n / 50))):
                b[i] = "#"
            b = "".join(b)
            x, y = ({s[i:i + 5] for i in range(len(s) - 4)} for s in (a, b))
            if 0.8 <= len(x & y) / len(x | y) < 0.82 or n == 60:
                pairs += [a, b]
        pairs = [x.encode() for x in pairs]
        m = np.concatenate([line_dedup.minima(pairs[i:i + 500], 5) for i in range(0, len(pairs), 500)])
        keys, sketch = line_dedup.band_keys(m), similar.sketch_of(m[:, line_dedup.BINS - 32:])
        met = (keys[::2] == keys[1::2]).any(1) & (similar.far(sketch[::2], sketch[1::2]) <= line_dedup.LIMIT)
        assert met.mean() >= 0.995


def test_windows_end_with_their_lines():
    for width in (1, 2, 5, 9):
        lines = ["abcabcab", "é", "ab\0cd", "hello world, hello", "aaaaaaaaaaaaaaa", "abcd", "abcde"]
        sets = line_dedup.line_sets([x.encode() for x in lines], width)
        assert [len(s) for s in sets] == [len({x[i:i + width] for i in range(max(1, len(x) - width + 1))}) for x in lines]
        m = line_dedup.minima([x.encode() for x in lines], width)
        for s, row in zip(sets, m, strict=True):  # a minimum is a shingle's hash without its highest bits
            assert set(row.tolist()) <= set((s >> np.uint64(line_dedup.LINE_BITS)).astype(np.uint32).tolist()) and len(set(row.tolist())) > len(s) / 3


@pytest.mark.parametrize("width", [1, 2, 3, 5, 6, 7])
def test_minima_are_those_of_each_bin(width):
    rng = random.Random(width)
    lines = ["a", "ab", "\u00e9", "\u6f22\u5b57\u304b\u306a x \u6f22", "x\0y\0\0z\0", "abcde", "a" * 300] + ["".join(rng.choice("abcd efg\u00e9") for _ in range(rng.randint(1, 400))) for _ in range(40)]
    for some in (lines, [x for x in lines if x.isascii()]):
        raw = [x.encode() for x in some]
        got = line_dedup.minima(raw, width)
        for row, of_line in zip(got.tolist(), line_dedup.line_sets(raw, width), strict=True):
            bins = {}
            for v in of_line.tolist():
                bins.setdefault(v >> 57, []).append(v >> line_dedup.LINE_BITS & (1 << 44) - 1)
            assert all(row[b] == min(v) & 0xFFFFFFFF for b, v in bins.items()) and set(row) <= {row[b] for b in bins}


def test_buckets_fall_into_groups_of_near_sketches():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 40, np.uint64)
    sketch = np.concatenate([base[rng.integers(0, 40, 600)] ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)), base])
    key = np.sort(rng.integers(0, 60, len(sketch)).astype(np.uint64))
    node = rng.permutation(len(sketch)).astype(np.int64)
    a, b = similar.bucket_groups(key, node, sketch, 6)
    got = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        got.setdefault(y, []).append(x)
    for k in range(60):
        mine = np.flatnonzero(key == k)
        near = [(i, j) for i in range(len(mine)) for j in range(i) if similar.far(sketch[mine[i]], sketch[mine[j]]) <= 6]
        groups = {}
        for i, g in zip(mine, roots_of(len(mine), near), strict=True):
            groups.setdefault(g, []).append(int(node[i]))
        for g in groups.values():
            assert min(g) not in got and all(got.pop(n) == [min(g)] for n in g if n != min(g))
    assert not got


def test_folded_nodes_are_compared(spark, monkeypatch):
    """Keys and sketches alike, so all but one node of a bucket are folded, in both rounds; no link is lost."""
    monkeypatch.setattr(similar, "HELD_KEYS", 8)
    sets = {1: range(100), 2: range(50, 150), 3: range(5, 105), 4: range(45, 145), 5: range(500, 600), 6: range(48, 148), 7: range(2, 102)}
    rows = spark.createDataFrame([(n, i) for n in sets for i in range(5)], "node long, k long").repartition(3)

    def entries(batch, _):
        node = batch.column(0).to_numpy()
        yield batch.column(1).to_numpy().astype(np.uint64), node, np.where(node == 6, np.uint64(1), np.uint64(0))

    table = spark.createDataFrame([(n, np.array(s, np.uint64).tobytes()) for n, s in sets.items()], "node long, payload binary")
    ws = Workspace(spark, "folded")
    met = similar.meet(rows, entries, 35, 3, ws)
    _, roots = similar.link(met, lambda nodes, _: table, near_dup.decode, 80, ws)
    assert {r.node: r.root for r in roots.collect()} == {1: 1, 3: 1, 7: 1, 2: 2, 4: 2, 6: 2}


def test_repeated_rows_share_their_lines(spark):
    docs = spark.createDataFrame([(1, "same line\nother words here"), (1, "same line\nother words here"), (None, "same line")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in line_dedup.keep_lines(docs).collect()} == {1: [1], None: [0]}
    assert line_dedup.drop_lines(docs).count() == 3


def brute_top(rows, k, every):
    vectors = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in vectors)
    padded = [(i, np.pad(v, (0, width - len(v)))) for i, v in vectors]
    out = []
    for n, (q, v) in enumerate(padded):
        if q % every == 0:
            best = sorted(((-int(v @ u), i) for m, (i, u) in enumerate(padded) if m != n))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_top_k_equals_brute_force(spark, spread):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + spread * rng.normal(size=8)).round(3).tolist()) for i in range(700)]
    rows += [(800 + i, rows[0][1]) for i in range(60)] + [(900, None), (None, rows[0][1]), (901, [None] * 8), (902, [float("nan")] * 8), (903, [1.0, 2.0]), (904, []), (50, rows[1][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in knn.top_k(df, 5, 50, task_rows=150, group_queries=4).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows, 5, 50)


def test_top_k_of_few_and_large(spark):
    rows = [(0, [1e6, 1e6]), (1, [1e6, -3.0]), (2, [0.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in knn.top_k(df).collect()) == brute_top(rows, 5, 50)
    huge = spark.createDataFrame([(0, [1e12]), (1, [1e300]), (2, [-1e12])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in knn.top_k(huge).orderBy("rank").collect()] == [1, 2]
    # Beyond a long scores are shown as its ends, and still compared as they are.
    huge = spark.createDataFrame([(0, [1e12]), (1, [1e13]), (2, [1e14]), (3, [-1e13]), (4, [-1e14]), (5, [1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in knn.top_k(huge, task_rows=2).orderBy("rank").collect()] == [(2, 2**63 - 1), (1, 2**63 - 1), (5, 65536000000000000), (3, 1 - 2**63), (4, 1 - 2**63)]
    same = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (3, [1.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in knn.top_k(same).collect())
    assert got == brute_top([(0, [1.0]), (0, [2.0]), (3, [1.0]), (3, [1.0])], 5, 50) and len(got) == 6
    assert knn.top_k(df.limit(0)).count() == 0 and knn.top_k(df.where("vec_id = 0")).count() == 0
    assert knn.top_k(df.where("vec_id > 0")).count() == 0


def test_pruning_sends_clusters_only_where_needed():
    pivots = np.array([[100.0, 0.0], [0.0, 100.0], [-100.0, 0.0]])
    counts = np.array([50.0, 50.0, 50.0])
    group, needs = knn.plan(pivots, counts, np.full(3, 1.0), np.array([2.0, 0.0, 0.0]), np.full(3, 1.0), 5)
    assert group.tolist() == [0, -1, -1] and needs == [{0}]
