import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeghkmnor") for _ in range(rng.randint(3, 8))) for _ in range(600)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        text = "\n".join(line(25) for _ in range(4))
        if i % 4 == 0:
            text = text.replace(" ", " wizzlepf ", 6)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(i % 4 == 0)))
    passage = line(14)
    docs[1] = (1, docs[1][1] + "\n" + passage + " " + line(20), "en", "s", 1)
    docs[5] = (5, docs[9][1].rsplit("\n", 1)[0] + "\n" + line(25), "en", "s", 1)
    docs[13] = (13, docs[17][1], "en", "s", 1)
    # The words of another text, wrapped elsewhere: no line of it is like one of the other's.
    words_of = docs[21][1].split()
    docs[25] = (25, "\n".join([" ".join(words_of[:12]), " ".join(words_of[12:37]), " ".join(words_of[37:62]), " ".join(words_of[62:])]), "en", "s", 1)
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        assert name == "packing" or out.columns == now.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in now.collect()}
    toxic = {i for i in range(240) if i % 4 == 0}
    assert len(toxic & seen["toxicity"].keys()) <= 3 and len(seen["toxicity"]) >= 178
    assert {*seen["toxicity"]} - {*seen["line_dedup"]} == {17}
    assert {21, 25} <= {*seen["line_dedup"]} and 21 in seen["minhash_dedup"] and 25 not in seen["minhash_dedup"]
    assert seen["line_dedup"][9].text == docs[5][1].rsplit("\n", 1)[1] or seen["line_dedup"][5].text == docs[5][1]
    assert 1 in seen["minhash_dedup"] and 1 not in seen["decontamination"]
    assert seen["packing"].keys() == seen["decontamination"].keys()


def test_near_copies_that_share_lines(spark, tmp_path):
    """Of near copies whose lines are mostly repeats, what line dedup leaves goes too, while the first document of each group stays, and so do others that share a line."""
    rng = random.Random(9)
    line = lambda n: " ".join("".join(rng.choice("abcdeghkmnor") for _ in range(rng.randint(3, 8))) for _ in range(n))
    docs = [(i, "\n".join(line(12) for _ in range(10)), "en", "s", 1) for i in range(40)]
    shared = line(12)
    for i in range(10):  # one line of ten is another one
        docs.append((100 + i, docs[i][1].rsplit("\n", 1)[0] + "\n" + line(12), "en", "s", 1))
        docs.append((200 + i, "\n".join([shared] + [line(12) for _ in range(9)]), "en", "s", 1))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    now = spark.createDataFrame(docs, kind)
    now.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[1:3]:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    left = [{r.doc_id for r in spark.read.parquet(str(tmp_path / name)).collect()} for name in ("line_dedup", "minhash_dedup")]
    assert {100 + i for i in range(10)} <= left[0]
    assert left[1] == {*range(40), *range(200, 210)}


def test_run_gives_packed_pieces(spark):
    from pathlib import Path

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no test tables")
    assert {"doc_id", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, sf).columns)


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, empty tables, and columns named as the operators' own."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    text = "one two three four five six seven eight nine ten eleven twelve\nand another line of quite other words that follow here"
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, None, None, None, None), (3, "", "en", None, 0), (None, "some words without an id stay where they are", None, "s", None), (4, " \n ", "en", "s", 3), (5, "long " * 30_000, "en", "s", 150_000)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "documents.parquet"))
    for docs, want in ((spark.createDataFrame(rows, kind), len(rows)), (spark.createDataFrame([], kind), 0)):
        docs = docs.withColumns({c: F.lit("own") for c in ("row", "kept", "node", "score", "_lost", "n_words")})
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.count() == want, name
            assert docs.where("row <> 'own' or kept <> 'own' or node <> 'own' or score <> 'own' or n_words <> 'own'").count() == 0
        packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
        assert len(packed) >= want and {r.doc_id for r in packed} == ({1, 2, 3, 4, 5, None} if want else set())


def test_own_texts_are_not_compared(spark, tmp_path, monkeypatch):
    """Near-dedup shuffles no text, and fetches no set of documents that met only their own other text; what goes is the same as when all texts are compared."""
    from weftline.llm import near_dup

    rng = random.Random(4)
    line = lambda n: " ".join("".join(rng.choice("abcdeghkmnor") for _ in range(rng.randint(3, 8))) for _ in range(n))
    came = [(i, "\n".join(line(12) for _ in range(10))) for i in range(60)]
    came += [(100 + i, came[i][1] + " " + line(3)) for i in range(5)] + [(200, None), (201, "few words"), (None, came[7][1])]
    now = [(i, t.split("\n", 1)[-1] if i is not None and i % 3 else t) if t else (i, t) for i, t in came if i not in (11, 103)]
    kind = "doc_id long, text string"
    spark.createDataFrame(came, kind).write.parquet(str(tmp_path / "documents.parquet"))
    docs, all_ = spark.createDataFrame(now, kind), spark.read.parquet(str(tmp_path / "documents.parquet"))
    union = docs.union(all_.join(docs.select("doc_id"), "doc_id", "left_semi"))
    gone = lambda df: {r.doc_id for r in df.where("not kept and doc_id is not null").collect()}
    asked = []
    inner = near_dup.link

    def link(met, payloads_of, *rest):
        def counted(nodes, n):
            asked.append(nodes.distinct().count())
            return payloads_of(nodes, n)

        return inner(met, counted, *rest)

    want = gone(near_dup.near_duplicates(union, width=5, least=80))
    monkeypatch.setattr(near_dup, "link", link)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in left.collect()} == want == {100, 101, 102, 104}
    assert asked and max(asked) <= 24


def test_near_dedup_shuffles_no_text_where_documents_go(spark, tmp_path, monkeypatch):
    from weftline.llm import similar

    rng = random.Random(8)
    text = lambda: " ".join(str(rng.randrange(500)) for _ in range(60))
    rows = [(i, text()) for i in range(20)]
    rows += [(i + 100, rows[i][1] + " more") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
        assert "BroadcastHashJoin" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in plan
        assert sorted(r.doc_id for r in out.collect()) == list(range(20))
        # Beyond the bound they are joined by a shuffle, with the same rows.
        monkeypatch.setattr(similar, "BROADCAST_ROWS", 0)
        assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()) == list(range(20))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
