"""Packing, language identification, decontamination and toxicity."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontaminate as D
from weftline.llm import language_id, packing, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return packing.Encoder(f.read(), most=200)


def test_encoder_equals_the_tokenizer(encoder, monkeypatch):
    rng = random.Random(3)
    bits = ["a", "b", " ", "\n", ".", ",", "é", "'s", "1", "\t", " x", "word", "<|endoftext|>", "\u3000", "\x1c", "\x85", "\r", "\u2009", "\u2014", "\u00d7", "ж", "漢", "\u00a0", "\x00", "  ", "."]
    texts = [None, "", " ", "\n", "a  b", "a\n\nb", ".,", " .", "x.\ny", "a\u2009 b", "\u0300 a"] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["wörd, and word. " * 400, "z" * 3000, " " * 500]
    for window in (1 << 20, 64):
        monkeypatch.setattr(packing, "WINDOW_BYTES", window)
        for i in range(0, len(texts), 100):
            some = pa.array(["pad", *texts[i:i + 100]], pa.string()).slice(1)
            assert [x.tobytes() for x in encoder.encode(some)] == encoder.plain([t or "" for t in texts[i:i + 100]])
    assert encoder.encode(pa.array([], pa.string())) == [] and [len(x) for x in encoder.encode(pa.array([None, ""], pa.string()))] == [0, 0]


def test_pieces():
    ids = np.arange(10, dtype="<u4").tobytes()
    assert [p[:2] for p in packing.pieces_of(ids, 4)] == [(0, 2), (2, 4), (6, 4)]
    assert [p[:2] for p in packing.pieces_of(ids, 5)] == [(0, 5), (5, 5)]
    assert packing.pieces_of(ids, 10) == [(0, 10, zlib.crc32(ids))]


def test_local_search_empties_bins():
    # Best fit leaves three bins of 6 + 3, 6 + 3 and 4; exchanges can't help there, but can below.
    lengths = [6, 5, 5, 4, 4, 3, 3]
    bins = [[0, 5], [1, 3], [2, 4], [6]]
    out = packing.improve(bins, lengths, 10)
    assert len(out) == 3 and sorted(i for b in out for i in b) == list(range(7))
    rng = random.Random(1)
    many = [rng.randint(1, 1024) for _ in range(3000)]
    packed = packing.pack_lengths(many, 1024)
    assert sorted(i for b in packed for i in b) == list(range(3000)) and max(sum(many[i] for i in b) for b in packed) <= 1024
    assert len(packed) <= 1.05 * -(-sum(many) // 1024)


def test_pack(spark, encoder):
    rows = [(1, "hello world " * 900), (2, None), (3, ""), (3, ""), (None, "x\ny"), (5, "z" * 100_000)] + [(10 + i, "word " * i) for i in range(60)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit(9)), PATH, capacity=256, group_pieces=32).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    for doc_id, text in dict((a, b) for a, b in rows if a != 3).items():
        ids = encoder.plain([text or ""])[0] + np.array([2], "<u4").tobytes()
        own = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids) // 4
        assert all(zlib.crc32(ids[4 * r.start:4 * (r.start + r.length)]) == r.ids_crc32 for r in own)
        assert len(own) == 1 or all(r.length == 256 for r in own[1:])
    assert len(by_doc[3]) == 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_languages(spark):
    rng = random.Random(2)
    words = {"aa": ["kala", "mela", "sila"], "bb": ["wurz", "grunz", "schur"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randint(1, 30))), x) for i, x in enumerate(rng.choices(["aa", "bb"], k=300))]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 !!", "bb"), (None, "kala", None), (903, "KALA " * 50_000, "bb")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit(5))
    got = language_id.identify(docs, *language_id.fit(docs.where("doc_id < 900"))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 305 and all(0 <= r.score <= 1 for r in got)
    assert all(by[i].lang_pred == x for i, _, x in rows)
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert [by[i].lang_pred for i in (900, 901, 902, None, 903)] == ["und", "und", "und", "aa", "aa"]
    nothing = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, *nothing).collect()} == {"und"}


def test_a_text_scores_alike_in_any_batch():
    names, matrix = ["a", "b"], np.random.default_rng(0).normal(size=(2, (1 << language_id.BITS) + 1))
    matrix[:, -1] = 0
    texts = ["abc", "de", None, "", "x" * 1000, "f"]
    whole = language_id.score(texts, names, matrix)
    assert [tuple(x[0] for x in language_id.score([t], names, matrix)) for t in texts] == list(zip(*whole, strict=True))


def brute_force(text, items, window=10):
    """Words, hit words and occurring items of one text, by comparing word lists."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words = split(text)
    hit, found = set(), set()
    for i, t in items.items():
        own = split(t)
        n = min(window, len(own))
        for k in range(len(own) - n + 1) if n else ():
            for p in range(len(words) - n + 1):
                if words[p:p + n] == own[k:k + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(i))
    return len(words), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé1") for _ in range(rng.randint(1, 4)))
    vocabulary = [word() for _ in range(12)]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = {1: say(14), 2: say(3), 3: vocabulary[0], 10: say(10), 11: "", 12: None, 5: "Ünd " + say(30)}
    docs = [(i, say(rng.randint(0, 60)).upper() if i % 2 else say(40) + " " + items[1] + "!" + items[5]) for i in range(60)] + [(None, None), (99, ""), (98, items[1].replace(" ", "-") * 3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    bench = spark.createDataFrame([*items.items(), (1, items[1]), (None, "a b c")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in D.decontaminate(frame, bench).collect()}
    assert got == {i: brute_force(t, {k: v for k, v in items.items()}) for i, t in docs}
    assert not any(r.contaminated for r in D.decontaminate(frame, bench.limit(0)).collect())
    kept = D.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, n, _) in got.items() if not n}
    assert D.decontaminate(frame.limit(0), bench).count() == 0


def test_long_patterns_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(n))
    items = {i: say(rng.randint(8, 25)) for i in range(20)}
    docs = [(i, say(200) + " " + items[i % 20] + " " + say(5)) for i in range(40)] + [(40, None), (41, ""), (None, items[3]), (42, items[5]), (42, items[5])]
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items.items()], "item_id long, text string")).collect()
    assert len(got) == len(docs) and {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in got} == {i: brute_force(t, items) for i, t in docs}
    kept = D.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items.items()], "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {40, 41}


def test_languages_without_bound(spark):
    docs = spark.createDataFrame([(i, "word", f"l{i}") for i in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(docs, languages=5)
    assert language_id.identify(docs.limit(0), *language_id.fit(docs)).count() == 0
    assert language_id.identify(docs.union(docs), *language_id.fit(docs)).count() == 60


def test_scores_equal_naive_bayes(spark):
    """Brute force: counts of hashed n-grams per language, smoothed, logarithms summed one by one."""
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcé d" if i % 2 else "xyzé d") for _ in range(rng.randint(1, 40))), "p" if i % 2 else "q") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, matrix = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, names, matrix).collect()}

    def grams(t):
        for n in language_id.ORDERS:
            for i in range(len(t)):  # the last ones hold the end of the text, as zeros
                h = 0
                for c in (t + "\0\0")[i:i + n]:
                    h = ((h ^ ord(c)) * 0x9E3779B1) % 2**32
                h ^= n * 0x85EBCA6B % 2**32
                yield ((h ^ (h >> 15)) * 0xC2B2AE35 % 2**32) >> (32 - language_id.BITS)

    counts = {x: np.full(1 << language_id.BITS, language_id.SMOOTHING) for x in "pq"}
    for i, t, x in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            for g in grams(t):
                counts[x][g] += 1
    for i, t, _ in rows:
        z = {x: sum(np.log(c[g] / c.sum()) for g in grams(t)) for x, c in counts.items()}
        best = max(sorted(z), key=z.get)
        if any(map(str.isalpha, t)):
            assert got[i].lang_pred == best and abs(got[i].score - 1 / sum(np.exp(v - z[best]) for v in z.values())) < 1e-6


def test_toxicity(spark):
    rng = random.Random(6)
    clean = ["".join(rng.choice("abcdeghkmnor") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["zuxxerly", "wizzlepf", "yuvvquab"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 80))]
        toxic = i % 4 == 0
        for _ in range(1 + len(words) // 20 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (None, "x"), (1002, "zuxxerli zuxxerly! " * 20_000)], "doc_id long, text string").withColumn("score", F.lit("own"))
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(5000, None), (None, 1), (5001, 3)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_texts(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 604 and sum(got[i].predicted == labels[i][1] for i in held) >= 0.95 * len(held)
    assert got[1000].score == got[1001].score < 0.5 and got[1002].predicted == 1
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {"own"}
    assert toxicity.train([], []).values()[1] < 0 and toxicity.train(["a"], [1]).values()[1] > 0


@pytest.mark.parametrize("seed", range(4))
def test_small_samples_learn_a_common_insult(seed):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("abcdeghkmnor") for _ in range(rng.randint(3, 8))) for _ in range(600)]
    texts = [" ".join(rng.choice(clean) for _ in range(60)) for _ in range(240)]
    texts = [t.replace(" ", " wizzlepf ", 6) if i % 4 == 0 else t for i, t in enumerate(texts)]
    labels = [int(i % 4 == 0) for i in range(240)]
    model = toxicity.train(texts[:192], labels[:192])
    scores = np.array(toxicity.Scorer(*model.values()).score(texts))
    assert ((scores >= 0.5) == np.array(labels)).mean() >= 0.97


def test_scorer_equals_the_unfolded_model():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=(1 << toxicity.BITS, toxicity.DIMENSIONS)), rng.normal(size=(toxicity.DIMENSIONS, 2)), rng.normal(size=2))
    for text in ("", "One two, two ünd", "x" * 50 + " y"):
        words = sorted({*toxicity.words_of(text)})
        bag = np.concatenate([*(toxicity.subwords([w])[0] for w in words), np.full(toxicity.END_TIMES, toxicity.END)]).astype(int)
        z = np.mean([model.embeddings[b] for b in bag], 0) @ model.weights + model.bias
        assert abs(toxicity.Scorer(*model.values()).score([text])[0] - np.exp(z[1]) / np.exp(z).sum()) < 1e-9


def test_toxicity_without_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, toxicity.fit(docs, labels.limit(0))).count() == 3
    assert toxicity.drop_toxic(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0
    assert toxicity.drop_toxic(docs.union(docs), toxicity.fit(docs, labels.limit(0))).count() == 6


def test_subwords_of_a_word_are_its_own():
    flat, n = toxicity.subwords([b"ab", "é".encode(), b"longer"])
    alone = [toxicity.subwords([w])[0].tolist() for w in (b"ab", "é".encode(), b"longer")]
    assert flat.tolist() == [x for a in alone for x in a] and n.tolist() == [len(a) for a in alone]


def fewest_bins(lengths, capacity):
    """The least number of bins, by trying every bin for the longest length left."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for free in sorted({f for f in bins if f >= lengths[i]}):
            at = bins.index(free)
            place(i + 1, [*bins[:at], free - lengths[i], *bins[at + 1:]])
        place(i + 1, [*bins, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_packing_of_small_instances_is_near_the_fewest_bins():
    import random

    rng = random.Random(12)
    worse = 0
    for _ in range(150):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(1, 11))]
        bins, least = packing.pack_lengths(lengths, 100), fewest_bins(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= least + 1
        worse += len(bins) > least
    assert worse <= 7


def test_toxicity_model_is_at_a_minimum_of_its_loss(monkeypatch):
    """The trained log-odds of a tiny table are those of a softmax on averaged embeddings: moving any parameter against the numeric gradient of the loss gains next to nothing."""
    import random

    import numpy as np

    from weftline.llm import toxicity

    rng = random.Random(3)
    words = [f"word{i}" for i in range(30)]
    texts = [" ".join(rng.sample(words, 8) + ["nasty"] * (i % 2)) for i in range(60)]
    labels = [i % 2 for i in range(60)]
    model = toxicity.train(texts, labels)
    values, bias = model.values()
    bags = []
    for t in texts:
        pick = np.append(toxicity.subwords(sorted(set(toxicity.words_of(t))))[0], np.full(toxicity.END_TIMES, toxicity.END))
        bags.append(pick)
    odds = np.array([values[b].mean() + bias for b in bags])
    loss = lambda shift: np.mean(np.log1p(np.exp(-(2 * np.array(labels) - 1) * (odds + shift))))
    assert loss(0) < 0.1 and all(loss(d) > loss(0) - 0.01 for d in (-0.5, -0.1, 0.1, 0.5))
    # A numeric gradient of the data term in one embedding against the analytic one: residual times weight times share.
    nasty = toxicity.subwords(toxicity.words_of("nasty"))[0][0]
    share = np.array([(b == nasty).mean() for b in bags])
    residual = 1 / (1 + np.exp(-odds)) - np.array(labels)
    w = model.weights[:, 1] - model.weights[:, 0]
    step = 1e-4
    for k in range(len(w)):
        moved = lambda d, k=k: np.mean(np.log1p(np.exp(-(2 * np.array(labels) - 1) * (odds + d * share * w[k]))))
        assert np.isclose((moved(step) - moved(-step)) / (2 * step), np.mean(residual * share * w[k]), atol=1e-5)
