"""Filter interaction audit, Merkle manifest and chat formatting against plain versions of them."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import chat, filter_audit, merkle
from weftline.llm.common import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# Filter audit.

def plain_audit(docs, labels):
    words = lambda t: re.findall("[^ \t-\r]+", t)
    texts = [(i, t or "", p or "") for i, t, p in docs]

    def failed(i, t):
        w = words(t)
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and any(j is not None and j < i and x == t for j, x, _ in texts))
        return {c for c, bad in zip("ABCDE", tests, strict=True) if bad}

    rows = [(p, failed(i, t), any(k == i and q == 1 for k, q, _ in labels if i is not None), any(k == i and x == 1 for k, _, x in labels if i is not None)) for i, t, p in texts]
    out = {}
    for part in {p for p, *_ in rows}:
        own = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for s, c in enumerate(order):
                gone = [r for r in own if c in r[1] and not r[1] & set(order[:s])]
                total[c] += len(gone)
                out[part, "".join(order), s + 1] = [sum(not r[1] & set(order[:s + 1]) for r in own), len(gone), sum(c in r[1] for r in own) - len(gone), sum(r[1] == {c} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), c]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = total[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def audit_rows():
    rng = random.Random(5)
    vocabulary = ["the", "The", "é", "日本", "a#b", "x|y", "longer" * 50, "word", "NASA", *(f"w{i}" for i in range(300))]
    docs = [(1, None, "en"), (2, "", "en"), (3, " \t\n\x0b", None), (None, "", "de"), (None, "same text", ""), (4, "same text", None), (5, "same text", "en"), (5, "same text", "en"), (6, "  not a gap", "de")]
    for i in range(7, 60):
        docs.append((i if i % 9 else 9, (" " if i % 2 else "\n").join(rng.choice(vocabulary if i % 3 else vocabulary[:40]) for _ in range(rng.choice((3, 199, 200, 260, 700)))), rng.choice(("en", "de", None))))
    docs += [(100 + i, docs[20 + i % 3][1], "en") for i in range(12)]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 110, 3)] + [(9, 0, 1), (9, 1, None), (None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("collide", (False, True))
def test_audit(spark, monkeypatch, collide):
    if collide:  # every word has the same hash, so each text is counted from its words
        monkeypatch.setattr(filter_audit, "word_hashes", lambda data, first, size: np.zeros(len(first), np.uint64))
    docs, labels = audit_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("own") for c in ("part", "digest", "words", "n", "failed", "good")})
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == plain_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@given(st.lists(st.text("ab é\n\t", max_size=60), max_size=6), st.integers(0, 2))
@settings(max_examples=150, deadline=None)
def test_text_counts(texts, cut):
    texts = [x * (1 + 40 * (i % 2)) for i, x in enumerate(texts)]
    got = filter_audit.text_counts(pa.array(texts, pa.string()).slice(cut))
    for i, t in enumerate(texts[cut:]):
        w = re.findall("[^ \t-\r]+", t)
        assert (got["words"][i], got["distinct"][i], got["chars"][i], got["digest"][i]) == (len(w), len(set(w)), len(t), hashlib.sha256(t.encode()).digest())


# Merkle manifest.

def plain_manifest(docs):
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def climb(tree, at, node):
        path = []
        for level in tree[:-1]:
            run = level[at // 2 * 2:at // 2 * 2 + 2]
            path += [x for j, x in enumerate(run) if j != at % 2]
            run[at % 2] = node
            node, at = sha("".join(run)), at // 2
        return path, node

    order = lambda x: (x is not None, (x or "").encode() if isinstance(x, str) else x or 0)
    trees = {}
    for lang in sorted({d[2] for d in docs}, key=order):
        own = sorted(((d[0], leaf(d)), d) for d in docs if d[2] == lang) if all(d[0] is not None for d in docs) else sorted((((order(d[0])), leaf(d)), d) for d in docs if d[2] == lang)
        trees[lang] = (own, levels([k[1] for k, _ in own]))
    top = levels([t[-1][0] for _, t in trees.values()])
    out = []
    for place, (own, tree) in enumerate(trees.values()):
        for at, ((_, mine), d) in enumerate(own):
            altered = leaf((*d[:3], d[3] + 1, d[4])) if d[0] is not None and d[3] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 else mine
            low, node = climb(tree, at, altered)
            up, node = climb(top, place, node)
            out.append((d[0], mine, tree[-1][0], top[-1][0], sha("".join(low + up)), node))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "langs", "levels", "range_rows"), ((70, 9, 2, 7), (1, 1, 3, 5), (33, 1, 1, 100), (64, 1, 3, 3), (40, 40, 2, 4)))
def test_manifest(spark, n, langs, levels, range_rows):
    rng = random.Random(n)
    docs = [(i * 3, rng.choice(("s", None, "ß")), None if i % langs == 1 else "é" * (i % langs), rng.choice((None, i, 9223372036854775807)), rng.choice((None, "", "text\n" * i, "x"))) for i in range(n)]
    docs += docs[:n // 4] + [(0, "other", docs[0][2], 1, "same id")] * (n > 1)
    df = spark.createDataFrame([(d, t, lang, s, c) for d, s, lang, c, t in docs], DOCS).withColumns({c: F.lit("own") for c in ("tree", "node", "pos", "n", "block", "leaf", "uid", "part")})
    found = merkle.manifest(df, merkle.one_more_character, levels, range_rows).withColumn("proof", F.sha2(F.array_join("siblings", ""), 256))
    got = sorted(map(tuple, found.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root").collect()), key=str)
    assert got == plain_manifest(docs)
    untouched = merkle.manifest(df, None, levels, range_rows)
    assert untouched.where("folded_root <> root or altered is not null").count() == 0


def test_manifest_of_odd_tables(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a", "en", None, None), (None, "a", "en", None, None), (5, "x" * 300_000, "", "s", 3)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), merkle.one_more_character).collect()
    assert len(got) == 3 and {r.root for r in got} == {r.folded_root for r in got if r.doc_id is None} and len({r.root for r in got}) == 1


def test_ranges_keep_order_of_one_id(spark, tmp_path):
    ws = Workspace(spark, "t")
    rows = ws.save(spark.range(500).select(F.lit("t").alias("tree"), F.lit(7).alias("k"), F.col("id").alias("uid")))
    got = sorted((r.uid, r.pos, r.n) for r in merkle.numbered(ws, rows, "tree", ["k", "uid"], 40).collect())
    assert got == [(i, i, 500) for i in range(500)]


# Chat formatting.

PIECES = st.lists(st.sampled_from([*chat.CONTROL, "<", "\\", "[", "/s>", "s>", "INST]", "é", "\n", "a", "<|im_start|", ">"]), max_size=12).map("".join)


@given(PIECES)
@settings(max_examples=500, deadline=None)
def test_escape(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)


@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
@settings(max_examples=200, deadline=None)
def test_parse(turns):
    text = "".join(chat.turn_text(*t)[0] for t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(text)] == turns


@given(st.lists(st.integers(1, 60), max_size=40), st.integers(0, 50))
@settings(max_examples=300, deadline=None)
def test_spans(sizes, system):
    budget = chat.Budget(64, 20)
    found = chat.spans(np.array(sizes, np.int64), system, budget)
    assert [i for _, new, end in found for i in range(new, end)] == list(range(len(sizes)))
    for first, new, end in found:
        total, repeated = system + sum(sizes[first:end]), sum(sizes[first:new])
        assert first <= new < end and repeated <= budget.history
        assert total <= budget.window or (end == new + 1 and first == new)
        # No turn more would have fitted, neither behind nor, within the budget of history, before.
        assert end == len(sizes) or total + sizes[end] > budget.window
        assert first == 0 or repeated + sizes[first - 1] > budget.history or system + sum(sizes[first - 1:new + 1]) > budget.window


TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def counter(path):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in made.encode_batch(texts, add_special_tokens=False)]


def conversations():
    rng = random.Random(2)
    rows = [(-7, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))]
    for c in range(12):
        for t in range(rng.choice((1, 2, 5, 30))):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]
            rows.append((c if c else None, t, role, rng.choice(("", "é ", "<s> ", "w ")) * rng.choice((0, 1, 10, 70)) + f"{c}.{t}"))
    return rows + [(50, 0, None, None), (50, None, "assistant", "first"), (51, 3, "odd\nrole\\n", "x"), (52, 0, "system", "alone"), (53, 0, "user", "long " * 30_000), (53, 1, "assistant", "y" * 200_000)]


@pytest.mark.parametrize("chunk_bytes", (chat.CHUNK_BYTES, 300))
def test_windows(spark, vocabulary, chunk_bytes):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("own") for c in ("chunk", "tie", "own", "bounds", "tree", "window")})
    budget = chat.Budget(200, 60)
    windows = chat.format_windows(df, vocabulary, budget, chunk_bytes)
    own = {}
    for c, t, role, text in rows:
        own.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for c in own:
        own[c].sort(key=lambda x: x[0])
    count = counter(vocabulary)
    seen = {}
    for w in sorted(windows.collect(), key=lambda w: (w.chunk, w.window)):
        turns = chat.parse(w.text)
        assert w.tokens == sum(count([chat.turn_text(r, t)[0] for r, t, _, _ in turns]))
        fresh = turns[w.first_new:]
        said, learned = seen.setdefault(w.conv_id, ([], []))
        all_turns = [(r, t) for _, r, t in own[w.conv_id]]
        system = all_turns[0][0] == "system"
        assert w.tokens <= budget.window or len(fresh) - int(system and w.first_new == 0) <= 1
        if system:
            assert turns[0][:2] == all_turns[0]
        repeated = [t[:2] for t in turns[int(system and bool(said)):w.first_new]]
        assert repeated == said[len(said) - len(repeated):]
        said += [t[:2] for t in fresh]
        assert [(s.start, s.end) for s in w.loss] == [(a, b) for r, _, a, b in fresh if r == "assistant"]
        learned += [chat.unescape(w.text[s.start:s.end]) for s in w.loss]
    assert {c: said for c, (said, _) in seen.items()} == {c: [(r, t) for _, r, t in x] for c, x in own.items()}
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    assert back.keys() == own.keys()
    for c, x in own.items():
        spoken = "".join(t for _, r, t in x if r == "assistant")
        assert (back[c].n_turns, back[c].turns_sha256, back[c].loss_chars, back[c].loss_sha256) == (len(x), sha("".join(f"{r}\n{t}\n" for _, r, t in x)), len(spoken), sha(spoken))
    if chunk_bytes < 1000:
        assert windows.agg(F.max("chunk")).first()[0] >= 2


def test_repeated_turns_and_no_turns(spark, vocabulary):
    rows = [(1, 0, "system", "s")] * 3 + [(1, 1, "assistant", "a"), (1, 1, "assistant", "b")] * 40
    for chunk_bytes in (chat.CHUNK_BYTES, 200):
        got = chat.read_back(chat.format_windows(spark.createDataFrame(rows, TURNS), vocabulary, chat.Budget(40, 15), chunk_bytes)).first()
        assert (got.n_turns, got.loss_chars) == (83, 80)
    assert chat.read_back(chat.format_windows(spark.createDataFrame([], TURNS), vocabulary)).count() == 0
