"""License scans, URL filters and sharding."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from weftline.llm import license_scan as L
from weftline.llm import sharding, url_filter

DOCS = "doc_id long, text string, source string"


def test_license_lines(spark):
    rows = [(1, "x\nReleased under the MIT license!\ny", "a"), (2, None, None), (None, "", "a"), (3, "Licensed  under CC-BY-NC 4.0\nlicensed under cc by nc 4 0", "b"), (4, "a " * 5000, "b"), (5, "the license of the software", "b")]
    got = {(r.doc_id, r.line_no): (r.license, r.dice) for r in L.scan_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, 1): ("MIT", 1.0), (3, 0): ("CC-BY-NC-4.0", 1.0), (3, 1): ("CC-BY-NC-4.0", 1.0)}
    assert L.scan_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_license_threshold_and_columns(spark):
    df = spark.createDataFrame([(1, "one two three four five", 7.0)], "doc_id int, text string, dice double")
    templates = (("A", "one two three four"), ("B", "one two three four five six"), ("C", "two three"))
    got = [(r._hit.license, round(r._hit.dice, 6)) for r in L.scan_texts(df, templates=templates, match=80).collect()]
    assert sorted(got) == [("A", round(6 / 7, 6)), ("B", round(8 / 9, 6))]
    best = L.best_hits(L.scan_texts(df, templates=templates), ["doc_id"]).first()
    assert (best.license, best.template_id) == ("B", 1)
    assert L.scan_texts(df, templates=()).count() == 0


def test_needles_are_in_every_match(spark):
    groups = L.needles()
    for _, body in L.TEMPLATES:
        words = L.re.split("[^a-z0-9]+", body.lower())
        assert any(all(any(g in w for w in words) for g in group) for group in groups)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/", "block"), ("org", "/fr/", "block")]


def test_urls(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    urls = {
        0: "http://A.Example.NET/en/x?q", 1: "https://example.net/de/", 2: "http://notexample.com/de/x", 3: "http://example.com/de", 4: "x://m.example.com/de/#f", 5: None, 6: "no scheme", 7: "",
        8: "http://a.org/fr/1", 9: "http://net", 10: "http://net/", 11: "http://a.net:80/", 12: "http://a..net/", 13: "://", 14: "http://" + "a." * 3000 + "net/" + "x" * 5000,
    }
    df = spark.createDataFrame([(k, u, "own") for k, u in urls.items()] + [(0, urls[0], "own")], "page_id int, url string, rule string")
    rows = url_filter.filter_urls(df, rules).collect()
    assert len(rows) == len(urls) + 1
    got = {r.page_id: (r.rule, r.verdict) for r in rows}
    assert got[0] == ("example.net/en/", "allow") and got[1] == ("net/", "block") and got[2] == (None, "allow") and got[3] == (None, "allow")
    assert got[4] == ("example.com/de/", "block") and got[5] == got[6] == got[7] == got[13] == (None, "allow")
    assert got[8] == ("org/fr/", "block") and got[9] == (None, "allow") and got[10] == got[12] == got[14] == ("net/", "block") and got[11] == (None, "allow")
    assert {r.page_id: r.host for r in rows}[0] == "a.example.net"
    assert {r.verdict for r in url_filter.filter_urls(df, rules.limit(0), default="block").collect()} == {"block"}
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def brute_shards(rows, shards, seed="weftline"):
    import hashlib

    by = {}
    for doc_id, text, source in rows:
        by.setdefault(source, []).append((hashlib.md5(f"{seed}:{doc_id}:{zlib.crc32(text.encode())}:{len(text.encode()) + 1}".encode()).hexdigest(), doc_id, text))
    order = []
    for s, own in by.items():
        for k, (h, doc_id, text) in enumerate(sorted(own), 1):
            order.append(((2 * k - 1) / (2 * len(own)), "s" + s, h, doc_id, text))
    n = len(order)
    return {x[3]: (i * shards // n, i - -(-n * (i * shards // n) // shards)) for i, x in enumerate(sorted(order))}


def test_shards(spark):
    rows = [(i, "té" * (i % 7), "hot" if i % 3 else f"s{i % 11}") for i in range(1000)]
    got = sharding.interleave(spark.createDataFrame(rows, DOCS), 8, group_rows=64).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == brute_shards(rows, 8)
    for r in got:
        raw = ("té" * (r.doc_id % 7)).encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    mixture = Counter((r.shard, rows[r.doc_id][2]) for r in got)
    total = Counter(x[2] for x in rows)
    assert all(abs(n - total[s] / 8) <= 1 + len(total) / 2 for (_, s), n in mixture.items())


def test_shards_of_odd_rows(spark):
    rows = [(None, None, None), (1, "a", None), (1, "a", None), (1, "b", "x"), (2, "", "")]
    got = sharding.interleave(spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash")), 3).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert {r.size for r in got} == {1, 2}
    assert sharding.interleave(spark.createDataFrame([], DOCS)).count() == 0


def test_shards_of_rows_without_ids(spark):
    rows = [(None, "same" if i % 2 else f"t{i % 5}", "hot") for i in range(600)] + [(7, f"x{i}", "hot") for i in range(300)]
    got = sharding.interleave(spark.createDataFrame(rows, DOCS), 8, group_rows=16).collect()
    sizes = Counter(r.shard for r in got)
    assert sum(sizes.values()) == 900 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    # Rows without an id are dealt like any others, not in one run.
    assert min(Counter(r.shard for r in got if r.doc_id is None).values()) > 40


def test_license_blocks_and_texts(spark):
    texts = dict(L.TEXTS)
    mit, bsd, gpl = texts["MIT"], texts["BSD-3-Clause"], texts["GPL-3.0"]
    notice = next(b for n, b in L.TEMPLATES if n == "GPL-3.0" and "is free software" in b and "any later version." in b)
    words = notice.split()
    wrapped = "\n".join(" ".join(words[i:i + 9]) for i in range(0, len(words), 9))
    rows = [(1, "Copyright someone\n\n" + mit), (2, "prose\n" + bsd), (3, gpl), (4, "before it\n\n" + wrapped + "\n\nafter it"), (5, "Some words. Licensed under the MIT License. More words that follow in the same line"), (6, "Licensed under CC BY-SA 4.0."), (7, "Licensed under CC BY 4.0."), (8, "plain words about a license of software")]
    got = {r.doc_id: (r.line_no, r.license) for r in L.scan_lines(spark.createDataFrame([(*r, "a") for r in rows], DOCS)).where("dice >= 0.9").collect()}
    assert got[1] == (2, "MIT") and got[2][1] == "BSD-3-Clause" and got[3][1] == "GPL-3.0" and got[4] == (2, "GPL-3.0")
    assert got[5] == (0, "MIT") and got[6] == (0, "CC-BY-SA-4.0") and got[7] == (0, "CC-BY-4.0") and 8 not in got


def plain_scan(rows, templates, texts, match):
    """Every line and every run of sentences against every template; then the best first."""
    words = lambda t: [w for w in L.re.split("[^a-z0-9]+", t.lower()) if w]
    grams = lambda w: {tuple(w)} if len(w) == 1 else set(zip(w, w[1:]))
    every = [(i, name, grams(words(body))) for i, (name, body) in enumerate((*templates, *texts)) if words(body)]
    out = []
    for n, (doc_id, text) in enumerate(rows):
        lines = (text or "").split("\n") if text is not None else []
        best = {}

        def score(g, own, best_of=None):
            for i, name, t in own:
                common = len(g & t)
                if g and 200 * common >= match * (len(g) + len(t)):
                    yield 2 * common / (len(g) + len(t)), -i, name

        for k, line in enumerate(lines):
            if found := max(score(grams(words(line)) if words(line) else set(), every[:len(templates)]), default=None):
                best[k] = found
        units = [(k, y) for k, line in enumerate(lines) for y in L.re.split(r"(?<=[.;:!?])\s+", line)]
        flat = [(u, k, w) for u, (k, y) in enumerate(units) for w in words(y)]
        blocks = []
        for u in sorted({u for u, _, _ in flat}):
            mine = None
            for e in sorted({x for x, _, _ in flat if x >= u}):
                w = [x for v, _, x in flat if u <= v <= e]
                if len(w) > 1 and (found := max(score(grams(w), every), default=None)):
                    mine = max(mine or (), (found, -units[e][0], u)) if mine else (found, -units[e][0], u)
            if mine:
                blocks.append((mine[0][0], False, -units[u][0], -mine[1], mine[0]))
        stay = []
        for x in sorted([(h[0], True, -k, k, h) for k, h in best.items()] + blocks, reverse=True):
            if x[1] or not any(-a[2] <= x[3] and -x[2] <= a[3] for a in stay):
                stay.append(x)
        found = {}
        for x in stay:
            found[-x[2]] = max(found.get(-x[2], ()), x[4]) if -x[2] in found else x[4]
        out += [(doc_id, k, h[2], -h[1], round(h[0], 9)) for k, h in found.items()]
    return sorted(out, key=str)


def test_license_blocks_against_all_runs(spark):
    import random

    rng = random.Random(11)
    templates = (("A", "alpha beta gamma delta epsilon zeta eta theta"), ("B", "licensed under the one licence. all rights given; none kept"), ("C", "lone"))
    texts = (("T", "first part of a text. second part of it follows: third part ends the text as it is"),)
    pool = [w for _, b in (*templates, *texts) for w in b.replace(".", " .").split()] + ["noise", "more", "alpha", "."]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            if kind < 0.45:
                body = rng.choice((*templates, *texts))[1].split()
                for _ in range(rng.randint(0, 2)):
                    body[rng.randrange(len(body))] = rng.choice(pool)
                parts += body
            else:
                parts += [rng.choice(pool) for _ in range(rng.randint(1, 9))]
            if rng.random() < 0.5:
                parts[-1] += rng.choice((".", ";", ""))
        text = " ".join(parts)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(text))
            text = text[:at] + text[at:].replace(" ", "\n", 1)
        rows.append((rng.choice((None, i, 7)), text))
    rows += rows[:9] + [(None, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("uid", "line_no", "rows", "dice")})
    got = sorted(((r.doc_id, r.line_no, r.license, r.template_id, round(r.dice, 9)) for r in L.scan_lines(df, templates=templates, texts=texts).collect()), key=str)
    assert got == plain_scan(rows, templates, texts, L.MATCH)


def test_license_rows_that_share_an_id(spark):
    mit, cc = "Released under the MIT License.", "Licensed under CC BY-NC 4.0."
    rows = [(None, mit, "a"), (None, cc, "a"), (7, mit, "a"), (7, cc, "a"), (7, cc, "a")]
    got = sorted((str(r.doc_id), r.license) for r in L.scan_lines(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted([("None", "MIT"), ("None", "CC-BY-NC-4.0"), ("7", "MIT"), ("7", "CC-BY-NC-4.0"), ("7", "CC-BY-NC-4.0")])


def test_license_far_parts(spark):
    """A run whose words are nearly all repeats is looked at to its end."""
    templates = (("A", "one two three four five six seven eight nine ten"),)
    text = "one two three four five. " + "one two three. " * 500 + "five six seven eight nine ten"
    got = L.scan_lines(spark.createDataFrame([(1, text, "a")], DOCS), templates=(), texts=templates).collect()
    # All 9 bigrams are there, and of 12 in the run also "three one", "three five" and "five one".
    assert [(r.line_no, r.license, round(r.dice, 6)) for r in got] == [(0, "A", round(18 / 21, 6))]
