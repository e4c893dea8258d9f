"""The crawl worker, layered extraction, folders of texts and tables rewritten in place."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from weftline.operators import corpus, extract, web
from weftline.sources import archive, folders
from weftline.sources.versions import Conflict, VersionedTable
from weftline.streaming import worker

BODY = "<html><title>t</title><body>" + "words of a page " * 200 + "</body></html>"


def site():
    """Answers by the item's name: busy or missing for some attempts, short, without text, or failing."""
    body, bare = BODY, "<html><body>" + "<br>" * 900 + "</body></html>"

    def answer(item, attempt):
        kind, n = item["url"].split("-")[1], int(item["url"].split("-")[2])
        if kind == "raise":
            raise OSError("no route")
        if kind in ("busy", "gone") and attempt <= n % 5:
            return (503 if kind == "busy" else 404), None
        return 200, {"short": "x", "bare": bare}.get(kind, body)

    return answer


def start(spark, path, items, out, checkpoint, policy=worker.Policy(busy_wait=1, other_wait=1)):
    stream = spark.readStream.schema("url string, ts long").option("maxFilesPerTrigger", 2).parquet(items)
    return worker.start(stream, "url", site(), f"{path}/{out}", f"{path}/{checkpoint}", policy)


def results(spark, path, out):
    saved, failed = worker.results(spark, f"{path}/{out}", web.extract_pages)
    return {r.url: (r.attempt, r.code, r.title) for r in saved.collect()}, {r.url: (r.attempt, r.code) for r in failed.collect()}


def test_worker_restarts_where_it_was(spark, tmp_path):
    items = str(tmp_path / "items")
    urls = [f"u-{kind}-{n}" for kind in ("plain", "busy", "gone", "short", "bare", "raise") for n in range(5)]
    rows = [(u, i) for i, u in enumerate(urls)]
    for part in range(5):
        spark.createDataFrame(rows[part::5] + rows[:2], "url string, ts long").coalesce(1).write.mode("append").parquet(items)
    worker.finish(spark, start(spark, tmp_path, items, "one", "c1"), f"{tmp_path}/one", "url", most=300)
    saved, failed = results(spark, tmp_path, "one")
    busy = {f"u-{k}-{n}": n + 1 for k in ("busy", "gone") for n in range(4)}
    assert saved == {**{f"u-plain-{n}": (1, 200, "t") for n in range(5)}, **{u: (n, 200, "t") for u, n in busy.items()}}
    assert failed == {**{f"u-short-{n}": (4, 200) for n in range(5)}, **{f"u-bare-{n}": (1, 200) for n in range(5)}, **{f"u-raise-{n}": (4, 0) for n in range(5)}, "u-busy-4": (4, 503), "u-gone-4": (4, 404)}
    log = worker.attempts(spark, f"{tmp_path}/one")
    assert log.count() == sum(a for a, *_ in [*saved.values(), *failed.values()])
    # Killed as soon as anything is written, and started again until all is done.
    query = start(spark, tmp_path, items, "two", "c2")
    until = time.time() + 120
    while worker.attempts(spark, f"{tmp_path}/two") is None and time.time() < until:
        time.sleep(0.05)
    query.stop()
    done = worker.attempts(spark, f"{tmp_path}/two").where("final").count()
    assert done < len(urls)
    worker.finish(spark, start(spark, tmp_path, items, "two", "c2"), f"{tmp_path}/two", "url", most=300)
    assert results(spark, tmp_path, "two") == (saved, failed)
    assert sorted(map(tuple, worker.attempts(spark, f"{tmp_path}/two").select("url", "attempt", "code", "final").collect())) == sorted(map(tuple, log.select("url", "attempt", "code", "final").collect()))


def test_archive(spark, tmp_path):
    rows = [(i, None if i == 3 else "" if i == 4 else f"é{i}" * i * 50) for i in range(40)]
    pages = spark.createDataFrame(rows, "i int, html string").repartition(3)
    archive.pack(pages, "html", str(tmp_path / "a")).write.parquet(str(tmp_path / "index"))
    read = archive.reader(str(tmp_path / "a"))
    assert {r.i: read(r.asDict()) for r in spark.read.parquet(str(tmp_path / "index")).collect()} == dict(rows)


def test_waits():
    p = worker.Policy()
    assert [p.wait(503, n) for n in (1, 2, 3)] == [20_000, 40_000, 60_000] and p.wait(404, 3) == 3_000 and p.wait(0, 1) == 20_000
    assert p.answered(200, "x" * 2001) and not p.answered(200, "x" * 2000) and not p.answered(200, None) and not p.answered(500, "x" * 9000)


# Extraction.

def plain_rule(lines, rule, title):
    """What a rule leaves, found by searching the lines."""
    hits = [i for i, x in enumerate(lines) if (re.search(rule.pattern, x) or (rule.title and x == title)) and (rule.zone is None or i < rule.zone)]
    if rule.kind == "drop while":
        n = 0
        while n < len(lines) and n in hits:
            n += 1
        return lines[n:]
    if not hits:
        return [] if rule.needed or (rule.short and len(lines) < rule.zone) else lines
    at = hits[-1] if rule.kind == "after last" else hits[0]
    if rule.kind == "until":
        return lines[:at]
    rest = lines[at + (rule.kind != "from first"):]
    if rule.then and not re.search(rule.unless or "$^", lines[at]):
        rest = plain_rule(rest, rule.then, title)
    return rest


RULES = [
    extract.Rule("after last", "k", 3), extract.Rule("after last", "k"), extract.Rule("drop while", "^a|k", title=True), extract.Rule("after first", "k", 2), extract.Rule("after first", "z", 2, needed=True),
    extract.Rule("from first", "^--- .* ---$"), extract.Rule("until", "k"), extract.Rule("after first", "k", 3, then=extract.Rule("after first", "d", 2, short=True), unless="kk"), extract.Rule("after first", "", 1),
]


def test_rules(spark):
    import random

    rng = random.Random(1)
    bodies = [[rng.choice(("a", "k", "kk", "the title", "d", "--- 1 ---", "x", "ak")) for _ in range(rng.randint(0, 7))] for _ in range(120)]
    pages = spark.createDataFrame([(i, "<title>the title</title><main>" + "<br>".join(b)) for i, b in enumerate(bodies)], "i int, html string")
    for rule in RULES:
        got = {r.i: r.body for r in extract.extract(pages, (extract.Layout("m", "<main>", rules=(rule,)),)).collect()}
        assert got == {i: "\n".join(plain_rule(b, rule, "the title")) for i, b in enumerate(bodies)}, rule


def test_library_pages(spark):
    head = "<title>Sastra Jawa - A work &amp; more - Sastra Jawa</title>"
    new = head + '<div class="com-content-article__body" itemprop="x"><p>Sambungan</p><p>1. Part. Kategori: a</p><p>2. Part.  Kategori: b</p><p>Citra</p><p>A work &amp; more</p><p>: chip</p><p>Terakhir diubah: x</p><p>help</p><p>a variasi ejaan b</p><p>.</p><p>[dj : j]</p><p>Real   text</p><script>no()</script><p>Citra</p><footer>end</footer></main>'
    kit = '<title>B</title><article class="uk-article" id="1"><p>Judul</p><p>B</p>one<!-- two --><br>three</article>after'
    old = '<title>C</title><div id="ja-content"><p>menu</p><p>--- 1 ---</p><p>body</p><div id="ja-col1">side'
    rows = [(1, new), (2, kit), (3, old), (4, "<title>D</title><p>listing</p>"), (5, None), (6, ""), (7, '<div id="ja-content">no mark')]
    got = {r.i: (r.layout, r.title, r.body) for r in extract.extract(spark.createDataFrame(rows, "i int, html string").withColumn("body", F.lit("own")), extract.LIBRARY, affixes=extract.LIBRARY_TITLE).collect()}
    assert got == {
        1: ("article body", "A work & more", "Real text\nCitra"), 2: ("article element", "B", "one\nthree"), 3: ("old columns", "C", "--- 1 ---\nbody"),
        4: (None, "D", None), 5: (None, None, None), 6: (None, "", None), 7: ("old columns", "", "no mark"),
    }


def test_periodical_and_portal_pages(spark):
    post = '<div class="single_post"><h1>Title</h1><a>Cerita</a>, <a>Sambung</a> <span>- Posted by</span><b>admin</b><i>on December 13, 2010</i><p>First.</p><p>Second.</p>This Post Tagged with x'
    same = '<div class="single_post"><h1>Title</h1><a>Warta - Posted by admin on May 1, 2011</a><p>on June 2, 2012</p>'
    page = "<div class='left_bar' id='detail_bar2'><i class='judul_berita'>Judul &amp; x</i><p>Kategori</p><p>- Alaming Lelembut -</p><p>Diwaca 12 kali</p><p>Body</p><p>Komentar (2)</p><p>no</p><div id=\"katonkanan\">"
    rows = [(1, post), (2, same), (3, page), (4, "<title>list</title>")]
    got = {r.i: (r.layout, r.title, r.category, r.body) for r in extract.extract(spark.createDataFrame(rows, "i int, html string"), extract.PERIODICAL).collect()}
    assert got == {
        1: ("blog post", "Title", "Cerita Sambung", "First.\nSecond."), 2: ("blog post", "Title", "Warta", "on June 2, 2012"), 3: ("article page", "Judul & x", "Alaming Lelembut", "Body"), 4: (None, "list", None, None),
    }
    portal = [(1, '<div class="blog item-page x"><p>One  two</p><ul class="pagenav">next'), (2, "<p>whole</p>")]
    assert {r.i: (r.layout, r.body) for r in extract.extract(spark.createDataFrame(portal, "i int, html string"), extract.PORTAL).collect()} == {1: ("item page", "One two"), 2: ("whole page", "whole")}


# Folders.

def test_folder(spark, tmp_path):
    path = str(tmp_path / "texts")
    rows = [("a/b.txt", "é"), ("c", None), (None, "x"), ("c", "again"), ("d.txt", "1"), ("d.txt", "2")]
    folders.write_folder(spark.createDataFrame(rows, "name string, text string").coalesce(1), path)
    read = lambda: {r.name: (tmp_path / "texts" / r.file).read_text() for r in folders.manifest(spark, path).collect()}
    assert read() == {"a__b.txt": "é", "c": "", "untitled": "x", "c-1": "again", "d.txt": "1", "d-1.txt": "2"}
    folders.write_folder(spark.createDataFrame([("e", "5")], "name string, text string"), path)
    assert len(read()) == 7
    folders.write_folder(spark.createDataFrame([("f", "6")], "name string, text string"), path, "overwrite")
    assert read() == {"f": "6"} and len([x for x in (tmp_path / "texts").iterdir() if x.name.startswith("part-")]) == 1
    folders.write_folder(spark.createDataFrame([], "name string, text string"), path)
    assert read() == {"f": "6"} and not [x for x in (tmp_path / "texts").iterdir() if x.name.startswith("_staging")]


def test_folder_of_a_failed_job_is_empty(spark, tmp_path):
    path = tmp_path / "texts"
    bad = spark.range(0, 400, 1, 4).select(F.concat(F.lit("n"), F.col("id")).alias("name"), F.when(F.col("id") == 399, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("text"))
    with pytest.raises(Exception, match="broken"):
        folders.write_folder(bad, str(path))
    assert not path.exists() or not [x for x in path.rglob("*") if x.is_file()]


# Versions.

def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    rows = [(i, "Sambungan\nx" if i < 3 else "plain") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4, "id").sortWithinPartitions("id")
    assert table.create(df) == 1
    before = table.read()
    files = lambda: sorted(str(x) for x in (tmp_path / "t").rglob("*.parquet"))
    first = files()
    sweep = {"text": F.regexp_replace("text", "^Sambungan\n", "")}
    assert table.update(sweep) == 2
    assert {r.text for r in table.read().collect()} == {"x", "plain"} and {r.text for r in before.collect()} == {"Sambungan\nx", "plain"}
    assert {r.text for r in table.read(1).collect()} == {"Sambungan\nx", "plain"}
    # Only the parts of the three rows are new.
    manifests = [json.loads((tmp_path / "t" / "versions" / f"{v:08d}.json").read_text())["parts"] for v in (1, 2)]
    changed = [p for p in manifests[0] if manifests[0][p] != manifests[1][p]]
    assert 0 < len(changed) < len(manifests[0])
    second = files()
    assert table.update(sweep) is None and files() == second and table.versions() == [1, 2]
    assert table.rewrite(lambda d: d.where("id <> 7")) == 3 and table.read().count() == 39
    assert table.vacuum() > 0 and table.versions() == [3] and table.read().count() == 39 and not set(first) <= set(files())
    with pytest.raises(Conflict):
        table._publish(3, {})
    assert table.rewrite(lambda d: d.where("false")) == 4 and table.read().count() == 0 and table.read().columns == ["id", "text"]


def test_a_failed_rewrite_leaves_the_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.create(spark.range(10).select("id", F.lit("x").alias("text")))
    with pytest.raises(Exception, match="broken"):
        table.update({"text": F.when(F.col("id") == 9, F.raise_error(F.lit("broken"))).otherwise(F.lit("y"))})
    assert table.versions() == [1] and {r.text for r in table.read().collect()} == {"x"}
    assert not [x for x in (tmp_path / "t" / "versions").iterdir() if x.name.startswith("_")]


def test_sweep(spark):
    furniture = lambda x: x.isin("Citra", "Judul") | x.startswith(": ")
    texts = {1: "T\nCitra\n\nJudul\nreal\nCitra", 2: "T", 3: "", 4: None, 5: "T\n" + "Citra\n" * 50 + "x", 6: "T\n: a\n: b", 7: "Citra\nx"}
    got = {r.i: r.t for r in spark.createDataFrame(list(texts.items()), "i int, t string").select("i", corpus.sweep_head(F.col("t"), furniture).alias("t")).collect()}
    assert got == {1: "T\n\nreal\nCitra", 2: "T", 3: "", 4: None, 5: "T\n" + "Citra\n" * 10 + "x", 6: "T", 7: "Citra\nx"}


def test_crawl_worker_decodes_as_its_sql(spark, tmp_path):
    """A page cut inside an entity has the digest of the text that the SQL's own entities give."""
    import hashlib

    from weftline import queries

    text = "word &lt; " * 250 + "&amp"
    spark.createDataFrame([(3, "http://a.b/c", f"<title>t</title><article><p>{text}</p></article>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    row = queries.crawl_worker(spark, str(tmp_path)).first()
    assert (row.saved, row.digest) == (True, hashlib.md5(text.encode()).hexdigest())


def test_layouts_with_given_entities(spark):
    from weftline import queries

    pages = spark.createDataFrame([(1, "<title>a &amp;&amp</title><main><b>c &amp;&amp</b><p>d &copy; &copy</p>")], "i int, html string")
    layout = (extract.Layout("m", "<main>", title="<b>(.*?)</b>"),)
    row = extract.extract(pages, layout, entities=queries.PAGE_ENTITIES).first()
    assert (row.title, row.body) == ("c &&amp", "c &&amp\nd © &copy")
    assert extract.extract(pages.withColumn("html", F.replace("html", F.lit("main"), F.lit("none"))), layout, entities=queries.PAGE_ENTITIES).first().title == "a &&amp"
    assert extract.extract(pages, layout).first().body == "c &&\nd © ©"
