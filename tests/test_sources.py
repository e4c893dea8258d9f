import json

import pytest

from weftline.operators import web
from weftline.sources import readers, writers
from weftline.streaming import words as streams


def test_text_files(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "x.txt").write_text("Title\nbody\nmore")
    (tmp_path / "in" / "a" / "_skip.txt").write_text("no")
    (tmp_path / "in" / "y.txt").write_text("Only")
    (tmp_path / "in" / "z.md").write_text("no")
    got = {r.rel_path: (r.title, r.body) for r in readers.text_files(spark, str(tmp_path / "in")).collect()}
    assert got == {"a/x.txt": ("Title", "body\nmore"), "y.txt": ("Only", "")}


def test_tables(spark, tmp_path):
    put = lambda name, text: ((tmp_path / name).write_text(text), str(tmp_path / name))[1]
    assert [tuple(r) for r in readers.frequency_table(spark, put("f", "a\tb\t3\nx\t1\nbad\n")).collect()] == [("a\tb", 3), ("x", 1)]
    assert {r.word for r in readers.word_set(spark, put("r", "a b\n\nb c\n")).collect()} == {"a", "b", "c"}
    row = "1\tOmahe\tOmah\tNOUN" + "\t_" * 6
    rows = readers.conllu(spark, put("c", f"# x\n{row}\n1-2\tq{chr(9) + '_' * 1}\n\n"))
    assert [tuple(r) for r in readers.evaluation_tokens(rows).collect()] == [("omahe", "omah")]
    assert [tuple(r) for r in readers.url_index(spark, put("u", "http://a 2010\nonly\nk 1 http://b\n")).collect()] == [("http://a", "2010")]
    assert [tuple(r) for r in readers.bucket_stats(spark, put("s", "sastra_vocab: 10->7\nx: 1\n")).collect()] == [("sastra", 10, 7)]
    assert [r.tokens for r in readers.token_lines(spark, put("t", "a b\n\nc\n")).collect()] == [["a", "b"], ["c"]]


def test_vectors_round_trip(spark, tmp_path):
    words = spark.createDataFrame([("a", [1.0, 2.5]), ("b", [0.0, -1.0])], "word string, vec array<float>")
    lines = writers.vector_lines(words)
    assert lines.first().line == "2 2"
    lines.write.text(str(tmp_path / "v"))
    assert {r.word: r.vec for r in readers.word_vectors(spark, str(tmp_path / "v")).collect()} == {"a": [1.0, 2.5], "b": [0.0, -1.0]}


def test_tsv_cleans_strings(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb\nc")], "i int, s string")
    writers.tsv(df, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).first().s == "a b c"


def test_paged_source(spark):
    def fetch(url):
        if "page_handle=2" in url:
            return json.dumps({"posts": [{"ID": 2, "date": "2012-03-04T00:00", "title": "b", "URL": "u2", "content": "c", "categories": {}}]})
        return json.dumps({"posts": [{"ID": 1, "date": "2011-01-02T10:00", "title": "a", "URL": "u1", "content": "c", "categories": {"x": {}, "y": {}}}], "meta": {"next_page": "2"}})

    class Fake(readers.PagedPosts):
        pass

    Fake.fetch = staticmethod(fetch)
    spark.dataSource.register(Fake)
    got = spark.read.format("paged_posts").option("url", "http://x?n=1").load().collect()
    assert [(r.id, r.date, r.categories) for r in got] == [(1, "2011-01-02", "x;y"), (2, "2012-03-04", "")]


def test_work_list(spark):
    rows = [("http://h/b/c/12-x", "2010", 0), ("http://h/b/c/12-x", "2012", 1), ("http://h/b/c/12-x", "2012", 2), ("http://h/a/c/7-y", "2011", 3), ("http://h/a/c/7-y?q", "2019", 4), ("http://h/a/c/no", "2011", 5), ("", "1", 6)]
    index = spark.createDataFrame(rows, "url string, ts string, seq int")
    got = [(r.section, r.item_id, r.seq) for r in web.work_list(index, sections=["a", "b"]).collect()]
    assert got == [("a", "7", 3), ("b", "12", 1)]


def test_crawl_and_missing(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "e")], "url string, target string")
    got = {r.url: r.depth for r in web.crawl(spark.createDataFrame([("a",)], "url string"), links).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    have = spark.createDataFrame([("1",)], "item_id string")
    want = spark.createDataFrame([("1",), ("2",)], "item_id string")
    assert [r.item_id for r in web.missing(want, have, "item_id").collect()] == ["2"]


def test_crawl_follows_long_chains(spark):
    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(24)], "url string, target string")
    start = spark.createDataFrame([("0",)], "url string")
    assert {r.url: r.depth for r in web.crawl(start, links).collect()} == {str(i): i for i in range(25)}
    with pytest.raises(ValueError):
        web.crawl(start, links, most_rounds=2)


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "<title>T - Site</title><nav>n</nav><article>Home<p>one</p>two</article>x"), (2, "nothing here")], "page_id int, html string")
    got = {r.page_id: r for r in web.extract_pages(pages, furniture="^Home$", title_affix=" - Site$").collect()}
    assert (got[1].title, got[1].body) == ("T", "one\ntwo")
    assert got[2].body is None


def test_streamed_counts_equal_batch(spark, tmp_path):
    events = spark.sql("select timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id * 7 as int)) ts, if(id % 3 = 0, 'a', 'b') event_type, id % 5 user_id, cast(id as double) value from range(60)")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = streams.windowed_counts(streams.read_events(spark, str(tmp_path / "e")))
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    key = lambda rows: sorted(map(tuple, rows))
    assert key(spark.table("counts").collect()) == key(streams.windowed_counts(spark.read.parquet(str(tmp_path / "e"))).collect())
    assert streams.sessions(spark.read.parquet(str(tmp_path / "e"))).count() > 0


def test_small_writers_and_names(spark, tmp_path):
    from pyspark.sql import functions as F

    from weftline.functions import text as T
    from weftline.operators import corpus

    docs = spark.createDataFrame([("a/x.txt", "k", "one\ntwo"), ("y.txt", None, "")], "rel_path string, bucket string, body string")
    writers.bucketed_texts(docs, str(tmp_path / "b"))
    assert {(r.name, r.bucket) for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {("a__x.txt", "k"), ("y.txt", None)}
    assert [r.body for r in corpus.single_line_corpus(docs, "body").collect()] == ["one two", ""]
    stats = spark.createDataFrame([("s", 10, 7), ("a", 2, 1)], "bucket string, before long, after long")
    lines = writers.stats_lines(stats)
    assert [r.line for r in lines.collect()] == ["a_vocab: 2->1", "s_vocab: 10->7"]
    lines.write.text(str(tmp_path / "s"))
    assert {tuple(r) for r in readers.bucket_stats(spark, str(tmp_path / "s")).collect()} == {("s", 10, 7), ("a", 2, 1)}
    writers.frequency_table(spark.createDataFrame([("b", 3), ("a", 3), ("c", 9), ("d", 2)], "word string, cnt long"), str(tmp_path / "f"))
    assert [r.value for r in spark.read.text(str(tmp_path / "f")).collect()] == ["c\t9", "a\t3", "b\t3"]
    log = spark.createDataFrame([("u", 503)], "url string, code int")
    writers.tsv(log, str(tmp_path / "t"))
    writers.tsv(log, str(tmp_path / "t"), "append")
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 2
    urls = spark.createDataFrame([("HTTP://www.Site.org:80/A/b?x#y",), ("site.org",)], "u string")
    assert [r.k for r in urls.select(web.url_key(F.col("u")).alias("k")).collect()] == ["site.org/A/b", "site.org"]
    files = spark.createDataFrame([("12-a.txt",), ("12-b.txt",), ("x.txt",)], "file_name string")
    assert [r.item_id for r in web.existing_ids(files).collect()] == ["12"]
    assert [r.t for r in urls.select(T.digits_to_zero(F.lit("a 12 b3")).alias("t")).collect()] == ["a 0 b0"] * 2
    tagged = spark.createDataFrame([(1, 0, "He", "he", "PRON"), (1, 1, "ran", "run", "VERB"), (1, 2, ".", ".", "PUNCT"), (1, 3, "two", "two", "NUM")], "doc_id int, tok_no int, token string, lemma string, pos string")
    assert corpus.tagged_text(tagged).first().body == "PRON1 run ORDINAL1"
    (tmp_path / "i3").write_text("key 2011 http://x\nno fields\n")
    assert [tuple(r) for r in readers.url_index(spark, str(tmp_path / "i3"), 3).collect()] == [("key", "2011", "http://x")]


def test_only_the_given_entities_are_decoded(spark):
    """Where the SQL names its entities, one cut off or another one stays as it is; extraction decodes all by default."""
    from weftline import queries

    pages = spark.createDataFrame([(1, "<title>a &amp;&amp;&amp</title><article><p>b &amp;quot; &copy &lt;</p></article>")], "page_id int, html string")
    row = web.extract_pages(pages, entities=queries.PAGE_ENTITIES).first()
    assert (row.title, row.body) == ("a &&&amp", "b &quot; &copy &lt;")
    row = web.extract_pages(pages).first()
    assert (row.title, row.body) == ("a &&&", "b &quot; © <")


def test_vector_lines_where_two_decimals_are_equally_near(spark):
    """19/1024 lies half way between its two shortest decimals; the line has the exact one."""
    rows = spark.createDataFrame([("w", [19 / 1024, 0.1, -19 / 1024, 1.5, 2.0**-12, 0.0])], "word string, vec array<float>")
    assert writers.vector_lines(rows).collect()[1].line == "w 0.0185546875 0.1 -0.0185546875 1.5 2.44140625E-4 0.0"
