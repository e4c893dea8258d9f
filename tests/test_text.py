import re
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import corpus, lexicon


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def contractions_in_python(text: str) -> str:
    """What expand_contractions() gives."""
    for old, new in T.CONTRACTIONS:
        text = text.replace(old, new)
    return " ".join(map(str.capitalize, re.sub(r"\s+", " ", re.sub(r"[^\w]", " ", text)).split(" ")))


def test_normalise(spark):
    assert one(spark, T.normalise, "Goenå", "TJILIK", "dj­oed", "ﬁn é", None, "") == ["guna", "cilik", "jud", "fin e", None, ""]
    once = one(spark, T.normalise, "Ångkåŕ Soerabaja")
    assert one(spark, T.normalise, *once) == once


def test_tokens(spark):
    assert one(spark, lambda c: T.tokens(c, ["aku"]), "aku duwe 12 tata-tata, x", "", None) == [["PRON1", "duwe", "ORDINAL1", "tata-tata", "x"], [], None]


def test_sentences(spark):
    assert one(spark, T.sentences, "a b. c d! e | f || g", "") == [["a b.", "c d!", "e", "f", "g"], []]


def test_contractions(spark):
    texts = ["I won't go, he can't", "they're 'ere", "it's MINE", ""]
    assert one(spark, T.expand_contractions, *texts) == [contractions_in_python(t) for t in texts]
    assert one(spark, T.expand_contractions, "I won't")[0] == "I Will Not"


def test_poem(spark):
    assert one(spark, T.is_poem, "", "Aa\nBb", "aa\nbb\nCc") == [True, True, False]


def test_html(spark):
    page = "<title> A &amp; B </title><script>x</script><p>one<br/>two</p><!-- no --><a href=\"/x\">l</a>"
    assert one(spark, T.html_to_text, page)[0] == "A & B one\ntwo\n\nl"
    assert one(spark, T.tag_lines, page)[0] == ["A & B", "one", "two", "l"]
    assert one(spark, T.html_links, page)[0] == ["/x"]
    assert one(spark, T.html_title, page)[0] == "A &amp; B"


def test_markdown_and_slug(spark):
    assert one(spark, T.markdown_to_text, "# Head\n![i](u)[link](v)\n---\ntext", "404 Not Found") == ["Head\nlink\n\ntext", ""]
    assert one(spark, T.slug, " A b/c! ", "!!", "x" * 200) == ["a_b_c", "untitled", "x" * 150]


def test_junk(spark):
    lines = ["", "--- 12 ---", "12. - (3)", "[", "§ 1", "12. Sinom", "1 2 a", "a line of text"]
    assert one(spark, corpus.junk_reason, *lines) == ["blank", "page", "numbers", "numbers", "editorial", "canto", "notation", None]


def test_language_carry(spark):
    rows = [(1, 0, "x y z"), (1, 1, "yang dengan"), (1, 2, "q"), (1, 3, "the of"), (1, 4, "zz"), (2, 0, "q")]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, line string")
    kept = corpus.carry_language(corpus.score_languages(df, {"en": ["the", "of"], "id": ["yang", "dengan"]}, "en"))
    assert [r.keep for r in kept.orderBy("doc_id", "line_no").collect()] == [True, False, False, True, True, True]


def test_shared_words_count_for_neither(spark):
    df = spark.createDataFrame([(1, 0, "supaya ing")], "doc_id int, line_no int, line string")
    got = corpus.score_languages(df, {"jv": ["supaya", "ing"], "id": ["supaya"], "en": ["ing"], "nl": ["ing"]}, "jv", ("id",)).first()
    assert (got.target_hits, got.other_hits) == (1, 2)


def test_bucket(spark):
    df = spark.createDataFrame([("sastra-org/arsip-dan-sejarah/x", ""), ("sastra-org/_recovered/x", "Kajawèn 3"), ("panjebarsemangat/a", ""), ("b", "")], "p string, t string")
    assert [r[0] for r in df.select(corpus.bucket(F.col("p"), F.col("t"))).collect()] == ["arsip", "jurnal", "majalah", "sastra"]


def test_exclusions_keep_empty_documents(spark):
    docs = spark.createDataFrame([(1, "Kamus X"), (2, "ok"), (3, "ok")], "doc_id int, title string")
    sentences = spark.createDataFrame([(3, 0, 0, ["a"] * 30)], "doc_id int, line_no int, sent_no int, tokens array<string>")
    assert {r.doc_id: r.reason for r in corpus.exclusions(docs, sentences, F.col("title")).collect()} == {1: "title", 2: "short: 0 tokens"}


def test_numerals(spark):
    rows = [(1, i, t, p) for i, (t, p) in enumerate([("two", "NUM"), ("hundred", "NUM"), ("5", "NUM"), ("six", "NUM"), ("x", "X")])]
    df = spark.createDataFrame(rows, "doc_id int, tok_no int, token string, pos string")
    assert [r.token for r in corpus.collapse_numerals(df).orderBy("tok_no").collect()] == ["0", "0", "0", "x"]


def test_dictionary_heads(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["abang", "see", "two words", "-x", "omah:", "zie griya", "griya:", "a house", "dalem | wisma"])], "doc_id int, line_no int, line string")
    words = lambda df: {r.word for r in df.collect()}
    assert words(lexicon.line_heads(lines)) == {"abang"}
    assert words(lexicon.colon_heads(lines)) == {"griya"}
    assert words(lexicon.synonym_heads(lines)) == {"omah", "griya", "dalem", "wisma"}
