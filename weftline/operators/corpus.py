"""Documents to clean lines, sentences and corpora."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Titles of dictionaries, grammars and word lists.
REFERENCE_TITLES = (
    r"(?iu)dictionary|dictionnaire|woordenboek|wordenboek|kamus|leksikon|paramasastra|spraakkunst|synoniemen|grammatica|dasanama|"
    r"javaansch.*taal|woordenlijst|pangkalan.?data|wawaton.?panyerat|frekuensi.?kata"
)
#: Marks of digitised pages.
PAGE_MARK = r"^---\s*.+?\s*---$"
CANTO_HEAD = r"(?U)^\d+\.?\s+[A-Za-zÀ-ÿê]+\s*$"
NUMBERS_ONLY = r"(?U)^[\d\s.\-:()\[\]]+$"
EDITORIAL_PATTERNS = (
    "^§", r"teks asli\s*:", "kurang satu", "lebih satu", "kirang sa", "langkung sa", "prayoginipun", r"kembali\)", "^sambungan$", "^citra$", "^judul$", "tanggal masehi",
    "^lingkup pencarian", "^teks pencarian", "^filter pencarian",
)
EDITORIAL = "(?iu)" + "|".join(EDITORIAL_PATTERNS)
#: A fixed part of each of them, which every line has that it matches.
EDITORIAL_PARTS = tuple(re.sub(r"^\^|\$$|\\s\*:|\\", "", p) for p in EDITORIAL_PATTERNS)
BROKEN_WORD = r"\[[^\]\[]*\.\.\.[^\]\[]*\]"
FOOTNOTE = r"(?U)\[\s*\d+\s*\]"
#: Letters of a word when languages are scored.
SCORED_WORD = "[a-zà-ÿêèéåăôíìóòúùṭḍ]+"
#: Title patterns of recovered texts, and path prefixes, by bucket.
RECOVERED_JOURNALS = "(?iu)kajaw[eè]n|pusaka jawi|s[eê]dya tama|darma kanda|narpawandawa|waspada|panji pustaka"
RECOVERED_ARCHIVES = "(?iu)koleksi warsadiningrat|arsip"


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text", title_line: bool = False) -> DataFrame:
    """(key, line_no, line) with line_no from 0 and white space stripped. With `title_line` the first line is left out."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    if title_line:
        rows = rows.where("line_no > 0")
    # A generator of one row: the optimizer would copy the stripping into every test of the line.
    return rows.select(key, "line_no", F.explode(F.array(T.strip(F.col("line")))).alias("line"))


def bucket(path: Column, title: Column) -> Column:
    """Class of a text by its path, or for recovered ones by its title."""
    recovered = F.when(title.rlike(RECOVERED_JOURNALS), "jurnal").when(title.rlike(RECOVERED_ARCHIVES), "arsip").otherwise("sastra")
    return (
        F.when(path.startswith("sastra-org/arsip-dan-sejarah"), "arsip").when(path.startswith("sastra-org/koran-majalah-dan-jurnal"), "jurnal")
        .when(path.startswith("sastra-org/_recovered"), recovered).when(path.startswith("panjebarsemangat/"), "majalah").otherwise("sastra")
    )


def junk_reason(line: Column, words: Column | None = None) -> Column:
    """Why a line, stripped, is no text, or null; the first reason that holds. Cheap tests go before the patterns that they bound."""
    low = F.lower(line)
    editorial = F.lit(False)
    for part in EDITORIAL_PARTS:
        editorial = editorial | low.contains(part)
    starts_with_digit = F.substring(line, 1, 1).rlike(r"(?U)^\d")
    return (
        F.when(line == "", "blank").when(line.startswith("---") & line.rlike(PAGE_MARK), "page").when(line.rlike(NUMBERS_ONLY), "numbers").when(line.isin("[", "]"), "bracket")
        .when(editorial & line.rlike(EDITORIAL), "editorial").when(starts_with_digit & line.rlike(CANTO_HEAD), "canto").when(T.is_notation(line, words), "notation")
    )


def clean_lines(lines: DataFrame) -> DataFrame:
    """Lines of text only, without broken words and footnote marks. Runs before language scoring."""
    line = F.col("line")
    inline = F.when(line.contains("["), F.regexp_replace(F.regexp_replace("line", BROKEN_WORD, " "), FOOTNOTE, " ")).otherwise(line)
    # A generator of one row: the optimizer would copy the words into every place that reads them.
    rows = lines.select("*", F.explode(F.array(T.words_of_line(line))).alias("_words"))
    return rows.where(junk_reason(line, F.col("_words")).isNull()).drop("_words").withColumn("line", inline)


def score_languages(lines: DataFrame, lexicon: dict[str, list[str]], target: str, shared_with: tuple[str, ...] = ()) -> DataFrame:
    """Adds target_hits and other_hits: words of a line in the target's list, and in each other list (a word in two counts twice).

    Words that the target shares with the lists named in `shared_with` count for neither. The lists are parameters of
    bounded size and become literals; a line is scored where it stands, without a join.
    """
    common = {w for name in shared_with for w in lexicon[name]} & set(lexicon[target])
    words = F.regexp_extract_all(F.lower("line"), F.lit(SCORED_WORD), F.lit(0))

    def hits(name: str) -> Column:
        own = sorted(set(lexicon[name]) - (common if name in (target, *shared_with) else set()))
        return F.size(F.filter("_words", lambda w: w.isin(*own))) if own else F.lit(0)

    scored = lines.select("*", F.explode(F.array(words)).alias("_words"))
    other = sum((hits(n) for n in sorted(lexicon) if n != target), F.lit(0))
    return scored.withColumn("target_hits", hits(target)).withColumn("other_hits", other).drop("_words")


def carry_language(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds keep: more target than other hits; a line without hits follows the last one that had any, at first true.

    The window is one document wide.
    """
    decided = F.when(F.col("target_hits") + F.col("other_hits") > 0, F.col("target_hits") > F.col("other_hits"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return scored.withColumn("keep", F.coalesce(F.last(decided, ignorenulls=True).over(before), F.lit(True)))


def sentences_of(lines: DataFrame, key: str = "doc_id", pronouns: list[str] | None = None, decompose: bool = True, shortest: int = 3) -> DataFrame:
    """(key, line_no, sent_no, tokens) of sentences with enough words, no more than half of them single letters."""
    parts = lines.select(key, "line_no", F.posexplode(F.split(T.normalise(F.col("line"), decompose), T.SENTENCE_END)).alias("sent_no", "sentence"))
    found = parts.select(key, "line_no", "sent_no", F.explode(F.array(T.tokens(F.col("sentence"), pronouns))).alias("tokens"))
    single = F.size(F.filter("tokens", lambda t: F.length(t) == 1))
    return found.where((F.size("tokens") >= shortest) & (single <= F.floor(F.size("tokens") / 2)))


def exclusions(docs: DataFrame, sentences: DataFrame, title: Column, key: str = "doc_id", least_tokens: int = 30, titles: str = REFERENCE_TITLES) -> DataFrame:
    """(key, reason) of documents left out: by title first, then as too short. Documents without sentences are among them."""
    sizes = sentences.groupBy(key).agg(F.sum(F.size("tokens")).alias("n"))
    n = F.coalesce("n", F.lit(0))
    reason = F.when(F.coalesce(title.rlike(titles), F.lit(False)), F.lit("title")).when(n < least_tokens, F.concat(F.lit("short: "), n.cast("string"), F.lit(" tokens")))
    return docs.join(sizes, key, "left").select(key, reason.alias("reason")).where("reason is not null")


def segment_corpus(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a sentence."""
    return sentences.select(key, "line_no", "sent_no", F.array_join("tokens", " ").alias("segment"))


def text_corpus(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document: its sentences in order."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "sent_no", "tokens")))
    return sentences.groupBy(key).agg(F.array_join(F.flatten(F.transform(ordered, lambda s: s["tokens"])), " ").alias("body"))


def corpus_stats(sentences: DataFrame, by: str) -> DataFrame:
    """Files, sentences, tokens and mean sentence length of each class."""
    per_doc = sentences.groupBy(by, "doc_id").agg(F.count("*").alias("s"), F.sum(F.size("tokens")).alias("t"))
    return per_doc.groupBy(by).agg(F.count("*").alias("files"), F.sum("s").alias("sentences"), F.sum("t").alias("tokens"), F.round(F.sum("t") / F.sum("s"), 6).alias("mean_length"))


def single_line_corpus(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts on one line each."""
    return docs.withColumn(text, F.regexp_replace(text, "\n", " "))


def head_zone(lines: DataFrame, furniture: Column, key: str = "doc_id", zone: int = 40) -> DataFrame:
    """Drops furniture lines until the first other line that is not blank, in the first `zone` lines only."""
    content = F.when(~furniture & (F.col("line") != ""), 1).otherwise(0)
    seen = F.max(content).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("_seen", seen).where((F.col("_seen") == 1) | (F.col("line_no") >= zone) | ~furniture).drop("_seen")


def sweep_head(text: Column, furniture: Callable[[Column], Column], zone: int = 40) -> Column:
    """A text behind its title line without the furniture lines before the first other line that is not blank, in the first `zone` lines only. Runs on a document where it stands."""
    lines = F.split(text, "\n")
    body = F.slice(lines, 2, F.size(lines))
    content = F.filter(F.transform(body, lambda x, i: F.when(~furniture(x) & (T.strip(x) != ""), i)), lambda i: i.isNotNull())
    until = F.least(F.coalesce(F.try_element_at(content, F.lit(1)), F.size(body)), F.lit(zone))
    kept = F.concat(F.filter(F.slice(body, 1, until), lambda x: ~furniture(x)), F.slice(body, until + 1, F.size(body)))
    return F.array_join(F.concat(F.slice(lines, 1, 1), kept), "\n")


def trim_prefix(lines: DataFrame, furniture: Column, key: str = "doc_id") -> DataFrame:
    """Drops the unbroken run of furniture lines at the start."""
    still = F.min(F.when(furniture, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("_still", still).where("_still = 0").drop("_still")


def cut_after_last(lines: DataFrame, marker: Column, key: str = "doc_id", zone: int = 400) -> DataFrame:
    """Only the lines after the last marker among the first `zone`; all without one."""
    last = F.max(F.when(marker & (F.col("line_no") < zone), F.col("line_no"))).over(Window.partitionBy(key))
    return lines.withColumn("_last", last).where("_last is null or line_no > _last").drop("_last")


def cut_footer(lines: DataFrame, marker: Column, key: str = "doc_id", zone: int = 80) -> DataFrame:
    """Only the lines before the earliest marker among the last `zone`."""
    whole = Window.partitionBy(key)
    rows = lines.withColumn("_n", F.max("line_no").over(whole) + 1)
    first = F.min(F.when(marker & (F.col("line_no") >= F.col("_n") - zone), F.col("line_no"))).over(whole)
    return rows.withColumn("_first", first).where("_first is null or line_no < _first").drop("_first", "_n")


def start_at_first(lines: DataFrame, marker: Column, key: str = "doc_id") -> DataFrame:
    """Lines from the first marker on; all without one."""
    first = F.min(F.when(marker, F.col("line_no"))).over(Window.partitionBy(key))
    return lines.withColumn("_first", first).where("_first is null or line_no >= _first").drop("_first")


def with_next_line(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds next_line, empty behind the last."""
    return lines.withColumn("next_line", F.lead("line", 1, "").over(Window.partitionBy(key).orderBy("line_no")))


def collapse_numerals(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens with numbers as `0`: a run of number words (pos `NUM`, no digits) gives one; digit tokens give one each."""
    word = (F.col("pos") == "NUM") & ~F.col("token").rlike(r"(?U)\d")
    again = word & F.coalesce(F.lag(word).over(Window.partitionBy(key).orderBy("tok_no")), F.lit(False))
    number = word | F.col("token").rlike(r"(?U)^\d+$")
    return tokens.withColumn("_again", again).where("not _again").drop("_again").withColumn("token", F.when(number, F.lit("0")).otherwise(F.col("token")))


def tagged_text(tokens: DataFrame, key: str = "doc_id", classes: dict[str, str] | None = None) -> DataFrame:
    """Text of tagged tokens: lemmas, or the class token of their part of speech; punctuation is dropped."""
    classes = {"PRON": "PRON1", "NUM": "ORDINAL1", "PROPN": "PROPN1"} if classes is None else classes
    chosen = F.col("lemma")
    for pos, name in classes.items():
        chosen = F.when(F.col("pos") == pos, F.lit(name)).otherwise(chosen)
    rows = tokens.where(~F.col("pos").isin("PUNCT", "SYM", "SPACE")).withColumn("_w", chosen)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tok_no", "_w"))), lambda s: s["_w"]), " ").alias("body"))
