"""Frequencies, vocabularies and root lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed value: shape of a dictionary head.
HEAD = "^[a-zà-ÿêèéåăṭḍ]+(?:-[a-zà-ÿêèéåăṭḍ]+)*$"
#: Abbreviations that stand alone on a dictionary's lines.
HEAD_NOISE = ("a", "b", "c", "ng", "kr", "ki", "ka", "var", "rg", "ltry", "inf", "sms", "see", "also", "or", "oj", "kn", "md")


def word_frequency(tokens: DataFrame, word: str = "word", by: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """(by..., word, cnt) with at least `least` occurrences; counted on the map side first."""
    return tokens.groupBy(*by, word).agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


def top_words(freq: DataFrame, k: int, by: tuple[str, ...] = (), word: str = "word") -> DataFrame:
    """The k most frequent words (of each class), ties by word, with their rank and share.

    Ranks come from a window over one class; Spark keeps only k rows of it per task before the shuffle.
    """
    if not by:
        total = freq.agg(F.sum("cnt").alias("total"))
        return freq.orderBy(F.desc("cnt"), word).limit(k).crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("cnt") / F.col("total"), 9)).drop("total")
    order = Window.partitionBy(*by).orderBy(F.desc("cnt"), word)
    return freq.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def threshold_histogram(freq: DataFrame, thresholds=(1, 2, 5, 10), by: tuple[str, ...] = ()) -> DataFrame:
    """How many words occur at least so often, a column for each threshold."""
    return freq.groupBy(*by).agg(*[F.count_if(F.col("cnt") >= t).alias(f"at_least_{t}") for t in thresholds])


def distinct_vocabulary(tokens: DataFrame, by: str, word: str = "word") -> DataFrame:
    return tokens.groupBy(by).agg(F.count_distinct(word).alias("vocabulary"), F.count("*").alias("tokens"))


def line_heads(lines: DataFrame) -> DataFrame:
    """Heads that stand alone on a line: one word of three letters or more, none of the noise, no hyphen at an end."""
    w = F.lower(T.strip(F.col("line")))
    return lines.select(w.alias("w")).where((F.length("w") >= 3) & ~F.col("w").isin(*HEAD_NOISE) & F.col("w").rlike(HEAD)).select(T.normalise(F.col("w")).alias("word")).distinct()


def synonym_heads(lines: DataFrame) -> DataFrame:
    """Heads of synonym lists: short lines that end in a colon, and the parts of lines with bars."""
    line = T.strip(F.col("line"))
    head = F.regexp_replace(line, "[ :]+$", "")
    words = F.size(F.split(line, r"(?U)\s+"))
    kept = lines.select(F.when(line.startswith("---"), None).when(line.endswith(":") & (words <= 3), head).when(F.contains(line, F.lit("|")), line).alias("l")).where("l is not null")
    parts = kept.select(F.explode(F.split("l", r"[|,.()]| ")).alias("p")).select(F.lower(T.strip(F.col("p"))).alias("w"))
    return parts.where((F.length("w") >= 3) & F.col("w").rlike(HEAD)).select(T.normalise(F.col("w")).alias("word")).distinct()


def colon_heads(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Heads before a colon, unless the next line is a short reference (`zie ...`). Blank lines count as next lines."""
    line = T.strip(F.col("line"))
    rows = lines.select(key, "line_no", line.alias("line")).withColumn("next", F.lead("line", 1, "").over(Window.partitionBy(key).orderBy("line_no")))
    w = F.lower(F.regexp_replace("line", "[ :]+$", ""))
    reference = F.lower("next").startswith("zie ") & (F.length("next") < 60)
    return rows.where(F.col("line").endswith(":") & ~reference).select(w.alias("w")).where((F.length("w") >= 3) & F.col("w").rlike(HEAD)).select(T.normalise(F.col("w")).alias("word")).distinct()


def union_of(*sets: DataFrame) -> DataFrame:
    """Words of any of the sets."""
    out = sets[0].select("word")
    for s in sets[1:]:
        out = out.union(s.select("word"))
    return out.distinct()


def set_algebra(a: DataFrame, b: DataFrame) -> DataFrame:
    """Words of either set with in_a and in_b: union, intersection and differences at once, by one aggregation."""
    marked = a.select("word", F.lit(True).alias("a")).union(b.select("word", F.lit(False)))
    return marked.groupBy("word").agg(F.max(F.col("a")).alias("in_a"), F.max(~F.col("a")).alias("in_b"))


def root_candidates(freq: DataFrame, known: DataFrame, least: int = 30, shortest: int = 4, longest: int = 9, variant_least: int = 5, variants: int = 3) -> DataFrame:
    """Frequent words, not yet known, of which enough regular forms occur: (word, cnt, forms). Order matters to miners, not here."""
    vowels = ("a", "e", "i", "o", "u")
    w = F.col("word")
    first, last = F.left(w, F.lit(1)), F.right(w, F.lit(1))
    rest = F.substring(w, 2, 1 << 30)
    nasal = (
        F.when(first.isin(*vowels), F.concat(F.lit("ng"), w)).when(first == "t", F.concat(F.lit("n"), rest)).when(first.isin("p", "w"), F.concat(F.lit("m"), rest))
        .when(first == "k", F.concat(F.lit("ng"), rest)).when(first.isin("s", "c"), F.concat(F.lit("ny"), rest)).when(first == "b", F.concat(F.lit("m"), w)).when(first == "d", F.concat(F.lit("n"), w))
        .when(first == "g", F.concat(F.lit("ngg"), w)).when(first == "j", F.concat(F.lit("nj"), w))
    )
    ends = F.when(last.isin(*vowels), F.array(*map(F.lit, ("ne", "nipun", "kake")))).otherwise(F.array(*map(F.lit, ("e", "ipun", "ake"))))
    forms = F.array_distinct(F.array_compact(F.concat(
        F.transform(F.array(*map(F.lit, ("di", "dipun", "tak", "ka"))), lambda p: F.concat(p, w)),
        F.transform(F.concat(ends, F.array(*map(F.lit, ("an", "i", "a", "en")))), lambda s: F.concat(w, s)), F.array(nasal))))
    asked = freq.where((F.col("cnt") >= least) & F.length("word").between(shortest, longest) & F.col("word").rlike(r"^\p{L}+$")).join(known.select("word"), "word", "left_anti")
    seen = freq.where(F.col("cnt") >= variant_least).select(F.col("word").alias("form"))
    return asked.select("word", "cnt", F.explode(forms).alias("form")).join(seen, "form").groupBy("word", "cnt").agg(F.count("*").alias("forms")).where(F.col("forms") >= variants)


def vocabulary_reduction(tokens: DataFrame, by: str) -> DataFrame:
    """Distinct words before and after lemmatisation, and the percentage saved. `tokens` has token and lemma."""
    out = tokens.groupBy(by).agg(F.count_distinct("token").alias("before"), F.count_distinct("lemma").alias("after"))
    return out.withColumn("saved_percent", F.round(100 * (1 - F.col("after") / F.col("before")), 6))
