"""Whole plans: documents to sentences, and the tables that queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus

#: Frequent words by which lines are told apart.
STOP_WORDS: dict[str, tuple[str, ...]] = {
    "en": (
        "the", "of", "and", "to", "in", "is", "was", "for", "with", "that", "this", "are", "be", "or", "from", "by", "an", "not", "his", "her",
    ),
    "nl": (
        "de", "het", "van", "en", "een", "der", "den", "te", "dat", "die", "met", "voor", "zijn", "aan", "op", "is", "niet", "ook", "naar", "worden",
        "wordt", "deze", "bij", "uit", "over", "tot",
    ),
    "id": (
        "yang", "dengan", "tidak", "dari", "untuk", "pada", "adalah", "dalam", "dan", "akan", "sudah", "telah", "bisa", "karena", "mereka", "kita", "saya",
        "anda", "tersebut", "sebagai", "juga", "atau", "itu", "ini", "oleh", "ke", "di", "secara", "tetapi", "namun", "agar", "supaya", "jika", "kalau",
        "saat", "ketika", "sehingga", "kemudian", "yaitu", "ialah", "bahwa", "para", "merupakan", "terhadap", "seperti", "antara", "banyak", "lebih",
    ),
    "jv": (
        "ing", "kang", "iku", "ora", "lan", "saka", "karo", "wis", "ana", "iki", "kanthi", "dening", "marang", "sing", "ingkang", "punika", "menika",
        "wonten", "boten", "mboten", "sampun", "dhateng", "saking", "ugi", "inggih", "kaliyan", "dene", "yen", "menawa", "menawi", "nanging", "amarga",
        "amargi", "supaya", "supados", "banjur", "lajeng", "uga", "apa", "punapa", "kados", "kaya", "sarta", "tuwin", "utawi", "utawa", "datan", "tan",
        "kalawan", "miwah", "ingsun", "sira", "dadya", "dadi", "dados", "arsa", "badhe", "bakal", "wus", "maring", "aneng", "neng", "ono", "iso", "isa",
        "ake", "dhumateng", "kagem", "dhewe", "piyambak", "malih", "maneh", "sanget", "banget", "mawi", "tanpa", "sajroning", "salebeting",
    ),
}
#: Pronouns that become one class token.
PRONOUNS = (
    "aku", "kula", "kawula", "ingsun", "ingwang", "kowe", "sira", "sampeyan", "panjenengan", "panjenenganipun", "dheweke", "dheke", "piyambakipun",
    "kita", "awakmu", "awakku", "slirane", "sliramu",
)


def words(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, and one row for each word of it (word): runs of letters in lower case."""
    return docs.select(*[c for c in docs.columns if c != text], F.explode(F.regexp_extract_all(F.lower(text), F.lit(corpus.SCORED_WORD), F.lit(0))).alias("word"))


def kept_lines(docs: DataFrame, target: str = "en", lexicon: dict[str, list[str]] | None = None, title_line: bool = False, shared_with: tuple[str, ...] = ()) -> DataFrame:
    """Clean lines in the target language, one window over each document and no other shuffle."""
    lines = corpus.clean_lines(corpus.lines_of(docs, title_line=title_line))
    scored = corpus.score_languages(lines, lexicon or STOP_WORDS, target, shared_with)
    return corpus.carry_language(scored).where("keep").select("doc_id", "line_no", "line")


def clean_corpus(docs: DataFrame, target: str = "en", decompose: bool = True, **options) -> DataFrame:
    """(doc_id, line_no, sent_no, tokens): clean lines of the target language as sentences."""
    return corpus.sentences_of(kept_lines(docs, target, **options), pronouns=PRONOUNS, decompose=decompose)
