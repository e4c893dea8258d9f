"""Column functions on text. Regular expressions are Unicode-aware where the data are, hence `(?U)`."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that are folded before accents are dropped.
FOLD_FROM, FOLD_TO = "êèéëåăâàáíìîïóòôöúùûüñç", "eeeeaaaaaiiiioooouuuunc"
#: Spelling rewrites, in this order.
SPELLING = (("oe", "u"), ("tj", "c"), ("dj", "j"))
#: Words are letters with inner hyphens, or digits.
TOKEN = "[a-z]+(?:-[a-z]+)*|\\d+"
NUMBER_TOKEN, PRONOUN_TOKEN = "ORDINAL1", "PRON1"
#: Fixed value: sentences end after `.?!;` and white space, or at single and double bars.
SENTENCE_END = r"(?<=[.?!;])\s+|\s*\|\|\s*|\s*\|\s*"
#: English contractions, the special ones first, in this order.
CONTRACTIONS = (("won't", "will not"), ("can't", "can not"), ("n't", " not"), ("'re", " are"), ("'s", " is"), ("'d", " would"), ("'ll", " will"), ("'t", " not"), ("'ve", " have"), ("'m", " am"))


def _mapped(one: Callable[[str], str], text: Column) -> Column:
    """A Python function on strings, in Arrow batches."""
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else one(x))

    return F.pandas_udf(run, "string")(text)


def _compatible(text: Column) -> Column:
    """Compatibility decomposition without combining marks; ASCII texts pass as they are."""
    return _mapped(lambda x: x if x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)), text)


def fold(text: Column) -> Column:
    """Lower case without soft hyphens, the listed letters folded. All in the JVM."""
    return F.translate(F.lower(F.replace(text, F.lit("­"), F.lit(""))), FOLD_FROM, FOLD_TO)


def respell(text: Column) -> Column:
    for old, new in SPELLING:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def normalise(text: Column, decompose: bool = True) -> Column:
    """Lower case, folded letters, no accents, modern spelling. Without `decompose` only the listed letters lose accents."""
    return respell(_compatible(fold(text)) if decompose else fold(text))


def strip(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column, pronouns: list[str] | None = None) -> Column:
    """Array of word tokens; digits become one class token, pronouns another."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    known = F.array(*[F.lit(p) for p in pronouns or []]).cast("array<string>")
    return F.transform(found, lambda t: F.when(t.rlike("^[0-9]+$"), F.lit(NUMBER_TOKEN)).when(F.array_contains(known, t), F.lit(PRONOUN_TOKEN)).otherwise(t))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END), lambda s: s != "")


def words_of_line(line: Column) -> Column:
    """The parts of a line between white space of any script."""
    return F.filter(F.split(line, r"(?U)\s+"), lambda t: t != "")


def is_notation(line: Column, words: Column | None = None) -> Column:
    """Three or more words of which more than half have a digit."""
    words = words_of_line(strip(line)) if words is None else words
    return (F.size(words) >= 3) & line.rlike(r"(?U)\d") & (2 * F.size(F.filter(words, lambda t: t.rlike(r"(?U)\d"))) > F.size(words))


def expand_contractions(text: Column) -> Column:
    """Contractions in full, other characters than word characters as spaces, each word with a capital and small letters."""
    for old, new in CONTRACTIONS:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w]", " "), r"(?U)\s+", " ")
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.when(w.startswith("ß"), F.lit("Ss")).otherwise(F.upper(F.left(w, F.lit(1)))), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def is_poem(text: Column) -> Column:
    """Fewer than three of ten lines start with a small letter; so an empty text is one."""
    lines = F.split(text, "\n")
    return F.size(F.filter(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+", "").rlike(r"^\p{Ll}"))) / F.size(lines) < 0.3


def digits_to_zero(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\d+", "0")


def slug(text: Column, longest: int = 150, empty: str = "untitled") -> Column:
    """A file name: other characters than word characters and hyphens as underscores."""
    name = F.regexp_replace(F.regexp_replace(F.lower(strip(text)), r"(?U)[^\w\-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.left(name, F.lit(longest)), F.lit("")), F.lit(empty))


def unescape(text: Column) -> Column:
    """HTML entities as characters."""
    return _mapped(lambda x: html.unescape(x) if "&" in x else x, text)


#: Entities that basic_unescape() knows; `&amp;` comes last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def basic_unescape(text: Column) -> Column:
    """The commonest entities, in the JVM."""
    for old, new in ENTITIES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def decoded(text: Column, entities: tuple[tuple[str, str], ...] | None = None) -> Column:
    """Entities as characters: all that HTML has, those without a semicolon too, or only `entities`, whole and in their order, in the JVM."""
    if entities is None:
        return unescape(text)
    for old, new in entities:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _no_scripts(text: Column) -> Column:
    return F.regexp_replace(text, r"(?is)<(script|style)\b.*?</(script|style)>", "")


def html_to_text(page: Column, decode: bool = True) -> Column:
    """Scripts and styles gone, `<br>` a line, `</p>` a blank line, other tags spaces, white space squeezed."""
    text = F.regexp_replace(F.regexp_replace(_no_scripts(page), r"(?i)<br\s*/?>", "\n"), "(?i)</p>", "\n\n")
    text = F.regexp_replace(text, "(?s)<[^>]+>", " ")
    text = (unescape if decode else basic_unescape)(text)
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), " ?\n ?", "\n")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def tag_lines(block: Column, entities: tuple[tuple[str, str], ...] | None = None) -> Column:
    """Array of non-empty lines: scripts, styles and comments gone, every other tag a line end. For `entities` see decoded(); with all of them a no-break space is a space."""
    text = F.regexp_replace(F.regexp_replace(_no_scripts(block), "(?s)<!--.*?-->", ""), "(?s)<[^>]+>", "\n")
    text = decoded(text, entities)
    if entities is None:
        text = F.replace(text, F.lit(" "), F.lit(" "))
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def html_title(page: Column) -> Column:
    return strip(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_links(page: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(page, F.lit(r'(?i)href="([^"]*)"'), F.lit(1)))


def markdown_to_text(page: Column) -> Column:
    """Plain text of Markdown: no images, links as their texts, no heading marks, no rules. Error pages are empty."""
    text = F.regexp_replace(page, r"!\[[^\]]*\]\([^)]*\)", "")
    text = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"(?m)^#{1,6}\s*", ""), r"(?m)^(\*\s*\*\s*\*|-{3,}|={3,})\s*$", "")
    text = strip(F.regexp_replace(text, "\n{3,}", "\n\n"))
    return F.when(page.rlike(r"(?i)^\s*(title:\s*)?(404|error|not found)"), F.lit("")).otherwise(text)
