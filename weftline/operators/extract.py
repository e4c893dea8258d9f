"""Layered extraction: layouts of pages and rules on their lines, as data, and the fold that applies them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Rule:
    """Where a text's lines begin or end.

    after last: behind the last line among the first `zone` that matches. after first: behind the first such line. drop while: behind the leading lines
    that match. from first: at the first line that matches. until: the text ends before that line. None of them cuts where no line matches; `needed` then
    leaves no line, and `short` leaves none if there are fewer lines than the zone. `title`: lines equal to the title match too. `then` is applied to what is left if a line
    matched, unless that line matches `unless` as well.
    """

    kind: str
    pattern: str
    zone: int | None = None
    title: bool = False
    needed: bool = False
    short: bool = False
    then: Rule | None = None
    unless: str | None = None


@dataclass(frozen=True)
class Layout:
    """A page's content: from behind `start` to `end` (else to the end), cut at each literal of `cuts`, then lines by `rules`.

    `title` is None for the page's own title, "" for the first line, else a pattern whose group is it. `category` is (kind, pattern): "next line" is the line behind the last
    match before the body, "lines before" those between the first line and the match.
    """

    name: str
    start: str
    end: str | None = None
    cuts: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    title: str | None = None
    category: tuple[str, str] | None = None


# The sites' markers, furniture and zones.
FURNITURE = r"^(Citra|Judul|Sambungan|Pencarian Teks|Lingkup pencarian|Teks pencarian|Filter pencarian)$|^: |^Terakhir diubah"
_LIBRARY_HEAD = (Rule("after last", "Kategori:", 400), Rule("drop while", FURNITURE, title=True), Rule("after first", "variasi ejaan", 30), Rule("drop while", r"^\.$|^\[dj"))
LIBRARY = (
    Layout("article body", r"com-content-article__body[^>]*>", None, ("</main>", "<footer", "com-content-article__navigation", '<div class="ysl-foottxt'), _LIBRARY_HEAD),
    Layout("article element", r'<article class="uk-article"[^>]*>', "</article>", (), _LIBRARY_HEAD),
    Layout("old columns", r'<div id="ja-content">', '<div id="ja-col1">', (), (Rule("from first", r"^---\s*.+?\s*---$"),)),
)
LIBRARY_TITLE = r"^Sastra Jawa\s*-\s*|\s*-\s*Sastra Jawa$"
_POSTED = r"^-?\s*Posted by\b| - Posted by"
PERIODICAL = (
    Layout(
        "blog post", r'<div class="single_post">', None, ("This Post Tagged with", "Berita lain yang terkait", '<div id="sidebar"', "<ul class='postnav'"),
        (Rule("after first", "", 1), Rule("after first", _POSTED, 11, then=Rule("after first", r"^on .*\d{4}$", 4, short=True), unless=r"Posted by.*\d{4}")), "", ("lines before", _POSTED),
    ),
    Layout(
        "article page", r"<div class='left_bar' id='detail_bar2'>", '<div id="katonkanan"', (),
        (Rule("after first", r"(^| )kali$", needed=True), Rule("until", "^(Berita Liyane|Komentar|Tulis Komentar)")), r"<i class='judul_berita'>(.*?)<", ("next line", "^Kategori"),
    ),
)
PORTAL = (Layout("item page", r'<div[^>]*class="[^"]*item-page[^"]*"[^>]*>', None, ('<div id="ja-col1"', '<div class="pagination', '<ul class="pagenav')), Layout("whole page", "^"))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator of one row: the optimizer would copy plain expressions into every place that reads them."""
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.explode(F.array(packed)).alias("_once")).select(*kept, *[F.col(f"_once.{n}").alias(n) for n in columns])


def cut_at(lines: Column, rule: Rule, title: Column) -> Column:
    """The number of lines before the cut of a rule ("until": of lines kept), or null if none matches: a fold over the lines whose state is a place, the cut so far and whether it is open."""
    hit = lambda x: F.coalesce(x.rlike(rule.pattern) | (x == title) if rule.title else x.rlike(rule.pattern), F.lit(False))
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("i"), (F.lit(0) if rule.kind == "drop while" else none).alias("cut"), F.lit(True).alias("open"))

    def step(s: Column, x: Column) -> Column:
        i, cut, still = s["i"], s["cut"], s["open"]
        found = still & (i < rule.zone if rule.zone is not None else F.lit(True)) & hit(x)
        at = i if rule.kind in ("from first", "until") else i + 1
        goes_on = still if rule.kind == "after last" else found if rule.kind == "drop while" else still & ~found
        return F.struct((i + 1).alias("i"), F.when(found, at).otherwise(cut).alias("cut"), goes_on.alias("open"))

    return F.aggregate(lines, start, step, lambda s: s["cut"])


def _apply(rows: DataFrame, rule: Rule, when: Column) -> DataFrame:
    """_lines after a rule, in rows of a layout."""
    rows = _once(rows, _cut=F.when(when, cut_at(F.col("_lines"), rule, F.col("title"))))
    n = F.size("_lines")
    kept = F.slice("_lines", 1, F.col("_cut")) if rule.kind == "until" else F.slice("_lines", F.col("_cut") + 1, F.greatest(n - F.col("_cut"), F.lit(0)))
    left = F.when(F.lit(rule.needed) | (F.lit(rule.short) & (n < (rule.zone or 0))), F.slice("_lines", 1, 0)).otherwise(F.col("_lines"))
    after = F.when(when, F.when(F.col("_cut").isNotNull(), kept).otherwise(left)).otherwise(F.col("_lines"))
    met = F.when(when & (F.col("_cut") > 0), F.try_element_at("_lines", F.col("_cut")))
    again = F.coalesce(met.isNotNull() & ~met.rlike(rule.unless or "$^"), F.lit(False))
    rows = _once(rows, _lines=after, _again=again).drop("_cut")
    return _apply(rows, rule.then, F.col("_again")).drop("_again") if rule.then else rows.drop("_again")


def _category(layout: Layout) -> Column:
    kind, pattern = layout.category
    lines = F.col("_all")
    places = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i)), lambda i: i.isNotNull())
    if kind == "next line":
        before = F.filter(places, lambda i: i < F.size(lines) - F.size("_lines"))
        return F.regexp_replace(F.coalesce(F.try_element_at(lines, F.try_element_at(before, F.lit(-1)) + 2), F.lit("")), "^[ -]+|[ -]+$", "")
    at = F.try_element_at(F.filter(places, lambda i: (i > 0) & (i < 12)), F.lit(1))
    above = F.array_join(F.filter(F.slice(lines, 2, F.greatest(F.coalesce(at, F.lit(1)) - 1, F.lit(0))), lambda x: x != ","), " ")
    own = F.regexp_replace(F.when(F.contains(F.try_element_at(lines, at + 1), F.lit("- Posted by")), F.split_part(F.try_element_at(lines, at + 1), F.lit("- Posted by"), F.lit(1))).otherwise(F.lit("")), "^[ ,]+|[ ,]+$", "")
    return F.coalesce(F.regexp_replace(F.concat_ws(" ", F.regexp_replace(above, "^[ ,]+|[ ,]+$", ""), own), "^[ ,]+|[ ,]+$", ""), F.lit(""))


def extract(pages: DataFrame, layouts: tuple[Layout, ...], page: str = "html", affixes: str | None = None, entities: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """Adds layout (the name of the first that the page has), title, category and body (lines) to the other columns of `pages`.

    Tags end lines; scripts, styles and comments go; white space is squeezed. A page without any of the layouts, or null, has null layout and body, and its own title.
    `affixes` is a pattern that goes from the page's title; `entities` are those that are decoded, all by default. Everything but entities stays in the JVM; each rule is a fold over a page's lines.
    """
    found = [F.when(F.col(page).rlike(f"(?s){x.start}"), F.struct(F.lit(i).alias("i"), F.regexp_extract(page, f"(?s){x.start}(.*)", 1).alias("block"))) for i, x in enumerate(layouts)]
    own = T.decoded(T.html_title(F.col(page)), entities)
    own = F.regexp_replace(own, affixes, "") if affixes else own
    drop = [c for c in pages.columns if c in ("layout", "title", "category", "body")]
    rows = _once(pages.drop(*drop), _found=F.coalesce(*found), title=own)
    block, i = F.col("_found.block"), F.col("_found.i")
    cut = block
    for n, x in enumerate(layouts):
        part = F.regexp_extract(block, f"(?s)^(.*?)(?:{x.end}|$)", 1) if x.end else block
        for marker in x.cuts:
            part = F.substring_index(part, marker, 1)
        cut = F.when(i == n, part).otherwise(cut)
    rows = _once(rows, _block=cut, _i=i).drop("_found")
    lines = F.transform(T.tag_lines(F.col("_block"), entities), lambda x: F.regexp_replace(x, "[ \\t]+", " "))
    rows = _once(rows, _all=lines)
    title, block = F.col("title"), F.col("_block")
    for n, x in enumerate(layouts):
        if x.title is not None:
            title = F.when(F.col("_i") == n, F.coalesce(F.try_element_at("_all", F.lit(1)), F.lit("")) if x.title == "" else T.strip(T.decoded(F.regexp_extract(block, f"(?s){x.title}", 1), entities))).otherwise(title)
    rows = _once(rows, title=title, _lines=F.col("_all")).drop("_block")
    for n, x in enumerate(layouts):
        for rule in x.rules:
            rows = _apply(rows, rule, F.col("_i") == n)
    category, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, x in enumerate(layouts):
        name = F.when(F.col("_i") == n, F.lit(x.name)).otherwise(name)
        category = F.when(F.col("_i") == n, _category(x)).otherwise(category) if x.category else category
    return rows.withColumns({"layout": name, "category": category, "body": F.when(F.col("_i").isNotNull(), F.array_join("_lines", "\n"))}).drop("_i", "_all", "_lines")
