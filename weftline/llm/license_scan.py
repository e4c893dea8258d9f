"""License scans: Dice coefficient over word bigrams against license templates."""

from __future__ import annotations

import re
from collections import Counter
from functools import cache, reduce
from operator import and_
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Workspace
from .similar import sized_broadcast

#: Short notices by which works state a licence, with SPDX identifiers.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *((name, f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.{rest}")
      for name, what, kind, version in (("GPL-2.0", "program", "", "2"), ("GPL-3.0", "program", "", "3"), ("LGPL-2.1", "library", "Lesser ", "2.1"), ("LGPL-3.0", "library", "Lesser ", "3"), ("AGPL-3.0", "program", "Affero ", "3"))
      for rest in ("", f" This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. You should have received a copy of the GNU {kind}General Public License along with this {what}. If not, see <https://www.gnu.org/licenses/>.")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
)
#: The names by which short notices call each licence.
NAMES = (
    ("AGPL-3.0", "the GNU Affero General Public License, version 3", "the GNU AGPLv3", "the AGPL-3.0 license"),
    ("Apache-2.0", "the Apache License, Version 2.0", "the Apache 2.0 License", "Apache-2.0"),
    ("BSD-2-Clause", "the BSD 2-Clause License", "the Simplified BSD License"),
    ("BSD-3-Clause", "the BSD 3-Clause License", "the BSD License", "the New BSD License"),
    ("CC0-1.0", "CC0 1.0", "the Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    *((f"CC-{x}-4.0", f"CC {x} 4.0", f"a Creative Commons {long} 4.0 International License", f"the Creative Commons {long} 4.0 International License", f"Creative Commons {long} 4.0")
      for x, long in (("BY", "Attribution"), ("BY-NC", "Attribution-NonCommercial"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))),
    ("GPL-2.0", "the GNU General Public License, version 2", "the GNU GPLv2", "the GPL-2.0 license"),
    ("GPL-3.0", "the GNU General Public License, version 3", "the GNU GPLv3", "the GPL-3.0 license"),
    ("ISC", "the ISC License"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1", "the LGPL-2.1 license"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3", "the LGPL-3.0 license"),
    ("MIT", "the MIT License", "MIT"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0", "the MPL 2.0"),
    ("Unlicense", "the Unlicense"),
)
#: The usual short forms with each name.
FORMS = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This software is licensed under {}.", "This project is licensed under {}.")
TEMPLATES = (*NOTICES, *((f, form.format(n)) for f, *names in NAMES for n in names for form in FORMS), *((f, f"SPDX-License-Identifier: {f}") for f, *_ in NAMES))
#: Full texts, numbered behind TEMPLATES; a line doesn't hold one, so only blocks of lines meet them.
TEXTS = tuple((p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt")))
#: Dice coefficient that counts as a match, in hundredths.
MATCH = 80
#: Letters from which a word counts as rare when words are chosen that a match must have.
RARE_LENGTH = 7
#: Bytes of templates that may be broadcast; a larger set is joined by shuffle.
BROADCAST_BYTES = 4 << 20


def normalised_words(text):
    """Words of a text: A-Z lower-cased, runs of other characters than ASCII letters and digits are gaps."""
    return F.split(F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " ")), " ")


def bigrams(words):
    """Distinct word bigrams; a single word is its own bigram, no word gives none."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).when(words[0] != "", words).otherwise(F.array().cast("array<string>"))


@cache
def needles(templates=TEMPLATES, match: int = MATCH) -> list[list[str]]:
    """Groups of words; every text that matches a template has all words of at least one group.

    A match shares at least match / (200 - match) of the template's bigrams. Words are taken out, long ones first,
    which few other texts have, and of them those in most of the bigrams left. Once a template has fewer bigrams
    left than a match needs, a text without any of those words can't match it; with just as many left, it must have
    all their words.
    """
    todo: list[tuple[set, int]] = []
    for _, body in templates:
        words = [w for w in re.split("[^a-z0-9]+", body.translate(str.maketrans(UPPER, LOWER))) if w]
        if words:
            grams = set(zip(words, words[1:])) or {(words[0],)}
            todo.append((grams, -(-len(grams) * match // (200 - match))))
    groups: list[list[str]] = []
    while True:
        groups += [sorted({w for g in grams for w in g}) for grams, need in todo if len(grams) == need]
        todo = [(grams, need) for grams, need in todo if len(grams) > need]
        if not todo:
            break
        gain = Counter(w for grams, _ in todo for g in grams for w in set(g))
        best = max(gain, key=lambda w: (min(len(w), RARE_LENGTH), gain[w], w))
        groups.append([best])
        todo = [({g for g in grams if best not in g}, need) for grams, need in todo]
    # Words are looked for as parts of words: a group goes if another one is found wherever it is.
    groups = [list(g) for g in sorted({tuple(g) for g in groups}, key=lambda g: (len(g), sum(map(len, g)), g))]
    kept: list[list[str]] = []
    for group in groups:
        if not any(all(any(h in g for g in group) for h in other) for other in kept):
            kept.append(group)
    return kept


def has_any(df: DataFrame, text: str, groups: list[list[str]]) -> DataFrame:
    """Rows whose text, in lower case, has all words of one of the groups in it."""
    found = F.lit(False)
    for words in groups:
        found = found | reduce(and_, (F.contains(F.col("_low"), F.lit(w)) for w in words))
    return df.select("*", F.explode(F.array(F.lower(text))).alias("_low")).where(found).drop("_low")


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template_id, license and bigrams of (license, text) pairs; those without words are left out."""
    rows = ", ".join("({}, '{}', '{}')".format(i, *(x.replace("\\", "\\\\").replace("'", "\\'") for x in t)) for i, t in enumerate(templates))
    base = spark.sql(f"select * from values {rows} as t(template_id, license, body)" if templates else "select 0 template_id, '' license, '' body where false")
    return base.select("template_id", "license", bigrams(normalised_words(F.col("body"))).alias("template")).where("size(template) > 0")


def scan_texts(texts: DataFrame, text: str = "text", templates=TEMPLATES, match: int = MATCH) -> DataFrame:
    """Rows of `texts` that state a licence, each with its best template.

    A text and a template are compared by 2 * common / (sizes together) over distinct word bigrams; at
    100 * Dice >= `match` they match. Sizes bound the coefficient, so a template meets only texts whose number of
    bigrams it can match: the join is on that number, and a text outside every range is compared with nothing. Before
    that, texts go that have none of the words that every match must have one of. Ties go to the smaller template number.

    Adds license, template_id and dice to the row's own columns (which they replace if so named). A null text, an
    empty one or one without words matches nothing; repeated rows give repeated results.
    """
    if not 0 < match <= 100:
        raise ValueError("match must be in 1..100")
    spark = texts.sparkSession
    table = template_table(spark, templates)
    # n_text lies in [m * t / (2 - t), m * (2 - t) / t] for m template bigrams.
    table = table.withColumn("n", F.explode(F.expr(f"sequence(cast(ceil(size(template) * {match} / {200 - match}) as int), cast(floor(size(template) * {200 - match} / {match}) as int))")))
    if sum(len(b) for _, b in templates) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    keep = [c for c in texts.columns if c not in ("license", "template_id", "dice")]
    # Generators of one row each: the optimizer would copy plain expressions into every filter above them.
    words = has_any(texts.select(*keep, *([] if text in keep else [text])), text, needles(templates, match)).select(*[F.col(c) for c in keep], F.explode(F.array(normalised_words(F.col(text)))).alias("_words")).where(F.col("_words").isNotNull())
    grams = words.select(*keep, F.explode(F.array(bigrams(F.col("_words")))).alias("_set")).withColumn("_n", F.size("_set"))
    table = table.select(F.col("n").alias("_n"), F.col("template_id").alias("_id"), F.col("license").alias("_license"), F.col("template").alias("_template"))
    pairs = grams.select(*keep, "_set", "_n").join(table, "_n").withColumn("_common", F.size(F.array_intersect("_set", "_template"))).withColumn("_both", F.col("_n") + F.size("_template"))
    found = pairs.where(F.expr(f"200 * _common >= {match} * _both"))
    return found.select(*keep, F.struct((2 * F.col("_common") / F.col("_both")).alias("dice"), (-F.col("_id")).alias("less"), F.col("_license").alias("license")).alias("_hit"))


def best_hit(hits: DataFrame, keys: list[str]) -> DataFrame:
    return hits.groupBy(*keys).agg(F.max("_hit").alias("_hit"))


def best_hits(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The best template for each key of what scan_texts() returns."""
    return best_hit(hits, keys).select(*keys, F.col("_hit.license").alias("license"), (-F.col("_hit.less")).alias("template_id"), F.col("_hit.dice").alias("dice"))


def scan_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, match: int = MATCH, texts=TEXTS) -> DataFrame:
    """Licence statements in whole documents: every line and every block of lines is compared with every template.

    Returns doc_id, line_no (from 0), license, template_id and dice: a row for each line that matches, and one at its
    first line for each block of scan_blocks() that is a better match than all lines and other blocks that it shares
    lines with. Rows of `docs` are documents each, whether or not they share an id or a text. `texts` are templates for blocks only. Null texts have no lines.
    """
    ws = Workspace(docs.sparkSession, "license-scan")
    tagged = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    # The only scan of all texts. Equal rows are looked at once and counted.
    few = has_any(tagged, "text", needles((*templates, *texts), match)).groupBy("doc_id", "text").agg(F.count("*").alias("rows"))
    few = ws.save(few.select("doc_id", "rows", F.monotonically_increasing_id().alias("uid"), "text"))
    lines = few.select("uid", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    single = ws.save(best_hit(scan_texts(lines, "line", templates, match), ["uid", "line_no"]))
    blocks = scan_blocks(few.select("uid", "text"), (*templates, *texts), match, ws)
    x = lambda df, last, whole: df.select("uid", F.struct(F.col("_hit.dice").alias("dice"), F.lit(whole).alias("whole"), (-F.col("line_no")).alias("less"), F.col(last).alias("last"), F.col("_hit").alias("hit")).alias("x"))
    both = x(single.join(blocks.select("uid").distinct(), "uid", "left_semi"), "line_no", True).union(x(blocks, "last_line", False))
    # Sorted by their first lines, hits that share lines, if by way of others, are runs; in each the best come first, and a block stays if it shares no line with what stays already.
    order = Window.partitionBy("uid").orderBy(F.desc("x.less"), "x.last")
    begins = F.when(-F.col("x.less") > F.coalesce(F.max("x.last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)), 1).otherwise(0)
    runs = both.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pick = F.expr("aggregate(array_sort(collect_list(x), (a, b) -> case when a > b then -1 when a < b then 1 else 0 end), cast(array() as array<%s>), (acc, h) -> if(h.whole or not exists(acc, a -> -a.less <= h.last and -h.less <= a.last), concat(acc, array(h)), acc))" % dict(both.dtypes)["x"])
    stay = runs.groupBy("uid", "run").agg(pick.alias("xs")).select("uid", F.explode("xs").alias("x")).where("not x.whole")
    found = best_hit(single.union(stay.select("uid", (-F.col("x.less")).alias("line_no"), "x.hit")), ["uid", "line_no"])
    rows = found.join(few.select("uid", "doc_id", "rows"), "uid").select("doc_id", "line_no", "_hit", F.explode(F.expr("sequence(1, rows)")))
    return rows.select("doc_id", "line_no", F.col("_hit.license").alias("license"), (-F.col("_hit.less")).alias("template_id"), F.col("_hit.dice").alias("dice"))


def scan_blocks(docs: DataFrame, templates, match: int, ws: Workspace) -> DataFrame:
    """uid, line_no, last_line and _hit, from documents (uid, text): for each sentence the best match of a run that begins there.

    Runs are all those of consecutive sentences, whose ends are newlines and . ; : ! ? before white space: wrapped notices,
    paragraphs, whole texts, a notice inside a line. A run that matches has a template's bigram in its first sentence
    if it is the best one, as it would be better without that sentence else; so runs begin only there. Documents that have fewer
    of a template's bigrams than a match needs aren't looked at further.

    A run with more distinct bigrams than the size bound allows can't match, and one that has all of the template's bigrams that follow its start gets no better by going on.
    So each start is looked at over twice the bound's number of words, and only where neither has come true over eight times more, and so on.
    """
    table = template_table(docs.sparkSession, templates).select("template_id", "license", F.size("template").alias("m"), F.transform("template", lambda g: F.xxhash64(g)).alias("grams"))
    table = ws.save(table.withColumn("need", F.expr(f"cast(ceil(m * {match} / {200 - match}) as int)")).withColumn("most", F.expr(f"cast(floor(m * {200 - match} / {match}) as int)")))
    hint = F.broadcast if sum(len(b) for _, b in templates) <= BROADCAST_BYTES else lambda df: df
    marks = table.select("template_id", F.explode("grams").alias("gram"))
    grams = _document_bigrams(docs)
    pairs = grams.select("uid", "gram").join(hint(marks), "gram").groupBy("uid", "template_id").agg(F.count_distinct("gram").alias("c"))
    pairs = ws.save(pairs.join(hint(table.select("template_id", "need", "most", "m", "license")), "template_id").where("c >= need").drop("c"))
    # Words of a document are dealt to stretches of 2 ** bits, twice the bound of its longest template.
    wanted = ws.save(pairs.groupBy("uid").agg(F.ceil(F.log2(2 * F.max("most") + 2)).cast("int").alias("bits")))
    own = Window.partitionBy("uid", "gram")
    found = _document_bigrams(docs.join(sized_broadcast(wanted.select("uid")), "uid", "left_semi"))
    found = ws.save(found.withColumn("prev", F.coalesce(F.lag("p").over(own.orderBy("p")), F.lit(-1))).withColumn("ends", F.lead("p").over(own.orderBy("p")).isNull()))
    # h: how many of the template's bigrams occur from a sentence on.
    # Joins of documents' own rows are by shuffle at every size, so that a small table's figures tell those of a large one.
    hits = found.join(hint(marks), "gram").join(pairs.hint("merge"), ["uid", "template_id"])
    starts = hits.groupBy("uid", "template_id", "license", "m", "need", "most", "unit", F.col("line").alias("line_no"), "first").agg(F.count_if("ends").alias("h")).join(sized_broadcast(wanted), "uid")
    after = Window.partitionBy("uid", "template_id").orderBy(F.desc("unit"))
    starts = ws.save(starts.withColumn("h", F.sum("h").over(after)).where("h >= need").drop("need"))
    length = found.groupBy("uid").agg(F.max("p").alias("end"))
    known = hint(marks.select("gram", "template_id", F.lit(1).alias("is")))
    run = ["uid", "template_id", "license", "m", "most", "h", "bits", "unit", "line_no", "first"]
    best, wider = None, 0
    while True:
        # A start meets the words of its stretch and of the next one, as far as a stretch's length behind it.
        # Later rounds read the documents of the starts that are left.
        placed = found.join(sized_broadcast(starts.select("uid").distinct()), "uid", "left_semi") if wider else found
        placed = placed.join(sized_broadcast(wanted.withColumn("bits", F.least(F.col("bits") + wider, F.lit(40)))), "uid")
        placed = placed.select("uid", F.expr("shiftright(cast(p as bigint), bits)").alias("stretch"), "p", "prev", "gram", "end_unit", "end_line")
        met = starts.withColumn("stretch", F.explode(F.expr("array(shiftright(cast(first as bigint), bits), shiftright(cast(first as bigint), bits) + 1)"))).join(placed.hint("merge"), ["uid", "stretch"])
        inside = met.where((F.col("p") >= F.col("first")) & (F.col("p") < F.col("first") + F.expr("shiftleft(1L, bits)")) & (F.col("prev") < F.col("first")))
        ends = inside.join(known, ["gram", "template_id"], "left").groupBy(*run, "end_unit").agg(F.min("end_line").alias("end_line"), F.count("*").alias("n"), F.count("is").alias("c"))
        up_to = Window.partitionBy("uid", "template_id", "unit").orderBy("end_unit")
        ends = ends.withColumn("n", F.sum("n").over(up_to)).withColumn("c", F.sum("c").over(up_to))
        hit = F.struct((2 * F.col("c") / (F.col("n") + F.col("m"))).alias("dice"), (-F.col("template_id")).alias("less"), F.col("license"))
        good = F.expr(f"200 * c >= {match} * (n + m)")
        reached = ends.groupBy(*run).agg(F.max(F.when(good, F.struct(hit.alias("_hit"), (-F.col("end_line")).alias("less_line")))).alias("b"), F.max("n").alias("n"), F.max("c").alias("c"))
        reached = ws.save(reached)
        some = reached.where("b is not null").select("uid", "unit", "line_no", "b")
        best = some if best is None else best.union(some)
        starts = reached.where("n <= most and c < h").join(length, "uid").where("first + shiftleft(1L, bits) <= end").select(*run).withColumn("bits", F.least(F.col("bits") + 3, F.lit(40)))
        wider += 3
        if starts.isEmpty():
            break
        starts = ws.save(starts)
    out = best.groupBy("uid", "unit", "line_no").agg(F.max("b").alias("b"))
    return ws.save(out.select("uid", "line_no", (-F.col("b.less_line")).alias("last_line"), "b._hit"))


def _document_bigrams(docs: DataFrame) -> DataFrame:
    """A row for each two words in a row of (uid, text): position p, 64-bit hash gram, unit, line and first position of the first word's sentence, end_unit and end_line of the second word's."""
    units = F.expr(r"flatten(transform(split(text, '\n'), (x, i) -> transform(split(x, '(?<=[.;:!?])\\s+'), y -> struct(i as line, y as body))))")
    word = lambda u, k: F.transform(F.filter(normalised_words(u["body"]), lambda w: w != ""), lambda w, i: F.struct(w.alias("w"), i.alias("i"), k.alias("unit"), u["line"].alias("line")))
    words = docs.select("uid", F.explode(F.array(units)).alias("u")).select("uid", F.explode(F.array(F.flatten(F.transform("u", word)))).alias("u")).where("size(u) > 1")
    two = F.zip_with(F.slice("u", 1, F.size("u") - 1), F.slice("u", 2, F.size("u") - 1), lambda a, b: F.struct(
        F.xxhash64(F.concat(a["w"], F.lit(" "), b["w"])).alias("gram"), a["unit"].alias("unit"), a["line"].alias("line"), a["i"].alias("i"), b["unit"].alias("end_unit"), b["line"].alias("end_line")))
    rows = words.select("uid", F.posexplode(two).alias("p", "g"))
    return rows.select("uid", "p", "g.gram", "g.unit", "g.line", (F.col("p") - F.col("g.i")).alias("first"), "g.end_unit", "g.end_line")
