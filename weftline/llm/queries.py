"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, filter_audit, knn, language_id, license_scan, line_dedup, merkle, near_dup, packing, sharding, toxicity, url_filter

#: The rules of op6_url_filter.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document against every license template."""
    return license_scan.scan_lines(_read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the URL of every page."""
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rules = spark.sql(f"select * from values {rows} as t(host, path, verdict)")
    return url_filter.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and place in it."""
    return sharding.interleave(_read(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    return knn.top_k(_read(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document that stay when alike lines are kept once."""
    return line_dedup.keep_lines(_read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = _read(spark, sf_dir, "documents")
    return language_id.identify(docs, *language_id.fit(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", toxicity.held_out(F.col("doc_id")).alias("held_out"))
    return toxicity.score_texts(rows, model, carry=("doc_id", "held_out"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest("item_ids").alias("items_sha256"), "contaminated")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five text filters remove in every order, for each language."""
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and the root that a tampered row leads to."""
    proofs = merkle.manifest(_read(spark, sf_dir, "documents"), merkle.one_more_character)
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The conversation that op13_chat_format adds.
CONTROL_TURNS = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as training windows, and what a reader gets back from those."""
    rows = ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in CONTROL_TURNS)
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(spark.sql(f"select * from values {rows} as t(conv_id, turn, role, text)"))
    return chat.read_back(chat.format_windows(turns, tokenizer_path()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_minhash_dedup, op3_packing, op4_topk_search, op5_line_dedup, op6_url_filter, op7_sharding, op8_language_id, op9_decontamination, op10_toxicity, op11_filter_audit, op12_merkle_manifest, op13_chat_format)}


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORM = "trim(regexp_replace(" + _LOWER + ", '[^a-z0-9]+', ' ', 'g'))"
_GRAMS = "case when w is null or w = '' then [] when strpos(w, ' ') = 0 then [w] else list_distinct(list_transform(range(1, len(string_split(w, ' '))), lambda i: string_split(w, ' ')[i] || ' ' || string_split(w, ' ')[i + 1])) end"

_OP1_SQL = f"""
with t as (
  select template_id, license, {_GRAMS} as g
  from (select template_id, license, {_NORM.format("body")} as w from (values {", ".join(f"({i}, {_sql_text(n)}, {_sql_text(b)})" for i, (n, b) in enumerate(license_scan.TEMPLATES))}) v(template_id, license, body))
), l as (
  select uid, doc_id, line_no, {_GRAMS} as g
  from (select uid, doc_id, line_no, {_NORM.format("line")} as w from (select row_number() over () as uid, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null))
), p as (
  select uid, doc_id, line_no, license, template_id, 2 * len(list_intersect(l.g, t.g))::double / (len(l.g) + len(t.g)) as dice, 200 * len(list_intersect(l.g, t.g)) >= {license_scan.MATCH} * (len(l.g) + len(t.g)) as hit
  from l join t on 2 * least(len(l.g), len(t.g)) * 100 >= {license_scan.MATCH} * (len(l.g) + len(t.g))
)
select doc_id, line_no::int as line_no, license, template_id::int as template_id, dice from p where hit
qualify row_number() over (partition by uid, line_no order by dice desc, template_id) = 1
"""

_OP6_SQL = f"""
with r as (select * from (values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}) v(rh, rp, rv)),
u as (
  select page_id, row_number() over () as uid, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages)
)
select page_id, host, path, rh || rp as rule, coalesce(rv, 'allow') as verdict
from u left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
qualify row_number() over (partition by uid order by length(rh) desc, length(rp) desc, rv desc) = 1
"""

_OP9_SQL = f"""
with d as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), b as (
  select item_id, w, least(10, len(w)) as k from (
    select item_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where text is not null and item_id is not null)
  where len(w) > 0
), bw as (
  select distinct item_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') as s from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as p from b)
), dw as (
  select doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') as s
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from b) where len(w) >= k)
), h as (select doc_id, p, k, item_id from dw join bw using (k, s)),
n as (select doc_id, count(distinct i) as n_hit from (select doc_id, unnest(range(p, p + k)) as i from h) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from h) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join n using (doc_id) left join i using (doc_id)
"""

_OP2_SQL = f"""
with recursive w as (
  select doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from w
), e as (select doc_id, len(s) as n, unnest(s) as g from s),
l as (
  select x.doc_id as a, y.doc_id as b from e x join e y on x.g = y.g and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))
), r(doc_id, other) as (
  select doc_id, doc_id from documents union select r.doc_id, l.b from r join l on r.other = l.a
), m as (select doc_id, min(other) as component_id from r group by doc_id)
select s.doc_id, len(s.s) as n_shingles, component_id, s.doc_id = component_id as kept from s join m using (doc_id)
"""

_OP4_SQL = """
with v as (
  select row_number() over () as uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.uid as asked, c.uid, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.uid <> c.uid
)
select query_id, row_number() over (partition by asked order by score desc, vec_id, uid)::int as rank, vec_id, score from s
qualify row_number() over (partition by asked order by score desc, vec_id, uid) <= 5
"""

_OP11_SQL = """
with t as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), l as (
  select doc_id, max((quality is not distinct from 1)::int) as good, max((toxic is not distinct from 1)::int) as toxic from labels where doc_id is not null group by doc_id
), c as (select text, min(doc_id) as first from t group by text),
f as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
     'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} as x
  from t join c using (text) left join l using (doc_id)
), cells as (select part, good, toxic, x, count(*) as n from f group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order from letters a join letters b on b.l <> a.l join letters c on c.l not in (a.l, b.l) join letters d on d.l not in (a.l, b.l, c.l) join letters e on e.l not in (a.l, b.l, c.l, d.l)
), steps as (select filter_order, step, filter_order[step] as letter, filter_order[1:step - 1] as before from orders, range(1, 6) r(step)),
fails as (select part, good, toxic, n, array_to_string(list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: case k when 'A' then x.A when 'B' then x.B when 'C' then x.C when 'D' then x.D else x.E end), '') as failed from cells),
m as (
  select part, filter_order, step, letter, n, good, toxic, failed, contains(failed, letter) as own, regexp_matches(failed, '[' || before || '_]') as gone, regexp_matches(failed, '[' || before || letter || ']') as hit from fails, steps
), r as (
  select part, filter_order, step, letter, coalesce(sum(n) filter (not hit), 0)::bigint as kept, coalesce(sum(n) filter (own and not gone), 0)::bigint as removed, coalesce(sum(n) filter (own and gone), 0)::bigint as redundant,
    coalesce(sum(n) filter (failed = letter), 0)::bigint as unique_fails, coalesce(sum(n) filter (own and not gone and good = 1), 0)::bigint as good_lost, coalesce(sum(n) filter (own and not gone and toxic = 1), 0)::bigint as toxic_lost
  from m group by part, filter_order, step, letter
)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from r
"""

_FIELD = "case when {0} is null then '-' else strlen({1}) || ':' || {1} end"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c, f"({v})::varchar") for c, v in (("doc_id", "doc_id"), ("source", "source"), ("lang", "lang"), ("n_chars", "n_chars + {0}"), ("text", "text"))) + ")"
_TREE = """{0}(tree, level, idx, n, node) as (
  select tree, 0, pos, n, node from {1}
  union all
  select tree, any_value(level) + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(node, '' order by idx)) from {0} where n > 1 group by tree, idx // 2
)"""
_FOLD = """{0}(uid, tree, level, idx, node) as (
  select uid, tree, 0, pos, node from {1}
  union all
  select f.uid, f.tree, f.level + 1, f.idx // 2, sha256(case when f.idx % 2 = 1 then s.node || f.node else f.node || coalesce(s.node, '') end)
  from {0} f join (select distinct tree, level, n from {2}) l on l.tree = f.tree and l.level = f.level and l.n > 1
    left join {2} s on s.tree = f.tree and s.level = f.level and s.idx = xor(f.idx, 1)
)"""
#: crc32 of the decimal id, which DuckDB lacks: bit by bit over the digits' bytes.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::ubigint)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda k: 0::ubigint)), lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384::ubigint) else x // 2 end)), 4294967295::ubigint)"""
_OP12_SQL = f"""
with recursive d as (
  select row_number() over () as uid, doc_id, coalesce('s' || lang, '') as tree, {_LEAF.format(0)} as node, case when {_CRC32} % 7 = 0 and n_chars is not null then {_LEAF.format(1)} end as altered from documents
), a as (select *, row_number() over (partition by tree order by doc_id nulls first, node) - 1 as pos, count(*) over (partition by tree) as n from d),
{_TREE.format("t", "a")},
sub as (select tree as own, node, 'all' as tree, row_number() over (order by tree) - 1 as pos, count(*) over () as n from t where n = 1),
{_TREE.format("u", "sub")},
root as (select node as root from u where n = 1),
low as (select a.uid, t.level, t.node from a join t on t.tree = a.tree and t.idx = xor(a.pos >> t.level, 1)),
up as (select s.own, u.level, u.node from sub s join u on u.idx = xor(s.pos >> u.level, 1)),
proof as (select uid, string_agg(node, '' order by tier, level) as p from (select uid, 0 as tier, level, node from low union all select uid, 1, level, up.node from up join a on a.tree = up.own) group by uid),
begun as (select uid, tree, pos, coalesce(altered, node) as node from a),
{_FOLD.format("f", "begun", "t")},
half as (select uid, 'all' as tree, s.pos, arg_max(f.node, f.level) as node from f join sub s on s.own = f.tree group by uid, s.pos),
{_FOLD.format("g", "half", "u")},
folded as (select uid, arg_max(node, level) as folded_root from g group by uid)
select doc_id, a.node as leaf, s.node as subroot, root, sha256(coalesce(p, '')) as proof_sha256, folded_root, folded_root = root as verified
from a join sub s on s.own = a.tree join folded using (uid) left join proof using (uid) cross join root
"""

ORACLE_SQL: dict[str, str] = {"op12_merkle_manifest": _OP12_SQL, "op11_filter_audit": _OP11_SQL, "op2_minhash_dedup": _OP2_SQL, "op4_topk_search": _OP4_SQL, "op9_decontamination": _OP9_SQL, "op1_license_scan": _OP1_SQL, "op6_url_filter": _OP6_SQL}
