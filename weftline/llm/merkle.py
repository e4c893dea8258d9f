"""Merkle manifest of a dataset: a tree of hashes for each language and one over their roots, with a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace
from .similar import sized_broadcast

#: Levels of a tree that one group of nodes covers: 2 ** LEVELS nodes with their ancestors are what a task holds at once.
LEVELS = 12
#: Rows of one range of leaves, about.
RANGE_ROWS = 1 << 17
#: Characters of a digest, and so of a child's slot in its parent's preimage.
SLOT = 64
#: Fixed value: the columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the number of its UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: dict[str, Column]) -> Column:
    """SHA-256 in lower-case hex of a row's fields. All in the JVM, so texts never leave it."""
    return F.sha2(F.concat(*[field(values[c]) for c in FIELDS]), 256)


def one_more_character(values: dict[str, Column]) -> tuple[Column, dict[str, Column]]:
    """Which rows are tampered with, and their columns afterwards: n_chars plus 1 where 7 divides the CRC-32 of the decimal doc_id."""
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    return F.crc32(F.encode(values["doc_id"].cast("string"), "UTF-8")) % 7 == 0, values | {"n_chars": more}


# A tree's nodes at a tier stand for 2 ** LEVELS nodes each of the tier below. A block is that many consecutive nodes.

def preimages(nodes: list[str], most: int | None) -> list[str]:
    """For each level above `nodes`, the concatenated child hashes of all its parents: parent i's preimage is slots 2i and 2i + 1.

    Goes up `most` levels (a lone node of the last run is hashed again), or with None until one node remains.
    """
    out = []
    while len(nodes) > 1 if most is None else len(out) < most:
        out.append("".join(nodes))
        nodes = [h("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]
    return out


def top_of(levels: list[str]) -> str:
    """The node above the last level's one run."""
    return h(levels[-1])


def ancestry(levels: list[str], at: int) -> list[str]:
    """Preimages of the ancestors of node `at` of a block, from the lowest."""
    return [level[2 * SLOT * (at >> i + 1):2 * SLOT * ((at >> i + 1) + 1)] for i, level in enumerate(levels)]


def siblings(ancestors: list[str], at: int) -> list[str]:
    """What is left of each ancestor's preimage without the slot that leads to node `at`."""
    out = []
    for i, preimage in enumerate(ancestors):
        own = SLOT * (at >> i & 1)
        out.append(preimage[:own] + preimage[own + SLOT:])
    return out


def fold(node: str, ancestors: list[str], at: int) -> str:
    """The node above the ancestors, once `node` is spliced into the lowest preimage and each result into the next."""
    for i, preimage in enumerate(ancestors):
        own = SLOT * (at >> i & 1)
        node = h(preimage[:own] + node + preimage[own + SLOT:])
    return node


@dataclass(frozen=True)
class Forest:
    """Trees over (tree, pos, n, node): by tier, the nodes and a table of preimages of each block; tops has (tree, top)."""

    nodes: list[DataFrame]
    blocks: list[DataFrame]
    tops: DataFrame


_BLOCK = "tree string, block long, n long, top string, levels array<string>"


def grow(ws: Workspace, nodes: DataFrame, levels: int = LEVELS) -> Forest:
    """Builds all trees of `nodes` (tree, pos from 0, n nodes of the tree, node) tier by tier, until every tree has one node."""
    width = 1 << levels

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table["n"][0].as_py()
        found = preimages(table["node"].to_pylist(), levels if n > width else None)
        top = top_of(found) if found else table["node"][0].as_py()
        return pa.table({"tree": table["tree"][:1], "block": table["block"][:1], "n": table["n"][:1], "top": [top], "levels": pa.array([found], pa.list_(pa.string()))})

    tiers, blocks, tops = [], [], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        tiers.append(nodes)
        made = ws.save(nodes.select("tree", F.shiftright("pos", levels).alias("block"), "pos", "n", "node").groupBy("tree", "block").applyInArrow(build, _BLOCK))
        blocks.append(made)
        tops.append(made.where(f"n <= {width}").select("tree", "top"))
        if most <= width:
            break
        most = -(-most // width)
        nodes = made.where(f"n > {width}").select("tree", F.col("block").alias("pos"), F.expr(f"(n + {width - 1}) div {width}").alias("n"), F.col("top").alias("node"))
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return Forest(tiers, blocks, out)


def climb(forest: Forest, tier: int, above: DataFrame, levels: int, finish: Callable[[dict, list[str], list[str]], dict], fields: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Joins the nodes of a tier with their block's preimages and what lies above the block: rows of `finish`.

    `above` has (tree, block, up_pos array<long>, up array<array<string>>): the place and the preimages of each stretch of ancestors above the block.
    finish gets a node's row, its stretches (place, ancestors) from the lowest, and the memo of its block.
    """
    nodes = forest.nodes[tier].withColumn("block", F.shiftright("pos", levels))
    width = 1 << levels
    known = forest.blocks[tier].join(above, ["tree", "block"]).select("tree", "block", "levels", "up_pos", "up")

    def run(own: pa.Table, blocks: pa.Table) -> pa.Table:
        row = blocks.slice(0, 1).to_pylist()[0]
        upper = list(zip(row["up_pos"], row["up"], strict=True))
        memo: dict = {}
        rows = []
        for node in own.to_pylist():
            at = node["pos"] % width
            rows.append(finish(node, [(at, ancestry(row["levels"], at)), *upper], memo))
        return pa.Table.from_pylist(rows, schema)

    schema = pa.schema([pa.field(*x) for x in _arrow_fields(fields)])
    keep = ["tree", "block", "pos", "node", *carry]
    return nodes.select(*keep).groupBy("tree", "block").cogroup(known.groupBy("tree", "block")).applyInArrow(run, fields)


def _arrow_fields(fields: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
    return [(name, kinds[kind]) for name, kind in (f.split(" ") for f in fields.split(", "))]


def paths(ws: Workspace, forest: Forest, top: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, block, up_pos, up) for the blocks of the lowest tier: what lies above each, as climb() takes it.

    `top` has (tree, up_pos, up): what lies above the root of each tree.
    """
    width = 1 << levels
    whole = lambda tier: forest.blocks[tier].where(f"n <= {width}").select("tree", "block").join(top, "tree")
    above = whole(-1)
    for tier in range(len(forest.nodes) - 1, 0, -1):
        lift = lambda node, stretches, memo: {"tree": node["tree"], "block": node["pos"], "up_pos": [p for p, _ in stretches], "up": [a for _, a in stretches]}
        above = ws.save(climb(forest, tier, above, levels, lift, "tree string, block long, up_pos array<long>, up array<array<string>>").union(whole(tier - 1)))
    return above


def numbered(ws: Workspace, rows: DataFrame, tree: str, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds pos (from 0, in the given order within each tree) and n (rows of the tree) to `rows`, a saved table.

    Rows are dealt to ranges of the whole order, so a tree that has most rows, or an id that most rows repeat, still fills many tasks; `order` must tell
    apart all rows. Each task numbers its rows by tree, and a table of counts by range and tree gives what lies before.
    """
    ranges = max(1, -(-rows.count() // range_rows))
    names = rows.columns

    def count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            pos = []
            for t in batch.column(names.index(tree)).to_pylist():
                seen = seen + 1 if t == last else 0
                last = t
                pos.append(seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(pos), pa.int64()), pa.array(pos, pa.int64())], [*names, "part", "inside"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", part long, inside long"
    by = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    placed = ws.save(rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).mapInArrow(count_up, schema))
    # A range holds a stretch of a tree, or several trees: a tree has a row of counts for each of its ranges.
    counts = placed.groupBy(F.col(tree).alias("_tree"), F.col("part").alias("_part")).agg(F.count("*").alias("c"))
    own = Window.partitionBy("_tree")
    before = ws.save(counts.select("_tree", "_part", (F.sum("c").over(own.orderBy("_part")) - F.col("c")).alias("below"), F.sum("c").over(own).alias("n")))
    joined = placed.join(sized_broadcast(before), (F.col(tree) == F.col("_tree")) & (F.col("part") == F.col("_part")))
    return joined.select(*names, (F.col("inside") + F.col("below")).alias("pos"), "n")


def manifest(docs: DataFrame, tamper: Callable[[dict[str, Column]], tuple[Column, dict[str, Column]]] | None = None, levels: int = LEVELS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """A leaf, its place in the trees, and a proof for every row of `docs` (FIELDS).

    A leaf is the SHA-256 of the row's fields. Leaves of a language in the order of doc_id make a binary tree whose nodes are hashes of their
    children's digests; the trees' tops, in the order of languages (null first, then by bytes), make one more. Returns doc_id, leaf, altered
    (the leaf of the row as `tamper` changes it, else null), subroot, root, siblings (array: from the lowest level up, what each ancestor's
    preimage holds besides the way to this leaf, empty for a lone child) and folded_root (from the altered leaf if there is one, else the leaf).

    `tamper` maps the columns to a condition and changed columns. Leaves of equal ids are ordered by their hash; rows alike in all fields are leaves each
    and interchangeable; a null id comes first. A null language is a tree of its own, other than ''. One row alone is leaf, subroot and root.
    An empty table has no rows and no root; other columns are ignored.

    Ancestors are stored as preimages, in a row for each block of 2 ** `levels` nodes; a leaf meets its block's row and, with it, that of each tier above.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "merkle")
    values = {c: F.col(c) for c in FIELDS}
    which, changed = tamper(values) if tamper else (F.lit(False), values)
    tree = F.coalesce(F.concat(F.lit("s"), F.col("lang").cast("string")), F.lit("")).alias("tree")
    rows = ws.save(docs.select("doc_id", tree, leaf_of(values).alias("node"), F.when(which, leaf_of(changed)).alias("altered"), F.monotonically_increasing_id().alias("uid")))
    leaves = numbered(ws, rows, "tree", ["doc_id", "node", "uid"], range_rows).drop("uid")
    trees = grow(ws, leaves, levels)
    tops = numbered(ws, ws.save(trees.tops.select(F.lit("").alias("tree"), F.col("tree").alias("own"), F.col("top").alias("node"))), "tree", ["own"], range_rows)
    over = grow(ws, tops, levels)
    found = over.tops.first()
    root = found["top"] if found else ""
    none = F.array().cast("array<long>"), F.array().cast("array<array<string>>")
    above = paths(ws, over, over.tops.select("tree", none[0].alias("up_pos"), none[1].alias("up")), levels)
    lift = lambda node, stretches, memo: {"tree": node["own"], "up_pos": [p for p, _ in stretches], "up": [a for _, a in stretches]}
    above = paths(ws, trees, ws.save(climb(over, 0, above, levels, lift, "tree string, up_pos array<long>, up array<array<string>>", ("own",))), levels)
    tiers_over = len(over.nodes)

    def prove(node: dict, stretches: list[tuple[int, list[str]]], memo: dict) -> dict:
        (at, lowest), *upper = stretches
        if "siblings" not in memo:  # what lies above a block is the same for all its leaves
            place, first = upper[-tiers_over]
            memo["siblings"] = [s for p, a in upper for s in siblings(a, p)]
            memo["subroot"] = first[0][SLOT * (place & 1):][:SLOT] if first else root
        top = fold(node["altered"] or node["node"], lowest, at)
        if top not in memo:
            x = top
            for p, a in upper:
                x = fold(x, a, p)
            memo[top] = x
        return {"doc_id": node["doc_id"], "leaf": node["node"], "altered": node["altered"], "subroot": memo["subroot"], "root": root, "siblings": siblings(lowest, at) + memo["siblings"], "folded_root": memo[top]}

    fields = f"doc_id {dict(docs.dtypes)['doc_id']}, leaf string, altered string, subroot string, root string, siblings array<string>, folded_root string"
    return climb(trees, 0, above, levels, prove, fields, ("doc_id", "altered"))
