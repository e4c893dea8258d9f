"""What near-duplicate operators share: candidates that meet in buckets, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, slices
from .components import components

#: Bytes of payloads that are decoded at once.
DECODED_BYTES = 1 << 20
#: Nodes in a block of a cluster, and elements in a dense part of their matrix.
BLOCK, COLUMNS = 512, 4096
#: Bytes of payloads that a block of a cluster holds, about.
BLOCK_BYTES = 4 << 20
#: Keys that a task holds before it sends them, and before it folds what came in. A key takes ENTRY_BYTES.
HELD_KEYS, ENTRY_BYTES = 1 << 20, 24
#: Bytes of keys that one partition of a bucket join gets, about.
PART_BYTES = 32 << 20
#: Rows of a table of a few numbers that may be broadcast; as a hashed relation they take 50 MB at most or so.
BROADCAST_ROWS = 1 << 19
#: Nodes that a task remembers, and pairs of one node that one task gets.
SEEN_NODES, HUB_PAIRS = 1 << 19, 1024
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_PAIRS = np.uint64(0x5555555555555555)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def set_digest(values: np.ndarray) -> int:
    """A signed 64-bit digest of a set of hashes, whatever their order."""
    with np.errstate(over="ignore"):
        return int(mix(values ^ GOLDEN).sum(dtype=np.uint64).astype(np.int64))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))


def sketch_of(minima: np.ndarray) -> np.ndarray:
    """Two bits of each of 32 minima (rows of small unsigned numbers), as one 64-bit number."""
    out = np.zeros(len(minima), np.uint64)
    for i in range(32):
        out |= (minima[:, i].astype(np.uint64) & np.uint64(3)) << np.uint64(2 * i)
    return out


def far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many of their 32 positions two sketches differ."""
    d = x ^ y
    return np.bitwise_count((d | (d >> np.uint64(1))) & _PAIRS)


class Members:
    """A bit map of hashes, of bounded size: what isn't in it was not among the rows it was made of.

    It saves shuffling rows that nothing asks for; an exact join follows. Beyond the bound it lets more rows pass, and with many more
    rows than bits nearly all: then each payload is shuffled once.
    """

    MOST_BITS = 1 << 26

    def __init__(self, hashes: DataFrame, name: str, n: int):
        """From one column of longs, which must be hashes, about n of them; 16 bits for each up to the bound."""
        bits = 1 << 12
        while bits < min(16 * n, self.MOST_BITS):
            bits *= 2
        at = F.col(name).bitwiseAND(F.lit(bits - 1))
        words = hashes.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).toArrow()
        self.map = np.zeros(bits // 64, np.int64)
        self.map[words.column("w").to_numpy()] = words.column("v").to_numpy()

    @staticmethod
    def test(map_: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Which of the hashes may be among the rows."""
        p = p & (len(map_) * 64 - 1)
        return (map_[p >> 6] >> (p & 63)) & 1 == 1


class Entries:
    """Keys of nodes with the nodes' sketches; of equal key and sketch the node that came first stands for all."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.folded = 0

    def add(self, key: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> None:
        self.parts.append((key, node, sketch))
        self.size += len(key)

    def fold(self, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Sorts and folds what is held; gives (a, b) for every b that a now stands for. The `last` time, keys that came once go."""
        key, node, sketch = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        order = np.argsort(key)
        key = key[order]
        again = np.zeros(len(key), bool)
        again[1:] = key[1:] == key[:-1]
        many = again.copy()
        many[:-1] |= again[1:]
        if last:
            order, key, again, many = order[many], key[many], again[many], many[many]
        at = np.flatnonzero(many)
        if len(at):
            order[at] = order[at][np.lexsort((order[at], sketch[order[at]], key[at]))]
        node, sketch = node[order], sketch[order]
        again[1:] &= sketch[1:] == sketch[:-1]
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))[again]
        pairs = node[head], node[again]
        self.parts = [(key[~again], node[~again], sketch[~again])]
        self.size = self.folded = len(self.parts[0][0])
        different = pairs[0] != pairs[1]
        return pairs[0][different], pairs[1][different]


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs, one after another."""
    return np.unique(np.stack([a, b], 1), axis=0).ravel() if len(a) else np.zeros(0, np.int64)


def sender(entries: Callable[[pa.RecordBatch, set], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: rows (part, keys, pairs) of the (keys, nodes, sketches) that `entries` makes of each batch.

    `entries` also gets a set of its task, to remember in it what it has sent.
    A row holds all keys that a task has for a part so far, as packed numbers; so the shuffle moves few rows, whatever the
    number of keys. Parts are ranges of keys.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, memo = Entries(), set()
        bounds = np.array([-(-(i << 64) // parts) for i in range(1, parts)], np.uint64)

        def send() -> pa.RecordBatch:
            nonlocal held
            pairs = _distinct(*held.fold())
            key, node, sketch = held.parts[0]
            cut = np.concatenate([[0], np.searchsorted(key, bounds), [len(key)]])
            full = np.flatnonzero(cut[1:] > cut[:-1])
            blobs = [key[lo:hi].tobytes() + node[lo:hi].tobytes() + sketch[lo:hi].tobytes() for lo, hi in zip(cut[full].tolist(), cut[full + 1].tolist(), strict=True)]
            held = Entries()
            same = [None] * len(full)
            if len(pairs):
                full, blobs, same = np.append(full, int(pairs[0]) % parts), [*blobs, None], [*same, pairs.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(same, pa.binary())], ["part", "keys", "pairs"])

        for batch in batches:
            for key, node, sketch in entries(batch, memo):
                held.add(key, node, sketch)
                if held.size >= HELD_KEYS:
                    yield send()
        if held.size:
            yield send()

    return run


def _groups(sketch: np.ndarray, limit: int) -> np.ndarray:
    """Number of the group of each sketch: groups are joined by steps between sketches within the limit; a group's number is its first member's."""
    group = np.arange(len(sketch))
    left = np.arange(len(sketch))
    while len(left):
        head, left = left[0], left[1:]
        waiting = [head]
        while waiting and len(left):
            near = far(sketch[left], sketch[waiting.pop()]) <= limit
            fresh = left[near]
            group[fresh] = head
            waiting += fresh.tolist()
            left = left[~near]
    return group


def bucket_groups(key: np.ndarray, node: np.ndarray, sketch: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) from entries sorted by key: in each bucket the groups of near sketches, a the smallest node of a group and b every other one."""
    again = np.zeros(len(key), bool)
    again[1:] = key[1:] == key[:-1]
    many = again.copy()
    many[:-1] |= again[1:]
    order = np.flatnonzero(many)
    order = order[np.lexsort((node[order], key[order]))]
    key, node, sketch = key[order], node[order], sketch[order]
    if not len(key):
        return node, node
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(start, len(key)))
    head = np.repeat(start, count)
    near = far(sketch, sketch[head]) <= limit
    # Buckets all of whose sketches are near the first one's are groups; in those of two that aren't, nothing met.
    mixed = np.unique(head[~near & np.repeat(count > 2, count)])
    own = np.where(near, head, np.arange(len(key)))
    for s, n in zip(mixed.tolist(), count[np.searchsorted(start, mixed)].tolist(), strict=True):
        own[s:s + n] = s + _groups(sketch[s:s + n], limit)
    b = np.flatnonzero((own != np.arange(len(key))) & (node[own] != node))
    return node[own[b]], node[b]


def meeting(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over the rows of sender(), a part of which is a partition: (a, b, folded).

    Nodes that share a key and whose sketches differ in `limit` positions at most, or are joined by such steps, give rows with the
    same a, or are folded: then a stands for b. Memory is bounded by the distinct keys and sketches of the part, however often they come.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Entries()

        def rows(flat: np.ndarray, folded: bool) -> Iterator[pa.RecordBatch]:
            pairs = flat.reshape(-1, 2)
            for i in range(0, len(pairs), 100_000):
                some = pairs[i:i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some[:, 0].copy()), pa.array(some[:, 1].copy()), pa.array(np.full(len(some), folded))], ["a", "b", "folded"])

        for batch in batches:
            for blob, pairs in zip(batch.column(1), batch.column(2), strict=True):
                if pairs.is_valid:
                    yield from rows(np.frombuffer(pairs.as_buffer(), np.int64), True)
                if blob.is_valid:
                    words = np.frombuffer(blob.as_buffer(), np.uint64)
                    n = len(words) // 3
                    held.add(words[:n], words[n:2 * n].view(np.int64), words[2 * n:])
                    if held.size >= 2 * HELD_KEYS + 2 * held.folded:
                        yield from rows(_distinct(*held.fold()), True)
        yield from rows(_distinct(*held.fold(last=True)), True)
        yield from rows(_distinct(*bucket_groups(*held.parts[0], limit)), False)

    return run


def meet(rows: DataFrame, entries: Callable, keys: int, limit: int, ws: Workspace) -> DataFrame:
    """(a, b, folded), written: nodes that share a key and have near sketches; `keys` is how many keys there are, about."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys * ENTRY_BYTES // PART_BYTES))
    sent = rows.mapInArrow(sender(entries, parts), "part int, keys binary, pairs binary")
    return ws.save(sent.repartitionById(parts, "part").mapInArrow(meeting(limit), "a long, b long, folded boolean"))


def once(found: DataFrame, n: int, ws: Workspace) -> DataFrame:
    """(node, payload), written, each node once; a node that many rows repeat should come once from each task. There are `n` nodes at most, so a task remembers SEEN_NODES of them or so."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for i, node in enumerate(batch.column(0).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    fresh.append(i)
            yield batch.take(pa.array(fresh, pa.int64()))

    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // SEEN_NODES))
    return ws.save(found.repartition(parts, "node").mapInArrow(first, "node long, payload binary"))


def link(met: DataFrame, payloads_of: Callable[[DataFrame, int], DataFrame], decode: Callable[[list[bytes]], list[np.ndarray]], least: int, ws: Workspace, pretest: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> tuple[DataFrame, DataFrame]:
    """Confirmed links between nodes that met, enough for every component, and (node, root), both written.

    met: what meet() gives. payloads_of: from nodes (node), which may repeat, and their number a written table (node, payload binary) of
    each of them, and perhaps others, once; decode: from payloads the sets, as sorted 64-bit hashes. A pair is a link if
    100 * intersection >= least * union. pretest: from pairs (a, b) those that may be links.

    The nodes that met the same a are its group. First each node meets a. Groups whose nodes are then in one component are done. In the
    others, nodes stay that share enough with any other of these nodes to have a link at all; most that no link reaches have
    too many elements of their own. Those that still meet in open groups form clusters, and in a cluster every
    node that isn't in its main component is compared with all others, block by block. No link is lost: two nodes of a
    group were compared, or were in one component already, or can't be a link.
    """
    met = ws.save(met.distinct())
    pairs = met.select("a", "b")
    payloads = payloads_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), 2 * pairs.count())
    links = ws.save(_confirm(pretest(pairs), payloads, decode, least, _hubs(pairs, ws)))
    roots = components(links, ws)
    small = sized_broadcast(roots)
    label = lambda df, c: df.join(small.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    labelled = ws.save(label(label(met, "a"), "b"))
    # A folded node goes wherever the one that stands for it is, and that one may have been folded once more.
    folded = labelled.where("folded").select(F.col("a").alias("for"), F.col("ra").alias("rf"), "b", "rb")
    folded = ws.save(folded.union(folded.alias("x").join(folded.alias("y"), F.col("x.for") == F.col("y.b")).select("y.for", "y.rf", "x.b", "x.rb")).distinct())
    loose = folded.where("rf <> rb").select("for").distinct()
    groups = labelled.where("not folded")
    open_ = groups.where("ra <> rb").select("a").union(groups.join(loose.withColumnRenamed("for", "b"), "b", "left_semi").select("a")).union(loose).distinct()
    inside = ws.save(groups.join(open_, "a", "left_semi").select("a", "ra", "b", "rb"))
    rest = inside.select(F.col("a").alias("key"), F.col("a").alias("node"), F.col("ra").alias("root")).union(inside.select("a", "b", "rb"))
    with_them = rest.select("key", F.col("node").alias("for")).distinct().join(folded.select("for", "b", "rb"), "for").select("key", "b", "rb")
    # Where the one that stands for others isn't linked with them all, they are a group too.
    apart = folded.join(loose, "for", "left_semi")
    rest = rest.union(with_them).union(apart.select("for", "b", "rb")).union(apart.select("for", "for", "rf")).distinct()
    # Two nodes alone were compared, and where all are in one component nothing is left to find.
    more = rest.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("n > 2 and r0 <> r1").select("key")
    rest = ws.save(rest.join(more, "key", "left_semi"))
    if not rest.isEmpty():
        found = ws.save(_rest(rest, payloads, decode, least, ws))
        if not found.isEmpty():
            links = ws.save(links.union(found))
            roots = components(links, ws)
    return links, roots


def sized_broadcast(table: DataFrame, rows: int | None = None) -> DataFrame:
    """A table of a few numbers a row, to be broadcast if it has few enough rows; a written one counts its own."""
    return F.broadcast(table) if (table.count() if rows is None else rows) <= BROADCAST_ROWS else table


def _rest(rest: DataFrame, payloads: DataFrame, decode, least: int, ws: Workspace) -> DataFrame:
    """Links (a, b) between the nodes of different roots among (key, node, root), as pairs leave no rows but links.

    A task gets a block of a cluster and a block of its nodes outside the main component, BLOCK nodes and BLOCK_BYTES of either at
    most or so; it counts common elements by a matrix product over the elements both sides have.
    """
    # Payloads are shuffled only if too many nodes are left for a broadcast.
    open_ = payloads.join(sized_broadcast(ws.save(rest.select("node").distinct())), "node", "left_semi")
    able = ws.save(_shareable(open_, decode).where(f"100 * m >= {least} * n").select("node"))
    members = ws.save(rest.join(able, "node").select("key", "node", "root"))
    heads = members.groupBy("key").agg(F.min("node").alias("a"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key", "a")
    groups = components(members.join(heads, "key").select("a", F.col("node").alias("b")), ws)
    weights = open_.select("node", F.length("payload").cast("long").alias("w"))
    placed = ws.save(groups.select("node", F.col("root").alias("cluster")).join(members.select("node", "root").distinct(), "node").join(weights, "node"))
    by_root = placed.groupBy("cluster", "root").agg(F.count("*").alias("c"), F.sum("w").alias("w"))
    sizes = by_root.groupBy("cluster").agg(F.sum("c").alias("n"), F.sum("w").alias("w_n"), F.max("c").alias("most"), F.max_by(F.struct("root", "w"), F.struct("c", "root")).alias("main")).where("n > most").select("cluster", "n", "w_n", "most", F.col("main.root").alias("main"), F.col("main.w").alias("w_main"))
    blocks = lambda c, w: F.greatest(F.ceil(c / BLOCK), F.ceil(w / BLOCK_BYTES)).cast("int")
    near = payloads.join(sized_broadcast(placed.drop("w").join(sizes, "cluster"), placed.count()), "node").select("cluster", "node", "root", "payload", (F.col("root") != F.col("main")).alias("minor"), blocks(F.col("n"), F.col("w_n")).alias("bn"), blocks(F.col("n") - F.col("most"), F.col("w_n") - F.col("w_main")).alias("bk"))
    mine = lambda b: F.pmod(F.xxhash64("node"), F.col(b)).cast("int")
    every = lambda b: F.explode(F.sequence(F.lit(0), F.col(b) - 1))
    rows = ["node", "root", "payload"]
    cells = near.select("cluster", mine("bn").alias("i"), every("bk").alias("j"), F.lit(False).alias("side"), *rows).union(near.where("minor").select("cluster", every("bn").alias("i"), mine("bk").alias("j"), F.lit(True).alias("side"), *rows))

    def compare(cell: pa.Table) -> pa.Table:
        side = cell.column("side").to_numpy(zero_copy_only=False).astype(bool)
        node, root = cell.column("node").to_numpy(), cell.column("root").to_numpy()
        payload = cell.column("payload").to_pylist()
        parts = [np.flatnonzero(~side), np.flatnonzero(side)]
        sets = [decode([payload[i] for i in p]) for p in parts]
        sizes = [np.array([len(x) for x in s], np.int64) for s in sets]
        flat = [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in sets]
        both = np.intersect1d(*flat)
        at = [np.searchsorted(both, f) for f in flat]
        hit = [both[np.minimum(a, max(len(both) - 1, 0))] == f if len(both) else np.zeros(len(f), bool) for a, f in zip(at, flat, strict=True)]
        rows = [np.repeat(np.arange(len(n)), n)[h] for n, h in zip(sizes, hit, strict=True)]
        cols = [a[h] for a, h in zip(at, hit, strict=True)]
        order = [np.argsort(c, kind="stable") for c in cols]
        rows, cols = [r[o] for r, o in zip(rows, order, strict=True)], [c[o] for c, o in zip(cols, order, strict=True)]
        common = np.zeros((len(parts[0]), len(parts[1])), np.float32)
        for c in range(0, len(both), COLUMNS):
            dense = []
            for r, k, n in zip(rows, cols, sizes, strict=True):
                lo, hi = np.searchsorted(k, [c, c + COLUMNS])
                m = np.zeros((len(n), min(COLUMNS, len(both) - c)), np.float32)
                m[r[lo:hi], k[lo:hi] - c] = 1
                dense.append(m)
            common += dense[0] @ dense[1].T
        whole = sizes[0][:, None] + sizes[1][None, :]
        i, j = np.nonzero((100 * common >= least * (whole - common)) & (root[parts[0]][:, None] != root[parts[1]][None, :]))
        x, y = node[parts[0][i]], node[parts[1][j]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return cells.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _shareable(payloads: DataFrame, decode) -> DataFrame:
    """(node, n, m): the size of each set, and how many of its elements any other of these sets has too.

    One row an element leaves Python; a row with a null element states the set's size.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1), DECODED_BYTES):
                parts = decode(batch.column(1).slice(lo, hi - lo).to_pylist())
                sizes = np.array([len(x) for x in parts])
                nodes = np.repeat(batch.column(0).slice(lo, hi - lo).to_numpy(), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(nodes), pa.array(np.ones(len(nodes), np.int64))], ["element", "node", "n"])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.int64()), batch.column(0).slice(lo, hi - lo), pa.array(sizes)], ["element", "node", "n"])

    rows = payloads.select("node", "payload").mapInArrow(spread, "element long, node long, n long")
    # An element that one node has is that node's own; so is the row with its size.
    own = rows.groupBy(F.coalesce("element", "node").alias("element"), F.col("element").isNull().alias("size")).agg(F.count("*").alias("c"), F.min("node").alias("node"), F.max("n").alias("n")).where("c = 1")
    return own.groupBy("node").agg(F.max(F.when(F.col("size"), F.col("n"))).alias("n"), F.count_if(~F.col("size")).alias("u")).select("node", "n", (F.col("n") - F.col("u")).alias("m"))


def _hubs(pairs: DataFrame, ws: Workspace) -> DataFrame:
    """(a, shares), written, of each a that is in more than HUB_PAIRS pairs."""
    return ws.save(pairs.groupBy("a").agg(F.count("*").alias("c")).where(F.col("c") > HUB_PAIRS).select("a", F.ceil(F.col("c") / HUB_PAIRS).cast("int").alias("shares")))


def _confirm(pairs: DataFrame, payloads: DataFrame, decode, least: int, hubs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets pass. A node that is in many pairs of a batch is decoded once.

    Sets of b are joined first, each pair's own; those of an a with many pairs are then sent to as many tasks as its pairs fill, HUB_PAIRS each.
    """
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in slices(whole.column(2), DECODED_BYTES):
                batch = whole.slice(lo, hi - lo)
                a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                nodes, first = np.unique(np.concatenate([a, b]), return_index=True)
                found = [*batch.column(2).to_pylist(), *batch.column(3).to_pylist()]
                sets = decode([found[i] for i in first.tolist()])
                n = np.array([len(x) for x in sets], np.int64)
                good = np.zeros(len(a), bool)
                x, y = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
                # Sizes alone rule out many.
                for i in np.flatnonzero(100 * np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y])).tolist():
                    p, q = sets[x[i]], sets[y[i]]
                    both = overlap(p, q)
                    good[i] = 100 * both >= least * (len(p) + len(q) - both)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    side = lambda c: payloads.select(F.col("node").alias(c), F.col("payload").alias(f"s{c}"))
    if hubs.isEmpty():
        wide = pairs.join(side("a"), "a").join(side("b"), "b")
    else:
        wide, of_a = pairs.join(side("b"), "b"), side("a")
        share = F.coalesce(F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"), F.lit(0)).alias("share")
        wide = wide.join(sized_broadcast(hubs), "a", "left").select("a", "b", "sb", share)
        of_a = of_a.join(sized_broadcast(hubs), "a", "left").select("a", "sa", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
        wide = wide.join(of_a, ["a", "share"])
    return wide.select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long")
