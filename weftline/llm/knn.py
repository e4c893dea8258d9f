"""Exact top-k search by inner product: a Voronoi join of queries and data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Pivots: a quarter of the square root of the number of vectors, at most so many; the driver holds some matrices of pivots x pivots.
PIVOTS = 2048
#: Queries whose data are gathered together, and data rows solved against them in one task.
GROUP_QUERIES, TASK_ROWS = 2048, 20_000
#: Scores beyond a long are shown as its largest or smallest.
LONG = 2**63 - 1
#: Data rows scored at once.
BLOCK = 2048


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * values.astype(np.float64)), -(2.0**62), 2.0**62).astype(np.int64)


def _matrix(cells: pa.Array, width: int) -> np.ndarray:
    """Rows of int64 vectors; shorter ones end in zeros."""
    out = np.zeros((len(cells), width), np.int64)
    if not len(cells):
        return out
    sizes = pa.compute.binary_length(cells).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    values = np.frombuffer(b"".join(cells.to_pylist()), np.int64)
    if (sizes == width).all():
        return values.reshape(-1, width).copy()
    at = np.repeat(np.arange(len(cells)) * width - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(values))
    out.ravel()[at] = values
    return out


def top_scores(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, data: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(number of the query, place in the data, score) of each query's k best rows but its own; ties go to smaller ids, then rows. `rows` tells data rows apart, `own` is each query's."""
    order = np.lexsort((rows, ids))
    names, data = rows[order], data[order]
    most = int(max(np.abs(queries).max(initial=0), np.abs(data).max(initial=0)))
    bound = most * most * max(queries.shape[1], 1)
    exact = np.float64 if bound < 2**52 else np.int64 if bound < 2**62 else object
    q = queries.astype(exact)
    best_at = np.zeros((len(q), 0), np.int64)
    best = np.zeros((len(q), 0), exact)
    for at in range(0, len(names), BLOCK):
        here = np.arange(at, min(at + BLOCK, len(names)))
        s = np.concatenate([best, q @ data[here].astype(exact).T], 1)
        places = np.concatenate([best_at, np.broadcast_to(here, (len(q), len(here)))], 1)
        # Earlier columns come first in the order, so a stable order settles ties.
        mine = names[places] == own[:, None]
        width = s.shape[1]
        n = min(k + 1, width)  # one more, as the query's own row may be among them until the end
        if exact is np.float64 and bound * 4096 < 2**52 and width < 4096:
            rank = np.where(mine, -np.inf, s * 4096 - np.arange(width))
            pick = np.argpartition(-rank, n - 1, axis=1)[:, :n] if n < width else np.broadcast_to(np.arange(width), (len(q), width))
            pick = np.take_along_axis(pick, np.argsort(-np.take_along_axis(rank, pick, 1), axis=1), 1)
        else:
            pick = np.stack([np.array(sorted(range(width), key=lambda j, r=r: (mine[r, j], -s[r, j], j))[:n], np.int64) for r in range(len(q))]) if len(q) else np.zeros((0, n), np.int64)
        best, best_at = np.take_along_axis(s, pick, 1), np.take_along_axis(places, pick, 1)
    number, place = np.repeat(np.arange(len(q)), best.shape[1]), best_at.ravel()
    good = names[place] != own[number] if len(place) else np.zeros(0, bool)
    return number[good], order[place[good]], [int(x) for x in best.ravel()[good]]


def plan(pivots: np.ndarray, counts: np.ndarray, radii: np.ndarray, q_counts: np.ndarray, q_radii: np.ndarray, k: int, group_queries: int = GROUP_QUERIES) -> tuple[np.ndarray, list[set[int]]]:
    """Group of each cell's queries (-1: none), and the data cells that each group needs.

    A query in cell i and a vector in cell j differ from their pivots by their radii at most, which bounds their
    product on both sides. A cell whose upper bound is below the k-th best lower bound of a query cell is not
    needed by it. Query cells join a group along their similarity to the first one until it has enough queries.
    """
    dot = pivots @ pivots.T
    norm = np.sqrt(np.maximum(np.diag(dot), 0))
    slack = norm[:, None] * radii[None, :] + q_radii[:, None] * norm[None, :] + q_radii[:, None] * radii[None, :]
    slack = slack * (1 + 1e-9) + 1e-6 * (1 + np.abs(dot))
    upper, lower = dot + slack, dot - slack
    cells = np.flatnonzero(q_counts > 0)
    need: dict[int, set[int]] = {}
    for i in cells.tolist():
        order = np.argsort(-lower[i], kind="stable")
        have = np.cumsum(counts[order])
        # The query itself may be among those counted.
        enough = np.flatnonzero(have >= k + 1)
        floor = lower[i, order[enough[0]]] if len(enough) else -np.inf
        need[i] = {int(j) for j in np.flatnonzero((upper[i] >= floor) & (counts > 0))}
    group, needs = np.full(len(pivots), -1), []
    left = set(cells.tolist())
    while left:
        first = min(left)
        held, mine = 0, set()
        for i in sorted(left, key=lambda c: (-dot[first, c], c) if c != first else (-np.inf, c)):
            if held and held + q_counts[i] > group_queries:
                break
            group[i] = len(needs)
            held += q_counts[i]
            mine |= need[i]
            left.discard(i)
        needs.append(mine)
    return group, needs


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding", task_rows: int = TASK_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """The k best inner products of every query with all other vectors, exactly.

    Components x become floor(scale * x); queries are the rows whose id is divisible by `every`, candidates all rows but the
    query's own. Ties go to the smaller id, then in the order of the table.

    Vectors are grouped by their nearest pivot. Sizes and radii of the groups bound the products between a query
    group and a data group; data groups that can't hold one of the k best are not sent to it. The rest is sent in parts of
    about `task_rows` rows, so no cell is too large for a task, each part is solved by itself, and the partial results,
    k a query and part, are merged. Queries are dealt in groups of about `group_queries`; a cell with more is split, and each share gets
    the data that the cell needs.

    Returns query_id, rank (from 1), vec_id, score. Rows with a null id, a null vector, or a vector with null, NaN or
    infinite components take no part. Shorter vectors end in zeros. Rows that repeat an id are rows each, as
    candidates and as queries, so a query_id has k rows for each of its own. With fewer than k candidates all are returned.
    Components beyond 2^62 are cut to that limit; scores beyond a long are compared exactly and shown as its largest or smallest.
    """
    if k < 1 or every < 1 or task_rows < 1:
        raise ValueError("k, every and task_rows must be positive")
    spark = vectors.sparkSession
    ws = Workspace(spark, "knn")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            flat = lists.flatten()
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
            row = np.repeat(np.arange(len(sizes)), sizes)
            bad = np.bincount(row, ~np.isfinite(values), minlength=len(sizes)) > 0 if len(values) else np.zeros(len(sizes), bool)
            good = ~bad & lists.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
            whole = quantised(np.where(np.isfinite(values), values, 0), scale)
            ends = np.cumsum(sizes)
            packed = [whole[e - n:e].tobytes() for e, n, g in zip(ends.tolist(), sizes.tolist(), good.tolist(), strict=True) if g]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.array(packed, pa.binary())], ["vec_id", "v"])

    rows = ws.save(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(read, "vec_id long, v binary").withColumn("uid", F.monotonically_increasing_id()))
    total, width = rows.agg(F.count("*"), F.max(F.length("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not total or rows.where(F.col("vec_id") % every == 0).isEmpty():
        return spark.createDataFrame([], schema)
    width = (width or 0) // 8
    n_pivots = max(1, min(PIVOTS, int(total**0.5) // 4))
    pivots = _matrix(pa.array([bytes(r[0]) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n_pivots).select("v").collect()], pa.binary()), width).astype(np.float64)
    centres = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = centres.value
        square = (p * p).sum(1)
        for batch in batches:
            x = _matrix(batch.column(1), width).astype(np.float64)
            cell = (square - 2 * (x @ p.T)).argmin(1) if len(x) else np.zeros(0, np.int64)
            radius = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(radius)], ["vec_id", "v", "uid", "cell", "radius"])

    placed = ws.save(rows.mapInArrow(assign, "vec_id long, v binary, uid long, cell int, radius double"))
    is_query = F.col("vec_id") % every == 0
    counts, radii, q_counts, q_radii = (np.zeros(len(pivots)) for _ in range(4))
    for cell, n, r, nq, rq in placed.groupBy("cell").agg(F.count("*"), F.max("radius"), F.count_if(is_query), F.max(F.when(is_query, F.col("radius")))).collect():
        counts[cell], radii[cell], q_counts[cell], q_radii[cell] = n, r, nq, rq or 0
    group, needs = plan(pivots, counts, radii, q_counts, q_radii, k, group_queries)
    # Bounded by pivots squared: which groups a cell is sent to, in how many parts a group's data come, and its queries.
    parts = [max(1, -(-int(sum(counts[j] for j in need)) // task_rows)) for need in needs]
    held = np.zeros(len(needs))
    np.add.at(held, group[group >= 0], q_counts[group >= 0])
    shares = [max(1, -(-int(n) // group_queries)) for n in held]
    first = np.concatenate([[0], np.cumsum(np.array(parts, np.int64) * np.array(shares, np.int64))])
    table = lambda rows: F.broadcast(spark.createDataFrame(rows, "cell int, first long, parts long, shares long"))
    sent = table([(int(c), int(first[g]), parts[g], shares[g]) for g, need in enumerate(needs) for c in sorted(need)])
    asked = table([(c, int(first[g]), parts[g], shares[g]) for c, g in enumerate(group.tolist()) if g >= 0])
    spread = F.xxhash64("uid", F.lit(1))
    share = placed.join(sent, "cell").select("vec_id", "uid", "v", "first", "parts", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    data = share.select((F.col("first") + F.col("share") * F.col("parts") + F.pmod(F.xxhash64("uid"), F.col("parts"))).alias("part"), "vec_id", "uid", "v")
    begin = F.col("first") + F.pmod(spread, F.col("shares")) * F.col("parts")
    queries = placed.where(is_query).join(asked, "cell").select(F.explode(F.sequence(begin, begin + F.col("parts") - 1)).alias("part"), F.col("vec_id").alias("query_id"), F.col("uid").alias("asked"), F.col("v").alias("q"))
    found_schema = pa.schema([("query_id", pa.int64()), ("asked", pa.int64()), ("vec_id", pa.int64()), ("uid", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return found_schema.empty_table()
        own, ids, uids = q["asked"].to_numpy(), x["vec_id"].to_numpy(), x["uid"].to_numpy()
        number, place, scores = top_scores(_matrix(q["q"].combine_chunks(), width), ids, uids, _matrix(x["v"].combine_chunks(), width), own, k)
        # A score in two longs, which sort as it does.
        parts = [pa.array([s >> 62 for s in scores], pa.int64()), pa.array([s & (2**62 - 1) for s in scores], pa.int64())]
        return pa.Table.from_arrays([pa.array(q["query_id"].to_numpy()[number]), pa.array(own[number]), pa.array(ids[place]), pa.array(uids[place]), *parts], schema=found_schema)

    found = queries.groupBy("part").cogroup(data.groupBy("part")).applyInArrow(solve, "query_id long, asked long, vec_id long, uid long, high long, low long")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("high"), F.desc("low"), "vec_id", "uid"))
    score = F.when(F.col("high") > 1, F.lit(LONG)).when(F.col("high") < -2, F.lit(-LONG)).otherwise(F.greatest(F.shiftleft("high", 62) + F.col("low"), F.lit(-LONG)))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
