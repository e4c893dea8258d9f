"""Chat formatting: conversations as training windows within a token budget, with a loss mask, and what a reader gets back from them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, columns_of, slices, small_batches
from .merkle import numbered
from .packing import Encoder
from .similar import sized_broadcast

#: Control strings of usual chat templates; none of them is left whole in a turn's text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
START, END = "<|im_start|>", "<|im_end|>\n"
#: UTF-8 bytes of a conversation's turns that one task formats at once; a longer conversation is cut between turns.
CHUNK_BYTES = 1 << 20

# A backslash goes behind the first character of a control string; one that has backslashes there gets one more.
_ESCAPE = re.compile("|".join(rf"(?<={re.escape(c[0])})\\*(?={re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    """The text without whole control strings; unescape() gives it back."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text) if "\\" in text else text


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where in it the escaped text lies."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, text, and where the escaped text lies. Whole control strings are its own marks only."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError("no turn begins here")
        line = text.index("\n", at)
        end = text.index(END, line)
        out.append((unescape_role(text[at + len(START):line]), unescape(text[line + 1:end]), line + 1, end))
        at = end + len(END)
    return out


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, and of the turns before it that it repeats."""

    window: int = 1024
    history: int = 256


def spans(sizes: np.ndarray, system: int, budget: Budget) -> list[tuple[int, int, int]]:
    """(first repeated, first new, end) of each window over turns of `sizes` tokens behind a system turn of `system` tokens.

    A prefix sum of the sizes gives by binary search how many turns fit. Every turn is new in one window. A window repeats the turns right before it
    that fit in the budget of history, as far as its first new turn fits as well. A turn that is too long by itself has a window of its own.
    """
    sums = np.concatenate([[0], np.cumsum(sizes)])
    room = budget.window - system
    out, new, n = [], 0, len(sizes)
    while new < n:
        spare = min(budget.history, room - int(sizes[new]))
        first = int(np.searchsorted(sums, sums[new] - spare)) if spare > 0 else new
        first = min(first, new)
        end = max(new + 1, int(np.searchsorted(sums, sums[first] + room, "right")) - 1)
        out.append((first, new, end))
        new = end
    return out


def chunks(turns: DataFrame, ws: Workspace, chunk_bytes: int) -> DataFrame:
    """(conv_id, bounds) of conversations beyond `chunk_bytes`: the (turn, tie) at which each chunk begins, in order.

    A chunk begins at the first turn whose bytes before it, in its conversation, pass a multiple of `chunk_bytes`. Only numbers of such conversations are
    shuffled, in ranges of the whole order, so a conversation that has most turns fills many tasks.
    """
    size = F.octet_length("text") + F.octet_length("role") + len(START) + len(END)
    large = ws.save(turns.groupBy("conv_id").agg(F.sum(size).alias("size")).where(F.col("size") > chunk_bytes).select("conv_id"))
    if large.isEmpty():
        return large.select("conv_id", F.array(F.struct(F.lit(None).cast(dict(turns.dtypes)["turn"]).alias("turn"), F.lit(0).cast("long").alias("tie"))).alias("bounds"))
    slim = turns.select("conv_id", "turn", "tie", size.alias("size"))
    slim = slim.join(sized_broadcast(large).withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    rows = ws.save(slim.select(F.coalesce(F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.lit("")).alias("tree"), "conv_id", "turn", "tie", "size", F.monotonically_increasing_id().alias("uid")))
    placed = numbered(ws, rows, "tree", ["turn", "tie", "uid"])
    # Bytes before a turn: sums over runs of 4096 turns, then inside a run.
    run = F.expr("pos div 4096")
    runs = placed.groupBy("tree", run.alias("run")).agg(F.sum("size").alias("s"))
    runs = runs.select("tree", "run", (F.sum("s").over(Window.partitionBy("tree").orderBy("run")) - F.col("s")).alias("below"))
    inside = F.sum("size").over(Window.partitionBy("tree", "run").orderBy("pos")) - F.col("size")
    at = placed.withColumn("run", run).withColumn("inside", inside).join(runs, ["tree", "run"]).select("conv_id", "turn", "tie", F.expr(f"(inside + below) div {chunk_bytes}").alias("chunk"))
    first = at.groupBy("conv_id", "chunk").agg(F.min(F.struct("turn", "tie")).alias("first"))
    return ws.save(first.groupBy("conv_id").agg(F.sort_array(F.collect_list("first")).alias("bounds")))


WINDOW = "chunk long, window int, text string, loss array<struct<start:long,end:long>>, first_new int, tokens long"


def format_windows(turns: DataFrame, tokenizer_path: str, budget: Budget = Budget(), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as windows of at most `budget.window` tokens of whole turns.

    Returns conv_id, chunk, window (from 0 in a chunk), text, loss (spans of code points in text, of the assistant texts that are new in this window),
    first_new (how many turns of the window repeat others: the system turn and history) and tokens. Every turn is new in one window, in order of
    chunk and window. A first turn of role system opens every window of its conversation. Only a window of a single new turn that is too long, or of a
    system turn that leaves no room, exceeds the budget; no turn is cut. A conversation beyond `chunk_bytes` is cut into chunks, across which no history is repeated.

    Turns of equal number are ordered by a hash of role and text; a null number comes first, a null conv_id is a conversation of its own, null
    roles and texts are empty. Rows that repeat are turns each. An empty table gives no windows; other columns are ignored.
    """
    spark = turns.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast({"json": f.read()})
    kind = dict(turns.dtypes)["conv_id"]
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("role", "text"))
    cut = chunks(rows, Workspace(spark, "chat"), chunk_bytes)
    n_bounds = cut.agg(F.sum(F.size("bounds"))).first()[0] or 0
    key = F.struct("turn", "tie")
    placed = rows.join(sized_broadcast(cut.withColumnRenamed("conv_id", "_c"), n_bounds), F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    own = F.coalesce(F.size(F.filter("bounds", lambda b: b <= key)) - 1, F.lit(0)).cast("long")
    dealt = placed.select("conv_id", own.alias("chunk"), "turn", "tie", "role", "text", F.lit(True).alias("own"))
    # The first turn of a conversation in chunks opens all of them if it is a system turn.
    heads = placed.where((F.size("bounds") > 1) & (F.col("role") == "system") & (key == F.col("bounds")[0])).dropDuplicates(["conv_id"])
    dealt = dealt.union(heads.select("conv_id", F.explode(F.sequence(F.lit(1).cast("long"), (F.size("bounds") - 1).cast("long"))).alias("chunk"), "turn", "tie", "role", "text", F.lit(False)))

    schema = pa.schema([("conv_id", table_type(kind)), ("chunk", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("first_new", pa.int32()), ("tokens", pa.int64())])

    def windows(conv_id, chunk: int, own: bool, roles: list[str], said: list[tuple[str, int, int]], sizes: np.ndarray) -> Iterator[dict]:
        """The windows of a chunk, whose turns are in order; `own` tells whether its first one is its own or the head of the conversation."""
        n_head = int(roles[0] == "system" and (chunk == 0 or not own))
        head, body, roles = said[:n_head], said[n_head:], roles[n_head:]
        n_system, sizes = int(sizes[:n_head].sum()), sizes[n_head:]
        for w, (first, new, end) in enumerate(spans(sizes, n_system, budget) or [(0, 0, 0)]):
            parts = [*head, *body[first:end]]
            at = np.concatenate([[0], np.cumsum([len(t) for t, _, _ in parts])]).tolist()
            # A conversation of a system turn alone has one window, in which that turn is new.
            repeats = (n_head if w or chunk else 0) + new - first
            loss = [{"start": at[n_head + i - first] + body[i][1], "end": at[n_head + i - first] + body[i][2]} for i in range(new, end) if roles[i] == "assistant"]
            yield {"conv_id": conv_id, "chunk": chunk, "window": w, "text": "".join(t for t, _, _ in parts), "loss": loss, "first_new": repeats, "tokens": n_system + int(sizes[first:end].sum())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tokenizer.value  # stays with the Python worker, and so does what it has learned
        if "encoder" not in held:
            held["encoder"] = Encoder(held["json"])
        key, turns = None, ([], [], [], [])  # the chunk at hand, and whether its turns are its own, their roles, texts and sizes
        for batch in batches:
            ids, chunk, own, role, text = columns_of(batch, ["conv_id", "chunk", "own", "role", "text"])
            said = [turn_text(r, t) for r, t in zip(role.to_pylist(), text.to_pylist(), strict=True)]
            formatted, sizes = pa.array([t for t, _, _ in said], pa.string()), []
            for lo, hi in slices(formatted):
                sizes += [len(x) for x in held["encoder"].encode(formatted.slice(lo, hi - lo))]
            out = []
            for now, *turn in zip(zip(ids.to_pylist(), chunk.to_pylist(), strict=True), own.to_pylist(), role.to_pylist(), said, sizes, strict=True):
                if now != key:
                    if turns[0]:
                        out += windows(*key, turns[0][0], *turns[1:3], np.array(turns[3], np.int64))
                    key, turns = now, ([], [], [], [])
                for column, x in zip(turns, turn, strict=True):
                    column.append(x)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if turns[0]:
            yield pa.RecordBatch.from_pylist(list(windows(*key, turns[0][0], *turns[1:3], np.array(turns[3], np.int64))), schema)

    # A task gets whole chunks in order, so it holds one of them and one batch of rows.
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "chunk", "own", "turn", "tie", "role", "text")]
    ordered = dealt.repartition("conv_id", "chunk").sortWithinPartitions(*order)
    return ordered.select("conv_id", "chunk", "own", "role", "text").mapInArrow(run, f"conv_id {kind}, {WINDOW}")


def table_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def read_back(windows: DataFrame) -> DataFrame:
    """What a reader of format_windows() gets: conv_id, n_turns, turns_sha256 (role, newline, text, newline of every turn), loss_chars and loss_sha256
    (code points and digest of the texts under the loss mask, one after another) and formatted_chars (code points of all windows).

    Digests run over a whole conversation, so its windows come to one task, in order, which holds one of them at a time.
    """
    spark = windows.sparkSession
    small_batches(spark)
    kind = dict(windows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv_id": now, "n_turns": turns, "turns_sha256": said.hexdigest(), "loss_chars": chars, "loss_sha256": learned.hexdigest(), "formatted_chars": size}], schema)

        now, begun = None, False
        for batch in batches:
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != now:
                    if begun:
                        yield result()
                    now, begun, turns, chars, size, said, learned = row["conv_id"], True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                text = row["text"]
                size += len(text)
                for role, body, _, _ in parse(text)[row["first_new"]:]:
                    turns += 1
                    said.update(f"{role}\n{body}\n".encode())
                for span in row["loss"]:
                    body = unescape(text[span["start"]:span["end"]])
                    chars += len(body)
                    learned.update(body.encode())
        if begun:
            yield result()

    schema = pa.schema([("conv_id", table_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "window")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
