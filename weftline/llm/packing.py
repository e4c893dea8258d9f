"""Best-fit packing of tokenised documents into sequences, improved by a swap-based local search."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, columns_of, slices, small_batches
from .similar import mix

#: Units of text whose ids a Python worker remembers, at about 32 bytes each.
MEMO_UNITS = 2_000_000
#: Bytes of text that are cut and looked up at once.
WINDOW_BYTES = 1 << 20
#: Pieces that are packed together; each such group can leave one sequence underfull.
GROUP_PIECES = 16_384
#: Bins in a row that may resist the local search, and documents of a bin that its exchanges look at.
PATIENCE, LOOK = 24, 6


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo:hi + 1] = True
    return out


#: By byte: what a unit begins with; visible ASCII; ASCII letters; lead bytes of two-byte letters of Latin scripts.
_GAP, _VISIBLE, _LETTER, _LATIN = _class((32, 32), (10, 10)), _class((33, 126)), _class((65, 90), (97, 122)), _class((0xC3, 0xC9))


def units(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the units of UTF-8 texts begin that a byte-level BPE encodes by themselves; `begins` are the texts' own first bytes.

    The usual pre-tokenizer never joins a character to white space that follows it, whatever comes later. So a text may
    be cut before a space or newline behind a character that is no white space, and before a full stop or comma
    between a letter and such a place. Where that isn't certain, for scripts or spaces not listed here, the unit goes on.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    one = np.zeros(len(data), np.uint8)
    two, three = one.copy(), one.copy()
    one[1:], two[2:], three[3:] = data[:-1], data[:-2], data[:-3]
    # Characters of two or three bytes some of which are white space: U+0080 on, U+1680, U+2000 on, U+3000 on.
    odd = (two == 0xC2) | (((three == 0xE1) | (three == 0xE2) | (three == 0xE3)) & (two >= 0x80))
    cut = _GAP[data] & (_VISIBLE[one] | ((one >= 0x80) & ~odd))
    cut[begins] = True
    after = np.append(cut[1:], True)
    letter = _LETTER[one] | ((one >= 0x80) & _LATIN[two] & ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7))))
    cut |= ((data == 46) | (data == 44)) & letter & after
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own.

    Texts are cut into units(), and each distinct unit is encoded once and remembered by a 64-bit hash, of which two units
    in a memory share one with a probability below 1e-6.
    """

    def __init__(self, tokenizer_json: str, most: int = MEMO_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        self.most = most
        # Byte-level vocabularies write a space as U+0120 and a newline as U+010A.
        vocabulary = self.tokenizer.get_vocab()
        self.leading = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.leading[i] = token[0] in "\u0120\u010a"
        rng = np.random.default_rng(20240607)
        self.values = rng.integers(0, 2**64, 256, np.uint64)
        self.powers = np.ones(1, np.uint64)
        self.base = np.uint64(int(rng.integers(0, 2**63)) * 2 + 1)
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _hashes(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        longest = int(size.max())
        with np.errstate(over="ignore"):
            while len(self.powers) < longest:
                self.powers = np.append(self.powers, self.powers * np.multiply.reduce(np.full(len(self.powers), self.base)))
            place = np.arange(len(data)) - np.repeat(start, size)
            return mix(np.add.reduceat(self.values[data] * self.powers[place], start) + size.astype(np.uint64))

    def _learn(self, hashes: np.ndarray, texts: list[bytes], plain: np.ndarray) -> None:
        """Encodes new units. The `plain` ones, whose only white space is their first character, are encoded as one text: only their first tokens begin with it."""
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n, encode = int(plain.sum()), self.tokenizer.encode_batch_fast
        flat, size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if n:
            flat = np.array(encode([b"".join([texts[i] for i in order[:n].tolist()]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            starts = np.flatnonzero(self.leading[flat])
            if len(starts) == n and starts[0] == 0:
                size = np.diff(np.append(starts, len(flat)))
            else:  # a vocabulary of another make
                n, flat = 0, flat[:0]
        if n < len(order):
            single = [x.ids for x in encode([texts[i].decode() for i in order[n:].tolist()], add_special_tokens=False)]
            size = np.concatenate([size, np.fromiter(map(len, single), np.int64, len(single))])
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(single), np.uint32)])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used:self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        hashes = hashes[order]
        order = np.argsort(hashes)
        place = np.searchsorted(self.known, hashes[order])
        self.known, self.at, self.size = (np.insert(x, place, y[order]) for x, y in ((self.known, hashes), (self.at, at), (self.size, size)))

    def _window(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the data, and how many lie before each unit; with the units' starts."""
        start = units(data, begins)
        size = np.diff(np.append(start, len(data)))
        hashes, first, which = np.unique(self._hashes(data, start, size), return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > self.most:
            self.forget()
        place = np.searchsorted(self.known, hashes)
        new = np.flatnonzero(self.known[np.minimum(place, max(len(self.known) - 1, 0))] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(new):
            whole = data.tobytes()
            lo = start[first[new]]
            hi = lo + size[first[new]]
            spaces = np.append(0, np.cumsum(data <= 32))
            self._learn(hashes[new], [whole[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], _GAP[data[lo]] & (spaces[hi] - spaces[lo] == 1) & (hi - lo > 1))
            place = np.searchsorted(self.known, hashes)
        place = place[which]
        n = self.size[place]
        before = np.cumsum(n) - n
        return self.ids[np.repeat(self.at[place] - before, n) + np.arange(int(n.sum()))], start, before

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string array; null is empty."""
        texts = texts.fill_null("").cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        begins = np.unique(ends[:-1][ends[1:] > ends[:-1]])
        parts, at, lo = [], np.zeros(len(ends), np.int64), 0
        done = 0
        while lo < len(data):
            hi = len(data)
            if hi - lo > WINDOW_BYTES:  # up to the last unit that begins in the window, or in a longer one
                reach = WINDOW_BYTES
                while True:
                    hi = min(lo + reach, len(data))
                    mine = begins[(begins >= lo) & (begins < hi)] - lo
                    start = units(data[lo:hi], np.union1d(mine, [0]))
                    # A mark at the end of the window may go on behind it.
                    start = start[start < hi - lo - 4]
                    if hi == len(data) or start[-1] > 0:
                        break
                    reach *= 2
                hi = lo + int(start[-1]) if hi < len(data) else hi
            mine = begins[(begins >= lo) & (begins < hi)] - lo
            ids, start, before = self._window(data[lo:hi], np.union1d(mine, [0]))
            inside = (ends >= lo) & (ends < hi)
            at[inside] = done + before[np.searchsorted(start, ends[inside] - lo)]
            parts.append(ids)
            done += len(ids)
            lo = hi
        at[ends >= len(data)] = done
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces: the first takes what full pieces leave over."""
    n = len(ids) // 4
    first = (n - 1) % capacity + 1
    cuts = [0, *range(first, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[4 * a:4 * b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room for exactly r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if above := rooms >> n:
            room = n + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int, patience: int = PATIENCE) -> list[list[int]]:
    """Empties bins by moving documents and by exchanging one for one, two for one or one for two.

    Only underfull bins take part. The emptiest one gives: each exchange leaves it emptier and fills another bin, so
    the sum of squared fills grows with every step and the search ends. It ends early when the bins are as few as
    their total length allows, or when `patience` bins in a row couldn't be emptied. Exchanges look at a bin's
    longest documents only; a move can take any.
    """
    size = np.array(lengths, np.int64)
    fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
    spare = len(bins) - -(-int(fill.sum()) // capacity)
    tried: set[int] = set()
    failed = 0
    while spare > 0 and failed < patience:
        open_ = [b for b in np.flatnonzero((fill > 0) & (fill < capacity)).tolist() if b not in tried]
        if not open_:
            break
        a = min(open_, key=lambda b: (fill[b], b))
        moved = False
        others = np.array([b for b in np.flatnonzero((fill > 0) & (fill < capacity)).tolist() if b != a], np.int64)
        longest = np.full((len(others), LOOK), -1, np.int64)
        for row, b in enumerate(others.tolist()):
            mine = sorted(bins[b], key=lambda i: -lengths[i])[:LOOK]
            longest[row, :len(mine)] = mine
        while bins[a] and len(others):
            step = _step(bins[a], int(fill[a]), fill[others], longest, size, capacity)
            if step is None:
                break
            moved = True
            row, out, back = step
            b = int(others[row])
            bins[a] = [i for i in bins[a] if i not in out] + list(back)
            bins[b] = [i for i in bins[b] if i not in back] + list(out)
            d = int(size[list(out)].sum() - size[list(back)].sum())
            fill[a] -= d
            fill[b] += d
            mine = sorted(bins[b], key=lambda i: -lengths[i])[:LOOK]
            longest[row] = -1
            longest[row, :len(mine)] = mine
        # After a step others may succeed that couldn't before.
        tried = set() if moved else tried | {a}
        failed = 0 if not bins[a] else failed + 1
        spare -= not bins[a]
    return [b for b in bins if b]


def _step(mine, fill_a, fill_b, longest, size, capacity):
    """The exchange that adds most to the sum of squared fills, or None: (row of the other bin, out, back)."""
    best, found = 0, None
    room, base = (capacity - fill_b)[:, None], (fill_b - fill_a)[:, None]
    there = longest >= 0
    ones = np.where(there, size[longest], capacity)
    left, right = np.triu_indices(LOOK, 1)
    twos = np.where(there[:, left] & there[:, right], ones[:, left] + ones[:, right], capacity)
    mine = sorted(mine, key=lambda i: -size[i])
    moves = np.zeros((len(room), 1), np.int64)
    outs = [((i,), (moves, ones, twos)) for i in mine] + [((i, j), (ones,)) for k, i in enumerate(mine[:LOOK]) for j in mine[k + 1:LOOK]]
    for out, backs in outs:
        n = int(sum(size[i] for i in out))
        for back in backs:
            d = n - back
            gain = np.where((d > 0) & (d <= room), d * (base + d), 0)
            at = int(gain.argmax()) if gain.size else 0
            if gain.size and (g := int(gain.flat[at])) > best:
                row, k = divmod(at, back.shape[1])
                given = () if back is moves else (int(longest[row, k]),) if back is ones else (int(longest[row, left[k]]), int(longest[row, right[k]]))
                best, found = g, (row, out, given)
    return found


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Item numbers by bin; every length is between 1 and the capacity."""
    return improve(best_fit(lengths, capacity), lengths, capacity)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Packs tokenised documents into as few sequences of at most `capacity` tokens as it can.

    A document is the ids of its text and then `end_id`. Only one longer than `capacity` is cut, into pieces of
    `capacity` tokens; its first piece may be shorter. The tokenizer's file is read on the driver and broadcast.

    The tokens themselves are never shuffled: a table of pieces (numbers only) is written to the shared folder and
    dealt out evenly, whatever the keys are, into groups of about `group_pieces`; each group is packed by itself by best fit
    and local search, so a group can leave one sequence underfull.

    Returns doc_id, piece (from 0), start (the document's ids before it), length, ids_crc32 (unsigned, of the ids as little-endian
    uint32), sequence_id and offset (the piece's place in its sequence, without gaps from 0). Every row of `docs`
    is a document, repeated rows too. A null or empty text is a document of one token. An empty table gives no rows;
    other columns are ignored.
    """
    if capacity < 1 or group_pieces < 1:
        raise ValueError("capacity and group_pieces must be positive")
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast({"json": f.read()})
    kind = dict(docs.dtypes)[key]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tokenizer.value  # stays with the Python worker, and so does what it has learned
        if "encoder" not in held:
            held["encoder"] = Encoder(held["json"])
        encoder = held["encoder"]
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                ids = encoder.encode(batch.column(1).slice(lo, hi - lo))
                rows, piece, start, length, crc = [], [], [], [], []
                for i, x in enumerate(ids):
                    for p, (s, n, c) in enumerate(pieces_of(x.tobytes() + end, capacity)):
                        rows.append(lo + i)
                        piece.append(p)
                        start.append(s)
                        length.append(n)
                        crc.append(c)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, count = [], 0, 0
        first = TaskContext.get().partitionId() << 40

        def packed() -> pa.RecordBatch:
            nonlocal held, n, count
            table = pa.Table.from_batches(held).combine_chunks()
            lengths = table.column("length").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            full = np.flatnonzero(lengths == capacity)
            sequence[full] = first + count + np.arange(len(full))
            count += len(full)
            rest = np.flatnonzero(lengths < capacity)
            for bin_ in pack_lengths(lengths[rest].tolist(), capacity):
                mine = rest[bin_]
                sequence[mine] = first + count
                offset[mine] = np.concatenate([[0], np.cumsum(lengths[mine])[:-1]])
                count += 1
            held, n = [], 0
            return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches()

        for batch in batches:
            held.append(batch)
            n += int((columns_of(batch, ["length"])[0].to_numpy() < capacity).sum())
            if n >= 2 * group_pieces:  # partitions are dealt evenly, but memory must not hang on it
                yield from packed()
        if held:
            yield from packed()

    fields = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    pieces = Workspace(spark, "packing").save(slim.mapInArrow(cut, fields))
    groups = max(1, round(pieces.count() / group_pieces))
    return pieces.repartition(groups).mapInArrow(place, fields + ", sequence_id long, offset long")
