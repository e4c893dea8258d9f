"""An archive of page bodies: compressed one by one behind each other, with an index by which a body is read alone."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame


def pack(pages: DataFrame, body: str, path: str) -> DataFrame:
    """Writes the bodies of `pages` below `path`; returns the other columns with file, at and size of each body.

    Every run of a task writes a file of its own, whole before its index rows go on. So save the result and read that: what the saved index doesn't name, of tasks that ran twice, is never read.
    A null body has a null file.
    """
    names = [c for c in pages.columns if c != body]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        files.create_dir(root)
        name = f"{uuid.uuid4().hex}.bodies"
        held, at = [], 0
        with files.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                bodies = batch.column(len(names)).to_pylist()
                raw = [None if b is None else zlib.compress(b.encode()) for b in bodies]
                sizes = [0 if b is None else len(b) for b in raw]
                starts = list(accumulate(sizes, initial=at))
                at = starts.pop()
                out.write(b"".join(b for b in raw if b is not None))
                held.append(pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([None if b is None else name for b in raw], pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], [*names, "file", "at", "size"]))
        yield from held

    kinds = dict(pages.dtypes)
    return pages.select(*names, body).mapInArrow(write, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", file string, at long, size long")


def reader(path: str) -> Callable[[dict], str | None]:
    """Maps a row of the index to its body, by one ranged read."""
    def read(row: dict) -> str | None:
        if row["file"] is None:
            return None
        files, root = fs.FileSystem.from_uri(path)
        with files.open_input_file(f"{root}/{row['file']}") as f:
            return zlib.decompress(f.read_at(row["size"], row["at"])).decode()

    return read
