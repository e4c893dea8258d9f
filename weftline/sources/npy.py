"""Word vectors as NumPy arrays: a source that reads ranges of rows, and a sink that writes shards in the same form."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows that one partition of the source reads, and rows in a batch.
RANGE_ROWS, BATCH_ROWS = 65_536, 4_096


def read_header(stream) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and length of the header of an array in NumPy's format."""
    version = np.lib.format.read_magic(stream)
    shape, columns_first, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    if columns_first:
        raise ValueError("arrays must be in row order")
    return shape, kind, stream.tell()


def header(shape: tuple[int, ...], kind: np.dtype) -> bytes:
    """Header of an array in NumPy's format, with room for any number of rows."""
    about = repr({"descr": kind.str, "fortran_order": False, "shape": shape})
    return b"\x93NUMPY\x01\x00" + (118).to_bytes(2, "little") + about.ljust(117).encode("latin1") + b"\n"


@dataclass
class _Range(InputPartition):
    shard: str
    first: int
    rows: int


@dataclass
class _Shard(WriterCommitMessage):
    name: str
    rows: int
    dim: int


class NpyVectors(DataSource):
    """(word, vec) in shards of three files: `x.npy` has the vectors, `x.words` the words in UTF-8 one after another, and `x.ends.npy` where each word ends.

    Source: `spark.read.format("npy_vectors").load(folder)`. Rows have a fixed size, so a partition is a range of rows: it seeks to its bytes of each file and reads
    those alone. Option rows_per_partition, by default RANGE_ROWS. Sink: a shard for each task, under a staging folder that is moved into place when all are done; a shard is written in one pass,
    and the headers, which need the number of rows, go before them at the end. All vectors of a task must have the same length; words and vectors must not be null.
    """

    @classmethod
    def name(cls) -> str:
        return "npy_vectors"

    def schema(self) -> str:
        return "word string, vec array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _NpyReader(self.options["path"], int(self.options.get("rows_per_partition", RANGE_ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if schema.names != ["word", "vec"]:
            raise ValueError("npy_vectors takes the columns word and vec")
        return _NpyWriter(self.options["path"], overwrite)


class _NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def _open(self) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        return files, root.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        files, root = self._open()
        out = []
        for info in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            if info.base_name.endswith(".ends.npy"):
                with files.open_input_file(info.path) as f:
                    (n,), _, _ = read_header(f)
                shard = info.path.removesuffix(".ends.npy")
                out += [_Range(shard, i, min(self.rows, n - i)) for i in range(0, n, self.rows)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        files, _ = self._open()
        with files.open_input_file(f"{partition.shard}.npy") as vectors, files.open_input_file(f"{partition.shard}.ends.npy") as ends, files.open_input_file(f"{partition.shard}.words") as words:
            (_, dim), kind, vectors_at = read_header(vectors)
            _, _, ends_at = read_header(ends)
            row_bytes = dim * kind.itemsize
            for lo in range(partition.first, partition.first + partition.rows, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.first + partition.rows - lo)
                before = max(lo - 1, 0)
                at = np.frombuffer(ends.read_at((lo + n - before) * 8, ends_at + before * 8), "<i8")
                at = at if lo else np.concatenate([[0], at])
                raw = words.read_at(int(at[-1] - at[0]), int(at[0]))
                table = np.frombuffer(vectors.read_at(n * row_bytes, vectors_at + lo * row_bytes), kind).astype(np.float32)
                names = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(at - at[0]), pa.py_buffer(raw)]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim, pa.int32()), pa.array(table))], ["word", "vec"])


class _NpyWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _open(self) -> tuple[fs.FileSystem, str, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        root = root.rstrip("/")
        return files, root, f"{root}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Shard:
        files, _, staging = self._open()
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.job[:8]}-{task.taskAttemptId()}"
        files.create_dir(staging)
        rows, dim, end = 0, None, 0
        # Bodies first; the headers, which need the number of rows, go before them when the shard is done.
        with files.open_output_stream(f"{staging}/{name}.vectors") as vectors, files.open_output_stream(f"{staging}/{name}.words") as words, files.open_output_stream(f"{staging}/{name}.places") as places:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                names, vecs = batch.column(0), batch.column(1)
                if names.null_count or vecs.null_count:
                    raise ValueError("words and vectors must not be null")
                table = vecs.flatten().to_numpy(zero_copy_only=False).astype("<f4")
                size, odd = divmod(len(table), batch.num_rows)
                if odd or (dim is not None and size != dim) or len(set(pa.compute.list_value_length(vecs).to_pylist())) > 1:
                    raise ValueError("vectors must have one length")
                dim = size
                vectors.write(table.tobytes())
                raw = [w.encode() for w in names.to_pylist()]
                words.write(b"".join(raw))
                ends = end + np.cumsum([len(w) for w in raw])
                end = int(ends[-1])
                places.write(ends.astype("<i8").tobytes())
                rows += batch.num_rows
        for body, file, shape, kind in ((f"{name}.vectors", f"{name}.npy", (rows, dim or 0), np.dtype("<f4")), (f"{name}.places", f"{name}.ends.npy", (rows,), np.dtype("<i8"))):
            with files.open_output_stream(f"{staging}/{file}") as out, files.open_input_stream(f"{staging}/{body}") as f:
                out.write(header(shape, kind))
                while block := f.read(1 << 22):
                    out.write(block)
            files.delete_file(f"{staging}/{body}")
        return _Shard(name, rows, dim or 0)

    def commit(self, messages: list[_Shard | None]) -> None:
        files, root, staging = self._open()
        old = [x.path for x in files.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("part-")] if self.overwrite else []
        shards = [m for m in messages if m is not None and m.rows]
        if len({m.dim for m in shards}) > 1:
            self.abort(messages)
            raise ValueError("vectors must have one length")
        for m in shards:
            for kind in ("npy", "words", "ends.npy"):  # a shard is seen by its ends, which come last
                files.move(f"{staging}/{m.name}.{kind}", f"{root}/{m.name}.{kind}")
        for path in sorted(old, key=lambda p: not p.endswith(".ends.npy")):
            files.delete_file(path)
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)

    def abort(self, messages: list[_Shard | None]) -> None:
        files, _, staging = self._open()
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)


def write_vectors(words: DataFrame, path: str, mode: str = "overwrite") -> None:
    words.sparkSession.dataSource.register(NpyVectors)
    words.selectExpr("word", "cast(vec as array<float>) vec").write.format("npy_vectors").mode(mode).save(path)


def read_vectors(spark: SparkSession, path: str, rows_per_partition: int = RANGE_ROWS) -> DataFrame:
    spark.dataSource.register(NpyVectors)
    return spark.read.format("npy_vectors").option("rows_per_partition", rows_per_partition).load(path)
