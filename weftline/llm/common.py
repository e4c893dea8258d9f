"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch sent to Python; whole texts are long, so batches stay small.
ARROW_ROWS = 1000
#: Bytes of text that a Python worker holds decoded at once.
SLICE_BYTES = 4 << 20
#: Texts are a Spark `string`; words of these operators are split on ASCII characters only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts within a Python worker's memory.

    The plans that operators return run after them, so the session keeps the setting; it is never raised.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset and all run in one process, a local one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Workspace:
    """Tables written to the shared folder; they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame) -> DataFrame:
        """Writes df as Parquet and returns a DataFrame that reads it back."""
        self.count += 1
        df.write.parquet(path := f"{self.root}/{self.count}")
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def clear(self, *keep: DataFrame) -> None:
        """Deletes the tables of this workspace but those in `keep`; nothing may read the others any more."""
        path_of = self.spark._jvm.org.apache.hadoop.fs.Path
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for df, path in self.paths:
            if not any(df is k for k in keep):
                path_of(path).getFileSystem(conf).delete(path_of(path), True)
        self.paths = [x for x in self.paths if any(x[0] is k for k in keep)]


def lower_ascii(col):
    """Lower-cases A-Z and leaves every other character as it is."""
    return F.translate(col, UPPER, LOWER)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string array with about `most` bytes each, at least one row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, size in enumerate(sizes):
        if i > lo and held + size > most:
            yield lo, i
            lo, held = i, 0
        held += int(size)
    if len(sizes) > lo:
        yield lo, len(sizes)


def raw(texts: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text, without decoding."""
    return texts.cast(pa.binary()).to_pylist()


def columns_of(batch: pa.RecordBatch, names: Iterable[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]
