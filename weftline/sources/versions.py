"""Tables that are rewritten in place: each change is a new version with a manifest, and parts that stay are shared."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class VersionedTable:
    """A table in parts below `root`: the rows that one task wrote first, wherever their later versions lie.

    `versions/00000001.json` and so on are manifests: the schema, and the folder, rows and digest of each part. The highest number is the current version. A
    version is there once its manifest has been renamed into place, which fails where it exists, so readers see the old or the new one and of two writers
    one gets a Conflict. Data are never changed; `vacuum` deletes folders that no kept version names. All file access is through Hadoop's, so any shared folder serves.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # Manifests.

    def _name(self, version: int) -> str:
        return f"{self.root}/versions/{version:08d}.json"

    def versions(self) -> list[int]:
        where = self._path(f"{self.root}/versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "_")

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(self._name(version)))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        staged = self._path(f"{self.root}/versions/_{uuid.uuid4().hex}")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(self._path(self._name(version))) or not self._fs.rename(staged, self._path(self._name(version))):
            self._fs.delete(staged, False)
            raise Conflict(f"version {version} exists")

    # Data.

    def _read(self, manifest: dict) -> DataFrame:
        """All rows with _part."""
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.root}/{p['path']}" for p in manifest["parts"].values()]
        if not paths:
            return self.spark.createDataFrame([], StructType([*schema.fields, StructField("_part", IntegerType())]))
        return self.spark.read.schema(schema).parquet(*paths).withColumn("_part", F.regexp_extract("_metadata.file_path", r"/_part=(\d+)/", 1).cast("int"))

    def _digests(self, rows: DataFrame) -> dict[int, tuple[int, str]]:
        """Rows and a digest of each part, whatever the order of rows: a row for each part comes to the driver."""
        one = F.xxhash64(*[c for c in rows.columns if c != "_part"])
        parts = rows.groupBy("_part").agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.sum(F.shiftright(one, 32)).alias("s"))
        return {r._part: (r.n, f"{r.x}:{r.s}") for r in parts.collect()}

    def _save(self, rows: DataFrame) -> str:
        """Writes rows by _part where they are, without a shuffle."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.partitionBy("_part").parquet(f"{self.root}/{folder}")
        return folder

    @staticmethod
    def _entries(folder: str, digests: dict[int, tuple[int, str]]) -> dict[str, dict]:
        return {str(p): {"path": f"{folder}/_part={p}", "rows": n, "digest": d} for p, (n, d) in digests.items()}

    def create(self, df: DataFrame) -> int:
        """Version 1."""
        folder, schema = self._save(df.withColumn("_part", F.spark_partition_id())), df.schema.json()
        written = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}").withColumn("_part", F.regexp_extract("_metadata.file_path", r"/_part=(\d+)/", 1).cast("int"))
        self._publish(1, {"schema": schema, "parts": self._entries(folder, self._digests(written))})
        return 1

    def read(self, version: int | None = None) -> DataFrame:
        """A version, by default the current one; the table stays what it is while later versions are made."""
        return self._read(self._manifest(version or self.versions()[-1])).drop("_part")

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> int | None:
        """Makes `change(current table)` the next version, and returns its number, or None if it is the same table.

        `change` gets the rows with their _part, which it must keep with the other columns, and gives the same rows whenever it runs. Parts are told apart by rows and
        digest; only those that differ are written, and where none does nothing is.
        """
        version = self.versions()[-1]
        old = self._manifest(version)
        now = self._read(old)
        changed = change(now).select(*now.columns)
        digests = self._digests(changed)
        known = {int(p): (x["rows"], x["digest"]) for p, x in old["parts"].items()}
        fresh = {p: d for p, d in digests.items() if known.get(p) != d}
        if not fresh and digests.keys() == known.keys():
            return None
        kept = {p: x for p, x in old["parts"].items() if int(p) in digests and int(p) not in fresh}
        made = self._entries(self._save(changed.where(F.col("_part").isin(*fresh))), fresh) if fresh else {}
        self._publish(version + 1, {"schema": old["schema"], "parts": kept | made})
        return version + 1

    def update(self, columns: dict[str, Column]) -> int | None:
        """rewrite() with columns replaced row by row."""
        return self.rewrite(lambda df: df.withColumns(columns))

    def vacuum(self, keep: int = 1) -> int:
        """Drops all but the last `keep` versions and the folders that only those had; returns how many folders went. Nothing may read the dropped versions."""
        stay = self.versions()[-keep:]
        named = {p["path"] for v in stay for p in self._manifest(v)["parts"].values()}
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(self._name(v)), False)
        gone = 0
        for made in self._fs.listStatus(self._path(f"{self.root}/data")):
            parts = [s.getPath() for s in self._fs.listStatus(made.getPath()) if s.getPath().getName().startswith("_part=")]
            unused = [p for p in parts if f"data/{made.getPath().getName()}/{p.getName()}" not in named]
            for p in unused:
                self._fs.delete(p, True)
            gone += len(unused)
        return gone
