"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class SharedTables:
    """Tables below spark.checkpoint.dir, for what several passes read: they cut lineage and outlive any executor.

    Where that setting is unset and all runs in one process, a local folder serves; elsewhere that fails.
    """

    def __init__(self, spark: SparkSession, name: str):
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            where = tempfile.mkdtemp(prefix="weftline-")
        self.spark = spark
        self.root = f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def delete(self) -> None:
        """Deletes all tables; nothing may read them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
