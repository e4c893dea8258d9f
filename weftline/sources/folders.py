"""A folder of texts, one file for each row, written as a whole or not at all."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    part: str
    files: int


class TextFolder(DataSource):
    """Sink of (name, text) rows: `df.write.format("text_folder").mode(...).save(path)` after `spark.dataSource.register(TextFolder)`.

    Task n writes its rows as files of a folder `part-n-...`, named as the rows are, slashes as `__`; of equal names in a task, later ones get a number.
    Files are written under `_staging`; only once all tasks are done their folders are moved into place, each in one step, so a failed task or job leaves no file.
    `_manifest` has a JSON line for each file: name, file (its path in the folder), bytes and md5. Null texts are empty files; rows without name are called `untitled`.
    Mode overwrite replaces what the folder has; append adds to it. The folder must be one that all executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "text_folder"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if schema.names != ["name", "text"]:
            raise ValueError("a text folder takes the columns name and text")
        return _FolderWriter(self.options["path"], overwrite)


class _FolderWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _open(self) -> tuple[fs.FileSystem, str, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        root = root.rstrip("/")
        return files, root, f"{root}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _, staging = self._open()
        task = TaskContext.get()
        part = f"part-{task.partitionId():05d}-{self.job[:8]}-{task.taskAttemptId()}"  # an attempt that is given up shares no folder with the next one
        files.create_dir(f"{staging}/{part}")
        files.create_dir(f"{staging}/_manifest")
        taken: dict[str, int] = {}
        count = 0
        with files.open_output_stream(f"{staging}/_manifest/{part}.json") as manifest:
            for batch in iterator:
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    name = (name or "untitled").replace("/", "__")
                    again = taken.get(name, 0)
                    taken[name] = again + 1
                    if again:
                        stem, dot, kind = name.rpartition(".")
                        name = f"{stem}-{again}{dot}{kind}" if dot else f"{name}-{again}"
                    raw = (text or "").encode()
                    with files.open_output_stream(f"{staging}/{part}/{name}") as f:
                        f.write(raw)
                    manifest.write(json.dumps({"name": name, "file": f"{part}/{name}", "bytes": len(raw), "md5": hashlib.md5(raw).hexdigest()}).encode() + b"\n")
                    count += 1
        return Written(part, count)

    def commit(self, messages: list[Written | None]) -> None:
        files, root, staging = self._open()
        files.create_dir(f"{root}/_manifest")
        old = [x.path for x in files.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("part-")] if self.overwrite else []
        old += [x.path for x in files.get_file_info(fs.FileSelector(f"{root}/_manifest"))] if self.overwrite else []
        for m in messages:
            if m is not None and m.files:
                files.move(f"{staging}/{m.part}", f"{root}/{m.part}")
                files.move(f"{staging}/_manifest/{m.part}.json", f"{root}/_manifest/{m.part}.json")
        for path in old:
            (files.delete_dir if files.get_file_info(path).type == fs.FileType.Directory else files.delete_file)(path)
        files.delete_dir(staging)

    def abort(self, messages: list[Written | None]) -> None:
        files, _, staging = self._open()
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)


def write_folder(texts: DataFrame, path: str, mode: str = "append") -> None:
    """Writes (name, text) rows as files below `path`."""
    texts.sparkSession.dataSource.register(TextFolder)
    texts.select("name", "text").write.format("text_folder").mode(mode).save(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, file, bytes and md5 of every file of a folder."""
    return spark.read.schema("name string, file string, bytes long, md5 string").json(f"{path.rstrip('/')}/_manifest")
