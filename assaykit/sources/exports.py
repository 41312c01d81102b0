"""A sink that writes one file for each row, for static sites: documents beside their assets.

Rows are (name, content). A task writes a hidden file and renames it to its name, so a file is whole or
not there, and an attempt that runs again or twice leaves the same files. What shows the folder to
readers is publishing it (see versions), after all tasks have ended.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .json_files import store

BATCH_BYTES = 16 << 20


@dataclass
class Count(WriterCommitMessage):
    files: int


class _Files(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        where, inner = store(self.path)
        made, n = set(), 0
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder, _, leaf = f"{inner}/{name}".rpartition("/")
                if folder not in made:
                    where.create_dir(folder, recursive=True)
                    made.add(folder)
                hidden = f"{folder}/.{leaf}.{uuid.uuid4().hex}"
                with where.open_output_stream(hidden) as f:
                    f.write(content or b"")
                where.move(hidden, f"{folder}/{leaf}")
                n += 1
        return Count(n)

    def commit(self, messages):
        where, inner = store(self.path)
        where.create_dir(inner, recursive=True)

    def abort(self, messages):
        where, inner = store(self.path)
        if where.get_file_info(inner).type == fs.FileType.Directory:
            where.delete_dir(inner)


class FileExport(DataSource):
    @classmethod
    def name(cls):
        return "file_export"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return _Files(self.options["path"])


def write(df: DataFrame, path: str) -> None:
    """The files of rows (name, content) under path, which must be new."""
    df.sparkSession.dataSource.register(FileExport)
    df.select("name", F.col("content").cast("binary")).write.format("file_export").option("path", path).mode("append").save()


def read(names: DataFrame, path: str) -> DataFrame:
    """name and content of the named files under path. Tasks open them; the driver, which a listing of them would fill, sees none."""

    def of(batches):
        where, inner = store(path)
        for batch in batches:
            told, contents, size = [], [], 0
            for name in batch.column(0).to_pylist():
                with where.open_input_stream(f"{inner}/{name}") as f:
                    contents.append(f.read())
                told.append(name)
                size += len(contents[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(told, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])
                    told, contents, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(told, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])

    return names.select("name").mapInArrow(of, "name string, content binary")
