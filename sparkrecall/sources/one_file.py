"""Small artifacts as one plain file: a Python data source whose tasks write their
lines beside the target and whose commit joins them, in partition order, into one
file that replaces the target by a rename. A write that fails leaves the old file.

For tables whose size does not grow with the corpus (a run's summary, configuration,
report): the commit reads the task files in pieces on the driver and refuses more than
``MAX_BYTES``. Larger tables are written as folders. The target must be on storage that
all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "onefile"
MAX_BYTES = 64 << 20
_PIECE = 1 << 20


def file_system(uri: str):
    """pyarrow file system and path of a file given as a path or URI."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


@dataclass
class TaskFile(WriterCommitMessage):
    partition: int
    path: str
    size: int


class OneFileWriter(DataSourceWriter):
    def __init__(self, target: str, header: str | None):
        self.target, self.header = target.rstrip("/"), header
        self.staging = f"{self.target}.{uuid.uuid4().hex}.tmp"

    def write(self, iterator: Iterator[Row]) -> TaskFile:
        from pyspark import TaskContext
        task = TaskContext.get()
        disk, folder = file_system(self.staging)
        disk.create_dir(folder, recursive=True)
        path, size = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}", 0
        with disk.open_output_stream(path) as out:
            for row in iterator:
                line = (row[0] + "\n").encode()
                size += len(line)
                out.write(line)
        return TaskFile(task.partitionId(), path, size)

    def commit(self, messages: list[TaskFile | None]) -> None:
        disk, target = file_system(self.target)
        _, folder = file_system(self.staging)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        total = sum(m.size for m in parts)
        if total > MAX_BYTES:
            raise ValueError(f"{total} bytes are too many for the one file {self.target}; write a folder")
        disk.create_dir(folder, recursive=True)
        with disk.open_output_stream(f"{folder}/whole") as out:
            if self.header is not None:
                out.write((self.header + "\n").encode())
            for m in parts:
                with disk.open_input_stream(m.path) as part:
                    while piece := part.read(_PIECE):
                        out.write(piece)
        info = disk.get_file_info(target)
        if info.type.name == "Directory":  # an earlier output of Spark's own writers
            disk.delete_dir(target)
        disk.move(f"{folder}/whole", target)
        disk.delete_dir(folder)

    def abort(self, messages: list[TaskFile | None]) -> None:
        disk, folder = file_system(self.staging)
        if disk.get_file_info(folder).type.name == "Directory":
            disk.delete_dir(folder)


class OneFileSource(DataSource):
    """``format("onefile")``: one string column, a line per row; option ``header``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> OneFileWriter:
        if not overwrite:
            raise ValueError("a one-file artifact is written whole: use mode 'overwrite'")
        return OneFileWriter(self.options["path"], self.options.get("header"))


def write_lines(lines: DataFrame, path: str, header: str | None = None) -> None:
    """``lines`` (one string column) as the file ``path``, in partition order."""
    lines.sparkSession.dataSource.register(OneFileSource)
    w = lines.write.format(FORMAT).mode("overwrite")
    (w if header is None else w.option("header", header)).save(path)


def write_json_file(df: DataFrame, path: str) -> None:
    """A JSON object per row, one per line."""
    write_lines(df.select(F.to_json(F.struct("*")).alias("value")), path)


def write_csv_file(df: DataFrame, path: str, options: dict[str, str] | None = None) -> None:
    """CSV with a header of the column names."""
    write_lines(df.select(F.to_csv(F.struct("*"), options or {}).alias("value")), path, ",".join(df.columns))
