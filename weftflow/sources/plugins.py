"""File formats of one's own, as Spark data sources whose writes appear as a whole or not at all.

A format is a subclass of Format with `encode` and `decode` over Arrow batches. `add_format` registers it with Spark and with READERS, so
that `files.read(spark, path, name)` reads it and `df.write.format(name).save(path)` writes it. Each file is a task when read, and each
task writes a file below `_staged`; the commit moves the files of the tasks that Spark chose into the folder, an abort deletes what was staged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .files import READERS


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of an address or a local path, and the path in it."""
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Format(DataSource):
    """What a format of files has to tell: its `name`, the `schema` of its rows, and how batches become bytes and come back."""

    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        """The bytes of a file, piece by piece."""
        raise NotImplementedError

    def decode(self, file: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        """The rows of a file, batch by batch, in the columns of the schema."""
        raise NotImplementedError

    def reader(self, schema: T.StructType) -> FileReader:
        return FileReader(self)

    def writer(self, schema: T.StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self, overwrite)


@dataclass
class File(InputPartition):
    path: str


class FileReader(DataSourceReader):
    def __init__(self, form: Format) -> None:
        self.form, self.path = form, form.options["path"]

    def partitions(self) -> list[File]:
        fs, at = file_system(self.path)
        info = fs.get_file_info(at)
        found = [info] if info.is_file else fs.get_file_info(pa.fs.FileSelector(at))
        return [File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        with file_system(self.path)[0].open_input_file(partition.path) as file:
            yield from self.form.decode(file)


@dataclass
class Staged(WriterCommitMessage):
    path: str


class FileWriter(DataSourceArrowWriter):
    def __init__(self, form: Format, overwrite: bool) -> None:
        self.form, self.path, self.overwrite = form, form.options["path"].rstrip("/"), overwrite
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        from pyspark import TaskContext

        fs, at = file_system(self.path)
        fs.create_dir(f"{at}/_staged/{self.run}")
        task = TaskContext.get()
        staged = f"{at}/_staged/{self.run}/{task.partitionId():06d}-{task.taskAttemptId()}"  # attempts have files of their own
        with fs.open_output_stream(staged) as out:
            for piece in self.form.encode(iterator):
                out.write(piece)
        return Staged(staged)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, at = file_system(self.path)
        before = [f.path for f in fs.get_file_info(pa.fs.FileSelector(at, allow_not_found=True)) if f.is_file] if self.overwrite else []
        for m in filter(None, messages):
            fs.move(m.path, f"{at}/part-{m.path.rpartition('/')[2].partition('-')[0]}-{self.run}")
        for old in before:
            fs.delete_file(old)
        self.clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear()

    def clear(self) -> None:
        fs, at = file_system(self.path)
        if fs.get_file_info(f"{at}/_staged/{self.run}").type != pa.fs.FileType.NotFound:
            fs.delete_dir(f"{at}/_staged/{self.run}")
        if fs.get_file_info(f"{at}/_staged").type != pa.fs.FileType.NotFound and not fs.get_file_info(pa.fs.FileSelector(f"{at}/_staged")):
            fs.delete_dir(f"{at}/_staged")


def add_format(spark: SparkSession, form: type[Format]) -> None:
    """Register a format with Spark and with the readers."""
    spark.dataSource.register(form)

    def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
        return spark.read.format(form.name()).options(**options).load(path)

    READERS[form.name()] = read
