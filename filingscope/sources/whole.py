"""Landed documents, a text file each: written by tasks, and read back whole.

With very many small files the driver should know none of them, and no file should be moved after it is written. So the
driver lists the folders directly under a path only; tasks list what is in them and read one file at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files of a folder that a task writes, loose files that a task reads, and bytes of text sent to Spark at once.
FOLDER_FILES, LOOSE_FILES, BATCH_BYTES = 2048, 2048, 4 << 20


def write_files(docs: DataFrame, path: str) -> None:
    """Writes each row (name, text) as a text file of its own, by its name, in one of the folders under path.

    The file's place comes from its task and its row there, so a task that runs again writes the same files, and rows of one
    name don't meet. docs should come from a scan, whose tasks have the same rows each time.
    """

    path = qualified(docs.sparkSession, path)

    def write(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        task, n, folder = TaskContext.get().partitionId(), 0, ""
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n % FOLDER_FILES == 0:
                    folder = f"{root}/{task:05d}-{n // FOLDER_FILES:05d}"
                    system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/{n % FOLDER_FILES:04d}-{name}") as file:
                    file.write((text or "").encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    docs.select("name", "text").mapInArrow(write, "n long").agg({"n": "sum"}).collect()  # one row


@dataclass
class Place(InputPartition):
    folder: str
    files: list


def _shown(info) -> bool:
    return not info.base_name.startswith(("_", "."))


class WholeReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str):
        self.names, self.path = schema.names, path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        own = system.get_file_info(root)
        if own.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [own] if own.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(root)) if _shown(x)]
        loose = [x.path for x in found if x.type == fs.FileType.File]
        parts = [Place(x.path, []) for x in found if x.type == fs.FileType.Directory]
        return parts + [Place("", loose[i : i + LOOSE_FILES]) for i in range(0, len(loose), LOOSE_FILES)] or [Place("", [])]

    def read(self, part: Place) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        at = urlsplit(self.path)
        paths, texts, size = [], [], 0

        def batch():
            columns = {"path": paths, "text": texts}
            return pa.RecordBatch.from_arrays([pa.array(columns[n], pa.string()) for n in self.names], names=self.names)

        for file in self.files(system, part):
            try:
                with system.open_input_stream(file) as stream:
                    text = stream.read().decode("utf-8", "replace")
            except OSError:
                continue
            paths.append(f"{at.scheme}://{at.netloc}{file}")
            texts.append(text)
            size += len(text)
            if size > BATCH_BYTES:
                yield batch()
                paths, texts, size = [], [], 0
        if paths:
            yield batch()

    def files(self, system, part: Place) -> Iterator[str]:
        from pyarrow import fs

        yield from part.files
        folders = [part.folder] if part.folder else []
        while folders:
            for x in system.get_file_info(fs.FileSelector(folders.pop())):
                if _shown(x) and x.type == fs.FileType.Directory:
                    folders.append(x.path)
                elif _shown(x):
                    yield x.path


class WholeFiles(DataSource):
    """Option: path, a file or a folder."""

    @classmethod
    def name(cls) -> str:
        return "wholefiles"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WholeReader(schema, dict(self.options)["path"])


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a URI, of Spark's default file system if it names none."""
    if "://" in path:
        return path
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub("^file:/(?!/)", "file:///", uri)


def openable(spark: SparkSession, path) -> str | None:
    """A path's URI if these readers can open it; globs, several paths, and stores that only Spark reads they can't."""
    from pyarrow import fs

    if not isinstance(path, str) or any(c in path for c in "*?[{"):
        return None
    try:
        fs.FileSystem.from_uri(uri := qualified(spark, path))
    except (pa.ArrowException, OSError):
        return None
    return uri


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the files under a URI; files that can't be read, and those whose names begin with _ or ., are left out."""
    spark.dataSource.register(WholeFiles)
    return spark.read.format("wholefiles").option("path", path).load()
