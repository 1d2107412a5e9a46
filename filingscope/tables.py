"""Tables in the folder that the driver and all executors share: written once, read by several plans, deleted after use."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one on a local master."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="filingscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writers, _scopes = threading.Lock(), [], threading.local()


@contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """While any thread writes a table, finished plans' shuffle files are deleted; the last one restores the setting."""
    with _lock:
        if not _writers:
            _writers.append(spark.conf.get(CLEANUP))
            spark.conf.set(CLEANUP, "true")
        _writers.append(None)
    try:
        yield
    finally:
        with _lock:
            _writers.pop()
            if len(_writers) == 1:
                spark.conf.set(CLEANUP, _writers.pop())


def write_table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends here, and a lost executor loses nothing.

    The shuffle files of its plan, which nothing reads later, are deleted once it is written.
    by is a column of few values that deals the rows out to folders.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    for made in getattr(_scopes, "made", []):
        made.append(path)
    with _without_shuffle_files(spark):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_alone(make, name: str, spark: SparkSession) -> DataFrame:
    """The table of make(), a function that gives a DataFrame; all other tables that it writes on the way are deleted."""
    scopes = _scopes.made = getattr(_scopes, "made", [])
    scopes.append(made := [])
    try:
        out = write_table(make(), name)
        for path in made[:-1]:
            _delete(spark, path)
    finally:
        scopes.remove(made)
    return out


def drop_table(*tables: DataFrame) -> None:
    """Deletes the files of tables of write_table() that no later plan reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            _delete(df.sparkSession, file.rsplit("/", 1)[0])
