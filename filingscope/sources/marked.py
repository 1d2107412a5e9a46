"""A data source of landed text files whose records begin with a marker: filings' submissions, feeds of entries.

Files are planned in byte ranges, so one large file is read by many tasks; a record belongs to the range in which its
marker begins, and its reader goes on past the range's end. A task holds one record and a piece of the file at a time.
The schema says what leaves the reader: a column that is not asked for is neither extracted nor sent to Spark.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Columns that every record has.
OWN = {"file": T.StringType(), "start": T.LongType(), "text": T.StringType()}
PIECE, BATCH_BYTES = 1 << 20, 4 << 20


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def _files(path: str):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
    return system, [(x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]


def records(file, marker: bytes, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, record) of the records whose marker begins in a file's bytes from start to end."""
    file.seek(start)
    held, at, begin = b"", start, None  # held begins at `at`; begin: where the open record begins in held
    while True:
        piece = file.read(PIECE)
        looked = max(0, len(held) - len(marker) + 1)
        held += piece
        found = held.find(marker, looked if begin is None else max(looked, begin + len(marker)))
        while found >= 0:
            if begin is not None:
                yield at + begin, held[begin:found]
            if at + found >= end:
                return
            begin = found
            found = held.find(marker, begin + len(marker))
        if not piece:
            if begin is not None:
                yield at + begin, held[begin:]
            return
        # the open record stays, or what may be the beginning of a marker
        keep = begin if begin is not None else max(0, len(held) - len(marker) + 1)
        if begin is None and at + keep >= end:
            return
        held, at, begin = held[keep:], at + keep, None if begin is None else 0


class MarkedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names, self.path, self.marker = schema.names, options["path"], options["marker"].encode()
        self.split = int(options.get("splitbytes", 128 << 20))
        fields = json.loads(options.get("fields", "{}"))
        unknown = [n for n in self.names if n not in OWN and n not in fields]
        if unknown:
            raise ValueError(f"no pattern for the columns {unknown}")
        self.fields = {n: fields[n] for n in self.names if n in fields}

    def partitions(self) -> list[InputPartition]:
        ranges = [Range(file, a, min(a + self.split, size)) for file, size in _files(self.path)[1] for a in range(0, size, self.split)]
        return ranges or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        patterns = {n: re.compile(p, re.S) for n, p in self.fields.items()}
        kinds = {"start": pa.int64()}
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(self.names, zip(*rows))], names=self.names)

        with _files(self.path)[0].open_input_file(part.file) as file:
            for place, data in records(file, self.marker, part.start, part.end):
                text = data.decode("utf-8", "replace") if patterns or "text" in self.names else ""
                own = {"file": part.file, "start": place, "text": text}
                for name, pattern in patterns.items():
                    found = pattern.search(text)
                    own[name] = found[1] if found else None
                rows.append([own[n] for n in self.names])
                size += len(data)
                if size > BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class MarkedFiles(DataSource):
    """Options: path, marker, splitBytes, fields (JSON: column -> pattern whose first group is its value)."""

    @classmethod
    def name(cls) -> str:
        return "marked"

    def schema(self) -> T.StructType:
        fields = json.loads(self.options.get("fields", "{}"))
        return T.StructType([T.StructField(n, t) for n, t in OWN.items()] + [T.StructField(n, T.StringType()) for n in fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MarkedReader(schema, {k.lower(): v for k, v in dict(self.options).items()})


def scan_marked(spark: SparkSession, path: str, marker: str, columns: list[str] | None = None, fields: dict[str, str] | None = None, split_bytes: int = 128 << 20) -> DataFrame:
    """The records of the files under a path (a URI that driver and executors can open), with the columns asked for:
    file, start, text and those of fields. Files without a marker have no records; what stands before the first is left out."""
    spark.dataSource.register(MarkedFiles)
    kinds = OWN | {n: T.StringType() for n in fields or {}}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in columns or list(kinds)])
    reader = spark.read.format("marked").schema(schema).option("path", path).option("marker", marker).option("splitBytes", str(split_bytes))
    return reader.option("fields", json.dumps(fields or {})).load()


#: What a submission begins with, and where its header has the accession.
SUBMISSION, ACCESSION = "<SEC-DOCUMENT>", r"ACCESSION NUMBER:\s*(\S+)"
#: What a feed's entry begins with, and its parts.
ENTRY = "<entry>"
ENTRY_FIELDS = {
    "form": r"<title>\s*(.+?)\s+-\s+.+?\s+\(\d+\)", "name": r"<title>\s*.+?\s+-\s+(.+?)\s+\(\d+\)", "cik": r"<title>\s*.+?\s+-\s+.+?\s+\((\d+)\)",
    "date": r"Filed:\s*(?:</b>|&lt;/b&gt;)\s*(\d{4}-\d{2}-\d{2})", "link": r'<link[^>]*href="([^"]+)"',
}


def scan_submission_files(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int = 128 << 20) -> DataFrame:
    """Submissions of landed files: accession, text, file, start. scan_13f_submission_text() reads their holdings."""
    return scan_marked(spark, path, SUBMISSION, columns, {"accession": ACCESSION}, split_bytes)


def scan_feed_files(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int = 128 << 20) -> DataFrame:
    """Entries of landed Atom feeds: form, name, cik, date, link; those without a cik, name, date or link drop out."""
    needed = ["cik", "name", "date", "link"]
    wanted = columns or list(ENTRY_FIELDS)
    rows = scan_marked(spark, path, ENTRY, list(dict.fromkeys([*wanted, *needed])), ENTRY_FIELDS, split_bytes)
    return rows.na.drop(subset=needed).select(wanted)
