"""WARC archives as seekable Zstandard bundles: independent frames, a seek table at the end, an index of records."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.common import new_path, write_table

#: Fixed values of the seekable format: a skippable frame's magic number, the footer's magic number.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 64 << 20, 3
#: Compressed bytes that a task reads back.
READ_BYTES = 32 << 20
INDEX = "record_id string, page_id long, bundle string, frame int, frame_at long, frame_size long, frame_bytes long, offset long, length long"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _file(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(page_id, digest: str) -> str:
    """A stable identifier: the same page and payload have the same one."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id} {digest}'.encode()).digest()[:16], version=5)}"


def warc_record(page_id, url: str | None, payload: bytes, digest: str, leader, date: str) -> bytes:
    """One record. leader: the page_id of the response that a revisit repeats."""
    revisit = leader is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:unknown")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id, digest)}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <{record_id(leader, digest)}>", f"X-Refers-To-Page: {leader}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's headers (lower case), block and payload (of a response)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no WARC record: {version[:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return {"headers": headers, "block": block, "payload": block.partition(b"\r\n\r\n")[2]}


class Bundle:
    """Writes one seekable bundle; add() gives where a record stands."""

    def __init__(self, uri: str, frame_bytes: int, level: int):
        import zstandard

        files, path = _file(uri)
        self.uri, self.out, self.pack = uri, files.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frame_bytes, self.frames, self.at, self.buffer, self.size, self.rows = frame_bytes, [], 0, [], 0, []

    def add(self, name: str, page_id, record: bytes) -> list[tuple]:
        self.rows.append((name, page_id, self.size, len(record)))
        self.buffer.append(record)
        self.size += len(record)
        return self.flush() if self.size >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.buffer:
            return []
        packed = self.pack.compress(b"".join(self.buffer))
        self.out.write(packed)
        done = [(name, page, self.uri, len(self.frames), self.at, len(packed), self.size, at, n) for name, page, at, n in self.rows]
        self.frames.append((len(packed), self.size))
        self.at += len(packed)
        self.buffer, self.size, self.rows = [], 0, []
        return done

    def close(self) -> list[tuple]:
        done = self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        return done


def seek_table(uri: str) -> list[tuple[int, int, int]]:
    """(place, compressed size, size) of each frame, from the end of a bundle."""
    files, path = _file(uri)
    with files.open_input_file(path) as f:
        n, _, magic = struct.unpack("<IBI", f.read_at(9, f.size() - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        sizes = list(struct.iter_unpack("<II", f.read_at(8 * n, f.size() - 9 - 8 * n)))
    at, out = 0, []
    for packed, size in sizes:
        out.append((at, packed, size))
        at += packed
    return out


def write_archives(pages: DataFrame, folder: str | None = None, dedupe_bytes: int = 100, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", date: str = "2024-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL) -> DataFrame:
    """Writes a record per row to bundles in a shared folder and returns the index of what was written.

    Rows with equal payloads of at least dedupe_bytes: the smallest id's is a response, the others
    are revisits of it (rows that repeat that id are responses too; without any id all are). A null
    payload is empty, a null URL is urn:unknown. A task writes files of its own name, and the index is
    a written table: what a lost or repeated attempt left behind is in no index.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    leaders = rows.filter(F.length("payload") >= dedupe_bytes).groupBy("digest").agg(F.min("page_id").alias("leader"), F.count(F.lit(1)).alias("n"))
    # one row per repeated payload; a payload that many pages have is one large join key, which AQE splits
    leaders = write_table(leaders.filter("n > 1").drop("n"), "warc-leaders")
    typed = rows.join(leaders, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("leader") != F.col("page_id"), F.col("leader")).alias("leader"))
    typed = typed.withColumn("leader", F.when(F.col("page_id").isNull(), F.lit(None)).otherwise(F.col("leader")))

    def write(batches):
        bundle, done = None, []
        for batch in batches:
            for page_id, target, data, digest, leader in zip(*[c.to_pylist() for c in batch.columns]):
                bundle = bundle or Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst", frame_bytes, level)
                done += bundle.add(record_id(page_id, digest), page_id, warc_record(page_id, target, data, digest, leader, date))
                if bundle.at + bundle.size >= bundle_bytes:
                    done += bundle.close()
                    bundle = None
            if done:
                yield _index(done)
                done = []
        if bundle:
            done = bundle.close()
        if done:
            yield _index(done)

    files, path = _file(folder)
    files.create_dir(path, recursive=True)
    return write_table(typed.mapInArrow(write, INDEX), "warc-index")


def _index(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32()] + [pa.int64()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in INDEX.split(", ")])


def checked_bundles(index: DataFrame) -> DataFrame:
    """(bundle) of an index; an error if the seek table at a bundle's end has other frames than the index."""

    def check(batches):
        for batch in batches:
            for uri, at, size, full in zip(*[c.to_pylist() for c in batch.columns]):
                if sorted(zip(at, size, full)) != seek_table(uri):
                    raise ValueError(f"{uri}: the index and the seek table name different frames")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["bundle"])

    # a bundle's frames are bounded by its size
    frames = index.groupBy("bundle").agg(F.sort_array(F.collect_set(F.struct("frame_at", "frame_size", "frame_bytes"))).alias("f"))
    return frames.select("bundle", "f.frame_at", "f.frame_size", "f.frame_bytes").mapInArrow(check, "bundle string")


def read_archives(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of an index, each frame fetched and opened once by its place, which its bundle's seek table must confirm.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, record_id (and payload;
    null for revisits). A response's digest is computed anew and must equal its header's.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "payload"][: 6 + with_payload]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string" + ", payload binary" * with_payload

    def read(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for uri, at, size, offsets, lengths in zip(*[c.to_pylist() for c in batch.columns]):
                files, path = _file(uri)
                with files.open_input_file(path) as f:
                    data = unpack.decompress(f.read_at(size, at))
                out = []
                for offset, length in zip(offsets, lengths):
                    record = parse_record(data[offset : offset + length])
                    h = record["headers"]
                    revisit, digest = h["warc-type"] == "revisit", h["warc-payload-digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(record["payload"]).hexdigest() != digest:
                        raise ValueError(f"{h['warc-record-id']}: the payload is damaged")
                    n = int(h["x-payload-length"]) if revisit else len(record["payload"])
                    out.append((int(h["x-page-id"]) if h["x-page-id"] else None, n, digest, h["warc-type"], int(h["x-refers-to-page"]) if revisit else None, h["warc-record-id"].strip("<>"), None if revisit else record["payload"])[: 6 + with_payload])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    # a frame's records are bounded by its size; the index is small, so the number of tasks follows the archives' bytes
    packed = index.groupBy("bundle", "frame_at").agg(F.first("frame_size").alias("n")).agg(F.sum("n")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, packed // READ_BYTES + 1)
    frames = index.groupBy("bundle", "frame_at", "frame_size").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("r"))
    frames = frames.join(checked_bundles(index), "bundle").repartition(tasks, "bundle", "frame_at")
    return frames.select("bundle", "frame_at", "frame_size", "r.offset", "r.length").mapInArrow(read, schema)


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Writes all pages and reads the archives back."""
    return read_archives(write_archives(pages, **options))
