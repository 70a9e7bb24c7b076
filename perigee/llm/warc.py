"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that are compressed independently; a bundle is frames and a seek table, in a skippable frame
at its end, of their sizes and checksums (the public seekable format, which any Zstandard reader takes). An index maps each
record's identifier to its bundle and frame, and to its place inside the frame, so that one record costs one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
import zstandard
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh
from .shared import delete, discard, materialize, small_side, tidy

#: Bytes of records from which a frame is closed, and of a file from which a bundle is.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
#: Bytes of records that a reading task gets.
READ_BYTES = 64 << 20
#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 0
#: Fixed values of the format: the skippable frame of a seek table, its end, and the flag of checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Layout of a seek table's end and of its entries.
TAIL, ENTRY = "<IBI", "<III"
INDEX = "page_id bigint, record_id string, bundle string, frame int, at bigint, length bigint"
FRAMES = "bundle string, frame int, start bigint, packed bigint, size bigint, checksum bigint"
RECORDS = "page_id bigint, record_id string, record_type string, refers_to bigint, uri string, declared string, payload_bytes bigint, payload_digest string, payload binary, bundle string, frame int"


class Archive(NamedTuple):
    """folder holds the bundles; index (INDEX) is a written table of their records."""

    folder: str
    index: DataFrame


def digest_of(payload: bytes) -> str:
    """The bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    number = identifier[len("<urn:x-page:") : -1]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None, date: str) -> bytes:
    """One record: a response with the payload, or a revisit with the header of one alone."""
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or record_id(page_id)[1:-1])
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The header, block and end of the record at a place."""
    cut = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:cut].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    header = dict(line.split(": ", 1) for line in lines)
    end = cut + 4 + int(header["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut")
    return header, data[cut + 4 : end], end + 4


class BundleWriter:
    """Writes records to bundles in a folder, as many as they fill. The names are new, so a task that runs twice never meets
    its first attempt's; files of attempts that failed are in no index."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int) -> None:
        self.fs, self.base = FileSystem.from_uri(folder)
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.out, self.held, self.frames, self.size, self.name = None, bytearray(), [], 0, ""

    def add(self, data: bytes) -> tuple[str, int, int]:
        """The bundle, frame and place inside the frame that the record got."""
        if self.out is None:
            self.name, self.frames, self.size = f"{uuid.uuid4().hex}.warc.zst", [], 0
            self.fs.create_dir(self.base, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None)
        where = self.name, len(self.frames), len(self.held)
        self.held += data
        if len(self.held) >= self.frame_bytes:
            self._frame()
            if self.size >= self.bundle_bytes:
                self.close()
        return where

    def _frame(self) -> None:
        data = bytes(self.held)
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.size += len(packed)
        self.held.clear()

    def close(self) -> None:
        if self.out is None:
            return
        if self.held:
            self._frame()
        table = b"".join(struct.pack(ENTRY, *f) for f in self.frames) + struct.pack(TAIL, len(self.frames), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.out = None


def write_archive(pages: DataFrame, least_bytes: int = LEAST_BYTES, date: str = "2024-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> Archive:
    """Writes a record for every row of pages (page_id, url, html) to a new folder in the shared one.

    Of rows with equal payloads of at least least_bytes, that of the largest page_id is a response and the others are revisits
    of it. Rows that share both payload and largest page_id are one capture, repeated: each is a response. A null html is an
    empty payload; a null url is replaced by the record's own name; a null page_id is smaller than any other. An empty table
    gives no bundle. Other columns are ignored.

    Digests alone are gathered by payload, each row's partial result first; the pages are met by a broadcast of the repeated
    payloads if these are few (small_side), else by one join, whose hot payload Spark splits. A task writes its rows as they
    come, a frame at a time. The folder is one that pyarrow opens (file, hdfs, s3, gs, abfs).
    """
    spark, folder = pages.sparkSession, fresh(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload")).withColumns({"sha": F.sha1("payload"), "n": F.octet_length("payload")})
    shared = rows.where(F.col("n") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("sha", "first")
    shared = materialize(shared)
    revisit = F.col("held") & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.join(small_side(shared.withColumn("held", F.lit(True))), "sha", "left").select("page_id", "url", "payload", "sha", F.coalesce(revisit, F.lit(False)).alias("revisit"), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, frame_bytes, bundle_bytes)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for page_id, url, data, sha, again, first in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    made = record(page_id, url, data, base64.b32encode(bytes.fromhex(sha)).decode(), again, first, date)
                    out.append((page_id, record_id(page_id), *writer.add(made), len(made)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], INDEX.replace(",", "").split()[::2])
        writer.close()

    index = materialize(rows.mapInArrow(tidy(run), INDEX))
    discard(shared)
    return Archive(folder, index)


def _tables(bundles: DataFrame, folder: str) -> DataFrame:
    """FRAMES of each bundle, read from the seek tables at their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(folder)
        tail, entry = struct.calcsize(TAIL), struct.calcsize(ENTRY)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{name}") as f:
                    size = f.size()
                    n, flags, magic = struct.unpack(TAIL, f.read_at(tail, size - tail))
                    if magic != SEEKABLE or flags != CHECKSUMS:
                        raise ValueError(f"{name} has no seek table")
                    entries = list(struct.iter_unpack(ENTRY, f.read_at(n * entry, size - tail - n * entry)))
                starts = [0]
                for packed, _, _ in entries:
                    starts.append(starts[-1] + packed)
                columns = [[name] * n, range(n), starts[:-1], *zip(*entries, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), *[pa.int64()] * 4), strict=True)], FRAMES.replace(",", "").split()[::2])

    return bundles.mapInArrow(run, FRAMES)


def _opened(fs, base: str, bundle: str, start: int, packed: int, size: int, checksum: int) -> bytes:
    with fs.open_input_file(f"{base}/{bundle}") as f:
        data = zstandard.ZstdDecompressor().decompress(f.read_at(packed, start), max_output_size=size)
    if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
        raise ValueError(f"a frame of {bundle} at {start} is damaged")
    return data


def _row(header: dict[str, str], block: bytes, payload: bool) -> tuple:
    kind, body = header["WARC-Type"], block[block.index(b"\r\n\r\n") + 4 :]
    refers = header.get("WARC-Refers-To")
    own = (len(body), digest_of(body), body if payload else None) if kind == "response" else (None, None, None)
    return (page_of(header["WARC-Record-ID"]), header["WARC-Record-ID"], kind, page_of(refers) if refers else None, header["WARC-Target-URI"], header["WARC-Payload-Digest"].removeprefix("sha1:"), *own)


_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int32()]


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], RECORDS.replace(",", "").split()[::2])


def frames_of(archive: Archive) -> DataFrame:
    """FRAMES of all bundles that the index names, as a written table."""
    names = archive.index.select("bundle").distinct()
    return materialize(_tables(names, archive.folder))


def read_archive(archive: Archive, payload: bool = True) -> DataFrame:
    """Every record of the archive (RECORDS): frames are found by the seek tables and read in any order, each once.

    payload_bytes, payload_digest and, with payload, payload are those of what a response holds, null in a revisit; declared
    is the digest that the record's header names. A frame whose checksum is wrong, and a record that is cut, are errors.
    """
    folder, frames = archive.folder, frames_of(archive)
    size = frames.agg(F.sum("size")).first()[0] or 0
    parts = max(frames.sparkSession.sparkContext.defaultParallelism, -(-size // READ_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(folder)
        for batch in batches:
            for bundle, frame, *where in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data, at, out = _opened(fs, base, bundle, *where), 0, []
                while at < len(data):
                    header, block, at = parsed(data, at)
                    out.append((*_row(header, block, payload), bundle, frame))
                yield _records(out)

    return frames.repartition(parts, "bundle", "frame").mapInArrow(tidy(run), RECORDS)


def fetch(archive: Archive, ids: DataFrame) -> DataFrame:
    """The records (RECORDS, with payloads) of ids (record_id): the index gives the frame and the place inside it.

    Of a frame only those records are parsed. An id that is not in the archive gives no row; a repeated one counts once.
    """
    folder = archive.folder
    wanted = archive.index.join(ids.select("record_id").distinct(), "record_id").join(frames_of(archive), ["bundle", "frame"])
    wanted = wanted.groupBy("bundle", "frame", "start", "packed", "size", "checksum").agg(F.sort_array(F.collect_list("at")).alias("places"))  # bounded by a frame

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(folder)
        for batch in batches:
            for bundle, frame, *where, places in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = _opened(fs, base, bundle, *where)
                yield _records([(*_row(*parsed(data, at)[:2], True), bundle, frame) for at in places])

    return wanted.mapInArrow(run, RECORDS)


def remove_strays(archive: Archive) -> int:
    """Deletes files in the folder that the index does not name, which failed attempts left; gives their number."""
    fs, base = FileSystem.from_uri(archive.folder)
    if fs.get_file_info(base).type == FileType.NotFound:
        return 0
    from pyarrow.fs import FileSelector

    named = {r["bundle"] for r in archive.index.select("bundle").distinct().toLocalIterator()}
    strays = [f.path for f in fs.get_file_info(FileSelector(base)) if f.base_name not in named]
    for path in strays:
        fs.delete_file(path)
    return len(strays)


def report(archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, from the archive alone, as a written table.

    A revisit's payload is looked up at the response it refers to; a revisit whose response is not there, or has another
    digest than it declares, has a null payload_bytes and payload_digest.
    """
    rows = materialize(read_archive(archive, payload=False).select("page_id", "record_type", "refers_to", "declared", "payload_bytes", "payload_digest"))
    told, again = rows.where("record_type = 'response'"), rows.where("record_type = 'revisit'")
    asked = again.select(F.col("refers_to").alias("asked"), F.col("declared").alias("asked_digest")).distinct()
    there = told.where("declared = payload_digest").select(F.col("page_id").alias("to"), F.col("declared").alias("to_digest"), "payload_bytes", "payload_digest").distinct()
    there = materialize(there.join(asked, F.expr("`to` <=> asked and to_digest = asked_digest"), "left_semi"))
    again = again.select("page_id", "record_type", "refers_to", "declared").join(small_side(there), F.expr("refers_to <=> `to` and declared = to_digest"), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    out = materialize(told.select(*columns).unionByName(again.select(*columns)))
    discard(rows, there)
    return out


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    out = report(archive)
    discard(archive.index)
    delete(spark, [archive.folder])
    return out


_FIVE = ", ".join(f"CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT)" for i in range(8))
OP12_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform([{_FIVE}], lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
  || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
"""
