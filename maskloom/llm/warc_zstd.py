"""A writer and reader of dictionary-compressed WARC archives.

Each archive begins with a skippable frame (magic number 0x184D2A5D) that holds a Zstandard dictionary built from
the archive's own first records; then every record is a frame of its own, compressed with that dictionary, so that
any record can be read at its offset. Equal payloads of some size are stored once: the row with the smallest id is
the response, the others are revisit records that name it.

Archives go to a folder that all executors share. A task writes under names of its own and reports them in its
rows; the manifest is a table that Spark commits, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fs_and_path, materialize, scratch

DICTIONARY_FRAME = 0x184D2A5D
SAMPLE_BYTES = 4 << 20  # of an archive's first records, for its dictionary
DICTIONARY_BYTES = 112 << 10
ARCHIVE_BYTES = 32 << 20  # compressed; an archive is closed beyond that
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records long, bytes long, dictionary_bytes long"
RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "url string, archive string, record_offset long, stored_digest string"
)


def mark_revisits(pages: DataFrame, min_bytes: int = 100, id_col: str = "page_id") -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to): which rows repeat the payload of a smaller id.

    Only ids and digests are aggregated, on the map side first; the join on the digest may be split where one
    payload has many rows. Rows with a null id, payloads under ``min_bytes`` and rows that repeat the smallest id
    itself are responses.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    first = rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    first = first.filter(F.col("first") < F.col("last")).select("digest", "first")
    out = rows.join(first, "digest", "left")
    refers = F.when((F.col("first") < F.col("page_id")), F.col("first"))
    return out.select(
        "page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "size", "digest", refers.alias("refers_to")
    )


def _urn(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def record_bytes(page_id, url, payload, size: int, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit (payload None) has the HTTP header only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is not None:
        head.append(f"X-Row-Id: {page_id}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"X-Refers-To-Row-Id: {refers_to}"]
    head += [f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A trained dictionary; of too few records for training, their own bytes; of none, nothing."""
    total = sum(map(len, records))
    if not total:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 10)), records, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Buffers the first records for the dictionary, then compresses each record into a frame of its own."""

    def __init__(self, folder: str, level: int):
        self.name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.level, self.waiting, self.waiting_bytes, self.out = level, [], 0, None
        self.records = self.written = self.dictionary_bytes = 0

    def _begin(self) -> None:
        fs, path = fs_and_path(self.name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path)
        d = build_dictionary(self.waiting)
        raw = d.as_bytes() if d else b""
        self.dictionary_bytes = len(raw)
        packed = zstandard.ZstdCompressor(level=self.level).compress(raw)
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=d, write_checksum=True)
        for r in self.waiting:
            self._put(self.compressor.compress(r))
        self.waiting = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.out is None:
            self.waiting.append(record)
            self.waiting_bytes += len(record)
            if self.waiting_bytes >= SAMPLE_BYTES:
                self._begin()
        else:
            self._put(self.compressor.compress(record))

    def close(self) -> tuple[str, int, int, int]:
        if self.out is None:
            self._begin()
        self.out.close()
        return self.name, self.records, self.written, self.dictionary_bytes


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write rows of ``mark_revisits`` as archives below ``folder``; the manifest of finished archives."""

    def write(batches):
        writer, done = None, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                writer = writer or ArchiveWriter(folder, level)
                page, refers = (None if pd.isna(x) else int(x) for x in (r.page_id, r.refers_to))
                writer.add(record_bytes(page, r.url, r.payload, int(r.size), r.digest, refers, date))
                if writer.written >= ARCHIVE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        yield pd.DataFrame(done, columns=["archive", "records", "bytes", "dictionary_bytes"])

    return materialize(rows.mapInPandas(write, MANIFEST), "warc-manifest")


def read_frames(stream: io.BufferedIOBase):
    """(offset, content) of every frame after the dictionary frame, one frame in memory at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive has no leading dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(stream.read(size))
    d = zstandard.ZstdCompressionDict(raw) if raw else None
    context = zstandard.ZstdDecompressor(dict_data=d)
    at, rest = 8 + size, b""
    while True:
        rest = rest or stream.read(1 << 16)
        if not rest:
            return
        frame, parts, used = context.decompressobj(), [], 0
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                used += len(rest) - len(frame.unused_data)
                rest = frame.unused_data
                break
            used += len(rest)
            rest = stream.read(1 << 16)
            if not rest:
                raise ValueError("the archive ends within a record")
        yield at, b"".join(parts)
        at += used


def parse_record(content: bytes) -> dict:
    """Named fields of one record, and its payload (None for a revisit)."""
    head, _, body = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = body[: int(fields["Content-Length"])]
    fields["payload"] = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    return fields


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the manifest's archives; digests and sizes of responses are taken from what is read."""

    def read(batches):
        for pdf in batches:
            for name in pdf["archive"]:
                fs, path = fs_and_path(name)
                rows = []
                with fs.open_input_stream(path) as stream:
                    for at, content in read_frames(stream):
                        f = parse_record(content)
                        payload, stored = f["payload"], f["WARC-Payload-Digest"].partition(":")[2]
                        size = int(f["X-Payload-Length"]) if payload is None else len(payload)
                        digest = stored if payload is None else hashlib.sha256(payload).hexdigest()
                        page, refers = (int(f[k]) if k in f else None for k in ("X-Row-Id", "X-Refers-To-Row-Id"))
                        row = (page, size, digest, f["WARC-Type"], refers, f.get("WARC-Target-URI"), name, at, stored)
                        rows.append((*row, payload) if with_payload else row)
                        if len(rows) == 1000:
                            yield table(rows)
                            rows = []
                yield table(rows)

    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload
    whole = {"page_id": "Int64", "refers_to": "Int64"}

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype(whole)

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInPandas(read, RECORDS + (", payload binary" if with_payload else ""))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: archive all pages, read the archives back, one row per page.

    A null html is an empty payload; a null url leaves the field out. No rows in: no archives and no rows out. Extra
    columns are ignored.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(mark_revisits(pages), scratch(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, url, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
