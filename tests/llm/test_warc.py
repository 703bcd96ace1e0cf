"""Archives: the frame layout, exact round trips, revisits, odd rows."""

import hashlib
import io
import struct
from urllib.parse import urlparse

import zstandard

from maskloom.llm.common import fs_and_path, scratch
from maskloom.llm.warc_zstd import DICTIONARY_FRAME, OP4_SQL, mark_revisits, op4_warc, parse_record, read_archives, read_frames, write_archives

TYPE = "page_id long, url string, html string, payload string"
LONG = "<p>é long payload of more than one hundred bytes</p>" * 4


def test_round_trip_and_revisits(spark):
    rows = [(5, "http://a/ b\n", LONG), (2, None, LONG), (9, "u", LONG), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (None, "u", LONG), (2, "u", LONG), (7, "u", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], TYPE)
    manifest = write_archives(mark_revisits(df), scratch(spark, "t"))
    got = read_archives(manifest, with_payload=True).collect()
    assert len(got) == len(rows) == manifest.agg({"records": "sum"}).first()[0]
    by_size = {len((h or "").encode()): (h or "").encode() for _, _, h in rows}
    for r in got:
        want = by_size[r.payload_bytes]
        assert r.payload_digest == r.stored_digest == hashlib.sha256(want).hexdigest()
        assert r.payload == (want if r.record_type == "response" else None) or bytes(r.payload) == want
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got if r.payload_bytes == len(LONG.encode()))
    assert kinds == [(0, "response", None), (2, "response", None), (2, "response", None), (5, "revisit", 2), (9, "revisit", 2)]
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 100)


def test_layout(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    manifest = write_archives(mark_revisits(pages), scratch(spark, "t")).collect()
    fs, path = fs_and_path(manifest[0].archive)
    data = fs.open_input_stream(path).read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == DICTIONARY_FRAME
    d = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    frames = list(read_frames(io.BytesIO(data)))
    assert len(frames) == manifest[0].records
    at, content = frames[-1]
    alone = zstandard.ZstdDecompressor(dict_data=d).decompressobj().decompress(data[at:])  # readable by itself at its offset
    assert alone == content and parse_record(content)["WARC-Type"] == "response"
    assert urlparse(parse_record(content)["WARC-Target-URI"]).scheme


def test_matches_sql(spark, sf):
    from compare import same

    same(op4_warc(spark, sf), OP4_SQL, sf)


def test_empty(spark):
    df = spark.createDataFrame([], TYPE)
    assert read_archives(write_archives(mark_revisits(df), scratch(spark, "t"))).count() == 0
