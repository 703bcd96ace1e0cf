"""Office packages built here, sinks, saved states, streams."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from maskloom.operators.rules import PROFILES
from maskloom.sources import ooxml, packages, sinks, tables
from maskloom.streaming.detection import detected_stream, grow_alias_book, windowed_counts

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = package(
    {
        "word/document.xml": f'<w:document {W}><w:body><w:p><w:r><w:t>Ann </w:t></w:r><w:r><w:t>Lee</w:t><w:tab/></w:r><w:hyperlink r:id="r1"><w:r><w:t>mail</w:t></w:r></w:hyperlink></w:p>'
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:ins w:id='1'/></w:body></w:document>",
        "word/_rels/document.xml.rels": REL.format('<Relationship Id="r1" Target="mailto:a@b.example"/>'),
        "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>head</w:t></w:r></w:p></w:hdr>",
        "word/comments.xml": f"<w:comments {W}/>",
        "docProps/core.xml": '<c xmlns:d="x"><d:creator>Eve</d:creator></c>',
    }
)
XLSX = package(
    {
        "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": REL.format('<Relationship Id="r1" Target="worksheets/sheet1.xml"/>'),
        "xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>氏名</t></si></sst>',
        "xl/worksheets/sheet1.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>',
    }
)


def files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(DOCX)
    (tmp_path / "b.xlsx").write_bytes(XLSX)
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.txt").write_text("no")
    return ooxml.read_files(spark, str(tmp_path))


def test_word_units_runs_and_features(spark, tmp_path):
    f = files(spark, tmp_path)
    assert f.count() == 3
    units = ooxml.text_units(f)
    got = {(r.container, r.story, r.text) for r in units.collect()}
    assert got == {("error", "BadZipFile", None), ("paragraph", "body", "Ann Lee\tmail"), ("table_cell", "body", "cell"), ("paragraph", "header", "head"), ("property", "creator", "Eve")}
    first = units.filter("text like 'Ann%'").first()
    assert [(r.char_start, r.char_end) for r in first.runs] == [(0, 4), (4, 8), (8, 12)]
    assert [r.url for r in ooxml.hyperlinks(units).collect()] == ["mailto:a@b.example"]
    found = {(r.feature, r["count"]) for r in ooxml.unsupported(ooxml.parts(f)).collect()}
    assert ("comments", 1) in found and ("tracked_insert", 1) in found


def test_sheet_cells(spark, tmp_path):
    got = {(r.coord, r.col, r.value, r.is_formula) for r in ooxml.cells(files(spark, tmp_path)).filter("value_type <> 'error'").collect()}
    assert got == {("A1", 1, "氏名", False), ("AB1", 28, "2", True)}


def test_audit_holds_no_originals(spark, tmp_path):
    f = spark.createDataFrame([("f1", 1, True, False, "name", "個人001", "山田太郎")], "finding_id string, page int, enabled boolean, excluded boolean, category string, replacement string, original string")
    sinks.write_audit(f, str(tmp_path / "audit"), b"key")
    text = spark.read.text(str(tmp_path / "audit")).first().value
    assert "山田" not in text and len(json.loads(text)["original_hmac_sha256"]) == 64
    u = spark.createDataFrame([("x", 2)], "feature string, count int")
    assert {r.metric: r.value for r in sinks.report(f, u).collect()}["unsupported"] == 2


def test_review_state_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "UNREVIEWED", "NONE")], "page int, review_state string, verification_state string")
    f = spark.createDataFrame([("f1", 1, True, "x", "secret")], "finding_id string, page int, enabled boolean, replacement string, original string")
    sinks.review_state(pages, f, "abc", b"k").write.text(str(tmp_path / "state"))
    p, g = tables.read_review_state(spark, str(tmp_path / "state"), "abc")
    assert p.first().page_review_state == "UNREVIEWED" and g.first().id == "f1"
    try:
        tables.read_review_state(spark, str(tmp_path / "state"), "other")
    except ValueError:
        return
    raise AssertionError("a state of another source must be refused")


def test_csv_and_split(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("﻿a,b\n1,2\n".encode())
    assert tables.read_csv(spark, str(tmp_path / "x.csv")).columns == ["a", "b"]
    (tmp_path / "s.json").write_text('{"dataset_version": "v", "dev": [1, 2], "val": [3]}')
    assert {(r.split, r.page) for r in tables.read_split(spark, str(tmp_path / "s.json")).collect()} == {("dev", 1), ("dev", 2), ("val", 3)}
    ok, bad = tables.quarantine(spark.createDataFrame([(1, True), (2, False)], "id int, signed boolean"), ["signed"])
    assert ok.first().id == 2 and bad.first().reasons == "signed"


def test_streamed_alias_book_grows(spark, tmp_path):
    src, book = str(tmp_path / "in"), str(tmp_path / "book")
    schema = "doc_id long, text string"
    for n, t in enumerate(["ip 10.0.0.1", "ip 10.0.0.2 and 10.0.0.1"]):
        spark.createDataFrame([(n, t)], schema).coalesce(1).write.mode("append").parquet(src)
        s = detected_stream(spark.readStream.schema(schema).parquet(src), PROFILES["plain"])
        grow_alias_book(s, book, str(tmp_path / "cp")).awaitTermination()
    got = {r.norm_key: r.alias_no for r in spark.read.parquet(f"{book}/v1").collect()}
    assert got == {"10.0.0.1": 1, "10.0.0.2": 2}


def test_windowed_counts(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert windowed_counts(e).agg(F.sum("n")).first()[0] == e.count()


P = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
SLIDE = f"<p:sld {P}><p:sp><a:p><a:r><a:t>Ann</a:t></a:r><a:r><a:t> Lee</a:t></a:r></a:p></p:sp><a:tbl><a:tr><a:tc><a:p><a:r><a:t>x</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p:sld>"
BAD_BOOK = package({"xl/worksheets/sheet1.xml": "<a/>"})


def test_slides_damaged_and_refused_files(spark, tmp_path):
    (tmp_path / "s.pptx").write_bytes(package({"ppt/slides/slide2.xml": SLIDE}))
    (tmp_path / "bad.xlsx").write_bytes(BAD_BOOK)
    (tmp_path / "m.docm").write_bytes(b"x")
    f = ooxml.read_files(spark, str(tmp_path))
    units = {(r.unit_id, r.text) for r in ooxml.text_units(f).collect()}
    assert units == {("shape_text:slide:2:None:None:None:0", "Ann Lee"), ("table_cell:slide:2:0:0:0:0", "x")}
    assert [(r.file_id, r.value_type, r.value) for r in ooxml.cells(f).collect()] == [("bad.xlsx", "error", "AttributeError")]
    assert [(r.file_id, r.reason) for r in ooxml.refused_files(spark, str(tmp_path)).collect()] == [("m.docm", "MACROS")]


def test_surfaces_and_unread_text(spark, tmp_path):
    f = files(spark, tmp_path)
    assert [(r.sheet, r.state, r.hidden_rows) for r in ooxml.surfaces(f).filter("kind = 'sheet'").collect()] == [("S", "visible", 0)]
    parts = spark.createDataFrame([("f", "word/footnotes.xml", "<w:t>a</w:t><w:t x>b</w:t>"), ("f", "word/document.xml", "<w:t>")], "file_id string, part string, content string")
    assert [(r.part, r.nodes) for r in ooxml.unread_text(parts).collect()] == [("word/footnotes.xml", 2)]


def test_edits_are_written_into_packages(spark, tmp_path):
    f = files(spark, tmp_path).filter("file_id <> 'c.docx'")
    edits = [("a.docx", "paragraph:body:0:None:None:None:0", 0, "X "), ("a.docx", "paragraph:body:0:None:None:None:0", 1, ""), ("a.docx", "paragraph:header:1:None:None:None:0", 0, "H"), ("b.xlsx", "S!A1", 0, "<名>")]
    out = packages.converted(f, spark.createDataFrame(edits, "file_id string, place string, run int, text string"))
    units = {r.unit_id: r.text for r in ooxml.text_units(out).collect()}
    assert units["paragraph:body:0:None:None:None:0"] == "X mail" and units["paragraph:header:1:None:None:None:0"] == "H" and units["table_cell:body:0:0:0:0:0"] == "cell"
    assert {(r.coord, r.value, r.is_formula) for r in ooxml.cells(out).collect()} == {("A1", "<名>", False), ("AB1", "2", True)}
    before, after = ({(r.file_id, r.part) for r in ooxml.parts(x).collect()} for x in (f, out))
    assert before == after


def test_finding_layouts_and_reports(spark):
    row = {"enabled": True, "status": "s", "sheet": "S", "cell": "A1", "location": "l", "page": 1, "category": "c", "detection": "d", "rule": "r", "confidence": 0.5, "original": "o", "replacement": "p", "reason": "w", "file_id": "f", "excluded": False}
    f = spark.createDataFrame([row])
    for kind, headers in sinks.LAYOUTS.items():
        assert sinks.finding_rows(f, kind).columns == list(headers)
        assert sinks.finding_rows(f, kind, review=True).columns[-2:] == ["問題分類", "期待値"]
    w = spark.createDataFrame([("f", "x"), ("g", "y")], "file_id string, text string")
    u = spark.createDataFrame([("f", 3)], "file_id string, count int")
    got = {r.file_id: (r.findings, r.enabled, r.warnings, r.unsupported) for r in sinks.file_reports(f, w, u).collect()}
    assert got == {"f": (1, 1, 1, 3), "g": (0, 0, 1, 0)}


def test_numbers_do_not_depend_on_the_job(spark, sf, tmp_path):
    from maskloom.storage import numbered, tidied

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    with tidied(spark) as kept:
        a = kept(numbered(docs.repartition(3), "uid", "t"))
    b = numbered(docs, "uid", "t")
    for df in (a, b):
        first = {r.doc_id: r.uid for r in df.collect()}
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        assert first == {r.doc_id: r.uid for r in df.collect()} and len(set(first.values())) == len(first)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
