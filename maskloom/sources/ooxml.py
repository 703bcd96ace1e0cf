"""Office packages as tables: parts, cells, paragraphs, runs, links, properties, features that are not handled.

Files are read as bytes by Spark and taken apart by the standard library, one file at a time within a task; a
damaged file gives one row of kind ``error`` and hides no other file.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NS = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "p": "http://schemas.openxmlformats.org/presentationml/2006/main",
    "s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
}
W, A, P, S, R = ("{" + NS[k] + "}" for k in "wapsr")
KINDS = ("docx", "pptx", "xlsx", "xlsm")
DAMAGED = (zipfile.BadZipFile, ET.ParseError, KeyError, IndexError, AttributeError, TypeError, ValueError)

# What in a package is counted as not handled, by part name or by marker in its text.
PART_FEATURES = (
    ("macro", r"vbaProject\.bin$"), ("embedding", r"/embeddings/"), ("custom_xml", r"^customXml/"), ("comments", r"/comments[^/]*\.xml$"),
    ("footnotes", r"/footnotes\.xml$"), ("endnotes", r"/endnotes\.xml$"), ("chart", r"/charts/"), ("diagram", r"/diagrams/"),
    ("pivot", r"/pivot"), ("external_link", r"/externalLinks/"),
)
TEXT_FEATURES = (("tracked_insert", "<w:ins "), ("tracked_delete", "<w:del "), ("text_box", "<w:txbxContent"), ("field_code", "<w:instrText"), ("drawing", "<w:drawing"))
PROPERTIES = (
    "creator", "category", "description", "contentStatus", "identifier", "keywords", "language", "lastModifiedBy", "subject", "title", "version",
)
UNITS = (
    "file_id string, unit_id string, unit_ord long, container string, story string, section int, table_idx int, row_idx int, cell_idx int, "
    "para_idx int, text string, runs array<struct<run_index:int,char_start:int,char_end:int,text:string,url:string>>"
)
CELLS = "file_id string, sheet string, sheet_ord int, row int, col int, coord string, value_type string, value string, is_formula boolean, formula string"
PARTS = "file_id string, part string, size long, content string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, kind, sha256, content) of office files below a path; other kinds are left out."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    return b.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file_id"), kind.alias("kind"), F.sha2("content", 256).alias("sha256"), "content").filter(kind.isin(*KINDS))


def refused_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, kind, reason) of files below a path that are not read: with macros, or of another kind."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    reason = F.when(kind.isin("docm", "pptm"), "MACROS").when(kind == "", "NO_EXTENSION").otherwise("OTHER_KIND")
    return b.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file_id"), kind.alias("kind"), reason.alias("reason")).filter(~kind.isin(*KINDS))


def _xml(z: zipfile.ZipFile, name: str):
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    rels = _xml(z, posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels"))
    return {} if rels is None else {e.get("Id"): e.get("Target") for e in rels}


def _runs(parent, texts, rels, link=None):
    """(text, url) of the runs of a paragraph, those of links included."""
    for child in parent:
        if child.tag == W + "hyperlink":
            yield from _runs(child, texts, rels, rels.get(child.get(R + "id")))
        elif child.tag in (W + "r", A + "r", A + "fld"):
            out = []
            for x in child:
                if x.tag in texts:
                    out.append(x.text or "")
                elif x.tag == W + "tab":
                    out.append("\t")
                elif x.tag in (W + "br", W + "cr"):
                    out.append("\n")
            yield "".join(out), link
        elif child.tag == A + "br":
            yield "\n", None


def _unit(file_id, ordinal, container, story, place, runs):
    at, rows = 0, []
    for i, (text, url) in enumerate(runs):
        rows.append({"run_index": i, "char_start": at, "char_end": at + len(text), "text": text, "url": url})
        at += len(text)
    section, table, row, cell, para = place
    ident = ":".join(map(str, (container, story, *place)))
    return (file_id, ident, ordinal, container, story, section, table, row, cell, para, "".join(r["text"] for r in rows), rows)


def _word_body(body, story, section, rels):
    """(container, place, runs) of paragraphs, in order; cells of tables inside tables follow their own table."""
    texts = (W + "t",)
    para = table = 0
    for child in body:
        if child.tag == W + "p":
            yield "paragraph", (section, None, None, None, para), list(_runs(child, texts, rels))
            para += 1
        elif child.tag == W + "tbl":
            for r, tr in enumerate(child.findall("w:tr", NS)):
                for c, tc in enumerate(tr.findall("w:tc", NS)):
                    for i, p in enumerate(tc.findall(".//w:p", NS)):
                        yield "table_cell", (section, table, r, c, i), list(_runs(p, texts, rels))
            table += 1


def word_units(file_id: str, data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        n = 0
        names = ["word/document.xml", *sorted(x for x in z.namelist() if re.fullmatch(r"word/(?:header|footer)\d*\.xml", x))]
        for name in names:
            root = _xml(z, name)
            if root is None:
                continue
            body = root.find("w:body", NS) if name.endswith("document.xml") else root
            story = "body" if name.endswith("document.xml") else re.sub(r"\d*\.xml$", "", posixpath.basename(name))
            section = int("0" + re.sub(r"\D", "", posixpath.basename(name)))
            for container, place, runs in _word_body(body, story, section, _relations(z, name)):
                yield _unit(file_id, n, container, story, place, runs)
                n += 1
        yield from _properties(file_id, z, n)


def _properties(file_id, z, n):
    """Core properties with a text, so that they pass the same detector."""
    core = _xml(z, "docProps/core.xml")
    for i, e in enumerate(core if core is not None else ()):
        if e.tag.rpartition("}")[2] in PROPERTIES and e.text and e.text.strip():
            yield _unit(file_id, n + i, "property", e.tag.rpartition("}")[2], (0, None, None, None, i), [(e.text, None)])


def slide_units(file_id: str, data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        n = 0
        slides = sorted((x for x in z.namelist() if re.fullmatch(r"ppt/(?:slides/slide|notesSlides/notesSlide)\d+\.xml", x)), key=lambda x: (int(re.sub(r"\D", "", posixpath.basename(x))), x))
        for name in slides:
            index = int(re.sub(r"\D", "", posixpath.basename(name)))
            story = "notes" if "notes" in name else "slide"
            root, rels = _xml(z, name), _relations(z, name)
            tables = list(root.iter(A + "tbl"))
            inside = {id(p) for t in tables for p in t.iter(A + "p")}
            for i, p in enumerate(x for x in root.iter(A + "p") if id(x) not in inside):
                yield _unit(file_id, n, "shape_text", story, (index, None, None, None, i), list(_runs(p, (A + "t",), rels)))
                n += 1
            for t, tbl in enumerate(tables):
                for r, tr in enumerate(tbl.findall("a:tr", NS)):
                    for c, tc in enumerate(tr.findall("a:tc", NS)):
                        for i, p in enumerate(tc.iter(A + "p")):
                            yield _unit(file_id, n, "table_cell", story, (index, t, r, c, i), list(_runs(p, (A + "t",), rels)))
                            n += 1
        yield from _properties(file_id, z, n)


def sheet_cells(file_id: str, data: bytes):
    """Cells with their formula and cached value; strings are looked up in the shared table."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = _xml(z, "xl/sharedStrings.xml")
        strings = ["".join(t.text or "" for t in si.iter(S + "t")) for si in shared] if shared is not None else []
        book, rels = _xml(z, "xl/workbook.xml"), _relations(z, "xl/workbook.xml")
        for order, sheet in enumerate(book.iter(S + "sheet")):
            root = _xml(z, posixpath.normpath(posixpath.join("xl", rels[sheet.get(R + "id")])))
            for c in root.iter(S + "c") if root is not None else ():
                kind, v, f = c.get("t", "n"), c.find("s:v", NS), c.find("s:f", NS)
                value = v.text if v is not None else None
                if kind == "s" and value is not None:
                    value = strings[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(S + "t"))
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                col = 0
                for ch in letters:
                    col = col * 26 + ord(ch) - 64
                name = {"s": "string", "inlineStr": "string", "str": "string", "b": "boolean", "e": "error"}.get(kind, "number")
                yield (file_id, sheet.get("name"), order, int(row), col, c.get("r"), name, value, f is not None, f.text if f is not None else None)


def package_parts(file_id: str, data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i in z.infolist():
            text = z.read(i).decode("utf-8", "replace") if re.search(r"\.(?:xml|rels)$", i.filename) else None
            yield (file_id, i.filename, i.file_size, text)


def _mapped(files: DataFrame, schema: str, parsers: dict) -> DataFrame:
    names = re.findall(r"(?:^|, )(\w+) ", re.sub(r"<[^ ]*>", "", schema))

    def run(batches):
        for pdf in batches:
            for file_id, kind, content in zip(pdf["file_id"], pdf["kind"], pdf["content"]):
                if kind in parsers:
                    try:
                        rows = list(parsers[kind](file_id, bytes(content)))
                    except DAMAGED as e:
                        known = {"file_id": file_id, "unit_id": "error", "unit_ord": 0, "container": "error", "story": type(e).__name__, "value_type": "error", "value": type(e).__name__, "part": "error", "kind": "error"}
                        rows = [tuple(known.get(n) for n in names)]
                    yield pd.DataFrame(rows, columns=names).astype({n: "Int32" for n in ("section", "table_idx", "row_idx", "cell_idx", "para_idx", "sheet_ord", "row", "col", "hidden_rows", "hidden_cols", "validations", "formats", "tables") if n in names} | {n: "Int64" for n in ("size",) if n in names} | {n: "boolean" for n in ("is_formula",) if n in names})

    return files.select("file_id", "kind", "content").mapInPandas(run, schema)


def text_units(files: DataFrame) -> DataFrame:
    return _mapped(files, UNITS, {"docx": word_units, "pptx": slide_units})


def cells(files: DataFrame) -> DataFrame:
    return _mapped(files, CELLS, {"xlsx": sheet_cells, "xlsm": sheet_cells})


def parts(files: DataFrame) -> DataFrame:
    return _mapped(files, PARTS, {k: package_parts for k in KINDS})


def runs(units: DataFrame) -> DataFrame:
    return units.select("file_id", "unit_id", F.explode("runs").alias("r")).select("file_id", "unit_id", "r.*")


def hyperlinks(units: DataFrame) -> DataFrame:
    return runs(units).filter(F.col("url").isNotNull()).select("file_id", "unit_id", "run_index", "text", "url")


def unsupported(package: DataFrame) -> DataFrame:
    """(file_id, feature, part, count) of what a package holds and the text path does not reach."""
    by_part = F.array(*[F.when(F.col("part").rlike(p), F.struct(F.lit(n).alias("feature"), F.lit(1).alias("count"))) for n, p in PART_FEATURES])
    by_text = F.array(*[F.struct(F.lit(n).alias("feature"), F.regexp_count(F.coalesce("content", F.lit("")), F.lit(m)).alias("count")) for n, m in TEXT_FEATURES])
    found = package.select("file_id", "part", F.explode(F.filter(F.concat(by_part, by_text), lambda x: x.isNotNull() & (x["count"] > 0))).alias("x"))
    return found.groupBy("file_id", F.col("x.feature").alias("feature"), "part").agg(F.sum("x.count").alias("count"))


SURFACES = "file_id string, kind string, sheet string, state string, hidden_rows int, hidden_cols int, validations int, formats int, tables int"


def sheet_surfaces(file_id: str, data: bytes):
    """What of a sheet is not seen, and what stands beside its cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book, rels = _xml(z, "xl/workbook.xml"), _relations(z, "xl/workbook.xml")
        for sheet in book.iter(S + "sheet"):
            root = _xml(z, posixpath.normpath(posixpath.join("xl", rels[sheet.get(R + "id")])))
            hidden = lambda tag, root=root: sum(e.get("hidden") in ("1", "true") for e in root.iter(S + tag))
            n = lambda tag, root=root: sum(1 for _ in root.iter(S + tag))
            yield (file_id, "sheet", sheet.get("name"), sheet.get("state", "visible"), hidden("row"), hidden("col"), n("dataValidation"), n("conditionalFormatting"), n("tablePart"))


def surfaces(files: DataFrame) -> DataFrame:
    return _mapped(files, SURFACES, {"xlsx": sheet_surfaces, "xlsm": sheet_surfaces})


def unread_text(package: DataFrame) -> DataFrame:
    """(file_id, part, nodes): text nodes of document and slide parts that the text path does not read."""
    read = r"^(?:word/(?:document|header\d*|footer\d*)|ppt/(?:slides/slide|notesSlides/notesSlide)\d+|docProps/.*)\.xml$"
    nodes = F.regexp_count(F.coalesce("content", F.lit("")), F.lit(r"<(?:w|a):t[ >]"))
    return package.filter(~F.col("part").rlike(read)).select("file_id", "part", nodes.alias("nodes")).filter("nodes > 0")
