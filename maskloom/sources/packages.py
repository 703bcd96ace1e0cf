"""Office packages with their edits: runs of paragraphs and cells of sheets take new texts, all other parts stay."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ooxml import NS, A, R, S, W, _relations, _xml

EDITS = "array<struct<place:string,run:int,text:string>>"
XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"


def _run_elements(parent):
    for child in parent:
        if child.tag == W + "hyperlink":
            yield from _run_elements(child)
        elif child.tag in (W + "r", A + "r", A + "fld", A + "br"):
            yield child


def _set_text(run, tag: str, text: str) -> None:
    """The run's text as one node; tabs and breaks of the old text go with it."""
    old = [x for x in run if x.tag in (tag, W + "tab", W + "br", W + "cr")]
    at = list(run).index(old[0]) if old else len(run)
    for x in old:
        run.remove(x)
    node = ET.Element(tag)
    node.text = text
    if tag == W + "t":
        node.set(XML_SPACE, "preserve")
    run.insert(at, node)


def _word_paragraphs(root, name: str):
    """(place, paragraph) as ``word_units`` names them."""
    body = root.find("w:body", NS) if name.endswith("document.xml") else root
    base = posixpath.basename(name)
    story = "body" if name.endswith("document.xml") else re.sub(r"\d*\.xml$", "", base)
    section, para, table = int("0" + re.sub(r"\D", "", base)), 0, 0
    for child in body:
        if child.tag == W + "p":
            yield f"paragraph:{story}:{section}:None:None:None:{para}", child
            para += 1
        elif child.tag == W + "tbl":
            for r, tr in enumerate(child.findall("w:tr", NS)):
                for c, tc in enumerate(tr.findall("w:tc", NS)):
                    for i, p in enumerate(tc.findall(".//w:p", NS)):
                        yield f"table_cell:{story}:{section}:{table}:{r}:{c}:{i}", p
            table += 1


def _slide_paragraphs(root, name: str):
    index, story = int(re.sub(r"\D", "", posixpath.basename(name))), "notes" if "notes" in name else "slide"
    tables = list(root.iter(A + "tbl"))
    inside = {id(p) for t in tables for p in t.iter(A + "p")}
    for i, p in enumerate(x for x in root.iter(A + "p") if id(x) not in inside):
        yield f"shape_text:{story}:{index}:None:None:None:{i}", p
    for t, tbl in enumerate(tables):
        for r, tr in enumerate(tbl.findall("a:tr", NS)):
            for c, tc in enumerate(tr.findall("a:tc", NS)):
                for i, p in enumerate(tc.iter(A + "p")):
                    yield f"table_cell:{story}:{index}:{t}:{r}:{c}:{i}", p


def _with_runs(name: str, root, edits: dict, kind: str) -> bool:
    walk, tag = (_word_paragraphs, W + "t") if kind == "docx" else (_slide_paragraphs, A + "t")
    changed = False
    for place, p in walk(root, name):
        for i, run in enumerate(_run_elements(p)):
            text = edits.get((place, i))
            if text is not None and run.tag != A + "br":
                _set_text(run, tag, text)
                changed = True
    return changed


def _with_cells(sheet: str, root, edits: dict) -> bool:
    changed = False
    for c in root.iter(S + "c"):
        text = edits.get((f"{sheet}!{c.get('r')}", 0))
        if text is not None:
            for x in list(c):
                c.remove(x)
            c.set("t", "inlineStr")
            node = ET.SubElement(ET.SubElement(c, S + "is"), S + "t")
            node.text = text
            changed = True
    return changed


def rewritten(kind: str, data: bytes, edits: dict[tuple[str, int], str]) -> bytes:
    """A package in which the named runs or cells have new texts."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        sheets = {}
        if kind in ("xlsx", "xlsm"):
            rels = _relations(z, "xl/workbook.xml")
            sheets = {posixpath.normpath(posixpath.join("xl", rels[s.get(R + "id")])): s.get("name") for s in _xml(z, "xl/workbook.xml").iter(S + "sheet")}
        texts = r"word/(?:document|header\d*|footer\d*)\.xml" if kind == "docx" else r"ppt/(?:slides/slide|notesSlides/notesSlide)\d+\.xml"
        for info in z.infolist():
            content = z.read(info)
            if info.filename in sheets or (not sheets and re.fullmatch(texts, info.filename)):
                root = ET.fromstring(content)
                done = _with_cells(sheets[info.filename], root, edits) if sheets else _with_runs(info.filename, root, edits, kind)
                content = ET.tostring(root, encoding="utf-8", xml_declaration=True) if done else content
            new.writestr(info, content)
    return out.getvalue()


def converted(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(file_id, kind, content) of office files after edits (file_id, place, run, text).

    A place is a unit's id, with the run's number, or ``sheet!A1`` with run 0. Files without edits come out as they are.
    """
    per = edits.groupBy("file_id").agg(F.collect_list(F.struct("place", "run", "text")).cast(EDITS).alias("edits"))
    rows = files.select("file_id", "kind", "content").join(per, "file_id", "left")

    def run(batches):
        for pdf in batches:
            new = []
            for kind, data, es in zip(pdf["kind"], pdf["content"], pdf["edits"]):
                new.append(bytes(data) if es is None else rewritten(kind, bytes(data), {(e["place"], e["run"]): e["text"] for e in es}))
            yield pd.DataFrame({"file_id": pdf["file_id"], "kind": pdf["kind"], "content": new})

    return rows.mapInPandas(run, "file_id string, kind string, content binary")


def run_texts(edits: DataFrame) -> DataFrame:
    """Edits of runs (file_id, unit_id, run_index, new_text) as ``converted`` takes them."""
    return edits.select("file_id", F.col("unit_id").alias("place"), F.col("run_index").alias("run"), F.col("new_text").alias("text"))


def cell_texts(cells: DataFrame) -> DataFrame:
    """Cells (file_id, sheet, coord, value, new_value) that changed, as ``converted`` takes them."""
    changed = cells.filter(~F.col("new_value").eqNullSafe(F.col("value")) & F.col("new_value").isNotNull())
    return changed.select("file_id", F.concat_ws("!", "sheet", "coord").alias("place"), F.lit(0).alias("run"), F.col("new_value").alias("text"))
