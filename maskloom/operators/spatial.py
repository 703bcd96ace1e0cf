"""Positioned words: lines, visual rows, label-value pairs, quality, spatial duplicates.

Words come as (file_id, page, block, line, word_no, x0, y0, x1, y1, text). What depends on the order of one page's
words is a grouped function over the page; everything else is column work.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable
from math import nan
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType, IntegerType, IntegralType, StructField, StructType

from ..functions.text import class_counts, compact, ocr_normalize

PAGE = ["file_id", "page"]

# Words that tell what a page is about, and labels, headers and headings with the kind of their values.
FINANCIAL_WORDS = (
    "貸借対照表", "損益計算書", "勘定科目", "資産の部", "負債の部", "純資産", "流動資産", "固定資産", "流動負債", "固定負債",
    "売上高", "売上原価", "販売費", "営業利益",
)
EXPLANATORY_WORDS = ("制度", "説明", "相談", "協議会", "設置", "活動", "ご案内", "お問い合わせ", "都道府県", "市区町村")
BANK_GUIDE_WORDS = ("銀行取引", "銀行協会", "相談室", "あっせん", "苦情", "活動")
LABEL_KINDS = (
    ("企業名称", "会社名"), ("会社名", "会社名"), ("法人名", "会社名"), ("商号", "会社名"), ("所在地", "住所"), ("住所", "住所"),
    ("代表者", "氏名"), ("代表取締役", "氏名"), ("取引銀行", "銀行名"), ("金融機関", "銀行名"),
)
COLUMN_KINDS = (
    ("氏名", "氏名"), ("株主", "氏名"), ("株主名", "氏名"), ("所在地", "住所"), ("住所", "住所"), ("販売先", "会社名"),
    ("仕入先", "会社名"), ("外注先", "会社名"), ("取引先", "会社名"),
)
SECTION_HEADINGS = ("主な仕入", "仕入先", "外注先", "主な販売先", "販売先", "取引先", "株主一覧", "役員構成")
CORPORATE_MARKER = r"(?:株式会社|有限会社|合同会社|[（(]株[）)]?|[（(]有[）)]?|㈱|㈲|株\)|有\))"
NUMERIC_ONLY = r"^[0-9０-９,.\-ー−－%％①-⑳\s]+$"


def by_page(df: DataFrame, order: list[str], one: Callable, schema: str | StructType) -> DataFrame:
    """``one(rows of a page)`` gives tuples of ``schema``; rows are named tuples in ``order``, nulls last, null numbers as NaN.

    Pages are dealt and sorted by Spark and cut where the page changes, many in one batch: a call a page of pandas or
    Arrow would cost more than the page's own work. One page is held at a time, beside one batch.
    """
    numbers = {i for i, f in enumerate(df.schema) if isinstance(f.dataType, (IntegralType, FractionalType)) and not isinstance(f.dataType, DecimalType) and f.name not in PAGE}
    columns, fields = df.columns, schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        Row = namedtuple("Row", columns, rename=True)
        arrow, at = to_arrow_schema(fields), [columns.index(k) for k in PAGE]
        key, page, out = None, [], []

        def values(c, number):
            if c.null_count:
                return [nan if v is None else v for v in c.to_pylist()] if number else c.to_pylist()
            return c.to_numpy(zero_copy_only=False).tolist() if number else c.to_pylist()

        def batch():
            names = [f.name for f in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(zip(*out), arrow)], names=names)

        for b in batches:
            for r in map(Row, *(values(c, i in numbers) for i, c in enumerate(b.columns))):
                here = tuple(r[i] for i in at)
                if here != key and page:
                    out.extend(one(page))
                    page = []
                    if len(out) >= 5000:
                        yield batch()
                        out = []
                key = here
                page.append(r)
        if page:
            out.extend(one(page))
        if out:
            yield batch()

    return df.repartition(*PAGE).sortWithinPartitions(*PAGE, *(F.col(c).asc_nulls_last() for c in order)).mapInArrow(run, fields)


def word_boxes(words: DataFrame) -> DataFrame:
    w = words.filter(F.length(F.trim("text")) > 0)
    return w.withColumn("block", F.coalesce("block", F.lit(0))).withColumn("line", F.coalesce("line", F.lit(0))).withColumn("norm", compact(F.col("text")))


def line_boxes(words: DataFrame) -> DataFrame:
    """Lines with their text in reading order and the rectangle around their words."""
    parts = F.sort_array(F.collect_list(F.struct("x0", "word_no", "text")))
    return word_boxes(words).groupBy(*PAGE, "block", "line").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def visual_rows(lines: DataFrame, closeness: float = 0.55) -> DataFrame:
    """Add ``vrow``: a line joins the first row whose median centre lies within a share of the larger height, its own or
    the median of the row's (one point at least); lines come from the top, then from the left."""

    def one(rows):
        centres, heights = [], []
        for r in rows:
            centre, tall = (r.y0 + r.y1) / 2, max(r.y1 - r.y0, 1.0)
            at = next((i for i, (c, h) in enumerate(zip(centres, heights)) if abs(centre - median(c)) <= closeness * max(median(h), tall)), len(centres))
            if at == len(centres):
                centres.append([])
                heights.append([])
            centres[at].append(centre)
            heights[at].append(tall)
            yield *r, at

    return by_page(lines, ["y0", "x0", "block", "line"], one, StructType([*lines.schema.fields, StructField("vrow", IntegerType())]))


def page_context(lines: DataFrame) -> DataFrame:
    """Per page three flags: at least two different words of a list occur."""

    def flag(words: tuple[str, ...]) -> Column:
        return sum((F.max(F.col("text").contains(w).cast("int")) for w in words), F.lit(0)) >= 2

    return lines.groupBy(*PAGE).agg(flag(FINANCIAL_WORDS).alias("financial"), flag(EXPLANATORY_WORDS).alias("explanatory"), flag(BANK_GUIDE_WORDS).alias("bank_guide"))


def _kind_of(text: Column, pairs) -> Column:
    kind = F.lit(None).cast("string")
    for label, k in reversed(pairs):
        kind = F.when(text == label, k).otherwise(kind)
    return kind


def table_columns(words: DataFrame, depth: float = 380.0) -> DataFrame:
    """Values under header rows: (page, header, kind, text, rectangle), one for each line of a column.

    A line with two header words or more is a header row. A column reaches half way to the headers beside it, and
    ``depth`` points down or to the next header row of its page.
    """
    w = word_boxes(words)
    row = Window.partitionBy(*PAGE, "block", "line").orderBy("x0")
    heads = w.withColumn("kind", _kind_of(F.col("norm"), COLUMN_KINDS)).filter(F.col("kind").isNotNull())
    heads = heads.withColumn("n", F.count("*").over(Window.partitionBy(*PAGE, "block", "line"))).filter("n > 1")
    left, right = (F.lag("x1").over(row) + F.col("x0")) / 2, (F.col("x1") + F.lead("x0").over(row)) / 2
    heads = heads.select(*PAGE, F.col("norm").alias("header"), "kind", F.coalesce(left, F.lit(float("-inf"))).alias("left"), F.coalesce(right, F.lit(float("inf"))).alias("right"), F.col("y1").alias("top"))
    nxt = F.min("top").over(Window.partitionBy(*PAGE).orderBy("top").rangeBetween(1, Window.unboundedFollowing))
    heads = heads.withColumn("bottom", F.least(F.col("top") + depth, F.coalesce(nxt, F.lit(float("inf")))))
    centre = (F.col("x0") + F.col("x1")) / 2
    below = w.join(heads, PAGE).filter((F.col("y0") >= F.col("top")) & (F.col("y1") <= F.col("bottom")) & (centre >= F.col("left")) & (centre < F.col("right")))
    below = below.filter(~F.col("norm").rlike(NUMERIC_ONLY) & (_kind_of(F.col("norm"), COLUMN_KINDS).isNull()))
    parts = F.sort_array(F.collect_list(F.struct("x0", "word_no", "text")))
    return below.groupBy(*PAGE, "header", "kind", "block", "line").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def section_blocks(lines: DataFrame, depth: float = 260.0, reach: float = 150.0) -> DataFrame:
    """Lines with a corporate marker below a section heading: each belongs to the nearest heading above it."""
    headed = lines.withColumn("t", compact(F.col("text")))
    heads = headed.filter(F.col("t").isin(*SECTION_HEADINGS)).select(*PAGE, F.col("t").alias("heading"), F.col("x0").alias("hx"), F.col("y1").alias("hy"))
    near = headed.filter(F.col("t").rlike(CORPORATE_MARKER)).join(heads, PAGE)
    near = near.filter((F.col("y0") >= F.col("hy")) & (F.col("y0") - F.col("hy") <= depth) & (F.abs(F.col("x0") - F.col("hx")) <= reach))
    last = near.groupBy(*PAGE, "block", "line").agg(F.max_by(F.struct("heading", "text", "x0", "y0", "x1", "y1"), "hy").alias("v"))
    return last.select(*PAGE, "v.*")


def label_values(lines: DataFrame, gap_right: float = 20.0, gap_below: float = 3.0) -> DataFrame:
    """Values to the right of a label on its row, else below it: (page, label, kind, text, place, rectangle)."""
    kind = _kind_of(F.regexp_replace(compact(F.col("text")), "[:：]$", ""), LABEL_KINDS)
    labels = lines.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    left = labels.select(*PAGE, F.col("text").alias("label"), "kind", *(F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")))
    pairs = left.join(lines, PAGE)
    height = F.col("l_y1") - F.col("l_y0")
    level = (F.least("l_y1", "y1") - F.greatest("l_y0", "y0")) > 0.5 * F.least(height, F.col("y1") - F.col("y0"))
    right = level & (F.col("x0") >= F.col("l_x1")) & (F.col("x0") - F.col("l_x1") >= 0)
    lap = (F.least("l_x1", "x1") - F.greatest("l_x0", "x0")) > 0
    below = (F.col("y0") >= F.col("l_y1")) & (F.col("y0") - F.col("l_y1") <= gap_below * height) & (lap | (F.abs(F.col("x0") - F.col("l_x0")) <= gap_right))
    placed = pairs.withColumn("place", F.when(right, "right").when(below, "below")).filter(F.col("place").isNotNull())
    far = F.when(F.col("place") == "right", F.col("x0") - F.col("l_x1")).otherwise(F.col("y0") - F.col("l_y1"))
    key = F.struct((F.col("place") == "below").alias("second"), far.alias("far"), "y0", "x0")
    best = placed.groupBy(*PAGE, "label", "kind", "l_x0", "l_y0").agg(F.min_by(F.struct("text", "place", "x0", "y0", "x1", "y1"), key).alias("v"))
    return best.select(*PAGE, "label", "kind", "v.*")


def words_in_rect(words: DataFrame, rects: DataFrame) -> DataFrame:
    """Words whose centre lies in a rectangle of their page."""
    cx, cy = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.y0") + F.col("w.y1")) / 2
    r, w = rects.alias("r"), words.alias("w")
    inside = cx.between(F.col("r.x0"), F.col("r.x1")) & cy.between(F.col("r.y0"), F.col("r.y1"))
    return r.join(w, [F.col(f"r.{k}") == F.col(f"w.{k}") for k in PAGE]).filter(inside).select("r.rect_id", "w.*")


def ocr_lines(words: DataFrame) -> DataFrame:
    """One normalised string a page, with character ranges of its words."""
    ordered = F.sort_array(F.collect_list(F.struct("block", "line", "word_no", ocr_normalize(F.col("text")).alias("t"))))
    return word_boxes(words).groupBy(*PAGE).agg(F.array_join(F.transform(ordered, lambda p: p["t"]), "").alias("norm"))


# Limits of page quality.
QUALITY = {"warn_chars": 40, "fail_chars": 10, "warn_garble": 0.08, "fail_garble": 0.18, "warn_area": 0.0005, "fail_area": 0.0001, "blank_chars": 80, "dark": 0.001}


def page_quality(pages: DataFrame, text: str = "text", limits: dict[str, float] = QUALITY) -> DataFrame:
    """Counts of character classes, ratios, a verdict and its reasons; ``area_ratio`` and ``dark_ratio`` are inputs."""
    t = compact(F.col(text))
    out = pages.withColumn("chars", F.length(t))
    for name, n in class_counts(t).items():
        out = out.withColumn(name, n)
    garble = F.when(F.col("chars") > 0, F.col("garble") / F.col("chars")).otherwise(0.0)
    failed = (F.col("chars") < limits["fail_chars"]) & (F.col("dark_ratio") >= limits["dark"]) | (garble >= limits["fail_garble"])
    reasons = F.array(
        F.when(F.col("chars") < limits["warn_chars"], "few_chars"), F.when(garble >= limits["warn_garble"], "garbled"), F.when(F.col("area_ratio") < limits["warn_area"], "small_area")
    )
    out = out.withColumn("garble_ratio", garble).withColumn("reasons", F.array_join(F.filter(reasons, lambda r: r.isNotNull()), ";"))
    return out.withColumn("verdict", F.when(failed, "FAILED").when(F.col("reasons") != "", "REVIEW_REQUIRED").otherwise("PASS"))


def spatial_dedupe(cands: DataFrame, share: float = 0.78) -> DataFrame:
    """Candidates of a page in order of ``cand_id``: of one kind, text and rounded place the first; then one that overlaps
    a kept one of its kind, whose text holds or is held by it or whose centre is near, goes or takes its place, by the
    higher ``rank``, then the smaller area."""
    from .layout import same_place

    def one(rows):
        order = lambda r: (r.rank, -(r.x1 - r.x0) * (r.y1 - r.y0))
        kept, seen = [], set()
        for r in rows:
            rect = (r.x0, r.y0, r.x1, r.y1)
            key = (r.kind, r.norm, *map(round, rect))
            if key in seen:
                continue
            seen.add(key)
            at = next((i for i, k in enumerate(kept) if k.kind == r.kind and same_place((k.x0, k.y0, k.x1, k.y1), k.norm, rect, r.norm, share)), None)
            if at is None:
                kept.append(r)
            elif order(r) > order(kept[at]):
                kept[at] = r
        return kept

    return by_page(cands, ["cand_id"], one, cands.schema)


def greedy_assignment(items: DataFrame, findings: DataFrame) -> DataFrame:
    """One-to-one pairs on a page and kind, items in order, each with the nearest unused finding by y centre."""

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        right = right.sort_values("finding_id")
        for it in left.sort_values("item_id").itertuples():
            free = [(abs((f.y0 + f.y1) / 2 - (it.y0 + it.y1) / 2), f.finding_id) for f in right.itertuples() if f.finding_id not in used]
            if free:
                best = min(free)[1]
                used.add(best)
                out.append((it.item_id, best))
        return pd.DataFrame(out, columns=["item_id", "finding_id"])

    keys = [*PAGE, "kind"]
    return items.groupBy(*keys).cogroup(findings.groupBy(*keys)).applyInPandas(one, "item_id long, finding_id long")
