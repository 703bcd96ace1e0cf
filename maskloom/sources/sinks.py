"""Outputs: findings, quality tables, audit records without originals, reports, saved states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hmac_sha256

FINDING_COLUMNS = ["enabled", "location", "category", "rule", "confidence", "replacement", "status", "reason"]


def write_findings(findings: DataFrame, path: str, with_originals: bool = False) -> None:
    """Findings as CSV; originals are written only when asked for."""
    cols = FINDING_COLUMNS + (["original"] if with_originals else [])
    findings.select(*cols).write.mode("overwrite").option("header", True).csv(path)


# The columns of findings by kind of file.
LAYOUTS = {
    "xlsx": ("変換", "処理状態", "シート", "セル", "種類", "検査", "検出値", "変換後", "理由"),
    "docx": ("変換", "処理状態", "位置", "種類", "検出ルール", "信頼度", "検出値", "変換後", "理由"),
    "pptx": ("変換", "処理状態", "スライド", "位置", "種類", "検出ルール", "信頼度", "検出値", "変換後", "理由"),
    "pdf": ("変換", "処理状態", "ページ", "位置", "種類", "検査", "検出値", "変換後", "理由"),
}
SOURCES = {
    "変換": "enabled", "処理状態": "status", "シート": "sheet", "セル": "cell", "位置": "location", "スライド": "page", "ページ": "page", "種類": "category",
    "検査": "detection", "検出ルール": "rule", "信頼度": "confidence", "検出値": "original", "変換後": "replacement", "理由": "reason",
}


def finding_rows(findings: DataFrame, kind: str, review: bool = False) -> DataFrame:
    """Findings under the headers of a kind of file; ``review`` adds two empty columns to be filled in by hand."""
    cols = [F.col(SOURCES[h]).alias(h) for h in LAYOUTS[kind]]
    if review:
        cols += [F.lit("").alias("問題分類"), F.lit("").alias("期待値")]
    return findings.select(*cols)


def file_reports(findings: DataFrame, warnings: DataFrame, unsupported: DataFrame) -> DataFrame:
    """One row a file: findings, enabled and excluded ones, formulas kept as findings say, warnings, unsupported parts."""
    f = findings.groupBy("file_id").agg(F.count("*").alias("findings"), F.count_if("enabled").alias("enabled"), F.count_if("excluded").alias("excluded"), F.countDistinct("category").alias("categories"))
    w = warnings.groupBy("file_id").agg(F.count("*").alias("warnings"))
    u = unsupported.groupBy("file_id").agg(F.sum("count").cast("long").alias("unsupported"))
    return f.join(w, "file_id", "full_outer").join(u, "file_id", "full_outer").na.fill(0)


def audit_records(findings: DataFrame, key: bytes) -> DataFrame:
    """One JSON record per finding with the keyed digest of its original, never the original."""
    digest = hmac_sha256(key)
    out = findings.withColumn("original_hmac_sha256", digest(F.col("original"))).drop("original")
    return out.select(F.to_json(F.struct(*out.columns)).alias("value"))


def write_audit(findings: DataFrame, path: str, key: bytes) -> None:
    audit_records(findings, key).write.mode("overwrite").text(path)


def report(findings: DataFrame, unsupported: DataFrame) -> DataFrame:
    """Counts of a run as (metric, value), from one aggregation of each table."""
    f = findings.agg(
        F.count("*").alias("findings"), F.count_if("enabled").alias("enabled"), F.count_if("excluded").alias("excluded"), F.countDistinct("category").alias("categories")
    )
    u = unsupported.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("unsupported"))
    row = f.crossJoin(u)
    return row.select(F.expr("stack(5, 'findings', findings, 'enabled', enabled, 'excluded', excluded, 'categories', categories, 'unsupported', unsupported) AS (metric, value)"))


def quality_rows(pages: DataFrame) -> DataFrame:
    return pages.select("file_id", "page", "chars", "garble_ratio", "area_ratio", "verdict", "reasons").orderBy("file_id", "page")


def review_state(pages: DataFrame, findings: DataFrame, sha256: str, key: bytes) -> DataFrame:
    """The saved state of one file as a JSON document: findings by keyed digest."""
    digest = hmac_sha256(key)
    p = pages.agg(F.sort_array(F.collect_list(F.struct(F.col("page").alias("page_number"), F.col("review_state").alias("page_review_state"), "verification_state"))).alias("pages"))
    f = findings.withColumn("original_hmac_sha256", digest(F.col("original")))
    f = f.agg(F.sort_array(F.collect_list(F.struct(F.col("finding_id").alias("id"), F.col("page").alias("page_number"), "enabled", "replacement", "original_hmac_sha256"))).alias("findings"))
    doc = p.crossJoin(f).select(F.lit("review_state_v1").alias("schema"), F.lit(sha256).alias("input_sha256"), "pages", "findings")
    return doc.select(F.to_json(F.struct(*doc.columns)).alias("value"))


def output_name(stem: Column, mode: str, stamp: str, extension: str) -> Column:
    return F.concat(stem, F.lit(f"_{mode}_匿名化_{stamp}.{extension}"))


def union_all_columns(parts: list[DataFrame]) -> DataFrame:
    """Rows of tables with different columns; columns in the order they first appear."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def redactions(findings: DataFrame, mode: str) -> DataFrame:
    """(file_id, page, rectangle, mode, text) to draw: the pseudonym, a mask, or nothing on black or white."""
    text = {"pseudonym": F.col("replacement"), "mask": F.repeat(F.lit("*"), F.length("original"))}.get(mode, F.lit(""))
    return findings.filter("enabled").select("file_id", "page", "x0", "y0", "x1", "y1", F.lit(mode).alias("mode"), text.alias("text"))
