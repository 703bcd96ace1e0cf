"""Findings in workbook cells, and the cells after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.generalise import replacement
from ..functions.labels import cleanup_address_tail, cleanup_alias_notes, preserve_reason
from ..functions.text import is_ambiguous_name
from ..functions.variants import rewrite_generic
from ..storage import materialize
from .dictionary import PLACE, candidate_masks, dictionary, literal_hits, seed_aliases, shuffled
from .resolve import apply_edits, coverage_anti_join, overlaps
from .structured import PRESERVED_KINDS, default_enabled, typed_cells

FINDING = [*PLACE, "category", "kind", "detection", "original", "replacement", "enabled", "reason", "start", "end", "ord"]
SECRET_KINDS = ("company", "supplier", "project", "project_id", "customer_id", "ticket_id")
WHOLE = ("列単位", "分類列")


def without_table_headers(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Cells that are not in the first row of a table (file_id, sheet, top, left, right) that has a header."""
    t = tables.filter(F.coalesce("header_rows", F.lit(1)) > 0).select("file_id", "sheet", F.col("top").alias("row"), F.explode(F.sequence("left", "right")).alias("col"))
    return cells.join(t, PLACE, "left_anti")


def column_findings(typed: DataFrame, cell_aliases: DataFrame, analysis: bool) -> DataFrame:
    """One finding for each cell under a known header. The alias given to the very cell goes before the value's own."""
    aliased = shuffled(typed.filter(F.col("kind").isNotNull())).join(shuffled(cell_aliases), PLACE, "left")
    kind = F.col("kind")
    new = F.when(kind == "name", F.col("alias")).otherwise(replacement(kind, F.col("value"), F.col("alias"), analysis))
    on = default_enabled(kind, F.lit("列単位"), F.col("is_formula"), F.lit(True), analysis)
    why = F.concat(F.lit("見出し「"), F.col("header"), F.lit("」"), F.when(on, "").otherwise(preserve_reason(kind, F.col("is_formula"), PRESERVED_KINDS, SECRET_KINDS, analysis)))
    return aliased.select(
        *PLACE, F.col("label").alias("category"), "kind", F.lit("列単位").alias("detection"), F.col("value").alias("original"), new.alias("replacement"), on.alias("enabled"), why.alias("reason"),
        F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.struct("sheet_ord", "row", "col", F.lit(0).alias("at")).alias("ord"),
    )


def literal_findings(texts: DataFrame, words: DataFrame, ambiguous: DataFrame, analysis: bool) -> DataFrame:
    """Known values in the text of cells (place, sheet_ord, text). Doubtful names are numbered candidates."""
    from ..functions.text import alias_key, strip_honorific

    hits = literal_hits(texts, words, PLACE).select(*PLACE, "sheet_ord", F.explode("hits").alias("h")).select(*PLACE, "sheet_ord", "h.*")
    hits = hits.withColumn("norm_key", alias_key(F.lit("name"), strip_honorific(F.col("text"))))
    hits = shuffled(hits).join(shuffled(ambiguous.withColumn("known", F.lit(True))), ["file_id", "norm_key"], "left")
    honorific = F.col("single") & F.col("text").endswith("さん")
    doubt = honorific | (~F.col("single") & (F.col("category") == "氏名") & (F.coalesce("known", F.lit(False)) | is_ambiguous_name(F.col("text"))))
    hits = hits.withColumn("doubt", doubt).withColumn("ord", F.struct("sheet_ord", "row", "col", F.col("start").alias("at")))
    masks = candidate_masks(hits.filter("doubt").withColumn("base", F.when(F.col("single"), F.lit(None)).otherwise(F.col("alias"))), ["file_id"], "text", "base")
    sure = hits.filter("NOT doubt").withColumn("mask", F.col("alias")).drop("norm_key")
    every = masks.drop("base").unionByName(sure)
    why = F.when(honorific, "曖昧な姓+敬称候補").when(F.col("doubt"), "曖昧な表記ゆれ候補").when(F.col("single"), "構造列から作成した1文字姓辞書").otherwise("構造列から作成した同一人物・組織辞書")
    kept = F.lit(analysis) & F.col("category").isin(*SECRET_KINDS)
    on = (~F.col("doubt") | F.lit(analysis)) & ~kept
    return every.select(
        *PLACE, F.when(F.col("doubt"), "氏名候補").otherwise(F.col("category")).alias("category"), F.when(F.col("category") == "氏名", "name").otherwise(F.col("category")).alias("kind"),
        F.when(F.col("doubt"), "確認候補").otherwise("辞書一致").alias("detection"), F.col("text").alias("original"), F.col("mask").alias("replacement"), on.alias("enabled"),
        F.concat(why, F.when(kept, " / 分析継続用のため企業機密項目を維持").otherwise("")).alias("reason"), "start", "end", "ord",
    )


def model_findings(spans: DataFrame, covered: DataFrame, confidence: float = 0.50) -> DataFrame:
    """A model's spans (place, sheet_ord, start, end, category, text, replacement) where no other finding lies; never enabled."""
    free = coverage_anti_join(spans, covered.filter(F.col("start").isNotNull()), PLACE).filter(F.length(F.trim("text")) >= 2)
    return free.select(
        *PLACE, "category", F.lit("text").alias("kind"), F.lit("AI候補").alias("detection"), F.trim("text").alias("original"), "replacement", F.lit(False).alias("enabled"),
        F.format_string("自然言語処理(信頼度%.2f)", F.lit(confidence)).alias("reason"), "start", "end", F.struct("sheet_ord", "row", "col", F.col("start").alias("at")).alias("ord"),
    )


def distinct_findings(findings: DataFrame, key: list[str]) -> DataFrame:
    """Of findings with one key the first by ``ord``."""
    rest = [c for c in findings.columns if c not in key]
    return findings.groupBy(*key).agg(F.min_by(F.struct(*rest), "ord").alias("v")).select(*key, "v.*").select(*findings.columns)


def scan_cells(cells: DataFrame, analysis: bool = True, extra: DataFrame | None = None) -> DataFrame:
    """All findings of workbooks: columns under known headers, then known values in the text of other cells."""
    from .dictionary import ambiguous_keys

    # written once each: what follows reads them several times
    typed = materialize(typed_cells(cells), "cells-typed")
    known = typed.filter(F.col("kind").isNotNull())
    cell_aliases = materialize(seed_aliases(known, extra)[1], "cells-aliases")
    value_of = F.when(F.col("kind") == "name", F.col("alias")).otherwise(replacement(F.col("kind"), F.col("value"), F.col("alias"), analysis))
    words = materialize(dictionary(known, cell_aliases, value_of), "cells-words")
    texts = typed.filter(F.col("kind").isNull()).select(*PLACE, "sheet_ord", F.col("value").alias("text"))
    return column_findings(known, cell_aliases, analysis).unionByName(literal_findings(texts, words, ambiguous_keys(known), analysis)).select(*FINDING)


def from_right(edits: Column) -> Column:
    """Edits of one text, those further right first, each taken if it overlaps none taken before; in text order."""
    ordered = F.transform(F.array_sort(F.transform(edits, lambda e: F.struct((-e["start"]).alias("s"), e.alias("e")))), lambda k: k["e"])
    none = F.slice(edits, F.lit(1), F.lit(0))
    return F.array_sort(F.aggregate(ordered, none, lambda acc, e: F.when(F.exists(acc, lambda y: overlaps(e, y)), acc).otherwise(F.concat(acc, F.array(e)))))


def apply_findings(cells: DataFrame, findings: DataFrame, analysis: bool = True) -> DataFrame:
    """Cells with ``new_value``: the last whole-cell replacement, else the span edits and the clean-ups after them.

    Formulas stay as they are in analysis (``skipped``).
    """
    on = findings.filter("enabled")
    whole = F.col("detection").isin(*WHOLE) | ((F.col("detection") == "確認候補") & F.col("start").isNull())
    edit = F.struct(F.col("start"), F.col("end"), F.col("replacement"))
    per = on.groupBy(*PLACE).agg(
        F.max_by(F.when(whole, F.col("replacement")), F.when(whole, F.col("ord"))).alias("__whole"),
        F.collect_list(F.when(~whole & F.col("start").isNotNull(), edit)).alias("__edits"),
        F.bool_or(F.col("category") == "住所").alias("__address"), F.bool_or(F.col("category") == "氏名").alias("__name"),
    )
    out = shuffled(cells).join(shuffled(per), PLACE, "left")
    text = apply_edits(F.col("value"), from_right(F.col("__edits")))
    text = F.when(F.col("__address"), cleanup_address_tail(text)).otherwise(text)
    text = rewrite_generic(F.when(F.col("__name"), cleanup_alias_notes(text)).otherwise(text))
    skipped = F.col("__edits").isNotNull() & F.col("is_formula") & F.lit(analysis)
    new = F.when(F.col("__edits").isNull() | skipped, F.col("value")).when(F.col("__whole").isNotNull(), F.col("__whole")).otherwise(text)
    return out.withColumn("new_value", new).withColumn("skipped", F.coalesce(skipped, F.lit(False))).drop("__whole", "__edits", "__address", "__name")
