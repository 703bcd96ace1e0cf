"""Comparisons: outputs with their sources, candidates with truths, one run with another, positions with positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Why a truth was missed or a candidate is wrong.
NO_CANDIDATE, NO_TRUTH = "候補自体が生成されなかった", "一般語誤検出"
WRONG_CATEGORY, TOO_SHORT, TOO_LONG = "カテゴリ誤分類", "span不足", "span過大"
REVIEW_RANKS = ("確認待ち", "座標要修正", "対象外", "確認済み")
SHARES = ("recall", "candidate_precision")


def error_causes(rows: DataFrame, others: DataFrame, key: list[str], missed: bool) -> DataFrame:
    """(rows, cause, related): missed truths with the candidates of their place, or wrong candidates with its truths.

    Rows and others have (key, category, start, end). What overlaps decides: another category, a part left out, too
    much taken in; nothing that overlaps, or something else.
    """
    o = others.select(*key, F.col("category").alias("__c"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    joined = rows.join(o, key, "left")
    hit = (F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end"))
    inner, outer = (("__s", "__e"), ("start", "end")) if missed else (("start", "end"), ("__s", "__e"))
    short = (F.col(inner[0]) > F.col(outer[0])) | (F.col(inner[1]) < F.col(outer[1]))
    long_ = (F.col(inner[0]) < F.col(outer[0])) | (F.col(inner[1]) > F.col(outer[1]))
    found = joined.groupBy(*rows.columns).agg(
        F.count("__c").alias("related"), F.bool_or(F.coalesce(hit, F.lit(False))).alias("__hit"), F.bool_or(hit & (F.col("__c") != F.col("category"))).alias("__other"),
        F.bool_or(hit & short).alias("__short"), F.bool_or(hit & long_).alias("__long"),
    )
    cause = (
        F.when(~F.col("__hit"), NO_CANDIDATE if missed else NO_TRUTH).when(F.col("__other"), WRONG_CATEGORY).when(F.col("__short"), TOO_SHORT).when(F.col("__long"), TOO_LONG)
        .otherwise("その他" if missed else "重複候補")
    )
    return found.select(*rows.columns, cause.alias("cause"), "related")


def side_by_side(left: DataFrame, right: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of two tables with the same place within a key, and ``same_count`` of the key; extra rows stay, with nulls."""

    def placed(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in key]
        w = Window.partitionBy(*key)
        return df.select(*key, F.row_number().over(w.orderBy(order)).alias("place"), F.count("*").over(w).alias(f"__n_{name}"), F.struct(*rest).alias(name))

    both = placed(left, "left").join(placed(right, "right"), [*key, "place"], "full_outer")
    same = F.coalesce(F.col("__n_left") == F.col("__n_right"), F.lit(False))
    return both.withColumn("same_count", same).drop("__n_left", "__n_right")


def stale_candidates(candidates: DataFrame, units: DataFrame, key: list[str]) -> DataFrame:
    """Candidates whose unit is gone, or no longer holds their text at their place."""
    u = units.select(*key, F.col("text").alias("__text"))
    now = F.substring(F.col("__text"), F.col("start") + 1, F.col("end") - F.col("start"))
    problem = F.when(F.col("__text").isNull(), "UNIT_MISSING").when(now != F.col("original"), "TEXT_CHANGED")
    return candidates.join(u, key, "left").withColumn("problem", problem).filter(F.col("problem").isNotNull()).drop("__text")


def located(findings: DataFrame, places: DataFrame, key: tuple[str, ...] = ("file_id", "sheet", "cell", "original")) -> DataFrame:
    """Findings with the rectangle saved for them; null where none was."""
    return findings.join(places.select(*key, "x0", "y0", "x1", "y1"), list(key), "left")


def surname_mentions(spans: DataFrame, names: DataFrame, key: list[str]) -> DataFrame:
    """(key, start, end, text, alias): family names of (file_id, surname, alias, ord) with an honorific in later texts.

    Texts are (key with file_id, ord, text). Only names met earlier in the file count; what stands before さん, 様 or
    氏 is looked up, one character less at a time, longest first.
    """
    found = F.regexp_extract_all("text", F.lit("([一-龯々〆ヵヶぁ-んァ-ヶーA-Za-z]{1,8})(?:さん|様|氏)"), F.lit(0))
    words = spans.select(*key, "ord", "text", F.explode(F.array_distinct(found)).alias("whole"))
    tail = F.regexp_extract("whole", "(さん|様|氏)$", 1)
    base = F.expr("substring(whole, 1, length(whole) - length(tail))")
    words = words.withColumn("tail", tail).withColumn("base", base)
    words = words.withColumn("surname", F.explode(F.transform(F.sequence(F.lit(1), F.length("base")), lambda i: F.substring(F.col("base"), i, F.length("base")))))
    known = names.select("file_id", "surname", "alias", F.col("ord").alias("__first"))
    hits = words.join(known, ["file_id", "surname"]).filter(F.col("__first") < F.col("ord"))
    best = hits.groupBy(*key, "text", "whole", "tail").agg(F.max_by(F.struct("surname", "alias"), F.length("surname")).alias("v"))
    mention = F.concat("v.surname", "tail")
    at = F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.length("text")), lambda i: F.substring(F.col("text"), i, F.length(mention)) == mention), lambda i: i - 1))
    return best.select(*key, at.alias("start"), mention.alias("value"), "v.alias").withColumn("end", F.col("start") + F.length("value"))


def propagate(findings: DataFrame, texts: DataFrame, kinds=("氏名", "会社名", "住所", "銀行名"), least: int = 3) -> DataFrame:
    """(file_id, page, literal, category, replacement): values found on one page that stand on another, not flagged there.

    Findings are (file_id, page, original, category, replacement, ord), texts (file_id, page, text). Values and pages
    meet by the first three characters of a value; the first finding of a value gives its category and replacement.
    """
    targets = findings.filter(F.col("category").isin(*kinds) & (F.length("original") >= least)).groupBy("file_id", F.col("original").alias("literal"))
    targets = targets.agg(F.min_by(F.struct("category", "replacement"), "ord").alias("v")).select("file_id", "literal", "v.*").withColumn("gram", F.substring("literal", 1, least))
    n = F.length("text")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), n - least + 1), lambda i: F.substring(F.col("text"), i, F.lit(least))))
    pages = texts.filter(n >= least).select("file_id", "page", "text", F.explode(grams).alias("gram"))
    hits = pages.join(targets, ["file_id", "gram"]).filter(F.col("text").contains(F.col("literal"))).select("file_id", "page", "literal", "category", "replacement").distinct()
    flagged = findings.select("file_id", "page", F.col("original").alias("literal")).distinct()
    return hits.join(flagged, ["file_id", "page", "literal"], "left_anti")


def workbook_check(source: DataFrame, output: DataFrame, key: list[str]) -> DataFrame:
    """Per file: formulas kept and changed, and numbers and dates whose type changed; cells have (value, value_type, formula)."""
    o = output.select(*key, F.col("value").alias("__v"), F.col("value_type").alias("__t"), F.col("formula").alias("__f"))
    j = source.join(o, key, "left")
    formula = F.col("formula").isNotNull()
    kept = F.coalesce(F.col("formula") == F.col("__f"), F.lit(False))
    moved = lambda t: F.count_if((F.col("value_type") == t) & ~formula & ~F.coalesce(F.col("__t") == t, F.lit(False)))
    return j.groupBy("file_id").agg(
        F.count_if(formula & kept).alias("formulas_kept"), F.count_if(formula & ~kept).alias("formulas_changed"), moved("number").alias("numbers_changed"), moved("date").alias("dates_changed")
    )


def shape_check(source: DataFrame, output: DataFrame) -> DataFrame:
    """Sheets whose presence, rows, columns or counts of tables, formats and validations differ; null is none."""
    parts = ["rows", "cols", "tables", "formats", "validations"]
    o = output.select("file_id", "sheet", F.struct(*parts).alias("__o"))
    j = source.select("file_id", "sheet", F.struct(*parts).alias("__s")).join(o, ["file_id", "sheet"], "full_outer")
    differs = F.array(*[F.when(~F.coalesce(F.col(f"__s.{p}"), F.lit(0)).eqNullSafe(F.coalesce(F.col(f"__o.{p}"), F.lit(0))), p) for p in parts])
    problems = F.when(F.col("__s").isNull(), F.array(F.lit("added"))).when(F.col("__o").isNull(), F.array(F.lit("removed"))).otherwise(F.filter(differs, lambda p: p.isNotNull()))
    return j.withColumn("problems", problems).filter(F.size("problems") > 0).select("file_id", "sheet", "problems")


def residual_in_rects(findings: DataFrame, words: DataFrame, pad: float = 2.0) -> DataFrame:
    """Enabled findings whose original can still be read within their own rectangle, which is widened by ``pad``.

    Words whose centre lies in it are joined in reading order. A finding without a rectangle is held against its page.
    """
    f = findings.filter(F.col("enabled") & (F.col("original") != ""))
    cx, cy = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.y0") + F.col("w.y1")) / 2
    inside = F.col("f.x0").isNull() | (cx.between(F.col("f.x0") - pad, F.col("f.x1") + pad) & cy.between(F.col("f.y0") - pad, F.col("f.y1") + pad))
    j = f.alias("f").join(words.alias("w"), [F.col("f.file_id") == F.col("w.file_id"), F.col("f.page") == F.col("w.page"), inside])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("w.block", "w.line", "w.word_no", "w.text"))), lambda x: x["text"]), "")
    read = j.groupBy("f.file_id", "f.page", "f.finding_id", "f.original").agg(text.alias("residual"))
    return read.filter(F.col("residual").contains(F.regexp_replace("original", r"(?U)\s+", "")))


def sanitised(properties: DataFrame, keep=("format", "encryption")) -> DataFrame:
    """Metadata of outputs: every value but those of ``keep`` is emptied; ``removed`` tells what was."""
    drop = ~F.col("name").isin(*keep) & (F.coalesce("value", F.lit("")) != "")
    return properties.withColumn("removed", drop).withColumn("value", F.when(drop, "").otherwise(F.col("value")))


def release_outputs(outputs: DataFrame, residuals: DataFrame, external: bool) -> DataFrame:
    """Outputs (file_id) with the number of values left in them; for use outside such outputs are to be deleted."""
    n = residuals.groupBy("file_id").agg(F.count("*").alias("left_over"))
    out = outputs.join(n, "file_id", "left").withColumn("left_over", F.coalesce("left_over", F.lit(0)))
    action = F.when(F.col("left_over") == 0, "keep").otherwise("delete" if external else "warn")
    return out.withColumn("action", action)


def metric_integrity(metrics: DataFrame) -> DataFrame:
    """(run, check, ok) of counts and ratios that must fit together."""
    checks = [
        ("truths", F.col("matched") + F.col("missed") == F.col("truths")), ("candidates", F.col("true_positive") + F.col("false_positive") == F.col("candidates")),
        *[(c, F.col(c).between(0.0, 1.0)) for c in SHARES],
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok")) for n, ok in checks])
    return metrics.select("run", F.explode(rows).alias("r")).select("run", "r.*")


def compare_runs(before: DataFrame, after: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """(key, metric, before, after, difference) for rows of both runs."""
    long = lambda df, name: df.select(*key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("m")).select(*key, "m.*")
    both = long(before, "before").join(long(after, "after"), [*key, "metric"])
    return both.withColumn("difference", F.col("after") - F.col("before"))


def accepted(before: DataFrame, after: DataFrame, key: list[str], slack: float = 0.01) -> DataFrame:
    """(key, accepted): no fewer matches, no more false positives, no lower precision, coverage lower by ``slack`` at most."""
    b = before.select(*key, F.struct("matched", "false_positive", "candidate_precision", "average_coverage").alias("b"))
    ok = (
        (F.col("matched") >= F.col("b.matched")) & (F.col("false_positive") <= F.col("b.false_positive")) & (F.col("candidate_precision") >= F.col("b.candidate_precision"))
        & (F.col("average_coverage") >= F.col("b.average_coverage") - slack)
    )
    return after.join(b, key).select(*key, ok.alias("accepted"))


def not_reproduced(frozen: DataFrame, now: DataFrame, key: list[str], metrics: list[str], digits: int = 9) -> DataFrame:
    """Frozen metrics that a new run does not give again."""
    return compare_runs(frozen, now, key, metrics).filter(F.round("difference", digits) != 0)


def review_queue(records: DataFrame, with_confirmed: bool = False, first: int | None = None) -> DataFrame:
    """Records in the order to look at them: by status, page, id; ``first`` of them for a preview."""
    rank = F.array_position(F.array(*map(F.lit, REVIEW_RANKS)), F.col("status"))
    rows = records if with_confirmed else records.filter(F.col("status") != REVIEW_RANKS[-1])
    ordered = rows.orderBy(F.when(rank == 0, 99).otherwise(rank), "page", "truth_id")
    return ordered if first is None else ordered.limit(first)


def best_condition(conditions: DataFrame, key: list[str]) -> DataFrame:
    """Of each key the condition with most exact hits, then most correct characters, fewest false positives, least time."""
    order = F.struct("exact_hits", "correct_chars", (-F.col("false_positives")).alias("f"), (-F.col("seconds")).alias("s"))
    return conditions.groupBy(*key).agg(F.max_by("condition", order).alias("condition"))


def page_transition(state: Column, event: Column) -> Column:
    """The state of a page after an event; a page that cannot make the step stays as it is."""
    seen = state.isin("REVIEWED_NO_SENSITIVE_DATA", "REVIEWED_WITH_REDACTIONS", "COMPLETED")
    return (
        F.when(event == "no_sensitive_data", "REVIEWED_NO_SENSITIVE_DATA").when(event == "redacted", "REVIEWED_WITH_REDACTIONS").when(event == "verification_failed", "VERIFICATION_FAILED")
        .when((event == "written") & seen, "COMPLETED").otherwise(state)
    )


def page_states(pages: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """Pages (key, quality) after their events (key, seq, event) in order, by one fold a page."""
    e = events.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("__e"))
    first = F.when(F.col("quality") == "FAILED", "FAILED_UNRESOLVED").otherwise("UNREVIEWED")
    none = F.array().cast("array<struct<seq:bigint,event:string>>")
    events_ = F.coalesce(F.col("__e").cast("array<struct<seq:bigint,event:string>>"), none)
    return pages.join(e, key, "left").withColumn("state", F.aggregate(events_, first, lambda s, x: page_transition(s, x["event"]))).drop("__e")


def apply_manual_edits(findings: DataFrame, edits: DataFrame, key: str = "finding_id") -> DataFrame:
    """Findings after manual additions, changes, deletions and merges.

    Edits are (seq, action, finding_id, into, category, replacement, x0, y0, x1, y1). The last change of a finding counts.
    Only manual findings are deleted. Merged ones are switched off, and the one they go into covers them all.
    """
    box = ["x0", "y0", "x1", "y1"]
    added = edits.filter("action = 'add'").select(key, F.coalesce("category", F.lit("手動追加")).alias("category"), F.coalesce("replacement", F.lit("[REDACTED]")).alias("replacement"), *box, F.lit(True).alias("enabled"), F.lit(True).alias("manual"))
    every = findings.select(key, "category", "replacement", *box, "enabled", "manual").unionByName(added)
    last = edits.filter("action = 'edit'").groupBy(key).agg(F.max_by(F.struct("category", "replacement", *box), "seq").alias("e"))
    every = every.join(last, key, "left")
    every = every.select(key, *[F.coalesce(f"e.{c}", c).alias(c) for c in ("category", "replacement", *box)], "enabled", "manual")
    gone = edits.filter("action = 'delete'").select(key).distinct().withColumn("__gone", F.lit(True))
    every = every.join(gone, key, "left").filter(~(F.col("manual") & F.coalesce("__gone", F.lit(False)))).drop("__gone")
    merged = edits.filter("action = 'merge'").select(key, "into").distinct()
    parts = merged.join(every, key).groupBy(F.col("into").alias(key)).agg(*[(F.min if c in ("x0", "y0") else F.max)(c).alias(f"__{c}") for c in box])
    every = every.join(parts, key, "left").join(merged.select(key, F.lit(True).alias("__off")).distinct(), key, "left")
    wide = {c: (F.least if c in ("x0", "y0") else F.greatest)(F.col(c), F.coalesce(F.col(f"__{c}"), F.col(c))) for c in box}
    on = F.when(F.col("__off"), False).when(F.col("__x0").isNotNull(), True).otherwise(F.col("enabled"))
    return every.withColumns(wide).withColumn("enabled", on).drop(*[f"__{c}" for c in box], "__off")


def rect_pixels(rects: DataFrame, dpi: float = 300.0, least: int = 3) -> DataFrame:
    """Rectangles cut to their page with their size in pixels, and a warning where recognition could not read them."""
    cut = {c: F.greatest(F.lit(0.0), F.least(c, "page_width" if c[0] == "x" else "page_height")) for c in ("x0", "y0", "x1", "y1")}
    r = rects.withColumns(cut)
    w, h = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0)), F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))
    r = r.withColumn("width_px", w * dpi / 72).withColumn("height_px", h * dpi / 72)
    return r.withColumn("warning", F.when((w <= 0) | (h <= 0), "EMPTY").when(F.least("width_px", "height_px") < least, "TOO_SMALL").otherwise(""))


def derived_pages(words: DataFrame, order: DataFrame, scale: float = 1.0) -> DataFrame:
    """Word tables of pages chosen, put in another order and scaled: ``order`` holds (page, new_page)."""
    out = words.join(F.broadcast(order), "page").drop("page").withColumnRenamed("new_page", "page")
    return out.withColumns({c: F.col(c) * scale for c in ("x0", "y0", "x1", "y1")}).select(*words.columns)
