"""Review decisions as tables: statuses, transitions, safety gates, saved states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REVIEW_BELOW = 0.75  # confidence under which a finding must be looked at


def requires_review(score: Column, source: Column) -> Column:
    return (score < REVIEW_BELOW) & (source != "hyperlink")


def status(enabled: Column, excluded: Column, review: Column, manual: Column) -> Column:
    return (
        F.when(excluded, "除外").when(manual & enabled, "手動追加").when(enabled & review, "承認済み").when(enabled, "自動採用").when(review, "要確認").otherwise("無効")
    )


def exclusive(df: DataFrame) -> DataFrame:
    """A finding that is enabled is not excluded."""
    return df.withColumn("excluded", F.col("excluded") & ~F.col("enabled"))


def apply_events(findings: DataFrame, events: DataFrame) -> DataFrame:
    """The last decision on each finding wins; manual findings stay enabled."""
    last = events.groupBy("finding_id").agg(F.max_by("approve", "seq").alias("approve"))
    out = findings.join(last, "finding_id", "left")
    enabled = F.when(F.col("manual"), True).otherwise(F.coalesce("approve", "enabled"))
    return exclusive(out.withColumn("enabled", enabled)).drop("approve")


def page_state(quality: Column, confirmed: Column, n_findings: Column) -> Column:
    return (
        F.when((quality == "FAILED") & ~confirmed, "FAILED_UNRESOLVED")
        .when(confirmed & (n_findings > 0), "REVIEWED_WITH_REDACTIONS")
        .when(confirmed, "REVIEWED_NO_REDACTION")
        .otherwise("UNREVIEWED")
    )


def output_gate(pages: DataFrame) -> DataFrame:
    """Per file whether it may be written, and why not: one conditional aggregation over its page states."""
    c = pages.groupBy("file_id").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("review_state") == "UNREVIEWED").alias("unreviewed"),
        F.count_if(F.col("review_state") == "FAILED_UNRESOLVED").alias("failed"),
    )
    reasons = F.array(F.when(F.col("unreviewed") > 0, "unreviewed_pages"), F.when(F.col("failed") > 0, "failed_pages"))
    return c.withColumn("reasons", F.array_join(F.filter(reasons, lambda r: r.isNotNull()), ";")).withColumn("ok", F.col("reasons") == "")


def decision_gates(decisions: DataFrame, unsupported: DataFrame, external: bool) -> DataFrame:
    """One row per failed gate: unreviewed, hyperlink enabled, unsupported part, nothing selected."""
    d = decisions.agg(
        F.count_if(requires_review(F.col("score"), F.col("source")) & ~F.col("enabled") & ~F.col("excluded")).alias("unreviewed"),
        F.count_if((F.col("source") == "hyperlink") & F.col("enabled")).alias("hyperlink"),
        F.count_if("enabled").alias("enabled"),
    )
    u = unsupported.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("unsupported"))
    rows = d.crossJoin(u).select(
        F.explode(
            F.array(
                F.struct(F.lit("unreviewed").alias("gate"), F.col("unreviewed").alias("n"), (F.col("unreviewed") > 0).alias("blocks")),
                F.struct(F.lit("hyperlink").alias("gate"), F.col("hyperlink").alias("n"), (F.col("hyperlink") > 0).alias("blocks")),
                F.struct(F.lit("unsupported").alias("gate"), F.col("unsupported").alias("n"), ((F.col("unsupported") > 0) & F.lit(external)).alias("blocks")),
                F.struct(F.lit("nothing_selected").alias("gate"), F.col("enabled").alias("n"), (F.col("enabled") == 0).alias("blocks")),
            ).cast("array<struct<gate:string,n:bigint,blocks:boolean>>")
        ).alias("g")
    )
    return rows.select("g.*")


def overlap_violations(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans that reach into the next one of their unit."""
    nxt = F.lead("start").over(Window.partitionBy(*by).orderBy("start", "end"))
    return spans.withColumn("next_start", nxt).filter(F.col("end") > F.col("next_start"))


def restore(fresh: DataFrame, saved: DataFrame, key: str = "state_id") -> DataFrame:
    """Saved decisions onto fresh findings, by id."""
    s = saved.select(key, F.col("enabled").alias("__e"), F.col("replacement").alias("__r"))
    out = fresh.join(s, key, "left")
    return out.withColumn("enabled", F.coalesce("__e", "enabled")).withColumn("replacement", F.coalesce("__r", "replacement")).drop("__e", "__r")


def next_unresolved(pages: DataFrame) -> DataFrame:
    """For every page the next unresolved one of its file, starting again at the first."""
    open_ = F.when(F.col("unresolved"), F.col("page"))
    w = Window.partitionBy("file_id")
    after = F.min(open_).over(w.orderBy("page").rowsBetween(1, Window.unboundedFollowing))
    return pages.withColumn("next_page", F.coalesce(after, F.min(open_).over(w)))
