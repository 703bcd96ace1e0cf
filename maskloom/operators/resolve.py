"""Resolution of overlapping spans and application of edits, as folds over one row's array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def greedy(spans: Column, same_category_only: bool = False) -> Column:
    """Spans by descending score and length, ties in the order they came, each taken if it overlaps none taken before.

    With ``same_category_only`` only spans of one category exclude one another. The result is in text order.
    """
    keyed = F.transform(spans, lambda x, i: F.struct((-x["score"]).alias("s"), (x["start"] - x["end"]).alias("n"), i.alias("i"), x.alias("x")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["x"])

    def clash(a: Column, b: Column) -> Column:
        hit = overlaps(a, b)
        return hit & (a["category"] == b["category"]) if same_category_only else hit

    def fold(o: Column) -> Column:
        return F.aggregate(
            o, F.slice(o, F.lit(1), F.lit(0)), lambda acc, x: F.when(F.exists(acc, lambda y: clash(x, y)), acc).otherwise(F.concat(acc, F.array(x)))
        )

    return F.array_sort(let(ordered, fold))


def apply_edits(text: Column, edits: Column) -> Column:
    """Replace the spans of ``edits`` (start, end, replacement; in text order, not overlapping), left to right."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        edits,
        first,
        lambda acc, e: F.struct(
            e["end"].cast("int").alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), e["replacement"]).alias("out")
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )


def coverage_anti_join(spans: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of the left table that overlap none of the right one's in the same unit."""
    c = covered.select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e"))
    on = [spans[k] == c[k] for k in keys] + [spans["start"] < c["__e"], c["__s"] < spans["end"]]
    return spans.join(c, on, "left_anti")


def affected_runs(spans: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Spans with the indices of the runs they touch, ascending."""
    r = runs.select(*keys, "run_index", F.col("char_start").alias("__s"), F.col("char_end").alias("__e"))
    hit = spans.join(r, keys).filter((F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end")))
    return hit.groupBy(*spans.columns).agg(F.sort_array(F.collect_list("run_index")).alias("run_idx"))


def run_edits(spans: DataFrame) -> DataFrame:
    """One row per affected run: the first takes the replacement, the others are emptied."""
    rows = spans.select("*", F.posexplode("run_idx").alias("pos", "run_index"))
    return rows.withColumn("new_text", F.when(F.col("pos") == 0, F.col("replacement")).otherwise(""))
