"""Checks of outputs: left-over values, workbook differences, determinism, splits."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_placeholder


def sensitive_values(findings: DataFrame, least: int = 3) -> DataFrame:
    """Distinct originals worth looking for, aliases left out."""
    v = F.col("original")
    return findings.filter((F.length(v) >= least) & ~is_placeholder(v)).select(v.alias("value"), "category").distinct()


def residual_values(parts: DataFrame, values: DataFrame, part_key: list[str], text: str = "content", token: str = r"[^\s<>\"'=;,()\[\]]+") -> DataFrame:
    """(part, value, category) of values that still stand in a part as a word or within one word.

    Values and words meet by their first three characters at each place of a word, so a value is compared only with
    words that hold its beginning; the pairs are then checked by ``contains``. Values with white space are looked up
    by their first word and checked against the whole part.
    """
    words = parts.select(*part_key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(token), F.lit(0)))).alias("word"))
    grams = words.filter(F.length("word") >= 3).withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substring("word", i, F.lit(3))))))
    first = F.regexp_extract("value", token, 0)
    keyed = values.withColumn("__w", first).filter(F.length("__w") >= 3).withColumn("gram", F.substring("__w", 1, 3))
    hit = grams.join(keyed, "gram").filter(F.col("word").contains(F.col("__w"))).select(*part_key, "value", "category", "__w").distinct()
    single = hit.filter(F.col("value") == F.col("__w"))
    many = hit.filter(F.col("value") != F.col("__w")).join(parts.select(*part_key, text), part_key).filter(F.col(text).contains(F.col("value")))
    return single.select(*part_key, "value", "category").unionByName(many.select(*part_key, "value", "category"))


def workbook_diff(actual: DataFrame, expected: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Cells of the expected side that are missing or differ."""
    a = actual.select(*keys, F.col(value).alias("actual"), F.lit(1).alias("__a"))
    e = expected.select(*keys, F.col(value).alias("expected"))
    out = e.join(a, keys, "left").filter(~F.col("expected").eqNullSafe(F.col("actual")))
    return out.withColumn("problem", F.when(F.col("__a").isNull(), "MISSING").otherwise("DIFFERENT")).drop("__a")


def expected_judgements(expected: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """Targets without a finding, and excluded places with an enabled one."""
    on = findings.filter("enabled").select(*keys).distinct()
    missing = expected.filter("judgement = 'target'").join(on, keys, "left_anti").withColumn("problem", F.lit("TARGET_MISSING"))
    still = expected.filter("judgement = 'exclude'").join(on, keys, "left_semi").withColumn("problem", F.lit("EXCLUDED_STILL_ENABLED"))
    return missing.unionByName(still)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    columns, sign = [F.col(f"`{c}`") for c in a.columns], F.lit(1).cast("long")
    both = a.select(*columns, sign.alias("__n")).union(b.select(*[F.col(f"`{c}`") for c in b.columns], (-sign).alias("__n")))
    return both.groupBy(*columns).agg(F.sum("__n").alias("__n")).filter("__n <> 0").isEmpty()


def signature(rows: DataFrame, by: list[str], name: str = "signature") -> DataFrame:
    """Per group the number of its rows and sums of their hashes, 128 bits in all, whatever the rows' order.

    Groups that hold the same rows as often have the same signature; others share one only by an accident of both
    hashes. Halves of a hash are added, so sums stay whole numbers up to 2^31 rows a group.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns if c not in by]
    nulls = reduce(add, (c.isNull().cast("int") * 2**i for i, c in enumerate(columns)))  # a hash leaves nulls out
    hashes = [F.xxhash64(F.lit(seed), nulls, *columns) for seed in (1, 2)]
    halves = [h for x in hashes for h in (x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(x, 32))]
    return rows.groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.struct(F.count("*"), *map(F.sum, halves)).alias(name))


def split_problems(splits: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that no split or more than one holds, and split pages that do not exist."""
    n = splits.groupBy("page").agg(F.count("*").alias("n"))
    both = pages.withColumn("__p", F.lit(1)).join(n, "page", "full_outer")
    problem = F.when(F.col("__p").isNull(), "UNKNOWN_PAGE").when(F.col("n").isNull(), "IN_NO_SPLIT").when(F.col("n") > 1, "IN_SEVERAL")
    return both.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("page", "problem")
