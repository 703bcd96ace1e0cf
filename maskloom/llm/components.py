"""Connected components of an edge table, by alternating star operations in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """Large star, then small star: neighbours move to the smallest of their neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.filter(F.col("u") != F.col("v")).distinct()  # now u > v
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u")
    out = small.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """(v, comp) for every vertex of the (u, v) edges: comp is the smallest vertex of its component.

    Every round halves the depth of the trees or better; rounds are written to the shared folder.
    """
    now = edges.filter(F.col("u") != F.col("v"))
    now = materialize(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = None
    for _ in range(most_rounds):
        row = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(row) == seen:
            break
        seen = tuple(row)
        if not row[0]:
            break
        now = materialize(_stars(now), name)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.unionByName(roots).groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "v")
