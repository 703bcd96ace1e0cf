"""Reading the driver's tables, and arithmetic stand-ins for layouts that they do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values_sql(rows: list[tuple], names: str) -> str:
    """The same rows as a VALUES list."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({names})"


LINES = """(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag,
  min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order and line number."""
    small = [F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag", "l_quantity")]
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*small)


def truth_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles from lineitem: page = order, type = return flag."""
    li = lines(spark, sf_dir)
    x0 = (F.col("l_suppkey") % 50 * 4).cast("double")
    y0 = (F.col("l_linenumber") * 20).cast("double")
    return li.select(
        (F.col("l_orderkey") % 5000).alias("page"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("truth_id"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 40).alias("x1"), (y0 + 10).alias("y1"),
    )


TRUTHS = f"""SELECT l_orderkey % 5000 AS page, l_returnflag AS kind, l_orderkey * 10 + l_linenumber AS truth_id,
  CAST(l_suppkey % 50 * 4 AS DOUBLE) AS x0, CAST(l_linenumber * 20 AS DOUBLE) AS y0,
  CAST(l_suppkey % 50 * 4 AS DOUBLE) + 40 AS x1, CAST(l_linenumber * 20 AS DOUBLE) + 10 AS y1 FROM {LINES}"""


def candidate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangles of all lines, shifted by their part, one in three far off the page, with a rule and a confidence."""
    li = lines(spark, sf_dir)
    far = F.when(F.col("l_partkey") % 3 == 0, 1000).otherwise(0)
    x0 = (F.col("l_suppkey") % 50 * 4 + F.col("l_partkey") % 8 + far).cast("double")
    y0 = (F.col("l_linenumber") * 20).cast("double")
    return li.select(
        (F.col("l_orderkey") % 5000).alias("page"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cand_id"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 41).alias("x1"), (y0 + 10).alias("y1"),
        F.concat(F.lit("rule_"), (F.col("l_partkey") % 5).cast("string")).alias("rule"),
        F.when(F.col("l_quantity") < 15, "LOW").when(F.col("l_quantity") < 35, "MEDIUM").otherwise("HIGH").alias("confidence"),
    )


CANDIDATES = f"""SELECT l_orderkey % 5000 AS page, l_returnflag AS kind, l_orderkey * 10 + l_linenumber AS cand_id,
  CAST(l_suppkey % 50 * 4 + l_partkey % 8 + CASE WHEN l_partkey % 3 = 0 THEN 1000 ELSE 0 END AS DOUBLE) AS x0, CAST(l_linenumber * 20 AS DOUBLE) AS y0,
  CAST(l_suppkey % 50 * 4 + l_partkey % 8 + CASE WHEN l_partkey % 3 = 0 THEN 1000 ELSE 0 END AS DOUBLE) + 41 AS x1, CAST(l_linenumber * 20 AS DOUBLE) + 10 AS y1,
  'rule_' || CAST(l_partkey % 5 AS VARCHAR) AS rule,
  CASE WHEN l_quantity < 15 THEN 'LOW' WHEN l_quantity < 35 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence
  FROM {LINES}"""

MATCHES = f"""truths AS ({TRUTHS}), cands AS ({CANDIDATES}), matches AS (
  SELECT page, kind, truth_id, cand_id, least(1.0, inter / 400.0) AS coverage,
    greatest(0.0, 410.0 - inter) / 410.0 AS excess_by_candidate, greatest(0.0, 410.0 - inter) / 400.0 AS excess_by_truth
  FROM (SELECT t.page, t.kind, truth_id, cand_id,
          greatest(0.0, least(t.x1, c.x1) - greatest(t.x0, c.x0)) * greatest(0.0, least(t.y1, c.y1) - greatest(t.y0, c.y0)) AS inter
        FROM truths t JOIN cands c ON t.page = c.page AND t.kind = c.kind)
  WHERE inter / 400.0 >= 0.85
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY truth_id ORDER BY coverage DESC, cand_id) AS n FROM matches) WHERE n = 1
)"""
