"""Ordinals of more digits than SQL's lpad leaves."""

from compare import same
from pyspark.sql import functions as F

from maskloom.plans import registry


def test_page_ordinals_above_999(spark, sf, tmp_path):
    import os

    for name in os.listdir(sf):
        (tmp_path / name).symlink_to(f"{sf}/{name}")
    (tmp_path / "supplier.parquet").unlink()
    spark.range(1100).select(F.col("id").alias("s_suppkey"), F.lit(101).alias("s_nationkey")).toPandas().to_parquet(tmp_path / "supplier.parquet")
    same(registry.QUERIES["page_ordinals"](spark, str(tmp_path)), registry.ORACLES["page_ordinals"], str(tmp_path))
