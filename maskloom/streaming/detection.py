"""Streaming extension: detection on arriving texts, and an alias book that grows with them.

Detection keeps no state. Aliases are a table: every batch merges its new keys into the book it finds, written as a
new version, so a batch that is run again after a failure finds the same book and gives the same aliases.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import alias_key
from ..operators.alias import merge_books, number_aliases
from ..operators.detect import detect, kind_of
from ..operators.rules import Rule


def detected_stream(stream: DataFrame, rules: Iterable[Rule], id_col: str = "doc_id") -> DataFrame:
    """(id, start, end, kind, value) of arriving texts."""
    d = detect(stream, rules)
    return d.select(id_col, F.explode("spans").alias("x")).select(id_col, "x.start", "x.end", kind_of(F.col("x.category")).alias("kind"), F.col("x.text").alias("value"))


def grow_alias_book(spans: DataFrame, book_path: str, checkpoint: str, id_col: str = "doc_id") -> StreamingQuery:
    """Keep an alias book below ``book_path``: version n holds all aliases after batch n."""

    def merge(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = batch.withColumn("norm_key", alias_key(F.col("kind"), F.col("value"))).withColumn("ord", F.struct(id_col, "start"))
        firsts = rows.groupBy("kind", "norm_key").agg(F.min("ord").alias("ord"))
        if number == 0:
            book = number_aliases(firsts, [])
        else:
            book = merge_books(spark.read.parquet(f"{book_path}/v{number - 1}"), firsts, [])
        book.write.mode("overwrite").parquet(f"{book_path}/v{number}")

    return spans.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of event types in tumbling windows, late rows dropped after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"))
