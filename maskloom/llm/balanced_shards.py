"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. Every linked document starts in a shard drawn by hash; each round joins a
group's documents with the counts of its members by shard and moves those elsewhere towards the shard that holds
most of the group, while that shard's quota lasts. When shards are full, groups turn to the next best open one.
At last every shard is filled to its exact number of rows with unlinked documents, which may lie anywhere.

The members of one group in one shard are interchangeable, so a round works on (group, unit, shard, count) rows, not
on documents or pairs: a group has at most one row a shard in the counts, and its documents are cut into units of
bounded size that move, and are ranked, independently. A group of any size is spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_text, materialize

UNIT_ROWS = 128
PRIORITIES = 1024  # moves are accepted in this many groups a shard, until its quota is used


def _loads(state: DataFrame, shards: int) -> list[int]:
    """Linked documents in each shard; one number a shard comes to the driver."""
    got = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def _lookup(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), index + 1)


def propagate(state: DataFrame, shards: int, capacity: int, rounds: int) -> tuple[DataFrame, list[int]]:
    """Move (gk, unit, shard, n) rows towards their groups' shards; the final state and the rows moved by round."""
    moved = []
    for turn in range(rounds):
        loads = _loads(state, shards)
        room = [max(0, capacity - x) for x in loads]
        counts = state.groupBy("gk", "shard").agg(F.sum("n").alias("members"))
        open_ = counts.filter(_lookup(room, F.col("shard")) > 0)
        tie = F.xxhash64("gk", "shard")
        best = open_.groupBy("gk").agg(F.max(F.struct("members", tie.alias("tie"), "shard")).alias("best"))
        here = state.join(counts, ["gk", "shard"]).join(best, "gk", "left")
        better = F.struct(F.col("best.members"), F.col("best.tie")) > F.struct("members", tie)
        wish = F.when(F.col("best").isNotNull() & better & (F.col("best.shard") != F.col("shard")), F.col("best.shard"))
        here = here.select(
            "gk", "unit", "shard", "n", wish.alias("to"),
            F.pmod(F.xxhash64("gk", "unit", "shard", F.lit(turn)), F.lit(PRIORITIES)).alias("priority"),
        )
        asked = here.filter(F.col("to").isNotNull()).groupBy("to", "priority").agg(F.sum("n").alias("asked"))
        upto = F.sum("asked").over(Window.partitionBy("to").orderBy("priority"))
        granted = asked.withColumn("upto", upto).filter(F.col("upto") <= _lookup(room, F.col("to"))).select("to", "priority", F.lit(True).alias("yes"))
        # at most shards * PRIORITIES rows, whatever the data
        after = here.join(F.broadcast(granted), ["to", "priority"], "left")
        after = after.select("gk", "unit", F.when(F.col("yes"), F.col("to")).otherwise(F.col("shard")).alias("shard"), "n", F.when(F.col("yes"), F.col("n")).otherwise(0).alias("moved"))
        state = materialize(
            after.groupBy("gk", "unit", "shard").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved")), "shards-state"
        )
        moved.append(state.agg(F.sum("moved")).first()[0] or 0)
        state = state.drop("moved")
        if not moved[-1]:
            break
    return state, moved


def _rank(rows: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """Add ``rank``, gapless from 0 within ``by``: ranks within hash buckets plus the rows of earlier buckets."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("rank")), F.lit(buckets)))
    sizes = rows.groupBy(*by, "bucket").count()
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy(*by, "bucket").orderBy("doc_id", "size", "text_crc32")
    nth = rows.withColumn("nth", F.row_number().over(own) - 1)
    return nth.join(sizes, [*by, "bucket"]).withColumn("rank", F.col("before") + F.col("nth")).drop("bucket", "before", "nth")


def balanced_shards(docs: DataFrame, shards: int = 16, rounds: int = 8, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) with law ``rows``: counts at most one apart.

    ``size`` is the text's UTF-8 bytes plus one (null: one). Null texts are linked with nothing; empty texts are
    equal texts. Rows with a null or repeated doc_id are rows like any other. No rows in: no rows out. Extra columns
    are ignored. ``grown_shard`` is null under this law.
    """
    text = F.col("text").cast("string")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long").alias("size"),
        crc32_text(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("gk"),
    )
    base = materialize(base, "shards-base")
    total = base.count()
    capacity = total // shards
    unit_rows = max(1, min(unit_rows, capacity // 4))
    groups = base.filter(F.col("gk").isNotNull()).groupBy("gk").agg(F.count("*").alias("members")).filter(F.col("members") > 1)
    tagged = base.join(groups, "gk", "left")
    unit = F.pmod(F.xxhash64("doc_id", "size", F.lit("unit")), F.ceil(F.col("members") / unit_rows))
    linked = materialize(tagged.filter(F.col("members").isNotNull()).withColumn("unit", unit).drop("members"), "shards-linked")
    start = F.pmod(F.xxhash64("doc_id", "size", F.lit("start")), F.lit(shards)).cast("int")
    state = materialize(linked.withColumn("shard", start).groupBy("gk", "unit", "shard").agg(F.count("*").alias("n")), "shards-state")
    state, _ = propagate(state, shards, capacity, rounds)

    # documents of a unit take its shards in turn
    turn = Window.partitionBy("gk", "unit").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shares = state.withColumn("from", F.coalesce(F.sum("n").over(turn), F.lit(0)))
    shares = shares.groupBy("gk", "unit").agg(F.sort_array(F.collect_list(F.struct("from", "shard"))).alias("shares"))
    own = Window.partitionBy("gk", "unit").orderBy("doc_id", "size")
    placed = linked.withColumn("nth", F.row_number().over(own) - 1).join(shares, ["gk", "unit"])
    shard = F.element_at(F.filter("shares", lambda x: x["from"] <= F.col("nth")), -1)["shard"]
    placed = placed.select("doc_id", "size", "text_crc32", shard.alias("shard"))

    buckets = max(1024, total // 50_000)
    quota = [capacity + (s < total % shards) for s in range(shards)]
    kept = [min(a, b) for a, b in zip(quota, _loads(state, shards))]
    placed = materialize(_rank(placed, ["shard"], buckets), "shards-placed")
    stay = placed.filter(F.col("rank") < _lookup(quota, F.col("shard")))
    over = placed.filter(F.col("rank") >= _lookup(quota, F.col("shard")))
    free = tagged.filter(F.col("members").isNull()).select("doc_id", "size", "text_crc32")
    free = _rank(free.unionByName(over.select("doc_id", "size", "text_crc32")).withColumn("all", F.lit(0)), ["all"], buckets)
    upto = [sum(quota[: s + 1]) - sum(kept[: s + 1]) for s in range(shards)]
    to = reduce(lambda a, b: a + b, [(F.col("rank") >= u).cast("int") for u in upto])
    first = [kept[s] - (upto[s] - (quota[s] - kept[s])) for s in range(shards)]
    free = free.withColumn("shard", to).withColumn("rank", F.col("rank") + _lookup(first, F.col("shard")))
    cols = ["doc_id", "size", "text_crc32", "shard", "rank"]
    return stay.select(*cols).unionByName(free.select(*cols)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("rank").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: all documents into shards 0 to 15, counts at most one apart."""
    return balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
