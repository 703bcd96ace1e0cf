"""Vectors in packed blocks, and the grid of query blocks against all blocks.

A vector search compares a stated query set with all rows. Both sides are dealt by a hash of the row into
blocks of bounded size; each pair of blocks is scored by one call of a numpy function. Either the pairs are rows of
a grid, or the tasks that hold blocks read the query blocks from the shared folder, one after the other.
Nothing is broadcast, no block grows with the input, and copies of one vector spread over all blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fs_and_path, materialize

BLOCK_SCHEMA = "dim int, block int, n int, ids binary, vecs binary"
QUERY_SCHEMA = "dim int, qb int, qn int, qids binary, qblock binary, qpos binary, qvecs binary"


def finite_vectors(df: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(id, vec): rows with an id whose vector holds only finite numbers, as doubles; optionally not all zero."""
    x = F.col("vec")
    ok = F.col("id").isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    if nonzero:
        ok = ok & F.exists(x, lambda v: v != 0)
    return df.select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")
    ).filter(ok)


def pack(vectors: DataFrame, n_blocks: int, name: str, prepare: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Blocks of (id, vec), dealt by a hash of the whole row, each sorted by id; written to the shared folder."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        dim, block = int(key[0]), int(key[1])
        m = np.array(pdf["vec"].tolist(), dtype=np.float64).reshape(len(pdf), dim)
        if prepare is not None:
            m = prepare(m)
        ids = pdf["id"].to_numpy(np.int64)
        return pd.DataFrame(
            {"dim": [dim], "block": [block], "n": [len(pdf)], "ids": [ids.tobytes()], "vecs": [m.tobytes()]}
        )

    dealt = vectors.select(
        "id", "vec", F.size("vec").alias("dim"), F.pmod(F.xxhash64("id", "vec"), F.lit(n_blocks)).cast("int").alias("block")
    )
    return materialize(dealt.groupBy("dim", "block").applyInPandas(one, BLOCK_SCHEMA), name)


def unpack(ids: bytes, vecs: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vecs, np.float64).reshape(len(i), dim)


def query_blocks(blocks: DataFrame, every: int, n_query_blocks: int, name: str) -> DataFrame:
    """The query rows (id divisible by ``every``) with their place in the index, packed anew in blocks."""

    def pick(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                ids, m = unpack(r.ids, r.vecs, r.dim)
                for p in np.flatnonzero(ids % every == 0):
                    out.append((r.dim, int(ids[p]), r.block, int(p), m[p].tobytes()))
            yield pd.DataFrame(out, columns=["dim", "qid", "block", "pos", "vec"])

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["qid", "block", "pos"])
        return pd.DataFrame(
            {
                "dim": [int(key[0])],
                "qb": [int(key[1])],
                "qn": [len(pdf)],
                "qids": [pdf["qid"].to_numpy(np.int64).tobytes()],
                "qblock": [pdf["block"].to_numpy(np.int32).tobytes()],
                "qpos": [pdf["pos"].to_numpy(np.int32).tobytes()],
                "qvecs": [b"".join(pdf["vec"])],
            }
        )

    rows = blocks.mapInPandas(pick, "dim int, qid long, block int, pos int, vec binary")
    dealt = rows.withColumn("qb", F.pmod(F.xxhash64("qid", "block", "pos"), F.lit(n_query_blocks)).cast("int"))
    return materialize(dealt.groupBy("dim", "qb").applyInPandas(one, QUERY_SCHEMA), name)


def grid(blocks: DataFrame, queries: DataFrame, n_blocks: int, n_query_blocks: int) -> DataFrame:
    """One row for each pair of a query block and a block of the same dimension, dealt by the pair."""
    left = blocks.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    right = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return left.join(right, ["dim", "block", "qb"])


def rows_of(path: str) -> Iterator:
    """The rows of a materialized table, few at a time, read by a task from the shared folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, root = fs_and_path(path)
    for info in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
        if info.base_name.endswith(".parquet"):
            with files.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f, buffer_size=1 << 20).iter_batches(batch_size=1):
                    yield from batch.to_pandas().itertuples(index=False)


def against(blocks: DataFrame, queries: DataFrame, score: Callable, schema: str) -> DataFrame:
    """``score(block row, query row)`` gives frames for each pair of equal dimension; ``queries`` is a materialized table.

    A task reads all query blocks once for each batch of its blocks. No vector is shuffled, copied or broadcast, so
    what is written does not grow with the number of pairs.
    """
    path = queries.materialized_at

    def run(batches):
        for pdf in batches:
            held = list(pdf.itertuples(index=False))
            for q in rows_of(path) if held else ():
                for r in held:
                    if r.dim == q.dim:
                        yield from score(r, q)

    return blocks.mapInPandas(run, schema)


def ranked(found: DataFrame, k: int, score_type: str) -> DataFrame:
    """The k best of each query over all blocks: higher scores first, ties to the smaller vec_id."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id", "qb", "qrow").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast(score_type).alias("score"))
    )
