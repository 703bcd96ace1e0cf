"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, block by block. A first pass builds one score histogram per query over
its whole possible range; the bin that holds the k-th best score is cut into finer bins by the next pass, until a
bin is one integer wide. That integer is the query's k-th score. A last pass filters: everything above it, and of
the rows equal to it the smallest ids.

A block reports only bins that can still decide the k-th place (those of its own k best scores in range), so a
histogram has at most k bins a block and a query, whatever the data; this changes no decision, because fewer than
k rows of a block can lie above the k-th score.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import against, finite_vectors, pack, query_blocks, ranked, unpack
from .common import discard, materialize

BINS = 4096


def integer_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of integral doubles as int64: by BLAS while every sum is below 2**53, else by int64 sums.

    Components beyond the range of int64 are outside the contract: their products wrap around.
    """
    top = (np.abs(q).max(initial=0.0)) * (np.abs(v).max(initial=0.0)) * max(1, q.shape[1])
    if top < 2.0**53:
        return (q @ v.T).astype(np.int64)
    return q.astype(np.int64) @ v.astype(np.int64).T


def _pair(r, q):
    own = np.frombuffer(q.qblock, np.int32) == r.block
    return *unpack(r.ids, r.vecs, r.dim), *unpack(q.qids, q.qvecs, q.dim), own, np.frombuffer(q.qpos, np.int32)


def _chunks(qm: np.ndarray, m: np.ndarray, own: np.ndarray, pos: np.ndarray, rows: int = 256):
    """Scores of some queries at a time, and a mask that is false at each query's own row."""
    for a in range(0, len(qm), rows):
        s = integer_scores(qm[a : a + rows], m)
        free = np.ones(s.shape, bool)
        mine = np.flatnonzero(own[a : a + rows])
        free[mine, pos[a : a + rows][mine]] = False
        yield a, s, free


def histogram_top_k(
    embeddings: DataFrame,
    k: int,
    every: int,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 256,
    rows_per_block: int = 4096,
    queries_per_block: int = 1024,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its k best other rows.

    Components become ``floor(scale * x)``; the score is their integer inner product. Rows without an id, and
    vectors that are null or hold null or non-finite components, take no part. Only vectors of equal length are
    compared. A repeated row is a row of its own: it is a candidate for its copies. Fewer than k candidates: all
    of them. No rows in: no rows out. Extra columns are ignored.
    """
    spark: SparkSession = embeddings.sparkSession
    vectors = finite_vectors(embeddings, id_col, vec_col, nonzero=False)
    vectors = vectors.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))
    total = vectors.count()
    nb = max(1, math.ceil(total / rows_per_block))
    nq = max(1, math.ceil(total / every / queries_per_block))
    blocks = pack(vectors, nb, "topk-blocks")
    queries = query_blocks(blocks, every, nq, "topk-queries")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    reach = vectors.select(F.max(norm)).first()[0] or 0.0

    def start(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                _, qm = unpack(r.qids, r.qvecs, r.dim)
                top = np.minimum(np.ceil(np.sqrt((qm * qm).sum(axis=1)) * reach) + 1, 2.0**62).astype(np.int64)
                yield pd.DataFrame({"dim": r.dim, "qb": r.qb, "qrow": np.arange(r.qn, dtype=np.int32), "lo": -top, "hi": top + 1, "above": 0})

    bounds = materialize(queries.mapInPandas(start, "dim int, qb int, qrow int, lo long, hi long, above int"), "topk-bounds")

    def with_bounds() -> DataFrame:
        packed = bounds.groupBy("dim", "qb").agg(F.sort_array(F.collect_list(F.struct("qrow", "lo", "hi", "above"))).alias("range"))
        q = queries.hint("merge").join(packed, ["dim", "qb"]).select(queries["*"], *(F.col(f"range.{c}").alias(c) for c in ("lo", "hi", "above")))
        return materialize(q, "topk-ranges")

    def count(r, q):
        _, m, _, qm, own, pos = _pair(r, q)
        lo, hi, need = np.asarray(q.lo, np.int64), np.asarray(q.hi, np.int64), k - np.asarray(q.above, np.int64)
        width = -(-(hi - lo) // BINS)
        for a, s, free in _chunks(qm, m, own, pos):
            b = slice(a, a + len(s))
            held = free & (s >= lo[b, None]) & (s < hi[b, None])
            n = min(k, s.shape[1])
            if np.count_nonzero(held) > 8 * n * len(s):  # the first pass: cut to the k best by their scores
                best = np.where(held, s, lo[b, None] - 1)
                best.partition(s.shape[1] - n, axis=1)
                best = best[:, s.shape[1] - n :].ravel()
                row = np.repeat(np.arange(a, a + len(s)), n)[best >= np.repeat(lo[b], n)]
                best = best[best >= np.repeat(lo[b], n)]
            else:
                row, col = np.nonzero(held)
                best = s[row, col]
                order = np.lexsort((-best, row))
                row, best = row[order], best[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < n
                row, best = row[first] + a, best[first]
            got, cnt = np.unique(np.stack([row, (best - lo[row]) // width[row]]), axis=1, return_counts=True)
            keep = need[got[0]] > 0
            yield pd.DataFrame({"dim": q.dim, "qb": q.qb, "qrow": got[0][keep].astype(np.int32), "bin": got[1][keep], "n": cnt[keep]})

    while (bounds.select(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0) > 1:
        ranges = with_bounds()
        hist = against(blocks, ranges, count, "dim int, qb int, qrow int, bin long, n long")
        hist = hist.groupBy("dim", "qb", "qrow", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("dim", "qb", "qrow").orderBy(F.col("bin").desc())
        hist = hist.withColumn("upto", F.sum("n").over(w)).join(bounds.hint("merge"), ["dim", "qb", "qrow"])
        at = hist.filter((F.col("above") + F.col("upto") >= k) & (F.col("above") + F.col("upto") - F.col("n") < k))
        width = F.expr(f"(hi - lo + {BINS - 1}) div {BINS}")
        at = at.select(
            "dim", "qb", "qrow",
            (F.col("lo") + F.col("bin") * width).alias("lo1"),
            F.least(F.col("hi"), F.col("lo") + (F.col("bin") + 1) * width).alias("hi1"),
            (F.col("above") + F.col("upto") - F.col("n")).cast("int").alias("above1"),
        )
        # a query with fewer than k candidates keeps them all: its range closes on its lowest value
        bounds = materialize(
            bounds.hint("merge").join(at, ["dim", "qb", "qrow"], "left").select(
                "dim", "qb", "qrow",
                F.coalesce("lo1", "lo").alias("lo"),
                F.coalesce("hi1", F.col("lo") + 1).alias("hi"),
                F.coalesce("above1", "above").alias("above"),
            ),
            "topk-bounds",
        )
        discard(ranges)

    def final(r, q):
        ids, m, qids, qm, own, pos = _pair(r, q)
        kth = np.asarray(q.lo, np.int64)
        for a, s, free in _chunks(qm, m, own, pos):
            at = kth[a : a + len(s), None]
            row, col = np.nonzero(free & (s > at))
            tr, tc = np.nonzero(free & (s == at))  # ids are sorted within a block: the first are the smallest
            nth = np.arange(len(tr)) - np.searchsorted(tr, tr)
            tr, tc = tr[nth < k], tc[nth < k]
            row, col = np.concatenate([row, tr]), np.concatenate([col, tc])
            yield pd.DataFrame({"query_id": qids[a + row], "qb": q.qb, "qrow": (a + row).astype(np.int32), "vec_id": ids[col], "score": s[row, col]})

    found = against(blocks, with_bounds(), final, "query_id long, qb int, qrow int, vec_id long, score long")
    return ranked(found, k, "long")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: rows with vec_id divisible by 50 against all rows, five best."""
    return histogram_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
