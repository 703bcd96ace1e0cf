"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index: a vector v = |v| o is turned by a fixed random rotation R, and only the signs of R o are kept, packed 64 to a
word, with two correction scalars: |v| and a = <sign(R o) / sqrt(D), R o>.
Search: a query is rotated and quantised to ``PLANES`` bits a component; bitwise AND and popcount of its bit planes
with a code give <code, R q>, and <code, R q> / a estimates <o, q>. The estimate's error is bounded with high
probability by eps * |q| * sqrt((1 - a^2) / (a^2 (D - 1))), plus what the quantisation of the query can add. Rows
whose upper bound reaches the k-th best exact score found so far are reranked with their original vectors, in
double precision; no others are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import finite_vectors, grid, pack, query_blocks, ranked, unpack
from .common import materialize

PLANES = 6


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix of twice ``dim``, rounded up to whole 64-bit words; zeros pad the vectors.

    Two bits a component narrow the error bounds by a factor of about 1.4, which saves far more reranking than the
    longer codes cost.
    """
    d = max(64, -(-2 * dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(m: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (uint64 words), norms and correction scalars of the rows of ``m``."""
    d = len(rot)
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    top = np.abs(m).max(axis=1)
    norm = np.where(np.isfinite(norm) & (norm > 0), norm, top)
    turned = (m / norm[:, None]) @ rot[:, : m.shape[1]].T
    bits = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64).reshape(len(m), d // 64)
    return bits, norm, np.abs(turned).sum(axis=1) / math.sqrt(d)


def estimate(q: np.ndarray, rot: np.ndarray, bits: np.ndarray, norm: np.ndarray, a: np.ndarray, eps: float):
    """Estimated inner products of queries with coded rows, and the bound of their error; both (queries, rows)."""
    d = len(rot)
    qn = np.sqrt(np.einsum("ij,ij->i", q, q))
    t = (q / qn[:, None]) @ rot[:, : q.shape[1]].T
    low = t.min(axis=1, keepdims=True)
    step = (t.max(axis=1, keepdims=True) - low) / (2**PLANES - 1)
    step[step == 0] = 1.0
    level = np.rint((t - low) / step).astype(np.uint8)
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    narrow = np.int16 if d * 2**PLANES < 2**15 else np.int32
    got = np.zeros((len(q), len(bits)), narrow)
    for j in range(PLANES):
        plane = np.packbits((level >> j) & 1, axis=1, bitorder="little").view(np.uint64).reshape(len(q), d // 64)
        for w in range(d // 64):
            got += np.bitwise_count(plane[:, w, None] & bits[None, :, w]).astype(narrow) << j
    on = low * ones[None, :] + step * got  # sum of the query's components where the code has a one
    whole = low[:, 0] * d + step[:, 0] * level.sum(axis=1)
    inner = (2 * on - whole[:, None]) / math.sqrt(d)
    scale = qn[:, None] * (norm / a)[None, :]
    spread = eps * np.sqrt(np.maximum(0.0, 1 - a * a) / (d - 1))
    return inner * scale, (spread[None, :] + step / 4) * scale


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of one query with some rows, in double precision; equal rows get equal scores."""
    return np.einsum("ij,j->i", v, q)


def best_of_block(q, own_pos, m, ids, rot, bits, norm, a, k, eps, rows=64):
    """(query row, block row, score) of the k best rows of a block for each query, by codes, bounds and reranking."""
    for at in range(0, len(q), rows):
        qs, own = q[at : at + rows], own_pos[at : at + rows]
        est, err = estimate(qs, rot, bits, norm, a, eps)
        mine = np.flatnonzero(own >= 0)
        est[mine, own[mine]] = -np.inf
        n = min(2 * k, len(m))
        first = np.argpartition(-est, n - 1, axis=1)[:, :n]
        for i, query in enumerate(qs):
            known = first[i][np.isfinite(est[i, first[i]])]
            kth = np.sort(exact(query, m[known]))[-k] if len(known) >= k else -np.inf
            c = np.flatnonzero((est[i] + err[i] >= kth) & np.isfinite(est[i]))
            s = exact(query, m[c])
            order = np.lexsort((ids[c], -s))[:k]
            yield np.full(len(order), at + i), c[order], s[order]


def coded_search(
    embeddings: DataFrame,
    k: int,
    every: int,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    seed: int = 7,
    eps: float = 2.5,
    rows_per_block: int = 4096,
    queries_per_block: int = 1024,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by inner product for each id divisible by ``every``.

    All rows are coded and all codes are scanned; ``eps`` sets how wide the error bounds are, and so recall. Rows
    without an id, and vectors that are null, empty, zero or hold null or non-finite components, take no part. Only
    vectors of equal length are compared. Repeated rows are candidates for one another; equal scores go to the
    smaller id. Fewer than k candidates: all of them. No rows in: no rows out. Extra columns are ignored.
    """
    vectors = finite_vectors(embeddings, id_col, vec_col, nonzero=True)
    total = vectors.count()
    nb = max(1, math.ceil(total / rows_per_block))
    nq = max(1, math.ceil(total / every / queries_per_block))
    plain = pack(vectors, nb, "codes-vectors")

    def code(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                _, m = unpack(r.ids, r.vecs, r.dim)
                bits, norm, a = encode(m, rotation(r.dim, seed))
                yield pd.DataFrame({"dim": [r.dim], "block": [r.block], "n": [r.n], "ids": [r.ids], "vecs": [r.vecs], "bits": [bits.tobytes()], "norms": [norm.tobytes()], "fixes": [a.tobytes()]})

    index = materialize(plain.mapInPandas(code, "dim int, block int, n int, ids binary, vecs binary, bits binary, norms binary, fixes binary"), "codes-index")
    queries = query_blocks(plain, every, nq, "codes-queries")

    def search(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, m = unpack(r.ids, r.vecs, r.dim)
                qids, q = unpack(r.qids, r.qvecs, r.dim)
                rot = rotation(r.dim, seed)
                own = np.where(np.frombuffer(r.qblock, np.int32) == r.block, np.frombuffer(r.qpos, np.int32), -1)
                bits = np.frombuffer(r.bits, np.uint64).reshape(r.n, -1)
                norm, a = np.frombuffer(r.norms), np.frombuffer(r.fixes)
                parts = list(zip(*best_of_block(q, own, m, ids, rot, bits, norm, a, k, eps)))
                if parts:
                    qr, c, s = map(np.concatenate, parts)
                    yield pd.DataFrame({"query_id": qids[qr], "qb": r.qb, "qrow": qr.astype(np.int32), "vec_id": ids[c], "score": s})

    found = grid(index, queries, nb, nq).mapInPandas(search, "query_id long, qb int, qrow int, vec_id long, score double")
    return ranked(found, k, "double")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: rows with vec_id divisible by 20 against all rows, twenty nearest."""
    return coded_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, every=20)
