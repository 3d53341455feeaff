"""Exact nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks, and each pair of blocks is one tile. A tile's product is taken over int8
vectors; the quantisation error of each vector bounds how far an inner product can be off, so a tile keeps the pairs
whose upper bound reaches the k-th best lower bound. Those are computed again in double precision on the original
vectors and kept in a heap of k a query; the heaps of a query's tiles are merged.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 512  # rows of a tile
CANDIDATE_BLOCK = 4096  # columns of a tile


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, the scale of each, and the length of what is left of each row after quantisation."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127.0
    q = np.rint(x / np.where(scale > 0, scale, 1)).astype(np.int8)  # numbers too small for a scale are all error
    return q, scale[:, 0], np.linalg.norm(x - q * scale, axis=1)


def inner_products(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner product of each row with x, component after component, so that the last bit is that of a plain loop."""
    total = np.zeros(len(rows))
    for j in range(len(x)):
        total += rows[:, j] * x[j]
    return total


def nearest_of(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[float, int]]:
    """(-score, id) of the k largest scores, ties to the smaller id; sums that overflowed both ways (NaN) come last."""
    return [(s, i) for _, s, i in heapq.nsmallest(k, zip(np.where(np.isnan(scores), np.inf, -scores).tolist(), (-scores).tolist(), ids.tolist(), strict=True), key=lambda x: (x[0], x[2]))]


def tile_top(queries: np.ndarray, query_ids: np.ndarray, cands: np.ndarray, cand_ids: np.ndarray, copies: np.ndarray, k: int) -> list[tuple]:
    """(query row, score, vec_id) of each query's k nearest in this tile, candidates as often as ``copies`` says, the query's own id left out."""
    qi, qs, qe = quantise(queries)
    ci, cs, ce = quantise(cands)
    kind = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products are exact in it
    near = (qi.astype(kind) @ ci.T.astype(kind)).astype(np.float64) * qs[:, None] * cs[None, :]
    # |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|, and a little for rounding in the bound itself
    qn, cn = np.linalg.norm(queries, axis=1), np.linalg.norm(cands, axis=1)
    err = (qe[:, None] * cn[None, :] + (qn + qe)[:, None] * ce[None, :]) * (1 + 1e-9) + 1e-12 * qn[:, None] * cn[None, :]
    own = query_ids[:, None] == cand_ids[None, :]
    low, high = np.where(own, -np.inf, near - err), np.where(own, -np.inf, near + err)
    kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
    found = []
    for i in range(len(queries)):
        keep = np.flatnonzero(~(high[i] < kth[i]) & ~own[i])  # a bound that overflowed (NaN) rules nothing out
        score = inner_products(cands[keep], queries[i])
        found += [(i, -s, v) for s, v in nearest_of(np.repeat(score, copies[keep]), np.repeat(cand_ids[keep], copies[keep]), k)]
    return found


def nearest(vectors: DataFrame, is_query, k: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The k rows of ``vectors`` (vec_id, embedding) with the largest inner product with each query row, itself left out.

    Returns query_id, rank from 1, vec_id, score. Ties go to the smaller vec_id. Rows with a null id, and vectors that
    are null, empty, all zero or hold a null or non-finite number, take no part; vectors of another length than the
    query's are no candidates of it. With fewer than k candidates all are returned. Rows that repeat an id are
    candidates of their own; a repeated query id is searched once, with the vector that sorts first. Every pair of
    blocks is compared, so recall is 1. Rows equal in id and vector are put together with their number, so blocks are
    of different rows, of ``query_block`` and ``candidate_block`` of them on average. Inner products that overflow are
    infinite; those that are not a number come last.
    """
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & good)
    valid = valid.withColumn("dim", F.size("embedding"))
    queries = valid.where(is_query)
    valid = valid.groupBy("vec_id", "embedding", "dim").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    n_all, n_queries = valid.count(), queries.count()
    n_cb, n_qb = max(1, -(-n_all // candidate_block)), max(1, -(-n_queries // query_block))
    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "embedding"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    left = left.withColumn("qb", block(n_qb, 1)).withColumn("cb", every(n_cb)).withColumn("side", F.lit(0))
    right = valid.withColumn("cb", block(n_cb, 2)).withColumn("qb", every(n_qb)).withColumn("side", F.lit(1))
    keys = ["dim", "qb", "cb"]
    out = "query_id long, score double, vec_id long"

    def tile(table: pa.Table) -> pa.Table:
        side, ids = table["side"].to_numpy(), table["vec_id"].to_numpy()
        flat = table["embedding"].combine_chunks().flatten().to_numpy()
        x = flat.reshape(len(side), -1)
        rows = tile_top(x[side == 0], ids[side == 0], x[side == 1], ids[side == 1], table["copies"].to_numpy()[side == 1], k) if 0 < side.sum() < len(side) else []
        q = ids[side == 0]
        return pa.table({"query_id": pa.array([q[r[0]] for r in rows], pa.int64()), "score": pa.array([r[1] for r in rows], pa.float64()),
                         "vec_id": pa.array([r[2] for r in rows], pa.int64())})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        best = nearest_of(table["score"].to_numpy(), table["vec_id"].to_numpy(), k)
        return pa.table({"query_id": pa.array([key[0].as_py()] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()),
                         "vec_id": pa.array([v for _, v in best], pa.int64()), "score": pa.array([-s for s, _ in best], pa.float64())})

    shown = [*keys, "side", "copies", "vec_id", "embedding"]
    both = left.withColumn("copies", F.lit(1)).select(shown).unionByName(right.select(shown))
    tiles = both.repartition(max(1, n_qb * n_cb), *keys).groupBy(*keys).applyInArrow(tile, out)
    return tiles.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
