"""Nearest neighbours by collision counting over single projections, with virtual rehashing.

Unit vectors are projected on `lines` random directions; each projection is one sorted array. A query's window on an array is centred
on its own projection and holds the rows within half a bucket width. A row that lies in the windows of at least `needed` arrays
is verified with the exact cosine. Virtual rehashing widens all windows by `ratio` until a query has verified enough rows
and its k-th distance is within the radius that the present width stands for, or its windows hold every row.

For unit vectors d^2 = 2 - 2 cos, and the projection of a difference of length d on a Gaussian direction is normal with
deviation d. A row within distance r falls in a window of half width w r / 2 with probability p1 = 2 Phi(w / 2) - 1; `needed` is
p1 * lines less a margin, so rows within r are missed with the small probability that `Collide` documents.

Plan: the vectors are dealt into blocks of rows; each block holds its own sorted arrays and answers all queries, which travel as
one packed block for each `QUERY_BLOCK` queries (a stated query set against all rows, in blocks). A block keeps its k best
of each query; the final k are the best of those by one aggregation on the query. Each query's expansion in a block stops by the
radius rule against its best k so far in that block, so a result never depends on how rows are dealt beyond missed rows.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; a query's candidates are
the vectors of its own dimension, as cosines of others don't exist; fewer than k candidates give all of them; a null vec_id takes no part; rows of equal vec_id are candidates
one by one but never of a query of that id; an empty table gives an empty result; other columns don't take part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fernquery.llm.common import table

QUERY_BLOCK = 16_384


@dataclass(frozen=True)
class Collide:
    """A row at the radius collides on 68 % of the arrays in the mean (width 2); with a margin of two deviations about one in forty
    such rows is missed, and fewer of those that are nearer."""

    lines: int = 128
    width: float = 2.0
    ratio: float = 1.4
    start: float = 0.35
    margin: float = 2.0
    block: int = 8_192  # rows of a block
    seed: int = 20240607

    @property
    def needed(self) -> int:
        p = math.erf(self.width / 2 / math.sqrt(2))
        return max(1, math.floor(p * self.lines - self.margin * math.sqrt(self.lines * p * (1 - p))))


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as array<double>, of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def window(arrays: np.ndarray, at: np.ndarray, side: str) -> np.ndarray:
    """The place of one value on each sorted array, by bisection of all arrays together."""
    m, n = arrays.shape
    lo, hi, every = np.zeros(m, np.int64), np.full(m, n), np.arange(m)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        held = arrays[every, np.minimum(mid, n - 1)]
        right = open_ & ((held < at) if side == "left" else (held <= at))
        lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
    return lo


def search_block(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, rule: Collide) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the query, vec_id, cosine) of the k nearest found in one block of rows."""
    n, d = x.shape
    lines = np.random.default_rng(rule.seed).normal(size=(d, rule.lines))
    xu, qu = _unit(x), _unit(q)
    _, first_copy, copy_of = np.unique(x, axis=0, return_index=True, return_inverse=True)  # equal vectors share projections and cosines
    copy_of = copy_of.reshape(-1)
    px, pq = (xu[first_copy] @ lines)[copy_of].T, (qu @ lines).T
    order = np.argsort(px, axis=1, kind="stable")
    arrays = np.take_along_axis(px, order, axis=1)
    places = np.stack([np.searchsorted(arrays[m], pq[m]) for m in range(rule.lines)]) if len(q) else np.zeros((rule.lines, 0), np.int64)
    best_i, best_s = [], []
    for j in range(len(q)):
        keep_i, keep_s = np.zeros(0, np.int64), np.zeros(0)
        hits, taken = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        lo = hi = places[:, j]  # a window on each sorted array, empty at first
        radius = rule.start
        while True:
            half = rule.width * radius / 2
            new_lo, new_hi = window(arrays, pq[:, j] - half, "left"), window(arrays, pq[:, j] + half, "right")
            # only what the windows have come to cover is counted
            fresh = [order[m, a:b] for m in range(rule.lines) for a, b in ((new_lo[m], lo[m]), (hi[m], new_hi[m])) if a < b]
            lo, hi = np.minimum(lo, new_lo), np.maximum(hi, new_hi)
            if fresh:
                hits += np.bincount(np.concatenate(fresh), minlength=n)
            found = (hits >= rule.needed) & ~taken
            taken |= found
            found = np.flatnonzero(found)
            found = found[ids[found] != q_ids[j]]
            if len(found) > k:  # only those near the k-th best can count; sums differ by their place in the product, so exact cosines decide
                near = xu[found] @ qu[j]
                found = found[near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9]
            different, which = np.unique(copy_of[found], return_inverse=True)
            exact = np.array([cosine(x[i], q[j]) for i in first_copy[different]])
            keep_i, keep_s = np.concatenate([keep_i, found]), np.concatenate([keep_s, exact[which]])
            top = np.lexsort((ids[keep_i], -keep_s))[:k]
            keep_i, keep_s = keep_i[top], keep_s[top]
            far = math.sqrt(max(0.0, 2 - 2 * keep_s.min())) if len(keep_s) >= k else math.inf
            if far <= radius or (hi - lo == n).all():
                break
            radius = min(radius * rule.ratio, far)
        best_i.append(keep_i)
        best_s.append(keep_s)
    index = np.repeat(np.arange(len(q)), [len(b) for b in best_i])
    rows = np.concatenate(best_i) if len(q) else np.zeros(0, np.int64)
    return index, ids[rows], np.concatenate(best_s) if len(q) else np.zeros(0)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """In double precision on the vectors as given; scaled first only where squares would leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        low = math.sqrt(a @ a) * math.sqrt(b @ b)
        if 1e-290 < low < 1e290 and a @ a > 1e-290 and b @ b > 1e-290:
            return float((a @ b) / low)
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float((a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)))


def search(vectors: DataFrame, queries: DataFrame, k: int, rule: Collide = Collide()) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every row of queries (vec_id, embedding) among vectors."""
    rows, asked = clean(vectors), clean(queries)
    total, n_queries = rows.count(), asked.count()
    blocks = max(1, -(-total // rule.block))
    # every block meets every query block: the pairs are (rows' block) x (queries' block), never single rows
    q_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    row_key = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")  # repeated rows are spread too
    keyed = rows.select("vec_id", "v", row_key.alias("block"))
    left = keyed.select("vec_id", "v", F.size("v").alias("d"), "block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"), F.lit(False).alias("asks"))
    right = asked.select("vec_id", "v", F.size("v").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(q_blocks)).cast("int").alias("q_block"), F.lit(True).alias("asks"))

    def run(table_: pa.Table) -> pa.Table:
        asks = table_.column("asks").to_numpy().astype(bool)
        ids, x = table_.column("vec_id").to_numpy(), _matrix(table_.column("v").combine_chunks())
        order = np.argsort(ids, kind="stable")
        ids, x, asks = ids[order], x[order], asks[order]
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if asks.all() or not asks.any():
            return schema.empty_table()
        j, i, s = search_block(ids[~asks], x[~asks], ids[asks], x[asks], k, rule)
        return pa.table([pa.array(ids[asks][j]), pa.array(i), pa.array(s)], schema=schema)

    found = left.unionByName(right).groupBy("d", "block", "q_block").applyInArrow(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 50 = 0"), 5)
