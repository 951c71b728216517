"""Operator 7: exact top-k by inner product with Fagin's threshold algorithm.

Candidates are dealt into blocks by a hash of their id. In a block every dimension has its list of
candidates sorted by value. A query reads each list from the end that its sign favours, the deeper the
larger its component is; at those depths no unread candidate can score more than the sum of the query's
components times the lists' values there. Candidates that were read are scored in full; a query stops
where that bound cannot beat the kth score it has.

The kth score comes first: every query is scored against one block of candidates, and the kth score
there, which the final one cannot be below, goes with the query to all other blocks. So the depth at which it
must stop is known from the lists alone (found by halving), and what lies above it is read in one
stretch. A query whose lists would give a block's every candidate is scored against the block as it is. Each block
gives at most k candidates per query, none below the first kth score; they are merged per query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

K = 20
#: Rows of a block: bounds what a task holds.
CANDIDATES, QUERIES = 16_384, 8_192
#: Scores held at a time.
SCORES = 1 << 22
LONG = 1 << 63


def usable(vector):
    """A vector as doubles; null unless it has components and all are finite."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(vector.isNotNull() & (F.size(x) > 0) & fine, x)


def whole(v: np.ndarray, scale: int = 64) -> np.ndarray:
    """floor(scale * x) of each component; as whole doubles if they stay below 2**52, else as Python integers."""
    if np.abs(v).max(initial=0) * scale < 2**52:
        return np.floor(v * scale)
    one = lambda x: math.floor(x * scale) if abs(x) < 2**60 else int(x) * scale  # noqa: E731  beyond 2**53 doubles are whole
    return np.array([[one(x) for x in row] for row in v.tolist()], object).reshape(v.shape)


class Lists:
    """A block's candidates (ascending ids) with a sorted list per dimension."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.order = np.argsort(x.astype(np.float64), axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.order, axis=0)

    def depths(self, q: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """How deep each query (row) reads each list: up to ``reach``, less where its component is smaller, not at all where it is 0."""
        size = np.abs(q).astype(np.float64)
        share = size / np.maximum(size.max(axis=1, keepdims=True), 1e-300)
        return np.minimum(len(self.x), np.ceil(share * reach[:, None])).astype(np.int64)

    def bounds(self, q: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The most that a candidate unread at ``depth`` can score; the value at a list's depth is that of its first unread candidate."""
        n = len(self.x)
        at = np.minimum(depth, n - 1)
        column = np.arange(q.shape[1])[None, :]
        return (q * np.where(q > 0, self.values[n - 1 - at, column], self.values[at, column])).sum(axis=1)

    def stops(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """The least reach at which each query's bound is below its kth score; the block's size where none before is."""
        n = len(self.x)
        low, high = np.zeros(len(q), np.int64), np.full(len(q), n)
        while (low < high).any():
            middle = (low + high) // 2
            below = (self.bounds(q, self.depths(q, middle)) < kth) & (low < high)
            high = np.where(below, middle, high)
            low = np.where(below | (low >= high), low, middle + 1)
        return high

    def read(self, q: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The candidates that one query reads, ascending."""
        n, seen = len(self.x), np.zeros(len(self.x), bool)
        for d in np.flatnonzero(depth):
            seen[self.order[n - depth[d] :, d] if q[d] > 0 else self.order[: depth[d], d]] = True
        return np.flatnonzero(seen)


def _best(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller ``at``; both ascend by position."""
    if len(score) > 4 * k and score.dtype != object:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= edge)
        return near[np.lexsort((at[near], -score[near]))[:k]]
    return np.array(sorted(range(len(score)), key=lambda c: (-score[c], at[c]))[:k], np.int64)


def threshold_top_k(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int = K, kth: list | None = None) -> tuple[list, int]:
    """([(query row, id, score), ...], candidates read) of each query's k best of the block, ties to the smaller id, rows of its own id left out.

    ``x`` and ``q`` are whole numbers, ``x`` by ascending id. ``kth``: scores (None for none) that a query's best must reach.
    """
    n, out, reads = len(x), [], 0
    if x.dtype == object or q.dtype == object or float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] >= 2**53:
        to_int = np.frompyfunc(int, 1, 1)
        x, q = to_int(x), to_int(q)
    floor = [None] * len(q) if kth is None else kth
    lists, asked = Lists(x, ids), np.array([f is not None for f in floor], bool)
    reach = np.full(len(q), n)
    if asked.any():
        some = np.flatnonzero(asked)
        reach[some] = lists.stops(q[some], np.array([floor[i] for i in some], x.dtype))
    depth = lists.depths(q, reach)
    few = np.flatnonzero(asked & (reach < n) & (depth.sum(axis=1) < n // 2))

    def give(i: int, at: np.ndarray, score: np.ndarray) -> None:
        fine = ids[at] != q_ids[i]
        if floor[i] is not None:
            fine &= score >= floor[i]
        at, score = at[fine], score[fine]
        out.extend((i, int(ids[at[c]]), int(score[c])) for c in _best(score, at, k))

    for i in few:
        at = lists.read(q[i], depth[i])
        reads += len(at)
        give(i, at, x[at] @ q[i])
    rest, every = np.setdiff1d(np.arange(len(q)), few), np.arange(n)
    step = max(1, SCORES // max(1, n))
    for j in range(0, len(rest), step):
        own = rest[j : j + step]
        reads += n * len(own)
        for i, score in zip(own, q[own] @ x.T, strict=True):
            give(i, every, score)
    return out, reads


def order_key(score: int) -> bytes:
    """Bytes that compare as whole numbers of any size do."""
    size = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    data = len(size).to_bytes(2, "big") + size
    return b"\x01" + data if score >= 0 else b"\x00" + bytes(255 - b for b in data)


def _rows(f: pd.DataFrame) -> np.ndarray:
    return whole(np.stack(f["v"].to_numpy()))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Per query of ``queries`` its k best of ``vectors`` (both: id long, v array<double>, scored as floor(64 * x)): query_id, rank, vec_id, score.

    Rows with a null id or vector take no part; vectors of another length than the query's are not
    compared; a repeated row is a candidate of its own, a query's own id is none;
    of a repeated query id the least vector asks. Fewer candidates
    than k give them all; empty tables give no rows. Scores are exact whole numbers and ranked as such; one
    that no long can hold is given as null.
    """
    vectors = vectors.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", "v", F.size("v").alias("d"))
    queries = cut(queries.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).groupBy("id").agg(F.min("v").alias("v")).select(F.col("id").alias("id"), "v", F.size("v").alias("d")))
    deal = lambda c, many: F.pmod(F.xxhash64(c), many).cast("int")
    at_least_one = lambda n: F.greatest(F.lit(1), F.ceil(n)).cast("int")
    # one row per length of vectors: how many blocks of candidates and groups of queries there are
    plan = vectors.groupBy("d").agg(at_least_one(F.count(F.lit(1)) / CANDIDATES).alias("blocks")).join(
        queries.groupBy("d").agg(at_least_one(F.count(F.lit(1)) / QUERIES).alias("groups")), "d"
    )
    rows = vectors.join(plan, "d").withColumn("b", deal("id", F.col("blocks")))
    asking = queries.join(plan, "d").withColumn("g", deal("id", F.col("groups")))
    every = lambda first, many: F.explode(F.sequence(F.lit(first), F.col(many) - 1))
    kind = "query_id long, vec_id long, score long, key binary, n_read long"

    def search(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found, reads = [], 0
        if len(x) and len(q):
            x = x.sort_values("id", kind="stable")
            kth = [None if f is None else _from_key(f) for f in q["kth"]] if "kth" in q else None
            found, reads = threshold_top_k(_rows(x), x["id"].to_numpy(), _rows(q), q["id"].to_numpy(), k, kth)
        q_ids = q["id"].to_numpy()
        return pd.DataFrame({
            "query_id": pd.Series([q_ids[i] for i, _, _ in found], dtype="int64"), "vec_id": pd.Series([v for _, v, _ in found], dtype="int64"),
            "score": pd.array([s if -LONG <= s < LONG else None for _, _, s in found], dtype="Int64"), "key": [order_key(s) for _, _, s in found], "n_read": pd.Series([reads] * len(found), dtype="int64"),
        })

    # every query against block 0, which gives its first kth score; then against all others
    head = rows.filter("b = 0").select("id", "v", "d", "b", every(0, "groups").alias("g"))
    first = cut(head.groupBy("d", "g").cogroup(asking.select("id", "v", "d", "g").groupBy("d", "g")).applyInPandas(search, kind))
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("kth")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
    left = rows.filter("blocks > 1 AND b > 0").select("id", "v", "d", "b", every(0, "groups").alias("g"))
    right = asking.filter("blocks > 1").join(kth, "id", "left").select("id", "v", "kth", "d", "g", every(1, "blocks").alias("b"))
    other = left.groupBy("d", "b", "g").cogroup(right.groupBy("d", "b", "g")).applyInPandas(search, kind)
    found = first.unionByName(other)
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _from_key(key: bytes) -> int:
    """The number of an ``order_key``."""
    return int.from_bytes(key[3:], "big") if key[0] else -int.from_bytes(bytes(255 - b for b in key[3:]), "big")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the 20 best of every twentieth vector of ``embeddings``; odd rows as in ``top_k``, other columns take no part."""
    vectors = cut(read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), usable(F.col("embedding")).alias("v")))
    return top_k(vectors, vectors.filter(F.col("id") % 20 == 0))


OP7_SQL = """
WITH w AS (
  SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM w q JOIN w c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
