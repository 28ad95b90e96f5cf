"""Nearest neighbours by inner product: a block matrix join on int8 tiles with error bounds.

Vectors are packed into blocks of about ``BLOCK``. A block keeps each vector's int8 codes and scale
beside the original components. Every block of queries meets every block of candidates
(an equi-join on the candidate block's number, to which a block of queries is sent once); the
product of their codes is exact in integers, and

    |x.y - s t (q.r)|  <=  s/2 * |y|_1  +  t/2 * s |q|_1

bounds what rounding to codes q, r with scales s, t can change. Candidates whose upper bound
lies below the k-th best lower bound of the tile can't be among the k nearest; all others
("survivors") are recomputed from the original components in double precision. Each
tile gives at most k rows for a query; they are merged by bounded heaps that keep the k best.

Of equal vectors in a block only the first k + 1 by id are candidates: ties go to the smaller
id, so the others can't be in any result (the query itself may be one of them). A result
with a third of all rows alike thus needs no more work than any other.

Rows: vectors that are null, zero, or hold a null or non-finite component take no part, nor do
rows without id. Vectors only meet those with as many components. Rows that repeat an id are
candidates each, but never for their own id; as a query an id has the least of its vectors. With fewer candidates than k all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small

#: Vectors in a block of candidates, and of queries.
BLOCK = 4096
QUERIES = 1024


def usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes and scales of rows; x is about scale * code, to half a scale."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale = np.where(scale > 0, scale, 1.0)
    return np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8), scale


def first_of_equal(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows enough for every query: of those with the same components up to k of an id and 2 k in all, by id; less those of any one id k are left."""
    key = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, group = np.unique(key, return_inverse=True)

    def rank(*keys: np.ndarray) -> np.ndarray:
        new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
        start = np.flatnonzero(new)
        return np.arange(len(new)) - np.repeat(start, np.diff(np.r_[start, len(new)]))

    order = np.lexsort((ids, group))
    order = order[rank(group[order], ids[order]) < k]
    return np.sort(order[rank(group[order]) < 2 * k])


def tile(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, point_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's number, ids, scores) of the k nearest points of each query, its own id excluded."""
    qc, qs = quantised(queries)
    pc, ps = quantised(points)
    p_norm = np.abs(points).sum(axis=1)
    p32 = pc.T.astype(np.float32)
    for a in range(0, len(queries), 256):
        b = min(a + 256, len(queries))
        # products of codes are integers below 2^24 a thousand components long: exact in single precision
        exact = np.float32 if queries.shape[1] <= 1000 else np.float64
        product = (qc[a:b].astype(exact) @ p32.astype(exact, copy=False)).astype(np.float64)
        middle = product * qs[a:b, None] * ps[None, :]
        q_code = np.abs(qc[a:b].astype(np.int64)).sum(axis=1) * qs[a:b]
        slack = (0.5 * qs[a:b, None] * p_norm[None, :] + 0.5 * q_code[:, None] * ps[None, :]) * (1 + 1e-9) + 1e-12
        lower, upper = middle - slack, middle + slack
        own = query_ids[a:b, None] == point_ids[None, :]
        lower[own] = upper[own] = -np.inf
        n = min(k, len(points))
        least = -np.partition(-lower, n - 1, axis=1)[:, n - 1] if len(points) > n else np.full(b - a, -np.inf)
        for i in range(b - a):
            at = np.flatnonzero((upper[i] >= least[i]) & ~own[i])
            score = np.add.accumulate(queries[a + i] * points[at], axis=1)[:, -1]  # from the first component to the last
            o = np.lexsort((point_ids[at], -score))[:k]
            yield a + i, point_ids[at][o], score[o]


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(dim, block, ids, data) with the rows packed; as many blocks as the row count asks for."""
    n = max(1, -(-rows.count() // size))

    def pack(key, table):
        t = table.sort_by("id")
        flat = np.array(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64)
        ids = t.column("id").to_numpy().astype(np.int64)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([flat.tobytes()], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")).withColumn("dim", F.size("v"))
    return dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids binary, data binary")


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k rows of the largest inner product with each query row."""
    rows = table.filter(F.col(id_col).isNotNull() & usable(vector)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    points = _blocks(rows.select("id", "v"), block, "points")
    queries = _blocks(rows.filter("q").groupBy("id").agg(F.min("v").alias("v")), QUERIES, "queries")
    # the blocks' numbers, not their data
    places = points.select(F.col("dim").alias("d"), F.col("block").alias("to"))
    sent = queries.join(F.broadcast(places) if small(places, 16) else places, F.col("dim") == F.col("d")).select("dim", "to", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    met = points.join(sent.withColumnRenamed("dim", "d"), (F.col("dim") == F.col("d")) & (F.col("block") == F.col("to"))).select("dim", "ids", "data", "q_ids", "q_data")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, data, q_ids, q_data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p_ids, x = np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, dim)
                keep = first_of_equal(x, p_ids, k)
                n_ids, y = np.frombuffer(q_ids, np.int64), np.frombuffer(q_data, np.float64).reshape(-1, dim)
                got = list(tile(y, n_ids, x[keep], p_ids[keep], k))
                yield pa.RecordBatch.from_arrays([pa.array([int(n_ids[i]) for i, _, _ in got], pa.int64()), pa.array([p.tolist() for _, p, _ in got], pa.list_(pa.int64())), pa.array([s.tolist() for _, _, s in got], pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])

    def merge(key, table):
        heap: list[tuple[float, int]] = []  # the worst of the k best on top
        for ids, scores in zip(table.column("ids").to_pylist(), table.column("scores").to_pylist(), strict=True):
            for i, s in zip(ids, scores, strict=True):
                if len(heap) < k:
                    heapq.heappush(heap, (s, -i))
                elif (s, -i) > heap[0]:
                    heapq.heapreplace(heap, (s, -i))
        best = sorted(heap, key=lambda x: (-x[0], -x[1]))
        return pa.table({"query_id": pa.array([key[0].as_py()] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()), id_col: pa.array([-i for _, i in best], pa.int64()), "score": pa.array([s for s, _ in best], pa.float64())})

    tiles = met.mapInArrow(multiply, "query_id long, ids array<long>, scores array<double>")
    return tiles.groupBy("query_id").applyInArrow(merge, f"query_id long, rank int, {id_col} long, score double")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the 20 nearest of every twentieth vector."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS score
  FROM (SELECT vec_id, min(v) AS v FROM e WHERE vec_id % 20 = 0 GROUP BY vec_id) q JOIN e c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
