"""Nearest neighbours by largest inner product: a block matrix join over int8 tiles.

Queries and candidates are dealt into blocks; each tile of a query block and a candidate block is one
task's matrix product of int8 codes. The codes' errors bound every inner product from both sides; pairs whose
upper bound reaches the k-th best lower bound, over distinct ids, of their query are computed again in double precision from
the original vectors. Tiles give each query's k best, and heaps merge them.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do
null ids; a query meets only vectors of its own length; rows with the query's own id are no candidates; of
a repeated candidate id the best score counts, of a repeated query id the smallest vector asks; ties go to
the smaller id; an empty table gives no row.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

K = 20
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
ROWS_AT_ONCE = 256

TOPS = "query_id long, vec_ids array<long>, scores array<double>"


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _codes(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """int8 codes, their scales, norms of the decoded vectors, of the errors and of the vectors, and the power of two that all of these leave out."""
    power = np.frexp(np.abs(x).max(axis=1))[1]
    power[np.abs(power) < 256] = 0  # squares of others leave the range of doubles, or come near its end
    x = np.ldexp(x, -power[:, None])
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(decoded, axis=1), np.linalg.norm(x - decoded, axis=1), np.linalg.norm(x, axis=1), power


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, summed in order, so equal pairs have equal scores."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d].astype(np.float64) * y[:, d]
    return total


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's k best of a block of candidates: id, their ids, their scores, best first."""
    by_id = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[by_id], c[by_id]
    own = np.flatnonzero(np.concatenate([[True], c_ids[1:] != c_ids[:-1]]))  # where the rows of each id begin
    n = min(k, len(own))
    qd, cd = q.astype(np.float64), c.astype(np.float64)
    qc, qs, _, qe, q_norm, q_power = _codes(qd)
    cc, cs, cn, ce, c_norm, c_power = _codes(cd)
    rounding = (q.shape[1] + 8) * 2.0**-52  # of sums of products, as a share of the norms
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # in which integer products are exact
    right = cc.astype(exact).T
    for at in range(0, len(q), ROWS_AT_ONCE):
        part = slice(at, at + ROWS_AT_ONCE)
        near = (qc[part].astype(exact) @ right).astype(np.float64) * (qs[part, None] * cs)
        bound = (q_norm[part, None] * ce + qe[part, None] * cn) * (1 + 1e-9) + rounding * q_norm[part, None] * c_norm
        low, high = near - bound, near + bound
        if q_power[part].any() or c_power.any():
            power = q_power[part, None] + c_power
            low, high = np.ldexp(low, power) - q.shape[1] * 5e-324, np.ldexp(high, power) + q.shape[1] * 5e-324
        own_row = q_ids[part, None] == c_ids
        low[own_row] = -np.inf
        if len(own) < len(c):  # the floor is over ids, of repeated ones the best row
            low = np.maximum.reduceat(low, own, axis=1)
        floor = np.partition(low, len(own) - n, axis=1)[:, len(own) - n]
        i, j = np.nonzero((high >= floor[:, None]) & ~own_row)
        score = inner(q[part][i], c[j])
        order = np.lexsort((c_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, np.arange(len(q[part]) + 1))
        for row in range(len(q[part])):
            found = slice(first[row], first[row + 1])
            ids, best = np.unique(c_ids[j[found]], return_index=True)
            best = np.sort(best)[:k]
            yield int(q_ids[at + row]), c_ids[j[found]][best], score[found][best]


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors (vec_id, embedding) for each of queries (vec_id, embedding)."""
    vectors = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    queries = queries.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n_q, n_c = (max(1, math.ceil(df.count() / size)) for df, size in ((queries, QUERY_BLOCK), (vectors, CANDIDATE_BLOCK)))
    dealt = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("dim", F.size("embedding")).withColumn("qb", dealt("q", n_q)).withColumn("cb", every(n_c))
    c = vectors.withColumn("dim", F.size("embedding")).withColumn("cb", dealt("c", n_c)).withColumn("qb", every(n_q))
    key = ["dim", "qb", "cb"]

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found, scores = [], [], []
        if left.num_rows and right.num_rows:
            for query, near, score in tile(left["vec_id"].to_numpy(), matrix(left["embedding"]), right["vec_id"].to_numpy(), matrix(right["embedding"]), k):
                ids.append(query)
                found.append(near)
                scores.append(score)
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_ids": pa.array(found, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64()))})

    tops = q.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(product, TOPS)
    return merged(tops, k)


def merged(tops: DataFrame, k: int) -> DataFrame:
    """The k best of each query's sorted lists, by a heap over the lists."""

    def rows(query: int, lists: list) -> Iterator[tuple]:
        seen: set = set()
        for loss, vec_id in heapq.merge(*([(-s, v) for v, s in zip(ids, scores)] for ids, scores in lists)):
            if vec_id not in seen:
                seen.add(vec_id)
                yield query, len(seen), vec_id, -loss
                if len(seen) == k:
                    return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, lists = None, []

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            out: list[tuple] = []
            for q, ids, scores in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if q != query and lists:
                    out += rows(query, lists)
                    lists = []
                query = q
                lists.append((ids, scores))
                if len(lists) >= 1024:  # many tiles of one query: keep what can still be among the best
                    best = list(rows(query, lists))
                    lists = [([r[2] for r in best], [r[3] for r in best])]
            if out:
                yield batch_of(out)
        if lists and (last := list(rows(query, lists))):
            yield batch_of(last)

    return tops.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
