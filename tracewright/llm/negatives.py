"""Hard negatives by exact integer products, several candidates a multiplication (Kronecker packing).

Components become integers, floor(256 x). A candidate's component is biased to be non-negative and put into its own
field of a wide integer beside those of other candidates; an anchor's component times that integer is all their products at once,
as fields are wide enough for the whole sum, which is unpacked exactly. Where fields and words allow it the wide
integers are 53 bits of a double, whose matrix product is then exact; components too large for that are packed into Python's unbounded integers.

Two passes over tiles of anchors and candidates: positives, within a label; then, with each positive's window of
scores, negatives. A tile sorts each anchor's scores once and takes what stands under each window's top.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component take no part; an
empty vector's scores are 0; vectors meet only those of their own length; of rows with one vec_id the one with the smallest label and
vector stands for all; a score that a long can't hold is null, although ranks follow it; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, staged, within

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least LOW and at most HIGH hundredths of its positive's.
LOW, HIGH = 50, 95
ANCHOR_BLOCK, CANDIDATE_BLOCK = 16384, 16384
#: Scores that a tile holds at once.
SCORES_AT_ONCE = 1 << 21
#: Candidates a wide integer where integers are unbounded.
FIELDS = 256
DOUBLE_BITS = 53

FOUND = "anchor_id long, positive_id long, vec_id long, score long, place binary"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole(vector: Column) -> Column:
    """No component is null or not finite."""
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))


def rows_of(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, label, and the components as shorts (codes), or where these are too short the vector itself (wide)."""
    x = F.col("embedding").cast("array<double>")
    narrow = F.forall(x, lambda v: F.abs(v) < 127.0)
    codes = F.when(narrow, F.transform(x, lambda v: F.floor(v * 256).cast("short")))
    usable = vectors.select("vec_id", "label", "embedding").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole(F.col("embedding")))
    one = usable.select("vec_id", F.struct("label", codes.alias("codes"), F.when(~narrow, x).alias("wide")).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    return one.select("vec_id", F.size(F.coalesce("v.codes", "v.wide")).alias("dim"), "v.label", "v.codes", "v.wide")


def components(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of finite doubles, exactly: as longs, or as Python integers where longs are too short."""
    if np.abs(vectors).max(initial=0) < 2.0**53:
        return np.floor(vectors * 256.0).astype(np.int64)
    return np.array([[int(x) * 256 if abs(x) >= 2.0**53 else int(np.floor(x * 256.0)) for x in row] for row in vectors.tolist()], dtype=object)


def place_of(score: int) -> bytes:
    """Bytes that stand in the order of the integers, of any size."""
    n = (abs(score).bit_length() + 7) // 8
    return (32768 + n).to_bytes(2) + score.to_bytes(n) if score >= 0 else (32768 - n).to_bytes(2) + ((1 << 8 * n) - 1 + score).to_bytes(n)


def score_of(place: bytes) -> int:
    n = int.from_bytes(place[:2]) - 32768
    return int.from_bytes(place[2:]) if n >= 0 else int.from_bytes(place[2:]) + 1 - (1 << -8 * n)


class Packed:
    """Candidates' integer components (a row each), packed for products with anchors whose components are at most `largest` in size."""

    def __init__(self, candidates: np.ndarray, largest: int):
        self.n, self.dim = candidates.shape
        self.bias = int(max(0, -candidates.min())) if candidates.size else 0
        top = (int(candidates.max()) if candidates.size else 0) + self.bias
        self.offset = self.dim * max(largest, 1) * max(top, 1)  # keeps every field's sum from falling below zero
        self.width = max(1, (2 * self.offset).bit_length())
        self.fields = DOUBLE_BITS // self.width
        self.type = np.float64 if self.fields and candidates.dtype != object else object
        if self.type is object:
            self.fields = FIELDS
        columns = -(-self.n // self.fields) if self.n else 0
        exact = np.int64 if self.type is np.float64 else object
        biased = np.zeros((columns * self.fields, self.dim), exact)
        biased[: self.n] = candidates.astype(exact) + self.bias
        self.words = np.zeros((self.dim, columns), exact)
        self.start = 0  # the offset in each field
        for field in range(self.fields):
            shift = field * self.width
            self.words += biased[field * columns : (field + 1) * columns].T * exact(1 << shift) if exact is np.int64 else biased[field * columns : (field + 1) * columns].T * (1 << shift)
            self.start += self.offset << shift
        self.words = self.words.astype(self.type)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of anchors and candidates, as longs, or as Python integers where those were packed."""
        if not self.dim:
            return np.zeros((len(anchors), self.n), np.int64)
        if self.type is object:
            anchors = anchors.astype(object)
        product = anchors.astype(self.type) @ self.words + self.start
        if self.type is np.float64:
            product = product.astype(np.int64)
        mask = (1 << self.width) - 1
        out = np.concatenate([(product >> (field * self.width)) & mask for field in range(self.fields)], axis=1)[:, : self.n]
        return out - self.offset - self.bias * anchors.sum(axis=1)[:, None]


def kinds(table: pa.Table, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their components; rows with large ones apart, as they need wider fields."""
    for name, kind in (("codes", np.int64), ("wide", np.float64)):
        column = table[name].combine_chunks()
        rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        if len(rows):
            values = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(rows), dim)
            yield rows, values if kind is np.int64 else components(values)


def products(anchors: pa.Table, candidates: pa.Table, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors' rows, candidates' rows and their scores, in pieces of about SCORES_AT_ONCE scores."""
    lines = list(kinds(anchors, dim))
    for columns, right in kinds(candidates, dim):
        for rows, left in lines:
            packed = Packed(right, int(np.abs(left).max(initial=0)))
            step = max(1, SCORES_AT_ONCE // len(columns))
            for at in range(0, len(rows), step):
                yield rows[at : at + step], columns, packed.scores(left[at : at + step])


def ordered(scores: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores joined with their columns (earlier ones larger) and sorted, so later ones come first in rank; how many of each row aren't allowed, which stand in front; the bits of the column."""
    n = scores.shape[1]
    bits = max(1, (n - 1).bit_length())
    if scores.dtype != object and max(int(scores.max()), -int(scores.min())) >= 1 << (61 - bits):
        scores = scores.astype(object)
    keys = scores * (1 << bits) + (n - 1 - np.arange(n))
    return np.sort(np.where(allowed, keys, keys.min() - 1), axis=1), n - allowed.sum(axis=1), bits


class Rows:
    """Rows of FOUND."""

    def __init__(self):
        self.columns = [[], [], [], [], []]

    def add(self, anchor: int, positive: int | None, vec: int, score: int) -> None:
        for column, value in zip(self.columns, (anchor, positive, vec, score if -(1 << 63) <= score < 1 << 63 else None, place_of(score))):
            column.append(value)

    def table(self) -> pa.Table:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(self.columns, types)], names=["anchor_id", "positive_id", "vec_id", "score", "place"])


def nearest(key: tuple, anchors: pa.Table, candidates: pa.Table, most: int) -> pa.Table:
    """Each anchor's first `most` of a block of candidates of its label."""
    out = Rows()
    if anchors.num_rows and candidates.num_rows:
        candidates = candidates.sort_by("vec_id")
        own, ids = anchors["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
        for rows, columns, scores in products(anchors, candidates, key[0].as_py()):
            keys, low, bits = ordered(scores, own[rows, None] != ids[columns])
            for i, row in enumerate(rows):
                for k in keys[i, max(low[i], len(columns) - most) :][::-1].tolist():
                    out.add(int(own[row]), None, int(ids[columns[len(columns) - 1 - (k & ((1 << bits) - 1))]]), k >> bits)
    return out.table()


def under_positives(key: tuple, anchors: pa.Table, candidates: pa.Table, most: int) -> pa.Table:
    """For each anchor and positive, the first `most` of a block of candidates with another label and a score within the positive's window."""
    out = Rows()
    if anchors.num_rows and candidates.num_rows:
        candidates = candidates.sort_by("vec_id")
        own, ids = anchors["vec_id"].to_pylist(), candidates["vec_id"].to_numpy()
        own_label, label = anchors["label"].to_numpy(), candidates["label"].to_numpy()
        positives = anchors["positives"].to_pylist()
        for rows, columns, scores in products(anchors, candidates, key[0].as_py()):
            keys, low, bits = ordered(scores, own_label[rows, None] != label[columns])
            for i, row in enumerate(rows):
                line, first = keys[i], int(low[i])
                if first == len(columns):
                    continue
                for p in positives[row]:
                    score = score_of(p["place"])
                    top, least = HIGH * score // 100, -(-LOW * score // 100)
                    end = _count_below(line, (top + 1) << bits)
                    for k in line[max(first, end - most) : end][::-1].tolist():
                        if k >> bits < least:
                            break
                        out.add(own[row], p["positive_id"], int(ids[columns[len(columns) - 1 - (k & ((1 << bits) - 1))]]), k >> bits)
    return out.table()


def _count_below(line: np.ndarray, limit: int) -> int:
    """How many of the sorted line are below limit, whatever its size."""
    if line.dtype != object and not -(1 << 63) <= limit < 1 << 63:
        return len(line) if limit > 0 else 0
    return int(np.searchsorted(line, limit))


def tiles(anchors: DataFrame, rows: DataFrame, keys: list[str], of_anchors: list[str], of_rows: list[str], found) -> DataFrame:
    """found(key, anchors, candidates) for each block of anchors with each block of candidates that have equal keys, as FOUND.

    Numbers of blocks follow from counts a key, so a key of any size is dealt into tiles of bounded size.
    """
    numbers = staged(rows.groupBy(*keys).agg(F.count("*").alias("_rows"), F.count(F.when(F.expr(IS_ANCHOR), 1)).alias("_anchors")).filter("_anchors > 0"), "numbers", small=True)
    numbers = numbers.select(*keys, F.ceil(F.col("_anchors") / ANCHOR_BLOCK).alias("_n_a"), F.ceil(F.col("_rows") / CANDIDATE_BLOCK).alias("_n_c"))
    dealt = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.col(n)).alias("_" + salt)
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(name)
    left = within(numbers, anchors, keys, "inner").select(*(F.col(c).alias(c) for c in [*keys, *of_anchors]), dealt("a", "_n_a"), every("_n_c", "_c"))  # new columns, as both sides come from the same rows
    right = within(numbers, rows, keys, "inner").select(*keys, *of_rows, dealt("c", "_n_c"), every("_n_a", "_a"))
    key = [*keys, "_a", "_c"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(found, FOUND)


IS_ANCHOR = "vec_id % 50 = 0"


def mine(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, label, embedding)."""
    rows = staged(rows_of(vectors), "rows")
    anchors = rows.filter(IS_ANCHOR)
    near = tiles(anchors, rows, ["dim", "label"], ["vec_id", "codes", "wide"], ["vec_id", "codes", "wide"], lambda key, a, c: nearest(key, a, c, positives))
    first = Window.partitionBy("anchor_id").orderBy(F.desc("place"), "vec_id")
    near = staged(near.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "place"), "positives")
    lists = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "place")).alias("positives"))
    own = anchors.join(lists, "vec_id")
    far = tiles(own, rows, ["dim"], ["vec_id", "label", "codes", "wide", "positives"], ["vec_id", "label", "codes", "wide"], lambda key, a, c: under_positives(key, a, c, negatives))
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("place"), "vec_id")
    ranked = far.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    found = ranked.join(near.drop("place"), ["anchor_id", "positive_id"])
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return mine(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_inner_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id AND a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
