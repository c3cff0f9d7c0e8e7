"""Rows whose value is on a list, however long either is.

A list of up to MOST_BROADCAST values is broadcast. Of a longer one a Bloom filter is made in tasks (bits of each value, merged by bitwise or) and
broadcast in its place, so that only rows which pass it, the listed ones and about one in fifty others, are shuffled to the exact join.
The filter is blocked: a value's bits lie in one segment of 8 KB, found by one equi-join. MOST_SEGMENTS of them (128 MB) are broadcast at most; a list
of more than SEGMENT_VALUES values a segment lets more rows pass, which changes no result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged

MOST_BROADCAST = 1 << 20
SEGMENT_VALUES, MOST_SEGMENTS = 6500, 1 << 14
WORDS, BITS = 1024, 4


def _places(value: Column) -> list[tuple[Column, Column]]:
    """Word and bit in a segment of each of a value's bits."""
    h = F.xxhash64(value, F.lit("bits"))
    spots = [F.shiftrightunsigned(h, 16 * i).bitwiseAND(F.lit((1 << 16) - 1)).cast("int") for i in range(BITS)]
    return [(F.shiftright(s, 6), F.call_function("shiftleft", F.lit(1).cast("long"), s.bitwiseAND(F.lit(63)))) for s in spots]


def _segment(value: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(segments)).cast("int")


def bloom(values: DataFrame, value: str, n: int) -> tuple[DataFrame, int]:
    """_segment, words (longs) of a Bloom filter of n values, and its number of segments."""
    segments = min(MOST_SEGMENTS, max(1, -(-n // SEGMENT_VALUES)))
    bits = F.explode(F.array(*(F.struct(w.alias("w"), b.alias("b")) for w, b in _places(F.col(value)))))
    held = values.select(_segment(F.col(value), segments).alias("_segment"), bits.alias("x")).groupBy("_segment", F.col("x.w").alias("w")).agg(F.bit_or("x.b").alias("b"))
    every = values.sparkSession.range(segments * WORDS).select((F.col("id") / WORDS).cast("int").alias("_segment"), (F.col("id") % WORDS).cast("int").alias("w"))
    dense = every.join(held, ["_segment", "w"], "left").groupBy("_segment").agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("x"))
    return staged(dense.select("_segment", F.col("x.b").alias("words")), "bloom"), segments


def may_hold(rows: DataFrame, value: str, filter_: tuple[DataFrame, int]) -> DataFrame:
    """Rows whose value may be in the filter; none that is goes. A null value is in none."""
    table, segments = filter_
    words = table.withColumnRenamed("_segment", "_filter_segment").withColumnRenamed("words", "_filter_words")
    found = reduce(lambda a, b: a & b, (F.get(F.col("_filter_words"), w).bitwiseAND(b) != 0 for w, b in _places(F.col(value))))
    return rows.filter(F.col(value).isNotNull()).join(F.broadcast(words), (_segment(F.col(value), segments) == F.col("_filter_segment")) & found).select(rows.columns)


def listed(values: DataFrame, watch: DataFrame, on: str = "value") -> DataFrame:
    """Rows whose value is on a list (value), without case and the list's outer blanks."""
    own = staged(watch.select(F.lower(F.trim("value")).alias("_w")).filter("_w is not null").distinct(), "list")
    n = own.count()
    key = F.lower(F.col(on))
    if n <= MOST_BROADCAST:
        return values.join(F.broadcast(own), key == F.col("_w"), "left_semi")
    some = may_hold(values.withColumn("_key", key), "_key", bloom(own, "_w", n))
    return some.join(own.hint("shuffle_merge"), F.col("_key") == F.col("_w"), "left_semi").drop("_key")
