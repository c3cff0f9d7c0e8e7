"""Running values along a key's rows that hold however many rows one key has.

Keys of up to HOT_ROWS rows are windows. Beyond that a segmented scan is taken: rows are dealt by ranges of (key, order), so
a busy key is cut into runs on many tasks; a run's summary is carried into those behind it. Only runs of keys that are cut are
carried, one for each border between ranges at most, so the carry is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..staging import staged

HOT_ROWS = 4 << 20


def is_hot(df: DataFrame, keys: list[str]) -> bool:
    """Whether a key has more rows than one task should sort."""
    return (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > HOT_ROWS


def _runs(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, WindowSpec]:
    """df, staged, with _run: its range; and the window of a key's rows in a run."""
    ranged = staged(df.repartitionByRange(*keys, *order).withColumn("_run", F.spark_partition_id()), "runs")
    return ranged, Window.partitionBy(*keys, "_run").orderBy(*order)


def _carried(ranged: DataFrame, keys: list[str], summary: Column, carry) -> DataFrame:
    """ranged with _carry: carry(summaries of a key's runs, the runs' window)."""
    every = Window.partitionBy(*keys)
    found = ranged.groupBy(*keys, "_run").agg(summary.alias("_summary")).withColumn("_n", F.count("*").over(every)).filter("_n > 1")
    found = found.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_run").alias("_r"), carry(F.col("_summary"), every.orderBy("_run")).alias("_carry")).filter("_carry is not null")
    same = F.col("_run") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranged.join(F.broadcast(found), same, "left").drop("_r", *(f"_k{i}" for i in range(len(keys))))


def lagged(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """df with out: value of the row before, by order, within the keys; null for the first."""
    if not is_hot(df, keys):
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    ranged, within = _runs(df.withColumn("_v", F.struct(value.alias("v"))), keys, order)
    known = _carried(ranged, keys, F.max_by("_v", F.struct(*order)), lambda s, w: F.lag(s).over(w))
    return known.withColumn(out, F.coalesce(F.lag("_v").over(within), "_carry")["v"]).drop("_v", "_run", "_carry")


def led(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """df with out: value of the row behind, by order, within the keys; null for the last."""
    if not is_hot(df, keys):
        return df.withColumn(out, F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)))
    ranged, within = _runs(df.withColumn("_v", F.struct(value.alias("v"))), keys, order)
    known = _carried(ranged, keys, F.min_by("_v", F.struct(*order)), lambda s, w: F.lead(s).over(w))
    return known.withColumn(out, F.coalesce(F.lead("_v").over(within), "_carry")["v"]).drop("_v", "_run", "_carry")


def last_known(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """df with out: the last value that is not null up to each row, by order, within the keys."""
    if not is_hot(df, keys):
        return df.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    ranged, within = _runs(df, keys, order)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    known = _carried(ranged, keys, last, lambda s, w: F.last(s, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return known.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)), "_carry")).drop("_run", "_carry")
