"""Timelines: unions of sources, gaps, and alerts tied to rows nearby."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import duration
from . import scans

COLUMNS = ["entity", "ts", "source", "event", "ref"]


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def deltas(timeline: DataFrame, by: str = "entity", most: float = 3600, order: tuple[str, ...] = ("source", "ref")) -> DataFrame:
    """seconds since the row before (0 for the first), as text, and whether the gap is excessive."""
    out = scans.lagged(timeline, [by], ["ts", *order], F.unix_micros("ts"), "_before")
    out = out.withColumn("delta", F.coalesce((F.unix_micros("ts") - F.col("_before")) / 1000000, F.lit(0.0))).drop("_before")
    return out.withColumns({"delta_text": duration(F.col("delta")), "excessive": F.col("delta") > most})


def tagged(alerts: DataFrame, rows: DataFrame, by: str, seconds: int = 60) -> DataFrame:
    """Pairs of alerts (alert_id, by, alert_ts) and rows (by, ts, ...) of one key less than so many seconds apart.

    Both sides are dealt by key and time bucket, so a busy key is spread over its buckets.
    """
    bucket = lambda c: F.floor(F.unix_micros(c) / (seconds * 1000000)).cast("long")
    near = alerts.withColumn("_b", F.explode(F.sequence(bucket("alert_ts") - 1, bucket("alert_ts") + 1)))
    met = near.join(rows.withColumn("_b", bucket("ts")), [by, "_b"])
    return met.filter(F.abs(F.unix_micros("ts") - F.unix_micros("alert_ts")) < seconds * 1000000).drop("_b")


def chronological(timeline: DataFrame, *keys: str) -> DataFrame:
    """All rows in order of time, rows without one last; for a final result or a file, as rows are dealt by ranges of time."""
    return timeline.orderBy(F.col("ts").asc_nulls_last(), *(keys or ("source", "ref")))


def previews(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows, by order, of each key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def by_record(alerts: DataFrame, rows: DataFrame, record: str = "record_id") -> DataFrame:
    """Alerts with the rows whose ids they list (record_ids)."""
    return alerts.withColumn(record, F.explode("record_ids")).drop("record_ids").join(rows, record)


def lifecycle(messages: DataFrame, hops: DataFrame, signatures: DataFrame, parts: DataFrame, key: str = "message_key") -> DataFrame:
    """One timeline of a message: its own date, hops, signing and expiry of signatures, attachments, ingest.

    messages: key, date, ingest_ts; hops: key, hop, ts, by_host; signatures: key, domain, signed, expires;
    parts: key, filename, modified. Rows without a time are left out.
    """
    entity = F.col(key).alias("entity")
    row = lambda df, ts, source, event, ref: df.select(entity, F.col(ts).alias("ts"), F.lit(source).alias("source"), F.lit(event).alias("event"), F.coalesce(ref.cast("string"), F.lit("")).alias("ref"))
    none = F.lit(None)
    all_ = union(
        row(messages, "date", "client", "SENT", none), row(hops, "ts", "relay", "RECEIVED", F.concat_ws(" ", "hop", "by_host")), row(signatures, "signed", "dkim", "SIGNED", F.col("domain")),
        row(signatures, "expires", "dkim", "EXPIRES", F.col("domain")), row(parts, "modified", "attachment", "MODIFIED", F.col("filename")), row(messages, "ingest_ts", "ingest", "INGESTED", none),
    )
    return all_.filter("ts is not null")
