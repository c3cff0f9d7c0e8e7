"""Detections over live feeds: the batch detectors' rules with event time, watermarks and state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

LATE = "10 minutes"


def brute_force(logons: DataFrame, threshold: int = 5, window: str = "10 minutes", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Failures per user and window. logons: ts, user, success."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = logons.withWatermark("ts", late).groupBy(w, F.lower("user").alias("user")).agg(F.count_if(~F.col("success")).alias("failures"), F.min(F.when(~F.col("success"), F.col("ts"))).alias("first_failure"), F.max(F.when(F.col("success"), F.col("ts"))).alias("last_success"))
    out = out.filter(F.col("failures") >= threshold)
    return out.select("user", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "failures", F.coalesce(F.col("last_success") >= F.col("first_failure"), F.lit(False)).alias("compromised"))


def password_spray(logons: DataFrame, threshold: int = 3, window: str = "10 minutes", late: str = LATE) -> DataFrame:
    """Distinct failing users per source and window (approximate, as exact distinct counts have unbounded state, but never more than failures that name a user)."""
    users = F.least(F.approx_count_distinct(F.lower("user"), 0.01), F.count("user"))
    out = logons.filter("not success").withWatermark("ts", late).groupBy(F.window("ts", window), "source_ip").agg(users.alias("users"), F.count("*").alias("failures"))
    return out.filter(F.col("users") >= threshold).select("source_ip", F.col("window.start").alias("start"), "users", "failures")


def impossible_travel(logins: DataFrame, seconds: int = 3600, late: str = LATE) -> DataFrame:
    """Two countries of one user within so many seconds; the state is the user's last login, dropped after twice that time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        last = state.get if state.exists else None
        out = []
        for ts, country in zip(rows["ts"], rows["country"]):
            now = int(ts.value // 1000)
            if last is not None and country is not None and last[1] is not None and country != last[1] and 0 <= now - last[0] <= seconds * 1_000_000:
                out.append((key[0], last[1], country, pd.Timestamp(last[0], unit="us"), ts, (now - last[0]) / 1e6))
            if last is None or now >= last[0]:
                last = (now, country)
        state.update(last)
        state.setTimeoutTimestamp(max(last[0] // 1000, state.getCurrentWatermarkMs()) + 2000 * seconds)
        yield pd.DataFrame(out, columns=["user", "country", "next_country", "ts", "next_ts", "seconds"])

    return logins.withWatermark("ts", late).groupBy("user").applyInPandasWithState(step, "user string, country string, next_country string, ts timestamp, next_ts timestamp, seconds double", "ts long, country string", "append", GroupStateTimeout.EventTimeTimeout)


def beacons(events: DataFrame, late: str = LATE, idle_seconds: int = 86400) -> DataFrame:
    """Regularity per apex from running count, sum and sum of squares of its gaps (no median, which has unbounded state)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, n, total, squares = state.get if state.exists else (None, 0, 0.0, 0.0)
        for ts in pd.concat(list(batches))["ts"].sort_values():
            now = int(ts.value // 1000)
            gap = (now - last) / 1e6 if last is not None else 0.0
            if gap > 0.05:
                n, total, squares = n + 1, total + gap, squares + gap * gap
            last = now if last is None else max(last, now)
        state.update((last, n, total, squares))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + 1000 * idle_seconds)
        if n >= 4:
            mean = total / n
            spread = max(0.0, squares / n - mean * mean) ** 0.5
            yield pd.DataFrame([(key[0], n, mean, max(0.0, min(1.0, 1 - spread / mean)))], columns=["apex", "gaps", "mean_gap", "regularity"])

    return events.withWatermark("ts", late).groupBy("apex").applyInPandasWithState(step, "apex string, gaps long, mean_gap double, regularity double", "last long, n long, total double, squares double", "update", GroupStateTimeout.EventTimeTimeout)


def flow_sessions(packets: DataFrame, idle: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Flows of unordered endpoints that end after so long without a packet."""
    a, b = F.struct(F.col("src").alias("host"), F.col("src_port").alias("port")), F.struct(F.col("dst").alias("host"), F.col("dst_port").alias("port"))
    p = packets.withColumns({"low": F.least(a, b), "high": F.greatest(a, b)}).withWatermark("ts", late)
    out = p.groupBy(F.session_window("ts", idle), "low", "high").agg(F.count("*").alias("packets"), F.sum("wire_len").alias("bytes"))
    return out.select("low", "high", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "packets", "bytes")


def first_seen(iocs: DataFrame, late: str = LATE) -> DataFrame:
    """Each indicator once within the watermark. iocs: ts, ioc_type, value."""
    return iocs.withColumn("value", F.lower(F.trim("value"))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["ioc_type", "value"])


def matched(values: DataFrame, watch: DataFrame, on: str = "value") -> DataFrame:
    """Stream rows whose value is on a static list (value)."""
    return values.join(watch.select(F.lower(F.trim("value")).alias("_w")).distinct(), F.lower(F.col(on)) == F.col("_w"), "left_semi")


def near_alerts(alerts: DataFrame, rows: DataFrame, seconds: int = 60, late: str = LATE) -> DataFrame:
    """Alerts (user, alert_ts) and rows (user, ts) of two streams, of one user and less than so many seconds apart."""
    a = alerts.withWatermark("alert_ts", late).withColumnRenamed("user", "_user")
    r = rows.withWatermark("ts", late)
    gap = F.expr(f"INTERVAL {seconds} SECONDS")
    return a.join(r, (F.col("_user") == F.col("user")) & (F.col("ts") > F.col("alert_ts") - gap) & (F.col("ts") < F.col("alert_ts") + gap)).drop("_user")


def _last_batch(spark: SparkSession, out: str) -> int:
    """The number of the last batch that has a folder, from this run or one before; -1 without any. A batch that did not end is run again and writes the same folder."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    names = [f.getPath().getName() for f in top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(top)]
    return max((int(n[6:]) for n in names if n.startswith("batch=") and n[6:].isdigit()), default=-1)


def drained(stream: DataFrame, mode: str, checkpoint: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """All that the stream's sources hold now, run once: rows appended to a Parquet folder, or the result after the last batch.

    In complete mode each batch holds the whole result; in update mode a batch replaces the rows of its keys, and the
    rows of other keys stay. Batches go to folders of their own, so a batch that runs again writes the same.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:

        def keep(df: DataFrame, n: int) -> None:
            df.write.mode("overwrite").parquet(f"{out}/batch={n}")

        query = writer.foreachBatch(keep).start()
    query.awaitTermination()
    spark, schema = stream.sparkSession, StructType([*stream.schema.fields, StructField("batch", LongType())])
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(out)  # a folder, also after no batch
    found = spark.read.schema(schema).parquet(out)
    if mode == "complete":
        return found.filter(F.col("batch") == _last_batch(spark, out)).drop("batch")
    if not keys:
        raise ValueError("update mode needs the keys of its rows")
    rest = [c for c in stream.columns if c not in keys]
    latest = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return latest.select(*(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in stream.columns))
