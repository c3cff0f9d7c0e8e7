"""Transit routes: Received headers and hop anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.network import address, is_private_address
from ..functions.times import parsed_time

MOST_DELAY = 86400


def parsed_received(headers: DataFrame, value: str = "value") -> DataFrame:
    """Clauses of a Received header; what stands after the last semicolon is its date."""
    v = F.regexp_replace(F.col(value), r"\s+", " ")
    part = lambda pattern: F.nullif(F.regexp_extract(v, pattern, 1), F.lit(""))
    out = headers.withColumns({
        "from_host": part(r"(?i)\bfrom\s+([^\s;()]+)"), "from_ip": part(r"(?i)\bfrom\s+[^;]*?\[?(\d{1,3}(?:\.\d{1,3}){3})\]?"), "by_host": part(r"(?i)\bby\s+([^\s;()]+)"),
        "protocol": part(r"(?i)\bwith\s+([a-zA-Z0-9_-]+)"), "id": part(r"(?i)\bid\s+([^\s;]+)"), "recipient": part(r"(?i)\bfor\s+<?([^\s;>]+)"),
        "tls": part(r"(?i)\b(?:using TLS|cipher=)\s*([^;)]+)"), "ts": F.when(F.contains(v, F.lit(";")), parsed_time(F.substring_index(v, ";", -1))),
    })
    return out


def numbered(headers: DataFrame, key: str = "message_key", pos: str = "pos") -> DataFrame:
    """The last Received header is the first hop."""
    return headers.withColumn("hop", F.row_number().over(Window.partitionBy(key).orderBy(F.col(pos).desc())))


def hop_delays(hops: DataFrame, key: str = "message_key", hop: str = "hop", most: int = MOST_DELAY) -> DataFrame:
    """delay in seconds to the last hop with a time, whether it runs backwards or takes more than `most`."""
    before = F.last("ts", ignorenulls=True).over(Window.partitionBy(key).orderBy(hop).rowsBetween(Window.unboundedPreceding, -1))
    out = hops.withColumn("delay", (F.unix_micros("ts") - F.unix_micros(before)) / 1000000)
    return out.withColumns({"skewed": F.coalesce(F.col("delay") < 0, F.lit(False)), "late": F.coalesce(F.col("delay") > most, F.lit(False))})


def time_travel(hops: DataFrame, key: str = "message_key", hop: str = "hop") -> DataFrame:
    """In order of time, hops whose number is below one already passed."""
    passed = F.max(hop).over(Window.partitionBy(key).orderBy("ts", hop).rowsBetween(Window.unboundedPreceding, -1))
    return hops.filter("ts is not null").withColumn("passed", passed).withColumn("travels", F.coalesce(F.col(hop) < F.col("passed"), F.lit(False)))


def origins(hops: DataFrame, key: str = "message_key") -> DataFrame:
    """The first hop with a public address, else hop 1, and the seconds in transit. hops: hop, from_ip, delay."""
    own = address(F.col("from_ip"))
    public = own.isNotNull() & ~is_private_address(own)
    return hops.groupBy(key).agg(
        F.min_by("from_ip", F.struct((~F.coalesce(public, F.lit(False))).alias("p"), F.col("hop"))).alias("origin"), F.count("*").alias("hops"), F.sum(F.greatest(F.lit(0.0), F.coalesce("delay", F.lit(0.0)))).alias("transit")
    )


def clock_anomalies(messages: DataFrame, hops: DataFrame, key: str = "message_key") -> DataFrame:
    """Messages (date, ingest_ts) dated over 5 minutes after ingest, or drifting from their first hop by -60 s or a day."""
    first = hops.groupBy(key).agg(F.min_by("ts", "hop").alias("first_hop"))
    out = messages.join(first, key, "left").withColumn("drift", (F.unix_micros("first_hop") - F.unix_micros("date")) / 1000000)
    return out.withColumns({"future": F.coalesce(F.unix_micros("date") > F.unix_micros("ingest_ts") + 300 * 1000000, F.lit(False)), "drifting": F.coalesce((F.col("drift") < -60) | (F.col("drift") > MOST_DELAY), F.lit(False))})
