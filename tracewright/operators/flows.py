"""Flows, talkers and capture risk over packets (packet_num, ts, wire_len, src, src_port, dst, dst_port, flags)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ports of remote shells and chat control channels.
SUSPICIOUS_PORTS = [1337, 4444, 6667]


def flows(packets: DataFrame, protocol: str | None = None) -> DataFrame:
    """One row per unordered pair of endpoints: counts both ways, the side that spoke first, span, handshake time, TCP state, and what packets say of names (app, sni, http_host, dns_domain, where given)."""
    a, b = F.struct(F.col("src").alias("host"), F.col("src_port").alias("port")), F.struct(F.col("dst").alias("host"), F.col("dst_port").alias("port"))
    p = packets.withColumns({"low": F.least(a, b), "high": F.greatest(a, b)}).withColumn("_forward", F.col("low") == a)
    syn = F.array_contains("flags", "SYN") if "flags" in packets.columns else F.lit(False)
    ack = F.array_contains("flags", "ACK") if "flags" in packets.columns else F.lit(False)
    order = F.struct("ts", "packet_num")
    said = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("app", "sni", "http_host", "dns_domain") if c in packets.columns]  # what the latest packet that says it says
    closing = (F.array_contains("flags", "FIN") | F.array_contains("flags", "RST")) if "flags" in packets.columns else F.lit(False)
    out = p.groupBy("low", "high", *([protocol] if protocol else [])).agg(
        *said,
        F.count("*").alias("packets"), F.sum("wire_len").alias("bytes"), F.count_if("_forward").alias("forward"), F.count_if(~F.col("_forward")).alias("reverse"),
        F.min_by(F.struct("src", "src_port"), F.struct("ts", "packet_num")).alias("client"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min(F.when(syn & ~ack, F.col("ts"))).alias("_syn"), F.min(F.when(syn & ack, F.col("ts"))).alias("_syn_ack"),
        F.max(F.when(closing, F.col("ts"))).alias("_closed"), F.min_by(syn, order).alias("_began"),
    )
    shaken = F.coalesce(F.col("_syn_ack") >= F.col("_syn"), F.lit(False))
    state = F.when(F.col("_closed").isNotNull() & ~F.coalesce(F.col("_closed") < F.col("_syn_ack"), F.lit(False)), "CLOSED").when(shaken | ~F.col("_began"), "ESTABLISHED").otherwise("SYN_SENT")
    return out.withColumn("tcp_state", state).drop("_closed", "_began").withColumn("rtt", F.when(F.col("_syn_ack") >= F.col("_syn"), (F.unix_micros("_syn_ack") - F.unix_micros("_syn")) / 1000000)).drop("_syn", "_syn_ack")


def top_talkers(packets: DataFrame, n: int = 10) -> DataFrame:
    """Hosts by bytes sent and received; ties go to the smaller host."""
    ends = packets.select(F.explode(F.array("src", "dst")).alias("host"), "wire_len")
    return ends.groupBy("host").agg(F.sum("wire_len").alias("bytes"), F.count("*").alias("packets")).orderBy(F.desc("bytes"), "host").limit(n)


def top_ports(packets: DataFrame, n: int = 10) -> DataFrame:
    """Ports by packets; a packet counts once for each of its ports."""
    ends = packets.select(F.explode(F.array_distinct(F.array("src_port", "dst_port"))).alias("port"))
    return ends.groupBy("port").agg(F.count("*").alias("packets")).orderBy(F.desc("packets"), "port").limit(n)


def enriched(flow: DataFrame, intel: DataFrame) -> DataFrame:
    """Flows with the intel (host, country, tag, is_anonymous) of both ends. intel has one row per host."""
    side = lambda s: intel.select(F.col("host").alias(f"_{s}"), *(F.col(c).alias(f"{s}_{c}") for c in ("country", "tag", "is_anonymous")))
    out = flow.join(side("low"), F.col("low.host") == F.col("_low"), "left")
    return out.join(side("high"), F.col("high.host") == F.col("_high"), "left").drop("_low", "_high")


def capture_risk(packets: DataFrame, anonymous: DataFrame, *by: str) -> DataFrame:
    """35 points for any anonymous host (host) among the ends, 25 for a suspicious port; verdict at 60 and 25."""
    seen = packets.select(*by, F.explode(F.array(F.struct(F.col("src").alias("host"), F.col("src_port").alias("port")), F.struct(F.col("dst").alias("host"), F.col("dst_port").alias("port")))).alias("e")).select(*by, "e.*").distinct()
    marked = seen.join(anonymous.select("host").distinct().withColumn("_anon", F.lit(True)), "host", "left")
    out = marked.groupBy(*by).agg(F.coalesce(F.bool_or("_anon"), F.lit(False)).alias("anonymous"), F.coalesce(F.bool_or(F.col("port").isin(SUSPICIOUS_PORTS)), F.lit(False)).alias("suspicious_port"))
    score = F.when(F.col("anonymous"), 35).otherwise(0) + F.when(F.col("suspicious_port"), 25).otherwise(0)
    return out.withColumn("score", score).withColumn("verdict", F.when(F.col("score") >= 60, "MALICIOUS").when(F.col("score") >= 25, "SUSPICIOUS").otherwise("BENIGN"))
