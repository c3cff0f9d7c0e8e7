"""DNS detections over query and answer tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domains import registered_domain, subdomain
from ..functions.suffixes import SuffixRules
from ..functions.network import ip_number, subnet24
from ..functions.text import covert_subdomain, encoding_class, entropy

# Roots of everyday traffic, which no detector reports.
BENIGN_ROOTS = ["google.com", "googleapis.com", "gstatic.com", "microsoft.com", "windowsupdate.com", "live.com", "office.com", "amazon.com", "amazonaws.com", "cloudfront.net", "akamai.net", "akamaiedge.net", "cloudflare.com", "apple.com", "icloud.com", "github.com", "githubusercontent.com", "facebook.com", "fbcdn.net", "twitter.com", "t.co", "digicert.com", "sectigo.com", "letsencrypt.org", "verisign.com"]


def tunnelling(queries: DataFrame, suffixes: SuffixRules | None = None) -> DataFrame:
    """Apexes whose queries (name, rtype) carry payloads: two of six signs, or four entropic names with one of 35 characters."""
    name = F.lower(F.rtrim(F.col("name"), F.lit(".")))
    rows = queries.withColumn("name", name).groupBy("name", F.upper("rtype").alias("rtype")).agg(F.count("*").alias("k"))  # each distinct name is analysed once
    sub = subdomain(F.col("name"), suffixes)
    rows = rows.withColumns({"apex": registered_domain(F.col("name"), suffixes), "sub": sub}).filter(~F.col("apex").isin(BENIGN_ROOTS))
    rows = rows.withColumns({"n": F.length("sub"), "odd": (entropy(F.col("sub")) >= 4.0) | F.coalesce(covert_subdomain(F.col("sub")), F.lit(False)), "kind": encoding_class(F.col("sub"))})
    out = rows.groupBy("apex").agg(
        F.sum("k").alias("queries"), F.countDistinct("name").alias("names"), F.sum(F.when(F.col("odd"), F.col("k")).otherwise(0)).alias("entropic"),
        F.max("n").alias("longest"), F.sum(F.col("n") * F.col("k")).alias("bytes"), F.bool_or(F.col("rtype").isin("TXT", "NULL")).alias("_txt"), F.bool_or(F.col("kind") != "UNKNOWN").alias("_encoded"),
    ).filter("queries >= 3")
    busy = (F.col("entropic") >= 5) | ((F.col("queries") >= 5) & (F.col("entropic") / F.col("queries") >= 0.5))
    large = (F.col("longest") >= 50) | (F.col("bytes") / F.col("queries") >= 30)
    signs = [(F.col("queries") >= 10) & (F.col("names") / F.col("queries") >= 0.75), busy, large, F.col("_txt"), F.col("_encoded"), F.col("bytes") >= 2048]
    out = out.withColumn("signs", reduce(lambda a, b: a + b, (s.cast("int") for s in signs)))
    severity = F.when(F.col("bytes") >= 2048, "CRITICAL").when(busy | large | F.col("_encoded"), "HIGH").otherwise("MEDIUM")
    out = out.withColumn("severity", severity).filter((F.col("signs") >= 2) | ((F.col("entropic") >= 4) & (F.col("longest") >= 35)))
    return out.drop("_txt", "_encoded")


def fast_flux(answers: DataFrame, servers: DataFrame | None = None) -> DataFrame:
    """Domains of answers (domain, ip, ttl) that rotate addresses; servers (domain, ns) tell double flux."""
    number = ip_number(F.col("ip"))
    out = answers.groupBy("domain").agg(F.countDistinct("ip").alias("ips"), F.min("ttl").alias("min_ttl"), F.round(F.avg("ttl"), 2).alias("avg_ttl"), F.countDistinct(subnet24(number)).alias("subnets"))
    if servers is not None:
        out = out.join(servers.groupBy("domain").agg(F.countDistinct("ns").alias("name_servers")), "domain", "left")
    else:
        out = out.withColumn("name_servers", F.lit(None).cast("long"))
    out = out.withColumn("name_servers", F.coalesce("name_servers", F.lit(0)))
    low = (F.col("min_ttl") <= 300) | (F.col("avg_ttl") <= 300)
    out = out.filter((F.col("ips") >= 3) & low & ((F.col("ips") >= 4) | (F.col("subnets") >= 3)))
    return out.withColumn("flux", F.when(F.col("name_servers") >= 3, "DOUBLE_FLUX").otherwise("SINGLE_FLUX")).withColumn("severity", F.when(F.col("name_servers") >= 3, "CRITICAL").otherwise("HIGH"))


def flux_lists(answers: DataFrame, servers: DataFrame, most_ips: int = 15, most_servers: int = 10) -> DataFrame:
    """Per domain its first addresses and name servers, so many at most; only these are gathered."""

    def first(df: DataFrame, value: str, n: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("domain").orderBy(value))
        return df.select("domain", value).filter(F.col(value).isNotNull()).distinct().withColumn("_n", place).filter(F.col("_n") <= n).groupBy("domain").agg(F.sort_array(F.collect_list(value)).alias(f"{value}_list"))

    return first(answers, "ip", most_ips).join(first(servers, "ns", most_servers), "domain", "left")


def intervals(events: DataFrame, key: str = "apex") -> DataFrame:
    """Seconds between successive events of a key; those of 0.05 s or less are bursts and left out."""
    w = Window.partitionBy(key).orderBy("ts")
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1000000
    return events.select(key, "ts").withColumn("gap", gap).filter("gap > 0.05")


def beaconing(events: DataFrame, key: str = "apex", digits: int = 2) -> DataFrame:
    """Mean, median and deviation of the gaps of a key, and regularity 1 - deviation / mean, held to 0..1."""
    out = intervals(events, key).groupBy(key).agg(F.count("*").alias("gaps"), F.avg("gap").alias("_m"), F.median("gap").alias("_d"), F.stddev_pop("gap").alias("_s"))
    out = out.withColumn("_r", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_s") / F.col("_m"))))
    beacon = (F.col("_r") >= 0.70) & (F.col("_m") >= 1.0) & (F.col("gaps") >= 4)
    out = out.withColumn("is_beacon", beacon).filter(beacon | (F.col("gaps") >= 8))
    severity = F.when(~F.col("is_beacon"), "LOW").when(F.col("_r") >= 0.88, "CRITICAL").otherwise("HIGH")
    return out.select(key, "gaps", F.round("_m", digits).alias("mean_gap"), F.round("_d", digits).alias("median_gap"), F.round("_s", digits).alias("deviation"), F.round("_r", 3).alias("regularity"), "is_beacon", severity.alias("severity"))


def failure_rate(events: DataFrame, key: str, failed: str, least: int = 10, rate: float = 0.4) -> DataFrame:
    """Keys with at least so many failures that are at least this share of their events."""
    out = events.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col(failed)).alias("failed"))
    return out.withColumn("rate", F.round(F.col("failed") / F.col("total"), 4)).filter((F.col("failed") >= least) & (F.col("failed") / F.col("total") >= rate))


def large_payloads(records: DataFrame) -> DataFrame:
    """TXT, NULL and CNAME data of 120 bytes, or of 64 with entropy of 4.5."""
    size = F.octet_length("rdata")
    return records.filter(F.upper("rtype").isin("TXT", "NULL", "CNAME")).withColumns({"bytes": size, "entropy": entropy(F.col("rdata"))}).filter((F.col("bytes") >= 120) | ((F.col("bytes") >= 64) & (F.col("entropy") >= 4.5)))


# Points of each kind of finding.
FINDING_POINTS = {"tunnels": 40, "flux": 35, "generated": 25, "beacons": 20, "payloads": 15, "failures": 15}


def scored(findings: DataFrame, *by: str) -> DataFrame:
    """Score and verdict from counts of findings (columns of FINDING_POINTS) by which of them exist."""
    points = reduce(lambda a, b: a + b, (F.when(F.max(k) > 0, n).otherwise(0) for k, n in FINDING_POINTS.items()))
    out = findings.groupBy(*by).agg(F.least(F.lit(100), points).alias("score"))
    return out.withColumn("verdict", F.when(F.col("score") >= 60, "MALICIOUS").when(F.col("score") >= 25, "SUSPICIOUS").otherwise("BENIGN"))
