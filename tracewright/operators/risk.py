"""Capped risk sums, case risk, tactics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The most each vector adds.
CAPS = {"AUTHENTICATION": 25.0, "PHISHING_URL": 25.0, "BEC_SOCIAL_ENGINEERING": 20.0, "ATTACHMENT_MALWARE": 20.0, "OBFUSCATION_TRANSIT": 10.0}

# Tactics of technique ids.
TACTICS = [("T1566", "Initial Access"), ("T1190", "Initial Access"), ("T1204", "Execution"), ("T1059", "Execution"), ("T1053", "Persistence"), ("T1543", "Persistence"), ("T1505", "Persistence"), ("T1098", "Persistence"), ("T1136", "Persistence"), ("T1548", "Privilege Escalation"), ("T1027", "Defense Evasion"), ("T1218", "Defense Evasion"), ("T1564", "Defense Evasion"), ("T1003", "Credential Access"), ("T1110", "Credential Access"), ("T1528", "Credential Access"), ("T1021", "Lateral Movement"), ("T1114", "Collection"), ("T1071", "Command and Control"), ("T1105", "Command and Control"), ("T1568", "Command and Control"), ("T1048", "Exfiltration"), ("T1490", "Impact"), ("T1486", "Impact")]


def looked_up(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def vector_scores(factors: DataFrame, key: str, caps: dict[str, float] = CAPS) -> DataFrame:
    """Points of factors (key, vector, points, severity) summed per vector and held to its cap."""
    cap = looked_up(F.col("vector"), caps)
    return factors.groupBy(key, "vector").agg(F.least(F.sum("points"), F.first(cap)).alias("score"), F.count("*").alias("factors"), F.bool_or(F.col("severity") == "CRITICAL").alias("critical"))


def totals(vectors: DataFrame, key: str) -> DataFrame:
    out = vectors.groupBy(key).agg(F.round(F.least(F.lit(100.0), F.sum("score")), 1).alias("score"), F.bool_or("critical").alias("_critical"))
    s = F.col("score")
    tier = F.when((s >= 90) | ((s >= 75) & F.col("_critical")), "CRITICAL").when(s >= 70, "HIGH").when(s >= 40, "MEDIUM").when(s >= 20, "SUSPICIOUS_LOW").otherwise("CLEAN")
    return out.withColumn("level", tier).drop("_critical")


def case_risk(items: DataFrame, correlations: DataFrame | None, key: str = "case_id") -> DataFrame:
    """min(100, max(0.7 max + 0.3 mean + min(10 correlations, 30), max)) of items (key, risk_score)."""
    out = items.groupBy(key).agg(F.max("risk_score").alias("_max"), F.avg("risk_score").alias("_avg"), F.count("*").alias("items"))
    if correlations is not None:
        out = out.join(correlations.groupBy(key).agg(F.count("*").alias("correlations")), key, "left")
    else:
        out = out.withColumn("correlations", F.lit(0))
    bonus = F.least(10 * F.coalesce("correlations", F.lit(0)), F.lit(30))
    score = F.least(F.lit(100.0), F.greatest(0.7 * F.col("_max") + 0.3 * F.col("_avg") + bonus, F.col("_max")))
    return out.select(key, "items", F.coalesce("correlations", F.lit(0)).cast("long").alias("correlations"), F.round(score, 2).alias("score"))


def tactic(technique: Column) -> Column:
    out = F.lit("Other")
    for prefix, name in reversed(TACTICS):
        out = F.when(technique.startswith(prefix), name).otherwise(out)
    return out


def tactic_matrix(alerts: DataFrame, technique: str = "mitre", *by: str) -> DataFrame:
    return alerts.groupBy(*by, tactic(F.col(technique)).alias("tactic")).agg(F.array_join(F.sort_array(F.collect_set(technique)), ",").alias("techniques"), F.count("*").alias("alerts"))


def item_score(kind: Column, malicious: Column, suspicious: Column, findings: Column) -> Column:
    """Score of an evidence item by its kind: binary 45 / 35 / 25, capture 50 / 40, log 30 + 15 a finding, memory 60 / 30."""
    out = (
        F.when(kind == "binary", F.when(malicious, 45).when(suspicious, 35).when(findings > 0, 25).otherwise(0))
        .when(kind == "capture", F.when(malicious, 50).when(suspicious, 40).otherwise(0))
        .when(kind == "log", F.when(findings > 0, 30 + 15 * findings).otherwise(0))
        .when(kind == "memory", F.when(malicious, 60).when(findings > 0, 30).otherwise(0))
        .otherwise(0)
    )
    return F.least(F.lit(100), out)


def kill_chain(items: DataFrame, key: str = "case_id") -> DataFrame:
    """Whether mail and binary evidence are both in a case (items: key, kind)."""
    return items.groupBy(key).agg((F.bool_or(F.col("kind") == "email") & F.bool_or(F.col("kind") == "binary")).alias("kill_chain"))


# Points and severity of each factor of a message's risk.
FACTORS = {
    "AUTHENTICATION": {"SPF_FAIL": (10.0, "HIGH"), "SPF_SOFTFAIL": (5.0, "MEDIUM"), "DKIM_INVALID": (10.0, "HIGH"), "DMARC_ENFORCED": (15.0, "CRITICAL"), "DMARC_FAIL": (10.0, "HIGH"), "ARC_BROKEN": (8.0, "MEDIUM")},
    "PHISHING_URL": {"IDN_HOMOGRAPH_ATTACK": (15.0, "CRITICAL"), "IP_HOST_URL": (12.0, "HIGH"), "ANCHOR_URL_MISMATCH": (10.0, "HIGH"), "SUSPICIOUS_SHORTENER": (8.0, "MEDIUM"), "CREDENTIAL_PHISH_PARAM": (8.0, "HIGH")},
    "ATTACHMENT_MALWARE": {"RULE_MATCH": (20.0, "CRITICAL"), "mismatch": (15.0, "HIGH"), "double_extension": (15.0, "HIGH"), "macro": (12.0, "HIGH"), "dangerous": (15.0, "CRITICAL")},
    "OBFUSCATION_TRANSIT": {"ZERO_WIDTH": (8.0, "MEDIUM"), "HIDDEN_CSS": (6.0, "MEDIUM"), "BASE64_TEXT": (6.0, "MEDIUM"), "HOP_ANOMALY": (5.0, "MEDIUM"), "TOR_HOP": (8.0, "HIGH")},
}
INDICATOR_POINTS = 15.0


def factors(findings: DataFrame, key: str) -> DataFrame:
    """Risk factors (key, vector, factor, points, severity) from findings (key, vector, factor, confidence).

    Sender-fraud findings weigh 15 points times their confidence (1 if null); others as in FACTORS, each once
    a message and factor; unknown factors are left out.
    """
    table = findings.sparkSession.createDataFrame([(v, f, p, s) for v, fs in FACTORS.items() for f, (p, s) in fs.items()], "vector string, factor string, points double, severity string")
    once = findings.groupBy(key, "vector", "factor").agg(F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"))
    known = once.join(F.broadcast(table), ["vector", "factor"]).select(key, "vector", "factor", "points", "severity")
    fraud = once.filter("vector = 'BEC_SOCIAL_ENGINEERING'").select(key, "vector", "factor", F.round(F.col("confidence") * INDICATOR_POINTS, 1).alias("points"), F.when(F.col("confidence") >= 0.9, "CRITICAL").otherwise("HIGH").alias("severity"))
    return known.unionByName(fraud)


# Points and rank of each severity of metadata anomalies.
METADATA_POINTS = {"CRITICAL": 50, "HIGH": 35, "MEDIUM": 20, "LOW": 10}


def metadata_score(anomalies: DataFrame, key: str) -> DataFrame:
    """Points of anomalies (key, severity) held to 100; the worst severity counts where it is HIGH or CRITICAL."""
    s = F.col("severity")
    out = anomalies.groupBy(key).agg(F.least(F.lit(100), F.sum(looked_up(s, METADATA_POINTS))).cast("int").alias("score"), F.bool_or(s == "CRITICAL").alias("_c"), F.bool_or(s == "HIGH").alias("_h"))
    n = F.col("score")
    return out.withColumn("severity", F.when(F.col("_c"), "CRITICAL").when(F.col("_h") | (n >= 75), "HIGH").when(n >= 40, "MEDIUM").when(n >= 15, "LOW").otherwise("CLEAN")).drop("_c", "_h")
