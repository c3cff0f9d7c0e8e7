"""The alert contract and severity scores that every detector shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points of each severity.
POINTS = {"CRITICAL": 40, "HIGH": 20, "MEDIUM": 10}

COLUMNS = ["alert_type", "severity", "ts", "actor", "target", "source_ip", "mitre", "reason", "evidence_count", "record_ids"]


def alert(df: DataFrame, alert_type: str, severity: Column | str, mitre: str, reason: Column | str, **columns: Column | str) -> DataFrame:
    """df as alerts; columns not named are null."""
    kinds = {"ts": "timestamp", "evidence_count": "long", "record_ids": "array<long>"}
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    given = {"alert_type": F.lit(alert_type), "severity": col(severity), "mitre": F.lit(mitre), "reason": col(reason)}
    given |= {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    return df.select(*(given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def severity_points(severity: Column) -> Column:
    out = F.lit(0)
    for name, points in POINTS.items():
        out = F.when(severity == name, points).otherwise(out)
    return out


def verdict(score: Column, any_critical: Column, any_high: Column) -> Column:
    return F.when((score >= 60) | any_critical, "MALICIOUS").when((score >= 20) | any_high, "SUSPICIOUS").otherwise("BENIGN")


def scored(alerts: DataFrame, *by: str) -> DataFrame:
    """Points summed and capped at 100, and the verdict, per key or over all alerts."""
    out = alerts.groupBy(*by).agg(
        F.count("*").alias("alerts"),
        F.least(F.lit(100), F.coalesce(F.sum(severity_points(F.col("severity"))), F.lit(0))).cast("int").alias("score"),
        F.coalesce(F.bool_or(F.col("severity") == "CRITICAL"), F.lit(False)).alias("_critical"),
        F.coalesce(F.bool_or(F.col("severity") == "HIGH"), F.lit(False)).alias("_high"),
    )
    return out.withColumn("verdict", verdict(F.col("score"), F.col("_critical"), F.col("_high"))).drop("_critical", "_high")


def rules(df: DataFrame, table: list[tuple[str, str, str, Column]], keep: list[str]) -> DataFrame:
    """A row for each (rule, severity, mitre, condition) of the table that a row of df fulfils: one scan, no join."""
    hits = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.lit(m).alias("mitre"))) for n, s, m, c in table)), lambda x: x.isNotNull())
    return df.select(*keep, F.inline(hits))
