"""Custody tables: digests, ledgers, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALGORITHMS = ("md5", "sha1", "sha256", "sha512")


def digests(content: Column) -> dict[str, Column]:
    b = content.cast("binary")
    return {"md5": F.md5(b), "sha1": F.sha1(b), "sha256": F.sha2(b, 256), "sha512": F.sha2(b, 512)}


def manifest(items: DataFrame, key: str, content: str, *keep: str) -> DataFrame:
    """Size and four digests of each item; its id is a digest of its key, so reruns agree."""
    body = F.col(content).cast("binary")
    return items.select(F.sha2(F.col(key).cast("string").cast("binary"), 256).alias("evidence_id"), key, *keep, F.octet_length(body).cast("long").alias("bytes"), *(c.alias(k) for k, c in digests(body).items()))


def verified(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """VERIFIED, TAMPER_DETECTED or FILE_NOT_FOUND for each item of before, and the digests that differ."""
    late = after.select(F.col(key).alias("_key"), *(F.col(a).alias(f"_{a}") for a in ALGORITHMS))
    met = before.join(late, F.col(key) == F.col("_key"), "left")
    differ = F.filter(F.array(*(F.when(F.col(a) != F.col(f"_{a}"), a) for a in ALGORITHMS)), lambda x: x.isNotNull())
    status = F.when(F.col("_key").isNull(), "FILE_NOT_FOUND").when(F.size(differ) > 0, "TAMPER_DETECTED").otherwise("VERIFIED")
    return met.select(key, status.alias("status"), F.when(F.col("_key").isNull(), F.lit("")).otherwise(F.array_join(differ, ",")).alias("differing"))


def ledger_events(items: DataFrame, key: str, action: Column | str, ts: Column, actor: str = "system") -> DataFrame:
    """Rows to append to a ledger; the id is a digest of item, action and time."""
    act = action if isinstance(action, Column) else F.lit(action)
    out = items.select(F.col(key).cast("string").alias("evidence_id"), act.alias("action"), ts.alias("ts"), F.lit(actor).alias("actor"))
    return out.withColumn("event_id", F.sha2(F.concat_ws("|", "evidence_id", "action", F.col("ts").cast("string")).cast("binary"), 256))


def append_ledger(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def ledger_state(ledger: DataFrame) -> DataFrame:
    """Per item its number of events, the last action, and whether tampering was ever seen."""
    return ledger.groupBy("evidence_id").agg(F.count("*").alias("events"), F.max_by("action", F.struct("ts", "event_id")).alias("last_action"), F.bool_or(F.col("action") == "TAMPER_DETECTED").alias("tampered"))


def audit_map(states: DataFrame, case: str) -> DataFrame:
    """Per case a map from item to verified or not."""
    return states.groupBy(case).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("evidence_id"), ~F.col("tampered"))))).alias("audit"))
