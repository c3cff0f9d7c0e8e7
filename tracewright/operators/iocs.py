"""Indicators in text: extraction, context, severity, dedup and correlation across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import matches
from ..functions.network import ip_number
from ..functions.text import decoded_wide

# Patterns of each kind of indicator, and its risk.
PATTERNS = {
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "ipv6": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:[0-9a-fA-F]{1,4}\b",
    "url": r"\b(?i:https?|ftp|wss?)://[^\s\"'<>\\]+",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "btc_legacy": r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b",
    "btc_bech32": r"\bbc1[a-zA-HJ-NP-Z0-9]{25,39}\b",
    "eth": r"\b0x[a-fA-F0-9]{40}\b",
    "jwt": r"\beyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\b",
    "private_key": r"(?i)-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----",
    "base64_executable": r"\b(?:TVqQAA[A-Za-z0-9+/=]{20,}|TVpQAA[A-Za-z0-9+/=]{20,})\b",
    "md5": r"\b[a-fA-F0-9]{32}\b",
    "sha1": r"\b[a-fA-F0-9]{40}\b",
    "sha256": r"\b[a-fA-F0-9]{64}\b",
}
RISKS = {"ipv4": 30, "ipv6": 30, "url": 40, "email": 20, "btc_legacy": 70, "btc_bech32": 70, "eth": 70, "jwt": 80, "private_key": 90, "base64_executable": 95, "md5": 20, "sha1": 20, "sha256": 20}

ENCODED_COMMAND = r"(?i)(?:-enc|-encodedcommand|-e)\s+([A-Za-z0-9+/=]{8,})"


def extract(df: DataFrame, text: str, keep: list[str], kinds: list[str] | None = None) -> DataFrame:
    """keep, ioc_type, value: every match, addresses only where they are valid."""
    value = F.coalesce(F.col(text), F.lit(""))
    one = lambda k: F.transform(F.regexp_extract_all(value, F.lit(PATTERNS[k]), F.lit(0)), lambda v: F.struct(F.lit(k).alias("ioc_type"), v.alias("value")))
    found = df.select(*keep, F.inline(F.concat(*map(one, kinds or PATTERNS))))
    return found.filter((F.col("ioc_type") != "ipv4") | ip_number(F.col("value")).isNotNull())


def with_context(df: DataFrame, text: str, pattern: str, around: int = 40) -> DataFrame:
    """df with value and context: each match of the pattern, and it with up to so many characters on both sides, in one line, without outer blanks. Neighbours share characters."""
    found = df.withColumn("_m", F.explode(matches(F.col(text), pattern)))
    begin = F.greatest(F.col("_m.start") - around, F.lit(0))
    size = F.col("_m.start") - begin + F.length("_m.value") + around
    line = F.trim(F.translate(F.substring(F.col(text), begin + 1, size), "\r\n", "  "))
    return found.withColumns({"value": F.col("_m.value"), "context": line}).drop("_m")


def risk(ioc_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in RISKS.items() for x in p)), ioc_type), F.lit(20))


def level(score: Column) -> Column:
    return F.when(score >= 90, "CRITICAL").when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def decoded_commands(df: DataFrame, text: str) -> DataFrame:
    """command: the text of encoded PowerShell arguments."""
    out = df.withColumn("encoded", F.explode(F.regexp_extract_all(F.col(text), F.lit(ENCODED_COMMAND), F.lit(1))))
    return out.withColumn("command", decoded_wide(F.col("encoded")))


def jwt_claims(token: Column) -> Column:
    """The claims of a JSON web token, its middle part, as JSON text; null where it is none."""
    middle = F.translate(F.get(F.split(token, r"\."), F.lit(1)), "-_", "+/")
    padded = F.rpad(middle, (F.ceil(F.length(middle) / 4) * 4).cast("int"), F.lit("="))
    claims = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(F.get_json_object(claims, "$").isNotNull(), claims)


def deduplicated(iocs: DataFrame, order: list[str], key: list[str] | None = None) -> DataFrame:
    """The first row, by order, of each kind and value; values without case and outer blanks."""
    norm = F.lower(F.trim("value"))
    w = Window.partitionBy(*(key or []), "ioc_type", norm).orderBy(*order)
    return iocs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def shared(iocs: DataFrame, item: str, least: int = 2, shortest: int = 4, shown: int = 20) -> DataFrame:
    """Values of at least four characters seen in at least two items, with the first `shown` items (their number counts all). One aggregation, no self-join; shared_rows has every item."""
    value = F.lower(F.trim("value"))
    each = iocs.withColumn("value", value).filter(F.length("value") >= shortest).groupBy("ioc_type", "value", item).agg(F.count("*").alias("n"))
    each = each.withColumn("_n", F.row_number().over(Window.partitionBy("ioc_type", "value").orderBy(item))).withColumn("_shown", F.when(F.col("_n") <= shown, F.col(item)))
    listed = F.array_join(F.sort_array(F.collect_list("_shown")), ",")
    return each.groupBy("ioc_type", "value").agg(F.count(item).alias("items"), F.sum("n").alias("sightings"), listed.alias("seen_in")).filter(F.col("items") >= least)


def shared_rows(iocs: DataFrame, item: str, least: int = 2, shortest: int = 4) -> DataFrame:
    """ioc_type, value, item, sightings of shared values: a row an item, however many have one."""
    each = iocs.withColumn("value", F.lower(F.trim("value"))).filter(F.length("value") >= shortest).groupBy("ioc_type", "value", item).agg(F.count("*").alias("sightings"))
    many = each.groupBy("ioc_type", "value").agg(F.count(item).alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return each.join(many, ["ioc_type", "value"], "left_semi")


def from_alerts(alerts: DataFrame) -> DataFrame:
    """Labelled indicators of alerts (actor, target, source_ip): USER:, TARGET: and IP: values, each once."""
    one = lambda c, label: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(label), F.col(c)))
    found = F.filter(F.array(one("actor", "USER:"), one("target", "TARGET:"), one("source_ip", "IP:")), lambda x: x.isNotNull())
    return alerts.select(F.explode(found).alias("indicator")).distinct()
