"""Exports: JSON, CSV ledgers, STIX bundles, payload tables. All write through Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.files import safe_name

LEDGER = ["case_id", "item_id", "ioc_type", "value", "severity", "category", "description", "first_seen", "source"]


def write_json(df: DataFrame, path: str) -> None:
    """Binary columns as base64, timestamps as ISO 8601."""
    df.select(*(F.base64(c).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes)).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def write_ledger(iocs: DataFrame, path: str) -> None:
    have = iocs.columns
    iocs.select(*(F.col(c).cast("string") if c in have else F.lit(None).cast("string").alias(c) for c in LEDGER)).write.option("header", True).option("quoteAll", True).csv(path)


def payload_name(index: Column, filename: Column) -> Column:
    """A safe name with the part's index before it, so two parts of one name don't meet."""
    return F.concat_ws("_", F.lpad(index.cast("string"), 3, "0"), safe_name(F.coalesce(filename, F.lit("unnamed"))))


def write_payloads(parts: DataFrame, path: str, case: str = "case_id") -> None:
    """Attachment contents apart from their metadata under safe names (stored_as, from index and filename), partitioned by case; no file per attachment."""
    parts.withColumn("stored_as", payload_name(F.col("index"), F.col("filename"))).write.partitionBy(case).parquet(path)


def stix_pattern(ioc_type: Column, value: Column) -> Column:
    """STIX comparison of an indicator; quotes and backslashes in the value are escaped."""
    quoted = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    path = (
        F.when(ioc_type == "ipv4", "ipv4-addr:value").when(ioc_type == "ipv6", "ipv6-addr:value").when(ioc_type == "url", "url:value").when(ioc_type == "email", "email-addr:value").when(ioc_type == "domain", "domain-name:value")
        .when(ioc_type == "md5", "file:hashes.MD5").when(ioc_type == "sha1", "file:hashes.'SHA-1'").when(ioc_type == "sha256", "file:hashes.'SHA-256'").otherwise("artifact:payload_bin")
    )
    return F.concat(F.lit("["), path, F.lit(" = '"), quoted, F.lit("']"))


def _uuid(text: Column) -> Column:
    digest = F.sha2(text.cast("binary"), 256)
    return F.concat_ws("-", digest.substr(1, 8), digest.substr(9, 4), F.concat(F.lit("5"), digest.substr(14, 3)), F.concat(F.lit("8"), digest.substr(18, 3)), digest.substr(21, 12))


def stix_indicators(iocs: DataFrame, created: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """id and JSON object of each indicator; ids are digests of kind and value, so reruns agree."""
    ident = F.concat(F.lit("indicator--"), _uuid(F.concat_ws("|", "ioc_type", "value")))
    pattern = stix_pattern(F.col("ioc_type"), F.col("value"))
    body = F.struct(F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), ident.alias("id"), F.lit(created).alias("created"), F.lit(created).alias("modified"), pattern.alias("pattern"), F.lit("stix").alias("pattern_type"), F.lit(created).alias("valid_from"))
    return iocs.withColumns({"stix_id": ident, "pattern": pattern, "object": F.to_json(body)})


def stix_attack_patterns(matrix: DataFrame) -> DataFrame:
    """Attack-pattern objects of a tactic matrix (tactic, techniques as comma-joined text), one a technique and tactic."""
    each = matrix.select("tactic", F.explode(F.split("techniques", ",")).alias("technique")).distinct()
    ident = F.concat(F.lit("attack-pattern--"), _uuid(F.concat_ws("|", "technique", "tactic")))
    refs = F.array(F.struct(F.lit("mitre-attack").alias("source_name"), F.col("technique").alias("external_id")))
    name = F.concat(F.lit("ATT&CK "), "technique", F.lit(" ("), "tactic", F.lit(")"))
    return each.withColumns({"stix_id": ident, "object": F.to_json(F.struct(F.lit("attack-pattern").alias("type"), F.lit("2.1").alias("spec_version"), ident.alias("id"), name.alias("name"), refs.alias("external_references")))})


def stix_bundles(indicators: DataFrame, case: str, per_bundle: int = 10_000) -> DataFrame:
    """Bundles of a case's objects (object), at most so many in one, as JSON text."""
    n = F.pmod(F.xxhash64("object"), F.greatest(F.lit(1), F.ceil(F.col("_n") / per_bundle)))
    sized = indicators.join(indicators.groupBy(case).agg(F.count("*").alias("_n")), case).withColumn("bundle", n)
    listed = F.array_join(F.sort_array(F.collect_set("object")), ",")
    return sized.groupBy(case, "bundle").agg(F.concat(F.lit('{"type":"bundle","objects":['), listed, F.lit("]}")).alias("json"))


def message_ledger(hops: DataFrame, messages: DataFrame, urls: DataFrame, parts: DataFrame, indicators: DataFrame, blobs: DataFrame, key: str = "message_key") -> DataFrame:
    """Indicators of messages in one ledger (key, ioc_type, value, severity, category): relay addresses, mail addresses, links, digests, fraud indicators, hidden blobs."""
    row = lambda df, kind, value, severity, category: df.select(key, F.lit(kind).alias("ioc_type"), value.alias("value"), severity.alias("severity"), F.lit(category).alias("category")).filter("value is not null and value <> ''")
    low, high = F.lit("LOW"), F.lit("HIGH")
    digest = F.sha2(F.col("content"), 256)
    selects = [
        row(hops, "ipv4", F.col("from_ip"), low, "relay"), row(messages, "email", F.lower("from_address"), low, "sender"), row(messages, "email", F.lower("reply_to"), low, "reply"),
        row(urls, "url", F.col("url"), F.when(F.col("score") >= 60, "HIGH").when(F.col("score") >= 20, "MEDIUM").otherwise("LOW"), "link"),
        row(parts.filter("is_attachment"), "sha256", digest, F.lit("MEDIUM"), "attachment"), row(indicators, "indicator", F.col("indicator"), high, "fraud"), row(blobs, "blob", F.col("evidence"), F.lit("MEDIUM"), "hidden"),
    ]
    out = selects[0]
    for df in selects[1:]:
        out = out.unionByName(df)
    return out.distinct()
