"""Enrichment joins: addresses to ranges, providers and risk; hosts to protected names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.network import address, ip_number, is_private, is_private_address, is_tor, is_tor_address, prefix
from ..functions.text import transliterated

# Cloud providers, their networks and words of their names, first match wins.
PROVIDERS = [
    ("AWS", [16509, 14618, 7224, 38895, 19349], ["amazon", "aws"]),
    ("Microsoft Azure", [8075, 8068, 8069], ["microsoft", "azure"]),
    ("Google Cloud", [15169, 396982, 16591, 19527], ["google", "gcp"]),
    ("Cloudflare", [13335, 209242, 394536], ["cloudflare"]),
    ("DigitalOcean", [14061, 202053, 202109], ["digitalocean"]),
    ("Hetzner", [24940, 213230], ["hetzner"]),
    ("OVH", [16276, 35540], ["ovh"]),
    ("Oracle Cloud", [31898, 20473], ["oracle"]),
    ("Linode / Akamai", [63949, 20940, 16625], ["linode", "akamai"]),
    ("Alibaba Cloud", [37963, 45102], ["alibaba", "alicloud"]),
    ("Vultr", [20473, 64512], ["vultr", "choopa", "constant company"]),
]
VPN_NETWORKS = [9009, 212238, 8100, 47583, 51167, 62240]

# Names that look-alikes imitate most.
PROTECTED = ["microsoft.com", "office.com", "office365.com", "live.com", "google.com", "apple.com", "paypal.com", "amazon.com", "docusign.com", "docusign.net", "chase.com", "bankofamerica.com", "wellsfargo.com", "citi.com", "dropbox.com", "adobe.com", "github.com", "linkedin.com", "netflix.com", "zoom.us"]


# What is known of much seen public addresses without any source: address, country, network number, organisation.
OFFLINE = [
    ("8.8.8.8", "US", 15169, "Google LLC"), ("8.8.4.4", "US", 15169, "Google LLC"), ("1.1.1.1", "AU", 13335, "Cloudflare, Inc."),
    ("209.85.208.177", "US", 15169, "Google LLC"), ("209.85.208.1", "US", 15169, "Google LLC"),
]


def offline_intel(spark: SparkSession) -> DataFrame:
    """A last source for enriched_ips."""
    return spark.createDataFrame(OFFLINE, "ip string, country string, asn int, org string")


def cidr_ranges(cidrs: DataFrame, cidr: str = "cidr") -> DataFrame:
    """first and last address of IPv4 ranges, as longs."""
    bits = F.substring_index(cidr, "/", -1).try_cast("int")
    size = F.pow(F.lit(2.0), 32 - bits).cast("long")
    start = ip_number(F.substring_index(cidr, "/", 1))
    return cidrs.withColumn("first", start - start % size).withColumn("last", F.col("first") + size - 1)


def in_range(ips: DataFrame, ranges: DataFrame, number: str, keep: list[str], shift: int = 16) -> DataFrame:
    """ips with the columns of the narrowest range (first, last) that holds them, null if none does.

    Ranges are listed under each block of 2^shift addresses that they touch, so the join is on equal keys;
    ranges wider than 256 blocks are listed under blocks of 2^24. Distinct addresses are looked up once.
    """
    wide = (F.col("last") - F.col("first")) / (1 << shift) > 256
    listed = ranges.select(*keep, "first", "last", F.when(wide, 24).otherwise(shift).alias("_s"))
    listed = listed.withColumn("_block", F.explode(F.sequence(F.floor(F.col("first") / F.pow(F.lit(2.0), "_s")).cast("long"), F.floor(F.col("last") / F.pow(F.lit(2.0), "_s")).cast("long"))))
    once = ips.select(number).filter(F.col(number).isNotNull()).distinct()
    probes = once.withColumn("_s", F.explode(F.array(F.lit(shift), F.lit(24)))).withColumn("_block", F.floor(F.col(number) / F.pow(F.lit(2.0), "_s")).cast("long"))
    hits = probes.join(listed, ["_s", "_block"]).filter(F.col(number).between(F.col("first"), F.col("last")))
    best = hits.groupBy(number).agg(F.min_by(F.struct(*keep), F.struct((F.col("last") - F.col("first")).alias("w"), "first", *keep)).alias("_r"))
    return ips.join(best, number, "left").select(*ips.columns, *(F.col(f"_r.{c}").alias(c) for c in keep))


def networks(cidrs: DataFrame, cidr: str = "cidr") -> DataFrame:
    """bits (0 to 128; 96 more for IPv4) and prefix of networks of both versions; what is none is left out."""
    start, size = F.substring_index(cidr, "/", 1), F.substring_index(cidr, "/", -1).try_cast("int")
    four = ip_number(F.trim(start)).isNotNull()
    whole = F.when(four, 32).otherwise(128)
    bits = F.when(F.contains(cidr, F.lit("/")), size).otherwise(whole)
    found = cidrs.withColumn("_a", address(start)).withColumn("bits", F.when(bits.between(0, whole), bits + F.when(four, 96).otherwise(0)))
    return found.withColumn("prefix", prefix(F.col("_a"), F.col("bits"))).filter("prefix is not null").drop("_a")


def in_networks(ips: DataFrame, nets: DataFrame, ip: str, keep: list[str]) -> DataFrame:
    """ips of either version with the columns of the longest of nets (as networks gives them) that holds them, null if none does.

    One join on equal (bits, prefix), for each length of prefix that the networks have: 129 at most, whatever their number. Distinct
    addresses are looked up once.
    """
    lengths = sorted(r["bits"] for r in nets.select("bits").distinct().collect())
    found = ips.withColumn("_address", address(F.col(ip)))
    if not lengths:
        return found.drop("_address").select(*ips.columns, *(F.lit(None).cast(dict(nets.dtypes)[c]).alias(c) for c in keep))
    once = found.select("_address").filter("_address is not null").distinct()
    probes = once.withColumn("bits", F.explode(F.array(*map(F.lit, lengths)))).withColumn("prefix", prefix(F.col("_address"), F.col("bits")))
    best = probes.join(nets.select("bits", "prefix", *keep), ["bits", "prefix"]).groupBy("_address").agg(F.max_by(F.struct(*keep), F.struct("bits", *keep)).alias("_r"))
    return found.join(best, "_address", "left").select(*ips.columns, *(F.col(f"_r.{c}").alias(c) for c in keep))


def provider(asn: Column, org: Column) -> Column:
    """The first provider with this network number, or whose words are in the organisation's name."""
    out = F.lit(None).cast("string")
    for name, numbers, words in reversed(PROVIDERS):
        named = F.lower(F.coalesce(org, F.lit(""))).rlike("|".join(words))
        out = F.when(asn.isin(numbers) | named, name).otherwise(out)
    return out


def ip_risk(number: Column, asn: Column, org: Column) -> Column:
    """10 private, 85 Tor, 65 VPN, 45 cloud, else 35."""
    return F.when(is_private(number), 10).when(is_tor(number), 85).when(asn.isin(VPN_NETWORKS), 65).when(provider(asn, org).isNotNull(), 45).otherwise(35)


def address_risk(address_: Column, asn: Column, org: Column) -> Column:
    """ip_risk of addresses of either version, as network.address gives them."""
    return F.when(is_private_address(address_), 10).when(is_tor_address(address_), 85).when(asn.isin(VPN_NETWORKS), 65).when(provider(asn, org).isNotNull(), 45).otherwise(35)


def enriched_ips(ips: DataFrame, sources: list[DataFrame], ip: str = "ip", fields: tuple[str, ...] = ("country", "asn", "org")) -> DataFrame:
    """ips of either version with each field from the first source (ip, fields) that has it; private addresses take none."""
    once = ips.select(ip).distinct()
    for i, source in enumerate(sources):
        once = once.join(source.select(F.col("ip").alias(ip), *(F.col(f).alias(f"_{i}_{f}") for f in fields)), ip, "left")
    known = once.withColumn("_private", F.coalesce(is_private_address(address(F.col(ip))), F.lit(False)))
    known = known.select(ip, *(F.when(~F.col("_private"), F.coalesce(*(F.col(f"_{i}_{f}") for i in range(len(sources))))).alias(f) for f in fields))
    return ips.join(known, ip, "left")


def _shortened(label: Column) -> Column:
    """A label and all that is left of it after one or two letters go: two labels at most two edits apart share one of these."""
    cut = lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.length(x))))).otherwise(F.array().cast("array<string>"))
    once = F.transform(F.array(label), cut)[0]
    return F.array_distinct(F.concat(F.array(label), once, F.flatten(F.transform(once, cut))))


def lookalikes(names: DataFrame, protected: DataFrame, name: str = "name", best: bool = True) -> DataFrame:
    """Distinct names that imitate a protected one (target): HOMOGLYPH, TYPOSQUAT or COMBOSQUAT; the best match of each, or all.

    A protected name itself imitates none. Edits are counted between first labels, for targets of 4 letters or more. Pairs meet on equal
    keys: what is left of both after up to two letters go, a part of the name that is the target, or its Latin reading.
    """
    label = lambda c: F.substring_index(c, ".", 1)
    ours = protected.select(F.lower("target").alias("target")).distinct().withColumn("_target", label(F.col("target")))
    theirs = names.select(F.lower(name).alias(name)).distinct().withColumn("_label", label(F.col(name)))
    clean = theirs.join(ours, F.col(name) == F.col("target"), "left_anti")
    n = F.length("_label")
    inside = F.when(n > 4, F.flatten(F.transform(F.sequence(F.lit(1), n - 3), lambda i: F.transform(F.sequence(F.lit(4), n - i + 1), lambda k: F.col("_label").substr(i, k))))).otherwise(F.array().cast("array<string>"))
    left = clean.withColumn("_key", F.explode(F.array_distinct(F.concat(_shortened(F.col("_label")), inside, F.array(transliterated(F.col("_label")))))))
    right = ours.withColumn("_key", F.explode(_shortened(F.col("_target"))))
    pairs = left.join(right, "_key").select(name, "_label", "target", "_target").distinct()
    edits = F.levenshtein("_label", "_target", 2)
    kind = (
        F.when((transliterated(F.col("_label")) == F.col("_target")) & (F.col("_label") != F.col("_target")), "HOMOGLYPH")
        .when((F.length("_target") >= 4) & edits.between(1, 2), "TYPOSQUAT")
        .when((F.length("_target") >= 4) & F.contains(F.col("_label"), F.col("_target")) & (F.col("_label") != F.col("_target")), "COMBOSQUAT")
    )
    found = pairs.withColumns({"kind": kind, "similarity": F.round(1 - F.levenshtein("_label", "_target") / F.greatest(F.length("_label"), F.length("_target")), 4)}).filter("kind is not null")
    if not best:
        return found.select(name, "target", "kind", "similarity")
    rank = F.when(F.col("kind") == "HOMOGLYPH", 0).when(F.col("kind") == "TYPOSQUAT", 1).otherwise(2)
    first = F.row_number().over(Window.partitionBy(name).orderBy(rank, F.desc("similarity"), "target"))
    return found.withColumn("_n", first).filter("_n = 1").select(name, "target", "kind", "similarity")


def vendors(mx: DataFrame, patterns: DataFrame) -> DataFrame:
    """mx (name, mx) with the vendor whose wildcard pattern (vendor, pattern) fits first, by pattern.

    A pattern's last labels without a wildcard must end the host: pairs meet on them, then the whole pattern is checked. Patterns without
    such labels meet every host under an empty end.
    """
    p = patterns.select("vendor", F.lower("pattern").alias("pattern")).withColumn("_end", F.regexp_replace(F.regexp_extract("pattern", r"(?:^|\.)([^*]*)$", 1), r"^\.", ""))
    like = F.concat(F.lit("^"), F.replace(F.replace("pattern", F.lit("."), F.lit("\\.")), F.lit("*"), F.lit(".*")), F.lit("$"))
    labels = F.split("mx", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = mx.select(F.lower("mx").alias("mx")).distinct().withColumn("_end", F.explode(F.array_append(ends, F.lit(""))))
    hits = hosts.join(p.withColumn("_like", like), "_end").filter(F.expr("mx rlike _like")).groupBy("mx").agg(F.min_by("vendor", "pattern").alias("vendor"))
    return mx.withColumn("mx", F.lower("mx")).join(hits, "mx", "left")
