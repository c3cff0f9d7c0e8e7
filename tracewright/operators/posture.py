"""Mail posture of domains, from their DNS records: SPF, DMARC, BIMI and DKIM texts, categories and a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domains import registered_domain, tld
from ..functions.suffixes import SuffixRules
from .messages import DISPOSABLE, FREEMAIL, dkim_tags

# Beginnings of SPF terms that ask the DNS, the most of them that are allowed, and strictness by the first sign of `all`.
LOOKUP_TERMS = ["include:", "a", "mx", "ptr", "exists:", "redirect="]
MOST_LOOKUPS = 10
STRICTNESS = {"-": "STRICT", "~": "SOFTFAIL", "+": "PERMISSIVE", "a": "PERMISSIVE", "?": "NEUTRAL"}

# Suffixes of public bodies and schools.
PUBLIC_SUFFIXES = ["gov", "mil", "edu", "ac.uk", "gov.uk"]


def spf(records: Column) -> dict[str, Column]:
    """strictness, lookups, too_many and validity of a name's SPF texts (array); the first counts, more than one are invalid."""
    terms = F.filter(F.split(F.lower(F.get(records, F.lit(0))), r"\s+"), lambda t: t != "")
    last = F.get(F.filter(terms, lambda t: F.endswith(t, F.lit("all"))), F.lit(0))
    sign = F.substring(last, 1, 1)
    strictness = F.lit("NEUTRAL")
    for s, name in STRICTNESS.items():
        strictness = F.when(sign == s, name).otherwise(strictness)
    lookups = F.size(F.filter(terms, lambda t: F.exists(F.array(*map(F.lit, LOOKUP_TERMS)), lambda p: F.startswith(t, p))))
    n = F.size(records)
    lookups = F.when(n > 0, lookups).otherwise(0)
    return {
        "strictness": F.when(n == 0, "MISSING").when(n > 1, "INVALID").otherwise(strictness), "lookups": lookups, "too_many": lookups > MOST_LOOKUPS, "valid": (n == 1) & (strictness != "PERMISSIVE"),
    }


def dmarc(records: Column) -> dict[str, Column]:
    """policy, subdomain policy, percentage, whether reports are asked for, and enforcement of a name's DMARC texts."""
    tags = dkim_tags(F.get(records, F.lit(0)))
    policy = F.lower(F.coalesce(tags["p"], F.lit("none")))
    missing = F.size(records) == 0
    return {
        "policy": F.when(missing, "missing").otherwise(policy), "subdomain_policy": F.lower(tags["sp"]), "percentage": F.coalesce(tags["pct"].try_cast("int"), F.lit(100)), "reports": F.coalesce(F.length(tags["rua"]) > 0, F.lit(False)),
        "enforcement": F.when(missing, "MISSING").when(policy == "reject", "REJECT").when(policy == "quarantine", "QUARANTINE").otherwise("NONE"),
    }


def bimi(records: Column) -> dict[str, Column]:
    """logo and whether a certificate is named by a name's BIMI texts."""
    tags = dkim_tags(F.get(records, F.lit(0)))
    return {"logo": F.nullif(tags["l"], F.lit("")), "certified": F.coalesce(F.startswith(tags["a"], F.lit("https://")), F.lit(False))}


def dkim_key(record: Column) -> dict[str, Column]:
    """Key type, preview and validity of a DKIM record."""
    tags = dkim_tags(record)
    key = F.coalesce(tags["p"], F.lit(""))
    return {"key_type": F.lower(F.coalesce(tags["k"], F.lit("rsa"))), "preview": F.when(F.length(key) > 24, F.concat(F.substring(key, 1, 16), F.lit("..."), F.right(key, F.lit(8)))).otherwise(key), "valid": key != ""}


def category(name: Column, lookalike: Column, has_mx: Column, has_address: Column, suffixes: SuffixRules | None = None) -> Column:
    apex = registered_domain(name, suffixes)
    public = tld(name).isin(PUBLIC_SUFFIXES) | F.substring_index(name, ".", -2).isin(PUBLIC_SUFFIXES)
    return F.when(lookalike, "LOOKALIKE").when(apex.isin(DISPOSABLE), "DISPOSABLE").when(apex.isin(FREEMAIL), "FREEMAIL").when(public, "GOVERNMENT_EDU").when(~has_mx & ~has_address, "UNRESOLVED").otherwise("CORPORATE")


def assessed(domains: DataFrame, suffixes: SuffixRules | None = None) -> DataFrame:
    """Category, score and tier of names (as logs.posture gives them) with brand_risk (CRITICAL, HIGH_RISK or null) and is_email (whether an address was asked for).

    Points: brand 55 or 35, disposable 40, SPF missing 15, permissive 25 or neutral 10, DMARC missing 20 or none 10, no MX for an address 15, unresolved 20.
    """
    s, d = spf(F.col("spf")), dmarc(F.col("dmarc"))
    has_mx = F.size("mx") > 0
    out = domains.withColumns({"spf_strictness": s["strictness"], "spf_lookups": s["lookups"], "dmarc_enforcement": d["enforcement"], "has_mx": has_mx})
    out = out.withColumn("category", category(F.col("name"), F.col("brand_risk").isNotNull(), F.col("has_mx"), F.col("addresses") > 0, suffixes))
    points = lambda *cases: sum((F.when(c, p).otherwise(0) for c, p in cases[1:]), F.when(cases[0][0], cases[0][1]).otherwise(0))
    score = points(
        (F.coalesce(F.col("brand_risk") == "CRITICAL", F.lit(False)), 55), (F.coalesce(F.col("brand_risk") == "HIGH_RISK", F.lit(False)), 35), (registered_domain(F.col("name"), suffixes).isin(DISPOSABLE), 40),
        (F.col("spf_strictness") == "MISSING", 15), (F.col("spf_strictness") == "PERMISSIVE", 25), (F.col("spf_strictness") == "NEUTRAL", 10), (F.col("dmarc_enforcement") == "MISSING", 20), (F.col("dmarc_enforcement") == "NONE", 10),
        (~F.col("has_mx") & F.col("is_email"), 15), (F.col("category") == "UNRESOLVED", 20),
    )
    out = out.withColumn("score", F.least(F.lit(100), score))
    n = F.col("score")
    return out.withColumn("tier", F.when(n >= 75, "CRITICAL").when(n >= 50, "HIGH").when(n >= 25, "MEDIUM").when(n > 5, "LOW").otherwise("CLEAN"))
