"""Mail messages: headers, authentication, sender fraud, links, attachments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domains import host, registered_domain, url_flags
from ..functions.maps import first_of_each
from ..functions.suffixes import SuffixRules
from ..functions.text import ZERO_WIDTH
from . import rules

# Free and throw-away mail domains.
FREEMAIL = ["gmail.com", "googlemail.com", "yahoo.com", "ymail.com", "rocketmail.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "icloud.com", "me.com", "mac.com", "aol.com", "mail.com", "zoho.com", "protonmail.com", "proton.me", "yandex.com", "yandex.ru", "mail.ru", "gmx.com", "gmx.net", "fastmail.com", "tutanota.com", "tutamail.com"]
DISPOSABLE = ["tempmail.com", "temp-mail.org", "mailinator.com", "10minutemail.com", "guerrillamail.com", "guerrillamail.net", "trashmail.com", "sharklasers.com", "throwawaymail.com", "yopmail.com", "getairmail.com", "dispostable.com", "maildrop.cc"]
TITLES = ["ceo", "chief executive officer", "cfo", "chief financial officer", "coo", "chief operating officer", "cio", "cto", "chief technology officer", "ciso", "president", "managing director", "executive director", "vice president", "general counsel", "payroll director", "payroll department", "human resources director", "hr department", "accounts payable"]

# Points of sender-fraud indicators.
FRAUD_POINTS = {"VIP_IMPERSONATION": 50, "DISPLAY_NAME_EMBEDDED_EMAIL_SPOOF": 50, "COUSIN_DOMAIN_TYPOSQUAT": 45, "REPLY_TO_DOMAIN_MISMATCH": 40, "BRAND_DISPLAY_NAME_SPOOF": 30, "COUSIN_DOMAIN_COMBOSQUAT": 30, "DISPOSABLE_EMAIL_DOMAIN": 25, "EXECUTIVE_TITLE_FREEMAIL_SPOOF": 25, "BEC_URGENCY_KEYWORDS": 20, "FREEMAIL_BRAND_MISMATCH": 20, "RETURN_PATH_MISMATCH": 10}
HARD_FLAGS = ["VIP_IMPERSONATION", "COUSIN_DOMAIN_TYPOSQUAT", "DISPLAY_NAME_EMBEDDED_EMAIL_SPOOF"]

# File endings that run, and those with macros.
DANGEROUS = ["exe", "scr", "bat", "cmd", "com", "pif", "vbs", "vbe", "js", "jse", "wsf", "wsh", "ps1", "psm1", "hta", "msi", "jar", "lnk", "iso", "img", "dll", "cpl", "reg"]
MACRO = ["docm", "dotm", "xlsm", "xltm", "xlam", "pptm", "potm", "ppam", "ppsm"]


def header_groups(headers: Column) -> dict[str, Column]:
    """Headers (array of struct<pos, name, value>) by kind. received, arc and x- are exclusive; authentication and DKIM ones also stand with the rest."""
    name = lambda h: F.lower(h["name"])
    exclusive = lambda h: (name(h) == "received") | name(h).startswith("arc-") | name(h).startswith("x-")
    return {
        "received": F.filter(headers, lambda h: name(h) == "received"),
        "auth": F.filter(headers, lambda h: name(h).isin("authentication-results", "received-spf")),
        "dkim": F.filter(headers, lambda h: name(h) == "dkim-signature"),
        "arc": F.filter(headers, lambda h: name(h).startswith("arc-")),
        "x": F.filter(headers, lambda h: name(h).startswith("x-")),
        "standard": F.filter(headers, lambda h: ~exclusive(h)),
    }


def header(headers: Column, wanted: str) -> Column:
    """Value of the first header of this name."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == wanted.lower()), F.lit(0))["value"]


def address_domain(address: Column) -> Column:
    inner = F.regexp_extract(address, r"<([^<>]*)>", 1)
    return F.lower(F.trim(F.substring_index(F.when(inner != "", inner).otherwise(address), "@", -1)))


def authentication(results: Column) -> dict[str, Column]:
    """spf, dkim, dmarc and arc verdicts, and the DMARC policy as p= or policy=."""
    verdict = lambda m: F.nullif(F.lower(F.regexp_extract(results, rf"(?i)\b{m}=(pass|fail|softfail|neutral|none|temperror|permerror)\b", 1)), F.lit(""))
    return {m: verdict(m) for m in ("spf", "dkim", "dmarc", "arc")} | {"policy": F.nullif(F.lower(F.regexp_extract(results, r"(?i)\b(?:p|policy)=(none|quarantine|reject)\b", 1)), F.lit(""))}


def dkim_tags(signature: Column) -> Column:
    """Tags of a DKIM signature or a DMARC, BIMI or DKIM record, names trimmed; of a tag that comes twice the first."""
    pairs = F.filter(F.split(signature, ";"), lambda p: F.contains(p, F.lit("=")))
    return first_of_each(F.transform(pairs, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("k"), F.trim(F.regexp_extract(p, r"(?s)=(.*)$", 1)).alias("v"))))


def dkim_times(tags: Column) -> dict[str, Column]:
    """Signing and expiry time of a DKIM signature's tags (t=, x=, seconds since 1970)."""
    return {"signed": F.timestamp_seconds(tags["t"].try_cast("bigint")), "expires": F.timestamp_seconds(tags["x"].try_cast("bigint"))}


def auth_flags(spf: Column, dkim: Column, dmarc_: Column, spf_aligned: Column, dkim_aligned: Column) -> Column:
    """Flags of a message's authentication, DMARC's first. dkim: fail if any signature fails."""
    none = lambda c: F.coalesce(c, F.lit("none")) == "none"
    failed = dmarc_ == "fail"
    nothing = none(spf) & none(dkim) & none(dmarc_)
    passed = (spf == "pass") | (dkim == "pass")
    found = F.array(
        F.when(nothing, "NO_AUTH_HEADERS_FOUND"), F.when(failed, "SPOOFING_CRITICAL_DMARC_FAILED").when(dmarc_ == "pass", "DMARC_PASSED"),
        F.when(spf == "fail", "SPF_HARD_FAIL").when(spf == "softfail", "SPF_SOFT_FAIL").when(spf == "pass", "SPF_PASSED"), F.when(dkim == "fail", "DKIM_SIGNATURE_VERIFICATION_FAILED").when(dkim == "pass", "DKIM_PASSED"),
        F.when(failed & spf.isNotNull() & ~F.coalesce(spf_aligned, F.lit(False)), "SPF_ALIGNMENT_MISMATCH"), F.when(failed & dkim.isNotNull() & ~F.coalesce(dkim_aligned, F.lit(False)), "DKIM_ALIGNMENT_MISMATCH"),
        F.when(~F.coalesce(dmarc_.isin("pass", "fail"), F.lit(False)) & (spf == "pass") & (dkim == "pass"), "SPF_AND_DKIM_PASSED"),
        F.when(~nothing & ~F.coalesce(dmarc_.isin("pass", "fail") | passed, F.coalesce(passed, F.lit(False))), "UNVERIFIED_SENDER_AUTHENTICATION"),
    )
    return F.array_compact(found)


def aligned(domain: Column, sender: Column, strict: bool = False, suffixes: SuffixRules | None = None) -> Column:
    return domain == sender if strict else registered_domain(domain, suffixes) == registered_domain(sender, suffixes)


def dmarc(auth: DataFrame, signatures: DataFrame, key: str = "message_key", suffixes: SuffixRules | None = None) -> DataFrame:
    """dmarc_pass per message: SPF passes aligned, or any DKIM signature does. auth: from_domain, spf, spf_domain; signatures: domain, result."""
    base = auth.select(key, "from_domain", ((F.col("spf") == "pass") & aligned(F.col("spf_domain"), F.col("from_domain"), suffixes=suffixes)).alias("_spf"))
    signed = base.join(signatures, key, "left").groupBy(key).agg(F.first("_spf").alias("_spf"), F.bool_or((F.col("result") == "pass") & aligned(F.col("domain"), F.col("from_domain"), suffixes=suffixes)).alias("_dkim"))
    return signed.select(key, (F.coalesce("_spf", F.lit(False)) | F.coalesce("_dkim", F.lit(False))).alias("dmarc_pass"))


def joined_signatures(signatures: DataFrame, results: DataFrame, key: str = "message_key") -> DataFrame:
    """Signatures (domain, selector) with the result for their domain and selector, or for the domain alone; results without a signature follow."""
    r = results.select(F.col(key).alias("_k"), F.col("domain").alias("_d"), F.col("selector").alias("_s"), "result")
    on = (F.col(key) == F.col("_k")) & (F.col("domain") == F.col("_d")) & ((F.col("selector") == F.col("_s")) | F.col("_s").isNull() | (F.col("_s") == ""))
    met = signatures.join(r, on, "left").drop("_k", "_d", "_s")
    alone = results.join(signatures.select(key, "domain").distinct(), [key, "domain"], "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


def auth_verdict(spf: Column, dkim: Column, dmarc_: Column) -> Column:
    return F.when(dmarc_ == "fail", "FAIL").when((spf == "fail") & (F.coalesce(dkim, F.lit("none")) != "pass"), "FAIL").when((dmarc_ == "pass") | ((spf == "pass") & (dkim == "pass")), "PASS").when(spf.isin("softfail", "neutral") | dkim.isin("fail", "neutral"), "SUSPICIOUS").otherwise("NONE")


def spf_record(txt: Column) -> dict[str, Column]:
    """Policy of `all`, number of lookups and whether they exceed ten."""
    terms = F.split(F.lower(F.trim(txt)), r"\s+")
    lookups = F.size(F.filter(terms, lambda t: t.rlike(r"^[+?~-]?(include:|a$|a[:/]|mx$|mx[:/]|ptr|exists:)|^redirect=")))
    final = F.get(F.filter(terms, lambda t: t.rlike(r"^[+?~-]?all$")), F.lit(0))
    return {"is_spf": F.lower(F.trim(txt)).startswith("v=spf1"), "all": final, "lookups": lookups, "too_many": lookups > 10}


def links(messages: DataFrame, key: str, html: str, text: str) -> DataFrame:
    """url, origin, anchor: from href, src and action attributes, and from plain text."""
    pair = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"'][^>]*>.*?</a>"), F.lit(0))
    anchors = F.transform(pair, lambda p: F.struct(F.regexp_extract(p, r"(?is)\bhref\s*=\s*[\"']([^\"']+)", 1).alias("url"), F.lit("a").alias("origin"), F.trim(F.regexp_replace(p, r"(?s)<[^>]*>", "")).alias("anchor")))
    none = F.lit(None).cast("string")
    other = lambda attr, origin: F.transform(F.regexp_extract_all(F.col(html), F.lit(rf"(?is)<(?:form|img|iframe)\b[^>]*?\b{attr}\s*=\s*[\"']([^\"']+)"), F.lit(1)), lambda u: F.struct(u.alias("url"), F.lit(origin).alias("origin"), none.alias("anchor")))
    plain = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"(?i)\b(?:https?|ftp)://[^\s\"'<>]+"), F.lit(0)), lambda u: F.struct(F.regexp_replace(u, r"[.,;:!?)\]}]+$", "").alias("url"), F.lit("text").alias("origin"), none.alias("anchor")))
    found = messages.select(key, F.inline(F.concat(*(F.coalesce(x, F.array().cast("array<struct<url:string,origin:string,anchor:string>>")) for x in (anchors, other("src", "src"), other("action", "action"), plain)))))
    return found.filter(~F.col("url").rlike(r"(?i)^(mailto|tel|javascript|data|cid|#|about):?")).distinct()


def header_links(headers: DataFrame, key: str) -> DataFrame:
    """url, origin of links in unsubscribe, archive, help and other headers (key, name, value)."""
    found = F.regexp_extract_all("value", F.lit(r"(?i)\b(?:https?|ftp)://[^\s\"'<>]+"), F.lit(0))
    return headers.select(key, F.explode(found).alias("url"), F.concat(F.lit("header:"), F.lower("name")).alias("origin")).distinct()


def anchor_mismatch(url: Column, anchor: Column, suffixes: SuffixRules | None = None) -> Column:
    """The anchor's text names a host whose registered domain is not the link's."""
    shown = F.lower(F.regexp_extract(anchor, r"(?i)\b(?:https?://)?((?:[a-z0-9-]+\.)+[a-z]{2,})\b", 1))
    return (shown != "") & (registered_domain(shown, suffixes) != registered_domain(host(url), suffixes))


def link_report(urls: DataFrame, key: str, suffixes: SuffixRules | None = None) -> DataFrame:
    """Per message: links, domains, flags and verdict from urls (url, anchor)."""
    flags = F.filter(F.array(*(F.when(c, n) for n, _, c in url_flags(F.col("url"), suffixes)), F.when(F.coalesce(anchor_mismatch(F.col("url"), F.col("anchor"), suffixes), F.lit(False)), "ANCHOR_URL_MISMATCH")), lambda x: x.isNotNull())
    points = reduce(lambda a, b: a + b, (F.when(c, p).otherwise(0) for _, p, c in url_flags(F.col("url"), suffixes)), F.when(F.coalesce(anchor_mismatch(F.col("url"), F.col("anchor"), suffixes), F.lit(False)), 40).otherwise(0))
    one = urls.withColumns({"flags": flags, "points": F.least(F.lit(100), points), "domain": registered_domain(host(F.col("url")), suffixes)})
    out = one.groupBy(key).agg(F.count("*").alias("links"), F.countDistinct("domain").alias("domains"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("flags")))).alias("flags"), F.max("points").alias("score"))
    return out.withColumn("verdict", F.when(F.col("score") >= 60, "MALICIOUS").when(F.col("score") >= 20, "SUSPICIOUS").otherwise("CLEAN"))


def sender_indicators(messages: DataFrame, key: str, executives: DataFrame | None = None, brands: DataFrame | None = None, suffixes: SuffixRules | None = None) -> DataFrame:
    """indicator rows of messages (display_name, from_address, reply_to, return_path, subject, body). executives: name, address; brands: word, domain."""
    name, sender = F.lower(F.coalesce("display_name", F.lit(""))), registered_domain(address_domain(F.col("from_address")), suffixes)
    reply, back = (registered_domain(address_domain(F.col(c)), suffixes) for c in ("reply_to", "return_path"))
    inside = F.lower(F.regexp_extract(F.col("display_name"), r"([\w.+-]+@[\w-]+\.[\w.]+)", 1))
    title = name.rlike(r"\b(" + "|".join(TITLES) + r")\b")
    body = F.concat_ws(" ", "subject", "body")
    urgent = reduce(lambda a, b: a | b, (body.rlike(p) for _, _, _, _, ps in rules.FRAUD_WORDING for p in ps))
    checks = {
        "REPLY_TO_DOMAIN_MISMATCH": reply != sender, "RETURN_PATH_MISMATCH": back != sender, "DISPOSABLE_EMAIL_DOMAIN": sender.isin(DISPOSABLE),
        "DISPLAY_NAME_EMBEDDED_EMAIL_SPOOF": (inside != "") & (registered_domain(address_domain(inside), suffixes) != sender),
        "EXECUTIVE_TITLE_FREEMAIL_SPOOF": title & sender.isin(FREEMAIL), "BEC_URGENCY_KEYWORDS": urgent,
    }
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks.items())), lambda x: x.isNotNull())
    out = messages.select(key, F.explode(found).alias("indicator"))
    people = messages.select(key, name.alias("_name"), F.lower("from_address").alias("_from"), sender.alias("_sender"))
    if executives is not None:
        who = executives.select(F.lower("name").alias("_vip"), F.lower("address").alias("_official")).filter("_vip <> ''")
        names = people.filter("_name <> ''").select("_name").distinct()
        # One holds the other only if it holds the other's first three letters: both ways are joins on equal letters, once a name.
        inner = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.col(c).substr(i, n))))))
        a = names.withColumn("_g", inner("_name")).join(who.withColumn("_g", F.substring("_vip", 1, 3)), "_g").filter(F.contains("_name", "_vip"))
        b = names.withColumn("_g", F.substring("_name", 1, 3)).join(who.withColumn("_g", inner("_vip")), "_g").filter(F.contains("_vip", "_name"))
        pairs = a.unionByName(b).select("_name", "_official").distinct()
        met = people.join(pairs, "_name").filter(~F.contains("_from", "_official"))
        out = out.unionByName(met.select(key, F.lit("VIP_IMPERSONATION").alias("indicator")).distinct())
    if brands is not None:  # the first by word counts; a brand can stand only where its first word does
        words = people.select(key, "_name", "_sender", F.explode(F.array_distinct(F.regexp_extract_all("_name", F.lit(r"\w+"), F.lit(0)))).alias("_w"))
        met = words.join(brands.withColumn("_w", F.regexp_extract("word", r"\w+", 0)), "_w").filter(F.expr(r"_name rlike concat(r'\b', word, r'\b')") & ~F.contains("_sender", "word"))
        met = met.groupBy(key).agg(F.min("word").alias("word"))
        out = out.unionByName(met.select(key, F.lit("BRAND_DISPLAY_NAME_SPOOF").alias("indicator")))
    return out


def fraud_report(indicators: DataFrame, key: str) -> DataFrame:
    points = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in FRAUD_POINTS.items() for x in p)), F.col("indicator")), F.lit(15))
    out = indicators.groupBy(key).agg(F.least(F.lit(100), F.sum(points)).cast("int").alias("score"), F.bool_or(F.col("indicator").isin(HARD_FLAGS)).alias("_hard"), F.sort_array(F.collect_set("indicator")).alias("flags"))
    level = F.when((F.col("score") >= 60) | F.col("_hard"), "CRITICAL_BEC").when(F.col("score") >= 40, "HIGH_RISK").when(F.col("score") >= 20, "SUSPICIOUS").otherwise("CLEAN")
    return out.withColumn("level", level).drop("_hard")


def without_hidden(text: Column) -> Column:
    return F.translate(text, ZERO_WIDTH, "")


def sanitised_html(html: Column) -> Column:
    """Without scripts, styles, frames, event handlers and script links."""
    for pattern, to in [(r"(?is)<(script|style|iframe|object|embed|form)\b.*?</\1\s*>", ""), (r"(?is)<(script|style|iframe|object|embed|form|link|meta|base)\b[^>]*>", ""), (r"(?is)\son[a-z]+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", ""), (r"(?is)(href|src|action)\s*=\s*([\"'])\s*(javascript|vbscript|data):[^\"']*\2", r"$1=$2#$2")]:
        html = F.regexp_replace(html, pattern, to)
    return html
