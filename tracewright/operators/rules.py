"""Rule scans: tables of patterns over text, with any, all or n-of conditions.

A rule is (rule, condition, severity, score, patterns). All patterns of all rules together first pick the
rows that can hit at all; only those are checked pattern by pattern. Patterns are literals in the plan, so
each is compiled once, and rows of a user's rule table can be given as more of these tuples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, matches, plus, running

# Instructions that try to take over a model.
PROMPT_INJECTION = ("prompt_injection", "any", "HIGH", 30, [
    r"(?i)\bignore\s+(?:all\s+)?previous\s+instructions\b", r"(?i)\bdisregard\s+(?:all\s+)?prior\s+(?:instructions|prompts)\b", r"(?i)\bsystem\s+prompt\s*:\s*",
    r"(?i)\byou\s+are\s+now\s+(?:an?|in|a\s+helpful)\s+(?:DAN|jailbreak|unrestricted)\b", r"(?i)\boverride\s+(?:all\s+)?(?:system|developer)\s+instructions\b", r"(?i)\bdo\s+not\s+follow\s+earlier\s+rules\b", r"(?i)\bprint\s+(?:your\s+)?initial\s+prompt\b",
])

# Commands and script calls in text.
SCRIPT_PAYLOADS = ("script_payload", "any", "HIGH", 30, [
    r"(?i)\bpowershell(?:\.exe)?\s+-[a-zA-Z]", r"(?i)\b(?:iex|invoke-expression)\s*\(", r"(?i)\bdownloadstring\s*\(", r"(?i)\bcmd(?:\.exe)?\s+/c\b", r"(?i)\bcertutil(?:\.exe)?\s+-urlcache\b",
    r"(?i)\bbitsadmin(?:\.exe)?\s+/transfer\b", r"(?i)\beval\s*\(", r"(?i)<\s*script[^>]*>", r"(?i)\b(?:document|window)\.location\b", r"(?i)^MZ[\x00-\xff]{2,}",
])

# Names of the script payloads, in the order of their patterns.
SCRIPT_NAMES = ["POWERSHELL_CMD", "POWERSHELL_IEX", "POWERSHELL_DOWNLOAD", "CMD_EXEC", "CERTUTIL_DOWNLOAD", "BITSADMIN_DOWNLOAD", "JAVASCRIPT_EVAL", "JAVASCRIPT_SCRIPT_TAG", "DOCUMENT_LOCATION_REDIRECT", "EXECUTABLE_HEADER"]

# Wordings of payment, payroll, gift card and urgency fraud.
FRAUD_WORDING = [
    ("WIRE_TRANSFER_PAYMENT", "any", "HIGH", 20, [r"(?i)\bwire\s+transfer\b", r"(?i)\bbank\s+transfer\b", r"(?i)\bswift\s+(?:code|payment|transfer)\b", r"(?i)\bremittance\s+advice\b", r"(?i)\bupdated?\s+bank\s+(?:details|account|information)\b", r"(?i)\bnew\s+banking\s+details\b", r"(?i)\bpayment\s+instructions?\b", r"(?i)\brouting\s+number\b", r"(?i)\boverdue\s+invoice\s+payment\b", r"(?i)\bprocess\s+(?:this\s+)?payment\b"]),
    ("PAYROLL_DIRECT_DEPOSIT", "any", "HIGH", 20, [r"(?i)\bupdate\s+(?:my\s+)?direct\s+deposit\b", r"(?i)\bchange\s+(?:my\s+)?payroll\b", r"(?i)\bnew\s+bank\s+account\s+for\s+(?:paycheck|payroll)\b", r"(?i)\bw-?2\s+(?:form|statement|document)\b", r"(?i)\bpayroll\s+direct\s+deposit\b"]),
    ("GIFT_CARD_FRAUD", "any", "HIGH", 20, [r"(?i)\bgift\s+cards?\b", r"(?i)\bapple\s+gift\s+cards?\b", r"(?i)\bgoogle\s+play\s+cards?\b", r"(?i)\bamazon\s+gift\s+cards?\b", r"(?i)\bpurchase\s+(?:some\s+)?(?:cards?|vouchers?)\b", r"(?i)\bscratch\s+the\s+back\b", r"(?i)\bclaim\s+code\b"]),
    ("EXECUTIVE_URGENCY", "any", "HIGH", 20, [r"(?i)\bare\s+you\s+at\s+your\s+desk\b", r"(?i)\bare\s+you\s+available\b", r"(?i)\bhandle\s+this\s+discreetly\b", r"(?i)\bstrictly\s+confidential\b", r"(?i)\burgent\s+(?:task|request|favor)\b", r"(?i)\bdo\s+not\s+call\s+me\b", r"(?i)\bi['’]?m\s+in\s+a\s+meeting\b"]),
]

Rule = tuple[str, str, str, int, Sequence[str]]


def scan(df: DataFrame, rules: Sequence[Rule], text: str, keep: list[str]) -> DataFrame:
    """keep, rule, severity, score, hits: rules whose number of patterns found meets the condition (any, all, or a number)."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    some = "|".join(f"(?:{p})" for _, _, _, _, patterns in rules for p in patterns)
    checks = []
    for name, condition, severity, score, patterns in rules:
        need = {"any": 1, "all": len(patterns)}.get(condition) or int(condition)
        hits = sum((value.rlike(p).cast("int") for p in patterns[1:]), value.rlike(patterns[0]).cast("int"))
        checks.append(F.when(hits >= need, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.lit(score).alias("score"), hits.alias("hits"))))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.filter(value.rlike(some)).select(*keep, F.inline(found))


def seen(text: Column, names: Sequence[str], patterns: Sequence[str]) -> Column:
    """Names of the patterns that a text holds, in their order."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), n) for n, p in zip(names, patterns))))


def located(df: DataFrame, rules: Sequence[Rule], text: str, keep: list[str], overlap: int = 64) -> DataFrame:
    """keep, rule, pattern, offset, value of every match of rules that hit, from left to right without overlaps.

    Chunks of a text that tell their own offset (chunk_off) and share `overlap` characters give the matches of the whole text, as long as a
    match and what it looks at beside it are within overlap / 2 characters: all places where a match can begin are taken, each from
    the chunk that shows most around it, and of places that overlap those that a search from the text's start finds stay.
    """
    value = F.col(text)
    some = "|".join(f"(?:{p})" for _, _, _, _, patterns in rules for p in patterns)
    hit = df.filter(value.rlike(some))
    named = [(name, n, p) for name, _, _, _, patterns in rules for n, p in enumerate(patterns)]
    row = lambda name, n, offset, v: F.struct(F.lit(name).alias("rule"), F.lit(n).alias("pattern"), offset.alias("offset"), v.alias("value"))
    if "chunk_off" not in df.columns:
        every = lambda name, n, p: F.transform(matches(value, p), lambda m: row(name, n, m["start"].cast("long"), m["value"]))
        return hit.select(*keep, F.inline(F.concat(*(every(*x) for x in named))))

    def begins(name: str, n: int, p: str) -> Column:
        def placed(x: Column) -> Column:
            ends = lambda b: running(F.transform(F.slice(b, 1, F.size(b) - 1), F.length), plus)
            places = let(ends(x["b"]), lambda at: F.when(value.rlike(rf"\A(?:{p})"), F.concat(F.array(F.lit(0)), F.filter(at, lambda i: i > 0))).otherwise(at))
            return F.zip_with(places, x["m"], lambda at, v: row(name, n, F.col("chunk_off") + at, v))

        return let(F.struct(F.split(value, f"(?={p})", -1).alias("b"), F.regexp_extract_all(value, F.lit(f"(?=({p}))"), F.lit(1)).alias("m")), placed)

    found = hit.select(*keep, "chunk_off", F.inline(F.concat(*(begins(*x) for x in named)))).filter((F.col("chunk_off") == 0) | (F.col("offset") - F.col("chunk_off") >= overlap // 2))
    one = [*keep, "rule", "pattern"]
    found = found.groupBy(*one, "offset").agg(F.max_by("value", "chunk_off").alias("value"))
    ordered = Window.partitionBy(*one).orderBy("offset")
    before = F.max(F.col("offset") + F.length("value")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("_new", F.coalesce(F.col("offset") >= before, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    places = F.array_sort(F.collect_list(F.struct("offset", "value")))  # of places that overlap one another
    first = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<struct<offset:bigint,value:string>>").alias("kept"))
    step = lambda acc, x: F.when(x["offset"] >= acc["end"], F.struct((x["offset"] + F.length(x["value"])).alias("end"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)
    return found.groupBy(*one, "_run").agg(F.aggregate(places, first, step, lambda acc: acc["kept"]).alias("_kept")).select(*one, F.inline("_kept"))


def attributed(hits: DataFrame, key: str, family: str = "rule") -> DataFrame:
    """Families and score per key: the highest score and 5 for each further family, 15 at most."""
    out = hits.groupBy(key).agg(F.countDistinct(family).alias("families"), F.max("score").alias("_max"))
    return out.withColumn("score", F.least(F.lit(100), F.col("_max") + F.least(F.lit(15), 5 * (F.col("families") - 1))).cast("int")).drop("_max")
