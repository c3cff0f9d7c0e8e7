"""Secret scans: fixed patterns, and tokens that two character Markov models call random.

One model holds random strings, the other ordinary identifiers and words; both are first-order chains over
the characters of ALPHABET, trained from labelled samples by DataFrame aggregation. A token of
MIN_TOKEN or more such characters is a secret if the log-likelihood ratio of the models exceeds MIN_RATIO a
character. Scan, training and redaction are DataFrame expressions only.

Patterns are the contract's; matches are leftmost and do not overlap within a kind. Positions are code
points, ends exclusive. A `random` span never overlaps a base span. Positions are running sums over a text's
matches, taken by blocks, and overlaps come from one sorted list, so long texts full of matches cost little
more than their length.

Defined results: a null text is an empty one and has no span; repeated rows are scanned alike; an empty
table gives no row, and training from it leaves both models even, so no token is called random.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let, plus, running
from .common import read

# The patterns of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_TOKEN = 20
MIN_RATIO = 0.5
MIN_DISTINCT = 8
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN
WORDS = r"[A-Za-z0-9_-]{4,}"
#: Documents whose words teach what is ordinary (about so many), and made-up random strings of each kind.
WORD_DOCS = 3000
RANDOM_STRINGS = 2000

SPAN = "struct<start:int,kind:int,end:int>"
#: Code points of a text's segments, from which parts of it are taken without counting from its start.
SEGMENT = 1024


def _matches(text: Column, pattern: str, value_group: int = 0, min_value: int = 0) -> Column:
    """start, end, match of a pattern's matches whose value is long enough. Ends are running sums of what was split off and matched."""
    found = F.struct(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(c) for g, c in ((0, "m"), (value_group, "v"))), F.split(text, pattern, -1).alias("b"))

    def placed(x: Column) -> Column:
        ends = running(F.zip_with(x["m"], F.slice(x["b"], 1, F.size(x["m"])), lambda m, b: F.length(m) + F.length(b)), plus)
        rows = F.zip_with(x["m"], ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match")))
        return F.array_compact(F.zip_with(rows, x["v"], lambda row, v: F.when(F.length(v) >= min_value, row)))

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(text.rlike(pattern), let(found, placed)).otherwise(none)


def _spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns, by start, then kind as listed."""
    return F.sort_array(F.concat(_spans(_matches(text, ASSIGN, 2, MIN_VALUE), 0), _spans(_matches(text, ACCESS), 1), _spans(_matches(text, HEX), 2)))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """sample, random: values of base matches of all documents and made-up strings; words of a bounded set of documents that are in no match."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    hits = docs.filter(F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX))
    values = F.concat(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))
    secret = hits.select(F.explode(values).alias("sample")).filter(F.length("sample") >= MIN_TOKEN)
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    made = spark.range(RANDOM_STRINGS).select(F.explode(F.array(F.base64(F.unhex(digest)), F.substring(digest, 1, 40), F.substring(F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", "")), 1, 32))).alias("sample"))
    n = docs.count()
    u = F.pmod(F.xxhash64(F.lit("words"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = docs.filter(u < WORD_DOCS / max(1, n)).select(F.explode(F.regexp_extract_all(plain, F.lit(WORDS), F.lit(0))).alias("sample"))
    return secret.unionByName(made).withColumn("random", F.lit(True)).unionByName(words.withColumn("random", F.lit(False)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio, random to ordinary, of each pair of characters of ALPHABET. samples: sample, random."""
    pair = F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda i: F.col("sample").substr(i, F.lit(2)))
    pairs = samples.filter(F.length("sample") >= 2).select("random", F.explode(pair).alias("pair"))
    n = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = {True: [[0.5] * n for _ in range(n)], False: [[0.5] * n for _ in range(n)]}
    known = pairs.filter(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))
    seen = set()
    for r in known.groupBy("random", "pair").agg(F.count("*").alias("n")).collect():  # 2 * len(ALPHABET)^2 rows at most
        counts[r["random"]][at[r["pair"][0]]][at[r["pair"][1]]] += r["n"]
        seen.add(r["random"])
    if len(seen) < 2:
        return [0.0] * (n * n)
    log = {k: [[math.log(x / sum(row)) for x in row] for row in rows] for k, rows in counts.items()}
    return [log[True][a][b] - log[False][a][b] for a in range(n) for b in range(n)]


def ratio(token: Column, table: list[float]) -> Column:
    """Sum of the pairs' log-likelihood ratios over a token of ALPHABET's characters."""
    scores = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.element_at(scores, (a - 1) * len(ALPHABET) + b))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def random_spans(text: Column, base: Column, table: list[float]) -> Column:
    """Spans of tokens that the models call random and no base span touches."""

    def random(m: Column) -> Column:
        token = m["match"]
        return (F.size(F.array_distinct(F.split(token, ""))) >= MIN_DISTINCT) & (ratio(token, table) >= MIN_RATIO * (F.length(token) - 1))

    def free(tokens: Column) -> Column:
        """Tokens by their ends among base spans by their starts: none that begins before a token's end may reach beyond its start."""
        event = lambda at, base_end, x: F.struct(at.alias("at"), base_end.alias("reach"), x["start"].alias("start"), x["end"].alias("end"))
        events = F.sort_array(F.concat(F.transform(base, lambda b: event(b["start"], b["end"], b)), F.transform(tokens, lambda t: event(t["end"], F.lit(0), t))))
        return let(events, untouched)

    def untouched(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e["reach"]), F.greatest)
        span = lambda e: F.struct(e["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), e["end"].alias("end"))
        return F.array_compact(F.zip_with(events, reach, lambda e, r: F.when((e["reach"] == 0) & (r <= e["start"]), span(e))))

    tokens = F.filter(_matches(text, TOKEN), random)
    return let(tokens, lambda t: F.when(F.size(t) > 0, free(t)).otherwise(F.array().cast(f"array<{SPAN}>")))


def scan(docs: DataFrame, table: list[float]) -> DataFrame:
    """docs with base (array of spans) and spans (base and random ones, by start, then kind)."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("base", base_spans(text))
    return out.withColumn("spans", F.sort_array(F.concat("base", random_spans(text, F.col("base"), table))))


def as_text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by a mark. spans: sorted by start."""

    def part(segments: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / SEGMENT).cast("int")
        some = F.slice(segments, first + 1, F.floor((b - 1) / SEGMENT).cast("int") - first + 1)
        return F.when(b > a, F.array_join(some, "").substr(a - first * SEGMENT + 1, b - a)).otherwise("")

    def rebuilt(x: Column) -> Column:
        """x: the spans, how far those up to each reach, the segments. A run begins where no span before reaches."""
        before = F.concat(F.array(F.lit(0)), F.slice(x["reach"], 1, F.size(x["reach"]) - 1))
        gaps = F.array_compact(F.zip_with(x["spans"], before, lambda s, r: F.when(s["start"] >= r, F.struct(r.alias("a"), s["start"].alias("b")))))
        kept = F.transform(gaps, lambda g: F.concat(part(x["segments"], g["a"], g["b"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), part(x["segments"], F.element_at(x["reach"], -1), F.length(text)))

    x = F.struct(spans.alias("spans"), running(F.transform(spans, lambda s: s["end"]), F.greatest).alias("reach"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0)).alias("segments"))
    return F.when(F.size(spans) == 0, text).otherwise(let(x, rebuilt))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = scan(docs.select("doc_id", "text"), train(labelled_samples(docs)))
    kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", kind(0).alias("n_assign"), kind(1).alias("n_access"), kind(2).alias("n_hex"), F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
