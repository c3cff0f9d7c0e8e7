"""Hidden and encoded content of messages: hidden elements and comments, zero-width characters, blobs and what they hold.

Tags are matched as a browser's parser without a document model does: an end tag closes what its element holds, elements
without end are empty, and what stays open ends with the message. Each message is read once by a small parser in
Arrow batches; decoded texts are judged by column expressions.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import html as references
import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ZERO_WIDTH
from . import rules

# Elements without an end tag, and those whose text is not shown as text.
EMPTY = "area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split()
UNSHOWN = "script style template".split()

# Techniques of inline styles, the first that fits counts.
STYLES = {
    "CSS_DISPLAY_NONE": r"\bdisplay\s*:\s*none\b",
    "CSS_VISIBILITY_HIDDEN": r"\bvisibility\s*:\s*hidden\b",
    "CSS_ZERO_FONT_SIZE": r"\bfont-size\s*:\s*0(?:px|pt|em|rem|%)?\b",
    "CSS_TRANSPARENT_COLOR": r"\bcolor\s*:\s*(?:transparent\b|rgba\([^)]*,\s*0(?:\.0+)?\))",
    "CSS_ZERO_OPACITY": r"\bopacity\s*:\s*0(?:\.0+)?\b",
    "CSS_OFF_SCREEN_POSITION": r"\b(?:left|top|text-indent|margin-left)\s*:\s*-\d{3,}(?:px)?\b",
    "CSS_ZERO_HEIGHT_OVERFLOW": r"\bmax-height\s*:\s*0(?:px)?\s*;\s*overflow\s*:\s*hidden\b",
}
SAME_COLOURS = [{"#fff", "#ffffff", "white", "rgb(255,255,255)", "rgba(255,255,255,1)"}, {"#000", "#000000", "black", "rgb(0,0,0)", "rgba(0,0,0,1)"}]

# How blobs are encoded, and how they look.
ENCODED = {
    "BASE64_TEXT": r"(?:data:[^;]+;base64,)?([A-Za-z0-9+/=]{24,})",
    "HEX_ESCAPES": r"((?:\\x[0-9a-fA-F]{2}){4,})",
    "PERCENT_ESCAPES": r"((?:%[0-9a-fA-F]{2}[a-zA-Z0-9_()./ -]*){2,})",
    "HTML_ENTITIES": r"((?:&#[xX]?[0-9a-fA-F]+;){4,})",
}
BLOBS = list(ENCODED)
PRINTABLE = 0.85

FOUND = "kind string, element string, evidence string, chars int, decoded string, sha256 string"


def technique(style: str) -> str | None:
    """How an inline style hides text, if it does."""
    style = style.lower()
    for name, pattern in STYLES.items():
        if re.search(pattern, style):
            return name
    ink, ground = (re.search(p, style) for p in (r"\bcolor\s*:\s*([^;]+)", r"\bbackground(?:-color)?\s*:\s*([^;]+)"))
    if ink and ground:
        ink, ground = (re.sub(r"\s", "", x[1]) for x in (ink, ground))
        if ink == ground or any(ink in same and ground in same for same in SAME_COLOURS):
            return "CSS_SAME_COLOR_BG"
    return None


class _Elements(HTMLParser):
    """Comments and hidden elements with their text: pieces between tags, without outer blanks, joined."""

    def __init__(self, least_comment: int):
        super().__init__(convert_charrefs=True)
        self.least, self.comments, self.attributes, self.styles = least_comment, [], [], []
        self.open: list[tuple[str, list]] = []  # tag, the findings that its text goes to
        self.piece: list[str] = []

    def _end_piece(self) -> None:
        text = "".join(self.piece).strip()
        self.piece = []
        if text and not (self.open and self.open[-1][0] in UNSHOWN):
            for _, findings in self.open:
                for f in findings:
                    f[2].append(text)

    def handle_data(self, data: str) -> None:
        self.piece.append(data)

    def handle_comment(self, data: str) -> None:
        self._end_piece()
        text = data.strip()
        if len(text) >= self.least and not text.startswith(("[if ", "<![endif")):
            self.comments.append(("HTML_COMMENT", "comment", [text]))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._end_piece()
        named, findings = dict(reversed(attrs)), []
        if "hidden" in named:
            findings.append(("HIDDEN_ATTRIBUTE", tag, []))
            self.attributes.append(findings[-1])
        if (how := technique(named.get("style") or "")) is not None:
            findings.append((how, tag, []))
            self.styles.append(findings[-1])
        if tag not in EMPTY:
            self.open.append((tag, findings))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._end_piece()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                break


def elements(html: str, least_comment: int) -> list[tuple]:
    """kind, element, text of comments, elements with the attribute hidden, and elements that a style hides; those without text are left out."""
    parser = _Elements(least_comment)
    parser.feed(html)
    parser.close()
    parser._end_piece()
    return [(kind, tag, "".join(text)) for kind, tag, text in (*parser.comments, *parser.attributes, *parser.styles) if text]


def _readable(text: str) -> bool:
    return bool(text) and sum(c.isprintable() or c in "\n\r\t" for c in text) >= PRINTABLE * len(text)


def decoded_bytes(kind: str, raw: str) -> bytes | None:
    """What a blob stands for; None where it stands for nothing."""
    if kind == "BASE64_TEXT":
        try:
            found = base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
        except (binascii.Error, ValueError):
            return None
        return found if len(found) >= 8 else None
    if kind == "HEX_ESCAPES":
        return bytes.fromhex(raw.replace("\\x", ""))
    text = unquote(raw) if kind == "PERCENT_ESCAPES" else references.unescape(raw)
    return text.strip().encode("utf-8", "replace") if text.strip() != raw else None


def encoded(text: str) -> Iterator[tuple]:
    """kind, blob, decoded text and sha256 of each distinct blob that holds mostly printable text."""
    seen = set()
    for kind, pattern in ENCODED.items():
        for found in re.finditer(pattern, text):
            raw = found[1].strip()
            if raw in seen or kind == "PERCENT_ESCAPES" and len(raw) < 8:
                continue
            seen.add(raw)
            content = decoded_bytes(kind, raw)
            plain = content.decode("utf-8", "ignore").strip() if content is not None else ""
            if _readable(plain) and not (kind == "BASE64_TEXT" and len(plain) < 8):
                yield kind, raw, plain, hashlib.sha256(content).hexdigest()


def content(messages: DataFrame, key: str, html: str, text: str, least_comment: int = 15) -> DataFrame:
    """key, kind, element, evidence, chars of hidden text, and decoded, sha256 of blobs, of messages with an HTML and a plain body."""
    schema = f"`{key}` {dict(messages.dtypes)[key]}, {FOUND}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
        names = [key, *(c.split()[0] for c in FOUND.split(", "))]
        for batch in batches:
            at, rows = [], []
            for i in range(batch.num_rows):
                h, t = (batch.column(c)[i].as_py() or "" for c in (1, 2))
                found = [(kind, tag, shown, len(shown), None, None) for kind, tag, shown in (elements(h, least_comment) if "<" in h else ())]
                both = f"{h}\n{t}"
                if zero := sum(both.count(c) for c in ZERO_WIDTH):
                    found.append(("ZERO_WIDTH", "unicode", f"{zero} characters", zero, None, None))
                found += [(kind, None, raw, 0, plain, digest) for kind, raw, plain, digest in encoded(both)]
                at += [i] * len(found)
                rows += found
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)

    return messages.select(key, F.col(html).alias("_html"), F.col(text).alias("_text")).mapInArrow(run, schema)


def _injection(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in rules.PROMPT_INJECTION[4]))


def blobs(findings: DataFrame) -> DataFrame:
    """Blobs among the findings with what they hold: injection, script names, a link."""
    b = findings.filter(F.col("kind").isin(BLOBS))
    return b.withColumns({"injection": _injection(F.col("decoded")), "scripts": rules.seen(F.col("decoded"), rules.SCRIPT_NAMES, rules.SCRIPT_PAYLOADS[4]), "has_link": F.col("decoded").rlike(r"(?i)\b(?:https?|ftp)://[^\s<>\"')]+")})


def report(findings: DataFrame, key: str) -> DataFrame:
    """Score and verdict per message of content's findings.

    50 for an injection, 50 for a script, 30 for zero-width characters, 30 for 50 hidden characters or 15 for any, and for each blob
    25 (suspicious), 15 (with a link) or 10; HIGH_RISK at 60, or with an injection or script; SUSPICIOUS with anything.
    """
    judged = {"injection": _injection(F.coalesce("decoded", "evidence")), "scripts": rules.seen(F.coalesce("decoded", F.lit("")), rules.SCRIPT_NAMES, rules.SCRIPT_PAYLOADS[4])}
    f = findings.withColumns(judged).withColumn("blob", F.col("kind").isin(BLOBS))
    link = F.col("decoded").rlike(r"(?i)\b(?:https?|ftp)://[^\s<>\"')]+")
    points = F.when(F.col("blob"), F.when(F.col("injection") | (F.size("scripts") > 0), 25).when(link, 15).otherwise(10)).otherwise(0)
    script = F.exists("scripts", lambda s: s.rlike("POWERSHELL|CMD|SCRIPT|EXECUTABLE"))
    out = f.groupBy(key).agg(
        F.bool_or(F.col("kind") == "ZERO_WIDTH").alias("zero_width"), F.sum("chars").alias("hidden_chars"), F.bool_or("injection").alias("injection"), F.bool_or(script).alias("script"), F.sum(points).alias("_p"),
        F.count_if("blob").alias("blobs"), F.count("*").alias("findings"), F.array_join(F.sort_array(F.collect_set(F.when(~F.col("blob"), F.col("kind")))), ",").alias("techniques"),
    )
    score = F.when(F.col("injection"), 50).otherwise(0) + F.when(F.col("script"), 50).otherwise(0) + F.when(F.col("zero_width"), 30).otherwise(0) + F.when(F.col("hidden_chars") >= 50, 30).when(F.col("hidden_chars") > 0, 15).otherwise(0) + F.col("_p")
    out = out.withColumn("score", F.least(F.lit(100), score).cast("int")).drop("_p")
    some = (F.col("score") >= 20) | (F.col("hidden_chars") > 0) | F.col("zero_width") | (F.col("blobs") > 0)
    return out.withColumn("verdict", F.when((F.col("score") >= 60) | F.col("injection") | F.col("script"), "HIGH_RISK").when(some, "SUSPICIOUS").otherwise("CLEAN"))
