"""Mail: single messages, mailboxes, MIME parts.

Files are read by Spark; the standard library's parser works on one message at a time inside the tasks.
"""

from __future__ import annotations

import email
import email.policy
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MESSAGES = (
    "message_key string, message_id string, date_raw string, subject string, display_name string, from_address string, to_addresses array<string>, cc_addresses array<string>, reply_to string, return_path string, "
    "headers array<struct<pos:int,name:string,value:string>>, body_plain string, body_html string, "
    "parts array<struct<index:int,path:string,depth:int,parent:string,content_type:string,filename:string,is_attachment:boolean,content:binary>>, defects array<string>"
)


def _text(part) -> str:
    raw = part.get_payload(decode=True) or b""
    for charset in (part.get_content_charset() or "utf-8", "utf-8", "latin-1"):
        try:
            return raw.decode(charset)
        except (LookupError, UnicodeDecodeError):
            continue
    return ""


def _walk(part, path: str, depth: int, parent: str | None, out: list) -> None:
    multi = part.is_multipart()
    name = part.get_filename()
    out.append((part, path, depth, parent, name, bool(name) or part.get_content_disposition() == "attachment"))
    if multi:
        for i, child in enumerate(part.get_payload(), 1):
            _walk(child, f"{path}.{i}", depth + 1, path, out)


def _row(key: str, raw: bytes) -> dict:
    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    found: list = []
    _walk(m, "1", 0, None, found)
    first = lambda n: str(m.get(n)) if m.get(n) is not None else None
    people = lambda n: [a.strip() for a in str(m.get(n) or "").split(",") if a.strip()]
    shown, address = email.utils.parseaddr(first("From") or "")
    body = lambda kind: "\n\n".join(_text(p) for p, _, _, _, _, attached in found if p.get_content_type() == kind and not attached) or None
    return {
        "message_key": key, "message_id": first("Message-ID"), "date_raw": first("Date"), "subject": first("Subject"), "display_name": shown or None, "from_address": address or None,
        "to_addresses": people("To"), "cc_addresses": people("Cc"), "reply_to": first("Reply-To"), "return_path": first("Return-Path"),
        "headers": [{"pos": i, "name": n, "value": str(v)} for i, (n, v) in enumerate(m.items())], "body_plain": body("text/plain"), "body_html": body("text/html"),
        "parts": [{"index": i, "path": path, "depth": depth, "parent": parent, "content_type": p.get_content_type(), "filename": name, "is_attachment": attached, "content": None if p.is_multipart() else p.get_payload(decode=True)} for i, (p, path, depth, parent, name, attached) in enumerate(found)],
        "defects": sorted({type(d).__name__ for p, *_ in found for d in p.defects}),
    }


def parsed_by_format(raw: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]], path: str = "path") -> DataFrame:
    """Messages from rows (path, message_key, content) of mixed formats: each format's rows go to its parser, those of formats without one are left out. A parser is any function from (message_key, content) to messages."""
    kind = raw.withColumn("_format", email_format(F.col(path), F.col("content")))
    one = [parser(kind.filter(F.col("_format") == name).select("message_key", "content")) for name, parser in parsers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one)


def parsed(raw: DataFrame) -> DataFrame:
    """Messages from rows (message_key, content binary)."""
    schema = raw.sparkSession.createDataFrame([], MESSAGES).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, contents = (batch.column(c).to_pylist() for c in ("message_key", "content"))
            for at in range(0, len(keys), 64):
                yield pa.RecordBatch.from_pylist([_row(k, c or b"") for k, c in zip(keys[at : at + 64], contents[at : at + 64])], schema=arrow)

    return raw.select("message_key", F.col("content").cast("binary").alias("content")).mapInArrow(run, schema)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """One message a file."""
    return parsed(spark.read.format("binaryFile").load(path).select(F.col("path").alias("message_key"), "content"))


def read_mailbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of mailboxes, split where a line begins with `From ` by Spark's splittable text reader.

    A message's key is its file and its number there. Numbers are counts of the blocks before and places within
    the block, so a mailbox of many blocks is numbered without gathering it.
    """
    rows = spark.read.option("lineSep", "\nFrom ").text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block")) - F.col("_n")
    rows = rows.join(blocks.withColumn("_before", before), ["_file", "_block"])
    entry = F.regexp_replace("value", r"^(From )?[^\n]*\n", "")  # the envelope line
    number = F.col("_before") + F.col("_at") - F.col("_first")
    rows = rows.filter(F.length(F.trim("value")) > 0)
    return parsed(rows.select(F.concat_ws("#", "_file", number.cast("string")).alias("message_key"), entry.cast("binary").alias("content")))


def parts(messages: DataFrame) -> DataFrame:
    return messages.select("message_key", F.inline("parts"))


def email_format(path: Column, content: Column) -> Column:
    """msg, mbox, eml or unknown, by ending, container magic, and the first 512 bytes."""
    head = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    return (
        F.when(F.hex(F.substring(content, 1, 8)) == "D0CF11E0A1B11AE1", "msg").when(head.startswith("From "), "mbox")
        .when(F.lower(path).rlike(r"\.(eml|emlx)$") | head.rlike(r"(?im)^(received|from|to|subject|date|message-id|mime-version|return-path):"), "eml")
        .when(F.lower(path).endswith(".mbox"), "mbox").when(F.lower(path).endswith(".msg"), "msg").otherwise("unknown")
    )


def evidence_kind(path: Column, content: Column) -> Column:
    """email, capture, log, memory, binary or document by ending; ambiguous text by words of its first 2 KB."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    head = F.lower(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    return (
        F.when(ext.isin("eml", "msg", "mbox"), "email").when(ext.isin("pcap", "pcapng", "cap"), "capture").when(ext.isin("evtx"), "log").when(ext.isin("raw", "dmp", "mem", "vmem", "lime"), "memory")
        .when(ext.isin("exe", "dll", "sys", "elf", "so", "bin"), "binary").when(ext.isin("json", "csv", "log", "xml") & head.rlike("eventid|eventdata|operation|auditdata|userid|creationtime|sysmon"), "log").otherwise("document")
    )
