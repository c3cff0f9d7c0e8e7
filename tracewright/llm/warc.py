"""WARC archives: a writer of one gzip member per record and a splittable reader.

The reader's tasks take byte ranges. A task looks for the gzip magic in its range, decodes the start of
each candidate and checks that it is a WARC header, and owns the records that start inside its range,
also where they end beyond. Archives are opened through pyarrow's file systems by the URI of the shared
folder (opened()), so they stand wherever Spark's own checkpoints stand.

No record is lost in silence: a member that begins as a record but is damaged or cut off is an error, and
op10 compares the numbers of records written and read, which the archives' rows carry.

Defined results: a null html is an empty payload; of equal payloads of at least min_revisit_bytes the smallest
page_id is the response (all its rows are), other rows revisit it; a null page_id is larger than any
other; a url of any length is kept as its header has it; an empty table gives no archive and no row. Archives of other
writers give all their records, warcinfo and others too: their ids are text, page_id is null, a digest that is missing or no SHA-1 is
computed, a revisit without a length has none. An archive within a record is part of its payload, but one that stands
there uncompressed can't be told from records by a range that begins inside it: compress members, as gzip does.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, read, staged

MAGIC = b"\x1f\x8b\x08"
BEGIN = b"WARC/1."
SPLIT_BYTES = 4 << 20
CHUNK_BYTES = 1 << 20
HEADER_BYTES = 1 << 16
#: Digests of repeated payloads (some 60 bytes each) that are broadcast, and salts of each beyond them.
MOST_REPEATED, SALTS = 1 << 19, 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

RECORDS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, record_id string, refers_to_id string"


#: Names that Spark's file systems have and pyarrow's have not, and which of pyarrow's reads the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def opened(uri: str):
    """The file system of a URI and the path in it. Stores that pyarrow doesn't know are opened by fsspec, where that is installed."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    try:
        return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + ":" + rest if re.match(r"[a-z0-9]+:/", uri) else uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        import fsspec

        store, path = fsspec.core.url_to_fs(uri)
        return fs.PyFileSystem(fs.FSSpecHandler(store)), path


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, and first_id: the smallest page_id with this payload (its own, where the payload is too small).

    Payloads that occur once are nobody's revisits, so only digests of repeated ones are joined; these are broadcast while
    a count shows that they are few, and beyond it both sides are dealt by digest and a salt, so a payload that a third of all pages have is
    spread over tasks.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("_digest", F.unhex(F.sha1("payload")))
    large = pages.filter(F.octet_length("payload") >= min_revisit_bytes)
    first = staged(large.groupBy("_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("_n")).filter("_n > 1").select("_digest", "first_id"), "repeated", small=True)
    if first.limit(MOST_REPEATED + 1).count() <= MOST_REPEATED:
        found = pages.join(F.broadcast(first.withColumn("_many", F.lit(True))), "_digest", "left")
    else:
        salted = first.withColumn("_many", F.lit(True)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = pages.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_merge"), ["_digest", "_salt"], "left")
    return found.select("page_id", "url", "payload", F.when(F.col("_many"), F.col("first_id")).otherwise(F.col("page_id")).alias("first_id"))


def _record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = page_id != first_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{first_id}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + out.flush()


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """One archive a task attempt, under a name of its own; only those of attempts that Spark counts are listed. Gives path, bytes and records; a row each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        size, records, out = 0, 0, None
        for batch in batches:
            for row in range(batch.num_rows):
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{top}/{name}", compression=None)  # members are compressed already
                member = _record(*(batch.column(c)[row].as_py() for c in ("page_id", "url", "payload", "first_id")))
                out.write(member)
                size += len(member)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([records])], names=["path", "bytes", "records"])

    written = with_revisits(pages, min_revisit_bytes).select("page_id", "url", "payload", "first_id").mapInArrow(write, "path string, bytes long, records long")
    rows = written.collect()  # a row per archive
    _removed_others(pages.sparkSession, folder, {r["path"].rpartition("/")[2] for r in rows})
    return pages.sparkSession.createDataFrame(rows, written.schema)


def _removed_others(spark: SparkSession, folder: str, names: set[str]) -> None:
    """Archives of attempts that failed or came second."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in store.listStatus(top) if store.exists(top) else []:
        if f.getPath().getName() not in names:
            store.delete(f.getPath(), False)


def _header(raw: bytes) -> dict[str, str] | None:
    """Named fields if raw begins with a WARC header, in lower case."""
    head, gap, _ = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(BEGIN):
        return None
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:]))
    return fields if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def _member(file, at: int, size: int) -> tuple[bytes, int] | None:
    """The member's content and its end, if a WARC record begins at this byte; an error if it begins as one but does not end as one."""
    inflate, place, head, rest = zlib.decompressobj(31), at, b"", b""
    try:
        while len(head) < len(BEGIN) and not inflate.eof:
            file.seek(place)
            raw = file.read(min(HEADER_BYTES, size - place))
            if not raw:
                return None
            head += inflate.decompress(raw, len(BEGIN) - len(head))
            rest, place = inflate.unconsumed_tail, place + len(raw)
    except zlib.error:
        return None
    if not head.startswith(BEGIN):
        return None
    parts = [head]
    try:
        if rest:
            parts.append(inflate.decompress(rest))
        while not inflate.eof:
            file.seek(place)
            raw = file.read(min(CHUNK_BYTES, size - place))
            if not raw:
                raise ValueError(f"byte {at}: a record that is cut off")
            parts.append(inflate.decompress(raw))
            place += len(raw)
    except zlib.error as e:
        raise ValueError(f"byte {at}: a damaged record") from e
    content = b"".join(parts)
    if _header(content) is None:
        raise ValueError(f"byte {at}: a record without type or length")
    return content, place - len(inflate.unused_data)


def _starts(file, start: int, end: int, size: int) -> Iterator[tuple[bytes, int]]:
    """Records that begin at a byte from start to before end, in order."""
    at = start
    while at < end:
        file.seek(at)
        window = file.read(min(CHUNK_BYTES, end + len(MAGIC) - 1 - at, size - at))
        k = window.find(MAGIC)
        if k < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += k
        if at >= end:
            return
        found = _member(file, at, size)
        if found:
            yield found
        at = found[1] if found else at + 1


def _page(urn: str | None) -> int | None:
    """The page_id in an id that the writer gave; None for other ids."""
    found = re.fullmatch(r"<?urn:page:(-?\d+)>?", urn or "")
    return int(found[1]) if found else None


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of an HTTP message, in lower case, and its body."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def _parsed(content: bytes) -> tuple:
    """A row of RECORDS: of any record, whoever wrote it. The payload is the body of an HTTP message, else the whole block."""
    fields = _header(content)
    kind = fields["warc-type"]
    block = content.partition(b"\r\n\r\n")[2][: int(fields["content-length"])]
    http, payload = _http(block) if fields.get("content-type", "").replace(" ", "").startswith("application/http") else ({}, block)
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if kind == "revisit":
        payload, length = None, http.get("content-length", "")
        size, digest = int(length) if length.isdigit() else None, digest or None
    else:
        size, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if algorithm.lower() == "sha1" and digest.upper() not in (own, hashlib.sha1(payload).hexdigest().upper()) and "transfer-encoding" not in http:
            raise ValueError(f"{fields.get('warc-record-id')}: its payload has the digest {own}, its header {digest}")
        digest = own
    record, refers = (fields.get(x, "").strip("<>") or None for x in ("warc-record-id", "warc-refers-to"))
    return _page(record), fields.get("warc-target-uri"), kind, _page(refers), payload, size, digest, record, refers


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of archives (path, bytes), by ranges of split_bytes: ours and those of other writers, of every type."""
    splits = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string())])
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                store, place = opened(path)
                with store.open_input_file(place) as file:
                    rows, held = [], 0
                    for content, _ in _starts(file, start, min(start + split_bytes, size), size):
                        rows.append(_parsed(content))
                        held += len(content)
                        if held >= 4 * CHUNK_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    n = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    return splits.repartition(4 * n, "path", "start").mapInArrow(scan, RECORDS)


def checked(records: DataFrame, archives: DataFrame) -> DataFrame:
    """records, staged, if they are as many as were written."""
    records = staged(records, "records")
    read_back, written = records.count(), archives.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if read_back != written:
        raise ValueError(f"{written} records were written and {read_back} read back")
    return records


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(read(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return checked(read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), archives)


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM p
)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::INT, 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
