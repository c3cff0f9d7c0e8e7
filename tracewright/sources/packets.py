"""Packet captures: frames of pcap and pcapng files, then headers by column expressions, then DNS, HTTP and TLS."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as SqlWindow
from pyspark.sql import functions as F

from ..functions.arrays import computed, let
from ..functions.maps import first_of_each
from ..staging import staged
from .ranges import CHUNK_BYTES, SPLIT_BYTES, Window, files, opened, ranges

FRAMES = "path string, packet_num long, ts_micros long, link int, wire_len long, frame binary, cut boolean"
DNS = "id int, is_response boolean, rcode int, section string, name string, rtype string, ttl long, rdata string"

# Record types by number.
RECORD_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 10: "NULL", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 65: "HTTPS"}
MOST_QUESTIONS, MOST_RECORDS, MOST_POINTERS = 20, 50, 10


#: Extension headers of an IPv6 packet that are followed.
EXTENSIONS = 6
#: Heads in a row that must fit for a place to be taken for a frame's.
CHAIN = 6
#: Bytes of a frame, or of a block, that a head may announce at most while its place is looked for.
MOST_FRAME, MOST_BLOCK = 1 << 18, 1 << 24
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
SECTION = b"\x0a\x0d\x0d\x0a"


class Classic:
    """Frames of a pcap file, from any place on where one begins."""

    first, gap = 24, 1

    def __init__(self, window: Window):
        self.window = window
        head = window.read(0, 24)
        self.order, self.unit = MAGIC[head[:4]]
        self.link = struct.unpack_from(self.order + "I", head, 20)[0]
        self.seen: list[tuple] = []

    def _head(self, at: int) -> tuple[int, int, int, int] | None:
        raw = self.window.read(at, 16)
        return struct.unpack(self.order + "IIII", raw) if len(raw) == 16 else None

    def fits(self, at: int) -> bool:
        """Whether a chain of heads of likely frames, of about one time, begins here, or reaches the file's end."""
        last = None
        for _ in range(CHAIN):
            if at == self.window.size:
                return last is not None
            head = self._head(at)
            if head is None or head[1] >= 1_000_000 * self.unit or not 0 < head[2] <= MOST_FRAME or head[3] < head[2] or head[3] > MOST_FRAME or last is not None and abs(head[0] - last) > 86400:
                return False
            last, at = head[0], at + 16 + head[2]
            if at > self.window.size:
                return False
        return True

    def frames(self, start: int, end: int, sections: list | None = None) -> Iterator[tuple]:
        """at, next place, ts_micros, link, wire_len, frame, cut of frames that begin from start to before end."""
        at = start
        while at < end:
            head = self._head(at)
            if head is None:
                yield at, self.window.size, None, self.link, None, self.window.read(at, 16), True
                return
            sec, part, cap, wire = head
            last = min(at + 16 + cap, self.window.size)
            yield at, last, sec * 1_000_000 + part // self.unit, self.link, wire, self.window.read(at + 16, last - at - 16), last < at + 16 + cap
            at = last


class Blocks:
    """Frames of a pcapng file, from any place on where a block begins."""

    first, gap = 0, 4

    def __init__(self, window: Window):
        self.window = window
        self.seen: list[tuple] = []  # what sections and interfaces say: (order, None, None) or (None, link, micros a tick)

    def _size(self, at: int, order: str) -> int | None:
        """A block's size, if it is told alike at both its ends."""
        raw = self.window.read(at, 12)
        if len(raw) < 12:
            return None
        if raw[:4] == SECTION:
            order = "<" if raw[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
        size = struct.unpack_from(order + "I", raw, 4)[0]
        if size < 12 or size % 4 or at + size > self.window.size:
            return None
        return size if self.window.read(at + size - 4, 4) == raw[4:8] else None

    def fits(self, at: int) -> bool:
        return any(self._chained(at, order) for order in "<>")

    def _chained(self, at: int, order: str) -> bool:
        for n in range(3):
            if at == self.window.size:
                return n > 0
            size = self._size(at, order)
            if size is None or size > MOST_BLOCK:
                return False
            at += size
        return True

    def frames(self, start: int, end: int, sections: list | None = None) -> Iterator[tuple]:
        order, links, ticks = next((o for o in "<>" if self._size(start, o) is not None), "<"), [], []  # until sections say it, as the first block has it
        for kind, link, tick in sections or ():
            if kind is not None:
                order, links, ticks = kind, [], []
            else:
                links.append(link)
                ticks.append(tick)
        at = start
        while at < end:
            raw = self.window.read(at, 12)
            if raw[:4] == SECTION and len(raw) == 12:
                order, links, ticks = ("<" if raw[8:12] == b"\x4d\x3c\x2b\x1a" else ">"), [], []
                self.seen.append((order, None, None))
            kind, size = struct.unpack_from(order + "II", raw, 0) if len(raw) == 12 else (None, 0)
            if size < 12 or at + size > self.window.size:
                yield at, self.window.size, None, links[0] if links else 1, None, self.window.read(at, min(self.window.size - at, MOST_FRAME)), True
                return
            if kind == 1:
                body = self.window.read(at, size)
                links.append(struct.unpack_from(order + "H", body, 8)[0])
                ticks.append(_tick(body, 16, size - 4, order))
                self.seen.append((None, links[-1], ticks[-1]))
            elif kind == 6 and size >= 32:
                body = self.window.read(at, size)
                iface, high, low, cap, wire = struct.unpack_from(order + "IIIII", body, 8)
                cut = cap > size - 32
                yield at, at + size, round(((high << 32) + low) * (ticks[iface] if iface < len(ticks) else 1.0)), links[iface] if iface < len(links) else 1, wire, body[28 : 28 + min(cap, size - 32)], cut
            elif kind == 3 and size >= 16:
                body = self.window.read(at, size)
                wire = struct.unpack_from(order + "I", body, 8)[0]
                yield at, at + size, 0, links[0] if links else 1, wire, body[12 : 12 + min(wire, size - 16)], False
            at += size
            self.at = at


def _tick(raw: bytes, at: int, end: int, order: str) -> float:
    """Microseconds of an interface's time unit: option 9 is a power of ten, or of two with its high bit; a microsecond without it."""
    while at + 4 <= end:
        code, size = struct.unpack_from(order + "HH", raw, at)
        if code == 9 and size:
            n = raw[at + 4]
            return 1e6 / (2 ** (n & 0x7F) if n & 0x80 else 10**n)
        if code == 0:
            break
        at += 4 + (size + 3) // 4 * 4
    return 1.0


def scanner(window: Window) -> Classic | Blocks | None:
    """What reads a file's frames; None where it is no capture."""
    head = window.read(0, 24)
    return Blocks(window) if head[:4] == SECTION else Classic(window) if len(head) == 24 and head[:4] in MAGIC else None


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """FRAMES rows in batches of about a chunk of bytes."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_())
    names = ["path", "packet_num", "ts_micros", "link", "wire_len", "frame", "cut"]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[5]) + 64
        if size >= CHUNK_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def frames(captures: DataFrame) -> DataFrame:
    """One row a frame of captures (path, content); content that is no capture gives none. What runs beyond the content's end comes as a row with cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column("path").to_pylist(), (v.as_py() for v in batch.column("content"))):
                window = Window(io.BytesIO(raw or b""), len(raw or b""))
                scan = scanner(window)
                found = scan.frames(scan.first, window.size) if scan else ()
                yield from _batches((file, n + 1, *x[2:]) for n, x in enumerate(found))

    return captures.select("path", "content").mapInArrow(run, FRAMES)


INDEX = "path string, bytes long, start long, end long, found long, next long, packets long, said array<struct<order:string,link:int,tick:double>>"


def _indexed(splits: DataFrame) -> DataFrame:
    """INDEX of ranges (path, bytes, start, end, found): where the first frame or block of each begins (found, looked for where it is null), where the first
    behind it does (next), how many frames begin in it, and what it says of sections and interfaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, size, start, end, found in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start", "end", "found"))):
                store, place = opened(name)
                with store.open_input_file(place) as file:
                    window = Window(file, size)
                    scan = scanner(window)
                    if scan is None:
                        continue
                    if found is None:
                        found = scan.first if start <= scan.first < end else next((at for at in range(-(-start // scan.gap) * scan.gap, end, scan.gap) if scan.fits(at)), end)
                    last, n = found, 0
                    for x in scan.frames(found, end):
                        last, n = x[1], n + 1
                    rows.append((name, size, start, end, found, max(last, getattr(scan, "at", 0), end if found >= end else 0), n, [dict(zip(("order", "link", "tick"), s)) for s in scan.seen]))
            said = pa.list_(pa.struct([("order", pa.string()), ("link", pa.int32()), ("tick", pa.float64())]))
            kinds = (pa.string(), *[pa.int64()] * 6, said)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "bytes", "start", "end", "found", "next", "packets", "said"])

    return splits.select("path", "bytes", "start", "end", "found").mapInArrow(run, INDEX)


def read_frames(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row a frame of capture files, each read by many tasks.

    A first pass finds where frames begin in each range, by chains of likely heads, and counts them. Ranges must meet: where
    one was taken to begin elsewhere than the one before ends, it is read again from there, until all meet. The second pass
    reads the frames; what a range needs from before it (number of frames, sections and interfaces) is a running sum over its file's ranges.
    """
    index = staged(_indexed(ranges(files(spark, path), split_bytes).withColumn("found", F.lit(None).cast("long"))), "index")
    by_file = SqlWindow.partitionBy("path").orderBy("start")
    while True:
        reach = F.max("next").over(by_file.rowsBetween(SqlWindow.unboundedPreceding, -1))
        met = index.withColumn("_due", F.coalesce(reach, F.col("found")))
        wrong = met.filter("found <> _due and not (found >= end and _due >= end)").withColumn("found", F.col("_due"))
        if wrong.isEmpty():
            break
        first = wrong.groupBy("path").agg(F.min("start").alias("start"))  # the next may be right once this one is
        again = _indexed(wrong.join(F.broadcast(first), ["path", "start"], "left_semi"))
        index = staged(index.join(first, ["path", "start"], "left_anti").unionByName(again), "index")
    ahead = by_file.rowsBetween(SqlWindow.unboundedPreceding, -1)
    known = index.filter("packets > 0 or size(said) > 0").withColumn("before", F.coalesce(F.sum("packets").over(ahead), F.lit(0))).withColumn("sections", F.flatten(F.collect_list(F.when(F.size("said") > 0, F.col("said"))).over(ahead)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("path", "bytes", "end", "found", "before", "sections")]
            for name, size, end, found, before, sections in zip(*columns):
                store, place = opened(name)
                with store.open_input_file(place) as file:
                    scan = scanner(Window(file, size))
                    rows = scan.frames(found, end, [(s["order"], s["link"], s["tick"]) for s in sections])
                    yield from _batches((name, before + n + 1, *x[2:]) for n, x in enumerate(rows))

    parts = 4 * spark.sparkContext.defaultParallelism
    return known.filter("packets > 0").repartition(parts, "path", "start").select("path", "bytes", "end", "found", "before", "sections").mapInArrow(run, FRAMES)


def _number(frame: Column, at: Column, size: int) -> Column:
    return F.conv(F.hex(frame.substr(at + 1, F.lit(size))), 16, 10).try_cast("bigint")


def _byte(frame: Column, at: Column) -> Column:
    return F.conv(F.hex(frame.substr((at + 1).cast("int"), F.lit(1))), 16, 10).try_cast("bigint")


def _address(frame: Column, at: Column) -> Column:
    return F.concat_ws(".", *(_number(frame, at + i, 1).cast("string") for i in range(4)))


def decoded(frames: DataFrame) -> DataFrame:
    """packets: Ethernet with or without a VLAN tag, or cooked capture; IPv4, IPv6 (addresses in full form; up to EXTENSIONS extension headers are passed), ARP; TCP flags, UDP and ICMP; the payload behind them."""
    frame = F.col("frame")
    tagged = (F.col("link") == 1) & (_number(frame, F.lit(12), 2) == 0x8100)
    at = F.when(F.col("link") == 113, 16).when(F.col("link") == 101, 0).when(tagged, 18).otherwise(14)
    p = computed(frames, _ip=at)
    ip = F.col("_ip")
    v4 = (_number(frame, ip, 1).bitwiseAND(F.lit(0xF0)) == 0x40)
    arp = (F.col("link") == 1) & (_number(frame, ip - 2, 2) == 0x0806)
    p = computed(p, _v4=~arp & v4, _v6=~arp & (_number(frame, ip, 1).bitwiseAND(F.lit(0xF0)) == 0x60), _arp=arp)
    v4, v6, arp = F.col("_v4"), F.col("_v6"), F.col("_arp")
    first = lambda kind, at: F.struct(kind.cast("long").alias("kind"), at.cast("long").alias("at"))
    four = first(_number(frame, ip + 9, 1), ip + _number(frame, ip, 1).bitwiseAND(F.lit(0x0F)) * 4)
    six = first(_number(frame, ip + 6, 1), ip + 40)
    for _ in range(EXTENSIONS):
        six = let(six, lambda x: F.when(x["kind"].isin(0, 43, 60), first(_byte(frame, x["at"]), x["at"] + (_byte(frame, x["at"] + 1) + 1) * 8)).when(x["kind"] == 44, first(_byte(frame, x["at"]), x["at"] + 8)).when(x["kind"] == 51, first(_byte(frame, x["at"]), x["at"] + (_byte(frame, x["at"] + 1) + 2) * 4)).otherwise(x))
    p = computed(p, _l4p=F.when(v4, four).when(v6, six)).withColumn("_l4", F.col("_l4p.at").cast("int")).withColumn("protocol", F.col("_l4p.kind"))
    wide = lambda at: F.concat_ws(":", *(F.lower(F.hex(frame.substr(at + 1 + 2 * i, F.lit(2)))) for i in range(8)))
    end = lambda four, six, hw: F.when(v4, _address(frame, ip + four)).when(v6, wide(ip + six)).when(arp, _address(frame, ip + hw))
    l4, proto = F.col("_l4"), F.col("protocol")
    flags = _number(frame, l4 + 13, 1)
    names = F.filter(F.array(*(F.when(flags.bitwiseAND(F.lit(1 << i)) > 0, n) for i, n in enumerate(("FIN", "SYN", "RST", "PSH", "ACK", "URG")))), lambda x: x.isNotNull())
    has_ports = proto.isin(6, 17)
    body = F.when(proto == 6, l4 + F.shiftright(_number(frame, l4 + 12, 1), 4) * 4).when(proto == 17, l4 + 8)
    return p.select(
        "path", "packet_num", F.timestamp_micros("ts_micros").alias("ts"), "wire_len", F.when(proto == 6, "TCP").when(proto == 17, "UDP").when(proto.isin(1, 58), "ICMP").when(arp, "ARP").alias("transport"),
        end(12, 8, 14).alias("src"), F.when(has_ports, _number(frame, l4, 2)).cast("int").alias("src_port"), end(16, 24, 24).alias("dst"), F.when(has_ports, _number(frame, l4 + 2, 2)).cast("int").alias("dst_port"),
        F.when(proto == 6, names).otherwise(F.array().cast("array<string>")).alias("flags"), F.when(has_ports, frame.substr(body.cast("int") + 1, F.length(frame))).alias("payload"),
    )


def _name(raw: bytes, at: int) -> tuple[str, int]:
    labels, end, hops = [], None, 0
    while at < len(raw) and (n := raw[at]):
        if n & 0xC0 == 0xC0:
            if at + 1 >= len(raw) or hops >= MOST_POINTERS:
                break
            end = at + 2 if end is None else end
            at, hops = (n & 0x3F) << 8 | raw[at + 1], hops + 1
            continue
        labels.append(raw[at + 1 : at + 1 + n].decode("latin-1"))
        at += n + 1
    return ".".join(labels), end if end is not None else at + 1


def dns_message(raw: bytes) -> list[tuple]:
    """Rows (id, is_response, rcode, section, name, type, ttl, data) of a DNS payload; what is cut off is left out."""
    if len(raw) < 12:
        return []
    ident, flags, *counts = struct.unpack_from(">HHHHHH", raw, 0)
    head, at, rows = (ident, bool(flags & 0x8000), flags & 0xF), 12, []
    try:
        for _ in range(min(counts[0], MOST_QUESTIONS)):
            name, at = _name(raw, at)
            kind = struct.unpack_from(">H", raw, at)[0]
            at += 4
            rows.append((*head, "question", name, RECORD_TYPES.get(kind, str(kind)), None, None))
        for section, n in zip(("answer", "authority", "additional"), counts[1:]):
            for _ in range(min(n, MOST_RECORDS)):
                name, at = _name(raw, at)
                kind, _, ttl, size = struct.unpack_from(">HHIH", raw, at)
                at += 10
                body = raw[at : at + size]
                if kind == 1 and size == 4:
                    data = ".".join(map(str, body))
                elif kind in (2, 5, 12):
                    data = _name(raw, at)[0]
                elif kind == 16:
                    data, k = "", 0
                    while k < len(body):
                        data += body[k + 1 : k + 1 + body[k]].decode("latin-1")
                        k += body[k] + 1
                else:
                    data = body.hex()
                rows.append((*head, section, name, RECORD_TYPES.get(kind, str(kind)), ttl, data))
                at += size
    except struct.error:
        pass
    return rows


def dns_records(packets: DataFrame) -> DataFrame:
    """packet_num, ts and the records of each packet to or from port 53."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
        names = ["id", "is_response", "rcode", "section", "name", "rtype", "ttl", "rdata"]
        for batch in batches:
            at, rows = [], []
            for i, raw in enumerate(batch.column("payload").to_pylist()):
                for row in dns_message(raw or b""):
                    at.append(i)
                    rows.append(row)
            if rows:
                kept = batch.select(["path", "packet_num", "ts"]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[*kept.schema.names, *names])

    some = packets.filter((F.col("transport") == "UDP") & ((F.col("src_port") == 53) | (F.col("dst_port") == 53)))
    return some.select("path", "packet_num", "ts", "payload").mapInArrow(run, "path string, packet_num long, ts timestamp, " + DNS)


def http_requests(packets: DataFrame) -> DataFrame:
    """Method, target, host, user agent, status, headers (names in lower case, the first of each) and the first 256 characters of the body of plain HTTP payloads."""
    text = F.decode("payload", "ISO-8859-1")
    head = F.substring_index(text, "\r\n\r\n", 1)
    one = lambda p: F.nullif(F.regexp_extract(head, p, 1), F.lit(""))
    lines = F.filter(F.split(head, "\r\n"), lambda x: x.rlike(r"^[A-Za-z0-9-]+:"))
    entries = F.transform(lines, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1)).alias("v")))
    headers = F.col("headers")
    return computed(packets.filter(text.rlike(r"^(GET|POST|PUT|HEAD|DELETE|OPTIONS|PATCH) |^HTTP/1\.")), headers=first_of_each(entries)).select(
        "path", "packet_num", "ts", one(r"^(GET|POST|PUT|HEAD|DELETE|OPTIONS|PATCH) ").alias("method"), one(r"^\w+ (\S+) HTTP/").alias("target"), F.lower(headers["host"]).alias("host"),
        headers["user-agent"].alias("user_agent"), one(r"^HTTP/1\.\d (\d{3})").try_cast("int").alias("status"), "headers", F.substring(F.regexp_extract(text, r"(?s)\r\n\r\n(.*)$", 1), 1, 256).alias("body"),
    )


# Names of TLS versions.
TLS_VERSIONS = {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}

HELLO = "sni string, version int, ciphers array<int>, extensions array<int>, supported array<string>"


def client_hello(raw: bytes) -> tuple | None:
    """sni, version, ciphers, extensions and supported versions of a TLS client hello; None where it is none or cut off before its extensions."""
    try:
        if raw[0] != 22 or raw[5] != 1:
            return None
        version, at = struct.unpack_from(">H", raw, 9)[0], 43
        at += 1 + raw[at]
        size = struct.unpack_from(">H", raw, at)[0] // 2
        ciphers = struct.unpack_from(f">{size}H", raw, at + 2)
        at += 2 + 2 * size
        at += 1 + raw[at]
        kinds, name, supported = [], None, []
        end = min(len(raw), at + 2 + struct.unpack_from(">H", raw, at)[0]) if at + 2 <= len(raw) else at
        at += 2
        while at + 4 <= end:
            kind, size = struct.unpack_from(">HH", raw, at)
            body = raw[at + 4 : at + 4 + size]
            kinds.append(kind)
            if kind == 0 and size >= 5 and len(body) == size and body[2] == 0:
                name = body[5 : 5 + struct.unpack_from(">H", body, 3)[0]].decode("latin-1")
            elif kind == 43 and size >= 2 and len(body) == size:
                supported = [TLS_VERSIONS.get(v, f"0x{v:04X}") for v in struct.unpack_from(f">{body[0] // 2}H", body, 1)]
            at += 4 + size
    except (IndexError, struct.error):
        return None
    return name, version, list(ciphers), kinds, supported


def tls_hellos(packets: DataFrame) -> DataFrame:
    """path, packet_num, ts with the client hellos of packets and their JA3 text (version, ciphers, extensions; curves and formats are left empty) and its md5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
        for batch in batches:
            found = [(i, h) for i, v in enumerate(batch.column("payload")) if (h := client_hello(v.as_py() or b""))]
            if found:
                kept = batch.select(["path", "packet_num", "ts"]).take(pa.array([i for i, _ in found], pa.int64()))
                columns = [pa.array(c, k) for c, k in zip(zip(*(h for _, h in found)), kinds)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*kept.schema.names, "sni", "version", "ciphers", "extensions", "supported"])

    some = packets.filter(F.hex(F.substring("payload", 1, 6)).rlike("^1603......01"))
    out = some.select("path", "packet_num", "ts", "payload").mapInArrow(run, "path string, packet_num long, ts timestamp, " + HELLO)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "-")
    ja3 = F.concat_ws(",", F.col("version").cast("string"), listed("ciphers"), listed("extensions"), F.lit(""), F.lit(""))
    return out.withColumn("ja3", ja3).withColumn("ja3_md5", F.md5(F.col("ja3").cast("binary")))


def cleartext_credentials(payloads: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """protocol, username, masked secret of every credential in clear text: HTTP Basic and Bearer, FTP and POP3, IMAP, Telnet, SMTP PLAIN and LOGIN. A password belongs to the user named last before it."""
    from ..functions.text import decoded_base64, masked

    value = F.col(text)
    every = lambda p, g=1: F.regexp_extract_all(value, F.lit(p), F.lit(g))
    none = F.lit(None).cast("string")
    row = lambda protocol, user, secret: F.struct(F.lit(protocol).alias("protocol"), user.alias("username"), secret.alias("secret"))
    both = lambda protocol, users, secrets: F.zip_with(users, secrets, lambda u, s: row(protocol, u, s))

    def lines(protocol: str, user: str, secret: str) -> Column:
        """Each secret with the user named last before it, if any."""
        said = every(rf"(?im)^(?:{user}|{secret})\s*\S+", 0)
        value = lambda x, word: F.regexp_extract(x, rf"(?i)^(?:{word})\s*(\S+)", 1)
        named = lambda i: F.filter(F.slice(said, 1, i), lambda x: x.rlike(f"(?i)^{user}"))
        return F.filter(F.transform(said, lambda x, i: F.when(x.rlike(f"(?i)^{secret}"), row(protocol, value(F.get(F.slice(named(i), -1, 1), F.lit(0)), user), value(x, secret)))), lambda r: r.isNotNull())

    basic = F.transform(F.transform(every(r"(?i)authorization:\s*basic\s+([A-Za-z0-9+/=]+)"), decoded_base64), lambda d: row("HTTP_BASIC", F.substring_index(d, ":", 1), F.nullif(F.regexp_extract(d, "(?s)^[^:]*:(.*)$", 1), F.lit(""))))
    plain = F.transform(F.transform(every(r"(?im)^AUTH PLAIN\s+([A-Za-z0-9+/=]+)"), decoded_base64), lambda d: row("SMTP_PLAIN", F.regexp_extract(d, r"^[^\x00]*\x00([^\x00]*)\x00", 1), F.nullif(F.regexp_extract(d, r"\x00([^\x00]*)$", 1), F.lit(""))))
    login = r"(?im)^AUTH LOGIN\s*\r?\n([A-Za-z0-9+/=]+)\r?\n([A-Za-z0-9+/=]+)"
    imap = r"(?im)^(?!AUTH )\S+ +LOGIN +\"?([^\s\"]+)\"? +\"?([^\s\"]+)"
    rows = F.concat(
        basic, F.transform(every(r"(?i)authorization:\s*bearer\s+(\S+)"), lambda t: row("HTTP_BEARER", none, t)), lines("FTP_OR_POP3", r"USER\s", r"PASS\s"),
        both("IMAP", every(imap), every(imap, 2)), lines("TELNET", "login:", "password:"),
        plain, both("SMTP_LOGIN", F.transform(every(login), decoded_base64), F.transform(every(login, 2), decoded_base64)),
    )
    return payloads.select(*keep, F.inline(F.filter(rows, lambda x: x["secret"].isNotNull()))).withColumn("secret", masked(F.col("secret")))
