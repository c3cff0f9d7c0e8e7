"""Captures and images by ranges: the rows of many tasks are those of one."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tracewright.operators import files
from tracewright.sinks.files import write_files
from tracewright.sources import packets, ranges


def classic(rng, n, order="<", magic=0xA1B2C3D4, payload=None):
    raw = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i in range(n):
        frame = payload(i) if payload else rng.randbytes(rng.choice([1, 14, 60, 700, 1500]))
        raw += struct.pack(order + "IIII", 1_700_000_000 + i // 10, i % 1000, len(frame), len(frame) + rng.choice([0, 9])) + frame
    return raw


def block(kind, body, order="<"):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))


def next_generation(rng, n):
    """Two sections of either byte order, interfaces of several units in the midst of frames, and blocks of other kinds."""
    raw = b""
    for order in "<>":
        raw += block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order) + block(1, struct.pack(order + "HHI", 1, 0, 0), order)
        interfaces = 1
        for i in range(n):
            if i % 50 == 20:
                raw += block(1, struct.pack(order + "HHI", 101, 0, 0) + struct.pack(order + "HHBxxx", 9, 1, 9) + struct.pack(order + "HH", 0, 0), order)
                interfaces += 1
            frame = rng.randbytes(rng.choice([1, 60, 701]))
            ticks = 1_700_000_000_000_000 + i
            raw += block(6, struct.pack(order + "IIIII", i % interfaces, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + frame, order)
            if i % 30 == 5:
                raw += block(5, rng.randbytes(24), order) + block(3, struct.pack(order + "I", 8) + b"simplest", order)
    return raw


def rows(df):
    return sorted((r["packet_num"], r["ts_micros"], r["link"], r["wire_len"], bytes(r["frame"]), r["cut"]) for r in df.collect())


def in_one(spark, raw):
    return rows(packets.frames(spark.createDataFrame([("c", bytearray(raw))], "path string, content binary")))


def nested(i):
    """Frames that hold parts of a capture themselves."""
    inner = classic(random.Random(i), 12, payload=lambda k: b"x" * 20)
    return inner[24:]


@pytest.mark.parametrize("split", [700, 9000])
def test_many_tasks_read_the_rows_of_one(spark, tmp_path, split):
    rng = random.Random(5)
    made = {"little": classic(rng, 60), "big": classic(rng, 30, ">", 0xA1B2C3D4), "nano": classic(rng, 20, "<", 0xA1B23C4D), "nested": classic(rng, 12, payload=nested), "ng": next_generation(rng, 120), "empty": classic(rng, 0)}
    made |= {"cut": made["little"][:-7], "cut_head": made["little"][: 24 + 16 + 1] + b"", "ng_cut": made["ng"][:-9], "large": classic(rng, 3, payload=lambda i: rng.randbytes(30_000)) + classic(rng, 20)[24:]}
    for name, raw in made.items():
        (tmp_path / f"{name}.cap").write_bytes(raw)
    (tmp_path / "none.cap").write_bytes(b"no capture at all, but long enough to be asked")
    found = packets.read_frames(spark, f"file://{tmp_path}", split).withColumn("name", F.regexp_extract("path", r"(\w+)\.cap$", 1)).persist()
    want = {name: in_one(spark, (tmp_path / f"{name}.cap").read_bytes()) for name in made if (tmp_path / f"{name}.cap").exists()}
    for name, one in want.items():
        assert rows(found.filter(F.col("name") == name)) == one, name
    assert found.filter("name = 'none'").count() == 0
    assert [sum(r[-1] for r in want[x]) for x in ("little", "cut", "ng", "ng_cut", "empty")] == [0, 1, 0, 1, 0] and len(want["ng"]) == 248
    found.unpersist()


def test_damaged_block_ends_a_file_in_any_split(spark, tmp_path):
    raw = bytearray(next_generation(random.Random(6), 100))
    at = raw.find(b"simplest", len(raw) // 3)
    raw[at - 8 : at - 4] = struct.pack("<I", 4)  # a size that no block has
    (tmp_path / "c.cap").write_bytes(raw)
    one = in_one(spark, raw)
    assert one[-1][-1] and all(rows(packets.read_frames(spark, f"file://{tmp_path}/c.cap", s)) == one for s in (900, 7000))


def test_images_by_ranges(spark, tmp_path):
    rng = random.Random(7)
    raw = b"".join(rng.choice([b"\0\1\2", b"plain text of an image ", "wide".encode("utf-16le"), rng.randbytes(9)]) for _ in range(4000)) + b"z" * 20_000
    pieces = spark.createDataFrame([("i.bin", at, bytearray(raw[at : at + 1000])) for at in range(0, len(raw), 1000)], "name string, at long, bytes binary").repartition(7)
    written = write_files(pieces, f"file://{tmp_path}/images").collect()
    assert [(r["path"], r["bytes"]) for r in written] == [(f"file://{tmp_path}/images/i.bin", len(raw))] and (tmp_path / "images/i.bin").read_bytes() == raw
    whole = spark.createDataFrame([("i", 0, bytearray(raw))], "image_id string, chunk_off long, bytes binary")
    as_set = lambda df: {(r["offset"], r["encoding"], r["value"]) for r in files.strings(df).collect()}
    assert as_set(ranges.read_pieces(spark, f"file://{tmp_path}/images", 512, 64, 5000)) == as_set(whole)
