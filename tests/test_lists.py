"""Long lists: a Bloom filter before the exact join changes no row."""

import random

from pyspark.sql import functions as F

from tracewright.operators import iocs, lists
from tracewright.sources import packets


def test_filter_holds_all_and_lets_few_others_pass(spark):
    own = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("v"))
    filter_ = lists.bloom(own, "v", 20_000)
    assert filter_[1] == 4 and filter_[0].count() == 4 and {len(r["words"]) for r in filter_[0].collect()} == {lists.WORDS}
    assert lists.may_hold(own, "v", filter_).count() == 20_000
    others = spark.range(20_000, 60_000).select(F.md5(F.col("id").cast("string")).alias("v"), F.lit(1).alias("words"))
    passed = lists.may_hold(others, "v", filter_)
    assert passed.columns == ["v", "words"] and 0 < passed.count() < 0.05 * 40_000


def test_listed_alike_with_and_without_filter(spark, monkeypatch):
    rng = random.Random(2)
    facts = spark.createDataFrame([(i, rng.choice([f"H{rng.randrange(300)}", f"h{rng.randrange(300)}", None, ""])) for i in range(2000)], "id long, value string")
    watch = spark.createDataFrame([(f" h{i} " if i % 2 else f"H{i}",) for i in range(0, 300, 3)] * 2 + [(None,)], "value string")
    plain = sorted(map(tuple, lists.listed(facts, watch).collect()))
    monkeypatch.setattr(lists, "MOST_BROADCAST", 10)
    found = lists.listed(facts, watch)
    assert found.columns == ["id", "value"] and sorted(map(tuple, found.collect())) == plain and len(plain) > 100
    monkeypatch.setattr(lists, "MOST_SEGMENTS", 1)
    monkeypatch.setattr(lists, "SEGMENT_VALUES", 1)
    assert sorted(map(tuple, lists.listed(facts, watch).collect())) == plain
    assert lists.listed(facts, watch.limit(0)).count() == 0


def test_shared_lists_are_bounded_and_rows_are_not(spark):
    seen = spark.createDataFrame([("ipv4", "1.1.1.1", f"i{k:03}") for k in range(50)] + [("ipv4", "2.2.2.2", "i1")], "ioc_type string, value string, item string")
    r = iocs.shared(seen, "item").collect()
    assert [(x["value"], x["items"], len(x["seen_in"].split(","))) for x in r] == [("1.1.1.1", 50, 20)]
    assert iocs.shared_rows(seen, "item").count() == 50


def test_extension_headers(spark):
    """Hop-by-hop, routing, fragment, authentication and destination headers before TCP; a chain that never ends."""
    tcp = (1000).to_bytes(2) + (443).to_bytes(2) + bytes(8) + b"\x50\x02" + bytes(6) + b"body"
    ends = bytes(15) + b"\x01" + bytes(15) + b"\x02"
    chain = lambda *kinds: b"".join((bytes([n, {43: 2, 51: 4}.get(k, 0)]) + bytes({43: 22, 51: 22}.get(k, 6))) for k, n in zip(kinds, (*kinds[1:], 6)))
    frame = lambda *kinds: bytes(12) + b"\x86\xdd\x60\0\0\0\0\0" + bytes([kinds[0] if kinds else 6, 64]) + ends + chain(*kinds) + tcp
    rows = [("c", i, 0, 1, 0, bytearray(frame(*k)), False) for i, k in enumerate([(), (0,), (0, 43, 44, 51, 60), (60,) * 9])]
    got = [(r["transport"], r["dst_port"], bytes(r["payload"] or b"")) for r in packets.decoded(spark.createDataFrame(rows, packets.FRAMES)).orderBy("packet_num").collect()]
    assert got == [("TCP", 443, b"body")] * 3 + [(None, None, b"")]
