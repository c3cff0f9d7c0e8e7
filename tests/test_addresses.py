"""Addresses of both versions against Python's own reading of them."""

import random
from ipaddress import ip_address, ip_network

from pyspark.sql import functions as F

from tracewright.functions import network
from tracewright.operators import enrich


def forms(rng):
    n = rng.choice([rng.getrandbits(32), rng.getrandbits(128), rng.getrandbits(128) & (0xFFFF << rng.randrange(112)), int(ip_network(rng.choice(network.SPECIAL_RANGES_V6 + network.GLOBAL_RANGES_V6)).network_address) + rng.randrange(3)])
    four, six = n < 1 << 32 and rng.random() < 0.8, ip_address(n) if n >= 1 << 32 else ip_address(f"::{n:x}" if n < 1 << 16 else f"::{n >> 16:x}:{n & 0xFFFF:x}")
    if four:
        return str(ip_address(n)), rng.choice([None, "::ffff:" + str(ip_address(n))])
    return six.compressed, rng.choice([six.exploded, six.compressed.upper(), f"[{six.compressed}]", six.compressed + "%eth0", None])


def number(text):
    a = ip_address(text)
    return int(a) if a.version == 6 else (0xFFFF << 32) + int(a)


ODD = ["", ":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "12345::", "g::", "::1.2.3", "::1.2.3.256", "1.2.3.4:5", "256.1.1.1", "1.2.3", "%eth0", "::%", None, "1:2:3:4:5:6:7::", "::", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::8:7:6:5:4:3:2"]


def test_addresses_and_special_ranges(spark):
    rng = random.Random(3)
    texts = {t for _ in range(2000) for t in forms(rng) if t} | set(ODD[:-5])
    texts |= set(ODD)
    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", network.address(F.col("ip")).alias("a"))
    for r in rows.select("ip", "a", network.is_private_address(F.col("a")).alias("p"), network.is_tor_address(F.col("a")).alias("t")).collect():
        try:
            bare = ip_address((r["ip"] or "").strip("[]").split("%")[0]) if not (r["ip"] or "").endswith("%") else ip_address("no")
        except ValueError:
            assert (r["a"], r["p"]) == (None, None), r
            continue
        assert r["a"] == f"{number(str(bare)):032x}", r
        plain = getattr(bare, "ipv4_mapped", None) or bare
        if plain.version == 6:  # IPv4 follows the library's own list
            assert r["p"] == (plain.is_private or plain.is_loopback or plain.is_link_local or plain.is_reserved), r
        else:
            assert r["p"] == any(plain in ip_network(x) for x in network.SPECIAL_RANGES) and r["t"] == any(plain in ip_network(x) for x in network.TOR_RANGES)


def test_longest_prefix_against_brute_force(spark):
    rng = random.Random(4)
    nets = set()
    while len(nets) < 300:
        if rng.random() < 0.5:
            nets.add(str(ip_network((rng.getrandbits(4) << 28 | rng.getrandbits(12) << 16 & 0xFFFFFFFF, rng.randrange(0, 33)), strict=False)))
        else:
            nets.add(str(ip_network((0x2001 << 112 | rng.getrandbits(6) << 100 | rng.getrandbits(4), rng.randrange(10, 129)), strict=False)))
    ips = [str(ip_address(rng.getrandbits(4) << 28 | rng.getrandbits(12) << 16 | rng.getrandbits(8))) for _ in range(300)] + [str(ip_address(0x2001 << 112 | rng.getrandbits(6) << 100 | rng.getrandbits(4))) for _ in range(300)] + ["no", "::ffff:" + "16.1.0.5"]
    listed = enrich.networks(spark.createDataFrame([(n, n) for n in nets] + [("x/9", "bad"), ("1.2.3.4/40", "bad")], "cidr string, net string"))
    got = {(r["ip"], r["net"]) for r in enrich.in_networks(spark.createDataFrame([(i,) for i in ips], "ip string"), listed, "ip", ["net"]).collect()}
    parsed = [ip_network(n) for n in nets]
    want = set()
    for i in ips:
        a = None if i == "no" else ip_address(i)
        a = getattr(a, "ipv4_mapped", None) or a
        held = [n for n in parsed if a is not None and a.version == n.version and a in n]
        want.add((i, str(max(held, key=lambda n: n.prefixlen)) if held else None))
    assert got == want
    none = enrich.in_networks(spark.createDataFrame([("1.1.1.1",)], "ip string"), listed.limit(0), "ip", ["net"])
    assert none.first()["net"] is None
