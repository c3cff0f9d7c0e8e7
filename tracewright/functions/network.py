"""IPv4 addresses as numbers, addresses of both versions as 128 bits in hexadecimal text, and ranges of special use."""

from __future__ import annotations

from functools import reduce

from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# Special-use IPv4 ranges.
SPECIAL_RANGES = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]

# Special-use and reserved IPv6 ranges, and those within them that are not.
SPECIAL_RANGES_V6 = ["::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10"]
GLOBAL_RANGES_V6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]

# Subnets of Tor exits.
TOR_RANGES = ["185.220.101.0/24", "185.220.100.0/24", "185.220.102.0/24", "171.25.193.0/24", "109.70.100.0/24", "195.176.3.0/24"]


def bounds(cidr: str) -> tuple[int, int]:
    address, bits = cidr.split("/")
    a, b, c, d = map(int, address.split("."))
    first = (a << 24) + (b << 16) + (c << 8) + d
    return first, first + (1 << (32 - int(bits))) - 1


def ip_number(ip: Column) -> Column:
    """IPv4 as a long; null where it is none."""
    parts = F.split(ip, r"\.")
    octet = lambda i: F.element_at(parts, i).try_cast("long")
    good = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & reduce(lambda a, b: a & b, (octet(i) <= 255 for i in range(1, 5)))
    return F.when(good, reduce(lambda a, b: a * 256 + b, (octet(i) for i in range(1, 5))))


def in_ranges(number: Column, ranges: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (number.between(*bounds(r)) for r in ranges))


def is_private(number: Column) -> Column:
    return in_ranges(number, SPECIAL_RANGES)


def is_tor(number: Column) -> Column:
    return in_ranges(number, TOR_RANGES)


def subnet24(number: Column) -> Column:
    return F.floor(number / 256).cast("long")


MAPPED = "0" * 20 + "ffff"


def address(ip: Column) -> Column:
    """An address of either version as 32 hexadecimal digits, so that text order is the addresses' order; IPv4 as mapped into IPv6.

    Takes brackets, a zone, any legal shortening, and an IPv4 tail; null where it is no address.
    """
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(ip), r"^\[(.*)\]$", "$1"), r"^([^%]*:[^%]*)%.+$", "$1"))
    four = lambda x: F.lpad(F.lower(F.hex(ip_number(x))), 8, "0")

    def without_tail(text: Column) -> Column:
        tail = F.regexp_extract(text, r":(\d+\.\d+\.\d+\.\d+)$", 1)
        return F.when(tail == "", text).otherwise(let(four(tail), lambda d: F.concat(text.substr(F.lit(1), F.length(text) - F.length(tail)), F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4))))

    def expanded(text: Column) -> Column:
        gap = F.contains(text, F.lit("::"))
        groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
        left, right = groups(F.substring_index(text, "::", 1)), F.when(gap, groups(F.regexp_extract(text, "^.*?::(.*)$", 1))).otherwise(F.array().cast("array<string>"))
        n = F.size(left) + F.size(right)
        good = text.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$") & (text != "") & F.when(gap, n <= 7).otherwise(n == 8)
        wide = lambda xs: F.array_join(F.transform(xs, lambda g: F.lpad(g, 4, "0")), "")
        return F.when(good, F.concat(wide(left), F.repeat(F.lit("0000"), F.greatest(8 - n, F.lit(0))), wide(right)))

    return F.coalesce(F.concat(F.lit(MAPPED), four(F.trim(ip))), let(let(bare, without_tail), expanded))


def prefix(address_: Column, bits: Column) -> Column:
    """The first bits of an address as text; addresses share it if these bits are equal."""
    whole, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    nibble = F.conv(address_.substr(whole + 1, F.lit(1)), 16, 10).cast("int")
    kept = nibble.bitwiseAND(F.element_at(F.array(*map(F.lit, (0, 8, 12, 14))), rest + 1))
    return F.concat(address_.substr(F.lit(1), whole), F.when(rest > 0, F.lower(F.hex(kept))).otherwise(""))


def _between(address_: Column, ranges: list[str]) -> Column:
    def ends(cidr: str) -> tuple[str, str]:
        net = ip_network(cidr)
        start = MAPPED if net.version == 4 else ""
        return tuple(start + f"{int(x):0{32 - len(start)}x}" for x in (net.network_address, net.broadcast_address))

    return let(address_, lambda a: reduce(lambda x, y: x | y, (a.between(*ends(r)) for r in ranges)))


def is_private_address(address_: Column) -> Column:
    """Of special use or reserved, whichever the version; a mapped IPv4 address is judged as IPv4."""
    four = address_.startswith(MAPPED)
    return F.when(four, _between(address_, SPECIAL_RANGES)).otherwise(_between(address_, SPECIAL_RANGES_V6) & ~_between(address_, GLOBAL_RANGES_V6))


def is_tor_address(address_: Column) -> Column:
    return _between(address_, TOR_RANGES)
