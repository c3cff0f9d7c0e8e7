"""Hosts, registered domains and URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import suffixes
from .suffixes import SuffixRules
from .text import decoded_base64

# Link shorteners.
SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "ow.ly", "is.gd", "buff.ly", "adf.ly", "bit.do", "mcaf.ee", "su.pr", "cutt.ly", "shorturl.at", "goo.gl", "qr.net", "v.gd", "trib.al", "rebrand.ly", "tiny.cc", "bl.ink", "clck.ru", "s.id", "linktr.ee"]

# Top-level domains of frequent abuse.
RISKY_TLDS = ["tk", "ml", "ga", "cf", "gq", "top", "xyz", "buzz", "work", "icu", "loan", "click", "fit", "rest", "surf", "gdn", "racing", "cam", "country", "stream"]

# Query parameters that carry an identity, and those that redirect.
IDENTITY_PARAMETERS = ["email", "user", "username", "login", "account", "id", "pass", "password", "token"]
REDIRECT_PARAMETERS = ["url", "redirect", "redirect_uri", "redirect_url", "next", "goto", "return", "returnurl", "continue", "dest", "destination", "target", "ref"]

COMMON_PORTS = [80, 443, 8080, 8443]


def host(url: Column) -> Column:
    """Host in lower case, without user, port, or a closing dot."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"\.$", ""))


def port(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)", 1).try_cast("int")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def query_keys(url: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.concat(F.lit("&"), query(url)), F.lit("&([^=&]+)"), F.lit(1)), F.lower)


def registered_domain(name: Column, rules: SuffixRules | None = None) -> Column:
    """Public suffix and one label more, by a user's rules or the built-in ones; a name without a dot, or an address, is itself."""
    return F.when(is_ip_host(name), name).otherwise(suffixes.registered(name, rules))


def subdomain(name: Column, rules: SuffixRules | None = None) -> Column:
    apex = registered_domain(name, rules)
    return F.when(F.length(name) > F.length(apex), name.substr(F.lit(1), F.length(name) - F.length(apex) - 1)).otherwise("")


def is_ip_host(name: Column) -> Column:
    """Dotted, plain or hexadecimal IPv4, or IPv6 in brackets."""
    return name.rlike(r"^(\d{1,3}(\.\d{1,3}){3}|\d{8,10}|0x[0-9a-f]{8}|\[[0-9a-f:.]+\])$")


def tld(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def unicode_name(name: Column) -> Column:
    """A host with its punycode labels decoded."""
    return F.when(F.contains(name, F.lit("xn--")), F.java_method(F.lit("java.net.IDN"), F.lit("toUnicode"), name)).otherwise(name)


def ascii_name(name: Column) -> Column:
    """A host with labels beyond ASCII in punycode; null where it can't be, as of labels that are too long."""
    return F.when(name.rlike(r"[^\x00-\x7F]"), F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), name)).otherwise(name)


def targets(target: Column, rules: SuffixRules | None = None) -> dict[str, Column]:
    """domain, username, is_email, registered, tld, punycode and unicode of an address, a URL or a name."""
    bare = F.trim(target)
    bare = F.when(F.contains(bare, F.lit("://")), F.regexp_extract(bare, r"^[^:]+://([^/?#]*)", 1)).otherwise(bare)
    inner = F.regexp_extract(bare, r"<([^<>]+)>", 1)
    bare = F.when(inner != "", inner).otherwise(bare)
    mail = F.contains(bare, F.lit("@"))
    name = F.lower(F.trim(F.when(mail, F.substring_index(bare, "@", -1)).otherwise(F.substring_index(bare, "/", 1))))
    name = F.regexp_replace(F.regexp_replace(name, r":\d+$", ""), r"\.+$", "")
    ascii_ = ascii_name(name)
    return {"domain": ascii_, "username": F.when(mail, F.trim(F.substring_index(bare, "@", 1))), "is_email": mail, "registered": registered_domain(ascii_, rules), "tld": tld(ascii_), "punycode": F.contains(ascii_, F.lit("xn--")), "unicode": unicode_name(ascii_)}


def defanged(url: Column) -> Column:
    """hxxp for http, and bracketed dots in the host alone."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)
    name = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    rest = url.substr(F.length(head) + F.length(name) + 1, F.length(url))
    return F.concat(F.replace(head, F.lit("http"), F.lit("hxxp")), F.replace(name, F.lit("."), F.lit("[.]")), rest)


def refanged(url: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(url, r"\[\.\]|\(\.\)|\{\.\}", "."), r"\[:\]", ":")
    return F.regexp_replace(plain, "^(?i)hxxp", "http")


def url_flags(url: Column, rules: SuffixRules | None = None) -> list[tuple[str, int, Column]]:
    """Name, points and condition of each flag of a single URL."""
    name, keys = host(url), query_keys(url)
    return [
        ("IP_HOST_URL", 35, is_ip_host(name)),
        ("IDN_HOMOGRAPH_ATTACK", 45, name.contains("xn--") | name.rlike(r"[^\x00-\x7F]")),
        ("SUSPICIOUS_SHORTENER", 20, registered_domain(name, rules).isin(SHORTENERS)),
        ("SUSPICIOUS_TLD", 15, tld(name).isin(RISKY_TLDS)),
        ("SUSPICIOUS_PORT", 20, F.coalesce(~port(url).isin(COMMON_PORTS), F.lit(False))),
        ("CREDENTIAL_PHISH_PARAM", 25, F.arrays_overlap(keys, F.array(*map(F.lit, IDENTITY_PARAMETERS)))),
        ("OPEN_REDIRECT_PARAM", 15, F.arrays_overlap(keys, F.array(*map(F.lit, REDIRECT_PARAMETERS)))),
        ("BASE64_ENCODED_TARGET", 20, F.exists(F.regexp_extract_all(query(url), F.lit("[A-Za-z0-9+/]{12,}={0,2}"), F.lit(0)), lambda t: F.coalesce(decoded_base64(t).rlike(r"^[\w.+-]+@[\w-]+\.[\w.]+$"), F.lit(False)))),
    ]


def url_score(url: Column, rules: SuffixRules | None = None) -> Column:
    return F.least(F.lit(100), reduce(lambda a, b: a + b, (F.when(when, points).otherwise(0) for _, points, when in url_flags(url, rules))))
