"""Entropy, encodings and look-alikes of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zero-width and bidirectional control characters.
ZERO_WIDTH = "​‌‍﻿‎‏‪‫‬‭‮"

# Look-alike letters and the Latin ones they stand for; `vv` stands for `w`.
LOOKALIKES = {
    "а": "a", "à": "a", "á": "a", "â": "a", "ã": "a", "ä": "a", "å": "a", "α": "a", "с": "c", "ç": "c", "ϲ": "c", "е": "e", "è": "e", "é": "e", "ê": "e", "ë": "e", "ε": "e",
    "і": "i", "í": "i", "ì": "i", "ï": "i", "ι": "i", "1": "i", "!": "i", "ј": "j", "о": "o", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "o", "ο": "o", "0": "o", "р": "p", "ρ": "p",
    "ѕ": "s", "ș": "s", "$": "s", "5": "s", "у": "y", "ý": "y", "ÿ": "y", "γ": "y", "х": "x", "χ": "x", "ѵ": "v", "ν": "v", "ԁ": "d", "ԛ": "q", "ԍ": "g",
}

VOWELS = "aeiou"


def entropy(text: Column) -> Column:
    """Shannon entropy of the lower-cased text in bits a symbol, 4 places; 0 for empty text."""
    chars = F.split(F.lower(text), "")
    n = F.length(text)
    term = lambda acc, c: acc - F.size(F.filter(chars, lambda x: x == c)) / n * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n > 0, F.round(F.aggregate(F.array_distinct(chars), F.lit(0.0), term), 4)).otherwise(F.when(text.isNotNull(), 0.0))


def encoding_class(label: Column) -> Column:
    """HEX, BASE32, BASE64URL, BASE64, BINARY_RAW or UNKNOWN, the first that fits."""
    plain = F.regexp_replace(label, "[.-]", "")
    n = F.length(plain)
    base32 = F.lower(plain).rlike("^[a-z2-7=]+$") & (n >= 8) & (plain.rlike("[2-7]") | (n >= 16))
    mixed = label.rlike("[A-Z]") & label.rlike("[a-z]") & label.rlike("[0-9=]")
    return (
        F.when(plain.rlike("^[0-9a-fA-F]{8,}$"), "HEX")
        .when(base32, "BASE32")
        .when((n >= 12) & label.rlike("^[a-zA-Z0-9_-]+$") & label.rlike("[-_]"), "BASE64URL")
        .when((n >= 16) & mixed, "BASE64")
        .when((n >= 16) & (entropy(plain) >= 4.4), "BINARY_RAW")
        .otherwise("UNKNOWN")
    )


def covert_subdomain(sub: Column) -> Column:
    """Whether a subdomain looks like a payload: by length, by entropy, or by encoding."""
    n, e, kind = F.length(sub), entropy(sub), encoding_class(sub)
    encoded = kind.isin("HEX", "BASE32", "BASE64URL", "BASE64") & ((n >= 16) | (e >= 3.8))
    return (n > 40) | ((e >= 4.5) & (n >= 12)) | ((e >= 3.9) & (n >= 24)) | encoded


def vowel_share(label: Column) -> Column:
    letters = F.regexp_count(label, F.lit("[a-zA-Z]"))
    return F.when(letters > 0, F.regexp_count(F.lower(label), F.lit(f"[{VOWELS}]")) / letters).otherwise(0.0)


def longest_consonants(label: Column) -> Column:
    runs = F.regexp_extract_all(F.lower(label), F.lit("[b-df-hj-np-tv-z]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def generated_score(label: Column) -> Column:
    """0 to 1: how much a domain label looks generated; labels under 7 characters score 0."""
    n, digits = F.length(label), F.regexp_count(label, F.lit("[0-9]"))
    letters, share = F.regexp_count(label, F.lit("[a-zA-Z]")), vowel_share(label)
    points = (
        F.when((entropy(label) >= 3.7) & (n >= 9), 40).otherwise(0)
        + F.when(((share < 0.18) | (share > 0.65)) & (letters >= 8), 35).otherwise(0)
        + F.when(longest_consonants(label) >= 5, 30).otherwise(0)
        + F.when((digits >= 4) | (digits / n >= 0.35), 25).otherwise(0)
        + F.when(F.lower(label).rlike("^[0-9a-f]{10,}$"), 30).otherwise(0)
    )
    return F.when(n >= 7, F.least(F.lit(1.0), points / 100)).otherwise(0.0)


def generated_family(label: Column) -> Column:
    n, digits = F.length(label), F.regexp_count(label, F.lit("[0-9]"))
    return (
        F.when(F.lower(label).rlike("^[0-9a-f]{10,}$"), "Hash-based DGA")
        .when((digits >= 4) | (digits / n >= 0.35), "Hex/Alphanumeric DGA")
        .when(longest_consonants(label) >= 5, "Conficker/Mirai-like DGA")
        .otherwise("High-Entropy Random")
    )


def transliterated(text: Column) -> Column:
    """Look-alike letters replaced by the Latin ones they stand for."""
    return F.replace(F.translate(F.lower(text), "".join(LOOKALIKES), "".join(LOOKALIKES.values())), F.lit("vv"), F.lit("w"))


def zero_width_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, ZERO_WIDTH, ""))


def mixed_scripts(host: Column) -> Column:
    """Letters of two scripts in one host, or punycode."""
    latin, other = host.rlike("[a-zA-Z]"), host.rlike(r"[\p{IsCyrillic}\p{IsGreek}]")
    return (latin & other) | F.lower(host).contains("xn--")


def decoded_base64(text: Column) -> Column:
    """The bytes as they are taken for UTF-8; null where it is no base64."""
    return F.try_to_binary(text, F.lit("base64")).cast("string")


def decoded_wide(text: Column) -> Column:
    """Base64 of UTF-16LE, without outer blanks; what is no character becomes U+FFFD. Null where it is no base64."""
    unit = "[0-9A-F]{2}"
    paired = rf"(?:{unit}D[89AB]{unit}D[C-F]|{unit}(?:D[0-7]|[0-9A-CEF][0-9A-F]))"
    raw = F.hex(F.try_to_binary(text, F.lit("base64")))
    valid = F.regexp_replace(raw, rf"\G((?:{paired})*+)(?:{unit}D[89A-F]|{unit}$)", "$1FDFF")
    return F.trim(F.decode(F.unhex(valid), "UTF-16LE"))


def masked(secret: Column) -> Column:
    """The first two and last two characters, stars between; all stars up to six characters."""
    n = F.length(secret)
    return F.when(n <= 6, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(secret, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(secret, F.lit(2))))
