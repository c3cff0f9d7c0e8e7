"""Public suffixes: under which names are registered, by rules that a user can give in the public list's own format.

A rule is a suffix (co.uk), a suffix with any label before it (*.ck), or an exception to such a rule (!www.ck). The
exception counts first, else the rule with most labels, else the last label. Rules stand in the plan as hash sets by number
of labels, so a name costs a few lookups and no join; a list of MOST_RULES at most is taken.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MOST_RULES = 50_000

# Suffixes of several labels by top-level domain, wildcards and exceptions, where no list is given; elsewhere the last label is the suffix.
COMMON = {
    "ar": "com edu gob net org", "at": "ac co gv or", "au": "asn com edu gov id net org", "br": "com edu gov net org", "cl": "gob", "cn": "ac com edu gov net org", "co": "com edu gov net org", "ec": "com gob",
    "eg": "com edu gov", "es": "com gob nom org", "fr": "gouv", "gr": "com edu gov net org", "hk": "com edu gov net org", "id": "ac co go or", "il": "ac co gov net org", "in": "ac co gov net org", "jp": "ac ad co ed go gr lg ne or",
    "ke": "ac co go or", "kr": "ac co go ne or", "mx": "com edu gob net org", "my": "com edu gov net org", "ng": "com edu gov net org", "nz": "ac co geek govt net org school", "pe": "com gob", "ph": "com edu gov net org",
    "pk": "com edu gov net org", "pl": "com edu gov net org", "pt": "com gov org", "sa": "com edu gov net org", "sg": "com edu gov net org", "th": "ac co go in or", "tr": "com edu gov net org", "tw": "com edu gov net org",
    "ua": "com edu gov net org", "uk": "ac co gov ltd me net nhs org plc police sch", "ve": "com gob", "vn": "com edu gov net org", "za": "ac co gov net org",
}
WILDCARDS = ["*.bd", "*.ck", "!www.ck", "*.er", "*.fk", "*.jm", "*.kh", "*.mm", "*.np", "*.pg", "*.kawasaki.jp", "!city.kawasaki.jp", "*.kobe.jp", "!city.kobe.jp"]


@dataclass(frozen=True)
class SuffixRules:
    """Rules without their marks, as plain suffixes, what stands behind *., and exceptions."""

    plain: frozenset[str]
    wildcard: frozenset[str]
    exception: frozenset[str]

    def of(self, kind: str, labels: int) -> list[str]:
        return sorted(r for r in getattr(self, kind) if r.count(".") + 1 == labels)

    @property
    def most_labels(self) -> int:
        return max([1, *(r.count(".") + 1 for r in self.plain | self.exception), *(r.count(".") + 2 for r in self.wildcard)])


def parsed_rules(lines: Iterable[str]) -> SuffixRules:
    """Rules of lines; comments (//), empty lines and what follows a blank are left out. Names beyond ASCII are kept in both forms."""
    kinds: dict[str, set[str]] = {"plain": set(), "wildcard": set(), "exception": set()}
    for line in lines:
        rule = (line.split() or [""])[0].lower().rstrip(".")
        if not rule or rule.startswith("//"):
            continue
        kind, name = ("exception", rule[1:]) if rule.startswith("!") else ("wildcard", rule[2:]) if rule.startswith("*.") else ("plain", rule)
        kinds[kind].add(name)
        if not name.isascii():
            kinds[kind].add(".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in name.split(".")))
    return SuffixRules(*(frozenset(kinds[k]) for k in ("plain", "wildcard", "exception")))


DEFAULT = parsed_rules([f"{second}.{top}" for top, seconds in COMMON.items() for second in seconds.split()] + WILDCARDS)


def read_rules(spark: SparkSession, path: str) -> SuffixRules:
    """Rules of a file in the public list's format."""
    lines = [r[0] for r in spark.read.text(path).filter(F.trim("value").rlike("^[^/\\s]")).limit(MOST_RULES + 1).collect()]
    if len(lines) > MOST_RULES:
        raise ValueError(f"{path} has more than {MOST_RULES} rules")
    return parsed_rules(lines)


def _cases(name: Column, rules: SuffixRules) -> list[tuple[Column, int]]:
    """Conditions in their order, and the number of labels of the suffix where one holds first."""
    size = F.size(F.split(name, r"\."))
    tail = lambda n: F.substring_index(name, ".", -n)
    found = [(tail(n).isin(listed), n - 1) for n in range(rules.most_labels, 1, -1) if (listed := rules.of("exception", n))]
    for n in range(rules.most_labels, 1, -1):
        met = [tail(n).isin(listed)] if (listed := rules.of("plain", n)) else []
        if listed := rules.of("wildcard", n - 1):
            met.append((size >= n) & tail(n - 1).isin(listed))
        if met:
            found.append((reduce(lambda a, b: a | b, met), n))
    return found


def suffix_labels(name: Column, rules: SuffixRules | None = None) -> Column:
    """Number of labels of a name's public suffix."""
    return reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(_cases(name, rules or DEFAULT)), F.lit(1))


def registered(name: Column, rules: SuffixRules | None = None) -> Column:
    """The suffix and one label more; a name that is a suffix is itself."""
    return reduce(lambda rest, x: F.when(x[0], F.substring_index(name, ".", -x[1] - 1)).otherwise(rest), reversed(_cases(name, rules or DEFAULT)), F.substring_index(name, ".", -2))
