"""Registered domains against a plain reading of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import domains, suffixes

LIST = ["// c", "com", "uk", "co.uk", "*.ck", "!www.ck", "a.b.c.d", "*.b.c.d", "!x.b.c.d", "*.x.y", "y", "ü.y", "jp", "*.kobe.jp", "!city.kobe.jp"]


def plain(name, rules):
    """The public list's own algorithm, rule by rule."""
    labels = name.split(".")
    best, exact = 1, None
    for kind in ("plain", "wildcard", "exception"):
        for rule in getattr(rules, kind):
            own = rule.split(".")
            own = ["*", *own] if kind == "wildcard" else own
            tail = labels[-len(own) :]
            if len(tail) == len(own) and all(r in ("*", x) for r, x in zip(own, tail)):
                if kind == "exception":
                    exact = len(own) - 1
                else:
                    best = max(best, len(own))
    return ".".join(labels[-(exact or best) - 1 :])


@pytest.mark.parametrize("rules", [suffixes.parsed_rules(LIST), suffixes.DEFAULT])
def test_against_plain_rules(spark, rules):
    rng = random.Random(7)
    parts = ["a", "b", "c", "d", "x", "y", "www", "ck", "co", "uk", "kobe", "jp", "city", "com", "org", "au", "xn--tda", "kawasaki"]
    names = sorted({".".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(3000)})
    names += [f"{left}{r}" for r in (*rules.plain, *rules.exception) for left in ("", "q.", "p.q.")]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: (r["apex"], r["k"]) for r in df.select("n", suffixes.registered(F.col("n"), rules).alias("apex"), suffixes.suffix_labels(F.col("n"), rules).alias("k")).collect()}
    assert {n: a for n, (a, _) in got.items()} == {n: plain(n, rules) for n in names}
    assert all(a == ".".join(n.split(".")[-k - 1 :]) for n, (a, k) in got.items())


def test_names_of_many_countries(spark):
    want = {"a.b.org.nz": "b.org.nz", "x.d.gob.mx": "d.gob.mx", "www.paypal.co.uk": "paypal.co.uk", "sub.example.com": "example.com", "a.www.ck": "www.ck", "a.b.c.ck": "b.c.ck", "co.uk": "co.uk", "localhost": "localhost", "10.1.2.3": "10.1.2.3", "": ""}
    df = spark.createDataFrame([(n,) for n in want], "n string")
    assert {r["n"]: r["a"] for r in df.select("n", domains.registered_domain(F.col("n")).alias("a")).collect()} == want


def test_list_of_a_user_reaches_callers(spark, tmp_path):
    from tracewright.operators import messages

    (tmp_path / "list").write_text("// mine\ncorp.example // remark\n\n*.w\n")
    rules = suffixes.read_rules(spark, f"file://{tmp_path}/list")
    auth = spark.createDataFrame([("m", "a.one.corp.example", "pass", "b.two.corp.example")], "message_key string, from_domain string, spf string, spf_domain string")
    none = spark.createDataFrame([], "message_key string, domain string, result string")
    assert [messages.dmarc(auth, none, suffixes=r).first()["dmarc_pass"] for r in (None, rules)] == [True, False]
    urls = spark.createDataFrame([("k", "http://a.corp.example/", "b.corp.example")], "k string, url string, anchor string")
    assert [messages.link_report(urls, "k", r).first()["flags"] for r in (None, rules)] == [[], ["ANCHOR_URL_MISMATCH"]]
    with pytest.raises(ValueError):
        suffixes.MOST_RULES, most = 1, suffixes.MOST_RULES
        try:
            suffixes.read_rules(spark, f"file://{tmp_path}/list")
        finally:
            suffixes.MOST_RULES = most
