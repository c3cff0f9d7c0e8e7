"""Running values of busy keys, cut into runs, against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators import cloud, processes, scans, timeline


@pytest.fixture
def rows(spark):
    rng = random.Random(11)
    made = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i // 3, i, rng.choice([None, None, f"v{i}"])) for i in range(1200)] + [("lone", 1, 5000, None)]
    rng.shuffle(made)
    return spark.createDataFrame(made, "k string, t long, n long, v string")


@pytest.mark.parametrize("most", [0, 1 << 30])
def test_against_windows(spark, rows, monkeypatch, most):
    monkeypatch.setattr(scans, "HOT_ROWS", most)
    w = Window.partitionBy("k").orderBy("t", "n")
    want = rows.select("k", "n", F.lag("v").over(w).alias("lag"), F.lead("v").over(w).alias("lead"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last"))
    got = scans.last_known(scans.led(scans.lagged(rows, ["k"], ["t", "n"], F.col("v"), "lag"), ["k"], ["t", "n"], F.col("v"), "lead"), ["k"], ["t", "n"], "v", "last")
    assert got.columns == [*rows.columns, "lag", "lead", "last"]
    as_set = lambda df: sorted(map(tuple, df.select("k", "n", "lag", "lead", "last").collect()), key=repr)
    assert as_set(got) == as_set(want)


def test_busy_keys_are_spread(spark, rows, monkeypatch):
    monkeypatch.setattr(scans, "HOT_ROWS", 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged, _ = scans._runs(rows, ["k"], ["t", "n"])
        sizes = [r["count"] for r in ranged.filter("k = 'hot'").groupBy("_run").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 3 and max(sizes) < 0.5 * sum(sizes)


def test_detections_do_not_depend_on_the_way(spark, monkeypatch):
    rng = random.Random(12)
    t = lambda: 1_700_000_000 + rng.randrange(4000)
    stamp = lambda df, *cs: df.withColumns({c: F.timestamp_seconds(c) for c in cs})
    line = stamp(spark.createDataFrame([("e" if i % 5 else "f", t(), "s", i) for i in range(300)], "entity string, ts long, source string, ref long"), "ts")
    logins = stamp(spark.createDataFrame([("u" if i % 6 else "v", t(), rng.choice("ABC"), i) for i in range(300)], "user string, ts long, country string, record_id long"), "ts")
    events = stamp(spark.createDataFrame([(i, i % 3 // 2, t(), rng.choice([None, "", "g1", "g2", "g9"])) for i in range(200)], "id long, pid long, ts long, guid string"), "ts")
    starts = stamp(spark.createDataFrame([(f"p{i}", i % 2, t() + 600, rng.choice(["g1", "g2", "", None])) for i in range(40)], "name string, pid long, ts long, guid string"), "ts")

    def all_of():
        return [sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr) for df in (timeline.deltas(line), cloud.impossible_travel(logins), processes.attached(events, starts, ["pid"], "ts", "name", "process", "guid"))]

    windows = all_of()
    monkeypatch.setattr(scans, "HOT_ROWS", 0)
    assert all_of() == windows and len(windows[2]) == 200
    by_guid = {r["guid"]: r["n"] for r in starts.filter("guid > ''").groupBy("guid").agg(F.max_by("name", F.struct("ts", "name")).alias("n")).collect()}
    first = {r["pid"]: r["n"] for r in starts.groupBy("pid").agg(F.min_by("name", F.struct("ts", "name")).alias("n")).collect()}
    plain = [(r["name"], r["pid"], r["ts"]) for r in starts.collect()]
    for r in processes.attached(events, starts, ["pid"], "ts", "name", "process", "guid").collect():
        started = max(((s, n) for n, pid, s in plain if pid == r["pid"] and s <= r["ts"]), default=(None, first[r["pid"]]))[1]
        assert r["process"] == by_guid.get(r["guid"], started)
