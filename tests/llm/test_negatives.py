"""Hard negatives against brute force in Python's integers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tracewright.llm import negatives

VEC = "vec_id long, label int, embedding array<double>, score string, place int"


def brute(rows):
    """Rows are (id, label, vector); of equal ids the smallest stands for all."""
    by_id = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            by_id[i] = min(by_id.get(i, (label, v)), (label, v))
    comps = {i: [math.floor(Fraction(x) * 256) for x in v] for i, (_, v) in by_id.items()}
    out = []
    for a in by_id:
        if a % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(comps[a], comps[i])), i) for i in by_id if i != a and len(comps[i]) == len(comps[a])))
        for loss, p in [(s, i) for s, i in scored if by_id[i][0] == by_id[a][0]][:5]:
            kept = [(s, i) for s, i in scored if by_id[i][0] != by_id[a][0] and 50 * -loss <= 100 * -s <= 95 * -loss][:3]
            out += [(a, p, k + 1, i, -loss, -s) for k, (s, i) in enumerate(kept)]
    long = lambda x: x if -(1 << 63) <= x < 1 << 63 else None
    return sorted((a, p, k, i, long(s), long(t)) for a, p, k, i, s, t in out)


def mined(spark, rows):
    out = negatives.mine(spark.createDataFrame([(i, label, v, "x", 1) for i, label, v in rows], VEC))
    return sorted(((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in out.collect()), key=lambda r: r[:4])


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)  # several tiles a label
    monkeypatch.setattr(negatives, "CANDIDATE_BLOCK", 40)
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, 7]), [rng.choice([rng.gauss(0, 0.2), 0.25, -0.5]) for _ in range(6)]) for i in range(400)]
    rows += [(i, 1, [0.5] * 6) for i in range(400, 460)] + [(i, 2, [0.35] * 6) for i in range(460, 500)]  # ties
    want = brute(rows)
    assert len(want) > 50 and mined(spark, rows) == want


def test_large_components(spark):
    rng = random.Random(4)
    size = lambda i: {50: 1e300, 51: 1e300, 52: 1e300, 100: 1e18, 101: 1e18, 102: 1e18}.get(i) or rng.choice([1.0, 1.0, 3.0, 1e3, 1e6])
    rows = [(i, i % 3, [x * rng.uniform(-0.2, 1) for _ in range(3)]) for i in range(300) for x in [size(i)]] + [(i, 0, [-(2.0**k), 0.5, 0.1]) for i, k in zip(range(300, 330), range(-4, 60, 2))]
    want = brute(rows)
    assert any(r[4] is None for r in want) and any(r[4] is not None for r in want)
    assert mined(spark, rows) == want


def test_odd_rows(spark):
    rows = [(0, 1, [0.5, 0.5]), (0, 1, [0.5, 0.5]), (0, 2, [9.0, 9.0]), (None, 1, [0.5, 0.5]), (1, None, [0.5, 0.5]), (2, 1, None), (3, 1, [0.5, None]), (4, 1, [float("nan"), 0.1]), (5, 1, [float("inf"), 0.1]), (6, 1, [0.5]), (50, 2, []), (51, 2, []), (52, 3, [])]
    rows += [(i, 1 + i % 2, [0.5, 0.25 + i / 100]) for i in range(7, 30)] + [(30, 1, [0.5, 0.32])] * 3
    want = brute(rows)
    assert {r[0] for r in want} == {0, 50} and mined(spark, rows) == want
    assert mined(spark, []) == []


@pytest.mark.parametrize("dtype,top", [(np.int64, 300), (np.int64, 1 << 20), (object, 1 << 90)])
def test_packed_products_are_exact(dtype, top):
    rng = random.Random(top)
    a, c = (np.array([[rng.randrange(-top, top) for _ in range(48)] for _ in range(n)], dtype=dtype) for n in (7, 515))
    packed = negatives.Packed(c, int(np.abs(a).max()))
    assert (packed.scores(a).astype(object) == a.astype(object) @ c.astype(object).T).all()
    assert packed.fields > 1 or top == 1 << 20


def test_places_stand_in_order():
    numbers = sorted([0, 1, -1, 255, 256, -255, -256, -257, 1 << 64, -(1 << 64), 10**300, -(10**300), 65535, -65536])
    places = [negatives.place_of(n) for n in numbers]
    assert places == sorted(places) and [negatives.score_of(p) for p in places] == numbers
