"""Similarity joins and searches against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewright.llm import collisions, components, jaccard, neighbours

VEC = "vec_id long, embedding array<float>, label int, node string"


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def closed(nodes, links):
    parent = {i: i for i in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in nodes}


def brute(rows):
    s = sets_of(rows)
    ids = sorted(s)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    roots = closed(ids, links)
    return {i: (len(s[i]), roots[i]) for i in ids}


def test_jaccard_against_brute_force(spark, docs_of):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(60)]
    rows, i = [], 0
    for size in (3, 5, 6, 8, 9, 13, 30, 31, 33, 64, 130, 300):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(5):
                t = list(base)
                for _ in range(rng.randrange(0, max(1, size // 40) + 2)):
                    t[rng.randrange(len(t))] = rng.choice(words)
                rows.append((i, " ".join(t)))
                i += 1
    for _ in range(40):  # texts that are mostly one passage: frequent signatures, some links
        t = passage + [rng.choice(words) for _ in range(rng.randrange(2, 40))]
        rows.append((i, " ".join(t)))
        i += 1
    base = [rng.choice(words) for _ in range(150)]
    for k in range(40):  # a group of near copies larger than a signature's group
        t = list(base)
        t[k] = f"x{k}"
        rows.append((i, " ".join(t).upper() if k % 2 else "\t".join(t)))
        i += 1
    rng.shuffle(rows)
    want = brute(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs_of([(a, t, None, None) for a, t in rows]).repartition(4)).collect()}
    assert got == want


def test_jaccard_odd_rows(odd, empty):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(odd).collect()), key=str)
    assert [g for g in got if g[0] in (1, 2)] == [(1, 0, 1), (2, 0, 2)]
    assert [g for g in got if g[0] in (4, 5)] == [(4, 1, 4), (5, 1, 4), (5, 1, 4)]
    assert (None, 1, None) in got and len(got) == 8
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_null_id_before_its_copies(docs_of):
    text = " ".join(f"w{i}" for i in range(60))
    docs = docs_of([(None, text, None, None), (7, text, None, None), (3, text + " more", None, None), (9, text, None, None), (1, "other words", None, None)]).coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert got == {None: 3, 7: 3, 3: 3, 9: 3, 1: 1}


def test_jaccard_of_one_id_with_several_texts(docs_of):
    text = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(9, text[0]), (9, text[1]), (9, text[1]), (9, text[1] + " more"), (4, text[0] + " more"), (7, text[1] + " less"), (8, text[2])] + [(3, text[2] + " x")] * 3
    for parts in (1, 3):
        docs = docs_of([(i, t, None, None) for i, t in rows]).repartition(parts, "doc_id", "text")
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect())
        assert got == sorted([(9, 56, 4), (9, 56, 7), (9, 56, 7), (9, 57, 7), (4, 57, 4), (7, 57, 7), (8, 56, 3)] + [(3, 57, 3)] * 3)


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    for n in (4, 5, 7, 8, 15, 16, 40, 127, 128, 500):
        for _ in range(20):
            s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            k = jaccard.most_different(len(s))
            gone = int(rng.integers(0, k + 1))
            t = np.unique(np.concatenate([s[gone // 2 :], rng.integers(0, 1 << 63, gone - gone // 2, dtype=np.uint64)]))
            both = len(np.intersect1d(s, t))
            if 100 * both < 80 * (len(s) + len(t) - both):
                continue
            mine, theirs = ({x for b in jaccard.bands(len(v)) for x in jaccard.signatures(v, b)[0].tolist()} for v in (s, t))
            assert mine & theirs
            assert sum(int(a ^ b).bit_count() for a, b in zip(jaccard.sketch(s).view("<u8").tolist(), jaccard.sketch(t).view("<u8").tolist())) <= len(s) + len(t) - 2 * both


@pytest.mark.parametrize("per_task", [7, 100_000])
def test_components(spark, per_task):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(3), per_task).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    want = closed(nodes, [e for e in edges if e[0] != e[1]])
    assert set(got) == nodes
    for x in nodes:
        assert {got[y] for y in nodes if want[y] == want[x]} == {got[x]}
    assert len(set(got.values())) == len(set(want.values()))
    assert components.components(spark.createDataFrame([], "a long, b long"), per_task).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], VEC)


def some_vectors(seed=2, n=300, dim=12):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)], i % 3) for i in range(n)]
    for k in range(40):  # near and exact copies
        i, v, label = rows[k]
        rows.append((n + k, [float(np.float32(x * (1 + 0.05 * (k % 4) * rng.normal()))) for x in v], label))
    nan, inf = float("nan"), math.inf
    bad = [None, [], [0.0] * dim, [nan] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [inf] * dim]
    return rows + [(1000 + 20 * k, v, 1) for k, v in enumerate(bad)] + [(2000, [1.0, 2.0], 1), (2001, [1.0, 2.0], 1), (2002, [1.0] * dim, None), (2003, [1.0] * dim, None)]


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def in_order(v, w):
    total = 0.0
    for a, b in zip(v.tolist(), w.tolist()):
        total += a * b
    return total


def test_nearest_against_brute_force(spark):
    rows = [(i, v, label) for i, v, label in some_vectors()]
    good = [(i, np.array(v)) for i, v, _ in rows if usable(v)]
    df = vectors(spark, rows)
    got = [tuple(r) for r in neighbours.search(df, df.filter("vec_id % 20 = 0"), 7).orderBy("query_id", "rank").collect()]
    want = []
    for i, v in good:
        if i % 20 == 0:
            near = sorted((-in_order(v, w), j) for j, w in good if j != i and len(w) == len(v))[:7]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(near, 1)]
    assert got == sorted(want)


def test_nearest_ties_repeats_and_empty(spark):
    rows = [(0, [1.0, 0.0], 1)] + [(i, [1.0, 1.0], 1) for i in (9, 3, 5, 3)] + [(20, [0.0, 1.0], 1)]
    df = vectors(spark, rows)
    got = [(r["query_id"], r["vec_id"]) for r in neighbours.search(df, df.filter("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 3), (0, 5), (0, 9), (20, 3), (20, 5), (20, 9)]
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def test_nearest_of_repeated_candidates_with_distinct_scores(spark):
    rng = np.random.default_rng(8)
    rows = [(0, [1.0] + [0.0] * 7, 1)] + [(i, [float(40 - i), *map(float, rng.normal(size=7).astype(np.float32))], 1) for i in range(1, 16)]
    rows += [rows[1]] * 6 + [rows[2]] * 9 + [(3, [float(10 + k)] + [0.0] * 7, 1) for k in range(9)]
    df = vectors(spark, rows)
    got = [(r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(df, df.filter("vec_id = 0"), 5).orderBy("rank").collect()]
    assert got == [(i, i, 40.0 - i) for i in range(1, 6)]
    got = [r["vec_id"] for r in neighbours.search(df, df.filter("vec_id = 0"), 20).orderBy("rank").collect()]
    assert got == list(range(1, 16))


def test_tiles_keep_all_that_bounds_allow():
    rng = np.random.default_rng(4)
    q, c = rng.normal(size=(9, 16)), rng.normal(size=(500, 16))
    c[::7] = c[0]
    ids = np.arange(500)
    for query, near, score in neighbours.tile(np.arange(1000, 1009), q, ids, c, 20):
        s = neighbours.inner(np.repeat(q[query - 1000][None], 500, 0), c)
        want = sorted(zip(-s, ids))[:20]
        assert near.tolist() == [i for _, i in want] and score.tolist() == [-x for x, _ in want]


@pytest.mark.parametrize("norm", [1e8, 1e-320, 1e-200, 1e200])
def test_nearest_of_large_and_tiny_vectors(norm):
    rng = np.random.default_rng(9)
    q = rng.integers(-3, 4, size=(3, 6)) + 0.5
    c = (rng.integers(-127, 128, size=(60, 6)) * norm) if norm < 1e150 else rng.normal(size=(60, 6)) * norm
    c[5:20] *= 1e3  # rows of different powers in one block
    c[~c.any(axis=1)] = norm
    ids = np.arange(60)
    for query, near, score in neighbours.tile(np.arange(100, 103), q, ids, c, 7):
        s = neighbours.inner(np.repeat(q[query - 100][None], 60, 0), c)
        want = sorted(zip(-s, ids))[:7]
        assert near.tolist() == [i for _, i in want] and score.tolist() == [-x for x, _ in want]


def test_double_vectors_and_text_labels(spark):
    near, far = math.sqrt(1 - 0.98000001**2), math.sqrt(1 - 0.97999999**2)
    rows = [(1, [1.0, 0.0], "x"), (2, [0.98000001, near], "x"), (3, [1.0, 0.0], "y"), (4, [0.97999999, far], "y"), (5, [1.0, 0.0], None)]
    for i in range(6, 40):
        rows.append((i, [1.0, 0.0], "x"))
    got = {r["vec_id"]: r["n_links"] for r in collisions.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got[3] == got[4] == got[5] == 0 and got[1] in (34, 35) and got[2] in (0, 35)


def test_measured_recall_over_the_given_vectors(spark, tmp_path):
    """The given vectors and a copy of each third one at a cosine from 0.98 on: all links by brute force, and how many of them the query finds."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label")
    rng, rows = np.random.default_rng(14), given.collect()
    for r in rows[::3]:
        v = np.array(r["embedding"], dtype=np.float64)
        side = rng.normal(size=len(v))
        side -= side @ v / (v @ v) * v
        cosine = 0.9801 + 0.0199 * rng.random() ** 2
        v = cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side)
        rows.append(Row(vec_id=r["vec_id"] + 10_000_000, embedding=[float(np.float32(x)) for x in v], label=r["label"]))
    spark.createDataFrame(rows, given.schema).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: r["n_links"] for r in collisions.op5_embedding_near_dedup(spark, str(tmp_path)).collect()}
    want, by = {r["vec_id"]: 0 for r in rows}, {}
    for r in rows:
        if r["label"] is not None and usable(r["embedding"]):
            by.setdefault((r["label"], len(r["embedding"])), []).append(r)
    for own in by.values():
        x = np.array([r["embedding"] for r in own], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        n = (x @ x.T >= 0.98).sum(axis=1) - 1
        for r, k in zip(own, n.tolist()):
            want[r["vec_id"]] = k
    found, total = sum(got.values()), sum(want.values())
    print(f"op5 recall: {found} of {total} link ends over {len(rows)} vectors, {found / total:.4f}")
    assert len(got) == len(rows) and 0.97 * total <= found <= total
    assert all(got[i] <= want[i] for i in want)


def test_embedding_duplicates_against_brute_force(spark):
    rows = some_vectors()
    got = {r["vec_id"]: r for r in collisions.near_duplicates(vectors(spark, rows)).collect()}
    links, count = [], {i: 0 for i, _, _ in rows}
    for k, (i, v, a) in enumerate(rows):
        for j, w, b in rows[k + 1 :]:
            if a is not None and a == b and usable(v) and usable(w) and len(v) == len(w):
                x, y = np.array(v), np.array(w)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((i, j))
                    count[i] += 1
                    count[j] += 1
    want = closed(count, links)
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values())
    assert 0.9 * sum(count.values()) <= found <= sum(count.values())
    assert all(got[i]["n_links"] <= count[i] for i in count)
    assert all(got[i]["component_id"] == want[i] for i in count if count[i] == 0)
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in got.values())


def test_large_cells_are_cut_and_counted_once(spark, monkeypatch):
    monkeypatch.setattr(collisions, "TILE", 16)
    rng = np.random.default_rng(6)
    base = rng.normal(size=8)
    rows = [(i, (base + 0.01 * rng.normal(size=8)).tolist(), 1) for i in range(90)] + [(100 + i, base.tolist(), 1) for i in range(5)]
    got = collisions.near_duplicates(vectors(spark, rows)).collect()
    assert {r["n_links"] for r in got} == {94} and {r["component_id"] for r in got} == {0}
    assert collisions.near_duplicates(vectors(spark, rows).limit(0)).count() == 0


def test_plan_has_its_recall():
    p = collisions.plan(100_000)
    close = collisions._together(p["width"], math.sqrt(2 - 2 * 0.98))
    assert 1 - (1 - close ** p["per_cell"]) ** p["tables"] >= 0.98 and 0 < p["least"] < p["lines"]


def test_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(12)
    n, dim = 3000, 48
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, n, dim)))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.98001 * x + math.sqrt(1 - 0.98001**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(i, v, 1) for i, v in enumerate(np.concatenate([x, y]).tolist())]
    got = {r["vec_id"]: r["n_links"] for r in collisions.near_duplicates(vectors(spark, rows)).collect()}
    assert set(got.values()) == {0, 1} and all(got[i] == got[n + i] for i in range(n))
    assert sum(got.values()) >= (collisions.TARGET - 0.007) * 2 * n
    for size in (6000, 100_000, 10_000_000):
        p, near = collisions.plan(size), math.sqrt(2 - 2 * 0.98)
        d = np.linspace(-collisions.WINDOW, collisions.WINDOW, 20_001)
        first = float(np.trapezoid(np.exp(-d * d / 2) / math.sqrt(2 * math.pi) * (1 - np.abs(d) / collisions.CELL_WIDTH), d))
        assert 1 - (1 - first * collisions._together(p["width"], near) ** (p["per_cell"] - 1)) ** p["tables"] >= collisions.TARGET


def test_norms_beyond_the_range_of_squares(spark):
    rows = [(1, [1e-170, 2e-170], 1), (2, [1e-170, 2.0001e-170], 1), (3, [1.0, 2.0], 1), (4, [1e200, 2e200], 1), (5, [-1e200, 2e200], 1), (6, [5e-324, 1e-323], 1), (7, [1e308, 1.7e308], 1), (8, [2e-170, -1e-170], 1), (9, [1e200, 2e200], 2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in collisions.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (5, 1), 2: (5, 1), 3: (5, 1), 4: (5, 1), 6: (5, 1), 7: (5, 1), 5: (0, 5), 8: (0, 8), 9: (0, 9)}
