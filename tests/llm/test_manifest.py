"""The Merkle manifest against a tree built in Python."""

import hashlib
import zlib

import pytest

from tracewright.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def lower(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, at):
    for nodes in tree[:-1]:
        run = at - at % 8
        yield nodes[run:at], nodes[at + 1 : run + 8]
        at //= 8


def brute(rows):
    """Rows are (doc_id, text, lang, source, n_chars)."""
    langs = {}
    for d, t, lang, source, n in rows:
        leaf = h(*map(field, (d, source, lang, n, t)))
        other = h(*map(field, (d, source, lang, n, lower(t)))) if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else leaf
        langs.setdefault(lang, []).append((d is not None, d or 0, leaf, other, d))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([r[2] for r in sorted(langs[x])]) for x in names}
    top = levels([trees[x][-1][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for i, (_, _, leaf, other, d) in enumerate(sorted(langs[x])):
            steps = [*path(trees[x], i), *path(top, k)]
            node = other
            for before, after in steps:
                node = h(*before, node, *after)
            out.append((d, leaf, trees[x][-1][0], top[-1][0], h(*(s for b, a in steps for s in b + a)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("height", [1, 2, 4])
def test_against_brute_force(spark, docs_of, height):
    rows = [(i, f"Text {i % 40} Ä {'x' * (i % 7)}", "en" if i % 3 else ["de", "fr", "ñ", "", None, "zz"][i % 18 // 3], ["a", None][i % 2]) for i in range(700)]
    rows += [(900 + i, "One", f"lang{i}", "b") for i in range(70)] + [(5000, "ALONE", "alone", "b")]  # more languages than a superblock of height 1 holds
    want = brute([(*r, len(r[1])) for r in rows])
    got = rows_of(manifest.manifest(docs_of(rows).repartition(5), height))
    assert got == want
    assert 0 < sum(not r[-1] for r in got) < len(got) / 2


def test_one_document(spark, docs_of):
    df = manifest.manifest(docs_of([(1, "Text", None, None)]))
    assert rows_of(df) == brute([(1, "Text", None, None, 4)])
    assert df.first()["proof_sha256"] == h()


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in odd.collect()]
    assert rows_of(manifest.manifest(odd)) == brute(rows)
    assert manifest.manifest(empty).count() == 0
