"""N-gram Jaccard join by PartEnum signatures.

A document's features are its distinct five-word shingles. Sets of sizes from 2^g to 2^(g+1) - 1 are one
band; a set also enters the next band when its partners may be there. In a band the feature domain is cut
into a fixed number of parts; a signature is the exact content of one part of the set. Two linked sets differ in
at most k = n / 4 features (n: the size of either), hence in at most k parts, so among the k + 1
parts with most features, by one order over all signatures, they share one. We emit SPARE signatures more:
then a link is seen although SPARE of the signatures are ignored for being too frequent.

A signature of up to GROUP sets gives their pairs. A frequent one gives none; its sets count how many of
theirs are frequent, and only those that have more than they can spare take the exact way: each is checked
against one set of each of its frequent groups, CENTRES times more against others, and then all pairs of such
sets that are not in one component yet. Parity sketches, whose difference never exceeds that of the sets, refuse most false pairs;
the others are verified on the whole shingle sets: first each set with its smallest partner, then only
pairs that lead from one component to another. Equal sets are one node throughout.

Sets are known by 64-bit hashes of sorted 64-bit shingle hashes, words by hashes with keys that each run draws anew, so
that nobody can make words that meet. Nothing is sampled or capped.

Defined results: null or empty texts have no shingle and link with nothing; fewer than five words are one
shingle; repeated rows are equal sets, so they share a component; rows of one doc_id with different texts have a
set each and the component of each; an empty table gives no row; a null doc_id is an id like any other but never
names a component while another id is there. Long texts are read step by step.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_keys, keyed_hashes, lower_ascii, mix, read, staged, steps, within, word_spans
from .components import components, smallest_member

WORDS = 5
PERCENT = 80
SPARE = 8
GROUP = 8
#: Times that hidden sets are checked against one set of each of their groups before all pairs are.
CENTRES = 2
#: Sets that a task remembers so as not to emit the signatures of equal ones again.
REMEMBERED_SETS = 200_000

_FACTORS = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of WORDS words."""
    n = max(0, len(words) - WORDS + 1)
    whole = np.zeros(n, np.uint64)
    for i in range(WORDS):
        whole += words[i : i + n] * _FACTORS[i]
    return mix(whole)


def shingle_sets(data: np.ndarray, at: np.ndarray, before: list[np.ndarray] | None = None, more: bool = False, keys: np.ndarray = hash_keys(0)) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row. A row that goes on (more) leaves its own in `before`, which its next step takes up."""
    lower = lower_ascii(data)
    start, end, rows = word_spans(lower, at)
    words = keyed_hashes(lower, start, end, keys)
    if more or before:
        last, found = before or (words[:0], words[:0])
        words = np.concatenate([last, words])
        found = np.unique(np.concatenate([found, _shingles(words)]))
        before[:] = [words[-(WORDS - 1) :], found] if more else []
        if not more:
            yield found if len(found) else _few(words)
        return
    whole = _shingles(words)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        yield np.unique(whole[a : b - WORDS + 1]) if b - a >= WORDS else _few(words[a:b])


def _few(words: np.ndarray) -> np.ndarray:
    """Fewer than WORDS words: one shingle, or none without any."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return mix(np.array([(words * _FACTORS[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))], dtype=np.uint64))


def sets_of(batches: Iterable[pa.RecordBatch], seed: int = 0) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of the batches with the shingle sets of their texts."""
    before: list[np.ndarray] = []
    keys = hash_keys(seed)
    for batch, data, at, more in steps(batches, "text"):
        found = list(shingle_sets(data, at, before, more, keys))
        if not more:
            yield batch, found


def set_id(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else 0


def most_different(n: int) -> int:
    """Features in which a set of n and one that it links with differ at most, whichever is larger."""
    return n * (100 - PERCENT) // PERCENT


def _parts(band: int) -> int:
    return 7 * (1 << band) // 10 + 2 * SPARE


def signatures(s: np.ndarray, band: int) -> tuple[np.ndarray, int]:
    """Signatures of a sorted set in a band, and how many of them may be ignored (below 0: the guarantee fails)."""
    parts = np.uint64(_parts(band))
    part = ((s >> np.uint64(32)) * parts) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    size = np.diff(np.append(first, len(s)))
    content = np.add.reduceat(mix(s + np.uint64(band)), first)
    found = mix(content + (part[first] << np.uint64(8)) + np.uint64(band)).astype(np.int64)
    need = most_different(len(s)) + 1
    if len(found) > need + SPARE:
        found = found[np.lexsort((found, -size))[: need + SPARE]]
    spare = len(found) - need
    if spare < 0:  # too few parts have features; two such sets may share none, so all of a band meet here
        found = np.append(found, mix(np.array([band], dtype=np.uint64)).astype(np.int64))
    return found, spare


def bands(n: int) -> list[int]:
    own = n.bit_length() - 1
    return [own, own + 1] if n * 100 // PERCENT >= 1 << (own + 1) else [own]


SETS = "doc_id long, n long, node long, own array<long>, own_spare int, next array<long>, next_spare int"


def document_signatures(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Per document its set's size and id, and its signatures, which equal sets of one task have once, with a document that has an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, found_sets in sets_of(batches, seed):
            sizes, nodes, lists, spares = [], [], ([], []), ([], [])
            known = batch.column("doc_id").is_valid().to_pylist()  # the others take no part in links
            for has_id, s in zip(known, found_sets):
                n, node = len(s), set_id(s)
                sizes.append(n)
                nodes.append(node)
                new = has_id and n * 100 // PERCENT > n and node not in seen  # smaller sets link with equal ones only
                if new:
                    if len(seen) >= REMEMBERED_SETS:
                        seen.clear()
                    seen.add(node)
                for i, band in enumerate((*bands(n), None)[:2] if new else (None, None)):
                    found, spare = signatures(s, band) if band is not None else (None, None)
                    lists[i].append(found)
                    spares[i].append(spare)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(lists[0], kind), pa.array(spares[0], pa.int32()), pa.array(lists[1], kind), pa.array(spares[1], pa.int32())],
                names=["doc_id", "n", "node", "own", "own_spare", "next", "next_spare"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def _grouped(rows: DataFrame) -> DataFrame:
    """From rows (sig, node, inst) sorted within their task: pairs a < b of small groups (inst null), and rows (sig as a, node as b, inst) of frequent ones.

    A task holds one batch and at most GROUP rows of the group that goes on in the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        held, frequent = (empty, empty, empty), None

        def emit(sig, node, inst, last: bool):
            nonlocal held, frequent
            out_a, out_b, out_i = [], [], []
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node, inst = sig[new], node[new], inst[new]
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else empty
            size = np.diff(np.append(first, len(sig)))
            big = size > GROUP
            if frequent is not None and len(sig) and sig[0] == frequent:
                big[0] = True
            keep = len(sig)
            if len(sig) and not last:
                if big[-1]:
                    frequent = sig[-1]
                else:
                    keep, frequent = first[-1], None
                    held = (sig[keep:], node[keep:], inst[keep:])
            if last or keep == len(sig):
                held = (empty, empty, empty)
            size_of = np.repeat(size, size)[:keep]
            in_big = np.repeat(big, size)[:keep]
            k = np.flatnonzero(in_big)
            out_a.append(sig[k])
            out_b.append(node[k])
            out_i.append(inst[k])
            left = np.repeat(first + size, size)[:keep]  # where the group ends
            at = np.flatnonzero(~in_big & (size_of > 1))
            for gap in range(1, GROUP):
                at = at[at + gap < left[at]]
                if not len(at):
                    break
                x, y = node[at], node[at + gap]
                out_a.append(np.minimum(x, y))
                out_b.append(np.maximum(x, y))
                out_i.append(np.full(len(at), -1000, np.int64))
            a, b, i = map(np.concatenate, (out_a, out_b, out_i))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(i.astype(np.int32), mask=i == -1000)], names=["a", "b", "inst"])

        for batch in batches:
            columns = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            yield emit(*columns, False)
        if len(held[0]):
            yield emit(*held, True)

    return rows.mapInArrow(run, "a long, b long, inst int")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b whose sets are similar enough. sets: node, s (packed hashes). Only sets that pairs name are shuffled."""
    pairs = staged(pairs, "pairs", small=True)
    needed = lambda c: within(staged(pairs.select(F.col(c).alias("node")).distinct(), "needed", small=True), sets.select("node", "s"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), dtype="<u8") for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(needed("a").select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(needed("b").select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


#: Words of 64 parity bits in a sketch: two sets differ in at least as many features as their sketches in bits.
SKETCH = 8


def sketch(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _packed_sets(docs: DataFrame, seed: int) -> DataFrame:
    """node, n, s (packed hashes) and a sketch, w0 and on, for texts (node, text) that are of their node: rows of one id may be of others. A task gives a node once."""
    names = ["node", "n", "s", *(f"w{i}" for i in range(SKETCH))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, found in sets_of(batches, seed):
            keep = []
            for node, s in zip(batch.column("node").to_pylist(), found):
                keep.append(node not in seen and set_id(s) == node)
                if keep[-1] and len(seen) < REMEMBERED_SETS:
                    seen.add(node)
            batch, found = batch.filter(pa.array(keep, pa.bool_())), [s for s, k in zip(found, keep) if k]
            if not found:
                continue
            words = np.stack([sketch(s) for s in found])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(map(len, found), pa.int64()), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary()), *(pa.array(w) for w in words.T.copy())], names=names)

    return docs.select("node", "text").mapInArrow(run, "node long, n long, s binary, " + ", ".join(f"w{i} long" for i in range(SKETCH)))


def _sketched(rows: DataFrame, sets: DataFrame, node: str, mark: str) -> DataFrame:
    """rows with the size and sketch of a node, their names marked."""
    return rows.join(sets.select(F.col("node").alias(node), *(F.col(c).alias(mark + c) for c in ("n", *(f"w{i}" for i in range(SKETCH))))), node)


def _may_link(x: str, y: str) -> Column:
    """Whether two sketches allow a link; a link is never refused."""
    differ = sum((F.bit_count(F.col(f"{x}w{i}").bitwiseXOR(F.col(f"{y}w{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col(f"{x}w0").bitwiseXOR(F.col(f"{y}w0"))))
    return differ * (100 + PERCENT) <= (F.col(f"{x}n") + F.col(f"{y}n")) * (100 - PERCENT)


def links(docs: DataFrame, known: DataFrame, seed: int = 0) -> DataFrame:
    """Edges between nodes (distinct sets) that join all linked ones. known: staged document_signatures(docs), with the same seed."""
    spark = docs.sparkSession
    rows = known.filter("own is not null").select("node", F.explode(F.array(F.struct(F.col("own").alias("sig"), (F.col("own_spare") * 2).alias("inst")), F.struct(F.col("next").alias("sig"), (F.col("next_spare") * 2 + 1).alias("inst")))).alias("x"))
    rows = rows.select(F.explode("x.sig").alias("sig"), "node", F.col("x.inst").alias("inst"))
    found = staged(_grouped(rows.repartition("sig").sortWithinPartitions("sig", "node")), "groups")
    pairs = found.filter("inst is null").select("a", "b")

    # The exact way for sets that have more frequent signatures than they can spare.
    frequent = found.filter("inst is not null").select(F.col("a").alias("sig"), F.col("b").alias("node"), "inst")
    tight = frequent.groupBy("node", "inst").agg(F.count("*").alias("c")).filter(F.col("c") > F.shiftright("inst", 1)).select("node", "inst")
    tight = staged(frequent.join(tight, ["node", "inst"], "left_semi").select("sig", "node"), "tight", small=True)
    # Each group has a centre of its own, so a set meets as many others as it has frequent signatures.
    centre = tight.groupBy("sig").agg(F.min_by("node", F.xxhash64("sig", "node")).alias("c"), F.count("*").alias("k")).filter("k > 1").select("sig", "c")
    stars = within(staged(centre, "centres", small=True), tight, "sig", "inner").filter("node <> c").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))

    met = staged(pairs.unionByName(stars).distinct(), "met", small=True)
    nodes = met.select(F.col("a").alias("node")).unionByName(met.select(F.col("b").alias("node"))).distinct()
    home = staged(known.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "homes", small=True)
    texts = within(home.select("doc_id"), docs.select("doc_id", "text"), "doc_id")
    sets = staged(_packed_sets(_with_node(texts, home), seed), "sets")
    if sets.count() > sets.select("node").distinct().count():  # several tasks gave a node, from repeated rows of its id
        sets = staged(sets.dropDuplicates(["node"]), "sets")
    candidates = staged(_sketched(_sketched(met, sets, "a", "x"), sets, "b", "y").filter(_may_link("x", "y")).select("a", "b"), "candidates", small=True)

    first = candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    done = staged(_verified(first, sets), "links", small=True)
    roots = staged(components(done), "roots", small=True)
    rest = candidates.join(first, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        rest = rest.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"_{side}")), side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    done = done.unionByName(staged(_verified(rest.filter("_a <> _b").select("a", "b"), sets), "links", small=True))
    roots = staged(components(done), "roots", small=True)

    def hidden() -> DataFrame:
        """sig, node, root: sets with too many frequent signatures that lead to other components. One within a component hides no link."""
        rooted = frequent.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = rooted.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("sig")
        rooted = staged(within(staged(mixed, "leading", small=True), rooted, "sig"), "mixed", small=True)
        many = rooted.groupBy("node", "inst").agg(F.count("*").alias("c")).filter(F.col("c") > F.shiftright("inst", 1)).select("node", "inst")
        return rooted.join(many, ["node", "inst"], "left_semi").select("sig", "node", "root").distinct()

    def both(x: DataFrame, y: DataFrame) -> DataFrame:
        """Pairs of x and y (staged) with one signature, of two components, that sketches allow."""
        x = _sketched(x, sets, "node", "x").withColumnRenamed("node", "a")
        y = _sketched(y.withColumnRenamed("root", "_root"), sets, "node", "y").withColumnRenamed("node", "b")
        return within(staged(y, "other"), x, "sig", "inner", 1 << 17).filter((F.col("a") != F.col("b")) & (F.col("root") != F.col("_root")) & _may_link("x", "y"))

    for salt in range(CENTRES):
        left = staged(hidden(), "hidden", small=True)
        if left.isEmpty():
            return done
        centre = left.groupBy("sig").agg(F.min_by(F.struct("node", "root"), F.xxhash64(F.lit(salt), "sig", "node")).alias("c")).select("sig", "c.*")
        pairs = both(left, centre).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        done = done.unionByName(staged(_verified(pairs, sets), "links", small=True))
        roots = staged(components(done), "roots", small=True)
    left = staged(hidden(), "hidden", small=True)
    rest = both(left, left).filter("a < b").select("a", "b").distinct()
    return done.unionByName(staged(_verified(rest, sets), "links", small=True))


def _with_node(texts: DataFrame, home: DataFrame) -> DataFrame:
    """texts (doc_id, text) with the node that each stands for."""
    few = home.limit((1 << 20) + 1).count() <= 1 << 20
    return texts.join(F.broadcast(home) if few else home, "doc_id").select("node", "text")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for docs (doc_id, text)."""
    seed = secrets.randbits(64)  # of this run's word hashes, so no texts can be made to collide
    known = staged(document_signatures(docs, seed), "signatures")
    edges = links(docs, known.filter("doc_id is not null"), seed)
    members = known.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("id"))
    named = smallest_member(members, staged(components(edges), "roots", small=True))
    out = known.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sh
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)
), r(id, c) AS (
  SELECT doc_id, doc_id FROM sh UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id WHERE r.c < l.b
), m AS (
  SELECT id, min(c) AS c FROM r GROUP BY id
)
SELECT sh.doc_id, len(sh.s)::BIGINT AS n_shingles, m.c AS component_id FROM sh JOIN m ON m.id = sh.doc_id
"""
