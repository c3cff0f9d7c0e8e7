"""Merkle manifest of a dataset: a leaf a document, a tree a language, a tree over the languages' roots.

H is SHA-256 of its inputs' concatenation, as lower-case hex text. Leaves of a language ascend by doc_id (then by
themselves); every 8 consecutive nodes become one, until one is left, the subroot; subroots by language likewise
give the root.

Leaves are put in order by ranges of (language, doc_id), so a language of any size is spread over tasks, and their
places follow from counts a range. Superblocks of 8 ** HEIGHT consecutive nodes are reduced in a task each, their
tops are dealt into superblocks again, and so on up to the root. On the way down each superblock's nodes are cogrouped
with the outer nodes that its own path to the root needs, one row a superblock; the function finishes the
reduction within the superblock, joins its siblings with the outer ones to each node's proof, and folds the proof.
No task holds more than a superblock, and nothing but the root and numbers of nodes reach the driver.

Defined results: null fields are `-`; a null doc_id is the smallest; rows that repeat are leaves of their own; a null
language is a tree of its own, before all others; a tree of one leaf is that leaf, with no siblings; documents with a
null doc_id are not tampered with; other columns are left out, whatever their names; texts of any length are hashed
by the JVM; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, staged, within

FANOUT = 8
#: Levels that one task reduces: a superblock has FANOUT ** HEIGHT nodes.
HEIGHT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
PATHS = "key string, block long, before array<string>, after array<string>, subroot string"


def leaf_of(fields: list[Column]) -> Column:
    """H of the fields, each `-` if null, else its bytes' number, `:` and itself."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text)), 256)


def tampered(doc_id: Column, text: Column) -> Column:
    """The text as it was tampered with: A-Z in lower case where 3 divides the id's checksum."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.translate(text, upper, upper.lower())).otherwise(text)


def placed(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Nodes with their place within their key (pos, from 0) and the key's number of nodes (total), and the largest such number.

    Sorted by ranges, so places are a range's start plus the place within it, and no key is gathered in a task.
    """
    ranged = nodes.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    ranged = staged(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ordered")
    runs = ranged.groupBy("key", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    every = Window.partitionBy("key")
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = staged(runs.select("key", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(every).alias("total")), "ranges", small=True)
    most = runs.agg(F.max("total")).first()[0] or 0
    found = within(runs, ranged, ["key", "_part"], "inner").withColumn("pos", F.col("_start") + F.col("_at") - F.col("_first"))
    return found.drop("_part", "_at", "_first", "_start"), most


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def height_of(total: int, most: int) -> int:
    """Levels until one of total nodes is left, at most `most`."""
    levels = 0
    while total > 1 and levels < most:
        total, levels = -(-total // FANOUT), levels + 1
    return levels


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes, and those of each level above."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest("".join(nodes[i : i + FANOUT])) for i in range(0, len(nodes), FANOUT)]
        out.append(nodes)
    return out


def siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands before and behind the path of a node in its run, level by level."""
    before, after = [], []
    for nodes in levels[:-1]:
        run = at - at % FANOUT
        before.append("".join(nodes[run:at]))
        after.append("".join(nodes[at + 1 : run + FANOUT]))
        at //= FANOUT
    return before, after


def folded(node: str, before: list[str], after: list[str]) -> str:
    for left, right in zip(before, after):
        node = digest(left + node + right)
    return node


def tops(nodes: DataFrame, height: int) -> DataFrame:
    """The top of each superblock of nodes (key, pos, total, digest), as nodes of the tree above."""
    span = FANOUT**height

    def top(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        total = int(block["total"].iloc[0])
        node = reduced(block["digest"].tolist(), height_of(total, height))[-1][0]
        return pd.DataFrame({"key": block["key"].iloc[:1], "pos": [int(block["pos"].iloc[0]) // span], "total": [-(-total // span)], "digest": [node]})

    dealt = nodes.select("key", "pos", "total", "digest", F.expr(f"pos div {span}").alias("block"))
    return dealt.groupBy("key", "block").applyInPandas(top, "key string, pos long, total long, digest string")


def tree(leaves: DataFrame, most: int, height: int) -> list[DataFrame]:
    """Nodes of every round, from the leaves to one node a key."""
    rounds, span = [leaves], FANOUT**height
    while True:
        rounds.append(staged(tops(rounds[-1], height), "nodes", small=True))
        if most <= span:
            return rounds
        most = -(-most // span)


def outer(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """The path of each of nodes (key, pos, total, digest) to the root, given its superblock's (above: PATHS), as paths of the superblocks below."""
    span = FANOUT**height

    def extended(block: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        levels = reduced(block["digest"].tolist(), height_of(int(block["total"].iloc[0]), height))
        own = [siblings(levels, i) for i in range(len(block))]
        ahead, behind, subroot = list(path["before"].iloc[0]), list(path["after"].iloc[0]), path["subroot"].iloc[0]
        return pd.DataFrame({"key": block["key"], "block": block["pos"], "before": [b + ahead for b, _ in own], "after": [a + behind for _, a in own], "subroot": subroot})

    dealt = nodes.select("key", "pos", "total", "digest", F.expr(f"pos div {span}").alias("block"))
    return staged(dealt.groupBy("key", "block").cogroup(above.groupBy("key", "block")).applyInPandas(extended, PATHS), "paths", small=True)


def proofs(leaves: DataFrame, above: DataFrame, root: str, height: int) -> DataFrame:
    """Subtree exchange: the leaves of a superblock (key, pos, total, digest, doc_id, other: the leaf to verify) with the outer nodes that they need."""
    span = FANOUT**height

    def verified(block: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        levels = reduced(block["digest"].tolist(), height_of(int(block["total"].iloc[0]), height))
        ahead, behind, subroot = list(path["before"].iloc[0]), list(path["after"].iloc[0]), path["subroot"].iloc[0]
        proof, end = [], []
        for i, leaf in enumerate(block["other"]):
            before, after = siblings(levels, i)
            before, after = before + ahead, after + behind
            proof.append(digest("".join(b + a for b, a in zip(before, after))))
            end.append(folded(leaf, before, after))
        out = pd.DataFrame({"doc_id": block["doc_id"], "leaf": block["digest"], "subroot": subroot, "root": root, "proof_sha256": proof, "folded_root": end})
        return out.assign(verified=out["folded_root"] == root)

    dealt = leaves.select("key", "pos", "total", "digest", "doc_id", "other", F.expr(f"pos div {span}").alias("block"))
    return dealt.groupBy("key", "block").cogroup(above.groupBy("key", "block")).applyInPandas(verified, PROOFS)


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row a document."""
    fields = [F.col(c) for c in FIELDS]
    other = leaf_of([*fields[:-1], tampered(F.col("doc_id"), F.col("text"))])
    key = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("lang")))  # in bytewise order, null first
    leaves = staged(docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(fields).alias("digest"), other.alias("other")), "leaves")
    leaves, most = placed(leaves, ["doc_id", "digest"])
    spark = docs.sparkSession
    if not most:
        return spark.createDataFrame([], PROOFS)
    own = tree(leaves, most, height)
    subroots, langs = placed(own[-1].select(F.lit("").alias("key"), F.col("key").alias("lang_key"), "digest"), ["lang_key"])
    joint = tree(subroots, langs, height)
    root = joint[-1].first()["digest"]
    path = spark.createDataFrame([("", 0, [], [], None)], PATHS)
    for nodes in reversed(joint[1:-1]):
        path = outer(nodes, path, height)
    path = of_languages(subroots, path, height)
    for nodes in reversed(own[1:-1]):
        path = outer(nodes, path, height)
    return proofs(leaves, path, root, height)


def of_languages(subroots: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Paths of the subroots to the root, as paths of each language's only superblock at its top."""
    found = outer(subroots, above, height).select(F.col("block").alias("pos"), "before", "after")
    return staged(subroots.join(found, "pos").select(F.col("lang_key").alias("key"), F.lit(0).cast("long").alias("block"), "before", "after", F.col("digest").alias("subroot")), "paths", small=True)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"))


def _field(sql: str) -> str:
    return f"CASE WHEN {sql} IS NULL THEN '-' ELSE octet_length(encode({sql}::VARCHAR)) || ':' || {sql}::VARCHAR END"


def _crc32(sql: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, k))"
    return f"xor(list_reduce(list_transform(string_split({sql}::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, k: {bits}, 4294967295::BIGINT), 4294967295)"


_LEAF = " || ".join(_field(f) for f in FIELDS[:-1])
OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS key, sha256({_LEAF} || {_field('text')}) AS leaf,
    CASE WHEN {_crc32('doc_id')} % 3 = 0 THEN sha256({_LEAF} || {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS other
  FROM documents
), b AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), own(key, lvl, pos, d) AS (
  SELECT key, 0, pos, leaf FROM b
  UNION ALL
  SELECT key, lvl + 1, pos // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM own) WHERE n > 1 GROUP BY key, lvl, pos // 8
), subroots AS (
  SELECT key, arg_max(d, lvl) AS subroot, max(lvl) AS height, row_number() OVER (ORDER BY encode(key)) - 1 AS pos FROM own GROUP BY key
), joint(lvl, pos, d) AS (
  SELECT 0, pos, subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM joint) WHERE n > 1 GROUP BY lvl, pos // 8
), root AS (
  SELECT arg_max(d, lvl) AS root FROM joint
), paths AS (
  SELECT b.key, b.pos, s.lvl, string_agg(s.d, '' ORDER BY s.pos) FILTER (s.pos < b.pos // (8 ** s.lvl)::BIGINT) AS before, string_agg(s.d, '' ORDER BY s.pos) FILTER (s.pos > b.pos // (8 ** s.lvl)::BIGINT) AS after
  FROM b JOIN subroots r ON r.key = b.key JOIN own s ON s.key = b.key AND s.lvl < r.height AND s.pos // 8 = b.pos // (8 ** (s.lvl + 1))::BIGINT GROUP BY ALL
  UNION ALL
  SELECT b.key, b.pos, r.height + s.lvl, string_agg(s.d, '' ORDER BY s.pos) FILTER (s.pos < r.pos // (8 ** s.lvl)::BIGINT), string_agg(s.d, '' ORDER BY s.pos) FILTER (s.pos > r.pos // (8 ** s.lvl)::BIGINT)
  FROM b JOIN subroots r ON r.key = b.key JOIN joint s ON s.lvl < (SELECT max(lvl) FROM joint) AND s.pos // 8 = r.pos // (8 ** (s.lvl + 1))::BIGINT GROUP BY b.key, b.pos, r.height, s.lvl
), proofs AS (
  SELECT key, pos, sha256(string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY lvl)) AS proof_sha256 FROM paths GROUP BY key, pos
), fold(key, pos, lvl, d) AS (
  SELECT key, pos, 0, coalesce(other, leaf) FROM b
  UNION ALL
  SELECT f.key, f.pos, f.lvl + 1, sha256(coalesce(p.before, '') || f.d || coalesce(p.after, '')) FROM fold f JOIN paths p ON p.key = f.key AND p.pos = f.pos AND p.lvl = f.lvl
), ends AS (
  SELECT key, pos, arg_max(d, lvl) AS folded_root FROM fold GROUP BY key, pos
)
SELECT b.doc_id, b.leaf, r.subroot, root.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
FROM b JOIN subroots r USING (key) JOIN ends e ON e.key = b.key AND e.pos = b.pos LEFT JOIN proofs p ON p.key = b.key AND p.pos = b.pos, root
"""
