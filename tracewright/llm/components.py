"""Connected components of an edge table, by spanning forests and randomised contraction.

Tasks of at most EDGES_PER_TASK edges or so replace theirs by stars that span the same components. Where more
than one task is needed, every node is hooked to the neighbour (or itself) that comes first in the
round's hashed order, and edges become edges between hooks, so a constant share of the nodes goes in each
round, also along chains; then the forests are taken again, by fewer tasks. Nothing is collected to the
driver but the number of edges left; each round's tables are staged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


#: Edges that one task's forest holds, some 50 MB.
EDGES_PER_TASK = 200_000


def spanning_stars(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """For each node that is not the smallest of its component of these edges, an edge to the smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for x, y in zip(a, b):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    return [root(x) for x in nodes], nodes


def _forest(edges: DataFrame, tasks: int) -> DataFrame:
    """Stars that span the components of each task's edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for batch in batches:
            a, b = spanning_stars(a + batch.column(0).to_pylist(), b + batch.column(1).to_pylist())
        for at in range(0, len(a), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 10_000], pa.int64()), pa.array(b[at : at + 10_000], pa.int64())], names=["a", "b"])

    return edges.coalesce(tasks).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """node, root for every node of edges (a long, b long), a staged table; root is one node of its component."""
    left, found, n = edges.select("a", "b").filter("a <> b"), None, 0
    while True:
        tasks = max(1, -(-left.count() // per_task))
        left = staged(_forest(left, tasks), "edges")
        stars = left.select(F.col("b").alias("node"), F.col("a").alias("root"))
        if tasks == 1:
            break
        order = lambda c: F.xxhash64(F.lit(n), F.col(c))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(order("b").alias("h"), F.col("b").alias("b"))).alias("first"))
        hook = staged(first.filter(F.col("first.h") < order("a")).select(F.col("a").alias("node"), F.col("first.b").alias("root")), "hooks", small=True)
        found = hook if found is None else _followed(found, hook)
        for side in ("a", "b"):
            left = left.join(hook.select(F.col("node").alias(side), F.col("root").alias("_root")), side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
        left = staged(left.select("a", "b").filter("a <> b"), "edges", small=True)
        n += 1
    found = stars if found is None else _followed(found, stars)
    tops = found.select("root").distinct().join(found.select(F.col("node").alias("root")), "root", "left_anti")
    return found.unionByName(tops.select(F.col("root").alias("node"), "root"))


def _followed(found: DataFrame, hook: DataFrame) -> DataFrame:
    """found with roots moved along hook, and hook's other nodes. A node hooked again is found already, by a way that leads to the same root."""
    far = hook.select(F.col("node").alias("root"), F.col("root").alias("_root"))
    moved = found.join(far, "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
    return staged(moved.unionByName(hook.join(found, "node", "left_anti")), "roots", small=True)


def smallest_member(members: DataFrame, roots: DataFrame) -> DataFrame:
    """node, component: the smallest id of its component. members: node, id (the node's smallest id); roots as from components()."""
    named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    return named.join(least, "root").select("node", "component")
