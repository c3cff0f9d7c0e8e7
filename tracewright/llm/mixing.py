"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded documents.

Documents are aggregated by the set of sources they belong to (their pattern). A flow routes words from
patterns to source quotas; using a pattern's words once costs nothing, each further time costs more, so
repetition is a last resort. The flow sees one row per pattern and per source, never a row per document,
and refuses more than MOST_PATTERNS patterns. Documents are then taken in an order that a seed fixes, until
the words of their pattern come as near to its flow as whole documents allow. Prefix sums go over parts
of that order, so a source with a third of all documents is spread over many tasks.

Defined results: a null or empty text has size 0 and is not taken; a null source is a source of its own,
last in order; repeated rows are documents of their own; an empty table gives no row.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, staged

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2
#: Patterns of membership and sources that a flow is computed for; more are refused with an error.
MOST_PATTERNS = 100_000
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def capped_targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST_REPEATS) -> list[float]:
    """Shares of share * sum(sizes) by weight; none above most * its size, the excess goes to the others by weight."""
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    rest, weight = share * sum(sizes), sum(weights)
    out = [0.0] * len(sizes)
    for n, i in enumerate(order):
        if rest * weights[i] < most * sizes[i] * weight:
            for j in order[n:]:
                out[j] = rest * weights[j] / weight
            break
        out[i] = float(most * sizes[i])
        rest -= out[i]
        weight -= weights[i]
    return out


def min_cost_flow(patterns: Sequence[tuple[tuple, int]], quotas: dict, repeats: int = MOST_REPEATS) -> list[dict]:
    """For each (sources, words) the words it gives to each of its sources.

    The n-th use of a pattern's words costs n - 1 a word. Costs lie on the arcs out of the start alone, and a flow
    never has to give such an arc's words back to grow, so the cheapest flow is a largest one over first
    uses, then enlarged by second uses, and so on.
    """
    source_at = {s: 1 + len(patterns) + i for i, s in enumerate(quotas)}
    end = 1 + len(patterns) + len(quotas)
    arcs: list[list] = [[] for _ in range(end + 1)]  # [to, room, index of the reverse]

    def arc(a: int, b: int, room: float) -> None:
        arcs[a].append([b, room, len(arcs[b])])
        arcs[b].append([a, 0.0, len(arcs[a]) - 1])

    for i, (members, _) in enumerate(patterns):
        arc(0, 1 + i, 0.0)
        for s in members:
            if s in source_at:
                arc(1 + i, source_at[s], float("inf"))
    for s, quota in quotas.items():
        arc(source_at[s], end, float(quota))
    for _ in range(repeats):
        for k, (_, words) in enumerate(patterns):
            arcs[0][k][1] += float(words)
        while level := _levels(arcs, end):
            _blocked(arcs, level, end)
    back = {at: s for s, at in source_at.items()}
    return [{back[b]: arcs[b][k][1] for b, _, k in arcs[1 + i] if b in back and arcs[b][k][1] > 0} for i in range(len(patterns))]


LEAST_ROOM = 1e-9


def _levels(arcs: list[list], end: int) -> dict[int, int] | None:
    """Each node's distance from node 0 over arcs with room, or None where the end is out of reach."""
    level, queue = {0: 0}, deque([0])
    while queue:
        a = queue.popleft()
        for b, room, _ in arcs[a]:
            if room > LEAST_ROOM and b not in level:
                level[b] = level[a] + 1
                queue.append(b)
    return level if end in level else None


def _blocked(arcs: list[list], level: dict[int, int], end: int) -> None:
    """Sends words along shortest paths until each of them is full."""
    tried, path, at = [0] * len(arcs), [], 0
    while True:
        if at == end:
            room = min(x[1] for x in path)
            for n, x in enumerate(path):
                x[1] -= room
                arcs[x[0]][x[2]][1] += room
            full = next(n for n, x in enumerate(path) if x[1] <= LEAST_ROOM)
            at = 0 if full == 0 else path[full - 1][0]
            del path[full:]
            continue
        while tried[at] < len(arcs[at]):
            x = arcs[at][tried[at]]
            if x[1] > LEAST_ROOM and level.get(x[0]) == level[at] + 1:
                path.append(x)
                at = x[0]
                break
            tried[at] += 1
        else:
            if not path:
                return
            path.pop()
            at = path[-1][0] if path else 0
            tried[at] += 1


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, and size in words."""
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def source_targets(items: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> list[tuple]:
    """(source, size, target) by code point, null last. items: source, size."""
    rows = items.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last()).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sources")
    sizes = [r["size"] for r in rows]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share, most)
    return [(r["source"], n, t) for r, n, t in zip(rows, sizes, targets)]


def mix(items: DataFrame, quotas: dict, repeats: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """items: doc_id, size, members (array of sources), and any others; adds taken, the words that the mix takes of a document.

    items must give the same rows each time they are read (staged). quotas: words wanted of each source.
    """
    spark = items.sparkSession
    items = items.withColumn("_pattern", F.to_json(F.array_sort(F.array_distinct("members"))))
    found = items.groupBy("_pattern").agg(F.sum("size").alias("size"), F.min("members").alias("members")).orderBy("_pattern").limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of membership")
    flow = min_cost_flow([(tuple(dict.fromkeys(r["members"] or [])), r["size"]) for r in found], quotas, repeats)
    rows = []
    for r, given in zip(found, flow):
        words, size = sum(given.values()), r["size"]
        whole = int(words // size) if size else 0
        rows.append((r["_pattern"], whole, float(words - whole * size)))
    plan = spark.createDataFrame(rows, "_pattern string, _whole int, _extra double")  # a row per pattern, MOST_PATTERNS at most
    items = items.withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))).withColumn("_part", F.substring("_order", 1, 3))
    sums = items.groupBy("_pattern", "_part").agg(F.sum("size").alias("_n"))
    sums = sums.select("_pattern", "_part", (F.sum("_n").over(Window.partitionBy("_pattern").orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.sum("size").over(Window.partitionBy("_pattern", "_part").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, 0))
    items = items.withColumn("_own", own - F.col("size")).join(sums, ["_pattern", "_part"]).join(F.broadcast(plan), "_pattern")
    middle = F.col("_before") + F.col("_own") + F.col("size") / 2
    times = F.least(F.lit(repeats), F.col("_whole") + F.when(middle <= F.col("_extra"), 1).otherwise(0))
    return items.withColumn("taken", times * F.col("size")).drop("_pattern", "_order", "_part", "_own", "_before", "_whole", "_extra")


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for documents of one source each."""
    items = staged(sized(docs), "sizes")
    targets = source_targets(items, weights, share, repeats)
    mixed = mix(items.withColumn("members", F.array("source")), {s: t for s, _, t in targets}, repeats, seed)
    named = docs.sparkSession.createDataFrame(targets, "_source string, source_size long, target double")  # a row per source, MOST_PATTERNS at most
    return mixed.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long"))


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of docs as often as the mix takes them; mixed has their doc_id, size and taken.

    Rows with one doc_id are matched by their sizes in words; of those with one size too, each is repeated as often
    as they are on the whole, and the rest goes to the first of them.
    """
    times = mixed.filter("size > 0").groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_size")).agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("_times"), F.count("*").cast("int").alias("_rows"))
    times = staged(times.filter("_times > 0"), "times")
    held = docs.select("doc_id", F.struct(*docs.columns).alias("doc"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))  # other columns may have any name
    held = held.join(times.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size")))
    if not times.filter("_rows > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy("_id", "_size").orderBy("doc.text"))
        held = held.withColumn("_nth", nth).withColumn("_times", (F.floor(F.col("_times") / F.col("_rows")) + F.when(F.col("_nth") <= F.col("_times") % F.col("_rows"), 1).otherwise(0)).cast("int")).filter("_times > 0")
    return held.select("doc", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("doc.*")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS ssize, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source
), r AS (
  SELECT *, 2 * ssize / w AS ratio,
    1.5 * sum(ssize) OVER () - coalesce(sum(2 * ssize) OVER (ORDER BY 2 * ssize / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY 2 * ssize / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight FROM s
), level AS (
  SELECT rest, weight FROM r WHERE rest * w < 2 * ssize * weight ORDER BY ratio, source NULLS LAST LIMIT 1
), t AS (
  SELECT r.source, r.ssize, CASE WHEN r.rest * r.w < 2 * r.ssize * r.weight THEN l.rest * r.w / l.weight ELSE 2 * r.ssize END AS target FROM r LEFT JOIN level l ON true
), c AS (
  SELECT d.doc_id, d.size, t.ssize, t.target, floor(t.target / nullif(t.ssize, 0)) AS whole,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || d.doc_id), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size / 2 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, ssize::BIGINT AS source_size, target,
  (size * least(2, coalesce(whole, 0) + CASE WHEN middle <= target - coalesce(whole, 0) * ssize THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
