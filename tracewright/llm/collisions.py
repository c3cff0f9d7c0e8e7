"""Embedding near-dedup by collision-counting projections.

Vectors of unit length are projected on many random lines. Two vectors at the threshold's distance differ on
each line by a normal variable of that deviation, so they fall into one query-centred window of a line with
a known chance. Lines are taken LINES_PER_CELL at a time to deal vectors into cells, in several tables;
in a cell the vectors are sorted by one projection, pairs come from the window after each vector, their
collisions over all lines are counted, and pairs with at least the calibrated count are verified by their
cosine in double precision. Cells above TILE vectors are cut into blocks and each pair of blocks is a
task's work, so no cell is gathered whole. A pair that meets in several tables counts in the first whose
window admits it.

Equal vectors of a label are one node with a weight. Recall: lines a cell, tables (by cell and window) and the count are set for
TARGET recall of pairs exactly at the threshold; closer pairs are found more surely.

Defined results: null labels, and vectors that are null, empty, zero or hold null or non-finite components, link
with nothing and are kept; labels are equal when they are as text; vectors of different lengths do not link; repeated rows are vectors of their own;
of vectors whose squares leave the range of doubles the cosines are those of multiples by powers of two; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, read, staged
from .components import components, smallest_member, spanning_stars
from .neighbours import inner, matrix, usable

COSINE = 0.98
TARGET = 0.985
CELL_WIDTH = 5.0
WINDOW = 2.0
LINES = 48
TILE = 1024
PAIRS_AT_ONCE = 1 << 18
#: Vectors of one label that may share a cell by chance.
CHANCE = 40


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _together(width: float, spread: float, window: float = math.inf) -> float:
    """Chance that two values whose difference has this deviation fall into one cell of this width and within the window."""
    r, m = width / spread, min(width, window) / spread
    return 1 - 2 * _normal(-m) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-m * m / 2))


def plan(n: int, cosine: float = COSINE, target: float = TARGET) -> dict:
    """Lines a cell, tables, lines in all, widths and the least count for labels of up to n vectors."""
    near = math.sqrt(2 - 2 * cosine)
    width = CELL_WIDTH * near
    far, close = _together(width, math.sqrt(2)), _together(width, near)
    per_cell = min(24, max(4, math.ceil(math.log(max(1, n / CHANCE)) / math.log(1 / far))))
    admitted = close ** (per_cell - 1) * _together(width, near, WINDOW * near)  # in one cell, and in its window on the first line
    tables = max(1, math.ceil(math.log(1 - target) / math.log(1 - admitted)))
    lines = max(LINES, tables * per_cell)
    p, least, seen = 2 * _normal(WINDOW) - 1, lines, 0.0
    while least > 0 and seen < 0.999:
        seen += math.comb(lines, least) * p**least * (1 - p) ** (lines - least)
        least -= 1
    return {"per_cell": per_cell, "tables": tables, "lines": lines, "width": width, "window": WINDOW * near, "least": least, "cosine": cosine}


def _lines(dim: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([17, dim])
    return rng.normal(size=(dim, n)), rng.uniform(size=n)


def _projected(x: np.ndarray, n: int) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True) @ _lines(x.shape[1], n)[0]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows as doubles; those whose squares would leave the range of doubles, or come near its end, by a power of two nearer to 1, which changes no cosine."""
    x = x.astype(np.float64)
    power = np.frexp(np.abs(x).max(axis=1))[1]
    power[np.abs(power) < 256] = 0
    if power.any():  # in two steps, as the power itself may be beyond the range
        half = power // 2
        x = np.ldexp(np.ldexp(x, -half[:, None]), (half - power)[:, None])
    return x


def cells(x: np.ndarray, label: np.ndarray, p: dict) -> np.ndarray:
    """The cell of each vector in each table, with label and length, as 64-bit keys."""
    n, shift = p["tables"] * p["per_cell"], _lines(x.shape[1], p["lines"])[1]
    at = np.floor(_projected(x, p["lines"])[:, :n] / p["width"] + shift[:n]).astype(np.int64).astype(np.uint64)
    keys = np.empty((len(x), p["tables"]), np.uint64)
    for t in range(p["tables"]):
        key = mix(label.astype(np.int64).astype(np.uint64) + np.uint64(1000003 * x.shape[1] + t))
        for column in at[:, t * p["per_cell"] : (t + 1) * p["per_cell"]].T:
            key = mix(key + column)
        keys[:, t] = key
    return keys.astype(np.int64)


def _with_cells(nodes: DataFrame, p: dict) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x) for x in batch.column("embedding")])
            for dim in np.unique(size):
                part = batch.filter(pa.array(size == dim))
                keys = cells(matrix(part.column("embedding")), part.column("label").to_numpy(), p)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(keys), pa.list_(pa.int64()))], names=[*part.schema.names, "cells"])

    nodes = nodes.select("node", "label", "weight", "embedding")
    return nodes.mapInArrow(run, f"node long, label long, weight long, embedding {dict(nodes.dtypes)['embedding']}, cells array<long>")


def _linked(group: np.ndarray, table: np.ndarray, lone: np.ndarray, block: np.ndarray, keys: np.ndarray, x: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (positions): in a tile of one block (lone) all pairs count, in one of two blocks those between them."""
    lines = _projected(x, p["lines"]).astype(np.float32)
    first = lines[np.arange(len(x)), table * p["per_cell"]]
    order = np.lexsort((first, group))
    group, table, lone, block, first, keys, lines, x = (v[order] for v in (group, table, lone, block, first, keys, lines, x))
    x = scaled(x)
    norm = np.sqrt(inner(x, x))
    found = []

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        counts = lone[i] | (block[i] != block[j])
        i, j = i[counts], j[counts]
        earlier = np.zeros(len(i), bool)
        for t in range(keys.shape[1]):
            begin = lines[:, t * p["per_cell"]]
            earlier |= (keys[i, t] == keys[j, t]) & (t < table[i]) & (np.abs(begin[i] - begin[j]) <= p["window"])
        i, j = i[~earlier], j[~earlier]
        many = (np.abs(lines[i] - lines[j]) <= p["window"]).sum(axis=1) >= p["least"]
        i, j = i[many], j[many]
        near = inner(x[i], x[j]) / (norm[i] * norm[j]) >= p["cosine"]
        found.append((order[i[near]], order[j[near]]))

    at, gap, held, n = np.arange(len(x)), 1, [], 0
    while len(at):
        at = at[at + gap < len(x)]
        at = at[(group[at] == group[at + gap]) & (first[at + gap] - first[at] <= p["window"])]
        held.append((at, at + gap))
        n += len(at)
        if n >= PAIRS_AT_ONCE:
            verify(*map(np.concatenate, zip(*held)))
            held, n = [], 0
        gap += 1
    if held:
        verify(*map(np.concatenate, zip(*held)))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 2


def _compared(rows: DataFrame, p: dict) -> DataFrame:
    """From rows sorted by tile within their task: (node, null, links) and edges (a, b, null).

    A task holds a batch and one tile, of some 2 * TILE vectors, that goes on in the next batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def emit(rows: pa.RecordBatch) -> pa.RecordBatch | None:
            tile = rows.column("tile").to_numpy()
            group = np.cumsum(np.concatenate([[0], tile[1:] != tile[:-1]]))
            table, node, weight = (rows.column(c).to_numpy() for c in ("table", "node", "weight"))
            lone, block = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("lone", "block"))
            i, j = _linked(group, table, lone, block, matrix(rows.column("cells")), matrix(rows.column("embedding")), p)
            links = np.bincount(i, weight[j], len(node)) + np.bincount(j, weight[i], len(node))
            some = np.flatnonzero(links)
            a, b = spanning_stars(node[i].tolist(), node[j].tolist())
            if not len(some):
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[some], np.array(a, np.int64)])), pa.array([None] * len(some) + b, pa.int64()), pa.array(links[some].astype(np.int64).tolist() + [None] * len(a), pa.int64())],
                names=["a", "b", "links"],
            )

        for batch in batches:
            table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
            sizes = pc.list_value_length(table["embedding"]).to_numpy()
            tile = table["tile"].to_numpy()
            ends = np.flatnonzero((tile[1:] != tile[:-1]) | (sizes[1:] != sizes[:-1])) + 1
            last = int(ends[-1]) if len(ends) else 0
            begin = 0
            for end in [e for k, e in enumerate(ends.tolist()) if e == last or sizes[e] != sizes[e - 1]]:
                out = emit(table.slice(begin, end - begin).combine_chunks().to_batches()[0])
                begin = end
                if out is not None:
                    yield out
            held = table.slice(last).combine_chunks().to_batches()[0] if table.num_rows > last else None
        if held is not None and held.num_rows > 1 and (out := emit(held)) is not None:
            yield out

    return rows.select("tile", "table", "lone", "block", "node", "weight", "cells", "embedding").mapInArrow(run, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, target: float = TARGET) -> DataFrame:
    """vec_id, n_links, component_id, kept for vectors (vec_id, embedding, label)."""
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kept = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    vectors = vectors.select("vec_id", kept.alias("embedding"), F.xxhash64(F.col("label").cast("string")).alias("label"), F.col("label").isNotNull().alias("_labelled"))
    ok = usable(F.col("embedding")) & F.col("_labelled")
    vectors = vectors.withColumn("node", F.when(ok, F.xxhash64("label", "embedding")))
    nodes = vectors.filter("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("id"))
    most = vectors.filter("node is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 1
    p = plan(most, cosine, target)
    nodes = staged(nodes, "nodes")
    celled = staged(_with_cells(nodes, p), "cells")

    met = celled.select("node", F.posexplode("cells").alias("table", "cell"))
    full = met.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / TILE).cast("int")
    met = met.join(full, "cell").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    met = met.select("node", "table", "block", (F.col("block") == F.col("other")).alias("lone"), F.xxhash64("cell", low, high).alias("tile"))
    rows = met.join(celled.select("node", "weight", "cells", "embedding"), "node")
    found = staged(_compared(rows.repartition("tile").sortWithinPartitions("tile"), p), "found", small=True)

    links = found.filter("links is not null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    roots = staged(components(found.filter("links is null").select("a", "b")), "roots", small=True)
    named = smallest_member(nodes.select("node", "id"), roots)
    per_node = nodes.select("node", "weight").join(links, "node", "left").join(named, "node")
    per_node = per_node.select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    out = vectors.select("vec_id", "node").join(per_node, "node", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
