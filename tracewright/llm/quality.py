"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Words are runs of letters, digits or marks, hashed into 2^14 buckets; a bucket's index vector is sparse
and random, its word vector the sum of the index vectors around it. Both the vectors and the network are
fitted on a bounded sample of labelled rows (TRAIN_DOCS); every text is scored whole. The word vectors
(2 MB) and the network are broadcast. A long text is pooled step by step. A temperature fitted on rows that the network did not see calibrates
the probabilities.

Defined results: a null or empty text has the zero vector and the network's score of it; without labels
of both kinds the score is the share of label 1 (0.5 without any). Repeated rows are scored alike; of
several labels of one document the smallest counts; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, lower_ascii, mix, read, span_hashes, steps

BUCKETS = 1 << 14
DIMENSIONS = 32
WINDOW = 2
TRAIN_DOCS = 12_000
TRAIN_TASKS = 8
HIDDEN = 24
THRESHOLD = 0.7

_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x80:] = 1
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True


def word_buckets(data: np.ndarray, at: np.ndarray, before: int | None = None, marks: bool = True) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Buckets of the words of each row, the rows' first words, and the last word's hash (before: that of the step that this one goes on from).

    marks: words in capitals share 16 buckets, and a word said again at once has bucket mix(1). Shouting and stuttering
    are signs of poor text whatever the words are, and words of their own kind would be too rare to teach it.
    """
    kind = _KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    cut[1:-1] |= kind[1:] != kind[:-1]
    edges = np.flatnonzero(cut[: len(data)])
    ends = np.append(edges[1:], len(data))
    keep = kind[edges] > 0 if len(edges) else np.zeros(0, bool)
    start, end = edges[keep], ends[keep]
    h = span_hashes(lower_ascii(data), start, end)
    capitals = np.concatenate([[0], np.cumsum(_CAPITAL[data])])
    shouted = (end - start > 1) & (capitals[end] - capitals[start] == end - start)
    rows = np.searchsorted(start, at)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[rows[:-1][rows[:-1] < len(h)]] = False
    if before is not None and len(h):
        again[0] = int(h[0]) == before
    last = int(h[-1]) if len(h) else before
    letters = kind[start] == 1
    if marks:
        h = np.where(shouted, mix(h >> np.uint64(60)), h)
        h = np.where(again & letters, np.uint64(1), h)
    return (mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64), rows, last


def bucket_steps(batches: Iterable[pa.RecordBatch], marks: bool = True) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, bool]]:
    """Rows of the batches, their words' buckets, the rows' first words, and whether the row goes on in the next step."""
    last = None
    for batch, data, at, more in steps(batches, "text"):
        bucket, rows, last = word_buckets(data, at, last, marks)
        last = last if more else None
        yield batch, bucket, rows, more


def index_vectors(seed: int = 7) -> np.ndarray:
    """Sparse ternary vectors, four entries each."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    for _ in range(2):
        out[np.arange(BUCKETS), rng.integers(0, DIMENSIONS, BUCKETS)] += 1
        out[np.arange(BUCKETS), rng.integers(0, DIMENSIONS, BUCKETS)] -= 1
    return out


def word_vectors(texts: DataFrame, marks: bool = True) -> np.ndarray:
    """Context sums over a bounded DataFrame of text, scaled to length 1; a bucket never seen keeps its index vector."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((BUCKETS, DIMENSIONS), np.float32)
        held = index[:0, 0].astype(np.int64)
        for _, bucket, rows, more in bucket_steps(batches, marks):
            row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
            bucket, row = np.concatenate([held, bucket]), np.concatenate([np.zeros(len(held), np.int64), row])
            early, held = len(held), bucket[-WINDOW:] if more else bucket[:0]
            for gap in range(1, WINDOW + 1):
                same = row[gap:] == row[:-gap]
                same[: max(0, early - gap)] = False  # pairs that the step before had
                left, right = bucket[:-gap][same], bucket[gap:][same]
                for d in range(DIMENSIONS):
                    total[:, d] += np.bincount(left, index[right, d], BUCKETS) + np.bincount(right, index[left, d], BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["total"])

    index, total = index_vectors(), np.zeros((BUCKETS, DIMENSIONS), np.float64)
    for r in texts.select("text").repartition(TRAIN_TASKS).mapInArrow(gather, "total binary").collect():  # a row per task
        total += np.frombuffer(r["total"], dtype="<f4").reshape(total.shape)
    size = np.linalg.norm(total, axis=1, keepdims=True)
    own = index / np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-9)
    return (np.where(size > 0, total / np.maximum(size, 1e-9), 0) + own).astype(np.float32)


def pooled(vectors: np.ndarray, batches: Iterable[pa.RecordBatch], marks: bool = True) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of the batches with their mean word vectors."""
    total, words = np.zeros(vectors.shape[1]), 0  # of a text that goes on
    for batch, bucket, rows, more in bucket_steps(batches, marks):
        n, out = np.diff(rows), np.zeros((len(rows) - 1, vectors.shape[1]))
        full = np.flatnonzero(n)
        if len(full):
            out[full] = np.add.reduceat(vectors[bucket], rows[:-1][full], axis=0, dtype=np.float64)
        out[0] += total
        n[0] += words
        total, words = (out[0], int(n[0])) if more else (0.0, 0)
        if not more:
            yield batch, out / np.maximum(n, 1)[:, None]


def fit_network(x: np.ndarray, y: np.ndarray, held: np.ndarray, seed: int = 11, epochs: int = 400) -> dict:
    """Two layers by Adam on rows not held, then a temperature on those held."""
    rng = np.random.default_rng(seed)
    mean, scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-6
    z = (x - mean) / scale
    p = {"a": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1)}
    m, v = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}
    zt, yt = z[~held], y[~held]
    for t in range(1, epochs + 1):
        i = rng.choice(len(zt), min(len(zt), 2048), replace=False)
        h = np.tanh(zt[i] @ p["a"] + p["b"])
        e = (1 / (1 + np.exp(-(h @ p["c"] + p["d"]))) - yt[i]) / len(i)
        back = np.outer(e, p["c"]) * (1 - h * h)
        g = {"a": zt[i].T @ back + 1e-4 * p["a"], "b": back.sum(axis=0), "c": h.T @ e + 1e-4 * p["c"], "d": np.array([e.sum()])}
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    p |= {"mean": mean, "scale": scale, "temperature": 1.0}
    zh, yh = (x[held], y[held]) if held.any() else (x, y)
    raw = logits(p, zh)
    losses = {t: np.logaddexp(0, np.where(yh > 0, -raw, raw) / t).mean() for t in np.geomspace(0.25, 8, 41)}
    p["temperature"] = min(losses, key=losses.get)
    return p


def logits(p: dict, x: np.ndarray) -> np.ndarray:
    return (np.tanh((x - p["mean"]) / p["scale"] @ p["a"] + p["b"]) @ p["c"] + p["d"]) / p["temperature"]


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, marks: bool = True) -> dict:
    """A model from docs (doc_id, text) and labels (doc_id, label 0 or 1); about train_docs labelled rows are used."""
    labels = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    share = train_docs / max(1, labels.count())
    u = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    chosen = labels.filter(u < share)  # about train_docs rows: the bound of this broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    vectors = word_vectors(sample, marks)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in pooled(vectors, batches, marks):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in rows.astype("<f4")], pa.binary())], names=["doc_id", "label", "x"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(pool, "doc_id long, label int, x binary").toArrow().sort_by([("doc_id", "ascending")])
    y = rows.column("label").to_numpy().astype(float)
    model: dict = {"vectors": vectors, "share": float(y.mean()) if len(y) else 0.5, "network": None, "marks": marks}
    if len(np.unique(y)) == 2:
        x = np.frombuffer(b"".join(rows.column("x").to_pylist()), dtype="<f4").reshape(len(y), DIMENSIONS).astype(float)
        held = (mix(rows.column("doc_id").to_numpy().astype(np.uint64)) & np.uint64(3)) == 3
        if len(np.unique(y[~held])) < 2:
            held[:] = False
        model["network"] = fit_network(x, y, held)
    return model


def probabilities(model: dict, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of the batches with their probability of label 1."""
    for batch, x in pooled(model["vectors"], batches, model["marks"]):
        yield batch, np.full(len(x), model["share"]) if model["network"] is None else 1 / (1 + np.exp(-np.clip(logits(model["network"], x), -500, 500)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and the probability of label 1, for docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in probabilities(sent.value, batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, with all their columns, whose probability reaches the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in probabilities(sent.value, batches):
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality_model(docs: DataFrame, labels: DataFrame) -> dict:
    """Fitted on labels.quality of the rows outside the held-out fold."""
    return fit(docs, labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(crc_fold("doc_id") != 2))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = score(docs, quality_model(docs, read(spark, sf_dir, "labels")))
    held = F.coalesce(crc_fold("doc_id"), F.lit(-1)) == 2
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
