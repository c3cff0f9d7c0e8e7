"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded sample of labelled rows (TRAIN_PER_LANG a language, the bound on what is
fitted); every text is scored whole. The log-probability matrix has 2^15 rows and a column per language
(MOST_LANGUAGES at most), so its broadcast is bounded.

Defined results: a null text, or one without any letter, is `und` with score 0; so is every text when no
labelled row exists. Long texts are counted step by step. Ties go to the smaller language code. Repeated rows are scored alike; an empty table
gives no row; other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, mix, read, steps

FEATURES = 1 << 15
ORDERS = (1, 2, 3)
TRAIN_PER_LANG = 4000
TRAIN_TASKS = 8
MOST_LANGUAGES = 500
SMOOTHING = 0.1
UNKNOWN = "und"

_FOLD = np.arange(0x250, dtype=np.uint32)
_FOLD[0x41:0x5B] += 32
_FOLD[0xC0:0xDF] += 32
_FOLD[0xD7] = 0xD7
_FOLD[[x for x in range(0x250) if not chr(x).isalpha()]] = 32


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of letters, all else a blank, and the row that each belongs to."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
    row = np.repeat(np.arange(len(at) - 1), np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]))
    low = points < len(_FOLD)
    points = np.where(low, _FOLD[np.where(low, points, 0)], points).astype(np.uint64)
    found, rows = [], []
    gram = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        gram = gram[: max(0, len(points) - n + 1)] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            whole = row[: len(gram)] == row[n - 1 :]
            found.append((mix(gram[whole]) & np.uint64(FEATURES - 1)).astype(np.int64))
            rows.append(row[: len(gram)][whole])
    return np.concatenate(found), np.concatenate(rows)


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Rows of the batches, their n-grams, the row of each, n-grams among them that a step before had, and whether the row goes on in the next step."""
    last = np.zeros(0, np.uint8)  # the code points of a text that goes on with which n-grams of its next step begin
    for batch, data, at, more in steps(batches, "text", words=False):
        grams, row = features(np.concatenate([last, data]), np.concatenate([[0], at[1:] + len(last)]))
        again = features(last, np.array([0, len(last)]))[0]
        yield batch, grams, row, again, more
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        if more and len(starts) >= max(ORDERS) - 1:
            last = data[starts[1 - max(ORDERS)] :].copy()
        else:
            last = np.concatenate([last, data]) if more else last[:0]


def fit(samples: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (feature x language) from a bounded DataFrame of text and lang."""
    langs = sorted(r["lang"] for r in samples.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at_lang = np.zeros((len(langs), FEATURES), np.int64), {x: i for i, x in enumerate(langs)}
        for batch, feature, row, again, _ in counted(batches):
            kind = np.array([at_lang[x] for x in batch.column("lang").to_pylist()])
            total += np.bincount(kind[row] * FEATURES + feature, minlength=total.size).reshape(total.shape)
            total[kind[0]] -= np.bincount(again, minlength=FEATURES)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(langs)), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total], pa.binary())], names=["lang", "counts"])

    total = np.zeros((FEATURES, len(langs)))
    if langs:
        parts = samples.select("text", "lang").repartition(TRAIN_TASKS).mapInArrow(count, "lang int, counts binary")
        for r in parts.collect():  # a row per task and language
            total[:, r["lang"]] += np.frombuffer(r["counts"], dtype="<i8")
    total += SMOOTHING
    return langs, np.log(total / total.sum(axis=0)).astype(np.float32)


def sample_by_lang(labelled: DataFrame, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """About per_lang rows of each language, the same ones each time. labelled: doc_id, text, lang."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("_n")).limit(MOST_LANGUAGES + 1)
    share = counts.select(F.col("lang").alias("_lang"), (F.lit(float(per_lang)) / F.col("_n")).alias("_share"))
    u = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    return labelled.join(F.broadcast(share), F.col("lang") == F.col("_lang")).filter(u < F.col("_share")).drop("_lang", "_share")


def predict(docs: DataFrame, langs: list[str], log_prob: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score for docs (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(log_prob)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = model.value, 0.0
        for batch, feature, row, again, more in counted(batches):
            n = batch.num_rows
            total = np.zeros((n, max(1, len(langs))))
            for k in range(len(langs)):
                total[:, k] = np.bincount(row, weights=table[:, k][feature], minlength=n)
            if langs:
                total[0] += held - table[again].sum(axis=0)
            held = total[0].copy() if more else 0.0
            if more:
                continue
            best = total.argmax(axis=1)
            sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            known = [bool(langs) and any(map(str.isalpha, t.as_py() or "")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([langs[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()), pa.array(np.where(known, sure, 0.0))],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    train = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null").filter(crc_fold("doc_id") != 2)
    found = predict(docs, *fit(sample_by_lang(train)))
    return found.select("doc_id", (F.coalesce(crc_fold("doc_id"), F.lit(-1)) == 2).alias("held_out"), "lang_pred", "score")
