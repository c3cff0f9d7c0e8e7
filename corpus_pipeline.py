"""Stages that turn documents into packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import jaccard, mixing, packing, quality, secrets
from tracewright.llm.common import read, staged


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. A null text is scored as an empty one."""
    return quality.accepted(docs, quality.quality_model(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked ones. Rows with one doc_id are one document; those without text stay."""
    found = jaccard.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id")
    gone = staged(found, "gone")
    few = gone.limit((1 << 20) + 1).count() <= 1 << 20  # longs: broadcast while they are few, else both sides are shuffled
    return docs.join(F.broadcast(gone) if few else gone.hint("shuffle_merge"), "doc_id", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    held = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text"))  # other columns may have any name
    found = secrets.scan(held, secrets.train(secrets.labelled_samples(docs)))
    text = secrets.redact(F.col("text"), F.col("spans"))
    own = {"text": text, "n_chars": F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("doc")["n_chars"])} if "n_chars" in docs.columns else {"text": text}
    return found.select(*(own.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs, mixing.mix_sources(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", accept_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier's fit and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, "stage")
    return docs
