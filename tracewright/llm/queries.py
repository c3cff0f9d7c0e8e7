"""Queries of the numbered operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collisions, jaccard, language, manifest, mixing, negatives, neighbours, packing, perspectives, quality, secrets, templates, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_nearest_neighbours": neighbours.op2_nearest_neighbours,
    "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_embedding_near_dedup": collisions.op5_embedding_near_dedup,
    "op6_language_id": language.op6_language_id,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_perspective_chats": perspectives.op8_perspective_chats,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_warc": warc.op10_warc,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_html_extraction": templates.op12_html_extraction,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}

SQL: dict[str, str] = {
    "op2_nearest_neighbours": neighbours.OP2_SQL,
    "op3_ngram_jaccard_join": jaccard.OP3_SQL,
    "op8_perspective_chats": perspectives.OP8_SQL,
    "op9_source_mixing": mixing.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_html_extraction": templates.OP12_SQL,
    "op13_merkle_manifest": manifest.OP13_SQL,
}
