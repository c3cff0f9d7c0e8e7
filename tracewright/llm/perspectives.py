"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as assistant, the
others as named users, and training masks over what the assistant says. Speakers in `silent` (system) are
context: rendered as such in every perspective, none of their own. The rendering of a dialogue is the
concatenation of its rows' segments by turn; rows carry their place in it, so a conversation of any
length is never gathered. Places are prefix sums over parts of PART turns, then within a part.

DataFrame expressions only.

Defined results: a null role is the speaker `unknown`, a null text an empty one; `<|` in a text or a name is
written `< |`, and in a name also `|>` as `| >` and each line break as a blank, so a name can't end its header; a null turn comes last; equal turns are ordered by role, then text; repeated rows are said as often
as they occur; a conversation of silent speakers alone gives no row, nor does an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

SILENT = ("system",)
PART = 256


def rotate(turns: DataFrame, silent: tuple[str, ...] = SILENT) -> DataFrame:
    """conv_id, perspective, turn, speaker, chat_role, segment, start, end, mask_start, mask_end (code points; masks null where not trained on)."""
    safe = lambda c, other: F.regexp_replace(F.coalesce(F.col(c), F.lit(other)), r"<\|", "< |")
    name = F.regexp_replace(F.regexp_replace(safe("role", "unknown"), r"\|>", "| >"), r"[\n\r]", " ")
    said = turns.select("conv_id", "turn", name.alias("speaker"), safe("text", "").alias("text"))
    people = said.filter(~F.col("speaker").isin(*silent)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    rows = said.join(people.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    role = F.when(F.col("speaker") == F.col("perspective"), "assistant").when(F.col("speaker").isin(*silent), F.col("speaker")).otherwise("user")
    opening = F.when(F.col("chat_role") == "user", F.concat(F.lit("<|user name="), F.col("speaker"), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), F.col("chat_role"), F.lit("|>\n")))
    rows = rows.withColumn("chat_role", role).withColumn("opening", opening).withColumn("segment", F.concat("opening", "text", F.lit("<|end|>\n")))
    rows = rows.withColumn("length", F.length("segment").cast("long")).withColumn("part", F.coalesce(F.floor(F.col("turn") / PART), F.lit((1 << 62))).cast("long"))
    key = ["conv_id", "perspective"]
    sums = rows.groupBy(*key, "part").agg(F.sum("length").alias("n"))
    sums = sums.select(*key, "part", (F.sum("n").over(Window.partitionBy(*key).orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("length").over(Window.partitionBy(*key, "part").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("own", own)
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_who")) & (F.col("part") == F.col("_part"))
    rows = rows.join(sums.select(F.col("conv_id").alias("_conv"), F.col("perspective").alias("_who"), F.col("part").alias("_part"), "before"), same)
    end = F.col("before") + F.col("own")
    rows = rows.withColumn("end", end).withColumn("start", end - F.col("length"))
    trained = F.col("chat_role") == "assistant"
    return rows.select(
        "conv_id", "perspective", "turn", "speaker", "chat_role", "segment", "start", "end",
        F.when(trained, F.col("start") + F.length("opening")).alias("mask_start"), F.when(trained, F.col("end") - 1).alias("mask_end"),
    )


def op8_perspective_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(read(spark, sf_dir, "conversations"))


OP8_SQL = r"""
WITH s AS (
  SELECT conv_id, turn, regexp_replace(replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >'), '[\n\r]', ' ', 'g') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM s WHERE speaker <> 'system'
), r AS (
  SELECT s.*, p.perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS chat_role
  FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, CASE WHEN chat_role = 'user' THEN '<|user name=' || speaker || '|>' || chr(10) ELSE '<|' || chat_role || '|>' || chr(10) END AS opening FROM r
), g AS (
  SELECT *, opening || text || '<|end|>' || chr(10) AS segment FROM o
), e AS (
  SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS "end" FROM g
)
SELECT conv_id, perspective, turn, speaker, chat_role, segment, "end" - length(segment) AS start, "end",
  CASE WHEN chat_role = 'assistant' THEN "end" - length(segment) + length(opening) END AS mask_start,
  CASE WHEN chat_role = 'assistant' THEN "end" - 1 END AS mask_end
FROM e
"""
