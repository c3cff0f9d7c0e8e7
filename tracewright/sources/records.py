"""JSON records whose keys nobody promised: as VARIANT, with what can't be read set apart.

A record that is no JSON, no object, or has a key twice costs itself only: it is a row of the rejects, with its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import computed


def objects(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """rows with object, the VARIANT of a JSON object, and reason: why there is none (EMPTY, NOT_JSON, REPEATED_KEY, NOT_AN_OBJECT), else null."""
    text = F.col(raw)
    parsed = computed(rows, object=F.try_parse_json(text))
    reason = (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "EMPTY").when(F.col("object").isNull() & F.get_json_object(text, "$").isNotNull(), "REPEATED_KEY").when(F.col("object").isNull(), "NOT_JSON")
        .when(~F.ltrim(text).startswith("{") & ~F.schema_of_variant("object").startswith("OBJECT"), "NOT_AN_OBJECT")
    )
    return parsed.withColumn("reason", reason)


def good(found: DataFrame) -> DataFrame:
    return found.filter("reason is null").drop("reason")


def rejects(found: DataFrame, raw: str = "raw") -> DataFrame:
    """raw, reason of the rows of objects() that hold none."""
    return found.filter("reason is not null").select(raw, "reason")


def rejects_by_reason(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("reason").agg(F.count("*").alias("records"))


def field(obj: Column | str, *paths: str) -> Column:
    """The first of these fields that a VARIANT has, as text; an object or a list as JSON."""
    obj = F.col(obj) if isinstance(obj, str) else obj
    return F.coalesce(*(F.try_variant_get(obj, f"$.{p}", "string") for p in paths))


def fields(obj: Column | str, path: str = "") -> Column:
    """All fields of a VARIANT object as a map of text; null where it is no object."""
    return F.try_variant_get(F.col(obj) if isinstance(obj, str) else obj, f"${path}", "map<string,string>")
