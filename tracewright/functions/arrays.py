"""Values computed once, and running totals within arrays, without growing an array element by element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, whatever filters and columns read them; a projection's would be copied into each of these."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of integers from 0 on, taken within blocks of about the root of its size, then over the blocks."""

    def totals(xs: Column) -> Column:
        step = lambda acc, x: let(combine(acc["at"], x), lambda y: F.struct(y.alias("at"), F.array_append(acc["out"], y).alias("out")))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, first, step, lambda acc: acc["out"])

    def blocked(xs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(xs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), lambda i: totals(F.slice(xs, i * size + 1, size)))
        return let(blocks, whole)

    def whole(blocks: Column) -> Column:
        until = totals(F.transform(blocks, lambda b: F.element_at(b, -1)))
        before = F.concat(F.array(F.lit(0)), F.slice(until, 1, F.size(until) - 1))
        return F.flatten(F.zip_with(blocks, before, lambda b, t: F.transform(b, lambda x: combine(t, x))))

    return let(values, lambda xs: F.when(F.size(xs) > 0, blocked(xs)).otherwise(xs))


def plus(a: Column, b: Column) -> Column:
    return a + b


def matches(text: Column, pattern: str) -> Column:
    """start, value of a pattern's matches: what ends where is a running sum of what was split off and matched."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b"))

    def placed(x: Column) -> Column:
        ends = running(F.zip_with(x["m"], F.slice(x["b"], 1, F.size(x["m"])), lambda m, b: F.length(m) + F.length(b)), plus)
        return F.zip_with(x["m"], ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), m.alias("value")))

    return let(found, placed)
