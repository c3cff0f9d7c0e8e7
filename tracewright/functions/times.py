"""Timestamps from the forms that logs use, and durations for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILETIME_EPOCH = 116444736000000000


def from_filetime(ticks: Column) -> Column:
    """100 ns ticks since 1601; before 1970 it is 1970."""
    return F.timestamp_micros(F.greatest(F.floor((ticks.cast("long") - FILETIME_EPOCH) / 10), F.lit(0)).cast("long"))


def parsed_time(text: Column) -> Column:
    """ISO 8601, RFC 2822, epoch seconds or milliseconds; null where none fits (never the present)."""
    number = text.try_cast("double")
    epoch = F.timestamp_micros(F.when(number > 1e11, number * 1000).otherwise(number * 1000000).cast("long"))
    mail = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\w{3},\s*", ""), r"\s*\([^)]*\)$", "")
    return F.coalesce(F.when(number.isNotNull(), epoch), F.try_to_timestamp(text), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss z")))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1000000


def duration(seconds: Column) -> Column:
    """+20s, +5m 20s, +2h 15m or +1d 3h, by size."""
    s = F.abs(seconds).cast("long")
    sign = F.when(seconds < 0, "-").otherwise("+")
    part = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(unit))
    return F.concat(
        sign,
        F.when(s < 60, part(s, "s"))
        .when(s < 3600, F.concat_ws(" ", part(F.floor(s / 60), "m"), part(s % 60, "s")))
        .when(s < 86400, F.concat_ws(" ", part(F.floor(s / 3600), "h"), part(F.floor(s % 3600 / 60), "m")))
        .otherwise(F.concat_ws(" ", part(F.floor(s / 86400), "d"), part(F.floor(s % 86400 / 3600), "h"))),
    )
