"""Maps from keys that may come twice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let


def first_of_each(entries: Column, key: str = "k") -> Column:
    """A map of an array of structs of a key (its field's name is given) and a value: of a key that comes twice the first, none of a null one."""
    first = lambda es, ks: F.when(F.size(F.array_distinct(ks)) == F.size(ks), es).otherwise(F.filter(es, lambda e, i: F.array_position(ks, e[key]) == i + 1))
    named = lambda es: let(F.transform(es, lambda e: e[key]), lambda ks: F.map_from_entries(first(es, ks)))
    return let(F.filter(entries, lambda e: e[key].isNotNull()), named)


def text_map(text: Column, between: str, sign: str) -> Column:
    """A map of `key sign value` pairs in a text; a pair without the sign has a null value, an empty key is left out."""
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), between), lambda p: F.substring_index(p, sign, 1) != "")
    value = lambda p: F.when(F.contains(p, F.lit(sign)), p.substr(F.length(F.substring_index(p, sign, 1)) + len(sign) + 1, F.length(p)))
    return first_of_each(F.transform(pairs, lambda p: F.struct(F.substring_index(p, sign, 1).alias("k"), value(p).alias("v"))))
