"""Dates in texts, shapes of keys, delimited lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dates_in(text: Column) -> Column:
    """Distinct dates (20yy-mm-dd) that a text holds, sorted; those of no calendar are left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"20\d{2}-\d{2}-\d{2}"), F.lit(0)), lambda x: x.try_cast("date"))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def age_band(days: Column) -> Column:
    return F.when(days > 180, "over 6 months").when(days < 30, "recent").otherwise("ok")


def is_structure_key(text: Column) -> Column:
    """Whether a text has the shape of a hashed structure key: 14, 10 and 1 capital letters."""
    return F.coalesce(text.rlike("^[A-Z]{14}-[A-Z]{10}-[A-Z]$"), F.lit(False))


def relabelled(text: Column, sep: str, labels: dict[str, str]) -> Column:
    """Labels of the known tokens of a delimited list, in its order."""
    tokens = F.filter(F.transform(F.split(text, sep), F.trim), lambda t: t.isin(list(labels)))
    names = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.transform(tokens, lambda t: F.element_at(names, t))
