"""Joins and names that operators share: null-safe keys, sides of a checked size, free names."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a summary that may go to all tasks; a longer one is joined by shuffle.
MOST_ROWS = 4096


def free_names(df: DataFrame, k: int, *taken: str) -> list[str]:
    """``k`` column names that ``df`` does not have and that are not among ``taken``."""
    taken = {c.lower() for c in (*df.columns, *taken)}
    return list(itertools.islice((x for i in itertools.count() if (x := f"__t{i}") not in taken), k))


def on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, keys compared null-safe; without keys ``right`` is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    names = free_names(left, len(keys), *right.columns)
    right = right.withColumnsRenamed(dict(zip(keys, names)))
    met = None
    for k, n in zip(keys, names):
        same = F.col(k).eqNullSafe(F.col(n))
        met = same if met is None else met & same
    return left.join(right, met, how).drop(*names)


def settled(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """A summary as it is now: broadcast if it has at most ``most`` rows, else as it was given."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df
