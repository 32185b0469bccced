"""Deterministic lookups, marks and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import free_names


def pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in the order; the order must tell all rows apart."""
    w = Window.partitionBy(*keys).orderBy(*order)
    (n,) = free_names(df, 1)
    return df.withColumn(n, F.row_number().over(w)).filter(F.col(n) == 1).drop(n)


def first_wins(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The first non-null value of each key in the order, as an aggregate without a sort."""
    kept = df.filter(F.col(value).isNotNull())
    return kept.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def last_wins(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def mark(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with whether its key is in ``other``."""
    (held,) = free_names(df, 1, name)
    there = other.select(key).distinct().withColumn(held, F.lit(True))
    return df.join(there, key, "left").withColumn(name, F.col(held).isNotNull()).drop(held)


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys on one side only, on both, and the largest difference of the value."""
    a, b = left.select(F.col(key).alias("k"), F.col(value).alias("x")), right.select(F.col(key).alias("j"), F.col(value).alias("y"))
    both = a.join(b, a.k.eqNullSafe(b.j), "full_outer")
    return both.agg(F.count_if(F.col("j").isNull()).alias("only_left"), F.count_if(F.col("k").isNull()).alias("only_right"), F.count_if(F.col("j").isNotNull() & F.col("k").isNotNull()).alias("both"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_diff"))


def match_by_priority(entities: DataFrame, methods: list[DataFrame], key: str) -> DataFrame:
    """The match of the first method that has one (smallest match on ties); unmatched entities stay, with nulls.

    Each method has the columns ``key`` and ``match``.
    """
    found = reduce(DataFrame.unionByName, (m.select(key, "match", F.lit(i + 1).alias("method")) for i, m in enumerate(methods)))
    best = found.groupBy(key).agg(F.min(F.struct("method", "match")).alias("b")).select(key, "b.method", "b.match")
    return entities.join(best, key, "left")


def trace(keys: DataFrame, key: str, stages: dict[str, DataFrame]) -> DataFrame:
    """Which stages hold each key, and the first that does not (``lost_at``, null if all do)."""
    rows = keys
    for name, stage in stages.items():
        rows = mark(rows, stage, key, f"in_{name}")
    lost = F.coalesce(*(F.when(~F.col(f"in_{name}"), F.lit(name)) for name in stages))
    return rows.withColumn("lost_at", lost)


def pair_key(a: Column, b: Column) -> Column:
    """The same for both orders of a pair."""
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def first_found(df: DataFrame, keys: list[str], tables: list[tuple[str, DataFrame]], computed: dict[str, Column]) -> DataFrame:
    """``df`` with the columns of ``computed`` from the first of ``tables`` (name, rows unique by ``keys``) that has the key, else as computed; and ``found_in``."""
    made, marks, own_names = df, [], free_names(df, len(tables), "found_in", *computed)
    for at, (name, rows) in zip(own_names, tables):
        made = made.join(rows.select(*keys, F.struct(*computed).alias(at)), keys, "left")
        marks.append((F.col(at).isNotNull(), name))
    found = F.coalesce(*(F.when(there, F.lit(name)) for there, name in marks), F.lit("computed"))
    values = {}
    for c, own in computed.items():
        picked = own
        for at in reversed(own_names):
            picked = F.when(F.col(at).isNotNull(), F.col(f"{at}.{c}")).otherwise(picked)
        values[c] = picked
    return made.select(*df.columns, *(v.alias(c) for c, v in values.items()), found.alias("found_in"))


def shares_any(pairs: DataFrame, members: DataFrame, key: str, item: str) -> DataFrame:
    """Pairs (a, b) with ``shared``: whether their sets of items overlap. Items of one end are looked up at the other, so that no set is gathered."""
    own = members.select(F.col(key).alias("k"), F.col(item).alias("i")).filter("k IS NOT NULL AND i IS NOT NULL").distinct()
    met = pairs.select("a", "b").distinct().join(own.withColumnRenamed("k", "a"), "a").join(own.withColumnRenamed("k", "b"), ["b", "i"], "left_semi")
    (held,) = free_names(pairs, 1, "shared")
    return pairs.join(met.select("a", "b").distinct().withColumn(held, F.lit(True)), ["a", "b"], "left").withColumn("shared", F.col(held).isNotNull()).drop(held)
