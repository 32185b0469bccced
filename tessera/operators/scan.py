"""Distributed prefix scans: running sums, running extremes and row numbers over one global order.

Rows are cut into ranges of the order by boundaries from a sample, each range is summarised,
the summaries are carried over the ranges, and each range is scanned on its own with what
comes before it. No task sees more than a range and the summaries, one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import free_names, on_keys

#: Sampled rows for each range; a table of fewer rows than the sample is one range.
SAMPLES_A_RANGE = 32


def boundaries(df: DataFrame, order: list[Column], ranges: int) -> list[tuple]:
    """Ascending keys of ``order`` that cut ``df`` into about even ranges; none for a short table."""
    named = [c.alias(f"k{i}") for i, c in enumerate(order)]
    sample = df.select(*named, F.xxhash64(*order).alias("h")).orderBy("h").limit(ranges * SAMPLES_A_RANGE).drop("h").collect()
    if len(sample) < ranges * SAMPLES_A_RANGE:
        return []
    keys = sorted({tuple(r) for r in sample}, key=lambda k: tuple((x is not None, x) for x in k))
    return keys[SAMPLES_A_RANGE::SAMPLES_A_RANGE]


def with_range(df: DataFrame, order: list[Column], name: str, ranges: int) -> DataFrame:
    """``df`` with the number of the range of ``order`` (ascending, nulls first) that a row lies in."""
    bounds = boundaries(df, order, ranges)
    if not bounds:
        return df.withColumn(name, F.lit(0))
    types = df.select(*(c.alias(f"k{i}") for i, c in enumerate(order))).dtypes
    schema = f"bounds array<struct<{','.join(f'{n}:{t}' for n, t in types)}>>"
    (held,) = free_names(df, 1, name)
    listed = df.sparkSession.createDataFrame([(bounds,)], schema).withColumnRenamed("bounds", held)  # one row
    own = F.struct(*(c.alias(n) for c, (n, _) in zip(order, types)))
    return df.crossJoin(F.broadcast(listed)).withColumn(name, F.size(F.filter(held, lambda b: b <= own))).drop(held)


def scan(df: DataFrame, order: list[Column], before: dict[str, Column] | None = None, least: dict[str, Column] | None = None, group: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with, for each name of ``before``, the sum of its column over all rows that come earlier in ``order``
    and, for each name of ``least``, the minimum of its column over these rows and the row itself.

    ``order``: ascending and unique within a group (equal rows are put in any order); for a
    descending one give the negative. With ``group`` each group is scanned on its own. ``df`` is
    evaluated twice and sampled once, so it should be short or materialised. Sums of no rows are 0.
    """
    before, least, group = before or {}, least or {}, group or []
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = free_names(df, 1 + len(order) + 2 * (len(before) + len(least)), *before, *least)
    part, keys = names[0], names[1 : 1 + len(order)]
    inner, outer = names[1 + len(order) :: 2], names[2 + len(order) :: 2]
    rows = with_range(df, order, part, ranges).withColumns(dict(zip(keys, order)))
    within = Window.partitionBy(*group, part).orderBy(*keys)
    earlier, upto = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(Window.unboundedPreceding, 0)
    # the ranges' summaries: one row for each range and group
    ahead = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    made, sums = {}, [(F.sum, k, c) for k, c in before.items()] + [(F.min, k, c) for k, c in least.items()]
    totals = rows.groupBy(*group, part).agg(*(f(c).alias(o) for (f, _, c), o in zip(sums, outer)))
    totals = totals.select(*group, part, *(f(o).over(ahead).alias(o) for (f, _, _), o in zip(sums, outer)))
    rows = rows.withColumns({i: f(c).over(earlier if f is F.sum else upto) for (f, _, c), i in zip(sums, inner)})
    totals = totals if group else F.broadcast(totals)  # without groups: a row for each range
    rows = on_keys(rows, totals, [*group, part])
    for (f, k, _), i, o in zip(sums, inner, outer):
        made[k] = F.coalesce(i, F.lit(0)) + F.coalesce(o, F.lit(0)) if f is F.sum else F.least(i, o)
    return rows.withColumns(made).drop(part, *keys, *inner, *outer)


def numbered(df: DataFrame, order: list[Column], name: str, group: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with its rows' numbers in ``order``, from 0."""
    return scan(df, order, before={name: F.lit(1).cast("long")}, group=group, ranges=ranges)
