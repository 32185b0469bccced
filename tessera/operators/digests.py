"""Digests of whole tables that do not depend on order or partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_digest(df: DataFrame, columns: list[str] | None = None):
    """SHA-256 of a row's cells in order; each cell is its text with its length, or a mark for null."""
    cells = [F.col(f"`{c}`").cast("string") for c in columns or df.columns]
    marked = [F.when(c.isNull(), F.lit("~;")).otherwise(F.concat(F.char_length(c).cast("string"), F.lit(":"), c, F.lit(";"))) for c in cells]
    return F.sha2(F.concat(*marked), 256)


def table_digest(df: DataFrame, columns: list[str] | None = None, levels: tuple[int, ...] = (6, 3)) -> DataFrame:
    """One row: n and the root of a Merkle tree over the rows' digests.

    Equal rows are counted first. A leaf holds the digests that share their first ``levels[0]``
    hexadecimal digits, in order and with counts; a node the digests of its children; so no
    task holds more than a leaf, whose size is the table's by 16 to the power of that level.
    """
    by = df.groupBy(row_digest(df, columns).alias("h")).agg(F.count("*").alias("k"))
    level = by.select(F.col("h").alias("at"), F.concat("h", F.lit("x"), F.col("k").cast("string")).alias("d"), "k")
    for digits in (*levels, 0):
        held = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]), ",")
        level = level.groupBy(F.substring("at", 1, digits).alias("at")).agg(F.sha2(held, 256).alias("d"), F.sum("k").alias("k"))
    return level.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.max("d"), F.sha2(F.lit(""), 256)).alias("root"))
