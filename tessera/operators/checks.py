"""Validation: claims, invariants, dependencies, breakdowns; results are rows, gates raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import free_names


def claim(metric: str, claimed: Column, actual: Column, tolerance: float | None = 0.0) -> Column:
    """Struct metric, claimed, actual, status: PASS within the tolerance, FAIL beyond, INFO without one."""
    status = F.lit("INFO") if tolerance is None else F.when(F.abs(claimed - actual) <= tolerance, "PASS").otherwise("FAIL")
    return F.struct(F.lit(metric).alias("metric"), claimed.cast("double").alias("claimed"), actual.cast("double").alias("actual"), status.alias("status"))


def claims(row: DataFrame, *each: Column) -> DataFrame:
    """A row for each claim about a one-row summary."""
    return row.select(F.explode(F.array(*each)).alias("c")).select("c.*")


def gate(checked: DataFrame) -> None:
    """Raise if any check failed; names the first ten."""
    failed = [r["metric"] for r in checked.filter("status = 'FAIL'").limit(10).collect()]
    if failed:
        raise AssertionError(f"checks failed: {', '.join(failed)}")


def dependency(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys, keys with several values, values with several keys, null values."""
    pairs = df.groupBy(key, value).agg(F.count("*").alias("k"))
    one = pairs.groupBy(key).agg(F.count(value).alias("v")).agg(F.count("*").alias("n_keys"), F.count_if(F.col("v") > 1).alias("keys_with_several"))
    two = pairs.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(key).alias("v")).agg(F.count_if(F.col("v") > 1).alias("values_with_several"))
    null = pairs.agg(F.coalesce(F.sum(F.when(F.col(value).isNull(), F.col("k"))), F.lit(0)).alias("null_values"))
    return one.crossJoin(two).crossJoin(null)  # one row each


def offenders(df: DataFrame, key: str, value: str, k: int = 10) -> DataFrame:
    """The ``k`` keys with the most different values (two at least): key, n_values, n_rows and up to five values."""
    pairs = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("k"))
    made = pairs.groupBy(key).agg(F.count("*").alias("n_values"), F.sum("k").alias("n_rows")).filter("n_values > 1")
    top = made.orderBy(F.desc("n_values"), key).limit(k)
    (place,) = free_names(pairs, 1)
    values = pairs.join(F.broadcast(top.select(key)), key, "left_semi")  # k keys
    values = values.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(value))).filter(F.col(place) <= 5)  # tasks keep five each before the shuffle
    values = values.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("examples"))
    return top.join(F.broadcast(values), key)


def reported(row: DataFrame, reported: dict[str, float], places: int = 3, tolerance: float = 0.02) -> DataFrame:
    """A row for each reported figure against the column of its name in a one-row summary: difference and MATCH or DISCREPANCY."""
    def one(name: str, figure: float) -> Column:
        difference = F.round(F.abs(F.lit(float(figure)) - F.col(name).cast("double")), places)
        return F.struct(F.lit(name).alias("metric"), F.lit(float(figure)).alias("reported"), F.col(name).cast("double").alias("recomputed"), difference.alias("difference"), F.when(difference < tolerance, "MATCH").otherwise("DISCREPANCY").alias("status"))

    return row.select(F.explode(F.array(*(one(k, v) for k, v in reported.items()))).alias("r")).select("r.*")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("times")).filter("times > 1")


def unknown_tokens(df: DataFrame, column: str, known: list[str], sep: str = r"\|") -> DataFrame:
    """Tokens of a delimited column that are not known, with how often."""
    rows = df.select(F.explode(F.split(column, sep)).alias("token"))
    return rows.filter(~F.col("token").isin(known)).groupBy("token").agg(F.count("*").alias("times"))


def breakdown(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """Expected (label, expected) against counted labels, both sides kept."""
    seen = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("actual"))
    made = expected.join(seen, "label", "full_outer")
    made = made.select("label", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return made.withColumn("status", F.when(F.col("expected") == F.col("actual"), "PASS").otherwise("FAIL"))


def completeness(df: DataFrame, split: Column) -> DataFrame:
    """One row: rows on both sides of a split, and whether they are all (null counts as no)."""
    yes = F.coalesce(split, F.lit(False))
    made = df.agg(F.count_if(yes).alias("n_in"), F.count_if(~yes).alias("n_out"), F.count("*").alias("n_all"))
    return made.withColumn("complete", F.col("n_in") + F.col("n_out") == F.col("n_all"))
