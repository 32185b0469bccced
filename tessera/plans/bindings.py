"""The operators' roles bound to the test tables, and the same as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as measurements: entity, source, assay, endpoint, value, qualifier, status, usable."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entity"), F.col("l_returnflag").alias("source"), F.col("l_suppkey").cast("string").alias("assay"),
        F.col("l_linestatus").alias("endpoint"), F.col("l_extendedprice").alias("value"), F.col("l_partkey").alias("part"),
        F.when(F.col("l_discount") > 0.085, "<").when(F.col("l_discount") > 0.065, "<=").when(F.col("l_discount") > 0.045, ">").when(F.col("l_discount") > 0.025, "~").otherwise("").alias("qualifier"),
        F.when(F.col("l_tax") > 0.075, "PARSE_ERROR").when(F.col("l_tax") > 0.065, "QUALIFIER_ONLY").when(F.col("l_tax") > 0.055, "NO_VALUE").otherwise("OK").alias("status"),
        (F.col("l_quantity") > 3).alias("usable"),
    )


M = """m AS (
  SELECT l_orderkey AS entity, l_returnflag AS source, CAST(l_suppkey AS varchar) AS assay, l_linestatus AS endpoint,
         l_extendedprice AS value, l_partkey AS part,
         CASE WHEN l_discount > 0.085 THEN '<' WHEN l_discount > 0.065 THEN '<=' WHEN l_discount > 0.045 THEN '>' WHEN l_discount > 0.025 THEN '~' ELSE '' END AS qualifier,
         CASE WHEN l_tax > 0.075 THEN 'PARSE_ERROR' WHEN l_tax > 0.065 THEN 'QUALIFIER_ONLY' WHEN l_tax > 0.055 THEN 'NO_VALUE' ELSE 'OK' END AS status,
         l_quantity > 3 AS usable
  FROM lineitem)"""

RANK = "CASE status WHEN 'OK' THEN 0 WHEN 'NO_VALUE' THEN 1 WHEN 'QUALIFIER_ONLY' THEN 2 WHEN 'UNCONVERTIBLE_UNITS' THEN 3 WHEN 'PARSE_ERROR' THEN 4 ELSE -1 END"


def rep_sql(keys: str) -> str:
    return f"""rep AS (
  SELECT {keys}, count(*) AS n_replicates, 9 - avg(CASE WHEN value > 0 THEN log10(value) END) AS potency,
         avg(CASE WHEN value > 0 THEN log10(value) END) AS log_mean, stddev_samp(CASE WHEN value > 0 THEN log10(value) END) AS log_std,
         min(value) AS value_min, max(value) AS value_max,
         CASE WHEN bool_or(qualifier IN ('<', '<=')) THEN '<' WHEN bool_or(qualifier = '>') THEN '>' WHEN bool_or(qualifier = '~') THEN '~' ELSE '' END AS any_qualifier,
         arg_max(status, {RANK}) AS worst_status, bool_or(usable) AS usable
  FROM m GROUP BY {keys})"""


SRC = """src AS (
  SELECT entity, source, endpoint, count(DISTINCT assay) AS n_assays, sum(n_replicates)::bigint AS n_measurements, avg(potency) AS potency_source,
         stddev_samp(potency) AS potency_std, max(potency) - min(potency) AS assay_spread, min(value_min) AS value_min, max(value_max) AS value_max,
         string_agg(DISTINCT assay, '|' ORDER BY assay) AS assay_list, bool_or(usable) AS usable
  FROM rep GROUP BY entity, source, endpoint)"""

ENT = """ent AS (
  SELECT entity, count(DISTINCT source) AS n_sources, sum(n_measurements)::bigint AS n_measurements, avg(potency_source) AS consensus,
         max(potency_source) - min(potency_source) AS spread, string_agg(DISTINCT source, '|' ORDER BY source) AS source_list
  FROM src WHERE usable GROUP BY entity)"""

CONSENSUS = f"WITH {M}, {rep_sql('entity, source, assay, endpoint')}, {SRC}, {ENT}"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles are summed in another order by another engine; both sides are compared at six digits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
