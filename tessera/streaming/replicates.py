"""Extension: replicate aggregation of a stream of measurements by event-time window.

The state of a group is a count, a sum and a sum of squares of logarithms, so that
windows merge exactly and late rows within the watermark are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_replicates(stream: DataFrame, time: str, keys: list[str], value: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    v = F.col(value)
    log = F.when(v > 0, F.log10(v))
    made = stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n_replicates"), F.count(log).alias("n_logs"), F.sum(log).alias("s"), F.sum(log * log).alias("ss"))
    mean = F.col("s") / F.col("n_logs")
    var = (F.col("ss") - F.col("s") * mean) / (F.col("n_logs") - 1)
    return made.select(
        F.col("window.start").alias("start"), *keys, "n_replicates", F.when(F.col("n_logs") > 0, 9 - mean).alias("potency"),
        F.when(F.col("n_logs") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("log_std"),
    )
