"""Helpers shared by the training-data operators."""

from __future__ import annotations

import itertools
import math
import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes an Arrow batch may hold, so that long texts do not fill a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: A table of at most so many rows may be broadcast; above it the join is shuffled. Small, so that inputs of all but the
#: smallest sizes are joined alike and what is measured on some 100 MB holds for more.
BROADCAST_ROWS = 2_000
#: A word of the contracts that count words: a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to BATCH_ROWS and BATCH_BYTES if they are above."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        try:
            now = spark.conf.get(key)
            if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
                spark.conf.set(key, str(most))
        except Exception as e:  # a setting this Spark version does not have
            if "CONF" not in str(e).upper():
                raise


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (tests) may go without; it gets a temporary one.
    """
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and cut from its lineage.

    Spark deletes the files when the result is no longer used, if the session has
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    shared_folder(df.sparkSession)
    done = df.checkpoint(eager=True)
    # The checkpoint keeps its plan's size estimate, a product over all joins so far. In loops
    # that grows beyond all bounds, so the rows are taken as a table of unknown size.
    session = df.sparkSession._jsparkSession
    return DataFrame(session.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), df.sparkSession)


def counted(df: DataFrame, rows_a_task: int = 50_000, *others: Column) -> tuple:
    """``durable(df)`` in as many partitions as its rows need, its number of rows and ``others`` (aggregates).

    The figures are observed as the rows are written, without a pass of their own.
    """
    seen = Observation()
    done = durable(df.observe(seen, F.count("*").alias("n"), *(c.alias(f"c{i}") for i, c in enumerate(others))))
    n = seen.get["n"]
    return done.coalesce(max(1, -(-n // rows_a_task))), n, *(seen.get[f"c{i}"] for i in range(len(others)))


def in_tasks(df: DataFrame, n: float) -> DataFrame:
    """``df`` in at most ``n`` tasks, though one for each core: short rows go to few files."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n)))


def if_small(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` counted rows (of a few numbers each) to be broadcast if they are at most BROADCAST_ROWS; else it is shuffled."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def free_names(df: DataFrame, k: int) -> list[str]:
    """``k`` column names that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return list(itertools.islice((x for i in itertools.count() if (x := f"__{i}") not in taken), k))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))
