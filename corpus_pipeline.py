"""Corpus pipeline: quality, language, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All stages but the last return the
columns of the documents they got; a stage works on all its predecessor kept.
"""

from __future__ import annotations

import atexit
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontamination, languages, minhash, quality
from tessera.llm.common import free_names, shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes to be of low quality or toxic go; null and empty texts too."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model, F.col("source"), F.col("lang")).filter("kept").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: no letter, or no mixture of languages explains the text better than chance."""
    langs, model = languages.learn(docs.filter(languages.training_rows(F.col("doc_id"))), "text", "lang", "doc_id")
    (out,) = free_names(docs, 1)
    found = languages.identify(docs, langs, model, out=out)
    return found.filter((F.col(out)["lang_pred"] != "und") & (F.col(out)["fit"] >= 0)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, similarity 0.8 or more."""
    return minhash.drop_duplicates(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text."""
    coded = bpe.encode_bpe(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
    return coded.select("doc_id", "bpe.n_tokens", "bpe.ids", "bpe.ids_sha256", "bpe.decoded_sha256")


STAGES = [
    ("quality classifier", quality_stage),
    ("language identification", language_stage),
    ("near-duplicate removal", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding", encoding_stage),
]

#: The classifiers and the near-duplicate groups are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared checkpoint folder.

    The tables of earlier stages are deleted as soon as the next one is written; the last
    one, which the result reads, when the interpreter ends.
    """
    base = f"{shared_folder(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    atexit.register(_delete, spark, base)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
