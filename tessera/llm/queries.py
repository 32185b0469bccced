"""Queries of the training-data operators, over whole tables.

Each has the operator's production parameters; digest columns are derived from what
the operator returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chats, decontamination, dialogues, filter_audit, imatch, languages, licenses, minhash, mixing, quality, sharding, token_counts
from tessera.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    made = sharding.shard(docs, 40, carry=["doc_id", "text_crc32"])
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan_licenses(docs)
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return found.select("doc_id", *(f"license.{c}" for c in columns))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "tokens.n_tokens", "tokens.score")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chats.collapse(table(spark, sf_dir, "conversations"))
    return made.select("conv_id", "segment", "n_turns", "copies", F.md5("text").alias("text_md5"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    langs, model = languages.learn(docs.filter(languages.training_rows(F.col("doc_id"))), "text", "lang", "doc_id")
    found = languages.identify(docs.drop("lang"), langs, model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score", F.array_join("language.langs", ",").alias("langs"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = imatch.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    found = quality.classify(docs, model, F.col("source"), F.col("lang"))
    return found.select("doc_id", "p_low", "p_toxic", "host_low", "path_low", "host_toxic", "path_toxic", "kept")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_bpe(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return coded.select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # fragments of under 20 words are half as likely as other documents of their source
    return mixing.mix(docs, carry=["doc_id"], preference=lambda size: F.when(size < 20, 0.5).otherwise(1.0))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    cells = filter_audit.mask_cells(docs, labels, filter_audit.text_conditions(F.col("text")), F.col("source"))
    made = filter_audit.audit(cells, "ABCDE")
    return made.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_license_scan": op2_license_scan,
    "op3_token_counts": op3_token_counts,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_language_id": op5_language_id,
    "op6_bpe": op6_bpe,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality": op8_quality,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_decontamination": op10_decontamination,
    "op11_mixing": op11_mixing,
    "op12_filter_audit": op12_filter_audit,
    "op13_dialogue_repair": op13_dialogue_repair,
}

ORACLE: dict[str, str] = {
    "op1_sharding": sharding.SHARDING_SQL,
    "op4_chat_formatting": chats.COLLAPSE_SQL,
    "op9_near_duplicates": minhash.CLASSES_SQL,
    "op11_mixing": mixing.MIXING_SQL,
    "op12_filter_audit": filter_audit.AUDIT_SQL,
    "op13_dialogue_repair": dialogues.REPAIR_SQL,
}
