"""Registered queries of the training-data operators: each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import (collocation, decontam, fim, langid, lm, mixing, quality, secret_scan, sharding, simhash, substring,
                            tokenbin, toxicity)
from timberline.llm.common import documents, table
from timberline.llm.oracle import ORACLE  # noqa: F401

TOKENIZER = "word_bpe_49k.json"


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.kept_digest(substring.dedup(documents(spark, sf_dir)))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir))
    return found.select("doc_id", "at", F.length("value").cast("long").alias("length"), "name",
                        F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.match(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("row__.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenbin.new_path(spark)
    tokenbin.write(documents(spark, sf_dir), path, public_tokenizers.path(TOKENIZER))
    return tokenbin.digests(spark, path)


def quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The policy and the bits that the query's SQL defines; the pipeline keeps by the default policy.
    policy = quality.POLICIES["full-1"]
    judged = quality.apply_policy(quality.ledger(documents(spark, sf_dir)), policy)
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.POLICIES["base-1"].mask)) != 0
    return judged.select("row__.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base.alias("base_failed"), "kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("fail_bits"))


def _remainder(n: int):
    """crc32 of the doc_id as text, modulo n: which rows are held out of learning."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, _remainder(4) != 2)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("row__.doc_id", "lang_pred", "score", "rejected").withColumn(
        "held_out", _remainder(4).eqNullSafe(2))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), _remainder(3) != 1)
    found = toxicity.score(docs, model).select("row__.doc_id", "score")
    return found.withColumn("held_out", _remainder(3).eqNullSafe(1)).withColumn(
        "predicted", (F.col("score") >= 0.7).cast("int"))


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), _remainder(5) == 1)


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transform(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("row__.doc_id", "n", "form", "prefix_chars", "middle_chars",
                        F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(documents(spark, sf_dir), 16, carry=["doc_id"])
    return found.select("row__.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocation.collocations(documents(spark, sf_dir))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup,
    "op2_secret_scan": secrets,
    "op3_benchmark_decontamination": decontamination,
    "op4_lm_scoring": lm_scores,
    "op5_toxicity": toxicity_scores,
    "op6_source_mixing": source_mix,
    "op7_simhash_near_dedup": simhash_components,
    "op8_language_id": language_id,
    "op9_token_output": token_output,
    "op10_quality_rules": quality_ledger,
    "op11_fill_in_middle": fill_in_middle,
    "op12_sharding": shards,
    "op13_collocations": collocations,
}
