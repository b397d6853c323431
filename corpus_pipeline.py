"""Training-corpus pipeline: quality rules, near-duplicates, benchmark decontamination, source
mixing, token files. Each stage gets what its predecessor kept, written as Parquet and read
again, and calls one operator of ``timberline.llm``.

Stages use only the columns doc_id, text and source; all others pass through unchanged.
"""

from __future__ import annotations

import uuid

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from timberline.llm import decontam, mixing, quality, simhash, tokenbin
from timberline.llm.common import documents, table, unnest
from timberline.session import discard, land, scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default quality policy keeps."""
    judged = quality.apply_policy(quality.ledger(docs), quality.POLICIES[quality.DEFAULT_POLICY])
    return unnest(judged.where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixed corpus; a digest row for each document in them."""
    path = tokenbin.new_path(spark)
    tokenbin.write(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenbin.digests(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: SimHash and the tokenizer cannot be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``, each written and read again; a stage's
    files go when its successor is written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}-{uuid.uuid4().hex}")
        docs = land(stage(spark, docs, sf_dir), path)
        if before is not None:
            discard(spark, before)
        before = path
    return docs
