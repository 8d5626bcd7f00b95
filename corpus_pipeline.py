"""The corpus pipeline: five stages from raw documents to packed training sequences, each written and read again by whoever runs them."""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession

from lumensift.llm import decontaminate as contamination_op, langid, near_dup, pack, substring_dedup
from lumensift.llm.common import tables
from lumensift.llm.queries import tokenizer_path
from lumensift.session import ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents that aren't held out; documents without a letter go."""
    ship_package(spark)
    return langid.keep_identified(docs, langid.learn_from(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest id."""
    ship_package(spark)
    return near_dup.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut from the text."""
    ship_package(spark)
    return substring_dedup.remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    ship_package(spark)
    (benchmark,) = tables(spark, sf_dir, "benchmark")
    return contamination_op.decontaminate(docs, benchmark)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokens, packed into sequences."""
    ship_package(spark)
    return pack.pack_documents(docs, tokenizer_path())


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("substring_dedup", substrings), ("decontamination", decontaminate), ("packing", packing)]

#: Signatures, language models, indexes and tokenizers are beyond SQL; tests compare the stages with plain versions of their rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage is written to the shared checkpoint folder and read again."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    out = f"{shared.rstrip('/')}/pipeline-{spark.sparkContext.applicationId}-{os.urandom(4).hex()}"
    (docs,) = tables(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{out}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
