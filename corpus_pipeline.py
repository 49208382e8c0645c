"""The corpus pipeline: quality rules, language, exact and near duplicates, packing."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from runlens.llm import exact_dedup, language_id, near_dedup, packing, quality  # noqa: E402
from runlens.llm.common import prepared  # noqa: E402
from runlens.llm.queries import TOKENIZER  # noqa: E402
from runlens.session import written  # noqa: E402
from runlens.tables import load  # noqa: E402


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    prepared(spark)
    return quality.cleaned(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, as found in the text."""
    prepared(spark)
    return language_id.kept(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the largest id, of those equal up to the case of A-Z."""
    prepared(spark)
    return exact_dedup.deduplicate(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of those linked by 0.8 of their five-word shingles."""
    prepared(spark)
    return near_dedup.kept(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents in padded batches."""
    prepared(spark)
    return packing.pack(packing.lengths(docs, TOKENIZER))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("packing", packing_stage),
]

# The language models have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
