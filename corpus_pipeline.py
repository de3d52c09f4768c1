"""From raw documents to packed sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm.disclosure import sanitise
from seqloom.llm.mixing import apply_mix
from seqloom.llm.packing import pack
from seqloom.llm.quality_rules import apply_quality_rules
from seqloom.llm.queries import tokenizer_path
from seqloom.llm.set_sketch import SketchParams, keep_one_of_each
from seqloom.storage import stored

#: Five words and 0.8, so that a copy with a block added or cut is near. 24 bands of 5 registers miss one pair in
#: 10,000 at 0.8; the estimate of 120 registers errs by 0.037 there, so the default margin is five times that.
NEAR = SketchParams(shingle=5, threshold=80, bands=24, rows=5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return apply_quality_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one_of_each(docs, NEAR)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and the terms that disclose it replaced."""
    return sanitise(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: Sketches, tokenizers and rounding by hash are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
