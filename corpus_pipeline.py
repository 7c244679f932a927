"""documents -> quality rules -> exact dedup -> near dedup -> packing, each stage written and read again.

For every stage: a null text counts as an empty one, nulls in other columns stay, a very long text is used whole, equal
rows are told apart, columns with clashing names are kept apart, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact, near, packing, quality
from quillon.llm.common import scope, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; a null or empty text has under 10 words and goes."""
    return quality.quality_filter(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows that repeat, one."""
    return exact.exact_filter(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id; texts without words are in no group."""
    return near.near_filter(docs)


#: Packing's workers share their executor with what earlier stages left there, so they remember less than by default.
MOST_CHUNKS = 150_000


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their sequences."""
    return packing.harmonic_packing(docs, packing.default_tokenizer(), most_chunks=MOST_CHUNKS)


STAGES = [("quality rules", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("packing", packing_stage)]

#: Tokenising can't be written in SQL; tests/llm/test_pipeline.py holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the stages, applied in order to documents. What a stage wrote on its way goes when it is done,
    its result when the next one is."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scope() as results:
            docs = written(stage(spark, docs, sf_dir), "stage")
            results.append(docs)
    return docs
