"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact, licenses, lines, near, packing, pieces, quality, sharding, tokencount, urls
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_query(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_dedup(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_packing(table(spark, sf_dir, "documents"), packing.default_tokenizer())


def op6_n_best_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.n_best_encoding(table(spark, sf_dir, "documents"), pieces.default_model(), keep=1)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), pieces.default_model())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_no", "kept", "match_doc", "match_line")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_url_filters, op3_exact_dedup, op4_near_dedup, op5_packing, op6_n_best_pieces, op7_license_scan, op8_token_counts, op9_line_dedup, op10_sharding)
}
ORACLE_SQL = {
    "op1_quality_rules": quality.ORACLE_SQL,
    "op2_url_filters": urls.ORACLE_SQL,
    "op3_exact_dedup": exact.ORACLE_SQL,
}
