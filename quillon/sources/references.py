"""Labelled reference vectors and validation entries from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.features import DIMS, reference_vector
from ..operators.shared import scoped, written


@scoped
def load_references(spark: SparkSession, path: str) -> DataFrame:
    """(idx, v, fraud) from one file with a JSON array of {vector, label}; idx is the place in the array.

    The file is split at closing braces, of which each entry has one, so it is read in parallel however it is broken
    into lines. An entry's idx is its place within its split, behind the entries of all splits before.
    A vector that hasn't 14 numbers, a missing label, or what isn't an entry, fails the job.
    """
    text = spark.read.text(path, lineSep="}").select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    entry = F.concat(F.regexp_replace("value", r"^[\s\[,]+", ""), F.lit("}"))
    read = F.from_json(entry, "struct<vector:array<double>,label:string>").alias("r")
    rows = written(text.where(r"not value rlike '^[\\s\\[\\]]*$'").select("block", "at", read), "entries")
    splits = rows.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    splits = splits.withColumn("before", F.sum("n").over(Window.orderBy("block")) - F.col("n"))  # one row a split
    idx = F.expr("before + at - first").alias("idx")
    return quantised_references(rows.join(splits, "block").select(idx, "r.vector", "r.label"))


def quantised_references(rows: DataFrame) -> DataFrame:
    """(idx, v, fraud) from (idx, vector, label); an entry of the wrong shape fails the job."""
    bad = F.coalesce(F.size("vector") != DIMS, F.lit(True)) | F.col("label").isNull() | F.exists("vector", lambda x: x.isNull())
    v = F.when(bad, F.raise_error(F.concat(F.lit("bad reference "), F.col("idx").cast("string")))).otherwise(reference_vector(F.col("vector")))
    return rows.select("idx", v.alias("v"), F.col("label").startswith("f").cast("int").alias("fraud"))


def load_validation(spark: SparkSession, path: str) -> DataFrame:
    """(qid, payload, expected_approved, expected_fraud_score) from one JSON document: an array, or an object with entries."""
    kind = "array<struct<request:variant,expected_approved:boolean,expected_fraud_score:double>>"
    value = F.col("value")
    entries = F.coalesce(F.get_json_object(value, "$.entries"), value)
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json(entries, kind)).alias("qid", "e"))
    return rows.select(F.col("qid").cast("long").alias("qid"), F.to_json("e.request").alias("payload"), "e.expected_approved", "e.expected_fraud_score")
