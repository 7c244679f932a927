"""Transactions and vectors derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.features import MCC_RISK

#: Codes by supplier; the last two slots are unknown codes.
CODES = [*MCC_RISK, "0000", "0000"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, fraud, and the flat payload columns), one row per order."""
    o = table(spark, sf_dir, "orders")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    n = s.count()  # keys are dense from 0
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    epoch = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + key * 37 % 86400
    codes = F.array(*[F.lit(x) for x in CODES])
    t = o.withColumn("epoch", epoch).withColumn("s_suppkey", key % n)
    earlier = F.lag("epoch").over(Window.partitionBy("o_custkey").orderBy("epoch", "o_orderkey"))
    t = t.withColumn("last_epoch", earlier).join(s, "s_suppkey", "left")
    written = lambda e: F.date_format(F.timestamp_seconds(e), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    merchant = lambda x: x.cast("string")
    return t.select(
        key.alias("qid"),
        (F.col("o_orderstatus") == "F").cast("int").alias("fraud"),
        (F.col("o_totalprice") / 45.0).alias("amount"),
        (key % 15).cast("double").alias("installments"),
        written(F.col("epoch")).alias("requested_at"),
        ((cust % 97).cast("double") * 25.0).alias("avg_amount"),
        (cust % 23).cast("double").alias("tx_24h"),
        F.array(merchant(cust % 10), merchant(cust * 3 % 10), merchant(cust * 7 % 10)).alias("known"),
        merchant(F.col("s_suppkey")).alias("merchant_id"),
        F.get(codes, (F.col("s_suppkey") % 12).cast("int")).alias("mcc"),
        F.col("s_acctbal").alias("merchant_avg"),
        (key % 2 == 0).alias("is_online"),
        (key % 3 == 0).alias("card_present"),
        ((key * 7919 % 12000).cast("double") / 10.0).alias("km_home"),
        F.col("last_epoch").isNotNull().alias("has_last"),
        written(F.col("last_epoch")).alias("last_at"),
        F.when(F.col("last_epoch").isNotNull(), (key * 104729 % 12000).cast("double") / 10.0).alias("last_km"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, v, fraud) of every embedding: 14 coordinates as fixed point, fraud by the label's parity."""
    e = table(spark, sf_dir, "embeddings")
    v = F.transform(F.slice("embedding", 1, 14), lambda x: F.round(x.cast("double") * 10000.0).cast("int"))
    return e.select(F.col("vec_id").alias("idx"), v.alias("v"), (F.col("label") % 2).cast("int").alias("fraud"))
