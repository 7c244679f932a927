"""Transactions from nested JSON payloads. Rows that can't be read stay, with parse_ok false."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import timestamp

SCHEMA = (
    "id string, transaction struct<amount double, installments double, requested_at string>, "
    "customer struct<avg_amount double, tx_count_24h double, known_merchants array<string>>, "
    "merchant struct<id string, mcc string, avg_amount double>, "
    "terminal struct<is_online boolean, card_present boolean, km_from_home double>, "
    "last_transaction struct<timestamp string, km_from_current double>"
)
#: Ids longer than this make a payload unreadable.
MOST_ID_BYTES = 38
FLAT = ["amount", "installments", "requested_at", "avg_amount", "tx_24h", "known", "merchant_id", "mcc", "merchant_avg", "is_online", "card_present", "km_home", "has_last", "last_at", "last_km"]


def decoded(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with FLAT and parse_ok.

    Flags of another type count as false where present, missing ones make the row unreadable, which takes the variant
    parser to tell apart; it is asked only about rows whose typed flags are null.
    """
    p = F.from_json(payload, SCHEMA)
    raw = F.try_parse_json(payload)
    typed = rows.withColumn("__p", p)

    def present(path: str, value: str) -> F.Column:
        held = F.try_variant_get(raw, path, "variant").isNotNull() & ~F.coalesce(F.is_variant_null(F.try_variant_get(raw, path, "variant")), F.lit(False))
        return F.when(F.col(value).isNotNull(), True).otherwise(F.coalesce(held, F.lit(False)))

    last_kind = F.col("__p.last_transaction")
    flat = {
        "amount": "__p.transaction.amount", "installments": "__p.transaction.installments", "requested_at": "__p.transaction.requested_at",
        "avg_amount": "__p.customer.avg_amount", "tx_24h": "__p.customer.tx_count_24h", "known": "__p.customer.known_merchants",
        "merchant_id": "__p.merchant.id", "mcc": "__p.merchant.mcc", "merchant_avg": "__p.merchant.avg_amount", "km_home": "__p.terminal.km_from_home",
        "last_at": "__p.last_transaction.timestamp", "last_km": "__p.last_transaction.km_from_current",
    }
    out = typed.withColumns({k: F.col(v) for k, v in flat.items()})
    out = out.withColumns({"is_online": F.coalesce("__p.terminal.is_online", F.lit(False)), "card_present": F.coalesce("__p.terminal.card_present", F.lit(False)), "has_last": last_kind.isNotNull()})
    needed = [F.col(c).isNotNull() for c in ("amount", "installments", "avg_amount", "tx_24h", "merchant_id", "mcc", "merchant_avg", "km_home")]
    ok = present("$.terminal.is_online", "__p.terminal.is_online") & present("$.terminal.card_present", "__p.terminal.card_present")
    ok = ok & timestamp(F.col("requested_at")).isNotNull() & (F.octet_length("merchant_id") <= MOST_ID_BYTES)
    for x in needed:
        ok = ok & x
    ok = ok & (~F.col("has_last") | (timestamp(F.col("last_at")).isNotNull() & F.col("last_km").isNotNull()))
    return out.withColumn("parse_ok", F.coalesce(ok, F.lit(False))).drop("__p")


def encoded(t: DataFrame) -> DataFrame:
    """t with its flat columns as a JSON payload; no last transaction means no such key."""
    c = F.col
    last = F.when(c("has_last"), F.struct(c("last_at").alias("timestamp"), c("last_km").alias("km_from_current")))
    body = F.struct(
        c("qid").cast("string").alias("id"),
        F.struct("amount", "installments", "requested_at").alias("transaction"),
        F.struct("avg_amount", c("tx_24h").alias("tx_count_24h"), c("known").alias("known_merchants")).alias("customer"),
        F.struct(c("merchant_id").alias("id"), "mcc", c("merchant_avg").alias("avg_amount")).alias("merchant"),
        F.struct("is_online", "card_present", c("km_home").alias("km_from_home")).alias("terminal"),
        last.alias("last_transaction"),
    )
    return t.withColumn("payload", F.to_json(body))
