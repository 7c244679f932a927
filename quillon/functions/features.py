"""Scalar functions and the 14 features of a transaction, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the feature definition.
MAX_AMOUNT, MAX_INSTALLMENTS, AMOUNT_VS_AVG_RATIO, MAX_MINUTES = 10000, 12, 10, 1440
MAX_KM, MAX_TX_24H, MAX_MERCHANT_AVG = 1000, 20, 10000
SCALE, MISSING = 10000, -10000
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
MCC_DEFAULT = 0.5
DIMS = 14


def clamp01(v: Column) -> Column:
    return F.when(v < 0, 0.0).when(v > 1, 1.0).otherwise(v)


def quantised(v: Column) -> Column:
    """Fixed point in [-10000, 10000], rounded half away from zero."""
    return F.greatest(F.lit(-1.0 * SCALE), F.least(F.lit(1.0 * SCALE), F.round(v * float(SCALE)))).cast("int")


def timestamp(text: Column) -> Column:
    """The first 19 characters as UTC; null when they are no date and time."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def mcc_risk(mcc: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MCC_RISK.items() for x in pair])
    return F.coalesce(F.try_element_at(table, mcc), F.lit(MCC_DEFAULT))


def ratio(amount: Column, average: Column) -> Column:
    """amount / average / 10 in [0, 1]; without an average 1, or 0 for a negative amount."""
    safe = F.when(average != 0, average)
    return F.when(average == 0, F.when(amount < 0, 0.0).otherwise(1.0)).otherwise(clamp01(amount / safe / float(AMOUNT_VS_AVG_RATIO)))


def unknown(merchant: Column, known: Column) -> Column:
    return ~F.coalesce(F.array_contains(known, merchant), F.lit(False))


def share(v: Column, most: float) -> Column:
    return quantised(clamp01(v / float(most)))


def flag(v: Column) -> Column:
    return F.when(v, SCALE).otherwise(0)


def features(t: DataFrame, name: str = "v") -> DataFrame:
    """t with the vector: array<int> of 14, from the flat columns of sources.payload.decoded or sources.fixtures.transactions."""
    at, last = timestamp(F.col("requested_at")), timestamp(F.col("last_at"))
    minutes = (F.unix_timestamp(at) - F.unix_timestamp(last)) / 60.0
    since = F.when(F.col("has_last"), share(minutes, MAX_MINUTES)).otherwise(MISSING)
    moved = F.when(F.col("has_last"), share(F.col("last_km"), MAX_KM)).otherwise(MISSING)
    c = F.col
    dims = [
        share(c("amount"), MAX_AMOUNT),
        share(c("installments"), MAX_INSTALLMENTS),
        quantised(ratio(c("amount"), c("avg_amount"))),
        quantised(F.hour(at) / 23.0),
        quantised(F.weekday(at) / 6.0),
        since,
        moved,
        share(c("km_home"), MAX_KM),
        share(c("tx_24h"), MAX_TX_24H),
        flag(c("is_online")),
        flag(c("card_present")),
        flag(unknown(c("merchant_id"), c("known"))),
        quantised(mcc_risk(c("mcc"))),
        share(c("merchant_avg"), MAX_MERCHANT_AVG),
    ]
    return t.withColumn(name, F.array(*dims))


def reference_vector(v: Column) -> Column:
    """A reference's coordinates as fixed point, without a clamp."""
    return F.transform(v, lambda x: F.round(x * float(SCALE)).cast("int"))


def distance(a: str, b: str, dims: int = DIMS) -> Column:
    """Squared Euclidean distance of two array columns as one unrolled sum, which stays in generated code."""
    terms = [F.col(a)[i].cast("long") - F.col(b)[i].cast("long") for i in range(dims)]
    total = terms[0] * terms[0]
    for t in terms[1:]:
        total = total + t * t
    return total
