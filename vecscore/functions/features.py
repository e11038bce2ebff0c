"""The 14 features of a transaction, in single precision, and their quantised form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecscore.functions import schema as S
from vecscore.sources.ingest import mcc_table, quantised


def f32(x: float | Column) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def clamp(x: Column) -> Column:
    """x in [0, 1]; NaN stays NaN."""
    return F.when(F.isnan(x), x).when(x < 0, f32(0)).when(x > 1, f32(1)).otherwise(x)


def share(x: Column, of: float) -> Column:
    return f32(x.cast("float") / f32(of))


def over_average(amount: Column, average: Column) -> Column:
    """amount over average over AVG_RATIO; null where the average is zero."""
    return share(f32(amount / F.when(average != 0, average)), S.AVG_RATIO)


def ratio(amount: Column, average: Column, over: Column | None = None) -> Column:
    """amount over average over AVG_RATIO, clamped. An average of zero gives 1 for any positive amount, and NaN for none. over: over_average(), where that is a column already."""
    zero = F.when(amount > 0, f32(1)).when(amount < 0, f32(0)).otherwise(f32(float("nan")))
    return F.when(average == 0, zero).otherwise(clamp(over_average(amount, average) if over is None else over))


def hour_of(at: Column) -> Column:
    return F.coalesce(F.hour(at), F.lit(0))


def weekday_of(at: Column) -> Column:
    """Monday is 0."""
    return F.coalesce(F.weekday(at), F.lit(0))


def minutes_between(last: Column, at: Column) -> Column:
    return F.coalesce(F.greatest(F.floor((F.unix_micros(at) - F.unix_micros(last)) / 60_000_000), F.lit(0)), F.lit(0))


def unknown_merchant(known: Column, merchant: Column) -> Column:
    return ~F.coalesce(F.array_contains(F.slice(known, 1, S.KNOWN_MERCHANTS), merchant), F.lit(False))


def with_mcc_risk(df: DataFrame, mcc_col: str = "mcc") -> DataFrame:
    """df with mcc_risk. The table of risks has a fixed ten rows, so it is broadcast."""
    code = F.coalesce(F.col(mcc_col).try_cast("int"), F.lit(0))
    table = F.broadcast(mcc_table(df.sparkSession))
    joined = df.withColumn("__mcc", code).join(table, F.col("__mcc") == F.col("mcc_code"), "left")
    listed = f32(F.coalesce("risk_byte", F.lit(S.MCC_DEFAULT)).cast("float") / f32(255))
    return joined.withColumn("mcc_risk", F.when(F.col("__mcc") >= S.MCC_LIMIT, f32(S.MCC_BEYOND)).otherwise(listed)).drop("__mcc", "mcc_code", "risk_byte")


def with_features(tx: DataFrame, minutes: str = "real") -> DataFrame:
    """tx (as parse_requests() gives) with v0..v13. minutes "zero" leaves the time since the last transaction at 0.

    What is clamped is a column first: clamp() names its argument four times, and a generated method of more than 8000 bytes is interpreted, never compiled."""
    c = F.col
    since = minutes_between(c("last_ts"), c("requested_at")) if minutes == "real" else F.lit(0)
    last = lambda x: F.when(c("has_last"), clamp(c(x))).otherwise(f32(-1))
    flag = lambda x: x.cast("int").cast("float")
    v = [
        clamp(c("__amount")),
        clamp(c("__installments")),
        ratio(c("amount"), c("customer_avg"), c("__ratio")),
        share(hour_of(c("requested_at")), 23),
        share(weekday_of(c("requested_at")), 6),
        last("__since"),
        last("__last_km"),
        clamp(c("__km_home")),
        clamp(c("__in_day")),
        flag(c("is_online")),
        flag(c("card_present")),
        flag(unknown_merchant(c("known_merchants"), c("merchant_id"))),
        c("mcc_risk"),
        clamp(c("__merchant_avg")),
    ]
    shares = {
        "__amount": share(c("amount"), S.MAX_AMOUNT),
        "__installments": share(c("installments"), S.MAX_INSTALLMENTS),
        "__ratio": over_average(c("amount"), c("customer_avg")),
        "__since": share(since, S.MAX_MINUTES),
        "__last_km": share(c("last_km"), S.MAX_KM),
        "__km_home": share(c("km_home"), S.MAX_KM),
        "__in_day": share(c("tx_count_24h"), S.MAX_TX_24H),
        "__merchant_avg": share(c("merchant_avg"), S.MAX_MERCHANT_AVG),
    }
    df = with_mcc_risk(tx).withColumns(shares)
    return df.select(*tx.columns, *[x.alias(f"v{d}") for d, x in enumerate(v)])


def with_quantised(df: DataFrame) -> DataFrame:
    return df.select(*df.columns, *[quantised(F.col(f"v{d}")).alias(f"q{d}") for d in range(S.DIMS)])
