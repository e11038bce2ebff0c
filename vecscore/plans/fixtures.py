"""Transactions and labelled vectors from the events table, in the shapes the engine reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecscore.functions.features import with_features, with_quantised
from vecscore.functions.schema import DIMS

MCCS = [5411, 5812, 5912, 5944, 7801, 7802, 7995, 4511, 5311, 5999, 1234]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each event: event_id and the columns of parse_requests(). A customer's history is that of the events before."""
    c = F.col
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "user_id", c("ts").cast("timestamp").alias("ts"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), (F.round(c("value") * 100).cast("bigint") * 60).alias("cents")
    )
    ev = ev.withColumn("merchant_id", F.concat(F.lit("MERC-"), F.lpad((c("k") % 50).cast("string"), 3, "0"))).withColumn("at", F.unix_micros("ts"))
    user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = user.rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy("user_id").orderBy("at").rangeBetween(-86_400_000_000, 0)
    ev = ev.withColumns(
        {
            "sum_before": F.sum("cents").over(before),
            "n_before": F.count(F.lit(1)).over(before),
            "in_day": F.count(F.lit(1)).over(day),
            "known_merchants": F.coalesce(F.collect_list("merchant_id").over(user.rowsBetween(-10, -1)), F.array().cast("array<string>")),
            "last_ts": F.lag("ts").over(user),
            "last_k": F.lag("k").over(user),
        }
    )
    merchants = ev.groupBy("merchant_id").agg((F.sum("cents") / F.count(F.lit(1)) / 100).cast("float").alias("merchant_avg"))
    mcc = F.element_at(F.array(*[F.lit(str(m)) for m in MCCS]), c("k") % 11 + 1)
    return ev.join(merchants, "merchant_id").select(
        "event_id",
        F.concat(F.lit("tx-"), c("event_id").cast("string")).alias("id"),
        (c("cents") / 100).cast("float").alias("amount"),
        (c("event_id") % 12 + 1).cast("int").alias("installments"),
        c("ts").alias("requested_at"),
        F.when(c("n_before") > 0, c("sum_before") / c("n_before") / 100).otherwise(c("cents") / 100).cast("float").alias("customer_avg"),
        ((c("in_day") - 1) * 2).cast("int").alias("tx_count_24h"),
        "known_merchants",
        "merchant_id",
        mcc.alias("mcc"),
        "merchant_avg",
        c("event_type").isin("click", "view").alias("is_online"),
        c("event_type").isin("purchase", "signup").alias("card_present"),
        ((c("user_id") * 37 + c("k") * 37 + c("event_id") * 13) % 1000).cast("float").alias("km_home"),
        c("last_ts").isNotNull().alias("has_last"),
        "last_ts",
        (F.abs(c("k") - c("last_k")) * 10).cast("float").alias("last_km"),
        F.lit(None).cast("string").alias("corrupt"),
        (((c("event_id") * 7 + c("k")) % 5 < 2) | (c("event_type") == "error")).alias("is_fraud"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and the transaction as a JSON request."""
    c = F.col
    last = F.when(c("has_last"), F.struct(c("last_ts").alias("timestamp"), c("last_km").alias("km_from_current")))
    request = F.struct(
        "id",
        F.struct("amount", "installments", "requested_at").alias("transaction"),
        F.struct(c("customer_avg").alias("avg_amount"), "tx_count_24h", "known_merchants").alias("customer"),
        F.struct(c("merchant_id").alias("id"), "mcc", c("merchant_avg").alias("avg_amount")).alias("merchant"),
        F.struct("is_online", "card_present", c("km_home").alias("km_from_home")).alias("terminal"),
        last.alias("last_transaction"),
    )
    return transactions(spark, sf_dir).select("event_id", F.to_json(request, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("json"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_features(transactions(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id (the event's), q0..q13, is_fraud."""
    return with_quantised(features(spark, sf_dir)).select(F.col("event_id").alias("vec_id"), *[f"q{d}" for d in range(DIMS)], "is_fraud")
