"""The given star-schema tables, seen as transactions, transfers and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _epoch_ms(column: str):
    """Milliseconds of a timestamp without time zone, read as UTC."""
    return F.unix_millis(F.col(column).cast("timestamp"))


def events_as_tx(spark: SparkSession, folder: str) -> DataFrame:
    """The ``events`` stream as canonical-like transactions with device, place and country derived from its columns."""
    k = F.col("k")
    # k is a column of its own so that the JSON is read once per row
    return table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).select(
        F.col("event_id").cast("string").alias("tx_id"),
        F.col("user_id").cast("string").alias("user_id"),
        _epoch_ms("ts").alias("ts_ms"),
        F.rint(F.col("value") * F.lit(100.0)).cast("long").alias("amount_minor"),
        F.lit("USD").alias("currency"),
        F.expr(
            "CASE event_type WHEN 'purchase' THEN 'ecommerce' WHEN 'view' THEN 'card_present'"
            " WHEN 'click' THEN 'mobile' WHEN 'signup' THEN 'transfer' ELSE 'atm' END"
        ).alias("channel"),
        F.concat(F.lit("dev"), F.pmod(k, F.lit(20)).cast("string")).alias("device_fp"),
        F.concat(F.lit("bin"), F.pmod(F.col("user_id"), F.lit(10)).cast("string")).alias("card_bin"),
        k.cast("string").alias("merchant_id"),
        F.col("event_type").alias("mcc"),
        F.when(k < 60, "US").when(k < 80, "GB").when(k < 95, "DE").otherwise("NG").alias("country"),
        (F.pmod(k * 7, F.lit(120)) - 60).cast("double").alias("lat"),
        (F.pmod(k * 13, F.lit(300)) - 150).cast("double").alias("lon"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("byte").alias("label"),
    )


def orders_as_tx(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` as transactions of the customer; merchant and country come from the customer row."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return (
        table(spark, folder, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            F.col("o_orderkey").cast("string").alias("tx_id"),
            F.col("o_custkey").cast("string").alias("user_id"),
            _epoch_ms("o_orderdate").alias("ts_ms"),
            F.rint(F.col("o_totalprice") * F.lit(100.0)).cast("long").alias("amount_minor"),
            F.expr(
                "CASE WHEN o_orderpriority LIKE '1%' THEN 'ecommerce' WHEN o_orderpriority LIKE '2%' THEN 'card_present'"
                " WHEN o_orderpriority LIKE '3%' THEN 'mobile' ELSE 'transfer' END"
            ).alias("channel"),
            F.col("c_mktsegment").alias("merchant_id"),
            F.col("o_orderpriority").alias("mcc"),
            F.col("c_nationkey").cast("string").alias("country"),
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("byte").alias("label"),
        )
    )


def transfers(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as payments between accounts: the customer pays the account with the supplier's number.

    Customer and supplier numbers share one range, so the low accounts both pay and are paid.
    """
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("tx_id"),
        F.col("o_custkey").alias("src"),
        F.col("l_suppkey").alias("dst"),
        _epoch_ms("o_orderdate").alias("ts_ms"),
        F.rint(F.col("l_extendedprice") * F.lit(100.0)).cast("long").alias("amount_minor"),
    )
