"""Readers of the driver's tables, and series made of tables that hold none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.timeutil import ms_of_ntz

# One bit for each kind of event, line or order.
EVENT_BITS = {"view": 1, "click": 2, "purchase": 4, "signup": 8, "error": 16}
RETURN_BITS = {"R": 1, "A": 2, "N": 4}
OPEN_LINE_BIT = 8
ORDER_BITS = {"F": 1, "O": 2, "P": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bits(c: str, bits: dict[str, int]) -> Column:
    out = None
    for k, v in bits.items():
        out = F.when(F.col(c) == k, v) if out is None else out.when(F.col(c) == k, v)
    return F.coalesce(out, F.lit(0)).cast("long")


def events_series(events: DataFrame) -> DataFrame:
    """One series for each user; flag tells the kind of event. event_id orders repeated rows."""
    return events.select(F.col("user_id").alias("id"), ms_of_ntz("ts").alias("time"), "value", _bits("event_type", EVENT_BITS).alias("flag"), F.col("event_id").alias("seq"))


def supply_series(lineitem: DataFrame) -> DataFrame:
    """One series for each supplier, with many rows of the same id and time; _seq is a struct that tells them apart."""
    return lineitem.select(
        F.col("l_suppkey").alias("id"), ms_of_ntz("l_shipdate").alias("time"), F.col("l_extendedprice").alias("value"),
        (_bits("l_returnflag", RETURN_BITS).bitwiseOR(F.when(F.col("l_linestatus") == "O", OPEN_LINE_BIT).otherwise(0).cast("long"))).alias("flag"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"),
    )


def order_series(orders: DataFrame) -> DataFrame:
    """One series for each customer."""
    return orders.select(F.col("o_custkey").alias("id"), ms_of_ntz("o_orderdate").alias("time"), F.col("o_totalprice").alias("value"), _bits("o_orderstatus", ORDER_BITS).alias("flag"), F.col("o_orderkey").alias("seq"))


def negated_series(supplier: DataFrame) -> DataFrame:
    """Series with negative values only, one for each nation."""
    return supplier.select(F.col("s_nationkey").cast("long").alias("id"), F.col("s_suppkey").alias("time"), (-F.abs("s_acctbal")).alias("value"), F.lit(0).cast("long").alias("flag"), F.col("s_suppkey").alias("seq"))


