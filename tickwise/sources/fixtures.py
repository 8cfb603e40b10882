"""Bar, portfolio and position tables derived from the shared parquet tables.

These are the inputs of every registered query.  Each one is a plain
aggregation over a scanned table, so it scales with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_cols(df: DataFrame) -> DataFrame:
    """``df`` with ``date`` and ``time``, the text of ``ts``."""
    return df.withColumn("date", F.date_format("ts", "yyyyMMdd")).withColumn("time", F.date_format("ts", "HH:mm"))


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per (event_type, hour): open/close = first/last value by (ts, event_id)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", "props")
    key = F.struct("ts", "event_id")
    bars = (
        ev.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
        .agg(
            F.min_by("value", key).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", key).alias("close"),
            F.sum(F.get_json_object("props", "$.k").cast("double")).alias("volume"),
        )
    )
    return text_cols(bars)


def most_lines(spark: SparkSession, sf_dir: str) -> int:
    """Lines of the supplier with most of them: no symbol of :func:`bars_daily` has more bars."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def bars_daily(spark: SparkSession, sf_dir: str, by_symbol: bool = False, text: bool = True) -> DataFrame:
    """One bar per (supplier, ship date); price = extended price / quantity.

    ``by_symbol`` deals the lines by symbol alone: the bars are then dealt and
    sorted as windows over a symbol need them, but all lines of a symbol are in
    one task (see :func:`most_lines`).  Without ``text`` the bars lack the
    columns of :func:`text_cols`.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    symbol = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol")
    # a supplier ships few lines a day: combined before the shuffle they would be sorted twice and travel as wide buffers
    lines = li.select(symbol, *li.drop("l_suppkey").columns).repartition("symbol") if by_symbol else li.repartition("l_suppkey", "l_shipdate")
    bars = (
        lines.withColumn("price", price)
        .groupBy("symbol" if by_symbol else "l_suppkey", F.col("l_shipdate").alias("ts"))
        .agg(
            F.min_by("price", key).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", key).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )
    bars = bars.select("symbol" if by_symbol else symbol, "ts", "open", "high", "low", "close", "volume")
    return text_cols(bars) if text else bars


def bars_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a degenerate bar (open = high = low = close)."""
    ev = table(spark, sf_dir, "events")
    v = F.col("value")
    bars = ev.select(
        F.col("event_type").alias("symbol"), "ts", v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )
    return text_cols(bars)


def portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a portfolio; cash = account balance x 1000."""
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return cu.select(
        F.col("c_custkey").alias("portfolio_id"),
        (F.col("c_acctbal") * F.lit(1000.0)).alias("cash"),
        F.lit(0).cast("long").alias("trades_used"),
    )


def positions(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """Holdings from activity: a user holds each event type it touched.

    shares = sum of ``props.k``, avg_price = mean value in cents, rounded to a cent.
    Customers without events hold nothing (pure cash portfolios).  ``numbered``
    adds ``position_no``: the order in which a user first touched the types.
    """
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "props", "ts")
    held = (
        ev.groupBy(F.col("user_id").alias("portfolio_id"), F.col("event_type").alias("symbol"))
        .agg(
            F.sum(F.get_json_object("props", "$.k").cast("long")).alias("shares"),
            # mean of whole cents (exact integer sum), rounded half up to a cent
            (F.floor(F.sum(F.floor(F.col("value") * 100.0 + 0.5)) / F.count(F.lit(1)) + F.lit(0.5)).cast("double") / F.lit(100.0)).alias("avg_price"),
            F.min("ts").alias("_first"),
        )
        .withColumn("last_action_signal", F.lit(0.0))
    )
    if numbered:
        held = held.withColumn("position_no", F.row_number().over(Window.partitionBy("portfolio_id").orderBy("_first", "symbol")))
    return held.drop("_first")
