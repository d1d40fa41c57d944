"""Bars from the star schema and from event ticks, and the dense weekly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ts
from ..operators.calendar import densify


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week x brand bars with market-like columns."""
    line = read(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    out = rows.groupBy(F.date_trunc("week", "l_shipdate").cast("timestamp").alias("ts"), F.col("p_brand").alias("symbol")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.sum("l_quantity").alias("volume"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("open_interest"),
        (F.avg("l_discount") - F.avg("l_tax")).alias("funding_rate"),
        ((F.count_if(F.col("l_linestatus") == "O") + 1) / (F.count_if(F.col("l_linestatus") == "F") + 1)).alias("ls_ratio"),
        F.avg("p_retailprice").alias("close_spot"),
        F.count("*").cast("double").alias("volume_spot"),
    )
    return out.withColumns({"basis": F.col("close") - F.col("close_spot"), "volume_ratio": F.col("volume") / F.when(F.col("volume_spot") == 0, 1e-12).otherwise(F.col("volume_spot"))})


def panel(spark: SparkSession, sf_dir: str, proxy: tuple[str, ...] = ()) -> DataFrame:
    """The dense weekly panel: prices filled over at most 5 rows, returns, and the
    market's return: the mean over the proxy symbols, or all if none is given."""
    dense = densify(weekly_bars(spark, sf_dir))
    filled = dense.withColumn("close", ts.ffill("close", 5))
    with_ret = filled.withColumn("ret", ts.pct_change("close"))
    own = F.when(F.col("symbol").isin(*proxy), F.col("ret")) if proxy else F.col("ret")
    return with_ret.withColumn("mkt", F.avg(own).over(W.partitionBy("ts")))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour x event type OHLCV bars from ticks; ties of time by event id."""
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    at = F.struct("ts", "event_id")
    return ev.groupBy(F.date_trunc("hour", "ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", at).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", at).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
