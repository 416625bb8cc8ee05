"""The business entities over the star-schema tables: a catalogue, store offers, observed prices and entity events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(our_id, name, brand, kind, size, our_price)"""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("our_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("our_price"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, store, product_id, price, discount, seen, brand, name): what stores ask for catalogue products."""
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        "l_suppkey",
        F.col("l_partkey").alias("product_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_shipdate").cast("date").alias("seen"),
    )
    stores = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("store"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"))
    return lines.join(stores, "l_suppkey").join(names, "product_id").drop("l_suppkey")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, user_id, status, value, k)"""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("long").alias("k")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("status"), "value", k)
