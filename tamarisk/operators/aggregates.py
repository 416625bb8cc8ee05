"""Aggregations over offers: store comparison, statistics, merges per product, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import cents


def compare_stores(offers: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Per store: products, prices, discounted ones and those first seen within ``days`` before ``as_of``."""
    new = F.col("seen") >= F.date_sub(F.lit(as_of).cast("date"), days)
    return offers.groupBy("store").agg(
        F.count("*").alias("total"),
        F.round(F.avg("price"), 0).alias("avg_price"),
        F.round(F.min("price"), 0).alias("min_price"),
        F.round(F.max("price"), 0).alias("max_price"),
        F.sum(F.when(F.col("discount") > 0, 1).otherwise(0)).alias("discounted"),
        F.sum(F.when(new, 1).otherwise(0)).alias("new_products"),
    )


def statistics(offers: DataFrame, exact: bool = True) -> DataFrame:
    """One row over all offers. Exact distinct counts shuffle their values; sketches do not."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    return offers.agg(
        F.count("*").alias("offers"),
        distinct("store").alias("stores"),
        distinct("brand").alias("brands"),
        distinct("product_id").alias("products"),
        distinct(F.when(F.col("discount") > 0, F.col("product_id"))).alias("discounted_products"),
        F.round(F.avg("price"), 2).alias("avg_price"),
    )


def tenths(total: Column, n: Column) -> Column:
    """The mean to one decimal, half up, from an exact sum with four decimals: sums of doubles would depend on their order."""
    whole = (total * 10000).cast("long")
    return F.when(n > 0, F.floor((2 * whole + 1000 * n) / (2000 * n).cast("decimal(20,0)")).cast("double") / 10)


def merge_offers(offers: DataFrame, keys: list[str], stores: int | None = None) -> DataFrame:
    """One row per product: price range over positive prices, the cheapest store's details first, distinct stores.

    The details hold one offer per store: its cheapest positive one. A product is bounded by the number of stores.
    """
    price = F.when(F.col("price") > 0, F.col("price"))
    each = offers.groupBy(*keys, "store").agg(F.min(price).alias("price"), F.count("*").alias("n"))
    detail = F.struct(F.coalesce("price", F.lit(999999.0)).alias("rank"), F.col("store"), F.col("price"))
    merged = each.groupBy(*keys).agg(
        F.count("*").alias("store_count"),
        F.sum("n").alias("offer_count"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        tenths(F.sum(F.col("price").cast("decimal(18,4)")), F.count("price")).alias("avg_price"),
        F.array_sort(F.collect_list(detail)).alias("details"),
    )
    some = F.col("details") if stores is None else F.slice("details", 1, stores)
    return merged.withColumns(
        {
            "stores": F.array_join(F.transform("details", lambda d: d["store"]), "، "),
            "suggested": F.greatest(F.lit(0.0), cents(F.col("min_price") - 1)),
            "details": some,
        }
    )


def cheapest(candidates: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The row with the least price per key, unknown (0) first; of equal ones the earliest."""
    columns = [c for c in candidates.columns if c != key]
    best = F.min_by(F.struct(*columns), F.struct("price", ordinal))
    return candidates.groupBy(key).agg(best.alias("row")).select(key, "row.*")


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def with_total(df: DataFrame, key: str, *totals: Column) -> DataFrame:
    """Aggregates per key and one row of the grand total, whose key is null."""
    return df.rollup(key).agg(*totals)


def automation_summary(decisions: DataFrame) -> DataFrame:
    """Counts of actions and money: what lowering saves is lost margin, what raising gains is won."""
    is_ = lambda a: F.col("action") == a
    gain = F.col("new_price") - F.col("our_price")
    return decisions.agg(
        F.count("*").alias("total"),
        F.count(F.when(is_("lower"), 1)).alias("lower"),
        F.count(F.when(is_("raise"), 1)).alias("raise"),
        F.round(F.coalesce(F.sum(F.when(is_("lower"), -gain)), F.lit(0.0)), 2).alias("savings"),
        F.round(F.coalesce(F.sum(F.when(is_("raise"), gain)), F.lit(0.0)), 2).alias("gains"),
    ).withColumns({"keep": F.expr("total - lower - raise"), "net": F.expr("round(gains - savings, 2)")})


def priority(missing: DataFrame) -> DataFrame:
    """Score 0 to 100 of missing products by how many stores have them, confidence, price band and completeness."""
    top = missing.agg(F.max("store_count").alias("top"))
    confidence = F.when(F.col("confidence") == "green", 25).when(F.col("confidence") == "yellow", 15).when(F.col("confidence") == "red", 2)
    p = F.col("price")
    band = F.when((p >= 100) & (p <= 500), 20).when((p > 500) & (p <= 1000), 14).when((p >= 50) & (p < 100), 8).otherwise(0)
    full = sum((F.when(F.coalesce(F.col(c), F.lit("")) != "", 5).otherwise(0) for c in ("image", "brand", "category")), F.lit(0))
    score = 40.0 * F.col("store_count") / F.greatest("top", F.lit(1)) + confidence.otherwise(8) + band + full
    scored = missing.crossJoin(F.broadcast(top)).withColumn("priority", F.least(F.lit(100.0), F.round(score, 0))).drop("top")
    s = F.col("priority")
    return scored.withColumn("level", F.when(s >= 80, "urgent").when(s >= 60, "high").when(s >= 40, "medium").otherwise("low"))


def options(df: DataFrame, name: str, first: str = "الكل") -> DataFrame:
    """Distinct non-blank values in order, after one that stands for all."""
    values = df.select(F.trim(name).alias("value")).where("value is not null and value <> ''").distinct()
    return values.withColumn("place", F.lit(1)).union(df.sparkSession.sql(f"select '{first}' as value, 0 as place")).orderBy("place", "value")


def vocabulary(df: DataFrame, name: str, known: DataFrame) -> DataFrame:
    """Values of 2 to 50 characters that are no URL or number, and not among ``known`` (column value, case ignored)."""
    v = F.trim(name)
    fit = (F.length(v) >= 2) & (F.length(v) <= 50) & ~v.rlike(r"(?i)^https?:|^\d+$")
    return df.where(fit).select(v.alias("value")).distinct().join(
        known.select(F.lower("value").alias("_k")).distinct(), F.lower("value") == F.col("_k"), "left_anti"
    )


def per_row_share(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Each row's share of its group's total, by a window."""
    return df.withColumn("share", F.round(F.col(value) / F.sum(value).over(Window.partitionBy(*keys)), 6))
