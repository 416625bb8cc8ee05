"""Price history, rankings and other work over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; give an order without ties."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("place") <= n)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each group in the given order. One pass with partial aggregation: no sort of groups."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("row")).select(*keys, "row.*").select(*df.columns)


def latest_by_url(df: DataFrame, url: str, ordinal: str) -> DataFrame:
    """The last row of each canonical URL; rows without a URL all stay."""
    from ..functions.keys import canonical_url

    link = canonical_url(url)
    some = df.where(link != "").withColumn("_link", link)
    return df.where(F.coalesce(link, F.lit("")) == "").unionByName(latest(some, ["_link"], [ordinal]).drop("_link"))


def daily_history(observed: DataFrame, ordinal: str) -> DataFrame:
    """(product_id, store, day, price, previous, changed): the last price of each day, and whether it differs from the day
    before by over 0.01."""
    daily = observed.groupBy("product_id", "store", "day").agg(F.max_by("price", ordinal).alias("price"))
    before = F.lag("price").over(Window.partitionBy("product_id", "store").orderBy("day"))
    changed = F.coalesce(F.abs(F.col("price") - before) > 0.01, F.lit(True))
    return daily.withColumns({"previous": before, "changed": changed})


def price_pairs(history: DataFrame, as_of: str, days: int) -> DataFrame:
    """Pairs of a recent record and any earlier one of the same product and store whose prices differ, in no order.

    Each pair counts, not only consecutive ones; equality of product and store makes it a hash join."""
    new, old = history.alias("n"), history.alias("o")
    recent = F.col("n.day") >= F.date_sub(F.lit(as_of).cast("date"), days)
    same = (F.col("n.product_id") == F.col("o.product_id")) & (F.col("n.store") == F.col("o.store"))
    pair = new.where(recent).join(old, same & (F.col("n.id") > F.col("o.id")) & (F.abs(F.col("n.price") - F.col("o.price")) > 0.01))
    return pair.select(
        "n.product_id",
        "n.store",
        F.col("n.id").alias("new_id"),
        F.col("o.id").alias("old_id"),
        F.round(F.col("n.price") - F.col("o.price"), 2).alias("change"),
    )


#: Ids of a product and store that share a bucket.
BUCKET = 100_000


def _earlier_extremes(history: DataFrame) -> DataFrame:
    """``history`` with the lowest and highest price (lo, hi) of smaller ids of the same product and store. A long history is looked at
    in buckets of ids: extremes within each, and those of the buckets before from one row a bucket."""
    keys = ["product_id", "store"]
    rows = history.withColumn("bucket", F.floor(F.col("id") / BUCKET))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(*keys, "bucket").agg(F.min("price").alias("l"), F.max("price").alias("h"))
    whole = whole.select(*keys, "bucket", F.min("l").over(before).alias("lo_"), F.max("h").over(before).alias("hi_"))
    inner = Window.partitionBy(*keys, "bucket").orderBy("id").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"lo": F.min("price").over(inner), "hi": F.max("price").over(inner)}).join(whole, [*keys, "bucket"])
    return rows.withColumns({"lo": F.least("lo", "lo_"), "hi": F.greatest("hi", "hi_")}).drop("lo_", "hi_", "bucket")


def price_changes(history: DataFrame, as_of: str, days: int, limit: int = 100) -> DataFrame:
    """The ``limit`` largest of ``price_pairs``, without making all pairs; ties go to the smaller new_id, old_id, product and store.

    A recent record's largest change is that to an extreme of the records before it. A pair among the ``limit`` largest belongs to one
    of the ``limit`` recent records with the largest changes, so only these meet the records of their product and store."""
    size = lambda a, b: F.abs(F.round(F.col(a) - F.col(b), 2))
    differs = lambda a, b: F.abs(F.col(a) - F.col(b)) > 0.01
    recent = F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days)
    most = F.greatest(*(F.when(differs("price", c), size("price", c)) for c in ("lo", "hi")))
    ends = _earlier_extremes(history).where(recent).withColumn("most", most).where("most is not null")
    order = (F.desc("most"), F.asc("id"), F.asc("product_id"), F.asc("store"))
    tops = ends.select("product_id", "store", F.col("id").alias("new_id"), F.col("price").alias("new_price"), "most", "id")
    tops = tops.orderBy(*order).limit(limit).drop("most", "id")
    pairs = history.join(F.broadcast(tops), ["product_id", "store"]).where((F.col("new_id") > F.col("id")) & differs("new_price", "price"))
    change = F.round(F.col("new_price") - F.col("price"), 2).alias("change")
    found = pairs.select("product_id", "store", "new_id", F.col("id").alias("old_id"), change)
    return found.orderBy(F.abs("change").desc(), "new_id", "old_id", "product_id", "store").limit(limit)



def failure_runs(events: DataFrame, keys: list[str], order: list[str], failed: Column, trip: int) -> DataFrame:
    """Length of the current run of failures at every event, and whether it reaches ``trip``: a success starts anew."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = events.withColumn("_fail", failed.cast("int"))
    island = F.sum(1 - F.col("_fail")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("_island", island)
    run = F.sum("_fail").over(Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("run", run).withColumn("tripped", F.col("run") >= trip).drop("_fail", "_island")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` from 1. Sorts only as many rows as it skips and shows."""
    return df.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def page_bounds(total: int, number: int, size: int) -> tuple[int, int]:
    """The page clamped to those there are, and their number."""
    pages = max(1, -(-total // size))
    return min(max(1, number), pages), pages


def ordering(kind: str) -> list[Column]:
    """Orders of the product browser, each with an id to break ties."""
    return {
        "price_asc": [F.col("price").asc(), F.col("id").asc()],
        "price_desc": [F.col("price").desc(), F.col("id").asc()],
        "newest": [F.coalesce("first_seen", "added").desc(), F.col("id").desc()],
    }.get(kind, [F.col("id").desc()])


def last_prices(sent: DataFrame, order: list[str]) -> DataFrame:
    """(product_id, new_price): the last price that was sent for each product; blank ids are left out, null prices are 0."""
    named = sent.where(~F.lower(F.trim("product_id")).isin("", "nan", "none"))
    last = F.max_by(F.coalesce("new_price", F.lit(0.0)), F.struct(*order))
    return named.groupBy(F.trim("product_id").alias("product_id")).agg(last.alias("new_price"))
