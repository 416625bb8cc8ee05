"""Unions, upserts, state folding and snapshot differences. Results are new tables, never the files being read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import latest


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that a table lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_latest(old: DataFrame, new: DataFrame, key_sets: list[list[str]]) -> DataFrame:
    """Union in which new rows replace old ones with the same key: the first key set that all columns exist for. Without
    one, whole equal rows collapse. Rows with a null or blank in the key all stay."""
    both = union_all(old.withColumn("_turn", F.lit(0)), new.withColumn("_turn", F.lit(1)))
    keys = next((k for k in key_sets if set(k) <= set(both.columns)), None)
    if keys is None:
        return both.drop("_turn").distinct()
    blank = F.lit(False)
    for k in keys:
        blank |= F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) == ""
    rest = [c for c in both.columns if c not in (*keys, "_turn")]
    best = both.where(~blank).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_turn", *rest)).alias("row"))
    return both.where(blank).drop("_turn").unionByName(best.select(*keys, "row.*"))


def upsert(old: DataFrame, batch: DataFrame, keys: list[str], ordinal: str, overwrite: list[str], keep: list[str]) -> DataFrame:
    """Apply a batch: ``overwrite`` columns take the batch's last value, ``keep`` columns only where it isn't blank; others stay as
    they were. Repeated keys of the batch are folded first, so replays change nothing."""
    fold = latest(batch, keys, [ordinal]).select(*keys, *(F.col(c).alias(f"_new_{c}") for c in (*overwrite, *keep)), F.lit(True).alias("_hit"))
    joined = old.join(fold, keys, "full_outer")
    out = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in overwrite}
    blank = lambda c: F.trim(F.col(f"_new_{c}").cast("string")) == ""
    out |= {c: F.when(F.col(f"_new_{c}").isNull() | blank(c), F.col(c)).otherwise(F.col(f"_new_{c}")) for c in keep}
    return joined.select(*(out.get(c, F.col(c)).alias(c) for c in old.columns))


def seen_dates(old: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """(key, first_seen, last_seen) after a batch of (key, day)."""
    new = batch.select(key, F.col("day").alias("first_seen"), F.col("day").alias("last_seen"))
    both = old.select(key, "first_seen", "last_seen").unionByName(new)
    return both.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(url, lastmod, change) between snapshots of (url, lastmod): added, modified (a date is known and differs), unchanged, removed."""
    o, n = old.select("url", F.col("lastmod").alias("_old"), F.lit(True).alias("_o")), new.select("url", "lastmod", F.lit(True).alias("_n"))
    modified = (F.coalesce("lastmod", F.lit("")) != "") & ~F.col("lastmod").eqNullSafe(F.col("_old"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(modified, "modified").otherwise("unchanged")
    return o.join(n, "url", "full_outer").select("url", F.coalesce("lastmod", "_old").alias("lastmod"), change.alias("change"))


def crawl_state(old: DataFrame, entries: DataFrame, outcomes: DataFrame, give_up: int = 3) -> DataFrame:
    """(url, lastmod, failures) after a crawl: success stores the date and clears failures, a failure leaves the date blank so that
    the URL is tried again, until ``give_up`` of them; new URLs that weren't tried keep their date."""
    j = old.join(entries.select("url", F.col("lastmod").alias("_new")), "url", "full_outer").join(outcomes, "url", "left")
    fails = F.coalesce("failures", F.lit(0)) + 1
    known = F.coalesce("_new", "lastmod", F.lit(""))
    failed = F.col("ok") == F.lit(False)
    return j.select(
        "url",
        F.when(F.col("ok"), known).when(failed & (fails < give_up), F.lit("")).otherwise(known).alias("lastmod"),
        F.when(F.col("ok"), 0).when(failed & (fails < give_up), fails).when(failed, 0).otherwise(F.coalesce("failures", F.lit(0))).cast("int").alias("failures"),
    )


def transitions(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, from_status, to_status, and the order) wherever an entity's status changes."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy(*order))
    moved = events.withColumn("from_status", before).where(~F.col("status").eqNullSafe(F.col("from_status")))
    return moved.select(key, *order, "from_status", F.col("status").alias("to_status"))


def undo_last(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, status) that undoing each entity's last transition with a known origin gives."""
    last = latest(log.where("from_status is not null"), [key], order)
    return last.select(key, F.col("from_status").alias("status"))


def ledger(events: DataFrame, order: list[str], default: str = "REJECTED_LOW_CONFIDENCE") -> DataFrame:
    """(comp_id, state, reason_code, last_score) of an intake log of (comp_id, state, reason_code, last_score): the last state wins,
    reasons and scores are kept unless replaced, what was only ingested is swept into ``default``."""
    at = F.struct(*order)
    known = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c)
    fold = events.groupBy("comp_id").agg(F.max_by("state", at).alias("state"), known("reason_code"), known("last_score"))
    stuck = F.col("state") == "INGESTED"
    return fold.withColumns(
        {
            "reason_code": F.when(stuck, F.coalesce("reason_code", F.lit("not_selected_in_batch"))).otherwise(F.col("reason_code")),
            "state": F.when(stuck, default).otherwise(F.col("state")),
        }
    )


def overlay(base: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with the override's non-blank, non-zero values in ``columns``; one override row for each key."""
    o = overrides.select(key, *(F.col(c).alias(f"_o_{c}") for c in columns))
    j = base.join(o, key, "left")

    def pick(c: str) -> Column:
        new = F.col(f"_o_{c}")
        empty = F.trim(new.cast("string")).isin("", "0", "0.0")
        return F.when(new.isNull() | empty, F.col(c)).otherwise(new).alias(c)

    return j.select(*(pick(c) if c in columns else F.col(c) for c in base.columns))


def enqueue(queue: DataFrame, products: DataFrame, brands: DataFrame) -> DataFrame:
    """Append products that aren't queued: ``ready_to_send`` if their brand is in the catalogue, else ``waiting_brand``; the price
    undercuts the competitor by one, at least 1."""
    new = products.dropDuplicates(["product_key"]).join(queue, "product_key", "left_anti")
    b = brands.select(F.lower("brand").alias("_b")).distinct()
    j = new.join(b, F.lower("brand") == F.col("_b"), "left")
    add = j.select(
        "product_key",
        "brand",
        F.greatest(F.round(F.col("price") - 1, 0), F.lit(1.0)).alias("price"),
        F.when(F.col("_b").isNotNull(), "ready_to_send").otherwise("waiting_brand").alias("status"),
    )
    return union_all(queue, add)
