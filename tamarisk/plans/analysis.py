"""The two analyses: pricing of what competitors offer of our products, and products that we miss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions.pricing import decision, risk, undercut
from ..operators import aggregates, brand_matching, filters, matching, routing


def priced(catalogue: DataFrame, offers: DataFrame) -> DataFrame:
    """Each catalogue row with the cheapest offer of its product and the decision on its price.

    ``catalogue``: (our_id, our_price, ...); ``offers``: (product_id, store, price, ...). Products without an offer are kept.
    """
    best = offers.where("price > 0").groupBy(F.col("product_id").alias("our_id")).agg(
        F.min(F.struct("price", "store")).alias("b"), F.count("*").alias("offer_count")
    )
    rows = catalogue.join(best, "our_id", "left").withColumns({"comp_price": F.col("b.price"), "store": F.col("b.store")}).drop("b")
    rows = rows.withColumn("d", decision("our_price", "comp_price"))
    percent = F.when(F.col("comp_price") > 0, F.round(F.col("d.diff_ours_minus_comp") / F.col("comp_price") * 100, 2)).otherwise(0.0)
    suggested = F.when(F.col("d.action") == "raise", undercut("comp_price"))
    return rows.select(*(c for c in rows.columns if c != "d"), "d.*", percent.alias("diff_pct"), suggested.alias("suggested")).withColumn(
        "risk", risk("diff_pct", F.lit(100.0))
    )


def matched_pricing(ours: DataFrame, theirs: DataFrame, n: int = 3, auto: float = 85.0) -> DataFrame:
    """Each catalogue row matched by name (``brand_matching.matched``) with the decision on its price and its section: decisions count for
    matched rows, the others are reviewed or excluded. Both sides are ``brand_matching.indexed``."""
    rows = brand_matching.matched(ours, theirs, n, auto).withColumn("d", decision("our_price", "comp_price"))
    section = F.when(F.col("route") != "matched", F.col("route")).otherwise(
        F.when(F.col("d.action") == "raise", "price_raise").when(F.col("d.action") == "lower", "price_lower").when(F.col("d.action") == "approve", "approved").otherwise("review")
    )
    percent = F.when(F.col("comp_price") > 0, F.round(F.col("d.diff_ours_minus_comp") / F.col("comp_price") * 100, 2)).otherwise(0.0)
    columns = [c for c in rows.columns if c != "d"]
    return rows.select(*columns, "d.decision", "d.diff_ours_minus_comp", section.alias("section"), percent.alias("diff_pct"), risk(percent, "score").alias("risk"))


def pricing_analysis(catalogue: DataFrame, offers: DataFrame) -> DataFrame:
    """Priced rows routed to sections; a row that would be lost or counted twice fails the job, in the same pass."""
    return routing.route(routing.balanced(priced(catalogue, offers)))


def missing_analysis(catalogue: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers of products that we don't have, one row each with price range, stores and confidence.

    ``catalogue``: (our_id, name, brand); ``offers``: (offer_id, name, brand, price, store). Rows that are no candidates keep their
    reason; every name gets one of reason, owned, review or missing.
    """
    tagged = filters.with_missing_reason(offers)
    keep = matching.featured(tagged.where("reason is null").drop("reason"), "name", brand="brand")
    ours = matching.featured(catalogue, "name", brand="brand")
    verdict = matching.resolve(keep, ours)
    confidence = F.when(F.col("ownership") == "missing", "green").otherwise("review")
    left = verdict.where("ownership <> 'owned'").withColumn("confidence", confidence)
    return aggregates.merge_offers(left, ["brand_key", "bare", "confidence"])


def accounting(catalogue: DataFrame, offers: DataFrame) -> DataFrame:
    """(outcome, n): every offer once, by reason or ownership; the counts sum up to the offers."""
    tagged = filters.with_missing_reason(offers).withColumnRenamed("reason", "outcome")
    ours = matching.featured(catalogue, "name", brand="brand")
    verdict = matching.resolve(matching.featured(tagged.where("outcome is null"), "name", brand="brand"), ours)
    done = tagged.where("outcome is not null").select("outcome").unionAll(verdict.select(F.col("ownership")))
    return aggregates.count_by(done, "outcome")


def closed_loop(catalogue: DataFrame, offers: DataFrame, known_brands: list[str] | None = None) -> DataFrame:
    """Match by SKU, then by name, then by similarity (90 and alike in size and gender); the rest is reviewed (65) or missing."""
    exact = matching.waterfall(offers, catalogue, {"sku": ("sku_key", "sku_key"), "name": ("name_key", "name_key")})
    found = exact.where("layer is not null").select("offer_id", "our_id", F.lit(100.0).alias("score"), F.lit("matched").alias("status"), "layer")
    rest = matching.featured(exact.where("layer is null").drop("our_id", "layer"), "name", known_brands)
    best = matching.best_match(rest, matching.featured(catalogue, "name", known_brands))
    good = (F.col("score") >= 90) & X.sizes_agree("size_ml", "our_size", 2.0) & ~X.genders_clash("gender_key", "our_gender")
    status = F.when(good, "matched").when(F.col("score") >= 65, "review").otherwise("missing")
    fuzzy = best.select("offer_id", "our_id", F.coalesce("score", F.lit(0.0)).alias("score"), status.alias("status"), F.lit("fuzzy").alias("layer"))
    return found.unionByName(fuzzy)
