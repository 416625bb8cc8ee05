"""Prices: cleaning, thresholds, decisions and suggestions.

Two conventions of a missing price exist and are kept apart: 0.0 for offers that were loaded, null for prices that were read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import Name, column


def _number(c: Name) -> Column:
    return F.coalesce(column(c).try_cast("double"), F.lit(0.0))


def cents(c: Column) -> Column:
    """Rounded half up to two decimals, by way of four: exact decimals, so that ties don't depend on binary fractions."""
    return F.round(c.cast("decimal(18,4)"), 2).cast("double")


def price_or_zero(c: Name) -> Column:
    """0.0 for what is no number."""
    n = _number(c)
    return F.when(F.isnan(n), 0.0).otherwise(n)


def price_or_null(c: Name) -> Column:
    """The number in a text without thousands separators and other characters; null if there is none."""
    t = F.regexp_replace(F.translate(column(c).cast("string"), "٠١٢٣٤٥٦٧٨٩٫", "0123456789."), r"[^0-9.]", "")
    return F.when(t.rlike(r"^\d*\.?\d+$"), t.try_cast("double"))


def last_price(c: Name, most: float = 1e6) -> Column:
    """The last number of a text with currencies and tags, if within bounds; else 0.0."""
    t = F.translate(F.coalesce(column(c).cast("string"), F.lit("")), "٠١٢٣٤٥٦٧٨٩,", "0123456789")
    numbers = F.regexp_extract_all(F.regexp_replace(t, r"<[^>]*>", " "), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    value = F.try_element_at(numbers, F.lit(-1)).try_cast("double")
    return F.when((value > 0) & (value < most), value).otherwise(0.0)


def first_price(c: Name, most: float = 1e6) -> Column:
    """The first number of a text between 0 and ``most``, exclusive; null if there is none."""
    t = F.translate(F.coalesce(column(c).cast("string"), F.lit("")), ",", "")
    numbers = F.transform(F.regexp_extract_all(t, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("double"))
    return F.get(F.filter(numbers, lambda x: (x > 0) & (x < most)), 0)


def product_id(c: Name) -> Column:
    """Ids as text: ``100.0`` is ``100``; zero, nan and nothing are empty."""
    t = F.trim(F.coalesce(column(c).cast("string"), F.lit("")))
    t = F.regexp_replace(t, r"\.0+$", "")
    return F.when(F.lower(t).isin("", "0", "nan", "none"), "").otherwise(t)


def threshold(ours: Name, theirs: Name, tolerance: float = V.PRICE_TOLERANCE) -> Column:
    """How far two prices may lie apart and still agree: a share of high prices, a constant of others."""
    a, b, tolerance = column(ours), column(theirs), float(tolerance or 10)
    mean = (a + b) / 2
    return (
        F.when((a <= 0) | (b <= 0), tolerance)
        .when(mean >= V.HIGH_AVERAGE, mean * V.HIGH_SHARE)
        .when(mean >= V.MID_AVERAGE, tolerance)
        .otherwise(V.LOW_TOLERANCE)
    )


def decision(ours: Name, theirs: Name, tolerance: float = V.PRICE_TOLERANCE) -> Column:
    """Struct of decision, diff_ours_minus_comp, threshold, action. A missing price goes to review."""
    a, b = price_or_zero(ours), price_or_zero(theirs)
    both, limit, diff = (a > 0) & (b > 0), threshold(a, b, tolerance), cents(a.cast("decimal(18,4)") - b.cast("decimal(18,4)"))
    high, low = both & (diff > limit), both & (diff < -limit)
    pick = lambda x, y, z, w: F.when(high, x).when(low, y).when(both, z).otherwise(w)
    return F.struct(
        pick(V.RAISE, V.LOWER, V.APPROVED, V.NO_PRICE).alias("decision"),
        F.when(both, diff).otherwise(0.0).alias("diff_ours_minus_comp"),
        F.when(both, limit).otherwise(0.0).alias("threshold"),
        pick("raise", "lower", "approve", "review").alias("action"),
    )


def undercut(theirs: Name) -> Column:
    p = column(theirs)
    return F.when(p > 0, cents(p - 1)).otherwise(0.0)


def with_margin(theirs: Name, percent: float) -> Column:
    p = column(theirs)
    return F.when(p > 0, F.round(p * (1 + percent / 100), 0)).otherwise(0.0)


def rule(
    ours: Name, theirs: Name, score: Name, cost: Name | None = None, min_diff: float = 1.0, step: float = 1.0, least_score: float = 85.0
) -> Column:
    """The first automatic rule that fits: undercut a cheaper competitor (not below cost, nor below 1), raise to match a
    dearer one, keep. Struct of action and new_price."""
    a, b, s = column(ours), column(theirs), column(score)
    floor = F.lit(0.0) if cost is None else F.coalesce(column(cost), F.lit(0.0))
    target = F.greatest(cents(b - step), floor, F.lit(1.0))
    fits = (s >= least_score) & (a > 0) & (b > 0)
    keep = F.struct(F.lit("keep").alias("action"), a.alias("new_price"))
    return (
        F.when(fits & (a - b > min_diff) & (target < a), F.struct(F.lit("lower").alias("action"), target.alias("new_price")))
        .when(fits & (b - a > min_diff), F.struct(F.lit("raise").alias("action"), cents(b - step).alias("new_price")))
        .otherwise(keep)
    )


def risk(diff_percent: Name, score: Name) -> Column:
    d, s = F.abs(column(diff_percent)), column(score)
    return F.when((d > 20) & (s >= 85), "critical").when((d > 10) & (s >= 75), "medium").otherwise("low")


def signed(c: Name) -> Column:
    """A difference for display, with its sign."""
    v = F.round(column(c), 2)
    return F.concat(F.when(v > 0, "+").otherwise(""), F.format_number(v, 2))
