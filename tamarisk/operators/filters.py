"""Row filters, most of them tagging a reason so that rows can be counted rather than lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import vocabulary as V
from ..functions.pricing import price_or_zero
from ..functions.text import Name, column
from ..session import written


def search(df: DataFrame, text: str = "", columns: tuple[str, ...] = (), regex: bool = False, **equal) -> DataFrame:
    """Rows where any of ``columns`` contains ``text`` (case ignored; a pattern with ``regex``), other columns equal the
    given values (a list: one of them), ``price_min``/``price_max`` and ``match_min`` hold inclusively."""
    tests: list[Column] = []
    if text:
        has = (lambda c: F.col(c).rlike(f"(?iu){text}")) if regex else (lambda c: F.contains(F.lower(c), F.lit(text.lower())))
        tests.append(reduce(lambda a, b: a | b, (F.coalesce(has(c), F.lit(False)) for c in columns)))
    for key, value in equal.items():
        if value in (None, "", [], "الكل"):
            continue
        if key == "price_min":
            tests.append(price_or_zero("price") >= value)
        elif key == "price_max":
            tests.append(price_or_zero("price") <= value)
        elif key == "match_min":
            tests.append(F.col("score") >= value)
        elif isinstance(value, (list, tuple)):
            tests.append(F.trim(key).isin(*value))
        else:
            tests.append(F.trim(key) == value)
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def missing_reason(name: Name, price: Name) -> Column:
    """Why an offer is no candidate for the missing list, or null: class, set, price, short name, no size, miniature."""
    return _missing_reason(name, price, X.product_class(name), X.is_set(name), X.size_ml(name))


def _missing_reason(name: Name, price: Name, kind: Column, in_set: Column, size: Column) -> Column:
    p = price_or_zero(price)
    return (
        F.when(kind.isin("rejected", "other", "body_lotion", "shower_gel", "hair_mist", "body_mist", "deodorant", "soap", "after_shave"), "class")
        .when((kind == "set") | in_set, "set")
        .when((p > 0) & ((p < V.MISSING_MIN_PRICE) | (p > V.MISSING_MAX_PRICE)), "price")
        .when(F.length(F.trim(F.coalesce(column(name), F.lit("")))) < V.MISSING_MIN_NAME, "short")
        .when(size == 0, "nosize")
        .when(size < V.MISSING_MIN_ML, "mini")
    )


def with_missing_reason(df: DataFrame, name: str = "name", price: str = "price") -> DataFrame:
    """Add ``reason`` (``missing_reason``); names are looked at once, however many rows have them."""
    names = df.select(F.col(name).alias("_n")).distinct().withColumn("_t", X.class_text("_n"))
    names = names.select("_n", X.class_of("_t").alias("_kind"), X.is_set("_n").alias("_in_set"), X.size_ml("_n").alias("_size"))
    # Written once: what follows reads the rows several times.
    names = written(names)
    rows = df.join(names, df[name].eqNullSafe(names["_n"]), "left")
    reason = _missing_reason(name, price, F.col("_kind"), F.col("_in_set"), F.col("_size"))
    return rows.withColumn("reason", reason).drop("_n", "_kind", "_in_set", "_size")


def strict_reason(name: Name, min_ml: float = 2.0) -> Column:
    """Why an offer is refused on upload, or null: empty, banned sample word, rejected class, tiny size."""
    n = F.trim(F.coalesce(column(name).cast("string"), F.lit("")))
    size = X.size_ml(n)
    banned = F.lower(n).rlike(r"(?U)\b(sample|عينة|عينه|decant|تقسيم|سمبل)\b")
    return (
        F.when(n == "", "empty_name")
        .when(banned, "sample")
        .when(X.product_class(n) == "rejected", "rejected_class")
        .when((size > 0) & (size < min_ml), "tiny")
    )


def is_phantom(name: Name, price: Name) -> Column:
    """Rows that are placeholders: no name or one like ``P12_x``, and no price."""
    n = F.trim(F.coalesce(column(name).cast("string"), F.lit("")))
    return ((n == "") | n.rlike(r"^(?:منتج\s+)?[Pp][A-Za-z0-9_\-]*$")) & (price_or_zero(price) <= 0)


def gate_reason(image: Name, description: Name, marker: str, least: int = 60) -> Column:
    """Why a product isn't ready to publish, or null: image, short description, missing marker, placeholder tokens."""
    from ..functions.text import strip_tags

    plain = strip_tags(description)
    return (
        F.when(~F.coalesce(column(image), F.lit("")).rlike(r"^(?i)https?://\S+$"), "image")
        .when(F.length(plain) < least, "short_description")
        .when(~F.contains(plain, F.lit(marker)), "marker")
        .when(plain.rlike(r"(?i)lorem|todo|\{\{|placeholder"), "placeholder")
    )


def split_by(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and rejected rows with it in column ``reason``: together all rows."""
    tagged = df.withColumn("reason", reason)
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")


def issues(*checks: tuple[str, Column]) -> Column:
    """Names of the checks that a row fails, as an array; an unknown outcome fails."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks)))


def soft_deleted(df: DataFrame, hidden: DataFrame, name: str, prefix: str = "softdel_") -> DataFrame:
    """Add ``is_deleted``: whether the trimmed name is among the hidden keys."""
    keys = hidden.select(F.col("key").alias("_key")).distinct()
    key = F.concat(F.lit(prefix), F.trim(F.coalesce(F.col(name), F.lit(""))))
    return df.join(keys, key == F.col("_key"), "left").withColumn("is_deleted", F.col("_key").isNotNull()).drop("_key")


def is_product_url(url: Name) -> Column:
    u = F.lower(F.coalesce(column(url), F.lit("")))
    return u.rlike(r"/(p|product|products|item)/|/[a-z]?\d{3,}(/|$)|\.html?$") & ~u.rlike(r"/(blog|category|categories|tag|cart|login|page)/")


def push_ready(decisions: DataFrame, least: float) -> DataFrame:
    """Decisions (product_id, score, action) that may be sent without review: sure, and with something to change."""
    named = F.coalesce(F.trim(F.col("product_id").cast("string")), F.lit("")) != ""
    return decisions.where((F.col("score") >= least) & F.col("action").isin("lower", "raise") & named)


def stuck(ledger: DataFrame, n: int = 20, order: str = "ingested_at") -> DataFrame:
    """The first ``n`` entries that are still INGESTED: a report."""
    return ledger.where("state = 'INGESTED'").orderBy(order).limit(n)
