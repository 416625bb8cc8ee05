"""Row shapes: canonical columns from whatever a source calls them, templates for upload, and media fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions.keys import canonical_url, sku
from ..functions.pricing import price_or_zero, with_margin
from ..functions.text import bare, key_text, normalize_name


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename where the old name is there and the new one is not."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})


def map_columns(df: DataFrame, chosen: dict[str, str | None]) -> DataFrame:
    """Copy the chosen columns to canonical names: canonical -> source."""
    return df.withColumns({c: F.col(f"`{s}`") for c, s in chosen.items() if s and s in df.columns})


def first_filled(df: DataFrame, *names: str) -> Column:
    """The first of the columns there that isn't blank, as text; null if none."""
    have = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(None).cast("string"))


def scraped_row(df: DataFrame, store: str = "") -> DataFrame:
    """(store, name, price, brand, image, url) of scraped rows under their various names; rows with a name under two characters or
    without a price are dropped, and relative URLs become absolute."""
    base = F.lit(store.rstrip("/"))
    url = first_filled(df, "url", "product_url", "link", "رابط")
    full = F.when(url.rlike(r"^(?i)https?://"), url).when(url.isNotNull(), F.concat(base, F.lit("/"), F.ltrim(url, F.lit("/"))))
    rows = df.select(
        F.coalesce(first_filled(df, "store", "competitor"), canonical_url(base)).alias("store"),
        first_filled(df, "name", "product_name", "title", "المنتج").alias("name"),
        price_or_zero(first_filled(df, "price", "السعر")).alias("price"),
        first_filled(df, "brand", "الماركة").alias("brand"),
        first_filled(df, "image", "image_url", "thumb").alias("image"),
        full.alias("url"),
    )
    return rows.where((F.length("name") >= 2) & (F.col("price") > 0))


def with_features(df: DataFrame, name: str, brands: list[str] | None = None) -> DataFrame:
    """The derived columns of a store table, all in one projection."""
    return df.withColumns(
        {
            "norm_name": normalize_name(name),
            "agg_name": bare(name),
            "size_ml": X.size_ml(name),
            "concentration": X.concentration(name),
            "gender": X.gender(name),
            "product_class": X.product_class(name),
            "extracted_brand": X.known_brand(name, brands) if brands else F.lit(""),
        }
    )


def fill_features(df: DataFrame, name: str, brands: list[str] | None = None) -> DataFrame:
    """Derive features only where ``agg_name`` is still blank; rows that have it stay as they are."""
    blank = F.coalesce(F.col("agg_name"), F.lit("")) == ""
    return df.where(~blank).unionByName(with_features(df.where(blank).drop("agg_name"), name, brands).select(df.columns))


def winner_field(candidates: str, winner: str, field: str) -> Column:
    """A field of the nested candidate whose name is the winner's."""
    return F.get(F.filter(F.col(candidates), lambda c: c["name"] == F.col(winner)), 0)[field]


def upload_rows(missing: DataFrame, margin: float = 15.0) -> DataFrame:
    """Confirmed missing products as upload rows: price with margin, and a SKU that is unique: collisions get an ``X`` each, in the
    order of the names."""
    green = missing.where(F.col("confidence") == "green")
    base = sku("brand", "name", F.col("size_ml").cast("string"))
    rows = green.select("name", "brand", "size_ml", with_margin("price", margin).alias("price"), base.alias("_sku"))
    nth = F.row_number().over(Window.partitionBy("_sku").orderBy("name", "price"))
    return rows.withColumn("sku", F.concat("_sku", F.repeat(F.lit("X"), nth - 1))).drop("_sku")


def first_image(text: str) -> Column:
    """The first image URL in a text, or null."""
    found = F.regexp_extract(F.col(text), r"(?i)(https?://\S+?\.(?:jpe?g|png|webp|gif)(?:\?\S*)?)", 1)
    return F.nullif(found, F.lit(""))


def restore(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse a JSON text column; what doesn't parse is null."""
    return df.withColumn(column, F.from_json(column, schema))


def brand_records(names: DataFrame, known: DataFrame) -> DataFrame:
    """New brands (column brand), one each by normalised name, that ``known`` (column brand) lacks."""
    new = names.where(key_text("brand") != "").groupBy(key_text("brand").alias("key")).agg(F.min("brand").alias("brand"))
    return new.join(known.select(key_text("brand").alias("key")).distinct(), "key", "left_anti")
