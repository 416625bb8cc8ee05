"""Sinks: files, templates and webhook payloads."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import cents, price_or_zero, product_id


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that CSV can hold them."""
    nested = ("array", "map", "struct")
    own = {c: F.col(f"`{c}`") for c in df.columns}
    return df.select(*(F.to_json(own[c]).alias(c) if kind.startswith(nested) else own[c] for c, kind in df.dtypes))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flat(df).write.mode(mode).csv(path, header=True, encoding="UTF-8")


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Replace the rows of the keys that ``df`` has and keep all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_sheets(frames: dict[str, DataFrame], path: str, workbooks: bool = False) -> None:
    """One folder of CSV, or of workbooks, for each sheet; names are cut to 31 characters as spreadsheets want them."""
    from ..sources.workbook import sheet_name, write_workbooks

    for name, df in frames.items():
        if workbooks:
            write_workbooks(flat(df), f"{path}/{sheet_name(name)}", name, mode="overwrite")
        else:
            write_csv(df, f"{path}/{name[:31]}", "overwrite")


def section_price(section: Column, ours: Column, theirs: Column) -> Column:
    """Price to publish: undercut when ours is raised or lowered to a competitor, ours when approved, else theirs or ours."""
    under = F.greatest(cents(theirs - 1), F.lit(0.0))
    return (
        F.when(section.isin("raise", "lower") & (theirs > 0), under)
        .when(section.isin("approved", "update"), ours)
        .otherwise(F.when(theirs > 0, theirs).otherwise(ours))
    )


def payloads(df: DataFrame, section: str) -> DataFrame:
    """(product_id, payload JSON) for rows with a name, an id and a price; empty fields are left out."""
    price = section_price(F.lit(section), price_or_zero("our_price"), price_or_zero("comp_price"))
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    rows = df.withColumns({"_id": product_id("product_id"), "_price": price})
    rows = rows.where((F.coalesce(F.trim("name"), F.lit("")) != "") & (F.col("_id") != "") & (F.col("_price") > 0))
    body = F.struct(F.col("_id").alias("product_id"), blank("name").alias("name"), F.col("_price").alias("price"), blank("store").alias("competitor"))
    return rows.select(F.col("_id").alias("product_id"), F.to_json(body).alias("payload"))


def batches(payload: DataFrame, size: int = 20, bucket_rows: int = 5000) -> DataFrame:
    """(batch, products): payloads in groups of up to ``size``, numbered within hash buckets of about ``bucket_rows`` rows, so that no
    task orders more, however many rows there are."""
    from pyspark.sql import Window

    bucket = F.pmod(F.xxhash64("product_id", "payload"), F.lit(max(1, payload.count() // bucket_rows)))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("product_id", "payload")) - 1
    numbered = payload.withColumn("bucket", bucket).withColumn("nth", F.floor(nth / size))
    grouped = numbered.groupBy("bucket", "nth").agg(F.sort_array(F.collect_list("payload")).alias("products"))
    return grouped.select(F.concat_ws("-", "bucket", "nth").alias("batch"), "products")


def send(batched: DataFrame, poster: Callable[[list[str]], bool], retries: int = 3, pause: float = 1.0) -> DataFrame:
    """(batch, n, sent, attempts): call ``poster`` for every batch on the executors, again if it fails or raises, after ``pause``
    seconds at first and twice as long each time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for batch, products in zip(p.batch, p.products, strict=True):
                sent, attempt = False, 0
                while not sent and attempt < retries:
                    if attempt:
                        time.sleep(pause * 2 ** (attempt - 1))
                    attempt += 1
                    try:
                        sent = bool(poster(list(products)))
                    except Exception:  # noqa: BLE001 a failed post is an outcome
                        sent = False
                rows.append((batch, len(products), sent, attempt))
            yield pd.DataFrame(rows, columns=["batch", "n", "sent", "attempts"])

    return batched.mapInPandas(run, "batch string, n int, sent boolean, attempts int")


def template(df: DataFrame, columns: dict[str, Column | str | None]) -> DataFrame:
    """Project to a fixed template: name -> column, constant text, or nothing."""
    return df.select(*((c if isinstance(c, Column) else F.lit(c or "")).alias(n) for n, c in columns.items()))


def json_safe(df: DataFrame, prices: list[str]) -> DataFrame:
    """NaN becomes 0.0 in price columns and null in other doubles; nested columns become JSON."""
    fix = {
        c: F.when(F.isnan(c), F.lit(0.0) if c in prices else F.lit(None)).otherwise(F.col(c))
        for c, kind in df.dtypes
        if kind in ("double", "float")
    }
    return flat(df.withColumns(fix) if fix else df)


def cached(spark, folder: str, signature: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result stored under a signature of its inputs, made and written if there is none. A folder counts once its success
    marker is there, which Spark writes last."""
    from pyspark.errors import AnalysisException

    path = f"{folder}/{signature}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def upload_file(products: DataFrame, marker: str, least: int = 60) -> tuple[DataFrame, DataFrame]:
    """Two tables of (name, category, image, description, price, sku, brand) products: the upload file with all columns as text, of those
    that may be published, and the rest as it came with the reason. The reduced price is one below the price; a missing sku is
    made from brand and name."""
    from ..functions import vocabulary as V
    from ..functions.keys import sku
    from .filters import gate_reason, split_by

    good, refused = split_by(products, gate_reason("image", "description", marker, least))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = {
        "أسم المنتج": text("name"),
        "تصنيف المنتج": text("category"),
        "صورة المنتج": text("image"),
        "وصف صورة المنتج": F.trim(F.regexp_replace(text("name"), r"(?U)[^\w\s]", " ")),
        "سعر المنتج": text("price"),
        "الوصف": text("description"),
        "رمز المنتج sku": F.coalesce(F.nullif(F.trim(text("sku")), F.lit("")), sku("brand", "name", F.lit(""))),
        "السعر المخفض": F.when(F.col("price") > 1, cents(F.col("price") - 1).cast("string")).otherwise(""),
        "الماركة": text("brand"),
    }
    return template(good, {c: own.get(c, V.UPLOAD_CONSTANTS.get(c, "")) for c in V.UPLOAD_COLUMNS}), refused
