"""File sources. Schemas are explicit; roles of columns are found on the driver from names or a few rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.pricing import price_or_null, price_or_zero

#: Header names by role.
ROLES = {
    "name": ("المنتج", "اسم المنتج", "أسم المنتج", "product_name", "name", "title"),
    "price": ("السعر", "سعر المنتج", "price", "سعر"),
    "id": ("معرف_المنتج", "رقم المنتج", "No.", "product_id", "id", "sku"),
    "brand": ("الماركة", "brand"),
    "image": ("صورة", "image", "image_url", "img"),
    "url": ("رابط", "url", "product_url", "link"),
}
META_ROW = "بيانات المنتج"
ARABIC_PAGE = "windows-1256"


def _filled(names: list[str]) -> Column:
    return F.coalesce(*(F.col(f"`{n}`") for n in names)).isNotNull()


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 if all lines of a file are valid, else the Arabic code page, which reads any bytes. The search stops at the first line
    that isn't."""
    return "UTF-8" if spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty() else ARABIC_PAGE


def read_csv(spark: SparkSession, path: str, encoding: str | None = "UTF-8", header: bool = True, bad: str | None = None) -> DataFrame:
    """All columns as text; rows of nothing but nulls are dropped, no others. Lines with too many or too few cells keep those that
    have a column; ``bad`` names a column for the whole text of such lines, so that they can be counted. Export files that
    start with a meta line are read with the second line as header. Without an encoding, it is found out."""
    page = (encoding or encoding_of(spark, path)) == ARABIC_PAGE
    encoding = "ISO-8859-1" if page else encoding or "UTF-8"
    recode = (lambda x: x and x.encode("latin-1").decode(ARABIC_PAGE)) if page else (lambda x: x)
    options = {"path": path, "encoding": encoding}
    top = spark.read.csv(**options, header=False, schema="c string").limit(1).first()
    meta = top is not None and (recode(top[0]) or "").lstrip("\ufeff").startswith(META_ROW)
    if meta:
        head = spark.read.csv(**options, header=False, enforceSchema=True).limit(2).collect()[-1]
        names = [recode(c).strip() if c else f"_c{i}" for i, c in enumerate(head)]
    else:
        names = [recode(c) for c in spark.read.csv(**options, header=header).columns]
    line = bad or "_line"
    schema = StructType([StructField(n, StringType()) for n in [*names, line]])
    rows = spark.read.csv(**options, schema=schema, header=header and not meta, mode="PERMISSIVE", columnNameOfCorruptRecord=line)
    if page:
        # Its upper half, read as Latin-1, one character for each byte.
        high = bytes(range(128, 256))
        table = (high.decode("latin-1"), high.decode(ARABIC_PAGE))
        rows = rows.select(*(F.translate(f"`{n}`", *table).alias(n) for n in [*names, line]))
    if meta:
        rows = rows.where(~F.coalesce(F.trim(f"`{names[0]}`"), F.lit("")).isin(META_ROW, names[0]))
    rows = rows.where(_filled(names))
    return rows if bad else rows.select(*(F.col(f"`{n}`") for n in names))


def promoted(df: DataFrame, least: int = 2) -> DataFrame:
    """``df`` with its first row as header, if that holds the header names of ``least`` roles or more and its own header doesn't."""
    row = df.limit(1).first()
    known = {n.lower() for names in ROLES.values() for n in names}
    count = lambda names: sum((x or "").strip().lower() in known for x in names)
    if row is None or count(row) < least or count(df.columns) >= least:
        return df
    names = [(x or "").strip() or c for x, c in zip(row, df.columns, strict=True)]
    same = reduce(lambda a, b: a & b, (F.col(f"`{c}`").eqNullSafe(F.lit(x)) for c, x in zip(df.columns, row, strict=True)))
    return df.where(~same).toDF(*names)


def column_for(columns: list[str], role: str) -> str | None:
    """The column of a role: an exact name, else one that contains a name; price-like and link-like headers are no names."""
    low = {c.strip().lower(): c for c in columns}
    for want in ROLES[role]:
        if want.lower() in low:
            return low[want.lower()]
    for want in ROLES[role]:
        for have, c in low.items():
            clash = role == "name" and any(x in have for x in ("price", "سعر", "url", "رابط"))
            if want.lower() in have and not clash:
                return c
    return None


def infer_roles(df: DataFrame) -> dict[str, str]:
    """Roles by content of all rows, in one pass with partial aggregation: links, images, prices, and the longest text as the name.
    A table without rows has a name only, its first column."""
    tests = []
    for c in df.columns:
        t = F.coalesce(F.col(c).cast("string"), F.lit(""))
        tests += [
            F.avg(t.rlike(r"(?i)^https?://").cast("int")).alias(f"{c}\0link"),
            F.avg(t.rlike(r"(?i)\.(jpe?g|png|webp)(\?|$)").cast("int")).alias(f"{c}\0image"),
            F.avg(t.rlike(r"^\s*\d+([.,]\d+)?\s*$").cast("int")).alias(f"{c}\0price"),
            F.avg(F.length(t)).alias(f"{c}\0length"),
        ]
    row = df.agg(*tests).first().asDict()
    share = lambda c, k: row[f"{c}\0{k}"] or 0
    roles: dict[str, str] = {}
    for role, least in (("image", 0.22), ("link", 0.38), ("price", 0.5)):
        best = max((c for c in df.columns if c not in roles.values()), key=lambda c: share(c, role), default=None)
        if best is not None and share(best, role) >= least:
            roles[role] = best
    rest = [c for c in df.columns if c not in roles.values()]
    if rest:
        roles["name"] = max(rest, key=lambda c: share(c, "length"))
    return roles


def load_catalogue(raw: DataFrame) -> DataFrame:
    """(product_id, name, price, brand) of a catalogue; nameless rows are dropped, unreadable prices are 0."""
    pick = lambda role: F.col(f"`{c}`") if (c := column_for(raw.columns, role)) else F.lit(None).cast("string")
    rows = raw.select(pick("id").alias("product_id"), F.trim(pick("name")).alias("name"), price_or_zero(pick("price")).alias("price"), pick("brand").alias("brand"))
    return rows.where(F.coalesce("name", F.lit("")) != "")


def load_competitor(raw: DataFrame, store: str | None = None) -> DataFrame:
    """(store, name, price, image, url) of a store's export; the price is null where there is none. Without a store name, the
    file's name is it."""
    pick = lambda role: F.col(f"`{c}`") if (c := column_for(raw.columns, role)) else F.lit(None).cast("string")
    label = F.lit(store) if store else F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = raw.select(label.alias("store"), F.trim(pick("name")).alias("name"), price_or_null(pick("price")).alias("price"), pick("image").alias("image"), pick("url").alias("url"))
    return rows.where(F.coalesce("name", F.lit("")) != "")


def live_offers(store_table: DataFrame) -> DataFrame:
    """Offers with a positive price; the store stays a column."""
    return store_table.where(F.col("price") > 0)


def read_stores(spark: SparkSession, path: str) -> DataFrame:
    schema = "name string, store_url string, sitemap_url string, mahally_store_id long"
    return spark.read.schema(schema).json(path, multiLine=True)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(url, lastmod) of product pages in XML sitemaps."""
    from ..operators.filters import is_product_url

    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    keep = is_product_url("loc") & ~F.col("loc").rlike(r"(?i)^https?://cdn\.")
    return rows.where(keep).select(F.trim("loc").alias("url"), "lastmod").dropDuplicates(["url"])


def parse_pasted(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``, row, cells) of pasted tables: each non-blank line is split at bars, tabs or commas, whichever its text has first."""
    sep = F.when(F.col(text).contains("|"), r"\|").when(F.col(text).contains("\t"), "\t").otherwise(",")
    lines = df.select(*keep, F.posexplode(F.split(text, "\n")).alias("row", "line"), sep.alias("sep"))
    cells = F.transform(F.split("line", F.col("sep")), lambda c: F.trim(c))
    return lines.where("trim(line) <> ''").select(*keep, "row", cells.alias("cells"))


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with exactly ``columns``, as text; columns it lacks are null, and a missing file is an empty table."""
    from pyspark.errors import AnalysisException

    empty = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    try:
        return empty.unionByName(read_csv(spark, path), allowMissingColumns=True).select(*columns)
    except AnalysisException:
        return empty
