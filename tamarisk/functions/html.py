"""Product fields from pages: JSON-LD first, then meta tags, then text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .pricing import first_price
from .text import Name, column, strip_tags

FIELDS = ("name", "image", "description", "brand", "sku", "price", "currency")
PRODUCT = "struct<" + ",".join(f"{f}:{'double' if f == 'price' else 'string'}" for f in FIELDS) + ">"
#: The lengths that fields are cut to, where a number is looked for, and currencies whose prices don't count.
CUT = {"name": 250, "description": 1200, "brand": 80, "sku": 120}
SKU_FIELDS = ("sku", "mpn", "productID", "gtin13", "gtin")
FOREIGN = ("USD", "EUR", "GBP", "AED", "KWD", "BHD", "QAR", "OMR")
META = {
    "name": ("og:title", "twitter:title"),
    "image": ("og:image", "twitter:image"),
    "description": ("og:description", "twitter:description", "description"),
    "brand": ("product:brand", "og:brand"),
    "sku": ("product:retailer_item_id", "product:sku", "og:sku"),
    "price": ("product:sale_price:amount", "product:price:amount", "og:price:amount"),
    "currency": ("product:sale_price:currency", "product:price:currency", "og:price:currency"),
}


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once for a row however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def meta(html: Name, name: str) -> Column:
    """Content of the first meta tag with this property or name."""
    tag = re.escape(name)
    first = F.regexp_extract(column(html), rf"""(?is)<meta[^>]*(?:property|name)=["']{tag}["'][^>]*content=["']([^"']*)""", 1)
    other = F.regexp_extract(column(html), rf"""(?is)<meta[^>]*content=["']([^"']*)["'][^>]*(?:property|name)=["']{tag}["']""", 1)
    filled = lambda c: _bound(c, lambda v: F.nullif(v, F.lit("")))
    return F.coalesce(filled(first), filled(other))


def tag_text(html: Name, tag: str) -> Column:
    found = F.regexp_extract(column(html), rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.nullif(strip_tags(found), F.lit(""))


def links(html: Name) -> Column:
    return F.array_distinct(F.regexp_extract_all(column(html), F.lit(r"""(?i)href=["']([^"'#]+)["']"""), F.lit(1)))


def _objects(node):
    """Every object of a parsed JSON-LD block, the outer before the inner."""
    if isinstance(node, dict):
        yield node
        node = list(node.values())
    if isinstance(node, list):
        for x in node:
            yield from _objects(x)


def _first(x):
    return x[0] if isinstance(x, list) and x else x


def _number(x) -> float | None:
    """The first number in a value, if a price can be it."""
    found = re.search(r"\d+\.?\d*", str(x).replace(",", "")) if x is not None else None
    value = float(found[0]) if found else 0.0
    return value if 0 < value < 1_000_000 else None


def _offered(product: dict) -> tuple | None:
    """Fields of an object that is a product with a price in a currency that counts."""
    offer = _first(product.get("offers"))
    offer = offer if isinstance(offer, dict) else {}
    currency = str(offer.get("priceCurrency") or "").upper()
    price = _number(offer.get("price")) or _number(offer.get("lowPrice"))
    if "Product" not in str(product.get("@type", "")) or price is None or currency in FOREIGN:
        return None
    image, brand = _first(product.get("image")), product.get("brand")
    found = {
        "name": product.get("name"),
        "image": image.get("url") if isinstance(image, dict) else image,
        "description": product.get("description"),
        "brand": brand.get("name") if isinstance(brand, dict) else brand,
        "sku": next((product[k] for k in SKU_FIELDS if product.get(k)), None),
    }
    texts = (str(v or "").strip()[: CUT.get(k)] or None for k, v in found.items())
    return (*texts, price, currency or None)


def json_ld(html: Name) -> Column:
    """The first priced product of a page's JSON-LD blocks, at any depth, as a struct of ``FIELDS``; nulls where it says nothing."""

    @pandas_udf(PRODUCT)
    def run(s: pd.Series) -> pd.DataFrame:
        block = re.compile(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""")
        rows = []
        for page in s:
            row = None
            for text in block.findall(page or ""):
                try:
                    parsed = json.loads(text)
                except ValueError:
                    continue
                row = next(filter(None, map(_offered, _objects(parsed))), None)
                if row is not None:
                    break
            rows.append(row or (None,) * len(FIELDS))
        return pd.DataFrame(rows, columns=FIELDS)

    return run(column(html))


def meta_product(html: Name) -> Column:
    """What a page's meta tags say of a product, as ``json_ld``; of several tags for a field the first in ``META`` that isn't empty,
    and no price in a foreign currency."""
    tags = list(dict.fromkeys(tag for names in META.values() for tag in names))

    def fields(said: Column) -> Column:
        of = lambda tag: said[f"t{tags.index(tag)}"]
        found = {k: F.coalesce(*map(of, names)) for k, names in META.items()}
        currency = F.upper(found["currency"])
        amounts = F.transform(F.array(*map(of, META["price"])), lambda a: first_price(a))
        price = F.get(F.filter(amounts, lambda a: (a > 0) & (a < 1_000_000)), F.lit(0))
        texts = [F.nullif(F.trim(found[k] if k not in CUT else F.substring(found[k], 1, CUT[k])), F.lit("")).alias(k) for k in FIELDS[:5]]
        return F.struct(*texts, F.when(~F.coalesce(currency.isin(*FOREIGN), F.lit(False)), price).alias("price"), currency.alias("currency"))

    # Tags that a page doesn't name are not searched by pattern.
    said = lambda low: F.struct(*(F.when(F.contains(low, F.lit(tag.lower())), meta(html, tag)).alias(f"t{i}") for i, tag in enumerate(tags)))
    return _bound(_bound(F.lower(column(html)), said), fields)


def product(html: Name) -> Column:
    """Fields of a page's product from JSON-LD if it has a price there, else from meta tags; name and image also without a price, the
    name at last from headings. ``currency`` is SAR where a price has none."""
    ld = json_ld(html)
    wanted = ld["price"].isNull() | ld["name"].isNull() | ld["image"].isNull()

    def fields(both: Column) -> Column:
        ld, tags = both["ld"], both["tags"]
        rest = [F.coalesce(ld[k], F.when(ld["price"].isNull(), tags[k])).alias(k) for k in FIELDS[2:5]]
        price = F.coalesce(ld["price"], tags["price"])
        currency = F.when(ld["price"].isNotNull(), F.coalesce(ld["currency"], F.lit("SAR"))).otherwise(F.coalesce(tags["currency"], F.lit("SAR")))
        return F.struct(
            F.coalesce(ld["name"], tags["name"], tag_text(html, "h1"), tag_text(html, "title")).alias("name"),
            F.coalesce(ld["image"], tags["image"]).alias("image"),
            *rest,
            price.alias("price"),
            F.when(price.isNotNull(), currency).alias("currency"),
        )

    return _bound(F.struct(ld.alias("ld"), F.when(wanted, meta_product(html)).alias("tags")), fields)


def lenient_json(c: Name) -> Column:
    """The first JSON object or array in a text, as it stands there, up to the bracket that closes it; null if there is none. Code
    fences and what stands around it, further objects and brackets included, don't matter."""

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        read = json.JSONDecoder().raw_decode

        def one(text: str | None) -> str | None:
            for m in re.finditer(r"[\[{]", text or ""):
                try:
                    return text[m.start() : read(text, m.start())[1]]
                except ValueError:
                    continue
            return None

        return s.map(one)

    return run(column(c))
