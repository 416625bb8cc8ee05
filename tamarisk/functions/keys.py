"""Deterministic keys and canonical URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Name, column, key_text


def _text(c: Name) -> Column:
    return F.trim(F.coalesce(column(c).cast("string"), F.lit("")))


def canonical_url(c: Name, lower_path: bool = False) -> Column:
    """Without scheme, www, query, fragment and trailing slash; host in lower case, the path too if asked for."""
    t = F.regexp_replace(_text(c), r"^(?i)https?://(www\.)?", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[?#].*$", ""), r"/+$", "")
    host, path = F.lower(F.substring_index(t, "/", 1)), F.regexp_extract(t, r"^[^/]*(/.*)?$", 1)
    return F.concat(host, F.lower(path) if lower_path else path)


def url_id(c: Name) -> Column:
    """The number at the end of a URL's path, after an optional letter; empty if none."""
    return F.regexp_extract(_text(c), r"/[a-z]?(\d+)(?:[/?#].*)?$", 1)


def product_key(name: Name, store: Name = "", url: Name = "") -> Column:
    """SHA-1 of the canonical URL, or of store and name where there is no URL."""
    store = F.lit("") if isinstance(store, str) and not store else key_text(store)
    link = F.lit("") if isinstance(url, str) and not url else canonical_url(url, True)
    return F.sha1(F.when(link != "", link).otherwise(F.concat_ws("|", store, key_text(name))).cast("binary"))


def intake_id(store: Name, name: Name, url: Name) -> Column:
    """Sixteen digits of MD5 over store, name and URL."""
    return F.substring(F.md5(F.concat_ws("|", key_text(store), key_text(name), key_text(url)).cast("binary")), 1, 16)


def sku(brand: Name, name: Name, size: Name) -> Column:
    text = F.concat_ws("|", key_text(brand), key_text(name), key_text(size))
    return F.concat(F.lit("MH-"), F.upper(F.substring(F.md5(text.cast("binary")), 1, 10)))


def fingerprint(brand: Name, core: Name, size: Name) -> Column:
    """Brand (30 characters), core name and size: equal for offers of one product."""
    whole = F.floor(F.coalesce(column(size), F.lit(0.0))).cast("long").cast("string")
    return F.concat_ws("|", F.substring(key_text(brand), 1, 30), key_text(core), whole)
