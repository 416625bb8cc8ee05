"""Entity resolution: which offers are which catalogue product.

Names become features once; candidates share near words (``name_join``); only distinct pairs of names are scored; guards are plain expressions; the best candidate is an aggregate. Every input row gets exactly one outcome.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import features as X
from ..functions import vocabulary as V
from ..functions.keys import canonical_url
from ..functions.similarity import similarity
from ..functions.text import bare_tokens, key_text
from ..session import written
from .name_join import candidates


def featured(df: DataFrame, name: str, brands: list[str] | None = None, brand: str | None = None) -> DataFrame:
    """Add the columns that matching reads: bare, brand_key, size_ml, gender_key. Names are looked at once, however many rows have
    them."""
    own = F.col(brand).cast("string") if brand else F.lit(None).cast("string")
    names = df.select(F.col(name).alias("_n"), own.alias("_own")).distinct()
    b = X.known_brand("_n", brands) if brands else F.lit("")
    if brand:
        b = F.when(b == "", F.coalesce("_own", F.lit(""))).otherwise(b)
    names = names.withColumns(
        {"bare": F.array_join(bare_tokens("_n"), " "), "brand_key": key_text(b), "size_ml": X.size_ml("_n"), "gender_key": X.gender("_n")}
    )
    # Written once: every pass over the rows would look at all names again.
    names = written(names)
    same = df[name].eqNullSafe(names["_n"])
    if brand:
        same &= df[brand].cast("string").eqNullSafe(names["_own"])
    return df.join(names, same, "left").drop("_n", "_own")


def best_match(offers: DataFrame, ours: DataFrame, kernel: str = "token_set", least: float = 0.0) -> DataFrame:
    """``offers`` (offer_id, features) with score and the best catalogue row (our_id and its features): the highest score, then
    the lowest our_id. Rows without a candidate keep nulls."""
    # The rows are read for their names once, not once for each use of the names.
    asked = written(offers.select("bare", "brand_key").distinct())
    held = written(ours.groupBy("bare", "brand_key").agg(F.min("our_id").alias("first_id")))
    pairs = candidates(asked, held, least, kernel=kernel)
    scored = pairs.withColumn("score", F.round(similarity("bare", "our_bare", kernel), 4)).where(F.col("score") >= least)
    item = F.struct("our_id", F.col("size_ml").alias("our_size"), F.col("gender_key").alias("our_gender"))
    # Of catalogue rows with one name and brand, the first stands for all.
    named = ours.groupBy(F.col("bare").alias("our_bare"), F.col("brand_key").alias("our_brand")).agg(F.min(item).alias("item"))
    found = scored.join(named, ["our_bare", "our_brand"])
    best = found.groupBy("bare", "brand_key").agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col("item.our_id"), F.col("item.our_size"), F.col("item.our_gender"))).alias("b")
    )
    best = best.select("bare", "brand_key", (-F.col("b.s")).alias("score"), "b.our_id", "b.our_size", "b.our_gender")
    return offers.join(best, ["bare", "brand_key"], "left")


def ownership(
    score: Column, has_item: Column, size_ok: Column, clash: Column, confirm: float = V.MATCH_CONFIRMED, review: float = V.MATCH_REVIEW
) -> Column:
    """Struct of ownership (owned, review, missing) and reason."""
    s = F.coalesce(score, F.lit(0.0))
    owned, maybe = (s >= confirm) & size_ok & ~clash, has_item & (s >= review)
    reason = F.when(clash, "gender").when((s >= confirm) & ~size_ok, "size").otherwise("unverified")
    return F.struct(
        F.when(owned, "owned").when(maybe, "review").otherwise("missing").alias("ownership"),
        F.when(~owned & maybe, reason).otherwise("").alias("reason"),
    )


def resolve(offers: DataFrame, ours: DataFrame) -> DataFrame:
    """Each offer with score, our_id, ownership and reason: one row out for each row in."""
    found = best_match(offers, ours)
    verdict = ownership(
        F.col("score"),
        F.col("our_id").isNotNull(),
        X.sizes_agree("size_ml", "our_size"),
        X.genders_clash("gender_key", "our_gender"),
    )
    return found.withColumn("_v", verdict).select(*offers.columns, F.coalesce("score", F.lit(0.0)).alias("score"), "our_id", "_v.*")


def waterfall(offers: DataFrame, ours: DataFrame, layers: dict[str, tuple[str, str]]) -> DataFrame:
    """Match by one key after another: {layer: (offer column, catalogue column)}. Blank keys match nothing; an offer takes the first
    layer that finds it, with the lowest our_id; the rest has null in our_id and layer. Each layer sees only what is left."""
    rest, done = offers, None
    for layer, (a, b) in layers.items():
        keys = ours.where(F.coalesce(F.trim(F.col(b).cast("string")), F.lit("")) != "")
        keys = keys.groupBy(F.col(b).alias("_k")).agg(F.min("our_id").alias("our_id"))
        found = rest.join(keys, rest[a] == keys["_k"]).drop("_k").withColumn("layer", F.lit(layer))
        done = found if done is None else done.unionByName(found)
        rest = rest.join(keys, rest[a] == keys["_k"], "left_anti")
    left = rest.withColumns({"our_id": F.lit(None).cast(ours.schema["our_id"].dataType), "layer": F.lit(None).cast("string")})
    return left if done is None else done.unionByName(left)


def keyed(df: DataFrame, sku: str, url: str, name: str) -> DataFrame:
    """Add the waterfall's keys: sku_key, url_key, name_key."""
    return df.withColumns({"sku_key": key_text(sku), "url_key": canonical_url(url, True), "name_key": key_text(name)})


def not_in_catalogue(offers: DataFrame, ours: DataFrame, key: str) -> DataFrame:
    """Offers whose key is long enough to tell and not in the catalogue."""
    known = ours.select(F.col(key)).distinct()
    return offers.where(F.length(key) > 5).join(known, key, "left_anti")


def duplicate_verdict(score: Column, known_key: Column) -> Column:
    """DUPLICATE, REVIEW or NEW for a new product: its key is known, or its best score is high."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(known_key | (s >= 95), "DUPLICATE").when(s >= 70, "REVIEW").otherwise("NEW")


def resolve_dictionary(df: DataFrame, column: str, dictionary: DataFrame, fuzzy: float = 75.0) -> DataFrame:
    """Add ``resolved``: the dictionary's value (columns key, value) for an equal key, else for the most similar one at or above
    ``fuzzy``, else null. Only distinct unknown values are scored, against entries that share a word."""
    known = dictionary.groupBy(key_text("key").alias("_k")).agg(F.min("value").alias("value"))
    names = df.select(key_text(column).alias("_n")).distinct()
    exact = names.join(known, names["_n"] == known["_k"]).select("_n", "value")
    rest = names.join(exact, "_n", "left_anti")
    words = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("_w")
    pairs = rest.select("_n", words("_n")).join(known.select("_k", "value", words("_k")), "_w").select("_n", "_k", "value").distinct()
    scored = pairs.withColumn("s", similarity("_n", "_k")).where(F.col("s") >= fuzzy)
    near = scored.groupBy("_n").agg(F.min(F.struct((-F.col("s")).alias("s"), "_k", "value")).alias("b")).select("_n", "b.value")
    found = exact.unionByName(near).withColumnRenamed("value", "resolved")
    return df.join(found, key_text(column) == found["_n"], "left").drop("_n")


def barrier(missing: DataFrame, ours: DataFrame, least: float = 92.0) -> DataFrame:
    """Missing rows (offer_id, sku, features) that are not ours after all: neither by SKU nor by a name as similar as ``least``."""
    known = ours.where(F.coalesce(F.trim("sku"), F.lit("")) != "").select(key_text("sku").alias("_s")).distinct()
    rest = missing.join(known, key_text("sku") == known["_s"], "left_anti")
    near = best_match(rest, ours, least=least)
    return near.where("our_id is null").select(*missing.columns)


def adjudicate(pairs: DataFrame, judge=None, least: float = 82.0) -> DataFrame:
    """(pair columns, verdict) of doubtful pairs (a, b, score): an injected ``judge(a, b) -> bool or None`` on the executors decides each
    distinct pair; where it has no answer, or there is none, the score does."""
    by_score = F.col("score") >= least
    if judge is None:
        return pairs.withColumn("verdict", by_score)

    @pandas_udf("boolean")
    def ask(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([judge(x, y) for x, y in zip(a, b, strict=True)], dtype="object")

    asked = pairs.select("a", "b").distinct().withColumn("_said", ask("a", "b"))
    return pairs.join(asked, ["a", "b"]).withColumn("verdict", F.coalesce("_said", by_score)).drop("_said")


def resolve_ids(df: DataFrame, given: str, name: str, dictionary: DataFrame) -> DataFrame:
    """Add resolved_id: the number in ``given`` unless 0, else the dictionary's id (key, id) of the name, case and spaces ignored, else
    null."""
    number = F.col(given).try_cast("double").cast("long")
    known = dictionary.groupBy(key_text("key").alias("_k")).agg(F.min("id").cast("long").alias("_id"))
    rows = df.join(known, key_text(name) == F.col("_k"), "left")
    return rows.withColumn("resolved_id", F.coalesce(F.when(number != 0, number), "_id")).drop("_k", "_id")


def reverse_match(offers: DataFrame, ours: DataFrame, least: float = 62.0) -> DataFrame:
    """Each offer with the catalogue row whose name is most similar by the weighted ratio, from ``least`` on; offers of a stream's
    batch against the static catalogue. ``offers`` and ``ours`` are ``featured``."""
    return best_match(offers, ours, "weighted", least)


def reanalysed(products: DataFrame, ours: DataFrame, certain: float = 85.0, maybe: float = 70.0) -> DataFrame:
    """``products`` (offer_id, name, old_decision, features) with score, our_id, decision (match, review, missing; invalid without a
    name) and whether it changed."""
    found = best_match(products, ours)
    s = F.coalesce("score", F.lit(0.0))
    decision = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "invalid").when(s >= certain, "match").when(s >= maybe, "review").otherwise("missing")
    return found.withColumn("decision", decision).withColumn("changed", ~F.col("decision").eqNullSafe(F.col("old_decision"))).select(
        *products.columns, s.alias("score"), "our_id", "decision", "changed"
    )
