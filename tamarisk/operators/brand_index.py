"""Brands of names from a table of brands: contained literally, or repaired by an index of letter pairs.

Literal brands are found by the automaton of ``functions.synonyms`` in one pass over each distinct name. For the rest, runs of
words meet only brands that share one of the first letter pairs of both, in one fixed order: for a ratio of ``least`` so many
pairs must agree that two texts without one among their first ones cannot reach it. So nothing is lost, and no run meets all brands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import similarity
from ..functions.synonyms import contained
from ..functions.text import fold_letters, normalize

#: Words of a run, and letters that it must have.
LONGEST, LETTERS = 3, 4


def _letter_pairs(text: Column) -> Column:
    """Letter pairs of a text with a mark at each end, repeats numbered: as many as letters, and one."""
    marked = F.concat(F.lit("\x02"), text, F.lit("\x03"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(marked, i, F.lit(2)))
    numbered = lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.size(F.filter(F.slice(pairs, 1, i), lambda y: y == x)).alias("k"))
    return F.transform(pairs, numbered)


def first_pairs(text: Column, least: float) -> Column:
    """The letter pairs of which two texts alike by ``least`` share one. Of a text's pairs, a letter of its own that the other lacks
    takes two and a letter that the other has besides takes one; the other text has at least least / (200 - least) of its letters."""
    t = least / 100
    share = (1.5 * t - 1) * (1 + t / (2 - t))
    needed = F.greatest(F.lit(1), F.ceil(share * F.length(text) + 1 - 1e-9).cast("int"))
    return F.slice(F.array_sort(_letter_pairs(text)), 1, F.greatest(F.lit(1), F.length(text) + 2 - needed))


def word_runs(name: Column, tried: int) -> Column:
    """The first ``tried`` runs of three, two and one words with enough letters, by the place they begin at, the longer first."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    n = F.size(words)
    at = lambda i: F.transform(
        F.filter(F.sequence(F.lit(LONGEST), F.lit(1), F.lit(-1)), lambda k: i + k - 1 <= n), lambda k: F.array_join(F.slice(words, i, k), " ")
    )
    every = F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), n), at))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.filter(every, lambda x: F.length(x) >= LETTERS), 1, tried)


def with_brand(df: DataFrame, name: str, brands: DataFrame, least: float = 85.0, tried: int = 12, to: str = "found_brand") -> DataFrame:
    """``df`` with column ``to``: the first of ``brands`` (ordinal, brand) that the name contains, else the brand most like the first
    of its word runs that has one of ``least`` or more, the first of equals; empty without any. Names are looked at once."""
    known = brands.where("brand is not null and trim(brand) <> ''").groupBy("brand").agg(F.min("ordinal").alias("ordinal"))
    known = known.withColumn("low", F.lower("brand"))
    names = df.select(F.col(name).alias("_n")).distinct().where("_n is not null")
    own = F.concat_ws("\x01", F.lower("_n"), normalize("_n"))
    terms = known.select("ordinal", F.explode(F.array_distinct(F.array("low", fold_letters("low")))).alias("term"))
    terms = terms.groupBy("term").agg(F.min("ordinal").alias("ordinal"))
    first = names.select("_n", F.array_min(contained(own, terms, "term", "ordinal")).alias("ordinal"))
    literal = first.where("ordinal is not null").join(known.select("ordinal", "brand"), "ordinal").select("_n", "brand")
    runs = first.where("ordinal is null").select("_n", F.posexplode(word_runs(F.lower("_n"), tried)).alias("place", "run"))
    some = runs.select("run").distinct().select("run", F.explode(first_pairs(F.col("run"), least)).alias("pair"))
    index = known.select("low", F.explode(first_pairs(F.col("low"), least)).alias("pair"))
    m, n = F.length("run"), F.length("low")
    fits = F.lit(200.0) * F.least(m, n) >= least * (m + n)
    pairs = some.join(index, "pair").where(fits).select("run", "low").distinct()
    scored = pairs.withColumn("score", similarity("run", "low", "ratio")).where(F.col("score") >= least)
    best = scored.join(known, "low").groupBy("run").agg(F.min(F.struct((-F.col("score")).alias("s"), "ordinal", "brand")).alias("b"))
    repaired = runs.join(best, "run").groupBy("_n").agg(F.min(F.struct("place", "b.brand")).alias("r")).select("_n", "r.brand")
    found = literal.unionByName(repaired).withColumnRenamed("brand", "_b")
    return df.join(found, F.col(name) == F.col("_n"), "left").withColumn(to, F.coalesce("_b", F.lit(""))).drop("_n", "_b")
