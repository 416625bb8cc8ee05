"""What each of several filters removes, in every order, from one SQL CUBE over the failure flags and the part.

A document fails or passes each filter whatever ran before. The CUBE over the flags holds, for every subset of filters, the row
in which the flags of the subset are false and the others are summed over: the documents that survive the subset. A step of an
order removes what survives the filters before it and not the step's too, so each step is a join of two subsets.

Documents are read once, into narrow rows of flags and counts; the CUBE sees at most two to the number of flags rows a part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_frequent, materialize

#: Shortest document in words, lowest share of distinct words and highest share of capitals in hundredths, symbols.
WORDS, DISTINCT, CAPITALS, SYMBOLS = 200, 50, 2, "[#$%&*|]"
COUNTS = ("n", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """The failure conditions that look at one text: A short, B repetitive, C capitals, D symbols."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic): one row a document. ``E``: a smaller doc_id has the identical text (by its SHA-256).

    Null text is the empty text, null source the part ``''``; rows without a doc_id never fail E and have no label; rows that
    repeat a doc_id with its text are documents of their own, of which none fails E for the other. A document with several
    labels is good, or toxic, if any says so. An empty table gives no rows; further columns are not read."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("same"),
        *(c.alias(k) for k, c in text_flags(text).items()),
    )
    rows = materialize(rows)
    labelled = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    firsts = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    judged = join_frequent(rows, firsts, "same", "copies", rows.count()).withColumn("E", later)
    marked = judged.join(labelled, "doc_id", "left")
    return marked.select("part", *"ABCDE", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS[1:]))


def survivors(flags: DataFrame, names: str = "ABCDE") -> DataFrame:
    """(part, subset, n, good, toxic) of every part and every subset of the filters ``names``, zeros included: how many
    documents no filter of the subset fails, how many of them are good and toxic. ``subset`` has bit i for names[i].

    ``flags`` has ``part``, a boolean for each name, ``good`` and ``toxic`` (0 or 1)."""
    few = flags.groupBy("part", *names).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    rolled = [F.grouping(x).alias(f"rolled_{x}") for x in names]
    cube = few.cube("part", *names).agg(*(F.sum(c).alias(c) for c in COUNTS), F.grouping("part").alias("no_part"), *rolled)
    passing = F.col("no_part") == 0
    subset = F.lit(0)
    for i, x in enumerate(names):
        passing &= (F.col(f"rolled_{x}") == 1) | ~F.col(x)
        subset += (1 - F.col(f"rolled_{x}").cast("int")) * (1 << i)
    found = cube.where(passing).select("part", subset.alias("subset"), *COUNTS)
    frame = few.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))))
    zeros = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS)
    return frame.join(found, ["part", "subset"], "left").select("part", "subset", *zeros)


def audit(flags: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters and step: (part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley), all counts longs.

    ``redundant`` fail the step's filter and were removed before it, ``unique_fails`` fail it alone, ``shapley`` is what it
    removes summed over all orders. No flags give no rows."""
    spark, every, total = flags.sparkSession, (1 << len(names)) - 1, len(names)
    alive = materialize(survivors(flags, names))
    # Every subset with every filter outside it, and in how many orders that filter comes right behind it.
    pairs = [
        (s, s | 1 << i, i, s | 1 << i == every, factorial(s.bit_count()) * factorial(total - 1 - s.bit_count()))
        for s in range(every + 1)
        for i in range(total)
        if not s >> i & 1
    ]
    pairs = spark.createDataFrame(pairs, "before int, after int, filter int, alone boolean, orders long")
    first = alive.select("part", F.col("subset").alias("before"), *(F.col(c).alias(f"{c}_before") for c in COUNTS))
    second = alive.select("part", F.col("subset").alias("after"), *(F.col(c).alias(f"{c}_after") for c in COUNTS))
    lost = (
        (F.col(f"{c}_before") - F.col(f"{c}_after")).alias(name)
        for c, name in zip(COUNTS, ("removed", "good_lost", "toxic_lost"), strict=True)
    )
    step = first.join(F.broadcast(pairs), "before").join(second, ["part", "after"])
    step = materialize(step.select("part", "before", "filter", "alone", "orders", F.col("n_after").alias("kept"), *lost))
    # With no filter before it a filter removes all that fail it, with all others before it what fails it alone.
    worth = step.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("alone"), F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
    )
    orders = []
    for p in permutations(range(total)):
        for k, i in enumerate(p):
            orders.append(("".join(names[j] for j in p), k + 1, sum(1 << j for j in p[:k]), i))
    steps = spark.createDataFrame(orders, "filter_order string, step int, before int, filter int")
    out = step.drop("alone", "orders").join(worth, ["part", "filter"]).join(F.broadcast(steps), ["before", "filter"])
    redundant = (F.col("fails") - F.col("removed")).alias("redundant")
    counts = ("unique_fails", "good_lost", "toxic_lost", "shapley")
    return out.select("part", "filter_order", "step", "kept", "removed", redundant, *counts)
