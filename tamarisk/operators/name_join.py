"""Candidate pairs of names for fuzzy matching, without a flood on words that many names hold.

Two words are near if they are equal, have one skeleton, or become equal when each loses at most one letter; which words of the two
sides are near is settled once, on their vocabularies. Every pair of names of one brand that share a near word is a candidate;
names of different brands never match. Pairs by a word that few of our names hold are rows; those by a word that more than
``RARE`` hold are looked at in blocks inside tasks, where a bound tells which can have the score that is asked for, or be a
name's best. So neither rows nor a task grow with the square of a word's names, and no pair is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import BATCH
from ..functions.text import skeleton
from ..session import written
from .name_search import Index

#: Names of a brand that may hold a word until its pairs are looked at in blocks; names of ours and of theirs in a block.
RARE, PIECE, CHUNK = 128, 4096, 1024
#: Scores are rounded to four decimals: such as differ by no more may tie.
NEAR_TIE = 2e-4
#: Letters that a word must have before one of them may be missing, and letters of a skeleton.
TYPO, SKELETON = 3, 3


def word_forms(word: Column) -> Column:
    """Keys of which near words share one."""
    n, bones = F.length(word), skeleton(word)
    lost = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("d:"), F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("w:"), word)),
            F.when(F.length(bones) >= SKELETON, F.array(F.concat(F.lit("s:"), bones))).otherwise(F.array().cast("array<string>")),
            F.when(n >= TYPO, F.concat(lost, F.array(F.concat(F.lit("d:"), word)))).otherwise(F.array().cast("array<string>")),
        )
    )


def _words(name: str) -> Column:
    return F.filter(F.array_distinct(F.split(name, " ")), lambda w: w != "")


def near_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(u, v): near words of two vocabularies, columns ``u`` and ``v``."""
    a = left.select("u", F.explode(word_forms(F.col("u"))).alias("form"))
    b = right.select("v", F.explode(word_forms(F.col("v"))).alias("form"))
    return a.join(b, "form").select("u", "v").distinct()


def score_bound(a: Column, b: Column) -> Column:
    """What no token set ratio of two names exceeds, from their lengths and common words."""
    x, y = F.split(a, " "), F.split(b, " ")
    common = F.array_intersect(x, y)
    held, m, n = F.length(F.array_join(common, " ")), F.length(a), F.length(b)
    inside = (F.size(common) > 0) & ((F.size(common) == F.size(F.array_distinct(x))) | (F.size(common) == F.size(F.array_distinct(y))))
    whole = F.lit(200.0) * F.least(m, n) / (m + n)
    part = F.when(held > 0, F.lit(200.0) * held / (held + F.least(m, n))).otherwise(0.0)
    return F.when(inside, 100.0).otherwise(F.greatest(whole, part))


class Words(Index):
    """Names as sets of words, with a bound for the token set ratio."""

    def __init__(self, names: list[str]):
        super().__init__([" ".join(sorted(set(x.split()))) for x in names])
        self.number = np.array([len(x.split()) for x in self.names])

    def bounds(self, other: Words) -> np.ndarray:
        """What no token set ratio of a name of ``other`` (rows) with one of these (columns) exceeds: the common words count as
        they are, and the longest common subsequence has no more of a letter than either name."""
        bag = np.zeros((len(other.names), len(self.names)), np.int32)
        mine = self.letters()
        for x, n in other.letters().items():
            if x in mine:
                bag += np.minimum.outer(n, mine[x])
        held, common = np.zeros(bag.shape, np.int32), np.zeros(bag.shape, np.int32)
        for w, rows in other.words.items():
            if w in self.words:
                both = np.ix_(rows, self.words[w])
                held[both] += len(w) + 1
                common[both] += 1
        held -= held > 0
        short, total = np.minimum.outer(other.size, self.size), np.add.outer(other.size, self.size)
        part = 200.0 * held / np.maximum(held + short, 1)
        inside = (common > 0) & (common == np.minimum.outer(other.number, self.number))
        return np.where(inside, 100.0, np.maximum(part, 200.0 * bag / np.maximum(total, 1)))


#: Bounds by kernel; other kernels are bounded by 100.
BOUNDS = {"token_set": Words, "weighted": Index}


def _bounds(ours: list[str], asked: list[str], kernel: str) -> np.ndarray:
    kind = BOUNDS.get(kernel)
    return np.full((len(asked), len(ours)), 100.0) if kind is None else kind(ours).bounds(kind(asked)) + 1e-9


def _best(ours: list[str], ids: list | None, asked: list[str], kernel: str, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of all pairs that an asked name's best score, of ``least`` or more, can be among. Of names of ours that
    score alike the one with the smallest id stands for all, if there are ids."""
    bound, score = _bounds(ours, asked, kernel), BATCH[kernel]
    of = lambda rows, columns: score([asked[i] for i in rows], [ours[i] for i in columns])
    every, first = np.arange(len(asked)), bound.argmax(axis=1)
    floor = np.maximum(of(every, first) - NEAR_TIE, least - NEAR_TIE)
    open_ = bound >= floor[:, None]
    if ids is not None:
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i])), np.int64)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
    out = []
    step = max(1, (1 << 18) // max(1, bound.shape[1]))
    for at in range(0, len(asked), step):
        rows, columns = np.nonzero(open_[at : at + step])
        rows += at
        if not len(rows):
            continue
        got = of(rows, columns)
        top = np.full(len(asked), -np.inf)
        np.maximum.at(top, rows, got)
        good = (got >= top[rows] - NEAR_TIE) & (got >= least - NEAR_TIE)
        rows, columns, got = rows[good], columns[good], got[good]
        if ids is not None and len(rows):
            turn = np.lexsort((place[columns], got, rows))
            rows, columns, got = rows[turn], columns[turn], got[turn]
            new = np.r_[True, (rows[1:] != rows[:-1]) | (got[1:] != got[:-1])]
            rows, columns = rows[new], columns[new]
        out.append((rows, columns))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int))


def _in_blocks(seen: DataFrame, mine: DataFrame, least: float, every: bool, kernel: str) -> DataFrame:
    """Pairs (bare, brand_key, our_bare, our_brand) of ``seen`` and ``mine`` with the same (brand, v): all that may score ``least``,
    or with ``every`` not set those that hold an asked name's best."""
    where = ["brand", "v"]
    parts = lambda df, size, name: df.groupBy(*where).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = written(parts(mine, PIECE, "pieces").join(parts(seen, CHUNK, "chunks"), where))

    def dealt(df: DataFrame, names: list[str], own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*names), F.col(f"{own}s")).cast("int").alias(own)
        return df.join(sizes, where).select(*df.columns, part, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other))

    left = dealt(seen, ["bare", "brand_key"], "chunk", "piece")
    right = dealt(mine, ["our_bare", "our_brand"], "piece", "chunk")
    named = "first_id" in mine.columns

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = columns = np.empty(0, int)
        if a.num_rows and b.num_rows:
            asked, ours = a.column("bare").to_pylist(), b.column("our_bare").to_pylist()
            if every:
                rows, columns = np.nonzero(_bounds(ours, asked, kernel) >= least)
            else:
                ids = b.column("first_id").to_pylist() if named else None
                rows, columns = _best(ours, ids, asked, kernel, least)
        one, two = a.select(["bare", "brand_key"]).take(pa.array(rows)), b.select(["our_bare", "our_brand"]).take(pa.array(columns))
        return pa.table([*one.columns, *two.columns], names=["bare", "brand_key", "our_bare", "our_brand"])

    blocks = [*where, "piece", "chunk"]
    met = left.groupBy(*blocks).cogroup(right.groupBy(*blocks))
    return met.applyInArrow(meet, "bare string, brand_key string, our_bare string, our_brand string")


def candidates(
    offers: DataFrame, ours: DataFrame, least: float = 0.0, rare: int = RARE, every: bool = False, kernel: str = "token_set"
) -> DataFrame:
    """Distinct (bare, brand_key, our_bare, our_brand) that share a near word and may score ``least`` or more by ``kernel``. Of the
    pairs by a word that over ``rare`` of a brand's names hold only those that an asked name's best is among, unless ``every`` is
    asked for.

    Both sides have (bare, brand_key); if ``ours`` has first_id too, of names that score alike the one with the smallest stands for
    all there. Brands that differ drop a pair, a blank one differs from none; names without words have no candidates."""
    left = offers.select("bare", "brand_key").distinct().withColumn("us", _words("bare")).where(F.size("us") > 0)
    named = ["first_id"] if "first_id" in ours.columns else []
    right = ours.select(F.col("bare").alias("our_bare"), F.col("brand_key").alias("our_brand"), *named)
    right = right.groupBy("our_bare", "our_brand").agg(F.min("first_id").alias("first_id")) if named else right.distinct()
    right = right.withColumn("vs", _words("our_bare")).where(F.size("vs") > 0)
    # A brand's names are asked for by the brand, unbranded ones by a blank, all of them by names of no brand.
    asked = F.when(F.col("brand_key") == "", F.array(F.lit("*"))).otherwise(F.array("brand_key", F.lit("")))
    given = F.array(F.col("our_brand"), F.lit("*"))
    near = near_words(left.select(F.explode("us").alias("u")).distinct(), right.select(F.explode("vs").alias("v")).distinct())
    held = right.select("our_bare", "our_brand", *named, F.explode(given).alias("brand"), "vs")
    held = held.select("our_bare", "our_brand", *named, "brand", F.explode("vs").alias("v"))
    spread = held.groupBy("brand", "v").agg(F.count("*").alias("n"))
    seen = left.select("bare", "brand_key", F.explode("us").alias("u")).join(near, "u")
    seen = seen.select("bare", "brand_key", F.explode(asked).alias("brand"), "v").distinct()
    seen, mine = written(seen.join(spread, ["brand", "v"])), written(held.join(spread, ["brand", "v"]))
    few = F.col("n") <= rare
    of = lambda df: (df.where(few).drop("n"), df.where(~few).drop("n"))
    (a, many), (b, wide) = of(seen), of(mine)
    pairs = a.join(b, ["brand", "v"]).select("bare", "brand_key", "our_bare", "our_brand")
    if not many.isEmpty():
        pairs = pairs.unionByName(_in_blocks(many, wide, least, every, kernel))
    pairs = pairs.distinct()
    # The bound is that of token sets.
    return pairs.where(score_bound(F.col("bare"), F.col("our_bare")) >= least) if kernel == "token_set" else pairs
