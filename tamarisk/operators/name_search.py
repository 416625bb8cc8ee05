"""The most similar names of a brand: an index of letter counts and words bounds every score, names are scored as far as the bound
reaches the n-th best.

Both sides go in as distinct names of a brand. A brand's names are dealt into pieces of the searched side and chunks of the asking
side by their measured numbers, so that no task grows with a brand; every piece gives each name its best n, and the best n of
those are the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import weighteds

#: Names of either side that a task meets, at most.
PIECE, CHUNK = 4096, 1024


class Index:
    """Names with their letter counts and words."""

    def __init__(self, names: Sequence[str]):
        self.names = list(names)
        self.size = np.fromiter(map(len, self.names), np.int64, len(self.names))
        self.counts = [Counter(x) for x in self.names]
        self.words: dict[str, list[int]] = {}
        self.repeats = np.zeros(len(self.names), bool)
        for i, x in enumerate(self.names):
            words = x.split()
            self.repeats[i] = len(set(words)) < len(words)
            for w in set(words):
                self.words.setdefault(w, []).append(i)

    def letters(self) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for i, c in enumerate(self.counts):
            for x, n in c.items():
                if x not in out:
                    out[x] = np.zeros(len(self.names), np.uint16)
                out[x][i] = min(n, 65535)
        return out

    def bounds(self, other: Index) -> np.ndarray:
        """What no weighted ratio of a name of ``other`` (rows) with one of these (columns) exceeds. A common subsequence has no
        more of a letter than either name; token sets reach their most only by a common word."""
        bag = np.zeros((len(other.names), len(self.names)), np.int64)
        mine = self.letters()
        for x, n in other.letters().items():
            if x in mine:
                bag += np.minimum.outer(n, mine[x])
        long, short = np.maximum.outer(other.size, self.size), np.minimum.outer(other.size, self.size)
        ratio = 200.0 * bag / np.maximum(long + short, 1)
        free = np.logical_or.outer(other.repeats, self.repeats)
        for w, rows in other.words.items():
            if w in self.words:
                free[np.ix_(rows, self.words[w])] = True
        near = np.maximum(ratio, np.where(free, 95.0, 0.0))
        scale = np.where(long <= 8 * short, 0.9, 0.6)
        far = np.maximum(ratio, scale * 200.0 * bag / np.maximum(short + bag, 1))
        return np.where(short > 0, np.where(2 * long < 3 * short, near, far), 0.0)

    def best(self, other: Index, n: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(rows, columns, scores) of all names that a name's ``n`` best can be among, at ``least`` or more, and how many pairs
        were scored: first those with the ``n`` highest bounds, then what can still reach the n-th of them."""
        bound = self.bounds(other) + 1e-9
        k = min(n, bound.shape[1])
        first = np.argpartition(-bound, k - 1, axis=1)[:, :k]
        rows = np.repeat(np.arange(len(other.names)), k)
        score = self._score(other, rows, first.ravel()).reshape(-1, k)
        floor = np.full(len(score), least) if k < n else np.maximum(score.min(axis=1), least)
        open_ = bound >= floor[:, None]
        np.put_along_axis(open_, first, False, axis=1)
        more = np.nonzero(open_)
        rows, columns = np.concatenate((rows, more[0])), np.concatenate((first.ravel(), more[1]))
        score = np.concatenate((score.ravel(), self._score(other, *more)))
        good = score >= floor[rows]
        return rows[good], columns[good], score[good], len(rows)

    def _score(self, other: Index, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return weighteds([other.names[i] for i in rows], [self.names[i] for i in columns])


def most_similar(asking: DataFrame, ours: DataFrame, n: int, least: float = 40.0, piece: int = PIECE, chunk: int = CHUNK) -> DataFrame:
    """(brand_key, name, our_name, first_id, score): for each name of ``asking`` (brand_key, name) the ``n`` names of ``ours``
    (brand_key, our_name, first_id, all distinct) of the same brand with the highest weighted ratio, of ``least`` or more, ties to
    the smaller first_id."""
    sizes = ours.groupBy("brand_key").agg(F.count("*").alias("held")).join(asking.groupBy("brand_key").agg(F.count("*").alias("asked")), "brand_key")
    parts = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    sizes = sizes.select("brand_key", parts("held", piece).alias("pieces"), parts("asked", chunk).alias("chunks"))

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        mine: Column = F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int").alias(own)
        each = F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other)
        return df.join(sizes, "brand_key").select(*df.columns, mine, each)

    where = ["brand_key", "piece", "chunk"]
    left, right = dealt(asking, "name", "chunk", "piece"), dealt(ours, "our_name", "piece", "chunk")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ("brand_key", "name", "our_name", "first_id", "score")
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64())
        columns: list = [[]] * len(names)
        if a.num_rows and b.num_rows:
            theirs, mine, ids = Index(a.column("name").to_pylist()), Index(b.column("our_name").to_pylist()), b.column("first_id").to_pylist()
            rows, at, score, _ = mine.best(theirs, n, least)
            brand = a.column("brand_key")[0].as_py()
            columns = [[brand] * len(rows), [theirs.names[i] for i in rows], [mine.names[i] for i in at], [ids[i] for i in at], score.tolist()]
        return pa.table({k: pa.array(c, t) for k, c, t in zip(names, columns, kinds, strict=True)})

    schema = "brand_key string, name string, our_name string, first_id long, score double"
    found = left.groupBy(*where).cogroup(right.groupBy(*where)).applyInArrow(search, schema)
    order = Window.partitionBy("brand_key", "name").orderBy(F.desc("score"), "first_id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")
