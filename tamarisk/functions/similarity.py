"""String similarity from 0 to 100 by public definitions, as vectorised functions over pairs.

``ratio`` is 200 * LCS / (sum of lengths) with LCS the longest common subsequence. Score distinct pairs only, after blocking.

Each kernel stands here twice: as a plain function of two texts, and over arrays of pairs (``BATCH``), which ``similarity`` uses:
there the pairs of a batch go through the bit-parallel recurrence together, one 64-bit word a pair, a character at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .text import Name, column


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of many bits at a time."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for ch in b:
        hit = rows & where.get(ch, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - rows.bit_count()


@lru_cache(100_000)
def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * _common(a, b) / total if total else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Best ratio among the common words and each side's words: 100 if one side's words are all common."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left = " ".join(filter(None, (both, " ".join(sorted(x - y)))))
    right = " ".join(filter(None, (both, " ".join(sorted(y - x)))))
    return max(ratio(left, right), *((ratio(both, left), ratio(both, right)) if both else (0.0,)))


@lru_cache(100_000)
def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of its length, cut short at the ends, in the longer one."""
    short, long = sorted((a, b), key=lambda x: (len(x), x))
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    windows = (long[max(0, i) : i + n] for i in range(1 - n, len(long)))
    return max(ratio(short, w) for w in windows)


def weighted(a: str, b: str) -> float:
    """Ratio, or token and partial ratios scaled by how different the lengths are; the greatest."""
    if not a or not b:
        return 0.0
    times = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if times < 1.5:
        return max(best, 0.95 * token_sort(a, b), 0.95 * token_set(a, b))
    scale = 0.9 if times <= 8 else 0.6
    inner = partial(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return max(best, scale * partial(a, b), 0.95 * scale * inner)


#: The weights of the matcher's base score, and of the kernels in the score of a challenge.
BLEND = {"token_sort": 0.3, "token_set": 0.5, "partial": 0.2}
NAMES = {"ratio": 1.0, "partial": 0.9, "token_sort": 0.95, "token_set": 0.95}


def blended(a: str, b: str) -> float:
    """The matcher's base score: a weighted sum of token sort, token set and partial."""
    return BLEND["token_sort"] * token_sort(a, b) + BLEND["token_set"] * token_set(a, b) + BLEND["partial"] * partial(a, b)


def score_names(a: str, b: str) -> float:
    """The greatest of the weighted ratios in ``NAMES``, two decimals; 0 if a text is empty."""
    if not a or not b:
        return 0.0
    return round(max(ratio(a, b), *(NAMES[f.__name__] * f(a, b) for f in (partial, token_sort, token_set))), 2)


KERNELS = {f.__name__: f for f in (ratio, token_sort, token_set, partial, weighted, blended, score_names)}

Texts = Sequence[str]
#: Characters that no text has, behind the shorter texts of a batch; rows of windows that are compared at once.
_PAD_A, _PAD_B, _ROWS = 0x110000, 0x110001, 1 << 16


def _codes(texts: Texts, width: int, pad: int) -> np.ndarray:
    """Code points, one row a text, padded to ``width``."""
    out = np.array(texts, dtype=f"U{max(width, 1)}").view(np.uint32).reshape(len(texts), -1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.where(np.arange(out.shape[1]) < sizes[:, None], out, np.uint32(pad))


def _lcs_words(a: np.ndarray, b: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Row by row; ``a`` has at most 64 columns, the rows of ``b`` have ``long`` characters each, the longest first."""
    state = np.full(len(a), ~np.uint64(0))
    same = np.zeros((len(a), 64), bool)
    left = np.searchsorted(-long, -np.arange(b.shape[1]), side="left")
    for j, n in enumerate(left.tolist()):
        np.equal(a[:n], b[:n, j, None], out=same[:n, : a.shape[1]])
        now = state[:n]
        hit = now & np.packbits(same[:n], axis=1, bitorder="little").view("<u8")[:, 0]
        np.bitwise_or(now + hit, now - hit, out=now)
    return 64 - np.bitwise_count(state).astype(np.int64)


def lcs(a: Texts, b: Texts) -> np.ndarray:
    """Length of the longest common subsequence of each pair, a batch at a time, the longer text character by character; where
    both texts have more than 64 characters, pair by pair."""
    out = np.zeros(len(a), np.int64)
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    short, long = (np.fromiter((len(p[i]) for p in pairs), np.int64, len(pairs)) for i in (0, 1))
    for i in np.flatnonzero(short > 64):
        out[i] = _common(*pairs[i])
    order = np.flatnonzero((short <= 64) & (short > 0))
    order = order[np.argsort(-long[order], kind="stable")]
    for at in range(0, len(order), 8192):
        part = order[at : at + 8192]
        x, y = ([pairs[i][k] for i in part] for k in (0, 1))
        out[part] = _lcs_words(_codes(x, short[part].max(), _PAD_A), _codes(y, long[part[0]], _PAD_B), long[part])
    return out


def _lengths(texts: Texts) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _scaled(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)


def ratios(a: Texts, b: Texts) -> np.ndarray:
    return _scaled(lcs(a, b), _lengths(a) + _lengths(b))


def _sorted_words(texts: Texts) -> list[str]:
    known = {t: " ".join(sorted(t.split())) for t in set(texts)}
    return [known[t] for t in texts]


def token_sorts(a: Texts, b: Texts) -> np.ndarray:
    return ratios(_sorted_words(a), _sorted_words(b))


def token_sets(a: Texts, b: Texts) -> np.ndarray:
    """The common words begin both sides, so their ratio with a side follows from lengths; only the sides are compared."""
    words = {t: frozenset(t.split()) for t in {*a, *b}}
    out, todo, left, right = np.zeros(len(a)), [], [], []
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x, y = words[p], words[q]
        if not x or not y:
            continue
        both = x & y
        if both and (both == x or both == y):
            out[i] = 100.0
            continue
        head = " ".join(sorted(both))
        left.append(" ".join(filter(None, (head, " ".join(sorted(x - y))))))
        right.append(" ".join(filter(None, (head, " ".join(sorted(y - x))))))
        todo.append(i)
        if head:
            out[i] = max(200.0 * len(head) / (len(head) + len(side)) for side in (left[-1], right[-1]))
    if todo:
        out[todo] = np.maximum(out[todo], ratios(left, right))
    return out


def _window_parts(order: np.ndarray, short: np.ndarray, long: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs with shorter texts of one length, as many as give ``_ROWS`` windows."""
    for n in np.unique(short[order]):
        mine = order[short[order] == n]
        step = max(1, _ROWS // int(n + long[mine].max()))
        yield from (mine[at : at + step] for at in range(0, len(mine), step))


def partials(a: Texts, b: Texts) -> np.ndarray:
    """All windows of all pairs of a part are rows of one array, cut from the longer texts by strides."""
    pairs = [(x, y) if (len(x), x) <= (len(y), y) else (y, x) for x, y in zip(a, b, strict=True)]
    short, long = (np.fromiter((len(p[i]) for p in pairs), np.int64, len(pairs)) for i in (0, 1))
    out = np.where(long == 0, 100.0, 0.0)
    for i in np.flatnonzero(short > 64):
        out[i] = partial(*pairs[i])
    order = np.flatnonzero((short > 0) & (short <= 64))
    for part in _window_parts(order, short, long):
        n, most = int(short[part[0]]), int(long[part].max())
        x = _codes([pairs[i][0] for i in part], n, _PAD_A)
        edge = np.full((len(part), n - 1), _PAD_B, np.uint32)
        y = np.hstack((edge, _codes([pairs[i][1] for i in part], most, _PAD_B), edge))
        windows = np.lib.stride_tricks.sliding_window_view(y, n, axis=1)
        count = windows.shape[1]
        whole = np.full(len(part) * count, n)
        common = _lcs_words(np.repeat(x, count, axis=0), windows.reshape(-1, n), whole).reshape(-1, count)
        start, own = np.arange(count) - (n - 1), long[part][:, None]
        size = np.minimum(start + n, own) - np.maximum(start, 0)
        out[part] = np.where(start < own, 200.0 * common / np.maximum(n + size, 1), 0.0).max(axis=1)
    return out


def weighteds(a: Texts, b: Texts) -> np.ndarray:
    m, n = _lengths(a), _lengths(b)
    times = np.maximum(m, n) / np.maximum(np.minimum(m, n), 1)
    out = np.where((m > 0) & (n > 0), ratios(a, b), 0.0)
    for near in (True, False):
        rows = np.flatnonzero((m > 0) & (n > 0) & ((times < 1.5) == near))
        x, y = [a[i] for i in rows], [b[i] for i in rows]
        if near:
            other = np.maximum(0.95 * token_sorts(x, y), 0.95 * token_sets(x, y))
        else:
            scale = np.where(times[rows] <= 8, 0.9, 0.6)
            other = np.maximum(scale * partials(x, y), 0.95 * scale * partials(_sorted_words(x), _sorted_words(y)))
        out[rows] = np.maximum(out[rows], other)
    return out


def blendeds(a: Texts, b: Texts) -> np.ndarray:
    return BLEND["token_sort"] * token_sorts(a, b) + BLEND["token_set"] * token_sets(a, b) + BLEND["partial"] * partials(a, b)


def scores_of_names(a: Texts, b: Texts) -> np.ndarray:
    """Kernels whose greatest possible value is below what is reached already are left out."""
    best = np.maximum(ratios(a, b), np.maximum(NAMES["token_sort"] * token_sorts(a, b), NAMES["token_set"] * token_sets(a, b)))
    rows = np.flatnonzero(best < 100.0 * NAMES["partial"])
    best[rows] = np.maximum(best[rows], NAMES["partial"] * partials([a[i] for i in rows], [b[i] for i in rows]))
    best = np.array([round(x, 2) for x in best.tolist()])
    return np.where((_lengths(a) > 0) & (_lengths(b) > 0), best, 0.0)


BATCH: dict[str, Callable[[Texts, Texts], np.ndarray]] = {
    "ratio": ratios,
    "token_sort": token_sorts,
    "token_set": token_sets,
    "partial": partials,
    "weighted": weighteds,
    "blended": blendeds,
    "score_names": scores_of_names,
}


def similarity(a: Name, b: Name, kernel: str = "token_set") -> Column:
    """A kernel over two columns; null counts as empty."""
    score = BATCH[kernel]

    @pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(score(x.fillna("").tolist(), y.fillna("").tolist()), dtype="float64")

    return run(column(a), column(b))


def jaccard(a: Name, b: Name) -> Column:
    """Share of common words of two texts, in percent; stays in the JVM."""
    x, y = (F.array_distinct(F.split(column(c), " ")) for c in (a, b))
    return 100.0 * F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
