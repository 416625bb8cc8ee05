"""Packing token pieces into fixed-length sequences as a cutting-stock problem.

Documents are tokenised; full sequences are cut off long ones, and what is left is an item of 1 to ``limit`` tokens. The
histogram of lengths in units of ``grain`` tokens (a few hundred numbers, whatever the input) is all that the linear
program needs: its columns are patterns of lengths that fit in a sequence, and a knapsack dynamic program prices new ones
until none improves. The rounded patterns are dealt to documents by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import ChunkCache
from .common import materialize, slices, worker_cache

LIMIT = 1024
#: Tokens of a unit of length: patterns leave up to this less one of padding for each piece.
GRAIN = 8
#: Column generation ends when the bound by the priced column is within this share of the optimum.
GAP = 2e-3
#: Chunks that a Python worker remembers.
CACHE = 600_000


class WordTokenizer:
    """Ids by the `tokenizers` library, as little-endian unsigned 32-bit numbers; chunks met before aren't encoded again."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        # A token's string has one character for each of its bytes.
        self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])
        self._chunks = ChunkCache(self._learn, lambda text: self._ids(text).tobytes(), cache)
        self.encode_all = self._chunks.encode_all

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        found = {}
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            text = " " + " ".join(part)
            ids = self._ids(text)
            size = map(len, part) if text.isascii() else (len(x.encode()) for x in part)
            ends = np.cumsum(np.fromiter(size, np.int64, len(part)) + 1)
            cut = (4 * (np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1)).tolist()
            raw = ids.tobytes()
            found.update(zip(part, [raw[i:j] for i, j in zip([0, *cut], cut, strict=False)], strict=True))
        return found

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text]))).tobytes()


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = LIMIT,
    end_id: int = 0,
    grain: int = GRAIN,
    digest: bool = False,
    cache: int = CACHE,
) -> DataFrame:
    """(doc_id, start, length, ids binary, doc_tokens, units, task, nth): every document's ids and the end id, cut after
    every ``limit`` ids. ``units`` is the length in grains, rounded up; ``nth`` counts a task's earlier pieces with as
    many. With ``digest``, ids_crc32 long (of the ids as little-endian unsigned 32-bit numbers) is in place of the ids.

    Null text is empty and gives the end id alone; repeated rows stay; an empty table gives no rows; no column but doc_id and
    text is read."""
    name, kind = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())
    own = "ids_crc32 long" if digest else "ids binary"
    schema = f"doc_id long, start long, length long, {own}, doc_tokens long, units int, task int, nth long"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_cache(tokenizer_path, lambda: WordTokenizer(tokenizer_path, cache))
        task = TaskContext.get().partitionId()
        seen = [0] * (-(-limit // grain) + 1)
        for b in slices(batches, 2048, tokenizer_path):
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), tok.encode_all(b.column("text")), strict=True):
                raw = ids.tobytes() + end
                total = len(raw) // 4
                for start in range(0, total, limit):
                    part = raw[4 * start : 4 * (start + limit)]
                    units = -(-len(part) // (4 * grain))
                    own = zlib.crc32(part) if digest else part
                    rows.append((doc, start, len(part) // 4, own, total, units, task, seen[units]))
                    seen[units] += 1
            kinds = (*(pa.int64(),) * 3, kind, pa.int64(), pa.int32(), pa.int32(), pa.int64())
            names = ["doc_id", "start", "length", name, "doc_tokens", "units", "task", "nth"]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def price(values: np.ndarray, lengths: np.ndarray, limit: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of lengths that fits in ``limit``, as counts."""
    best, took = np.zeros(limit + 1), np.full(limit + 1, -1)
    for room in range(1, limit + 1):
        best[room] = best[room - 1]
        n = int(np.searchsorted(lengths, room, "right"))
        if n:
            got = best[room - lengths[:n]] + values[:n]
            k = int(got.argmax())
            if got[k] > best[room] + 1e-12:
                best[room], took[room] = got[k], k
    count, room = np.zeros(len(lengths), np.int64), limit
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            count[took[room]] += 1
            room -= int(lengths[took[room]])
    return float(best[limit]), count


def greedy(lengths: np.ndarray, left: np.ndarray, limit: int) -> list[np.ndarray]:
    """Patterns filled with the longest lengths that are left and fit, each used as often as it goes."""
    found, left = [], left.copy()
    while left.any():
        count, room = np.zeros(len(lengths), np.int64), limit
        for k in range(len(lengths) - 1, -1, -1):
            if left[k] and lengths[k] <= room:
                count[k] = min(left[k], room // lengths[k])
                room -= int(count[k] * lengths[k])
        has = count > 0
        left -= count * int((left[has] // count[has]).min())
        found.append(count)
    return found


def solve(histogram: dict[int, int], limit: int = LIMIT, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> pieces of it) and how many sequences use each; together they hold every piece once.

    The linear program covers the counts by column generation with the revised simplex method: first columns that fill
    sequences greedily, then those that the knapsack prices best. Uses are rounded down, and never beyond what is left, so
    that rounding errors of the pivots cannot make a plan wrong; what remains, a few thousand pieces at most whatever the
    counts, is packed first fit,
    longest first.
    """
    lengths = np.array(sorted(x for x, c in histogram.items() if c > 0 and 0 < x <= limit))
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], float)
    m = len(lengths)
    patterns = [np.zeros(m, np.int64) for _ in range(m)]
    for i, x in enumerate(lengths):
        patterns[i][i] = limit // x
    inverse = np.diag(1.0 / np.array([limit // x for x in lengths]))
    used = inverse @ counts
    pool = np.array(greedy(lengths, counts.astype(np.int64), limit), float)
    for _ in range(12 * m):
        prices = inverse.sum(0)
        worths = pool @ prices
        k = int(worths.argmax())
        column = pool[k]
        if worths[k] <= 1 + gap:
            worth, column = price(np.maximum(prices, 0), lengths, limit)
            if worth <= 1 + gap:
                break
        way = inverse @ column
        able = way > 1e-9
        ratio = np.where(able, used / np.where(able, way, 1), np.inf)
        out = int(ratio.argmin())
        move = max(0.0, ratio[out])
        used -= move * way
        used[out] = move
        patterns[out] = column.astype(np.int64)
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
    left = counts.astype(np.int64)
    plan: list[tuple[dict[int, int], int]] = []
    for i in np.argsort(-used):
        p = patterns[i]
        has = p > 0
        n = int(min(np.floor(used[i] + 1e-6), (left[has] // p[has]).min())) if has.any() else 0
        if n > 0:
            plan.append(({int(lengths[k]): int(p[k]) for k in np.flatnonzero(p)}, n))
            left -= n * p
    opened: list[dict[int, int]] = []
    room = np.empty(0, np.int64)
    for k in range(m - 1, -1, -1):
        x = int(lengths[k])
        n = int(left[k])
        for at in np.flatnonzero(room >= x):
            if not n:
                break
            put = min(n, int(room[at]) // x)
            opened[at][x] = opened[at].get(x, 0) + put
            room[at] -= put * x
            n -= put
        while n:
            put = min(n, limit // x)
            whole = n // put
            if whole > 1:
                # Alike sequences with no room for more of this length are one entry; smaller ones may still fit.
                plan_room = limit - put * x
                if plan_room == 0:
                    plan.append(({x: put}, whole))
                    n -= whole * put
                    continue
            opened.append({x: put})
            room = np.r_[room, limit - put * x]
            n -= put
    plan += [(p, 1) for p in opened]
    return plan


def assign(parts: DataFrame, limit: int = LIMIT, grain: int = GRAIN, gap: float = GAP) -> DataFrame:
    """Add sequence_id and offset to a table with (length, units, task, nth), such as ``pieces`` gives; other columns stay.

    Only the histogram of units goes to the driver, and the plan goes back: both bounded by ``limit / grain``. A piece's
    rank within its units is its task's start plus ``nth``; the starts are a running sum over tasks.
    """
    spark = parts.sparkSession
    by_task = materialize(parts.groupBy("units", "task").count())
    histogram = {r[0]: r[1] for r in by_task.groupBy("units").agg(F.sum("count")).collect()}
    slots: dict[int, list[tuple[int, int, int, int]]] = {x: [] for x in histogram}
    served, first = dict.fromkeys(histogram, 0), 0
    for pattern, n in solve(histogram, limit // grain, gap):
        place = 0
        for x, k in sorted(pattern.items(), reverse=True):
            slots[x].append((served[x], k, first, place))
            served[x] += n * k
            place += k
        first += n
    plan = spark.sparkContext.broadcast({x: tuple(np.array(own, np.int64).T) for x, own in slots.items()})
    before = Window.partitionBy("units").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("units", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = parts.join(starts, ["units", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    ranked = ranked.drop("before", "task", "nth")
    names = [c for c in ranked.columns if c not in ("units", "rank")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units, rank = b.column("units").to_numpy(), b.column("rank").to_numpy()
            sequence, place = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(units):
                i = np.flatnonzero(units == x)
                served_from, per, seq, at = plan.value[int(x)]
                k = np.searchsorted(served_from, rank[i], "right") - 1
                within = rank[i] - served_from[k]
                sequence[i] = seq[k] + within // per[k]
                place[i] = at[k] + within % per[k]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(sequence), pa.array(place)], [*names, "sequence_id", "place"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name in names)
    placed = ranked.mapInArrow(run, f"{fields}, sequence_id long, place long")
    # A sequence has ``limit`` pieces at most.
    inside = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("place")


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = 0, grain: int = GRAIN) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every piece, tokens included."""
    return assign(materialize(pieces(docs, tokenizer_path, limit, end_id, grain)), limit, grain)


def pack_digests(
    docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = 0, grain: int = GRAIN, cache: int = CACHE
) -> DataFrame:
    """As ``pack``, with ids_crc32 (CRC-32 of the little-endian unsigned 32-bit ids) in place of the ids, so that
    only narrow rows are written and joined."""
    return assign(materialize(pieces(docs, tokenizer_path, limit, end_id, grain, True, cache)), limit, grain)
