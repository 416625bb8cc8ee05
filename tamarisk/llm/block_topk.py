"""Exact top-k search by inner product, block at a time.

Candidates are ordered by the sides of random cuts they lie on, so that alike ones stand together, and cut into blocks, each a
packed forward index. A block's scores for a query are bounded by the sum over dimensions of the larger product with either
bound of the block, and by the product with its centre plus that of the lengths of the query and the block's radius. Blocks
are taken in the order of their bounds, scored from their forward index, and left out from the first bound on that is below
the k-th score. Queries go in chunks that are ordered alike; a block that no query of a chunk can need isn't sent there.

How much is left out depends on the data: of tight groups nearly all, of directions spread evenly over many dimensions nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

#: Candidates of a block, blocks that a task scores at once, and queries of a chunk.
BLOCK, GROUP, CHUNK = 64, 512, 2048
#: Candidates whose scores give every query a first lower bound.
SEEDS = 2048
#: Cuts that order the rows.
CUTS = 24
#: Chunks whose bounds are broadcast, at most; with more, every block goes to every chunk.
CHUNKS_BOUND = 8192


def quantize(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of every component; null vectors or ones with null or non-finite
    components are left out, as are null ids."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & finite & F.col("vec_id").isNotNull())
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten(), np.int64).reshape(-1, dim)


class Blocks:
    """Several blocks of candidates with their bounds."""

    def __init__(self, ids: list[np.ndarray], rows: list[np.ndarray]):
        self.ids, self.x = np.concatenate(ids), np.concatenate(rows)
        size = np.array([len(x) for x in ids])
        self.start, self.end = np.cumsum(size) - size, np.cumsum(size)
        self.low = np.minimum.reduceat(self.x, self.start, axis=0)
        self.high = np.maximum.reduceat(self.x, self.start, axis=0)
        self.peak = np.abs(self.x.astype(float)).max(initial=0)
        whole = self.x.astype(float)
        self.centre = np.add.reduceat(whole, self.start, axis=0) / size[:, None]
        away = np.linalg.norm(whole - np.repeat(self.centre, size, axis=0), axis=1)
        self.radius = np.maximum.reduceat(away, self.start)
        #: (query, block) pairs, and those that were scored.
        self.pairs = self.scored = 0

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """What no score of a block exceeds, for rows of queries: doubles where they are exact enough, else 64-bit integers."""
        if self.peak * np.abs(q.astype(float)).max(initial=0) * q.shape[1] >= 2**52:
            return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        q = q.astype(float)
        box = np.maximum(q, 0) @ self.high.T.astype(float) + np.minimum(q, 0) @ self.low.T.astype(float)
        length = np.linalg.norm(q, axis=1)[:, None]
        middle = q @ self.centre.T
        # A little more than rounding can take away.
        ball = middle + length * self.radius + 1 + 1e-9 * length * (np.linalg.norm(self.centre, axis=1) + self.radius)
        return np.minimum(box, np.ceil(ball))

    def search(self, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(query, candidate, score) of the best ``k`` for each query, as far as they reach its ``floor``."""
        bound = self.bounds(q)
        x, q = self.x.astype(bound.dtype), q.astype(bound.dtype)
        order = np.argsort(-bound, axis=1, kind="stable")
        self.pairs += bound.size
        for n, own in enumerate(query_ids):
            best: list[tuple[int, int]] = []
            least, blocks, at, step = floor[n], order[n], 0, 4
            while at < len(blocks):
                part = blocks[at : at + step]
                part = part[bound[n, part] >= least]
                if not len(part):
                    break
                self.scored += len(part)
                at, step = at + step, 2 * step
                rows = np.concatenate([np.arange(self.start[b], self.end[b]) for b in part.tolist()])
                score = x[rows] @ q[n]
                ids = self.ids[rows]
                good = np.flatnonzero((score >= least) & (ids != own))
                if len(good):
                    # A tie goes to the smaller id; of what is good, only the best k can stay.
                    top = good[np.lexsort((ids[good], -score[good]))[:k]]
                    best = sorted(best + [(-int(score[i]), int(ids[i])) for i in top])[:k]
                    if len(best) == k:
                        least = max(least, -best[-1][0])
            for score, other in best:
                yield own, other, -score


def _floors(ids: np.ndarray, q: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of every query among the seeds: what its results reach at least."""
    floor = np.full(len(ids), np.iinfo(np.int64).min)
    if len(seeds) > k and np.abs(seeds.astype(float)).max() * np.abs(q.astype(float)).max(initial=0) * q.shape[1] < 2**52:
        score = q.astype(float) @ seeds.T.astype(float)
        score[ids[:, None] == seed_ids] = -np.inf
        floor = np.partition(score, -k, axis=1)[:, -k].astype(np.int64)
    return floor


def top_k(rows: DataFrame, is_query, k: int = 5, group: int = GROUP, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the highest inner product for each query row.

    ``rows`` has (vec_id, v array<long>); ``is_query`` is a condition on its columns. A query's own id is no candidate;
    ties go to the smaller vec_id. Rows of another length than most take no part; of rows that repeat a vec_id with other
    values, the smallest counts. Scores must fit in 64 bits. An empty table, or one without queries, gives no rows.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    width = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if width is None or width.dim == 0:
        return spark.createDataFrame([], schema)
    dim = width.dim
    rows = materialize(rows.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v")))
    total, wanted = rows.count(), rows.where(is_query).count()
    if not wanted:
        return spark.createDataFrame([], schema)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).toArrow()
    seed_ids, seed = some.column("vec_id").to_numpy(), _matrix(some.column("v"), dim)
    cuts = np.random.default_rng(5).standard_normal((dim, CUTS))
    middle = np.median(seed @ cuts, axis=0)
    fixed = spark.sparkContext.broadcast((seed_ids, seed, cuts, middle))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, cuts, middle = fixed.value
        for b in slices(batches, 4096):
            side = _matrix(b.column("v"), dim).astype(float) @ cuts >= middle
            code = side @ (1 << np.arange(CUTS)[::-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.astype(np.int64))], [*b.schema.names, "code"])

    placed = rows.mapInArrow(place, "vec_id long, v array<long>, code long")
    # Queries in chunks of alike ones, each with its first lower bound.
    chunks = -(-wanted // chunk)
    asked = placed.where(is_query).repartitionByRange(chunks, "code", "vec_id")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seeds, _, _ = fixed.value
        mine = TaskContext.get().partitionId()
        for b in slices(batches, 1024):
            own, q = b.column("vec_id"), _matrix(b.column("v"), dim)
            floor = _floors(own.to_numpy(), q, ids, seeds, k)
            columns = [pa.array(np.full(len(q), mine, np.int32)), own, b.column("v"), pa.array(floor)]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "vec_id", "v", "floor"])

    queries = materialize(asked.mapInArrow(ask, "chunk int, vec_id long, v array<long>, floor long"))

    def sum_up(t: pa.Table) -> pa.Table:
        q = _matrix(t.column("v"), dim).astype(float)
        centre = q.mean(0)
        radius = np.linalg.norm(q - centre, axis=1).max()
        low = int(t.column("floor").to_numpy().min())
        return pa.table({"chunk": t.column("chunk")[:1], "centre": [centre.tolist()], "radius": [radius], "floor": [low]})

    ends = None
    if chunks <= CHUNKS_BOUND:
        ends = queries.groupBy("chunk").applyInArrow(sum_up, "chunk int, centre array<double>, radius double, floor long").toArrow()
        ends = tuple(ends.column(c).to_numpy() for c in ("chunk", "radius", "floor")) + (np.stack(ends.column("centre").to_pylist()),)
    bounds = spark.sparkContext.broadcast(ends)
    # As many parts as keep a task's blocks within bounds and all cores at work.
    parts = max(1, -(-total // (block * group)), min(2 * spark.sparkContext.defaultParallelism // chunks, total // (4 * block)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, nth = TaskContext.get().partitionId(), 0
        for b in slices(batches, block):
            ids, x = b.column("vec_id").to_numpy(), _matrix(b.column("v"), dim)
            kind = next(t for t in ("<i2", "<i4", "<i8") if t == "<i8" or np.abs(x.astype(float)).max() < np.iinfo(t).max)
            if bounds.value is None:
                to = np.arange(chunks)
            else:
                to, radius, floor, centre = bounds.value
                mean = x.astype(float).mean(0)
                own = np.linalg.norm(x - mean, axis=1).max()
                far = np.linalg.norm(centre, axis=1)
                most = centre @ mean + far * own + np.linalg.norm(mean) * radius + own * radius
                to = to[most + 1 + 1e-9 * np.abs(most) >= floor]
            nth += 1
            at = (mine * 7919 + nth) % parts
            raw, names = x.astype(kind).tobytes(), ids.tobytes()
            if len(to):
                columns = [pa.array(to.astype(np.int32)), pa.array(np.full(len(to), at, np.int32))]
                columns += [pa.array([v] * len(to)) for v in (kind, names, raw)]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "part", "kind", "ids", "x"])

    ordered = placed.repartitionByRange("code", "vec_id").sortWithinPartitions("code", "vec_id")
    right = ordered.mapInArrow(pack, "chunk int, part int, kind string, ids binary, x binary")
    left = queries.select("chunk", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "v", "floor")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            ids = [np.frombuffer(x, np.int64) for x in b.column("ids").to_pylist()]
            x = zip(b.column("kind").to_pylist(), b.column("x").to_pylist(), strict=True)
            blocks = Blocks(ids, [np.frombuffer(raw, kind).astype(np.int64).reshape(-1, dim) for kind, raw in x])
            q, own, floor = _matrix(a.column("v"), dim), a.column("vec_id").to_numpy(), a.column("floor").to_numpy()
            for at in range(0, len(q), 512):
                i = slice(at, at + 512)
                found += blocks.search(own[i], q[i], floor[i], k)
        columns = list(zip(*found, strict=True)) or [[], [], []]
        names = ("query_id", "vec_id", "score")
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    found = left.groupBy("chunk", "part").cogroup(right.groupBy("chunk", "part"))
    found = found.applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
