"""Nearest neighbours by largest inner product, through a multi-index over binary codes.

Vectors become codes of ``BITS`` signs: a rotation to principal axes of a sample, and rotations learned from there by iterative
quantisation, so that few components lie next to zero. A last component brings all candidates to one length, which makes the
largest product the smallest angle. A code is split into ``PARTS`` substrings, each indexed by its value. Of two codes within a
Hamming radius, at least one substring lies within its share of the radius (the shares and one more each make up more than the
radius), so every code within the radius is met in some index; a pair counts in the first of them only, is checked over the whole
code, and scored from the floats.

Each query has its own radius. Its k-th best product among the sample bounds the angle of its neighbours from above; codes of
vectors at that angle differ in a known share of the bits, and a margin learned on the sample covers the spread. Nothing within
the radius is left out.

An index is dealt by cells, the leading bits of its values, so that a query goes only to the cells that its share of the radius
reaches; large cells and many queries are cut into pieces. Equal vectors are one entry with their smallest ids, and equal queries
are searched for once. How much the radius leaves out depends on the data: of tight groups nearly all the rest, of directions
spread evenly over 64 dimensions, as most of the given vectors are, little, and there most pairs are met in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

BITS, PARTS = 128, 4
WIDTH = BITS // PARTS
#: Vectors that the codes and margins are learned on, and queries among them for the margin.
SAMPLE, TRIALS = 16384, 512
#: The margin covers this share of the neighbours of the trials.
COVER = 0.985
#: Index entries and queries that a task meets at once.
PIECE, CHUNK = 8192, 4096
#: Rounds of quantisation, and how many times k vectors of the sample lie above a query's floor.
ROUNDS, SPARE = 25, 4


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten(), np.float64).reshape(-1, dim)


def _words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, PARTS)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, added up in the same order whatever else is computed."""
    return (a * b).sum(axis=1)


class Codes:
    """What is learned on the sample, sent to every task."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 11):
        self.longest, self.seed = longest, seed
        x = self._lifted(sample)
        rng, dim = np.random.default_rng(seed), x.shape[1]
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, : min(dim, BITS)]
        y, turns = x @ axes, []
        while sum(t.shape[1] for t in turns) < BITS:
            turn = np.linalg.qr(rng.standard_normal((y.shape[1], y.shape[1])))[0]
            for _ in range(ROUNDS):
                left, _, right = np.linalg.svd(np.sign(y @ turn).T @ y)
                turn = (left @ right).T
            turns.append(axes @ turn)
        self.planes = np.concatenate(turns, axis=1)[:, rng.permutation(sum(t.shape[1] for t in turns))[:BITS]]
        self.margin = 0.0

    def _lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest**2 - (x * x).sum(axis=1), 0)
        return np.column_stack((x, np.sqrt(rest))) / self.longest

    def _bits(self, lifted: np.ndarray) -> np.ndarray:
        """Rows of PARTS unsigned 32-bit words."""
        packed = np.packbits(lifted @ self.planes >= 0, axis=1)
        return np.ascontiguousarray(packed).view(">u4").astype(np.uint32)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        return self._bits(self._lifted(x))

    def queries(self, q: np.ndarray) -> np.ndarray:
        return self._bits(np.column_stack((q / np.linalg.norm(q, axis=1)[:, None], np.zeros(len(q)))))

    def angle_bits(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """In how many bits the code of a candidate with this score differs from the query's, on average."""
        cosine = score / (np.linalg.norm(q, axis=1) * self.longest)
        return BITS / np.pi * np.arccos(np.clip(cosine, -1, 1))

    def calibrate(self, sample: np.ndarray, k: int) -> None:
        trials = sample[np.random.default_rng(self.seed).permutation(len(sample))[:TRIALS]]
        score = trials @ sample.T
        near = np.argpartition(-score, min(k, len(sample) - 1), axis=1)[:, : k + 1]
        own, other = self.queries(trials), self.candidates(sample)
        apart = np.bitwise_count(own[:, None, :] ^ other[near]).sum(axis=2)
        expected = self.angle_bits(np.repeat(trials, near.shape[1], axis=0), np.take_along_axis(score, near, 1).ravel())
        self.margin = float(np.quantile(apart.ravel() - expected, COVER)) if len(sample) > 1 else float(BITS)

    def radius(self, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        return np.clip(np.ceil(self.angle_bits(q, floor) + self.margin), 0, BITS).astype(np.int32)


def shares(radius: np.ndarray) -> np.ndarray:
    """(queries, PARTS): how far each substring is searched, -1 for not at all; the shares and one more each make radius + 1."""
    total = radius.astype(np.int64) + 1
    return np.stack([(total + PARTS - 1 - j) // PARTS - 1 for j in range(PARTS)], axis=1)


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part: not null or zero, without null or non-finite components, with an
    id, of the commonest length; of rows that repeat a vec_id with other values the smallest counts."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(F.col("embedding").isNotNull() & finite & some & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def meet(q: dict[str, np.ndarray], c: dict[str, np.ndarray], part: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows of q, rows of c, scores) of the entries within the radius that are met first in this part's index: for each query the
    best ``k`` and those as good as the k-th, as far as rounding can tell, down to its floor."""
    limits = shares(q["radius"])
    for at in range(0, len(limits), 256):
        i = slice(at, at + 256)
        first, near = np.ones((len(limits[i]), len(c["v"])), bool), np.zeros((len(limits[i]), len(c["v"])), np.int32)
        for j in range(PARTS):
            apart = np.bitwise_count(q["code"][i, j, None] ^ c["code"][None, :, j])
            if j <= part:
                inside = apart <= limits[i, j, None]
                first &= inside if j == part else ~inside
            near += apart
        first &= near <= q["radius"][i, None]
        if first.mean() > 0.02:
            score = np.where(first, q["v"][i] @ c["v"].T, -np.inf)
        else:
            own, other = np.nonzero(first)
            score = np.full(first.shape, -np.inf)
            score[own, other] = dots(q["v"][i][own], c["v"][other])
        least = q["floor"][i]
        if score.shape[1] > k:
            least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
        least = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), least)
        own, other = np.nonzero((score >= least[:, None]) & first)
        yield own + at, other, dots(q["v"][i][own], c["v"][other])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the ``k`` rows found with the largest inner product, in doubles.

    ``is_query`` is a condition on vec_id. A query's own id is no candidate, ties go to the smaller vec_id, and fewer candidates
    are all returned. Vectors that take no part: see ``sound_vectors``. An empty table, or one without queries, gives no rows;
    further columns are not read."""
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows = sound_vectors(vectors)
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(squares).alias("most"))
    top = lengths.orderBy(F.desc("n"), "dim").first()
    if top is None:
        return spark.createDataFrame([], schema)
    dim, longest = top.dim, float(np.sqrt(top.most)) * (1 + 1e-12)
    rows = rows.where(F.size("v") == dim)
    # Of equal vectors the smallest ids can be in a result, one more than k since the query's own goes.
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    entries = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("entry")))
    asked = rows.where(is_query)
    queries = materialize(asked.groupBy("v").agg(F.min("vec_id").alias("query")).select("query", "v"))
    sample = _matrix(entries.orderBy(F.xxhash64("entry"), "entry").select("v").limit(SAMPLE).toArrow().column("v"), dim)
    codes = Codes(sample, longest)
    codes.calibrate(sample, k)
    learned = spark.sparkContext.broadcast((codes, sample))
    distinct, total = entries.agg(F.count("*"), F.sum(F.size("ids"))).first()
    bits = max(0, int(np.ceil(np.log2(max(1, distinct / PIECE)))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, _ = learned.value
        for b in slices(batches, 4096):
            code = codes.candidates(_matrix(b.column("v"), dim))
            cells = (code.astype(np.uint64) >> np.uint64(WIDTH - bits)).tolist()
            columns = [*b.columns, pa.array([x.tobytes() for x in code]), pa.array(cells, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "code", "cells"])

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's floor, radius and code, and the cells of every index that its share of the radius reaches."""
        codes, sample = learned.value
        every = np.arange(1 << bits, dtype=np.uint64)
        kind = pa.list_(pa.struct([("part", pa.int32()), ("cell", pa.int32())]))
        for b in slices(batches, 512):
            q = _matrix(b.column("v"), dim)
            whole = np.asarray(b.column("whole").to_pylist(), bool)
            score = np.sort(q @ sample.T, axis=1)[:, ::-1]
            # The query's own vector may be in the sample, so one more. Far more than k reach the floor.
            bound = score[:, k] if len(sample) > k else np.full(len(q), -np.inf)
            floor = score[:, SPARE * k] if len(sample) > SPARE * k else np.full(len(q), -np.inf)
            code = codes.queries(q)
            radius = np.where(whole, BITS, codes.radius(q, np.maximum(bound, -np.linalg.norm(q, axis=1) * codes.longest))).astype(np.int32)
            floor = np.where(whole, -np.inf, floor)
            reach, to = shares(radius), [[] for _ in q]
            for j in range(PARTS):
                near = np.bitwise_count((code[:, j, None].astype(np.uint64) >> np.uint64(WIDTH - bits)) ^ every) <= reach[:, j, None]
                for n, cells in enumerate(near):
                    to[n] += [{"part": j, "cell": x} for x in np.flatnonzero(cells).tolist()]
            columns = [b.column("query"), b.column("v"), pa.array([x.tobytes() for x in code]), pa.array(radius), pa.array(floor), pa.array(to, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["query", "v", "code", "radius", "floor", "to"])

    coded = entries.select("entry", "v").mapInArrow(encode, "entry long, v array<double>, code binary, cells array<int>")
    index = materialize(coded.select("entry", "v", "code", F.posexplode("cells").alias("part", "cell")))
    where, keys = ["part", "cell", "piece", "chunk"], ["part", "cell"]

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            both = [{"v": _matrix(t.column("v"), dim), "code": _words(t.column("code"))} for t in (a, b)]
            both[0] |= {c: a.column(c).to_numpy() for c in ("radius", "floor")}
            ids, names = a.column("query").to_numpy(), b.column("entry").to_numpy()
            found = [(ids[i], names[j], s) for i, j, s in meet(*both, a.column("part")[0].as_py(), k + 1)]
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] or [[], [], []]
        kinds = zip(("query", "entry", "score"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)
        return pa.table({n: pa.array(c, t) for n, c, t in kinds})

    def retrieve(queries: DataFrame, whole: bool) -> DataFrame:
        """(query, entry, score) of the best within each query's radius, or among all."""
        schema = "query long, v array<double>, code binary, radius int, floor double, to array<struct<part int, cell int>>"
        aimed = queries.withColumn("whole", F.lit(whole)).mapInArrow(aim, schema)
        aimed = materialize(aimed.select("query", "v", "code", "radius", "floor", F.inline("to")))
        # Cells in pieces and their queries in chunks: every piece meets every chunk.
        sizes = index.groupBy(*keys).agg(F.count("*").alias("held")).join(aimed.groupBy(*keys).agg(F.count("*").alias("asking")), keys)
        several = [F.ceil(F.col(n) / size).cast("int").alias(to) for n, size, to in (("held", PIECE, "pieces"), ("asking", CHUNK, "chunks"))]
        sizes = sizes.select(*keys, *several)

        def spread(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
            mine = F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int").alias(own)
            each = F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other)
            return rows.join(sizes, keys).select(*rows.columns, mine, each)

        asking, held = spread(aimed, "query", "chunk", "piece"), spread(index, "entry", "piece", "chunk")
        met = asking.groupBy(*where).cogroup(held.groupBy(*where)).applyInArrow(search, "query long, entry long, score double")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
        return met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")

    found = materialize(retrieve(queries, False))
    # Queries whose radius holds too few go on to all codes.
    enough = found.join(entries.select("entry", F.size("ids").alias("held")), "entry").groupBy("query").agg(F.sum("held").alias("held"))
    short = materialize(queries.join(enough.where(F.col("held") >= min(k + 1, total)), "query", "left_anti"))
    if not short.isEmpty():
        rest = materialize(retrieve(short, True))
        found = found.join(short.select("query"), "query", "left_anti").unionByName(rest)
    named = found.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    each = asked.select(F.col("vec_id").alias("query_id"), "v").join(queries, "v").select("query_id", "query")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = each.join(named, "query").where("vec_id <> query_id").withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
