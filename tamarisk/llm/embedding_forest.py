"""Near-duplicate embeddings by a forest of random-projection trees with spill overlap.

The trees are fitted on a bounded sample: a node is split along one of several random directions, where few sample vectors
lie near the cut; vectors close to a cut go to both sides. All vectors are then dealt to the leaves of every tree and
compared within leaves; a pair that meets in several leaves counts in the first one only. Each block of a leaf returns
counts and edges that span its components, never its pairs.

Equal vectors are one vector with a weight. Dense groups of unequal ones would fill leaves with pairs that need no comparison:
a vector within half the linking angle of a core links with every other such vector, so members of a core are counted by the
core's size and take no part in the choice of cuts, which would else run through them and double them at every level. Cores
are sample vectors with many neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_frequent, materialize, slices
from .components import connected_components

#: Sample vectors on which the forest and the cores are fitted; every vector is indexed.
SAMPLE = 16_384
TREES = 6
#: Vectors of a leaf that a split aims at, and of a block that is compared with others at once.
LEAF, BLOCK = 512, 2048
#: Half the width of the overlap at a cut, in units of 1 / sqrt(dimension).
SPILL = 0.16
#: A node is no longer split if that would repeat more than this share of its sample vectors.
REPEATED = 0.4
#: Sample vectors tried as cores, and the share of the sample a core must cover.
CORES_TRIED, CORE_SHARE = 2048, 0.002
#: Rows of a block whose similarities are held at once.
STRIP = 512


class Forest:
    """Nodes of all trees in arrays: direction, cut and the two children; a negative child -1 - k is leaf k.

    A node is split where few sample vectors lie near the cut, until it holds ``leaf`` vectors of the whole table by the
    sample's estimate. Where too few sample vectors are left to choose, their median is the cut, down to two of them.
    """

    def __init__(self, sample: np.ndarray, rows: int, threshold: float, trees: int, leaf: int, seed: int):
        n, dim = sample.shape
        rng = np.random.default_rng(seed)
        self.spill = SPILL / np.sqrt(dim)
        self.directions = rng.standard_normal((dim, 128))
        self.directions /= np.linalg.norm(self.directions, axis=0)
        self.leaves, small = 0, leaf * n / max(1, rows)
        shadow = sample @ self.directions
        near = 2.5 * self.spill
        nodes: list[list] = []
        self.roots = []

        def split(own: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray] | None:
            if len(own) <= small or len(own) < 2 or self._tight(sample[own], threshold):
                return None
            best = (np.inf, 0, 0.0)
            for d in rng.integers(0, 128, 8):
                x = np.sort(shadow[own, d])
                cuts = np.quantile(x, np.linspace(0.2, 0.8, 25)) if len(own) >= 16 else np.array([np.median(x)])
                crowd = np.searchsorted(x, cuts + near) - np.searchsorted(x, cuts - near)
                uneven = np.abs(np.searchsorted(x, cuts) / len(x) - 0.5)
                cost = crowd / len(x) + 0.5 * uneven
                k = int(cost.argmin())
                best = min(best, (float(cost[k]), int(d), float(cuts[k])))
            _, d, cut = best
            x = shadow[own, d]
            left, right = own[x < cut + self.spill], own[x >= cut - self.spill]
            if len(own) >= 16 and len(left) + len(right) > (1 + REPEATED) * len(own) or max(len(left), len(right)) == len(own):
                return None
            return d, cut, left, right

        for _ in range(trees):
            # (own sample vectors, parent, which child) of what is still to be split.
            todo: list[tuple[np.ndarray, int, int]] = [(np.arange(n), -1, 0)]
            while todo:
                own, parent, side = todo.pop()
                got = split(own)
                if got is None:
                    at = -1 - self.leaves
                    self.leaves += 1
                else:
                    at = len(nodes)
                    nodes.append([got[0], got[1], 0, 0])
                    todo += [(got[2], at, 2), (got[3], at, 3)]
                if parent < 0:
                    self.roots.append(at)
                else:
                    nodes[parent][side] = at
        columns = list(zip(*nodes, strict=True)) or [(), (), (), ()]
        self.direction, self.left, self.right = (np.array(columns[i], np.int32) for i in (0, 2, 3))
        self.cut = np.array(columns[1], float)

    @staticmethod
    def _tight(own: np.ndarray, threshold: float) -> bool:
        middle = own.mean(0)
        return bool((own @ middle >= threshold * np.linalg.norm(middle)).all())

    def deal(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs, ordered by row: every leaf of every tree that each row of ``x`` falls into."""
        shadow, done = x @ self.directions, []
        row = np.tile(np.arange(len(x)), len(self.roots))
        at = np.repeat(np.array(self.roots, np.int64), len(x))
        while len(row):
            leaf = at < 0
            done.append((row[leaf], -1 - at[leaf]))
            row, at = row[~leaf], at[~leaf]
            p, cut = shadow[row, self.direction[at]], self.cut[at]
            low, high = p < cut + self.spill, p >= cut - self.spill
            row, at = np.r_[row[low], row[high]], np.r_[self.left[at[low]], self.right[at[high]]].astype(np.int64)
        row, leaf = (np.concatenate(c) for c in zip(*done, strict=True))
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def find_cores(sample: np.ndarray, threshold: float, tried: int = CORES_TRIED, share: float = CORE_SHARE) -> np.ndarray:
    """Centres of dense groups: at most 1 / ``share`` of them. Two vectors within half the linking angle of a centre have
    at most the linking angle between them."""
    half = np.sqrt((1 + threshold) / 2) + 1e-7
    covers = sample[:tried] @ sample.T >= half
    cores = []
    while len(covers):
        size = covers.sum(1)
        k = int(size.argmax())
        if size[k] < max(8, share * len(sample)):
            break
        cores.append(sample[k])
        covers = covers & ~covers[k]
    return np.array(cores).reshape(-1, sample.shape[1])


def _unit(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(values.flatten(), np.float64).reshape(-1, dim)
    # Scaling first keeps the squares of very large or small components in range.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spanning(link: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the least index of each row's component."""
    label = np.full(len(link), -1)
    for i in np.flatnonzero(link.any(1)):
        if label[i] < 0:
            front, label[i] = [i], i
            while front:
                new = np.flatnonzero(link[front.pop()] & (label < 0))
                label[new] = i
                front += new.tolist()
    return np.where(label < 0, np.arange(len(link)), label)


def link_vectors(
    vectors: DataFrame,
    threshold: float = 0.9,
    trees: int = TREES,
    sample: int = SAMPLE,
    leaf: int = LEAF,
    block: int = BLOCK,
    seed: int = 11,
) -> DataFrame:
    """(vec_id, n_links, component_id) of (vec_id, embedding): links are pairs with cosine >= ``threshold``.

    Vectors that are null, of another length than most, zero, or with null or non-finite components link with nothing.
    Rows that repeat a vec_id are one vector (the smallest of different embeddings). Null ids are ignored, other columns
    not read; an empty table gives no rows. Found links are exact; links that no leaf holds are missed.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    ids = vectors.select("vec_id").distinct()
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = vectors.where(finite & F.exists(e, lambda x: x != 0))
    width = sound.groupBy(F.size(e).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    none = ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if width is None:
        return none
    dim = width.dim
    each = sound.where(F.size(e) == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    each = materialize(each)
    total = each.count()
    # Equal vectors are one from here on: the smallest id, and how many there are.
    same = materialize(each.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight")))
    own = same.select(F.col("first").alias("vec_id"), "embedding", "weight")
    of = None
    if own.count() < total:
        of = materialize(join_frequent(each, same, "embedding", "weight", total).select("vec_id", "first"))
    counts, edges = _linked(own, dim, threshold, trees, sample, leaf, block, seed)
    counts = counts.groupBy("vec_id").agg(F.sum("n").alias("n"))
    named = connected_components(edges)
    found = own.select(F.col("vec_id").alias("first"), F.col("weight").alias("many")).join(
        counts.withColumnRenamed("vec_id", "first"), "first", "left"
    )
    found = found.join(named.withColumnRenamed("node", "first"), "first", "left")
    found = materialize(found.select("first", "many", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "first").alias("component")))
    out = found.withColumnRenamed("first", "vec_id") if of is None else join_frequent(of, found, "first", "many", total)
    out = out.select("vec_id", (F.col("n") + F.col("many") - 1).alias("n_links"), F.col("component").alias("component_id"))
    return out.unionByName(none.join(each, "vec_id", "left_anti"))


def _linked(
    own: DataFrame, dim: int, threshold: float, trees: int, sample: int, leaf: int, block: int, seed: int
) -> tuple[DataFrame, DataFrame]:
    """Two tables for (vec_id, embedding, weight) with distinct vectors of ``dim`` components: (vec_id, n), whose sums are the
    weights of the linked vectors, and edges (a, b) that connect what is linked."""
    spark = own.sparkSession
    rows = own.count()
    some = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    some = _unit(some.column("embedding"), dim)
    cores = find_cores(some, threshold)
    half = np.sqrt((1 + threshold) / 2) + 1e-7

    def core_of(x: np.ndarray) -> np.ndarray:
        if not len(cores):
            return np.full(len(x), -1)
        near = x @ cores.T
        k = near.argmax(1)
        return np.where(near[np.arange(len(x)), k] >= half, k, -1)

    loose = core_of(some) < 0
    forest = Forest(some[loose], int(rows * loose.mean()), threshold, trees, leaf, seed)

    # Blocks of each leaf, from the sample's counts: first those of mixed rows, then those of each core that fills half a
    # block; (core or -1, first block, blocks).
    scale = rows / len(some)
    row, dealt = forest.deal(some)
    kind = core_of(some)[row]
    order = np.lexsort((kind, dealt))
    kind, starts = kind[order], np.searchsorted(dealt[order], np.arange(forest.leaves + 1))
    plan: list[list[tuple[int, int, int]]] = []
    for a, b in zip(starts, starts[1:], strict=False):
        names, n = np.unique(kind[a:b], return_counts=True)
        large = {int(c): int(k * scale) for c, k in zip(names, n, strict=True) if c >= 0 and k * scale > block // 2}
        at = max(1, -(-int((b - a) * scale - sum(large.values())) // block))
        parts = [(-1, 0, at)]
        for c, k in large.items():
            parts.append((c, at, -(-k // block)))
            at += -(-k // block)
        plan.append(parts)
    shared = spark.sparkContext.broadcast((forest, plan))
    value = own.schema["embedding"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, plan = shared.value
        for b in slices(batches, 1024):
            x = _unit(b.column("embedding"), dim)
            core, ids = core_of(x), b.column("vec_id").to_numpy()
            row, leaf = forest.deal(x)
            first = np.searchsorted(row, np.arange(len(x) + 1))
            out = []
            for r, k in zip(row.tolist(), leaf.tolist(), strict=True):
                parts, c = plan[k], int(core[r])
                mine = next((p for p in parts if p[0] == c), parts[0])
                blk = mine[1] + int(ids[r] * 0x9E3779B1 & 0x7FFFFFFF) % mine[2]
                for kind, start, n in parts:
                    if kind >= 0 and kind == mine[0]:
                        continue
                    out += [(r, k, min(blk, y), max(blk, y), blk) for y in range(start, start + n)]
            if out:
                take, k, lo, hi, blk = (np.array(c) for c in zip(*out, strict=True))
                every = pa.array([leaf[first[r] : first[r + 1]].tolist() for r in take], pa.list_(pa.int32()))
                at = pa.array(take)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(c.astype(np.int32)) for c in (k, lo, hi, blk, core[take])),
                        *(b.column(c).take(at) for c in ("vec_id", "embedding", "weight")),
                        every,
                    ],
                    ["leaf", "lo", "hi", "blk", "core", "vec_id", "embedding", "weight", "leaves"],
                )

    def compare(t: pa.Table) -> pa.Table:
        x, ids, weight = _unit(t.column("embedding"), dim), t.column("vec_id").to_numpy(), t.column("weight").to_numpy()
        core, blk = t.column("core").to_numpy(), t.column("blk").to_numpy()
        here, both = t.column("leaf")[0].as_py(), t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
        lists = t.column("leaves").combine_chunks()
        flat, owner = np.asarray(lists.flatten()), np.repeat(np.arange(len(x)), np.diff(np.asarray(lists.offsets)))
        # Earlier leaves that two rows here share; of most there is one row only.
        names, place, uses = np.unique(flat, return_inverse=True, return_counts=True)
        useful = (uses > 1) & (names < here)
        seat = np.zeros((len(x), int(useful.sum())), np.float32)
        column = np.cumsum(useful) - 1
        kept = useful[place]
        seat[owner[kept], column[place[kept]]] = 1
        near = np.zeros((len(x), len(x)), bool)
        for at in range(0, len(x), STRIP):
            i = slice(at, at + STRIP)
            link = x[i] @ x.T >= threshold
            link &= ids[i, None] != ids
            link &= (core[i, None] != core) | (core[i, None] < 0)
            if both:
                link &= blk[i, None] != blk
            r = np.flatnonzero(link.any(1))
            if len(r) and seat.shape[1]:
                link[r] &= seat[i][r] @ seat.T < 0.5
            near[i] = link
        label = _spanning(near)
        n = near @ weight
        keep = np.flatnonzero(n)
        return pa.table({"vec_id": pa.array(ids[keep]), "n": pa.array(n[keep].astype(np.int64)), "root": pa.array(ids[label[keep]])})

    dealt_rows = own.mapInArrow(
        assign, f"leaf int, lo int, hi int, blk int, core int, vec_id long, embedding {value}, weight long, leaves array<int>"
    )
    found = materialize(dealt_rows.groupBy("leaf", "lo", "hi").applyInArrow(compare, "vec_id long, n long, root long"))
    counts, edges = found.select("vec_id", "n"), found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))
    if len(cores):

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 4096):
                core = core_of(_unit(b.column("embedding"), dim))
                k = pa.array(np.flatnonzero(core >= 0))
                columns = [b.column("vec_id").take(k), b.column("weight").take(k), pa.array(core.astype(np.int32)).take(k)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "weight", "core"])

        members = materialize(own.mapInArrow(name, "vec_id long, weight long, core int"))
        # One row for each core.
        sizes = members.groupBy("core").agg(F.sum("weight").alias("size"), F.min("vec_id").alias("least"))
        members = members.join(F.broadcast(sizes), "core")
        counts = counts.union(members.select("vec_id", (F.col("size") - F.col("weight")).alias("n")))
        edges = edges.union(members.select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    return counts, edges
