"""SimHash near-duplicates, candidates pruned by pigeonring chains.

A fingerprint's 64 bits are four segments on a ring. If two fingerprints differ in at most three bits, then from some
segment on, one, two, three and four consecutive segments differ in at most 0, 1, 2 and 3 bits in sum (a quota of
3/4 bit a segment). The first two steps are a join key: a segment, and the next one with up to one set bit cleared. The
third step and the full distance are checked on what shares a key.

Texts with 0.8 of their shingles in common differ in 10 of 64 bits on average, too many for segments that tell texts apart to
agree, and some differ in any number. ``similar_documents`` therefore takes candidates from shingles of which alike texts must
share one (``shingle_bands``) and checks the whole sets, so that it misses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_frequent, materialize, slices, utf8
from .components import connected_components
from .shingle_bands import SIMILAR, checked, frequent, linked_within, met, signatures

SEGMENTS, BITS = 4, 16
DISTANCE = 3
#: A segment value that so many fingerprints hold, besides 64 times the mean, is hot; see ``_hot_keys``.
HOT = 4096
#: Longest run of equal keys that is compared pair by pair at once; longer ones are searched breadth first.
SHORT = 32


def fingerprint(raw: bytes, size: int = 3, seed: int = 42) -> int:
    """Fingerprint of a UTF-8 text: a bit is set if more than half of the shingles' hashes have it."""
    words = raw.lower().split()
    if not words:
        return 0
    count, n = np.zeros(64, np.int64), max(1, len(words) - size + 1)
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + size - 1]
        if len(part) <= size:
            shingles = [b" ".join(part)]
        else:
            shingles = map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False))
        h = np.fromiter(map(digest, shingles), "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): fingerprints of lower-cased (A-Z) whole texts; null or wordless texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(x, size, seed) for x in utf8(b)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _chain(x: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Whether the differences ``x`` keep within 1, 2 and 3 bits over two, three and four segments from ``start``."""
    turn = np.asarray(start, np.uint64) * np.uint64(BITS)
    x = (x >> turn) | (x << ((np.uint64(64) - turn) % np.uint64(64)))
    within = np.bitwise_count(x & np.uint64(0xFFFFFFFF)) <= 1
    within &= np.bitwise_count(x & np.uint64(0xFFFFFFFFFFFF)) <= 2
    return within & (np.bitwise_count(x) <= DISTANCE)


def _run_links(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within each run of equal keys; as many as members of a run at most."""
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[edge, len(key)])
    start = (key >> np.int64(32)).astype(np.uint64)
    short = np.repeat(size <= SHORT, size)
    label = np.arange(len(key))
    pairs = []
    for d in range(1, SHORT):
        i = np.flatnonzero(short[:-d] & (key[d:] == key[:-d])) if d < len(key) else np.empty(0, int)
        if not len(i):
            break
        i = i[_chain(fp[i] ^ fp[i + d], start[i])]
        pairs.append((i, i + d))
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while len(a):
            low = np.minimum(label[a], label[b])
            old = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (old == label).all():
                break
        i = np.flatnonzero(label != np.arange(len(key)))
        yield fp[i], fp[label[i]]
    for k in np.flatnonzero(size > SHORT):
        rest, at = fp[edge[k] : edge[k] + size[k]], start[edge[k]]
        while len(rest):
            root, front, rest = rest[0], [rest[0]], rest[1:]
            while front and len(rest):
                near = _chain(rest ^ front.pop(), at)
                if near.any():
                    new, rest = rest[near], rest[~near]
                    front += list(new)
                    yield new, np.full(len(new), root)


def _keyed_links(keys: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints that share a key; ``keys`` has (key, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in (*batches, None):
            if b is not None:
                key = np.r_[key, b.column("key").to_numpy()]
                fp = np.r_[fp, b.column("fp").to_numpy().view(np.uint64)]
                done = int(np.searchsorted(key, key[-1])) if len(key) else 0
            else:
                done = len(key)
            if done:
                for x, y in _run_links(key[:done], fp[:done]):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view("<i8")), pa.array(y.view("<i8"))], ["a", "b"])
                key, fp = key[done:], fp[done:]

    return keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def _hot_keys(hot: DataFrame) -> DataFrame:
    """(key, fp) for fingerprints with a hot segment (i, s): the other 48 bits are four parts, of which one at least is equal if they
    differ in three bits at most."""
    rest = F.call_function("shiftrightunsigned", F.col("fp"), (F.col("i") * BITS).cast("int")).bitwiseOR(
        F.call_function("shiftleft", F.col("fp"), (64 - F.col("i") * BITS).cast("int"))
    )
    part = lambda j: F.call_function("shiftrightunsigned", rest, F.lit(BITS + 12 * j)).bitwiseAND(F.lit(0xFFF).cast("long"))
    parts = F.explode(F.array(*(F.lit(j << 12).cast("long").bitwiseOR(part(j)) for j in range(4))))
    return hot.select("fp", "i", "s", parts.alias("v")).select(
        (F.col("i") * (1 << 32) + F.col("s") * (1 << 14) + F.col("v")).alias("key"), "fp"
    )


def ring_links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect exactly those within three differing bits."""
    # Reading the segments as unsigned values: a logical shift, then 16 bits.
    seg = lambda i: F.call_function(
        "shiftrightunsigned", F.col("fp"), F.lit(BITS * (i % SEGMENTS))
    ).bitwiseAND(F.lit(0xFFFF).cast("long"))
    one = F.lit(1).cast("long")
    starts = F.explode(
        F.array(*(F.struct(F.lit(i).cast("long").alias("i"), seg(i).alias("s"), seg(i + 1).alias("t")) for i in range(SEGMENTS)))
    )
    split = fps.select("fp", starts.alias("x")).select("fp", "x.*")
    n = fps.count()
    limit = hot + 64 * n // (1 << BITS)
    # At most 4 * 65,536 / 64 values can be so frequent: the table is small at any size.
    busy = materialize(split.groupBy("i", "s").count().where(F.col("count") > limit).select("i", "s"))
    cleared = F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda b: F.when(
            F.call_function("shiftrightunsigned", F.col("t"), b).bitwiseAND(one) == 1,
            F.col("t").bitwiseXOR(F.call_function("shiftleft", one, b)),
        ),
    )
    cold, some_hot = split, not busy.isEmpty()
    if some_hot:
        cold = split.join(F.broadcast(busy), ["i", "s"], "left_anti")
    variant = F.explode(F.array_compact(F.concat(F.array("t"), cleared)))
    keys = cold.select("fp", "i", "s", variant.alias("v")).select(
        (F.col("i") * (1 << 32) + F.col("s") * (1 << BITS) + F.col("v")).alias("key"), "fp"
    )
    links = _keyed_links(keys)
    if some_hot:
        links = links.union(_keyed_links(_hot_keys(split.join(F.broadcast(busy), ["i", "s"], "left_semi"))))
    return links


def near_duplicates(docs: DataFrame, size: int = 3, seed: int = 42, hot: int = HOT) -> DataFrame:
    """(doc_id, fp long, component_id): documents whose fingerprints link, directly or through others.

    Null or empty texts have fingerprint 0 and link like any other; rows with equal texts or equal fingerprints are one
    class; repeated rows stay rows. An empty table gives an empty result. Extra columns of ``docs`` are not read.
    """
    fps = materialize(fingerprints(docs, size, seed))
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    nodes = connected_components(ring_links(distinct.select("fp"), hot))
    named = materialize(nodes.join(distinct, nodes.node == distinct.fp).select("fp", "component", "least"))
    ids = named.groupBy("component").agg(F.min("least").alias("lowest"), F.count("*").alias("many"))
    moved = join_frequent(named, ids, "component", "many", named.count()).select("fp", "lowest")
    roots = distinct.join(moved, "fp", "left").select("fp", F.coalesce("lowest", "least").alias("component_id"), "n")
    out = join_frequent(fps, materialize(roots), "fp", "n", fps.count())
    return out.select("doc_id", "fp", "component_id")


def similar_documents(docs: DataFrame, size: int = 5, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, component_id): documents linked by a Jaccard similarity of ``similar`` or more, directly or through others.

    Texts with equal sets of shingles are one class. Classes that share a key which few hold are checked pair by pair. Of the members
    of other keys all are checked against the most typical one; then members of a key that no links connect yet are compared
    with each other, block by block. Null or wordless texts are one class; repeated rows stay rows; null ids
    are grouped like others; an empty table gives no rows; no column but doc_id and text is read.
    """
    signed = materialize(signatures(docs, size, similar, frequent(docs, size)))
    first = signed.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "sketch")))
    first = materialize(first)
    own = signed.select("cls", "doc_id", "n", "keys").join(first.select("cls", "doc_id"), ["cls", "doc_id"], "left_semi")
    shared = materialize(met(own.select("cls", "n", F.explode("keys").alias("key")), similar))
    ids = materialize(signed.select("doc_id", "cls"))
    discard(signed)
    pairs = shared.where("key is null").select("a", "b")
    wide = materialize(shared.where("key is not null").select("key", F.col("a").alias("cls"), "n"))
    some = not wide.isEmpty()
    if some:
        starred = _starred(wide)
        ours, other = F.col("n"), F.col("root.n")
        alike = F.least(ours, other) >= similar * F.greatest(ours, other) - 1e-9
        stars = starred.where((F.col("cls") != F.col("root.cls")) & alike)
        pairs = pairs.union(stars.select(F.least("cls", "root.cls").alias("a"), F.greatest("cls", "root.cls").alias("b")))
    links = checked(pairs, docs, first, size, similar)
    nodes = materialize(connected_components(links))
    if some:
        named = starred.join(nodes, starred.cls == nodes.node, "left").select(
            "key", "cls", F.coalesce("component", "cls").alias("part"), (F.col("cls") == F.col("root.cls")).alias("top")
        )
        named = materialize(named)
        discard(starred)
        split = named.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"))
        # The first of a key has met all others.
        split = materialize(split.where("p <> q").select("key"))
        if not split.isEmpty():
            rest = named.where("not top").join(split, "key", "left_semi").select("key", "cls", "part")
            links = links.union(materialize(linked_within(rest, docs, first, size, similar)))
            nodes = connected_components(links)
    discard(shared, wide)
    joined = materialize(nodes.join(first.select(F.col("cls").alias("node"), "doc_id"), "node"))
    lowest = joined.groupBy("component").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("many"))
    moved = join_frequent(joined, lowest, "component", "many", joined.count()).select(F.col("node").alias("cls"), "lowest")
    roots = first.select("cls", F.col("doc_id").alias("least"), "copies").join(moved, "cls", "left")
    roots = materialize(roots.select("cls", F.coalesce("lowest", "least").alias("component_id"), "copies"))
    out = join_frequent(ids, roots, "cls", "copies", ids.count())
    return out.select("doc_id", "component_id")


def _starred(wide: DataFrame) -> DataFrame:
    """``wide`` (key, cls, n) with each key's most typical class as ``root`` (cls, n)."""
    sizes = wide.groupBy("key").agg(F.count("*").alias("m"))
    total = max(1, wide.count())
    # A text that many others were made from shares most of its keys with most of them: such a one is put first.
    typical = wide.join(sizes, "key").groupBy("cls").agg(F.sum("m").alias("weight"))
    root = wide.join(typical, "cls").groupBy("key").agg(
        F.max_by(F.struct("cls", "n"), F.struct("weight", "cls")).alias("root"), F.count("*").alias("size")
    )
    return materialize(join_frequent(wide, materialize(root), "key", "size", total).drop("size"))
