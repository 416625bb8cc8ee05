"""Substring duplicates by collinear chaining.

Hashes of five-word shingles, winnowed so that every run of shared words of some length shares one, are matched with the
first document that has them, where that leads to nothing with the nearest one before, and what is open then with all documents
before that share two of them. The matches of two documents that keep their order are chained, with costs for gaps, by a Fenwick tree; chains are extended and aligned word by word, so that passages with small edits are found whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, join_frequent, materialize, slices, utf8
from .features import STEP, groups, mix, words

#: Words of a shingle, and shingles of a window that keeps its least one.
SHINGLE, WINDOW = 5, 6
#: Words that a chain of two or more seeds must span before it is aligned.
LEAD = 8
#: Worth of a matched shingle and cost of a word of gap on either side; a chain's score may bridge more than one seed's 50 words.
WORTH, COST = 10.0, 0.1
#: Words that a passage must have, and the share of them that must agree.
LEAST, SIMILAR = 50, 0.8
#: Words that a chain must span in documents beyond the first and the nearest.
FAR_LEAD = 24
#: Words looked at beyond the outermost shingles, and the grid to which ranges of sources are rounded.
MARGIN, GRID = 48, 64


def seeds(docs: DataFrame) -> DataFrame:
    """(hash, doc_id, pos) of the winnowed shingles of every whole text; pos counts words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, ids = utf8(b), b.column("doc_id").to_numpy()
            for at, end in groups(texts):
                h, doc, _, _ = words(texts[at:end])
                n = len(h) - SHINGLE + 1
                if n < 1:
                    continue
                k = np.zeros(n, np.uint64)
                for i in range(SHINGLE):
                    k = k * np.uint64(STEP) + h[i : i + n]
                k = mix(k)
                whole = doc[:n] == doc[SHINGLE - 1 :]
                k[~whole] = np.iinfo(np.uint64).max
                w = min(WINDOW, n)
                least = np.lib.stride_tricks.sliding_window_view(k, w).argmin(1) + np.arange(n - w + 1)
                least = np.unique(least)
                least = least[whole[least]]
                first = np.searchsorted(doc, np.arange(end - at))
                pos = least - first[doc[least]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k[least].view(np.int64)),
                        pa.array(ids[at:end][doc[least]].astype(np.int64)),
                        pa.array(pos.astype(np.int32)),
                    ],
                    ["hash", "doc_id", "pos"],
                )

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "hash long, doc_id long, pos int")


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, first_id, first_pos, near_id, near_pos): each seed that a smaller doc_id has too, with its first place in the
    smallest and its last place in the nearest of them. One row for each seed at most, however many documents share it."""
    own = materialize(seeds(docs))
    return _earlier(own, own)


def _earlier(own: DataFrame, *used: DataFrame) -> DataFrame:
    """``matches`` of (hash, doc_id, pos), written to shared storage; ``used`` is deleted once its rows are linked.

    Rows are dealt by ranges of (hash, doc_id, pos), so that a frequent hash spreads over tasks. What a task's first hash has in
    the tasks before is added afterwards, from four rows that each task leaves at most."""
    names = ["hash", "doc_id", "pos"]
    out = ["task", "kind", *names, "first_id", "first_pos", "near_id", "near_pos"]
    place = (pa.int64(), pa.int32())
    kinds = (pa.int32(), pa.int32(), pa.int64(), *place, *place, *place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def rows(kind: int, h, doc, pos, places=(), null=None) -> pa.RecordBatch:
            """kind 0: with an earlier document; 1: of the task's first hash; 2: first place of its last hash; 3: an end of it."""
            null = np.ones(len(h), bool) if null is None else null
            extra = [pa.array(x, mask=null) for x in places or (doc, pos, doc, pos)]
            own = [pa.array(np.full(len(h), x)) for x in (task, kind)] + [pa.array(x) for x in (h, doc, pos)]
            return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(own + extra, kinds, strict=True)], out)

        held, top = [np.empty(0, np.int64) for _ in names], None
        for b in batches:
            if not b.num_rows:
                continue
            old = len(held[0])
            h, doc, pos = (np.r_[x, b.column(n).to_numpy().astype(np.int64)] for x, n in zip(held, names, strict=True))
            top = h[0] if top is None else top
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            first = np.repeat(start, np.diff(np.r_[start, len(h)]))
            edge = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
            end = np.r_[edge[1:], len(h)] - 1
            group = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, len(h)]))
            near = end[np.maximum(group - 1, 0)]
            later = doc > doc[first]
            new = np.arange(len(h)) >= old
            for kind, of in ((0, later & new & (h != top)), (1, new & (h == top))):
                i = np.flatnonzero(of)
                if len(i):
                    f, n = first[i], near[i]
                    yield rows(kind, h[i], doc[i], pos[i], (doc[f], pos[f], doc[n], pos[n]), ~later[i])
            last = int(start[-1])
            keep = np.unique(np.r_[last, [k for k in end[-2:] if k >= last]])
            held = [x[keep] for x in (h, doc, pos)]
        if len(held[0]):
            yield rows(2, *(x[:1] for x in held))
            yield rows(3, *(x[-2:] for x in held))

    schema = "task int, kind int, hash long, doc_id long, pos int, first_id long, first_pos int, near_id long, near_pos int"
    dealt = own.repartitionByRange(*names).sortWithinPartitions(*names)
    linked = materialize(dealt.mapInArrow(run, schema))
    discard(*used)
    heads: dict[int, tuple] = {}
    at, start, ends = None, (), {}
    left = linked.where("kind > 1").orderBy("task", "kind", "doc_id", "pos").select("task", "kind", "hash", "doc_id", "pos").collect()
    of_task: dict[int, list] = {}
    for r in left:
        of_task.setdefault(r.task, []).append(r)
    for task in sorted(of_task):
        rows = of_task[task]
        if at is not None:
            heads[task] = (at, start, sorted(ends.items())[-2:])
        if rows[0]["hash"] != at:
            at, start, ends = rows[0]["hash"], (rows[0].doc_id, rows[0].pos), {}
        for r in rows[1:]:
            ends[r.doc_id] = r.pos
    # Two places for each task at most.
    shared = linked.sparkSession.sparkContext.broadcast(heads)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, task, h, doc = (b.column(c).to_numpy() for c in ("kind", "task", "hash", "doc_id"))
            known, near = (np.array(b.column(c).is_valid()) for c in ("first_id", "near_id"))
            got = [b.column(c) for c in out[5:]]
            if (kind == 1).any():
                got = [np.array(c.fill_null(-1)) for c in got]
                for t in np.unique(task[kind == 1]):
                    at, start, ends = shared.value.get(int(t), (None, (), ()))
                    later = np.flatnonzero((kind == 1) & (task == t) & (h == at) & (doc > start[0])) if start else ()
                    if not len(later):
                        continue
                    for c, value in zip(got[:2], start, strict=True):
                        c[later] = value
                    for end in ends:
                        i = later[~near[later] & (doc[later] > end[0])]
                        for c, value in zip(got[2:], end, strict=True):
                            c[i] = value
                    known[later] = True
                got = [pa.array(c, k) for c, k in zip(got, kinds[5:], strict=True)]
            keep = pa.array(known)
            columns = [b.column("doc_id"), b.column("pos"), *got]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], out[3:])

    places = linked.where("kind < 2")
    found = materialize(places.mapInArrow(settle, "doc_id long, pos int, first_id long, first_pos int, near_id long, near_pos int"))
    discard(linked)
    return found


def chain(pos: np.ndarray, src: np.ndarray) -> list[np.ndarray]:
    """Index arrays of the best chains of matches of two documents, in order of ``pos``; no match is in two of them.

    A chain may follow any match that ends before it in both documents. The cost of the words between splits into a part
    of either match, so the best predecessor is a maximum over a prefix of the source's positions: a Fenwick tree.
    """
    order = np.lexsort((src, pos))
    pos, src = pos[order], src[order]
    shift = pos - src
    if (shift == shift[0]).all() and (np.diff(pos) * 2 * COST <= WORTH).all() and (np.diff(pos) > 0).all():
        return [order]
    ranks = np.unique(src, return_inverse=True)[1] + 1
    size = int(ranks.max())
    best, who = [-np.inf] * (size + 1), [-1] * (size + 1)
    score, back, waiting = [0.0] * len(pos), [-1] * len(pos), deque()
    for i, (p, s, r) in enumerate(zip(pos.tolist(), src.tolist(), ranks.tolist(), strict=True)):
        while waiting and waiting[0][0] < p:
            # Matches at earlier positions enter the tree; those at the same one must not precede each other.
            _, value, k, j = waiting.popleft()
            while k <= size:
                if value > best[k]:
                    best[k], who[k] = value, j
                k += k & -k
        top, k, j = -np.inf, r - 1, -1
        while k:
            if best[k] > top:
                top, j = best[k], who[k]
            k -= k & -k
        here = COST * (p + s)
        gain = top - here
        score[i] = WORTH + (gain if gain > 0 else 0.0)
        back[i] = j if gain > 0 else -1
        waiting.append((p, score[i] + here, r, i))
    chains, used = [], [False] * len(pos)
    for i in np.argsort(-np.array(score), kind="stable").tolist():
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(i)
            i = back[i]
        if own:
            chains.append(order[own[::-1]])
    return chains


def chains(found: DataFrame, least: int = LEAD) -> DataFrame:
    """(doc_id, source_id, pos array, source_pos array) of every chain that spans ``least`` words in both documents.
    A chain is cut where more than ``GRID`` words of either document lie between two seeds."""

    def one(doc: int, source: int, pos: np.ndarray, src: np.ndarray):
        if pos.max() - pos.min() + SHINGLE < least:
            return
        for whole in chain(pos, src):
            if len(whole) < 2:
                continue
            far = np.maximum(np.diff(pos[whole]), np.diff(src[whole])) > SHINGLE + GRID
            for c in np.split(whole, np.flatnonzero(far) + 1) if far.any() else [whole]:
                if min(pos[c[-1]] - pos[c[0]], src[c[-1]] - src[c[0]]) + SHINGLE >= least:
                    yield doc, source, pos[c].tolist(), src[c].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "source_id", "pos", "source_pos"]
        held = [np.empty(0, np.int64) for _ in names]
        for b in (*batches, None):
            if b is not None:
                held = [np.r_[x, b.column(n).to_numpy()] for x, n in zip(held, names, strict=True)]
            doc, source, pos, src = held
            edge = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(source) != 0)]) if len(doc) else np.empty(0, int)
            ends = np.r_[edge[1:], len(doc)]
            if b is not None:  # the last group may go on
                edge, ends = edge[:-1], ends[:-1]
            size = ends - edge
            if len(edge):
                # Groups that are one chain as they stand need no tree.
                step, other = np.diff(pos[: ends[-1]], prepend=0), np.diff(src[: ends[-1]], prepend=0)
                turn = (step != other) | (step <= 0) | (2 * COST * step > WORTH)
                turn[edge] = False
                plain = np.add.reduceat(turn.astype(np.int64), edge) == 0
                span = pos[ends - 1] - pos[edge] + SHINGLE
                whole = np.flatnonzero(plain & (size > 1) & (span >= least))
                if len(whole):
                    take = np.repeat(edge[whole] - (np.cumsum(size[whole]) - size[whole]), size[whole]) + np.arange(size[whole].sum())
                    offsets = pa.array(np.r_[0, np.cumsum(size[whole])].astype(np.int32))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[take].astype(np.int32))) for x in (pos, src)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[edge[whole]]), pa.array(source[edge[whole]]), *lists], names)
                out, rest = [], ~plain & (size > 1)
                for at, end in zip(edge[rest].tolist(), ends[rest].tolist(), strict=True):
                    out += one(int(doc[at]), int(source[at]), pos[at:end], src[at:end])
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                    columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names)
            if len(ends):
                held = [x[ends[-1] :] for x in held]

    dealt = found.repartition("doc_id", "source_id").sortWithinPartitions("doc_id", "source_id", "pos")
    return dealt.mapInArrow(run, "doc_id long, source_id long, pos array<int>, source_pos array<int>")


def cut_words(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, lo, hi, words array<int>): hashes of the words ``lo`` to ``hi`` of documents, for (doc_id, parts) with distinct (lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            out = []
            for doc, text, parts in zip(b.column("doc_id").to_pylist(), utf8(b), b.column("parts").to_pylist(), strict=True):
                h = (words([text])[0] >> np.uint64(33)).astype(np.int32)
                out += [(doc, x["lo"], x["hi"], h[x["lo"] : x["hi"]]) for x in parts]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lo", "hi", "words"])

    rows = docs.select("doc_id", "text").where("doc_id is not null").join(parts, "doc_id")
    return rows.mapInArrow(run, "doc_id long, lo int, hi int, words array<int>")


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two short word lists. Rows of the table are bits of whole numbers: a bit that is
    not set tells that the subsequence grows there."""
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    j = 0
    while j < len(a) - i and j < len(b) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    found = [(k, k) for k in range(i)]
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    places: dict[int, int] = {}
    for k, word in enumerate(x):
        places[word] = places.get(word, 0) | 1 << k
    if x and not places.keys().isdisjoint(y):
        whole = (1 << len(x)) - 1
        rows = [whole]
        for word in y:
            same = rows[-1] & places.get(word, 0)
            rows.append((rows[-1] + same | rows[-1] - same) & whole)
        p, q, inner = len(x), len(y), []
        while p and q:
            bit = 1 << p - 1
            if rows[q] & bit:
                p -= 1
            elif rows[q - 1] & bit:
                p, q = p - 1, q - 1
                inner.append((i + p, i + q))
            else:
                q -= 1
        found += inner[::-1]
    return found + [(len(a) - k, len(b) - k) for k in range(j, 0, -1)]


def align(a: np.ndarray, b: np.ndarray, pos: np.ndarray, src: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that agree in both word arrays, in order: between the seeds of a chain and beyond its ends."""
    near = MARGIN + GRID
    p, s = int(pos[0]), int(src[0])
    n = min(near, p, s)
    other = np.flatnonzero(a[p - n : p] != b[s - n : s])
    k = n - 1 - int(other[-1]) if len(other) else n
    # k words before the first seed agree; what stands before them is searched for more.
    front, back = a[max(0, p - near) : p - k].tolist(), b[max(0, s - near) : s - k].tolist()
    left = [(p - k - 1 - i, s - k - 1 - j) for i, j in reversed(_common(front[::-1], back[::-1]))]
    pieces = [np.array(left, np.int64).reshape(-1, 2), np.arange(-k, 0)[:, None] + (p, s)]
    whole, shift = int(pos[-1]) - p, s - p
    if int(src[-1]) - s == whole and (src - pos == shift).all() and (a[p : p + whole] == b[s : s + whole]).all():
        pieces.append(np.arange(whole)[:, None] + (p, s))
    else:
        for p, q, s, t in zip(pos.tolist(), pos[1:].tolist(), src.tolist(), src[1:].tolist(), strict=False):
            pieces.append(np.array(_common(a[p:q].tolist(), b[s:t].tolist()), np.int64).reshape(-1, 2) + (p, s))
    p, s = int(pos[-1]), int(src[-1])
    x, y = a[p : p + SHINGLE + near], b[s : s + SHINGLE + near]
    n = min(len(x), len(y))
    other = np.flatnonzero(x[:n] != y[:n])
    k = int(other[0]) if len(other) else n
    pieces.append(np.arange(k)[:, None] + (p, s))
    pieces.append(np.array(_common(x[k:].tolist(), y[k:].tolist()), np.int64).reshape(-1, 2) + (p + k, s + k))
    at = np.concatenate(pieces)
    return at[:, 0], at[:, 1]


def _longest(x: np.ndarray, y: np.ndarray, least: int, similar: float) -> tuple[int, int] | None:
    """First and last place of the longest run of agreeing words that has ``least`` words and is alike by ``similar``."""
    n, best, found = len(x), 0, None
    for at in range(0, n, 64):
        # Strips of starts, so that the tables stay small.
        i = slice(at, at + 64)
        same = np.arange(n) - np.arange(n)[i, None] + 1
        span, other = x - x[i, None] + 1, y - y[i, None] + 1
        good = (np.minimum(span, other) >= least) & (same >= similar * np.maximum(span, other) - 1e-9)
        longest = np.where(good, same, 0)
        k = int(longest.argmax())
        if longest.flat[k] > best:
            best, found = int(longest.flat[k]), (at + k // n, k % n)
    return found


#: Agreeing words whose runs are all tested; longer alignments are cut at their worst gap first.
TESTED = 1000


def segments(x: np.ndarray, y: np.ndarray, least: int = LEAST, similar: float = SIMILAR) -> list[tuple[int, int]]:
    """First and last places, in an alignment, of its passages: disjoint, ``least`` words long and alike by ``similar``.

    The best run by one for a word that agrees and minus two for one that doesn't is taken first; one that isn't alike is
    cut down to its longest run that is, and what lies on either side is searched in turn.
    """
    done, todo = [], [(0, len(x))]
    gap = np.r_[0, np.maximum(np.diff(x), np.diff(y)) - 1] if len(x) else np.empty(0, int)
    while todo:
        at, end = todo.pop()
        if end - at < similar * least:
            continue
        total = np.cumsum(1 - 2 * gap[at:end])
        before = total - 1
        low = np.minimum.accumulate(before)
        j = int((total - low).argmax())
        i = at + int(before[: j + 1].argmin())
        j += at
        width = lambda v: int(v[j] - v[i]) + 1  # noqa: B023, E731
        short = min(width(x), width(y)) < least
        if not short and j - i + 1 >= similar * max(width(x), width(y)) - 1e-9:
            found = (i, j)
        else:
            lo, hi = i, j + 1
            if short:
                lo = max(at, int(np.searchsorted(x, x[i] - least)))
                hi = min(end, int(np.searchsorted(x, x[j] + least, "right")))
            if hi - lo > TESTED:
                cut = lo + 1 + int(gap[lo + 1 : hi].argmax())
                todo += [(at, cut), (cut, end)]
                continue
            found = _longest(x[lo:hi], y[lo:hi], least, similar)
            if found is None:
                todo += [(at, i), (j + 1, end)]
                continue
            found = (found[0] + lo, found[1] + lo)
        done.append(found)
        todo += [(at, found[0]), (found[1] + 1, end)]
    return sorted(done)


def repeated_passages(docs: DataFrame, least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, start, end, source_id, source_start, source_end, n_words, similarity) of passages of ``least`` words or more
    that an earlier document (smaller doc_id) has too, alike by ``similar``; positions count words, ends exclusive.

    Null ids are ignored, null or short texts have no passages, rows that repeat a doc_id count as one document, and whole
    copies are passages of their own. A passage that many documents share is reported once for each but the first. Seeds that the
    first documents leave uncovered, and that lie close enough together for a passage, are looked up in the nearest document before,
    then in all of them (``_all_earlier``). An empty table gives no rows; extra columns are not read.
    """
    linked = matches(docs)
    firsts = linked.select("doc_id", "pos", F.col("first_id").alias("source_id"), F.col("first_pos").alias("source_pos"))
    found = _passages(docs, firsts, least, similar)
    parts, span = [found], int(similar * least)
    rest = materialize(_open_runs(linked, found, span))
    used = [linked, rest]
    near = rest.where("near_id <> first_id or near_pos <> first_pos")
    near = near.select("doc_id", "pos", F.col("near_id").alias("source_id"), F.col("near_pos").alias("source_pos"))
    near = materialize(_open_runs(near, found, span))
    used.append(near)
    if not rest.isEmpty():
        # Texts are dealt once for all that follows.
        keys = materialize(rest.select(*SEED).distinct())
        shared = materialize(linked.join(keys, SEED, "left_semi").select(*SEED, "doc_id", "pos"))
        docs = materialize(_holders(docs, shared, keys))
        used += [keys, shared, docs]
        parts.append(_passages(docs, near, least, similar))
        rest = materialize(_open_runs(rest, parts[-1], span))
        used.append(rest)
        runs = materialize(_runs(_places(docs, shared, rest)))
        used.append(runs)
        within = materialize(_within_runs(rest, runs))
        used.append(within)
        if not within.isEmpty():
            parts.append(_passages(docs, within, least, similar))
            rest = materialize(_open_runs(rest, parts[-1], span))
            used.append(rest)
        far = _all_earlier(docs, rest, runs)
        used.append(far)
        if not far.isEmpty():
            parts.append(_passages(docs, far, least, similar, FAR_LEAD))
    discard(*used)
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


#: A hash is named by its first place.
SEED = ["first_id", "first_pos"]


def _holders(docs: DataFrame, shared: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents that have a seed of ``keys``."""
    ids = shared.select("doc_id").union(keys.select("first_id")).distinct()
    return docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")


def _places(docs: DataFrame, shared: DataFrame, rest: DataFrame) -> DataFrame:
    """(first_id, first_pos, doc_id, pos): all places in all documents of the seeds that ``rest`` has, those repeated in their
    first documents too, which ``shared`` doesn't hold."""
    keys = materialize(rest.select(*SEED).distinct())
    firsts = materialize(seeds(docs.join(keys.select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi")))
    named = firsts.join(keys, (F.col("doc_id") == F.col("first_id")) & (F.col("pos") == F.col("first_pos")))
    own = firsts.join(named.select("hash", "doc_id", *SEED).distinct(), ["hash", "doc_id"])
    columns = [*SEED, "doc_id", "pos"]
    places = materialize(shared.join(keys, SEED, "left_semi").select(*columns).union(own.select(*columns)).distinct())
    discard(keys, firsts)
    return places


def _runs(places: DataFrame) -> DataFrame:
    """(first_id, first_pos, doc_id, lo, hi, n, step): runs of ``n`` places of one seed at equal steps of a shingle at most, from
    ``lo`` to ``hi``. All words of such a run follow from its seed; a place by itself is a run of one."""
    order = Window.partitionBy("doc_id", *SEED).orderBy("pos")
    rows = places.withColumn("by", F.col("pos") - F.lag("pos").over(order)).withColumn("before", F.lag("by").over(order))
    new = F.col("by").isNull() | (F.col("by") > SHINGLE) | ((F.col("before") <= SHINGLE) & (F.col("by") != F.col("before")))
    rows = rows.withColumn("run", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(order))
    runs = rows.groupBy("doc_id", *SEED, "run").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"))
    step = F.when(F.col("n") > 1, ((F.col("hi") - F.col("lo")) / (F.col("n") - 1)).cast("int")).otherwise(0)
    return runs.withColumn("step", step).drop("run")


def _within_runs(rest: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, pos, source_id, source_pos): seeds of runs by the longest run of an earlier document, laid out from either end
    and repeated where the later run is longer. What lies within a run needs no other source."""
    before = Window.partitionBy(*SEED, "step").orderBy("doc_id").rangeBetween(Window.unboundedPreceding, -1)
    longest = F.max(F.struct("n", (-F.col("doc_id")).alias("source"), F.col("lo").alias("from"), F.col("hi").alias("to"))).over(before)
    known = runs.where("n > 1").withColumn("s", longest).where("s is not null")
    rows = rest.select("doc_id", "pos", *SEED).join(known, ["doc_id", *SEED]).where("lo <= pos and pos <= hi")
    ahead = F.expr("s.`from` + step * (cast((pos - lo) / step as int) % s.n)")
    back = F.expr("s.`to` - step * (cast((hi - pos) / step as int) % s.n)")
    rows = rows.withColumn("source_pos", F.explode(F.array_distinct(F.array(ahead.cast("int"), back.cast("int")))))
    # A later run that is not longer lies in the earlier one as it stands.
    rows = rows.where((F.col("n") > F.col("s.n")) | (F.col("source_pos") == ahead))
    return rows.select("doc_id", "pos", (-F.col("s.source")).alias("source_id"), "source_pos")


def _all_earlier(docs: DataFrame, rest: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, pos, source_id, source_pos): the open seeds ``rest`` with all their places in every earlier document that can
    share a chain of ``FAR_LEAD`` words with them. Of runs the two ends count, and the places that far inside of them: what crosses
    no end is found by ``_within_runs``.

    Such a chain holds two seeds that lie ``FAR_LEAD`` words apart or as little more as one gap allows; documents meet by pairs
    of seeds between which they can agree (``_alike``), so that seeds and pairs that very many have bring no rows by themselves."""
    inner = F.expr(f"step * cast(ceil({FAR_LEAD - SHINGLE} / step) as int)")
    places = F.array("lo", "hi", F.least("hi", F.col("lo") + inner), F.greatest("lo", F.col("hi") - inner))
    places = F.when(F.col("n") > 1, F.array_distinct(places)).otherwise(F.array("lo"))
    ends = runs.withColumn("pos", F.explode(places))
    ends = ends.select(*SEED, "doc_id", F.col("lo").alias("run"), "pos", F.col("pos").isin(F.col("lo"), F.col("hi")).alias("outer"))
    still = rest.select("doc_id", "pos", *SEED, F.lit(True).alias("open")).distinct()
    ends = materialize(ends.join(still, ["doc_id", "pos", *SEED], "left").fillna(False, ["open"]))
    reach = FAR_LEAD + GRID
    ahead = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(int(STRETCH * FAR_LEAD) - SHINGLE, int((reach + SHINGLE) / STRETCH))
    twos = ends.withColumn("twos", F.collect_set(F.struct(*SEED, "run", "pos", "open")).over(ahead)).withColumn("two", F.explode("twos"))
    apart = (F.col("two.pos") - F.col("pos")).between(FAR_LEAD - SHINGLE, reach)
    within = F.struct(*SEED, "run") == F.struct("two.first_id", "two.first_pos", "two.run")
    twos = twos.where(~within).select(
        F.xxhash64(*SEED, "two.first_id", "two.first_pos").alias("key"),
        "doc_id",
        F.col("pos").alias("lo"),
        (F.col("two.pos") + SHINGLE).alias("hi"),
        ((F.col("open") | F.col("two.open")) & apart).alias("open"),
    )
    twos = materialize(twos)
    shared = twos.groupBy("key").agg(
        F.min("doc_id").alias("least"), F.max(F.when(F.col("open"), F.col("doc_id"))).alias("last"), F.count("*").alias("n")
    )
    # Rows that have no open one after them, or none before them, meet nothing.
    met = twos.join(shared.where("least < last"), "key").where("doc_id < last or open")
    pairs = _alike(docs, met.select("key", "doc_id", "lo", "hi", F.col("open") & (F.col("doc_id") > F.col("least")), "n"))
    # Chains are laid through the ends alone: what lies inside would tie one end of a run to the other of a longer one.
    own = ends.where("open and outer").select("doc_id", "pos", *SEED)
    source = ends.where("outer").select(F.col("doc_id").alias("source_id"), F.col("pos").alias("source_pos"), *SEED)
    found = materialize(pairs.join(own, "doc_id").join(source, ["source_id", *SEED]).select("doc_id", "pos", "source_id", "source_pos"))
    discard(ends, twos, pairs)
    return found


#: Share of the words that two documents must have in common between two seeds of a chain, in any order. A passage whose seeds are
#: all open has beyond its outermost ones no ten words in a row that agree, so it is alike by 0.66 between two of them at least.
STRETCH = 0.6
#: Classes of words that are counted, and rows of one pair of seeds in a block.
BAG, BLOCK = 256, 4096


def _alike(docs: DataFrame, twos: DataFrame) -> DataFrame:
    """(doc_id, source_id): open pairs of seeds (key, doc_id, lo, hi, open, n) with the earlier documents that have the same pair and
    ``STRETCH`` of the words from ``lo`` to ``hi`` as well. Rows are compared in blocks within tasks, those that ``n`` rows share
    a key with in many, so that neither rows nor memory grow with the square of a key's rows."""
    twos = twos.toDF("key", "doc_id", "lo", "hi", "open", "n")
    parts = twos.groupBy("doc_id").agg(F.collect_list(F.struct("key", "lo", "hi", "open", "n")).alias("parts"))
    parts = materialize(parts)
    names = ["key", "block", "open", "doc_id", "size", "bag"]
    schema = "key long, blocks int, open boolean, doc_id long, size int, bag binary"

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            for doc, text, own in zip(b.column("doc_id").to_pylist(), utf8(b), b.column("parts"), strict=True):
                h = (words([text])[0] >> np.uint64(33)).astype(np.int64) % BAG
                own = own.values
                key, lo, hi, is_open, n = (own.field(c) for c in ("key", "lo", "hi", "open", "n"))
                lo, hi = (x.to_numpy().astype(np.int64) for x in (lo, hi))
                for at in range(0, len(lo), BLOCK):
                    part = slice(at, at + BLOCK)
                    size = hi[part] - lo[part]
                    row = np.repeat(np.arange(len(size)), size)
                    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size - lo[part], size)
                    bag = np.bincount(row * BAG + h[place], minlength=len(size) * BAG).astype(np.uint8)
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BAG), len(size), [None, pa.py_buffer(bag)])
                    blocks = -(-n.slice(at, BLOCK).to_numpy() // BLOCK)
                    columns = [
                        key.slice(at, BLOCK),
                        pa.array(blocks.astype(np.int32)),
                        is_open.slice(at, BLOCK),
                        pa.array(np.full(len(size), doc)),
                        pa.array(size.astype(np.int32)),
                        raw.cast(pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "blocks", "open", "doc_id", "size", "bag"])

    def meet(doc, size, bag, source, length, other) -> Iterator[np.ndarray]:
        step = max(1, (1 << 17) // len(source))
        for at in range(0, len(doc), step):
            part = slice(at, at + step)
            both = np.minimum(size[part, None], length), np.maximum(size[part, None], length)
            i, j = np.nonzero((source < doc[part, None]) & (both[0] >= STRETCH * both[1]))
            if len(i):
                same = np.minimum(bag[part][i], other[j]).sum(1, dtype=np.int32)
                good = same >= STRETCH * np.maximum(size[part][i], length[j])
                if good.any():
                    yield np.unique(np.stack([doc[part][i[good]], source[j[good]]], 1), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            key, block, is_open, doc, size = (b.column(c).to_numpy(zero_copy_only=False) for c in names[:5])
            bag = np.frombuffer(b"".join(b.column("bag").to_pylist()), np.uint8).reshape(-1, BAG)
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])]) if len(key) else ()
            out = []
            for lo, hi in zip(edge, [*edge[1:], len(key)], strict=True):
                if (key[lo], block[lo]) != at:
                    at, held = (key[lo], block[lo]), []
                cut = lo + int(np.searchsorted(is_open[lo:hi], True))
                if cut > lo:
                    held.append((doc[lo:cut], size[lo:cut], bag[lo:cut]))
                if hi > cut and held:
                    held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                    out += meet(doc[cut:hi], size[cut:hi], bag[cut:hi], *held[0])
            if out:
                out = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["doc_id", "source_id"])

    rows = docs.select("doc_id", "text").where("doc_id is not null").join(parts, "doc_id").mapInArrow(bags, schema)
    # A row is a source in one block of its key; an open one meets the sources of every block.
    sources = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).withColumn("open", F.lit(False))
    opens = rows.where("open").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = sources.select(names).union(opens.select(names)).repartition("key", "block").sortWithinPartitions("key", "block", "open")
    found = materialize(dealt.mapInArrow(run, "doc_id long, source_id long").distinct())
    discard(parts)
    return found


def _open_runs(linked: DataFrame, passages: DataFrame, least: int) -> DataFrame:
    """The seeds outside of all ``passages`` that lie so close together that ``least`` words or more are covered."""
    spans = passages.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    covered = F.exists("spans", lambda x: (x["start"] <= F.col("pos")) & (F.col("pos") < x["end"]))
    rows = linked.join(spans, "doc_id", "left").where(F.col("spans").isNull() | ~covered).drop("spans")
    order = Window.partitionBy("doc_id").orderBy("pos")
    breaks = F.coalesce((F.col("pos") - F.lag("pos").over(order) > SHINGLE + GRID).cast("int"), F.lit(0))
    rows = rows.withColumn("apart", breaks).withColumn("run", F.sum("apart").over(order))
    run = Window.partitionBy("doc_id", "run")
    span = F.max("pos").over(run) - F.min("pos").over(run) + SHINGLE + WINDOW
    return rows.withColumn("span", span).where(F.col("span") >= least).drop("apart", "run", "span")


def _passages(docs: DataFrame, linked: DataFrame, least: int, similar: float, lead: int = LEAD) -> DataFrame:
    """The passages that the matches ``linked`` lead to, written to shared storage; what was written on the way is deleted."""
    chained = materialize(chains(linked, lead))
    first, last = F.element_at("pos", 1), F.element_at("pos", -1)
    s_first, s_last = F.element_at("source_pos", 1), F.element_at("source_pos", -1)
    found = chained.withColumns(
        {
            "lo": F.greatest(F.lit(0), first - MARGIN),
            "hi": last + SHINGLE + MARGIN,
            "s_lo": (F.greatest(F.lit(0), s_first - MARGIN) / GRID).cast("int") * GRID,
            "s_hi": F.ceil((s_last + SHINGLE + MARGIN) / GRID).cast("int") * GRID,
        }
    )
    wanted = found.select("doc_id", "lo", "hi").union(found.select("source_id", "s_lo", "s_hi")).distinct()
    # A document has no more distinct ranges than its own length allows. Written, their size is known: texts need not move for few.
    parts = materialize(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("parts")))
    cut = materialize(cut_words(docs, parts).dropDuplicates(["doc_id", "lo", "hi"]))
    discard(parts)
    key = F.concat_ws(":", "source_id", "s_lo", "s_hi")
    rows = materialize(found.join(cut, ["doc_id", "lo", "hi"]).withColumn("key", key))
    discard(chained)
    uses = rows.groupBy("key").agg(F.count("*").alias("n"))
    named = cut.select(F.concat_ws(":", "doc_id", "lo", "hi").alias("key"), F.col("words").alias("s_words"))
    both = join_frequent(rows, uses.join(named, "key"), "key", "n", rows.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            out = []
            lists = []
            for n in ("pos", "source_pos", "words", "s_words"):
                c = b.column(n)
                lists.append(np.split(np.asarray(c.flatten()), (np.asarray(c.offsets)[1:-1] - np.asarray(c.offsets)[0])))
            ends = (b.column(n).to_pylist() for n in ("doc_id", "source_id", "lo", "s_lo"))
            for doc, source, lo, s_lo, pos, src, a, c in zip(*ends, *lists, strict=True):
                x, y = align(a, c, pos - lo, src - s_lo)
                for i, j in segments(x, y, least, similar):
                    at, end, at2, end2 = (int(v) for v in (x[i], x[j] + 1, y[i], y[j] + 1))
                    share = (j - i + 1) / max(end - at, end2 - at2)
                    out.append((doc, at + lo, end + lo, source, at2 + s_lo, end2 + s_lo, end - at, share))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, list(_OUT))

    schema = ", ".join(f"{n} {k}" for n, k in _OUT.items())
    columns = ["doc_id", "source_id", "pos", "source_pos", "lo", "s_lo", "words", "s_words"]
    # Parts of one chain may extend to the same passage.
    passages = materialize(both.select(columns).mapInArrow(run, schema).dropDuplicates(list(_OUT)[:6]))
    discard(cut, rows)
    return passages


_OUT = {
    "doc_id": "long",
    "start": "int",
    "end": "int",
    "source_id": "long",
    "source_start": "int",
    "source_end": "int",
    "n_words": "int",
    "similarity": "double",
}


def without_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with its columns, where every reported passage is cut out of the later documents; texts of which no word
    is left go. n_chars, if there, follows a text that was cut. Null texts, rows without a doc_id and any further columns stay;
    rows that repeat a doc_id are cut alike, within their own length."""
    names, counted = docs.columns, "n_chars" in docs.columns
    (marks,) = fresh(names, "cuts")
    cuts = passages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(marks))
    rows = docs.join(cuts, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, keep, was_cut = [], [], []
            for text, cut in zip(utf8(b), b.column(marks).to_pylist(), strict=True):
                if cut:
                    _, _, start, end = words([text])
                    parts, at = [], 0
                    for c in cut:
                        if c["start"] < len(end) and (stop := int(end[min(c["end"], len(end)) - 1])) > at:
                            parts.append(text[at : max(at, start[c["start"]])])
                            at = stop
                    text = b"".join([*parts, text[at:]])
                keep.append(not cut or bool(text.strip()))
                texts.append(text.decode())
                was_cut.append(bool(cut))
            columns = []
            for n in names:
                c = b.column(n)
                if n == "text":
                    null = c.is_null().to_pylist()
                    c = pa.array([None if z else x for x, z in zip(texts, null, strict=True)], pa.string())
                elif n == "n_chars" and counted:
                    c = pa.array([len(x) if y else n for x, y, n in zip(texts, was_cut, c.to_pylist(), strict=True)], c.type)
                columns.append(c)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return rows.mapInArrow(run, docs.schema)
