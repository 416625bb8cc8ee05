"""Cheapest repair of conversations whose roles must read ``(s?(ua)+)?``, as a shortest path through composed automata.

The input acceptor is the chain of a conversation's turns, the edit transducer keeps, rerolls, deletes or inserts, the grammar
acceptor knows the four ``GRAMMAR`` states. Their composition is never built: ``arcs`` gives what leaves a state once it is
reached, and states are reached in topological order, by turn and by the number of insertions since the last turn (more than two
would return to a state at a cost). Weights are (cost, labels), compared in this order. Two paths between the same states with
equal costs have labels of which neither begins the other, since further labels would be insertions and cost more; so the order
is kept when labels are put before or behind, and segments of a conversation can be solved apart and joined.

Rows are dealt by ranges of (conversation, turn, role, text), so that a conversation of any length lies in several tasks. What is
whole within a task is settled there; of what is cut, each segment's best path between any two grammar states goes on, and one
pass over the segments (not the rows) of a conversation chooses among them. The digest of a cut conversation is then taken by
streaming its kept rows once in order, as a SHA-256 must be.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

#: Grammar states: nothing yet, after the system's turn, after a user's, after an assistant's; what each takes, where it goes.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
START, FINAL = 0, (0, 3)
LEGAL = ("su", "ua", "au")
ROLE = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Faults of a row.
SOUND, CUT_OFF, BLANK, DUPLICATE = 0, 1, 2, 3
#: Rows, and bytes of text, of one segment.
SEGMENT, SEGMENT_BYTES = 4096, 16 << 20

Vector = dict[int, tuple[int, str]]


def arcs(state: int, symbol: tuple[str, int] | None) -> Iterator[tuple[str, int, int]]:
    """(label, cost, next grammar state) of the arcs that leave a state of the composition; ``symbol`` is the turn that is
    read, (role initial, fault), or None for an insertion."""
    takes = GRAMMAR[state]
    if symbol is None:
        yield from (("I", INSERT, to) for x, to in takes.items() if x in ROLE)
        return
    initial, fault = symbol
    yield "D", DELETE, state
    if fault < BLANK:
        more = TRUNCATED if fault == CUT_OFF else 0
        if initial in takes:
            yield "K", more, takes[initial]
        yield from (("R", REROLE + more, to) for x, to in takes.items() if x in ROLE)


def _relax(into: Vector, state: int, weight: tuple[int, str]) -> None:
    if state not in into or weight < into[state]:
        into[state] = weight


def insertions(reached: Vector) -> Vector:
    """``reached`` with up to two insertions behind."""
    out = dict(reached)
    for _ in range(2):
        for state, (cost, labels) in list(out.items()):
            for label, price, to in arcs(state, None):
                _relax(out, to, (cost + price, labels + label))
    return out


def step(reached: Vector, symbol: tuple[str, int]) -> Vector:
    """Insertions, then one turn."""
    out: Vector = {}
    for state, (cost, labels) in insertions(reached).items():
        for label, price, to in arcs(state, symbol):
            _relax(out, to, (cost + price, labels + label))
    return out


def path(symbols: Iterable[tuple[str, int]], start: int = START) -> Vector:
    """Best path from ``start`` over all symbols to each state. What all paths begin with is put aside on the way, so that
    labels aren't copied over and over."""
    settled, reached = [], {start: (0, "")}
    for n, symbol in enumerate(symbols):
        reached = step(reached, symbol)
        if n % 64 == 63:
            same = os.path.commonprefix([labels for _, labels in reached.values()])
            settled.append(same)
            reached = {s: (c, labels[len(same) :]) for s, (c, labels) in reached.items()}
    head = "".join(settled)
    return {s: (c, head + labels) for s, (c, labels) in reached.items()}


def best(reached: Vector) -> tuple[int, str, int]:
    """(cost, labels, state before the last insertions) of the best path that ends in a final state."""
    ends = []
    for state, weight in reached.items():
        closed = insertions({state: weight})
        ends += [(*closed[f], state) for f in FINAL if f in closed]
    return min(ends)


@lru_cache(1 << 16)
def solve(symbols: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    return best(path(symbols))[:2]


def apply(audit: str, turns: Iterable[tuple[str, str]], state: int = START) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) rows that the labels make of the turns, from a grammar state on."""
    rows = iter(turns)
    for label in audit:
        if label == "D":
            next(rows)
            continue
        role, text = next(rows) if label in "KR" else ("", "")
        if label == "K":
            state = GRAMMAR[state][role[:1]]
        else:
            initial = next(x for x in GRAMMAR[state] if x in ROLE)
            role, state = ROLE[initial], GRAMMAR[state][initial]
        yield role, text


def digest(rows: Iterable[tuple[str, str]], into, first: bool = True) -> bool:
    """Feed repaired rows to a hash, newline-joined; says whether nothing has been fed yet."""
    for role, text in rows:
        into.update(("" if first else "\n").encode() + role.encode() + b":" + text.encode())
        first = False
    return first


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times) after the damage by crc32(``conv_id:turn``) % 20: ``times`` is 0 for a dropped row and
    2 for a repeated one. Nulls in role and text, and in the text that is hashed, are one space; an empty table stays empty;
    further columns are not read."""
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    key = F.concat(conv, F.lit(":"), turn)
    kind, role, text = F.crc32(key.cast("binary")) % 20, F.coalesce("role", space), F.coalesce("text", space)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )


class Segment:
    """Consecutive rows of a conversation in one task, and what is counted of them."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.symbols, self.bytes = conv_id, [], [], 0
        self.low = self.high = self.head = self.tail = None
        self.distinct = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.symbols and self.symbols[-1][0] + role[:1] not in LEGAL:
            self.illegal += 1
        self.turns.append((role, text))
        self.symbols.append((role[:1], fault))
        self.bytes += len(text)
        self.tail = (turn, role, text)
        self.head = self.head or self.tail

    def record(self, at: tuple[int, int], whole: bool) -> dict:
        faults = [f for _, f in self.symbols]
        out = {"conv_id": self.conv_id, "part": at[0], "seg": at[1], "whole": whole, "low": self.low, "high": self.high}
        out |= {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT_OFF)}
        out |= {"turns": self.distinct, "illegal": self.illegal, "n": len(faults)}
        if whole:
            cost, audit = solve(tuple(self.symbols)) if len(self.symbols) < 64 else best(path(self.symbols))[:2]
            sha = hashlib.sha256()
            digest(apply(audit, self.turns), sha)
            out |= {"cost": cost, "audit": audit, "sha256": sha.hexdigest()}
        elif faults:
            ends = [hashlib.sha256(repr(x).encode("utf-8", "surrogatepass")).digest() for x in (self.head, self.tail)]
            role, text = zip(*self.turns, strict=True)
            out |= {"head": ends[0], "tail": ends[1], "roles": list(role), "texts": list(text), "faults": faults}
        return out


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_FOUND = {"conv_id": "long", "part": "int", "seg": "int", "whole": "boolean", **dict.fromkeys(_COUNTS, "long")}
_FOUND |= dict.fromkeys(("turns", "low", "high", "n", "cost"), "long") | {"audit": "string", "sha256": "string"}
_FOUND |= {"head": "binary", "tail": "binary", "roles": "array<string>", "texts": "array<string>", "faults": "array<int>"}
_SOLVED = {"conv_id": "long", "part": "int", "seg": "int"} | dict.fromkeys(("start", "end", "price"), "array<int>") | {"labels": "array<string>"}
_CHOSEN = {"part": "int", "seg": "int", "start": "int", "end": "int", "labels": "string", "price": "long"}
_REPAIRED = {"conv_id": "long", "cost": "long", "audit": "string", "sha256": "string"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
_ARROW |= {"array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in fields.items())


def _batches(records: Iterable[dict], fields: dict[str, str], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Records -> batches of at most ``rows`` of them."""
    out: list[dict] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in out], _ARROW[t]) for k, t in fields.items()], list(fields))

    for r in records:
        out.append(r)
        if len(out) == rows:
            yield batch()
            out = []
    if out:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch], *names: str, rows: int = 1024) -> Iterator[tuple]:
    for b in slices(batches, rows, "conversation_repair"):
        yield from zip(*(b.column(c).to_pylist() for c in names), strict=True)


def _segments(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """The sorted rows of a task -> conversations and segments of those that may reach beyond the task."""
    part = TaskContext.get().partitionId()

    def records() -> Iterator[dict]:
        now, before, cut, nth = None, None, True, 0
        for conv_id, turn, role, text, times, fault, again in _rows(
            batches, "conv_id", "turn", "role", "text", "times", "fault", "again"
        ):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield now.record((part, nth), not cut)
                    nth += 1
                now, before, cut = Segment(conv_id), None, now is None
            for _ in range(times):
                if len(now.turns) == segment or now.bytes >= SEGMENT_BYTES:
                    yield now.record((part, nth), False)
                    now, nth, cut = Segment(conv_id), nth + 1, True
                me = (turn, role, text)
                now.add(*me, DUPLICATE if fault < BLANK and (again or me == before) else fault)
                before = me
        if now is not None:
            yield now.record((part, nth), False)

    yield from _batches(records(), _FOUND)


def _solve_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best paths through each segment between all grammar states."""

    def records() -> Iterator[dict]:
        for conv_id, part, seg, roles, faults, repeats in _rows(batches, "conv_id", "part", "seg", "initials", "faults", "repeats"):
            symbols = list(zip(roles, faults, strict=True))
            if repeats:
                symbols[0] = (symbols[0][0], DUPLICATE)
            found = [(s, e, *w) for s in GRAMMAR for e, w in path(symbols, s).items()]
            columns = zip(("start", "end", "price", "labels"), zip(*found, strict=True), strict=True)
            yield {"conv_id": conv_id, "part": part, "seg": seg} | {k: list(v) for k, v in columns}

    yield from _batches(records(), _SOLVED, 8)


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in the order of their conversations -> the state each is entered in and its labels. Of a conversation, the best
    path to each state is held, without what all have in common, and two short lists for each segment."""

    def settle(back: list, reached: Vector) -> Iterator[dict]:
        state = best(reached)[2]
        cost, closing, _ = best({state: (0, "")})
        for part, seg, via in reversed(back):
            start, price = via[state]
            yield {"part": part, "seg": seg, "start": start, "end": state, "labels": closing, "price": price + cost}
            state, closing, cost = start, "", 0

    def records() -> Iterator[dict]:
        now, back, reached = None, [], {START: (0, "")}
        for conv_id, part, seg, *paths in _rows(batches, "conv_id", "part", "seg", "start", "end", "price", "labels", rows=16):
            if back and conv_id != now:
                yield from settle(back, reached)
                back, reached = [], {START: (0, "")}
            now, via, new = conv_id, {}, {}
            for start, end, price, labels in zip(*paths, strict=True):
                if start in reached:
                    weight = (reached[start][0] + price, reached[start][1] + labels)
                    if end not in new or weight < new[end]:
                        new[end], via[end] = weight, (start, price)
            same = len(os.path.commonprefix([labels for _, labels in new.values()]))
            reached = {s: (cost, labels[same:]) for s, (cost, labels) in new.items()}
            back.append((part, seg, via))
        if back:
            yield from settle(back, reached)

    yield from _batches(records(), _CHOSEN)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order, with their labels and rows -> audit and digest of each conversation; rows are fed and forgotten."""

    def records() -> Iterator[dict]:
        now, sha, audit, cost, first = None, None, [], 0, True
        names = ("conv_id", "start", "labels", "price", "roles", "texts")
        for conv_id, start, labels, price, roles, texts in _rows(batches, *names, rows=4):
            if sha is not None and conv_id != now:
                yield {"conv_id": now, "cost": cost, "audit": "".join(audit), "sha256": sha.hexdigest()}
                sha = None
            if sha is None:
                now, sha, audit, cost, first = conv_id, hashlib.sha256(), [], 0, True
            first = digest(apply(labels, zip(roles, texts, strict=True), start), sha, first)
            audit.append(labels)
            cost += price
        if sha is not None:
            yield {"conv_id": now, "cost": cost, "audit": "".join(audit), "sha256": sha.hexdigest()}

    yield from _batches(records(), _REPAIRED)


def _same_conversation(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on conv_id, where nulls are equal."""
    other = right.withColumnRenamed("conv_id", "conv_id_")
    return left.join(other, F.col("conv_id").eqNullSafe(F.col("conv_id_")), how).drop("conv_id_")


def _joined(cut: DataFrame) -> DataFrame:
    """Whole conversations from the segments of those that reach over tasks."""
    order = ["conv_id", "part", "seg"]
    chain = Window.partitionBy("conv_id").orderBy("part", "seg")
    first, last = F.element_at("roles", 1), F.element_at("roles", -1)
    full = cut.where("n > 0")
    narrow = full.select(*order, "head", "tail", "low", "high", *(F.substring(c, 1, 1).alias(k) for c, k in ((first, "a"), (last, "z"))), F.element_at("faults", 1).alias("fault"))
    seen = F.max("high").over(chain.rowsBetween(Window.unboundedPreceding, -1))
    repeats = (F.col("head") == F.lag("tail").over(chain)) & (F.col("fault") < BLANK)
    meets = F.concat(F.lag("z").over(chain), "a")
    border = materialize(
        narrow.select(
            *order,
            F.coalesce(repeats, F.lit(False)).alias("repeats"),
            F.coalesce(~meets.isin(*LEGAL), F.lit(False)).cast("long").alias("more_illegal"),
            F.coalesce(F.col("low") == seen, F.lit(False)).cast("long").alias("shared_turn"),
            "fault",
        )
    )
    key = border.select("part", "seg", "repeats")
    symbols = full.select(*order, F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials"), "faults").join(key, ["part", "seg"])
    solved = materialize(symbols.select(*order, "initials", "faults", "repeats").mapInArrow(_solve_segments, _ddl(_SOLVED)))
    ordered = solved.repartition("conv_id").sortWithinPartitions(*order)
    chosen = materialize(ordered.mapInArrow(_choose, _ddl(_CHOSEN)))
    paths = F.arrays_zip("start", "end", "labels").alias("paths")
    own = F.filter("paths", lambda x: (x["start"] == F.col("entered")) & (x["end"] == F.col("left")))
    picked = chosen.select("part", "seg", F.col("start").alias("entered"), F.col("end").alias("left"), F.col("labels").alias("closing"), F.col("price"))
    picked = solved.select("part", "seg", paths).join(picked, ["part", "seg"])
    picked = picked.select("part", "seg", F.col("entered").alias("start"), F.concat(F.element_at(own, 1)["labels"], "closing").alias("labels"), "price")
    lines = full.select(*order, "roles", "texts").join(picked, ["part", "seg"])
    lines = lines.select(*order, "start", "labels", "price", "roles", "texts").repartition("conv_id").sortWithinPartitions(*order)
    repaired = lines.mapInArrow(_write, _ddl(_REPAIRED))
    sums = cut.join(border.drop("conv_id"), ["part", "seg"], "left").groupBy("conv_id").agg(
        F.sum("blank").alias("blank"),
        F.sum(F.col("duplicate") + F.when(F.col("repeats"), 1).otherwise(0)).alias("duplicate"),
        F.sum(F.col("truncated") - F.when(F.col("repeats") & (F.col("fault") == CUT_OFF), 1).otherwise(0)).alias("truncated"),
        F.sum(F.col("illegal") + F.coalesce("more_illegal", F.lit(0))).alias("illegal"),
        (F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - F.coalesce("shared_turn", F.lit(0)))).alias("gaps"),
    )
    out = _same_conversation(sums, repaired, "left")
    empty = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id",
        F.coalesce("gaps", F.lit(0)).alias("gaps"),
        *_COUNTS,
        F.coalesce("cost", F.lit(0)).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(empty)).alias("sha256"),
    )


def repair(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each conv_id: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256).

    ``conversations`` has (conv_id, turn, role, text, times), see ``damaged``; a row stands ``times`` times. Rows go by turn, nulls
    first, ties by role and text. Each row's first fault counts: blank, duplicate (role and text stand before in the
    conversation), truncated (no ``[.!?]`` at the end). Rows without a conv_id are one conversation; one all of whose rows are
    dropped has zeros, an empty audit and the hash of the empty string; an empty table gives no rows. Texts of any length are
    read whole, within a segment's bytes at a time; a label string must fit in one value, 2 GB. ``segment`` is the most rows of one."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    rows = conversations.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "times",
        F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT_OFF).alias("fault"),
        F.unhex(F.sha2(F.concat_ws("\n", "role", "text").cast("binary"), 256)).alias("same"),
    )
    # Role and text at several turns repeat from the second turn on; at one turn they stand next to each other.
    seen = rows.where(f"times > 0 and fault <> {BLANK}").groupBy("conv_id", "same").agg(F.min(place).alias("first"), F.max(place).alias("final"))
    seen = seen.where("first <> final").select("conv_id", F.col("same").alias("other"), "first")
    seen = seen.withColumnRenamed("conv_id", "conv_id_")
    both = F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("same") == F.col("other"))
    again = F.coalesce(place > F.col("first"), F.lit(False)).alias("again")
    rows = rows.join(seen, both, "left").select("conv_id", "turn", "role", "text", "times", "fault", again)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    # The last key deals out equal rows of one place.
    dealt = rows.repartitionByRange(*order, F.asc(F.substring("text", 1, 32)), F.asc(F.rand(7)))
    found = materialize(dealt.sortWithinPartitions(*order, "text").mapInArrow(lambda b: _segments(b, segment), _ddl(_FOUND)))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    whole = found.where("whole").select("conv_id", gaps, *_COUNTS, "cost", "audit", "sha256")
    return whole.unionByName(_joined(found.where("not whole")))
