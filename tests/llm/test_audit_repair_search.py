"""Filter audits, repaired conversations and the multi-index against plain versions, with their edge cases."""

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarisk.llm import conversation_repair as C
from tamarisk.llm import filter_audit, multi_index

EMPTY = hashlib.sha256(b"").hexdigest()
SPACES = " \t\n\x0b\x0c\r"


def repaired(rows):
    """A conversation's rows (turn, role, text) after damage -> the expected row, by trying all edits in order of cost."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(SPACES)[-1:]
        faults.append("b" if not last else "d" if (role, text) in seen else "" if last in ".!?" else "t")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    takes = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {}

    def go(i, state, inserted):
        """Cheapest (cost, labels, lines) from here on."""
        if (i, state, inserted) in best:
            return best[i, state, inserted]
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if inserted < 3:
            for x, to in takes[state].items():
                if x != "s":
                    c, a, out = go(i, to, inserted + 1)
                    found.append((c + 3, "I" + a, (("user:" if x == "u" else "assistant:"), *out)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, out = go(i + 1, state, 0)
            found.append((c + 4, "D" + a, out))
            if faults[i] not in ("b", "d"):
                more = 3 * (faults[i] == "t")
                for x, to in takes[state].items():
                    c, a, out = go(i + 1, to, 0)
                    if role[:1] == x:
                        found.append((c + more, "K" + a, (f"{role}:{text}", *out)))
                    if x != "s":
                        found.append((c + more + 3, "R" + a, (("user:" if x == "u" else "assistant:") + text, *out)))
        best[i, state, inserted] = min(found) if found else (10**9, "", ())
        return best[i, state, inserted]

    cost, audit, lines = go(0, 0, 0)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [faults.count(x) for x in "bdt"]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def hurt(rows):
    """(conv_id, turn, role, text) rows -> those of each conversation after the damage."""
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        mine = out.setdefault(conv, [])
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        mine += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


@pytest.fixture(scope="module")
def chats(spark):
    rnd = random.Random(3)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rnd.choice([1, 2, 3, 5, 9])):
            role = rnd.choice(["user", "user", "assistant", "assistant", "system", "admin", "x", "", None])
            text = rnd.choice(["Yes.", "No!", "cut", "cut \n", "  ", "", None, "so? ", "a\x85", "été. ."])
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 3, None]), role, text))
    for turn in range(130):
        rows.append((500, turn, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", f"Well {turn}.", "cut"])))
    rows += [(501, 7, "user", "Again.")] * 9 + [(502, None, None, None)] * 3
    return rows


@pytest.mark.parametrize("segment", [4096, 3])
def test_repairs_are_the_cheapest(spark, chats, segment):
    df = spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").withColumn("same", F.lit(1)).withColumn("fault", F.lit("x"))
    got = C.repair(C.damaged(df.repartition(3)), segment=segment).collect()
    want = {conv: repaired(rows) for conv, rows in hurt(chats).items()}
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == {
        k: v if hurt(chats)[k] else (0, 0, 0, 0, 0, 0, "", EMPTY) for k, v in want.items()
    }
    assert C.repair(C.damaged(df.limit(0))).count() == 0


def test_paths_put_aside_what_they_share():
    rnd = random.Random(8)
    for _ in range(40):
        symbols = [(rnd.choice("usax"), rnd.randrange(4)) for _ in range(rnd.choice([0, 1, 5, 90, 200]))]
        plain = {0: (0, "")}
        for s in symbols:
            plain = C.step(plain, s)
        assert C.path(symbols) == plain


def test_audit_of_edge_cases(spark):
    long = "word " * 60_000
    texts = [None, "", "Plain words here", "Plain words here", "AB cd #", long, " ".join(map(str, range(300))), "a\x85b\xa0c"]
    rows = [(i, t, None if i % 3 == 0 else "s", "z") for i, t in enumerate(texts)] + [(3, texts[3], "s", "z"), (None, texts[3], "t", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, same string")
    labels = spark.createDataFrame([(2, 1, 0), (2, 0, 1), (5, 1, None), (None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    flags = [
        (d, s or "", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "#" in t))
        for d, t, s, _ in rows
        for t in [t or ""]
        for w in [[x for x in t.replace("\n", " ").split(" ") if x]]
    ]
    later = [d is not None and any(o is not None and o < d and (u or "") == (t or "") for o, u, _, _ in rows) for d, t, _, _ in rows]
    flags = [(d, p, (*f, e)) for (d, p, f), e in zip(flags, later, strict=True)]
    good, toxic = {2, 5}, {2, 3}
    want = {}
    for part in {p for _, p, _ in flags}:
        mine = [(d, f) for d, p, f in flags if p == part]
        removed = {}
        for order in permutations(range(5)):
            for k, x in enumerate(order):
                gone = [d for d, f in mine if f[x] and not any(f[y] for y in order[:k])]
                removed[order, k] = (
                    sum(not any(f[y] for y in order[: k + 1]) for _, f in mine),
                    len(gone),
                    sum(f[x] for _, f in mine) - len(gone),
                    sum(f[x] and sum(f) == 1 for _, f in mine),
                    sum(d in good for d in gone),
                    sum(d in toxic for d in gone),
                )
        for (order, k), counts in removed.items():
            shapley = sum(v[1] for (o, j), v in removed.items() if o[j] == order[k])
            want[part, "".join("ABCDE"[y] for y in order), k + 1] = (*counts, shapley)
    got = filter_audit.audit(filter_audit.flagged(docs, labels)).collect()
    assert len(got) == len(want) == 120 * 5 * 3 and {tuple(r)[:3]: tuple(r)[3:] for r in got} == want
    assert filter_audit.audit(filter_audit.flagged(docs.limit(0), labels)).count() == 0
    assert filter_audit.audit(filter_audit.flagged(docs, labels.limit(0))).agg(F.sum("good_lost")).first()[0] == 0


def neighbours(ids, x, own, k):
    score = x @ x[own]
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[own]]
    return [(int(ids[j]), float(score[j])) for j in order[:k]]


def test_neighbours_within_the_radius(spark):
    """Tight groups, a hot vector, lengths of their own and loose directions: found as by comparing all."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    x = np.concatenate((np.repeat(centres, 40, 0) + 0.2 * rng.standard_normal((1600, 16)), rng.standard_normal((800, 16)), np.tile(centres[0], (900, 1))))
    x = x.astype(np.float32)
    ids = rng.permutation(len(x)) * 3
    df = spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), ids.tolist(), strict=True)), "vec_id long, embedding array<float>, n int")
    got = multi_index.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    hits = 0
    for q, mine in got.groupby("query_id"):
        mine = mine.sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and q not in mine.vec_id.tolist()
        want = neighbours(ids, x.astype(float), int(np.flatnonzero(ids == q)[0]), 20)
        assert mine[["score", "vec_id"]].apply(lambda r: (-r.score, r.vec_id), axis=1).is_monotonic_increasing
        floor = want[-1][1] - 1e-9
        hits += sum(s >= floor for s in mine.score)
        exact = dict(neighbours(ids, x.astype(float), int(np.flatnonzero(ids == q)[0]), len(x)))
        assert np.allclose(mine.score, [exact[v] for v in mine.vec_id], rtol=0, atol=1e-12)
    assert set(got.query_id) == {int(i) for i in ids if i % 20 == 0}
    assert hits >= 0.97 * len(got)


def test_neighbours_of_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0], [1.0, 0.0], [2.0, 0.5], [1.0, 0.0], [-1.0, 1.0], []]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(6, vectors[6], 0), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = multi_index.nearest(df, F.col("vec_id").isin(6, 9, 3)).collect()
    assert sorted(map(tuple, got)) == [(6, 1, 7, 2.0), (6, 2, 8, 1.0), (6, 3, 9, -1.0), (9, 1, 6, -1.0), (9, 2, 8, -1.0), (9, 3, 7, -1.5)]
    assert multi_index.nearest(df.limit(0), F.col("vec_id") == 6).count() == 0
    assert multi_index.nearest(df, F.col("vec_id") == -1).count() == 0
    assert multi_index.nearest(df.where("vec_id = 6"), F.col("vec_id") == 6).count() == 0


def test_recall_on_the_table(spark, sf):
    from tamarisk.llm.queries import queries

    got = queries()["op11_multi_index"](spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding.tolist()).astype(float)
    wanted = {q: {v for v, _ in neighbours(ids, x, i, 20)} for i, q in enumerate(ids.tolist()) if q % 20 == 0}
    assert set(got.query_id) == set(wanted)
    assert sum(len(wanted[q] & set(g.vec_id)) for q, g in got.groupby("query_id")) >= 0.95 * len(got)
