"""Whole queries and pipeline stages against plain versions that compare everything with everything."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tamarisk.llm import chain_dedup, cutting_stock, ecoc_language, ordinal_quality, queries, secret_ownership
from tamarisk.llm.common import materialize, table
from tamarisk.llm.features import ngram_counts

xxhash = pytest.importorskip("xxhash")


def lowest(ids, pairs):
    """The smallest id that each id reaches through pairs."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def test_components_of_fingerprints(spark, sf):
    got = queries.queries()["op8_simhash_ring"](spark, sf).collect()
    fp = {r.doc_id: int(r.fingerprint, 16) for r in got}
    ids = sorted(fp)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 3]
    assert near and {r.doc_id: r.component_id for r in got} == lowest(ids, near)


def test_blocks_of_one_key_find_every_link(spark, monkeypatch):
    from tamarisk.llm import shingle_bands

    rnd = random.Random(12)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for k in rnd.sample(range(120), rnd.choice([0, 1, 2, 3, 12])):
            own[k] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = shingle_bands.signatures(docs, 5).groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    known = {r.doc_id: r.cls for r in first.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(116)} for i, t in rows if i in known for w in [t.split()]}
    members = first.select(F.lit(1).cast("long").alias("key"), "cls", F.col("cls").alias("part"))
    wanted = lowest(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    back = {c: i for i, c in known.items()}
    for block in (512, 20):
        monkeypatch.setattr(shingle_bands, "BLOCK", block)
        found = shingle_bands.linked_within(members, docs, first, 5, 0.8).collect()
        assert lowest(sets, [(back[r.a], back[r.b]) for r in found]) == wanted
    assert len(set(wanted.values())) < len(wanted)


def test_grades_are_those_of_the_fitted_weights(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = ordinal_quality.fit(docs, labels.select("doc_id", grade.cast("long").alias("grade")))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = queries.queries()["op2_ordinal_quality"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        doc, feature = ordinal_quality.features([(text[r.doc_id] or "").encode()])
        score = sum(model.weights[f] for f in feature)
        above = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert r.expected_grade == pytest.approx(sum(above)) and r.tail == pytest.approx(above[-1]) and r.selected == (above[-1] >= queries.SELECT)


def test_grades_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    known = labels.select("doc_id", grade.cast("long").alias("grade")).where("grade is not null")
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 < 3
    model = ordinal_quality.fit(docs, known.where(~test))
    rows = ordinal_quality.score(docs, model).join(known.where(test), "doc_id").toPandas()
    good, tail = (rows.grade == 2).to_numpy(), rows["tail"].to_numpy()
    rank = np.argsort(np.argsort(tail)) + 1
    area = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert area > 0.98
    assert rows.expected_grade[rows.grade == 0].mean() < rows.expected_grade[rows.grade == 1].mean() < rows.expected_grade[rows.grade == 2].mean()


def test_languages_are_the_nearest_codewords(spark, sf, docs):
    model = ecoc_language.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.queries()["op7_ecoc_language"](spark, sf).collect()}
    for r in docs.collect():
        if not r.text or not any(map(str.isalpha, r.text)):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        n = ngram_counts(r.text.lower().encode(), ecoc_language.BITS)
        losses = []
        for word in model.code:
            loss = 0.0
            for j, bit in enumerate(word):
                margin = ((n @ model.weights[j].astype(float)) / max(1, n.sum()) - model.shift[j]) / model.scale[j]
                loss += model.bit_weight[j] * np.log1p(np.exp(-2 * margin * bit))
            losses.append(loss)
        assert got[r.doc_id][0] == model.languages[int(np.argmin(losses))] and 0 <= got[r.doc_id][1] <= 1


def runs(a, b, least):
    """(start, end) in ``a`` of maximal runs of ``least`` words that ``b`` has too."""
    at = defaultdict(list)
    for j in range(len(b) - least + 1):
        at[tuple(b[j : j + least])].append(j)
    return [(i, i + least) for i in range(len(a) - least + 1) if tuple(a[i : i + least]) in at]


def covered(spans, start, end):
    return all(any(s <= i < e for s, e in spans) for i in range(start, end))


def test_every_exact_passage_is_reported(spark):
    rnd = random.Random(21)
    vocabulary = [f"v{i}" for i in range(3000)]
    some = lambda n: rnd.choices(vocabulary, k=n)
    shared, rows = [some(rnd.randint(50, 120)) for _ in range(12)], []
    for i in range(120):
        parts = [some(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(shared)
            lo = rnd.choice([0, 0, rnd.randrange(len(p))])
            parts += [p[lo:], some(rnd.randint(1, 60))]
        rows.append((i, " ".join(w for p in parts for w in p)))
    found = defaultdict(list)
    texts = {i: t.split() for i, t in rows}
    for r in chain_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r.doc_id].append((r.start, r.end))
        x, y = texts[r.doc_id][r.start : r.end], texts[r.source_id][r.source_start : r.source_end]
        assert r.source_id < r.doc_id and len(x) >= 50 and len(chain_dedup._common(x, y)) >= 0.8 * max(len(x), len(y)) - 1e-9
    wanted = [(i, s, e) for i in texts for j in range(i) for s, e in runs(texts[i], texts[j], 50)]
    missed = [x for x in wanted if not covered(found[x[0]], *x[1:])]
    assert wanted and len(missed) <= 0.02 * len(wanted)


def least_sequences(h, limit):
    """A bound on the number of sequences: for every size, what cannot share a sequence, and what is left over of the room."""
    best = 0
    for small in range(limit // 2 + 1):
        alone = sum(n for x, n in h.items() if x > limit - small)
        large = {x: n for x, n in h.items() if limit / 2 < x <= limit - small}
        rest = sum(x * n for x, n in h.items() if small <= x <= limit / 2)
        room = sum((limit - x) * n for x, n in large.items())
        best = max(best, alone + sum(large.values()) + max(0, -(-(rest - room) // limit)))
    return best


def test_plans_are_near_the_least_number_of_sequences():
    rnd = random.Random(5)
    for trial in range(20):
        # With enough short pieces to fill gaps the bound can be reached.
        h = {x: rnd.randint(0, 400) for x in rnd.sample(range(9, 129), rnd.randint(3, 60))} | {x: rnd.randint(200, 2000) for x in range(1, 9)}
        used, least = sum(n for _, n in cutting_stock.solve(h, 128)), least_sequences(h, 128)
        assert least <= used <= 1.02 * least + 3, (trial, used, least)


def test_stages_are_those_of_brute_force(spark, sf, docs):
    before = {r.doc_id: r for r in docs.collect()}
    # Language: of what is kept, nothing is unrecognised.
    model = ecoc_language.fit(docs)
    kept = materialize(pipeline.language(spark, docs, sf))
    predicted = {r.doc_id: r for r in ecoc_language.predict(docs, model).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, r in predicted.items() if r.lang_pred != "und" and not r.ambiguous}
    # Near-duplicates: all pairs of shingle sets.
    sets = {}
    for r in kept.collect():
        w = words_of(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    ids = sorted(sets)
    alike = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    roots = lowest(ids, alike)
    single = materialize(pipeline.near_duplicates(spark, kept, sf))
    assert alike and sorted(r.doc_id for r in single.collect()) == [i for i in ids if roots[i] == i]
    # Passages: no exact run of 50 words of an earlier document is left.
    cut = materialize(pipeline.repeated_passages(spark, single, sf))
    whole, rest = ({r.doc_id: words_of(r.text) for r in d.collect()} for d in (single, cut))
    grams = defaultdict(list)
    for i in sorted(whole):
        for k in range(len(whole[i]) - 49):
            grams[tuple(whole[i][k : k + 50])].append(i)
    first = {g: own[0] for g, own in grams.items()}
    left = [i for i, w in rest.items() for k in range(len(w) - 49) if first.get(tuple(w[k : k + 50]), i) < i]
    assert not left and any(len(rest.get(i, ())) < len(whole[i]) for i in whole)
    # Secrets: every base finding whose value fewer than three sources have, and that is no placeholder, is gone.
    clean = materialize(pipeline.secrets(spark, cut, sf))
    hits, owners = [], defaultdict(set)
    for r in cut.collect():
        for kind in secret_ownership.BASE:
            pattern, least = secret_ownership.KINDS[kind]
            for m in re.finditer(pattern.replace("(?:(?i:", "(?:(?i:"), r.text):
                value = m[1] if "([" in pattern else m[0]
                if len(value) >= least:
                    hits.append((r.doc_id, m[0], value))
                    owners[value].add(r.source)
    after = {r.doc_id: r.text for r in clean.collect()}
    assert set(after) == {r.doc_id for r in cut.collect()}
    for doc, whole_match, value in hits:
        copied = len(owners[value]) >= secret_ownership.COPIED or re.search(secret_ownership.PLACEHOLDER, value)
        assert bool(copied) == (whole_match in after[doc]) or "[SECRET]" in after[doc]
    # Packing: every document's tokens once.
    packed = pipeline.packing(spark, clean, sf).toPandas()
    assert set(packed.doc_id) == set(after) and (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()
    assert before.keys() >= after.keys()
