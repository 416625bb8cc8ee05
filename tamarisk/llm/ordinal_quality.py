"""Quality classification by ordinal cumulative-link regression.

A text has one latent score: the sum of shared weights over its hashed words and over bins of its shape (symbols, capitals,
repetition, length). Ordered thresholds cut the score into grades, so that P(grade > j) = sigmoid(score - threshold j).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8
from .features import NOT_WORD, groups, mix, words

BITS = 18
#: Labelled documents that are fitted at most: a bound that doesn't grow with the corpus.
SAMPLE = 12_000
#: Documents of the sample that must hold a feature for it to get a weight.
LEAST = 5
#: Chi-square over the grades that a feature must exceed.
TELLING = 24.0
#: Bounds of the bins of each shape measure; the last one is of log2 of the words.
BINS = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7])


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) pairs, each once: hashed words, and a hashed bin of every shape measure."""
    doc, feature = [], []
    for at, end in groups(texts):
        own = texts[at:end]
        h, d, _, _ = words(own, NOT_WORD)
        pair = np.unique((d.astype(np.int64) << bits) | (h >> np.uint64(64 - bits)).astype(np.int64))
        n, distinct = np.bincount(d, minlength=len(own)), np.bincount(pair >> bits, minlength=len(own))
        raw = np.frombuffer(b"\n".join(own) + b"\n", np.uint8)
        length = np.array([len(x) + 1 for x in own])
        first, size = np.cumsum(length) - length, np.maximum(length - 1, 1)
        # Sums over bytes, without wider arrays: a text can be long.
        share = lambda of: np.add.reduceat(of.view(np.uint8), first, dtype=np.int64) / size  # noqa: E731, B023
        upper, digit = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57)
        odd = NOT_WORD[raw] & (raw != 32) & (raw != 10) & (raw != 44) & (raw != 46)
        line = raw == 10
        shape = [share(upper), share(digit), share(odd), share(line), 1 - distinct / np.maximum(n, 1)]
        bins = [np.searchsorted(BINS, x) for x in shape]
        bins.append(np.minimum(np.log2(n + 1).astype(int), 15))
        bins.append(np.searchsorted(BINS, distinct / np.maximum(n, 1)) * 16 + bins[-1])
        doc += [(pair >> bits) + at, *(np.arange(len(own)) + at for _ in bins)]
        feature.append(pair & ((1 << bits) - 1))
        for k, b in enumerate(bins):
            code = mix(np.uint64(0x5EED) + np.uint64(k << 16) + b.astype(np.uint64))
            feature.append((code >> np.uint64(64 - bits)).astype(np.int64))
    none = [np.empty(0, np.int64)]
    return np.concatenate(doc or none), np.concatenate(feature or none)


class Model:
    """Weights of the features, and ascending thresholds between the grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, bits: int):
        self.weights, self.thresholds, self.bits = weights, thresholds, bits

    def above(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > j) for every text and threshold."""
        doc, feature = features(texts, self.bits)
        score = np.bincount(doc, weights=self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -50, 50)))


def fit_arrays(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, bits: int = BITS, steps: int = 300, decay: float = 0.02) -> Model:
    """Maximum likelihood with L2 decay, by gradient steps scaled for each feature (Adam), full batch. Classes weigh by
    the inverse root of their size."""
    levels = int(grade.max()) if len(grade) else 0
    n = max(1, len(grade))
    share = np.bincount(grade, minlength=levels + 1) / n
    # Features whose spread over the grades is no accident; the many others would only add noise to long texts.
    seen = np.stack([np.bincount(feature[grade[doc] == g], minlength=1 << bits) for g in range(levels + 1)])
    total = seen.sum(0)
    due = share[:, None] * total
    odd = ((seen - due) ** 2 / np.maximum(due, 1e-9)).sum(0)
    used = np.flatnonzero((total >= LEAST) & (odd > TELLING))
    place = np.full(1 << bits, -1)
    place[used] = np.arange(len(used))
    keep = place[feature] >= 0
    doc, col = doc[keep], place[feature[keep]]
    weight = 1 / np.sqrt(np.maximum(share, 1e-3))[grade]
    weight = weight / weight.mean() if len(weight) else weight
    # Parameters: weights, first threshold, logs of the steps between thresholds.
    x = np.zeros(len(used) + max(1, levels))
    m, v = np.zeros_like(x), np.zeros_like(x)
    top = len(used)
    for t in range(1, steps + 1):
        gaps = np.exp(x[top + 1 :])
        th = x[top] + np.r_[0, np.cumsum(gaps)]
        bounds = np.r_[-np.inf, th, np.inf] if levels else np.array([-np.inf, np.inf])
        score = np.bincount(doc, weights=x[col], minlength=n)
        hi = 1 / (1 + np.exp(np.clip(score - bounds[grade + 1], -50, 50))) if len(grade) else score
        lo = 1 / (1 + np.exp(np.clip(score - bounds[grade], -50, 50))) if len(grade) else score
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p * weight, lo * (1 - lo) / p * weight
        g = np.zeros_like(x)
        g[:top] = np.bincount(col, weights=(dhi - dlo)[doc], minlength=top) / n + decay * x[:top] / n
        for j in range(levels):
            pull = (dlo[grade == j + 1].sum() - dhi[grade == j].sum()) / n
            g[top] += pull
            for i in range(1, j + 1):
                g[top + i] += pull * gaps[i - 1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    weights = np.zeros(1 << bits)
    weights[used] = x[:top]
    th = x[top] + np.r_[0, np.cumsum(np.exp(x[top + 1 :]))] if levels else np.zeros(0)
    return Model(weights, th, bits)


def fit(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Fit on (doc_id, grade long from 0) for up to ``sample`` documents, chosen by a hash of the id; the least grade counts
    of a document with several. Null ids or grades are ignored; without any grade everything gets grade 0."""
    known = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            doc, feature = features(utf8(b), bits)
            order = np.argsort(doc, kind="stable")
            offsets = np.searchsorted(doc[order], np.arange(b.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("grade"), lists], ["grade", "feature"])

    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    got = rows.select("text", F.col("grade").cast("long").alias("grade")).mapInArrow(run, "grade long, feature array<int>").toArrow()
    lists = got.column("feature").combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.empty(0, int)
    doc = np.repeat(np.arange(got.num_rows), sizes)
    return fit_arrays(doc, np.asarray(lists.flatten()), got.column("grade").to_numpy().astype(int), bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, expected_grade, tail): the mean of the grade, and the probability of the highest one, for every whole text.
    Null text counts as empty; repeated rows stay; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            above = shared.value.above(utf8(b))
            tail = above[:, -1] if above.shape[1] else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(above.sum(1)), pa.array(tail)], ["doc_id", "expected_grade", "tail"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_grade double, tail double")
