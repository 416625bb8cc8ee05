"""Language identification with error-correcting output codes.

Each language has a codeword; for each bit, a binary classifier over hashed byte trigrams (a log-odds model from the
corpus counts of the languages on either side) says how much a text is on the one side. Decoding weighs each bit's loss by
how well that bit separates the training documents, and takes the codeword with the least loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .features import ngram_counts

BITS = 13
#: A prediction is ambiguous if its probability is below this.
CLEAR = 0.6


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` rows of -1 and 1: all halvings of a few languages, seeded random ones of many. Every bit has both signs."""
    if n <= 5:
        # Exhaustive code: bit j separates by the binary digits of j.
        width = max(1, 2 ** (n - 1) - 1)
        code = np.array([[1 - 2 * (j >> (n - 1 - i) & 1) for j in range(1, width + 1)] for i in range(n)])
        return code if n > 1 else np.ones((1, 1), int)
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, width))
        code[:, np.abs(code.sum(0)) == n] *= np.where(np.arange(n) % 2, 1, -1)[:, None]
        away = (width - code @ code.T) / 2
        nearest = away[~np.eye(n, dtype=bool)].min()
        if nearest > far:
            best, far = code, nearest
    return best


class Model:
    """languages, code (n x b), weights (b x features), scale and shift of each bit's mean log-odds, bit weights."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1])
        sides = []
        for bit in self.code.T:
            up = share[bit > 0].mean(0) if (bit > 0).any() else share.mean(0)
            down = share[bit < 0].mean(0) if (bit < 0).any() else np.full(share.shape[1], 1 / share.shape[1])
            sides.append(np.log(up) - np.log(down))
        self.weights = np.array(sides, np.float32)
        # The mean log-odds that each language's own corpus gets: their gap is what the bit can tell apart.
        own = share @ self.weights.T
        high = np.where(self.code > 0, own, np.inf).min(0)
        low = np.where(self.code < 0, own, -np.inf).max(0)
        high, low = np.where(np.isfinite(high), high, 1.0), np.where(np.isfinite(low), low, -1.0)
        self.shift = (high + low) / 2
        self.scale = np.maximum((high - low) / 2, 1e-3)
        gap = np.clip(high - low, 1e-3, None)
        self.bit_weight = gap / gap.sum()

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and its probability, for rows of feature counts."""
        n = counts.sum(1, keepdims=True)
        margin = (counts.astype(np.float32) @ self.weights.T) / np.maximum(n, 1)
        margin = (margin - self.shift) / self.scale
        loss = np.logaddexp(0, -2 * margin[:, None, :] * self.code[None]) @ self.bit_weight
        # More n-grams make a sharper decision, up to a point.
        sharp = 2 * np.sqrt(np.clip(n, 1, 400))
        odds = np.exp(np.clip(-(loss - loss.min(1, keepdims=True)) * sharp, -60, 0))
        p = odds / odds.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def fit(labelled: DataFrame, bits: int = BITS) -> Model | None:
    """Fit on all rows of (text, lang). Each task sums n-gram counts per language; only the sums, languages times
    ``2 ** bits``, reach the driver. Null or letterless texts and null languages teach nothing; None without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in slices(batches):
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for text, lang in zip(texts, langs, strict=True):
                total.setdefault(lang, np.zeros(1 << bits, np.int64))
                # Every n-gram counts alike, so that a long text weighs as much as the short ones it could be cut into.
                total[lang] += ngram_counts(text.lower().encode(), bits)
        if total:
            kind = pa.list_(pa.int64())
            rows = [pa.array(list(total)), pa.array([x.tolist() for x in total.values()], kind)]
            yield pa.RecordBatch.from_arrays(rows, ["lang", "counts"])

    known = labelled.where("text is not null and lang is not null").select("text", "lang")
    part = known.mapInArrow(run, "lang string, counts array<long>")
    cells = part.select("lang", F.posexplode("counts")).where("col > 0").groupBy("lang", "pos").agg(F.sum("col").alias("n"))
    rows = cells.toPandas()
    if not len(rows):
        return None
    languages = sorted(rows.lang.unique())
    counts = np.zeros((len(languages), 1 << bits))
    counts[np.searchsorted(languages, rows.lang), rows.pos] = rows.n
    return Model(languages, counts)


def predict(
    docs: DataFrame,
    model: Model | None,
    bits: int = BITS,
    clear: float = CLEAR,
    columns: list[str] | None = None,
    names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous"),
) -> DataFrame:
    """``columns`` of ``docs`` (doc_id, if not given) with lang_pred, score and ambiguous, or what ``names`` calls them, for
    documents whose columns have these names already. Null or letterless texts are ``und`` with score 0 and ambiguous; so is
    everything without a model. Repeated rows stay, an empty table gives no rows, and no column but the text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added, names = list(names), columns or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, 128):
            texts = b.column("text").to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            has = [i for i, x in enumerate(texts) if x and any(map(str.isalpha, x))] if m else []
            if has:
                best, p = m.decode(np.stack([ngram_counts(texts[i].lower().encode(), bits) for i in has]))
                score[has] = p
                for i, k in zip(has, best, strict=True):
                    lang[i] = m.languages[k]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score), pa.array(score < clear)],
                [*names, *added],
            )

    own = docs.select(*dict.fromkeys([*names, "text"]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for n in names for f in [own.schema[n]])
    kinds = ", ".join(f"`{n}` {k}" for n, k in zip(added, ("string", "double", "boolean"), strict=True))
    return own.mapInArrow(run, f"{fields}, {kinds}")
