"""Hashed features of whole texts, vectorised over many documents at once."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the hashes (fixed values).
BASE, STEP, MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII byte but letters and digits.
NOT_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    """Powers of BASE and of its inverse modulo 2 ** 64, as many as the longest batch has bytes."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 1 << 16)
        one = np.ones(1, np.uint64)
        _powers = np.r_[one, np.cumprod(np.full(n, BASE, np.uint64))]
        _inverse = np.r_[one, np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), np.uint64))]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


#: Bytes of one text that are hashed at once.
PART = 1 << 22


def words(texts: list[bytes], blanks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document index, start and end (bytes within its text) of every word, A-Z lowered. Bytes marked in ``blanks``
    (white space, if not given) separate words."""
    if len(texts) == 1 and len(texts[0]) > PART:
        return _long(texts[0], blanks)
    return _short(texts, blanks)


def _short(texts: list[bytes], blanks: np.ndarray):
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    _grow(len(joined) + 1)
    blank = blanks[joined]
    edge = np.flatnonzero(np.diff(np.r_[True, blank]))
    start, end = edge[::2], edge[1::2]
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum((_LOWER[joined].astype(np.uint64) + np.uint64(1)) * _powers[: len(joined)])]
    h = mix((sums[end] - sums[start]) * _inverse[start])
    first = np.cumsum([0, *(len(x) + 1 for x in texts)])
    doc = np.searchsorted(first, start, "right") - 1
    return h, doc, start - first[doc], end - first[doc]


def _long(text: bytes, blanks: np.ndarray):
    """``words`` of one text, part by part; parts end at blanks."""
    found, at, blank = [], 0, np.flatnonzero(blanks[np.frombuffer(text, np.uint8)])
    while at < len(text):
        k = np.searchsorted(blank, at + PART)
        end = int(blank[k]) + 1 if k < len(blank) else len(text)
        h, doc, start, stop = _short([text[at:end]], blanks)
        found.append((h, doc, start + at, stop + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def groups(texts: list[bytes], size: int = 1 << 20):
    """Slices of about ``size`` bytes of a list of texts, one text at least."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= size):
            total += len(texts[end])
            end += 1
        yield at, end
        at = end


def ngram_counts(raw: bytes, bits: int, size: int = 3) -> np.ndarray:
    """How often each hashed byte n-gram occurs in a text, runs of digits and punctuation taken as blanks."""
    x = _FOLD[np.frombuffer(b" " + raw + b" ", np.uint8)]
    keep = np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]
    x = x[keep].astype(np.uint64)
    if len(x) < size:
        return np.zeros(1 << bits, np.int64)
    h = np.zeros(len(x) - size + 1, np.uint64)
    for i in range(size):
        h = h * np.uint64(STEP) + x[i : len(x) - size + 1 + i]
    return np.bincount((mix(h) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
