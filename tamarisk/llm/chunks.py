"""Encoding texts chunk by chunk, where chunks met before aren't encoded again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space before white space or at the end (RE2; its \s is ASCII only).
_SPACES = r" (?:[\s\v\x1c-\x1f\x{85}\p{Z}]|$)"
#: Bytes of texts that are looked up at once, one text at least.
GROUP = 1 << 22


class ChunkCache:
    """Ids of texts as 32-bit numbers. Texts are cut at spaces before anything but white space, where byte-level vocabularies
    with their usual pattern always start a piece; the rare texts with other spaces are encoded whole.

    ``learn`` gives the ids (as bytes) of new chunks, which have the space before them left out; ``whole`` those of a text.
    Of the chunks met, the last ``size`` at least are remembered, in two generations of which the older one goes at once.
    """

    def __init__(self, learn: Callable[[list[str]], dict[str, bytes]], whole: Callable[[str], bytes], size: int):
        self.learn, self.whole, self.size = learn, whole, size
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._heads: dict[str, bytes] = {}

    def _head(self, text: str) -> bytes:
        """The ids of what stands before the first space."""
        ids = self._heads.get(text)
        if ids is None:
            if len(self._heads) >= self.size // 8:
                self._heads.clear()
            ids = self._heads[text] = self.whole(text) if text else b""
        return ids

    def _known(self, chunks: list[str]) -> list[bytes]:
        ids = list(map(self._young.get, chunks))
        gaps = [i for i, known in enumerate(ids) if known is None]
        if gaps:
            missing = [chunks[i] for i in gaps]
            if self._old:
                new = {x: known for x, known in zip(missing, map(self._old.get, missing), strict=True) if known is not None}
                missing = [x for x in missing if x not in new]
                new |= self.learn(missing)
            else:
                new = self.learn(missing)
            if len(self._young) + len(new) > self.size:
                self._young, self._old = {}, self._young
            self._young |= new
            for i in gaps:
                ids[i] = new[chunks[i]]
        return ids

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text; null is empty."""
        texts = pc.fill_null(texts, "")
        total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + GROUP, "right")))
            yield from self._group(texts.slice(at, end - at))
            at = end

    def _group(self, texts: pa.Array) -> Iterator[np.ndarray]:
        odd = pc.match_substring_regex(texts, _SPACES)
        apart = dict.fromkeys(np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist())
        for i in apart:
            apart[i] = np.frombuffer(self.whole(texts[i].as_py()), "<u4")
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        offsets = np.asarray(lists.offsets)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        chunks, use = coded.dictionary.to_pylist(), np.array(coded.indices)
        # What stands first in a text has no space before it.
        heads, of_text = np.unique(use[offsets[:-1]], return_inverse=True)
        ids = self._known(chunks) + [self._head(chunks[i]) for i in heads.tolist()]
        use[offsets[:-1]] = len(chunks) + of_text
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        tokens = np.frombuffer(b"".join(ids), "<u4")
        n = size[use]
        stop = np.cumsum(n, dtype=np.int64)
        total = int(stop[-1])
        # Counting in 32 bits is faster, and enough for all but a single huge text.
        kind = np.int32 if total < 1 << 31 else np.int64
        place = np.repeat(((np.cumsum(size, dtype=np.int64) - size)[use] - (stop - n)).astype(kind), n)
        place += np.arange(total, dtype=kind)
        found = tokens[place]
        cut = np.r_[0, stop][offsets].tolist()
        for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            yield apart[i] if i in apart else found[a:b]
