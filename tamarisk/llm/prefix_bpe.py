"""Byte-level BPE by prefix dynamic programming.

The encoding of every prefix of a byte string ends in one token, and that token is unique. ``last[i]`` holds it for
the prefix of ``i + 1`` bytes: among the vocabulary's tokens that end there, it is the one that stands unmerged
behind the last token of what precedes it. The table of a text grows by appends without any change to what it holds,
and an edit recomputes entries only until the old ones come back.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .chunks import ChunkCache
from .common import slices, worker_cache

#: Entries of each cache of a Python worker.
CACHE = 600_000
#: Token pairs of which a worker remembers whether they stand side by side.
PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PrefixBPE:
    """Encodes and decodes single pieces (matches of the splitting pattern)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.token = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.token[rank] = piece
        self.heads = {x[:i] for x in ranks for i in range(1, len(x) + 1)}
        # States of reading, made as they are met; 0 is that of having read nothing.
        self._texts, self._states, self._go = [b""], {b"": 0}, {}
        self._ends: list[tuple[list[tuple[int, int]], int]] = [([], 0)]
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._beside: dict[int, bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self._halves:
            parts = [bytes([x]) for x in self.token[token]]
            while len(parts) > 2:
                best = min(
                    (r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None
                )[1]
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def stands(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` side by side, unmerged.

        It undoes both tokens' merges from the latest to the earliest. At every moment the two tokens that meet at
        the border must not have a merge that came before the merges still standing on both sides.
        """
        limit, a, b, token, rank = len(self.token), left, right, self.token, self.ranks.get
        while True:
            merged = rank(token[a] + token[b])
            if merged is not None and merged < limit:
                return False
            x, y = self.halves(a), self.halves(b)
            if x is None and y is None:
                return True
            # The later merge is undone first. Of equal merges, the left one was made first.
            if y is None or x is not None and a > b:
                limit, a = a, x[1]
            else:
                limit, b = b + 1, y[0]

    def _step(self, state: int, byte: int) -> int:
        """The state after one more byte. A state is the longest ending of what was read with which some token begins; to each
        belong the tokens that end here, longest first, with their lengths, and the shortest one apart."""
        text = self._texts[state] + bytes([byte])
        while text not in self.heads:
            text = text[1:]
            if not text:
                raise ValueError(f"no token begins with byte {byte}")
        new = self._states.setdefault(text, len(self._texts))
        if new == len(self._texts):
            ends = [(self.ranks[x], len(x)) for i in range(len(text)) if (x := text[i:]) in self.ranks]
            if not ends:
                raise ValueError(f"no token ends with byte {byte}")
            self._texts.append(text)
            self._ends.append((ends[:-1], ends[-1][0]))
        self._go[state << 8 | byte] = new
        return new

    def extend(self, last: list[int], piece: bytes, states: list[int] | None = None) -> list[int]:
        """Fill the table ``last`` up to the end of ``piece``, of which it covers a prefix; ``states`` grows with it.

        Of the tokens that end at a byte, the longest that stands behind the token before it is the entry; if all others
        don't, the shortest does.
        """
        go, ends, beside, size = self._go, self._ends, self._beside, len(self.token)
        done = len(last)
        if states is None:
            states, state = [], 0
            for byte in piece[max(0, done - self.longest) : done]:
                state = go.get(state << 8 | byte) or self._step(state, byte)
        else:
            state = states[-1] if states else 0
        for at in range(done, len(piece)):
            key = state << 8 | piece[at]
            state = go.get(key) or self._step(state, piece[at])
            states.append(state)
            longer, entry = ends[state]
            for token, length in longer:
                if length > at:
                    entry = token
                    break
                before = last[at - length]
                pair = before * size + token
                stands = beside.get(pair)
                if stands is None:
                    if len(beside) >= PAIRS:
                        beside.clear()
                    stands = beside[pair] = self.stands(before, token)
                if stands:
                    entry = token
                    break
            last.append(entry)
        return last

    def edit(self, last: list[int], old: bytes, new: bytes) -> list[int]:
        """The table of ``new`` from that of ``old``: the common prefix is kept, and the entries of the common
        suffix are taken over as soon as as many as the longest token's bytes agree again."""
        head = next((i for i, (x, y) in enumerate(zip(old, new, strict=False)) if x != y), min(len(old), len(new)))
        room = min(len(old), len(new)) - head
        tail = next((i for i in range(room) if old[-1 - i] != new[-1 - i]), room)
        table, agree, shift = last[:head], 0, len(old) - len(new)
        for end in range(head + 1, len(new) + 1):
            self.extend(table, new[:end])
            agree = agree + 1 if end > len(new) - tail and table[-1] == last[end - 1 + shift] else 0
            if agree >= self.longest:
                return table + last[end + shift :]
        return table

    def tokens(self, last: list[int]) -> list[int]:
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= len(self.token[ids[-1]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        token = self.ranks.get(piece)
        return self.tokens(self.extend([], piece)) if token is None else [token]

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """``encode`` for pieces in ascending order: each takes over the table of what it shares with the one before."""
        last: list[int] = []
        states: list[int] = []
        before = b""
        for piece in pieces:
            token = self.ranks.get(piece)
            if token is None:
                same, most = 0, min(len(piece), len(before))
                while same < most and piece[same] == before[same]:
                    same += 1
                del last[same:], states[same:]
                before = piece
                yield self.tokens(self.extend(last, piece, states))
            else:
                yield [token]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class TextEncoder:
    """Encodes whole texts: the pattern's matches one by one, remembering those met often."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.bpe, self.find, self.cache = PrefixBPE(ranks), regex.compile(pattern).findall, cache
        self._piece: dict[str, array] = {}
        self._chunks = ChunkCache(self._learn, self._whole, cache)

    def _pieces(self, text: str) -> list[str]:
        """The matches of ``text``, all of them known from here on."""
        pieces, known = self.find(text), self._piece
        distinct = set(pieces)
        if len(known) + len(distinct) > self.cache:
            known.clear()
        new = sorted((x.encode(), x) for x in distinct.difference(known))
        for (_, x), ids in zip(new, self.bpe.encode_sorted([raw for raw, _ in new]), strict=True):
            known[x] = array("I", ids)
        return pieces

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        found = {}
        for at in range(0, len(chunks), 1 << 14):
            part = chunks[at : at + (1 << 14)]
            pieces, known = iter(self._pieces(" " + " ".join(part))), self._piece
            for x in part:
                ids, left = known[piece := next(pieces)], len(x) + 1 - len(piece)
                if left:
                    ids = ids[:]
                    while left:
                        ids += known[piece := next(pieces)]
                        left -= len(piece)
                found[x] = ids.tobytes()
        return found

    def _whole(self, text: str) -> bytes:
        return b"".join([self._piece[x].tobytes() for x in self._pieces(text)])

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text."""
        return next(self.encode_all(pa.array([text])))

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """``encode`` for several texts, null ones as empty; what they have in common is encoded once."""
        return self._chunks.encode_all(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bpe.decode(ids.tolist())


class GrowingText:
    """A text with its tokens kept up to date under appends and edits, piece by piece."""

    def __init__(self, encoder: TextEncoder, text: str = ""):
        self.encoder, self.pieces, self.tables = encoder, [], []
        self.append(text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    @property
    def ids(self) -> list[int]:
        return [x for table in self.tables for x in self.encoder.bpe.tokens(table)]

    def append(self, more: str) -> None:
        """More text can change the last two matches at most (an apostrophe and a letter may become one)."""
        kept = max(0, len(self.pieces) - 2)
        old, tables = self.pieces[kept:], self.tables[kept:]
        del self.pieces[kept:], self.tables[kept:]
        for i, piece in enumerate(self.encoder.find("".join(old) + more)):
            raw = piece.encode()
            known = i < len(old) and raw.startswith(old[i].encode())
            self.pieces.append(piece)
            self.tables.append(self.encoder.bpe.extend(list(tables[i]) if known else [], raw))

    def replace(self, at: int, removed: int, inserted: str) -> None:
        """Put ``inserted`` where ``removed`` characters from ``at`` stood. Pieces outside the edit keep their tables."""
        text = self.text
        new = self.encoder.find(text[:at] + inserted + text[at + removed :])
        old, tables = self.pieces, self.tables
        head = next((i for i, (x, y) in enumerate(zip(old, new, strict=False)) if x != y), min(len(old), len(new)))
        room = min(len(old), len(new)) - head
        tail = next((i for i in range(room) if old[-1 - i] != new[-1 - i]), room)
        mid = []
        for i, piece in enumerate(new[head : len(new) - tail]):
            j = head + i
            if j < len(old) - tail:
                mid.append(self.encoder.bpe.edit(tables[j], old[j].encode(), piece.encode()))
            else:
                mid.append(self.encoder.bpe.extend([], piece.encode()))
        self.pieces, self.tables = new, tables[:head] + mid + (tables[len(old) - tail :] if tail else [])


def encoder(ranks_path: str, pattern: str) -> TextEncoder:
    """One encoder for each vocabulary and Python worker."""
    return worker_cache(f"{ranks_path} {pattern}", lambda: TextEncoder(read_ranks(ranks_path), pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null counts as empty, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for b in slices(batches, 2048, f"{ranks_path} {pattern}"):
            ids = [x.astype("<i4") for x in enc.encode_all(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) from (doc_id, ids); null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for b in slices(batches, 2048, f"{ranks_path} {pattern}"):
            raw = [enc.bpe.decode(x or ()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes and keeps only digests of both.

    Null text counts as empty and has no tokens; repeated rows stay; an empty table gives no rows. No column but doc_id and
    text is read, so that others may have any name. A text is held whole, however long, one at a time beside its batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        enc = encoder(ranks_path, pattern)
        digits = list(map(str, range(len(enc.bpe.token))))
        for b in slices(batches, 2048, f"{ranks_path} {pattern}"):
            n, first, second = [], [], []
            for found in enc.encode_all(b.column("text")):
                ids = found.tolist()
                n.append(len(ids))
                first.append(sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                second.append(sha256(enc.bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(first), pa.array(second)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
