"""Byte-level BPE encoding and decoding in linear time, by an automaton and backtracking.

The vocabulary's byte strings, mapped to Latin-1 characters, form an Aho-Corasick automaton that gives the longest token at
each place. An encoding is exact when each two adjacent tokens are compatible: their concatenation, encoded by merges, is
those two tokens. So the encoder takes the longest match that is compatible with the token before it, tries the next shorter
prefix where it is not, and steps back where none is left. A bit for each place stops it from trying a dead end twice.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import flat, pretokens

#: What each of a worker's two memos may hold, unless said otherwise; one is emptied beyond. Less memory costs more time; results are the same.
MEMO_BYTES = 40 << 20
ENTRY_BYTES = 160  # of a dictionary's place, key and value, besides a piece's bytes and ids
LONGEST_KEPT = 32


class Codec:
    """Encodes byte strings by a rank file, and decodes ids."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.tree = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.tree.add_word(token.decode("latin-1"), rank)
        self.tree.make_automaton()
        self.halves = {rank: self._split(token) for token, rank in self.ranks.items()}
        self.shorter = {rank: self._prefix(token) for token, rank in self.ranks.items()}
        self.fits_memo: dict[int, bool] = {}
        self.memo: dict[bytes, tuple[int, ...]] = {}
        self.held, self.memo_bytes = 0, MEMO_BYTES  # bytes of memo, and the most of them

    def _prefix(self, token: bytes) -> int:
        """The longest token that is a proper prefix, or -1."""
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), -1)

    def _split(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one when its own bytes are encoded; None for a single byte."""
        if len(token) < 2:
            return None
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            made = [self.ranks.get(parts[k] + parts[k + 1], 1 << 60) for k in range(len(parts) - 1)]
            at = made.index(min(made))
            if made[at] == 1 << 60:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if all(p in self.ranks for p in parts) else None

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes leaves these two tokens; remembered for each pair."""
        pair = left << 32 | right
        known = self.fits_memo.get(pair)
        if known is None:
            if len(self.fits_memo) * ENTRY_BYTES > self.memo_bytes:
                self.fits_memo.clear()
            known = self.fits_memo[pair] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        """No pair across the border may merge earlier than the merges that built both sides."""
        ranks, tokens, bound = self.ranks, self.tokens, 1 << 60
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < bound:
                return False
            if left > right:  # undo the later of the two merges; it bounds what may still come before it
                bound, parts = left, self.halves[left]
                if parts is None:
                    bound, parts = right + 1, self.halves[right]
                    if parts is None:
                        return True
                    right = parts[0]
                    continue
                left = parts[1]
            else:
                bound, parts = right + 1, self.halves[right]
                if parts is None:
                    bound, parts = left, self.halves[left]
                    if parts is None:
                        return True
                    left = parts[1]
                    continue
                right = parts[0]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        text, size, tokens = piece.decode("latin-1"), len(piece), self.tokens
        longest = [-1] * size
        for end, rank in self.tree.iter(text):
            start = end + 1 - len(tokens[rank])
            longest[start] = rank  # ends come in order, so the last is the longest
        open_at, ids, at = bytearray(b"\1" * (size + 1)), [], 0
        token = longest[0]
        while True:
            stop = at + len(tokens[token])
            if open_at[stop] and (not ids or self.fits(ids[-1], token)):
                ids.append(token)
                at = stop
                if at == size:
                    return tuple(ids)
                token = longest[at]
                continue
            token = self.shorter[token]
            while token < 0:
                open_at[at] = 0
                token = ids.pop()
                at -= len(tokens[token])
                token = self.shorter[token]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        ids = self.memo.get(piece)
        if ids is None:
            ids = self.encode_piece(piece)
            if len(piece) <= LONGEST_KEPT:
                if self.held > self.memo_bytes:
                    self.memo.clear()
                    self.held = 0
                self.memo[piece] = ids
                self.held += ENTRY_BYTES + len(piece) + 8 * len(ids)
        return ids

    def forget(self) -> None:
        """Empties the memos."""
        self.memo.clear()
        self.fits_memo.clear()
        self.held = 0

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode_text(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        bounds = np.append(pretokens.starts(data, np.array([0, len(data)])), len(data))
        return [i for a, b in zip(bounds[:-1], bounds[1:], strict=True) for i in self.encode(data[a:b].tobytes())]


@functools.lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


def _drop() -> None:
    codec.cache_clear()


def _taken(values: list[bytes], codes: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The coded values one after another, and the byte place of each."""
    held = pa.array(values, pa.large_binary())
    lengths = np.diff(np.frombuffer(held.buffers()[1], np.int64)[: len(values) + 1])[codes]
    places = np.concatenate([[0], np.cumsum(lengths)])
    return memoryview(pc.take(held, pa.array(codes)).buffers()[2] or b""), places


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Ids of each row's whole text, their digest, and the digest of the bytes that decoding these ids gives.

    Returns doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256, and ids array<int> unless
    with_ids is False. A null text counts as empty: no ids, digests of nothing. Repeated and null identifiers stay as they
    are; other columns are dropped, so their names can't clash. Map only: no shuffle.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def encode(data: np.ndarray, offsets: np.ndarray):
        begins = pretokens.starts(data, offsets)
        codes, pieces = pretokens.encoded(data, begins) if len(begins) else (np.zeros(0, np.int64), [])
        own = codec(path)
        own.memo_bytes = memo_bytes
        encoded = [own.encode(p) for p in pieces]
        bounds = np.searchsorted(begins, offsets)
        lengths = np.array([len(x) for x in encoded], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        n = flat.sums_by_row(lengths, bounds)
        written, at = _taken([b"".join(b"%d," % i for i in x) for x in encoded], codes)
        decoded, to = _taken([own.decode(x) for x in encoded], codes)
        ids = [hashlib.sha256(written[at[a] : max(at[a], at[b] - 1)]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        back = [hashlib.sha256(decoded[to[a] : to[b]]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        out = [pa.array(n), pa.array(ids, pa.string()), pa.array(back, pa.string())]
        if with_ids:
            every = np.fromiter(itertools.chain.from_iterable(encoded), np.int32)
            ends = np.cumsum([0, *map(len, encoded)])
            values = pc.take(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(every)), pa.array(codes)).flatten() if len(codes) else pa.array([], pa.int32())
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values))
        return out

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.flat(batch.column(1))
            for low, high in flat.chunks(offsets):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *encode(*flat.part(data, offsets, low, high))], ["doc_id", *names])
        codec(path).forget()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(flat.tidy(run, _drop), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
