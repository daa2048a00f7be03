"""Token counts by byte-pair merging with a heap over a linked list.

Each pre-token starts as one symbol a byte. A heap holds adjacent pairs by rank and place; the lowest is popped, its right
symbol leaves the list, and the two new neighbouring pairs are pushed. The count is the initial symbols minus the merges;
no identifiers are produced. Pre-tokens repeat, so counts are kept in a bounded memo for each Python worker.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import flat, pretokens

MEMO_ENTRIES = 600_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in such vocabularies: printable Latin-1 bytes stand for themselves, others follow from code point 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeCounter:
    """Counts tokens by the merges of a tokenizer file; special strings in a text count as one token each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        ids = spec["model"]["vocab"]
        self.first = [ids[c] for c in byte_symbols()]
        self.pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.specials = sorted((t["content"] for t in spec.get("added_tokens") or []), key=len, reverse=True)
        self.memo: dict[bytes, int] = {}

    def count(self, piece: bytes) -> int:
        """Symbols of one pre-token after all merges."""
        size = len(piece)
        if size < 2:
            return size
        symbol = [self.first[b] for b in piece]
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        pairs = self.pairs
        heap = [(found[0], k, symbol[k], symbol[k + 1], found[1]) for k in range(size - 1) if (found := pairs.get((symbol[k], symbol[k + 1])))]
        heapq.heapify(heap)
        left = size
        while heap:
            _, at, a, b, made = heapq.heappop(heap)
            beside = after[at]
            if symbol[at] != a or beside >= size or symbol[beside] != b:
                continue  # one of the two is gone
            symbol[at], symbol[beside] = made, -1
            left -= 1
            after[at] = behind = after[beside]
            if behind < size:
                before[behind] = at
                if found := pairs.get((made, symbol[behind])):
                    heapq.heappush(heap, (found[0], at, made, symbol[behind], found[1]))
            if (ahead := before[at]) >= 0 and (found := pairs.get((symbol[ahead], made))):
                heapq.heappush(heap, (found[0], ahead, symbol[ahead], made, found[1]))
        return left

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        memo, out = self.memo, np.empty(len(pieces), np.int64)
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        for k, piece in enumerate(pieces):
            n = memo.get(piece)
            if n is None:
                n = self.count(piece)
                if len(piece) <= 32:
                    memo[piece] = n
            out[k] = n
        return out

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row, without regard to special strings."""
        begins = pretokens.starts(data, offsets)
        if not len(begins):
            return np.zeros(len(offsets) - 1, np.int64)
        codes, pieces = pretokens.encoded(data, begins)
        return flat.sums_by_row(self.counts(pieces)[codes], np.searchsorted(begins, offsets))

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        held = data.tobytes()
        specials = [s.encode() for s in self.specials if s.encode() in held]
        if not specials:
            return self.plain(data, offsets)
        import re

        cut = re.compile(b"|".join(map(re.escape, specials)))
        owner, pieces, out = [], [], np.zeros(len(offsets) - 1, np.int64)
        for row in range(len(offsets) - 1):
            parts = cut.split(held[offsets[row] : offsets[row + 1]])
            out[row] += len(parts) - 1
            pieces += parts
            owner += [row] * len(parts)
        places = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        np.add.at(out, owner, self.plain(np.frombuffer(b"".join(pieces), np.uint8), places))
        return out


@functools.lru_cache(1)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Bytes and tokens of each row's whole text, and whether the tokens exceed the limit.

    Rows keep their identifier whatever it is (null too, repeats too). A null text counts as empty: 0 bytes, 0 tokens,
    not over the limit. Other columns are dropped, so their names can't clash. Map only: no shuffle.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.flat(batch.column(1))
            n = np.concatenate([np.zeros(0, np.int64), *(counter(path).rows(*flat.part(data, offsets, *c)) for c in flat.chunks(offsets))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(flat.tidy(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
