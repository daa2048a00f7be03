"""Flat views of text columns: one byte buffer and row offsets, so numpy works on whole batches without row loops.

Nulls count as empty texts everywhere here.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)
_RADIX_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_held: Callable[[], None] | None = None  # by what the worker's tasks have left
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], holds: Callable[[], None] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that gives free memory back after each task, as workers outlive tasks and stages.

    What a task leaves in its worker for the next one, `holds` drops; that happens when the worker gets a task of another operator.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _taken_over(holds)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def _taken_over(holds: Callable[[], None] | None) -> None:
    """A module's function, as tidied() is sent to workers by value and its globals would be its own."""
    global _held
    if _held is not None and _held is not holds:
        _held()
    _held = holds


def give_back() -> None:
    """Free memory that the allocators hold goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes as one uint8 array, and its int64 row offsets (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each; a longer row stands alone."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high
        low = high


def slices(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch's rows in slices of at most so many bytes of a text column each, so that what is made of one is small; a longer row stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for low, high in chunks(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), most):
        yield batch.slice(low, high - low)


def part(data: np.ndarray, offsets: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    return data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; other bytes stay."""
    return _LOWER[data]


def row_marks(size: int, offsets: np.ndarray) -> np.ndarray:
    """True at each row's first byte; one place more than the data."""
    marks = np.zeros(size + 1, bool)
    marks[offsets] = True
    return marks


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes outside [\\x20\\x09-\\x0D], and where each row's words begin (rows + 1)."""
    inside = ~_SPACE[data]
    marks = row_marks(len(data), offsets)
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | marks[:-1]))
    ends = np.flatnonzero(inside & (~after | marks[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power(count: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < count:
        for k, by in enumerate((_RADIX, _RADIX_INVERSE)):
            grown = np.full(1 << count.bit_length(), by, np.uint64)
            grown[0] = 1
            _powers[k] = np.cumprod(grown)
    return _powers[0][:count], _powers[1][:count]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that all bits of a result depend on all of the input."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from prefix sums of one polynomial over the buffer."""
    power, inverse = _power(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
        own = (sums[ends] - sums[starts]) * inverse[starts]
        return mix(own + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ordered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts non-negative 64-bit values, equal ones by place; and the sorted values.

    One plain sort of the values' leading bits with their places below, which is much faster than an indirect one; where the leading bits
    don't tell two values apart, an indirect one.
    """
    values = values.astype(np.uint64, copy=False)
    if not len(values):
        return np.zeros(0, np.int64), values
    place = np.uint64(len(values).bit_length())
    spare = np.uint64(64 - max(1, int(values.max()).bit_length()))
    lead = (values << spare) >> place << place
    lead |= np.arange(len(values), dtype=np.uint64)
    lead.sort()
    order = (lead & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    found = values[order]
    if spare < place and (found[1:] < found[:-1]).any():
        order = np.argsort(values, kind="stable")
        found = values[order]
    return order, found


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, ascending; where each value stands among them; the order that sorts the values; where each distinct one begins in it."""
    order, found = ordered(values)
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    place = np.empty(len(found), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return found[first], place, order, first


def sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each row i."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
