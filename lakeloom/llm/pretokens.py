"""The pre-tokeniser pattern of the byte-level vocabularies, as array operations on whole batches.

The pattern is `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`. Its matches cover the
text without gaps, so a batch is described by the byte places where matches begin.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from lakeloom.llm.flat import row_marks

OTHER, LETTER, NUMBER, SPACE = range(4)
# Code points with the White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What may follow an apostrophe in a contraction.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, points):
            at = ord(points[m.start()])
            if at < 0xD800 <= ord(points[m.end() - 1]):
                table[at:0xD800] = kind
                at = 0xE000
            table[at : ord(points[m.end() - 1]) + 1] = kind
    table[WHITE] = SPACE
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte place and value of each code point of well-formed UTF-8."""
    if not (data & 0x80).any():
        return np.arange(len(data)), data.astype(np.int32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    value = lead.copy()
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        some = np.flatnonzero((lead >= low) & (lead < (0xE0, 0xF0, 0x100)[size - 2]))
        point = lead[some] & mask
        for k in range(1, size):
            point = (point << 6) | (data[at[some] + k] & 0x3F)
        value[some] = point
    return at, value


def starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places where the pattern's matches begin; no match crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64)
    at, value = code_points(data)
    kind = classes()[value]
    first = row_marks(len(data), offsets)[at]
    begins = first.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(begins)
    stops = np.append(runs[1:], len(at))
    nature = kind[runs]
    row_ends = np.append(first, True)[stops]
    # White space before other text gives its last character away: a blank to what follows, another to a match of its own.
    given = np.flatnonzero((nature == SPACE) & ~row_ends)
    last = stops[given] - 1
    begins[last] = True
    blank = value[last] == 0x20
    begins[stops[given][blank]] = False
    # An apostrophe that begins a match takes a contraction's letters.
    quote = np.flatnonzero((nature == OTHER) & (stops - runs == 1) & (value[runs] == 0x27) & begins[runs] & ~row_ends)
    quote = quote[nature[quote + 1] == LETTER] if len(quote) else quote
    if len(quote):
        begin, stop = runs[quote + 1], stops[quote + 1]
        one = value[begin]
        two = np.where(stop - begin > 1, value[np.minimum(begin + 1, len(value) - 1)], 0)
        taken = np.zeros(len(quote), np.int64)
        for ending in ENDINGS:
            fits = one == ord(ending[0])
            if len(ending) == 2:
                fits &= two == ord(ending[1])
            taken[fits & (taken == 0)] = len(ending)
        begin, stop, taken = begin[taken > 0], stop[taken > 0], taken[taken > 0]
        begins[begin] = False
        begins[(begin + taken)[begin + taken < stop]] = True
    return at[np.flatnonzero(begins)]


def encoded(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Matches as codes into the list of their distinct byte strings."""
    places = np.append(begins, len(data)).astype(np.int32)
    column = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))])
    column = column.dictionary_encode()
    return column.indices.to_numpy(zero_copy_only=False), column.dictionary.to_pylist()
