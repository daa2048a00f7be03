"""An n-gram trie of Elias-Fano sequences in a memory map, with quantised log probabilities.

A level holds, context after context, the ascending ids of the words that follow each context. Ids are made one monotone sequence by
adding what the ranges before have reached, so the sequence, and the pointers that bound the ranges, are Elias-Fano coded: low bits
packed, high bits in unary. No level is ever decoded: a place is read by a select of its high bit, and a word is searched relative to its
context, as the successor of what the ranges before reached plus its id, by a select of the high part's bucket and a binary search over
the low bits of that bucket. Searches come in batches and are array operations. Values are 16-bit codes of logarithms.
"""

from __future__ import annotations

import mmap

import numpy as np

STEP = 16 / 65534  # decimal digits a code; a logarithm of up to 16 digits, whatever its sign
_ONE = np.uint64(1)


def quantised(values: np.ndarray) -> np.ndarray:
    """16-bit codes of the logarithms of positive values all at most 1, or all at least 1; 0 stands for none (a value of 0)."""
    with np.errstate(divide="ignore"):
        digits = np.abs(np.log10(values))
    return np.where(values > 0, np.minimum(np.rint(digits / STEP), 65534) + 1, 0).astype(np.uint16)


def shares(codes: np.ndarray) -> np.ndarray:
    """The values, at most 1, that codes stand for."""
    return np.where(codes > 0, 10.0 ** (-STEP * (codes - 1.0)), 0.0)


def counts(codes: np.ndarray) -> np.ndarray:
    """The values, at least 1, that codes stand for."""
    return np.where(codes > 0, 10.0 ** (STEP * (codes - 1.0)), 0.0)


def _or_by_word(out: np.ndarray, word: np.ndarray, bits: np.ndarray) -> None:
    """out[word] |= bits for ascending words."""
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] |= np.bitwise_or.reduceat(bits, first)


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit of each word that has `rank` set bits below it."""
    word, rank, at = word.copy(), rank.astype(np.int64), np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
        beyond = rank >= below
        rank -= below * beyond
        at += width * beyond
        word >>= (width * beyond).astype(np.uint64)
    return at


def elias_fano(values: np.ndarray) -> list[np.ndarray]:
    """[count, low width and highest high part; low bits; high bits; set bits before each word of these] of an ascending sequence."""
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    values = values.astype(np.uint64)
    low = np.zeros(n * width // 64 + 2, np.uint64)
    if width and n:
        bit = np.arange(n, dtype=np.uint64) * np.uint64(width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        part = values & np.uint64((1 << width) - 1)
        _or_by_word(low, word, part << shift)
        over = np.flatnonzero(shift + np.uint64(width) > 64)
        _or_by_word(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
    high = np.zeros((n + (top >> width)) // 64 + 2, np.uint64)
    at = (values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)
    _or_by_word(high, (at >> np.uint64(6)).astype(np.int64), _ONE << (at & np.uint64(63)))
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))[:-1]])
    return [np.array([n, width, top >> width], np.int64), low, high, ones]


class Sequence:
    """Reads and searches of an Elias-Fano coded ascending sequence."""

    def __init__(self, parts: list[np.ndarray]):
        (self.size, self.width, self.top), self.low, self.high, self.ones = map(int, parts[0]), *parts[1:]
        self.zeros = np.arange(len(self.high), dtype=np.int64) * 64 - self.ones

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        value = self.low[word] >> shift
        over = np.flatnonzero(shift > np.uint64(64 - self.width))
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return value & np.uint64((1 << self.width) - 1)

    def read(self, at: np.ndarray) -> np.ndarray:
        """The values at these places."""
        word = np.searchsorted(self.ones, at, "right") - 1
        place = word * 64 + _select(self.high[word], at - self.ones[word])
        return ((place - at).astype(np.uint64) << np.uint64(self.width)) | self._low(at)

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values with this high part begin and end: the set bits between the zero that closes the bucket before and the next zero."""
        zero = high - 1
        word = np.maximum(np.searchsorted(self.zeros, zero, "right") - 1, 0)
        held = self.high[word]
        bit = _select(~held, np.maximum(zero - self.zeros[word], 0)) + 1
        bit[high == 0] = 0  # nothing closes before the first bucket
        at = word * 64 + bit - high
        # The run of set bits from there; one that fills its word goes on in the next ones.
        rest = np.where(bit < 64, held >> np.minimum(bit, 63).astype(np.uint64), np.uint64(0))
        run = np.bitwise_count((rest ^ (rest + _ONE)) >> _ONE).astype(np.int64)
        full = np.flatnonzero(bit + run >= 64)
        run[full] = np.minimum(run[full], 64 - bit[full])
        word = word[full]
        while len(full):
            word = word + 1
            more = np.bitwise_count((self.high[word] ^ (self.high[word] + _ONE)) >> _ONE).astype(np.int64)
            more[self.high[word] == ~np.uint64(0)] = 64
            run[full] += more
            full, word = full[more == 64], word[more == 64]
        return at, at + run

    def successor(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place whose value is at least this, the sequence's size where there is none; and whether it is this value."""
        if not self.size:
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        wanted = wanted.astype(np.uint64)
        high = wanted >> np.uint64(self.width)
        beyond = high > np.uint64(self.top)
        at, end = self._bucket(np.minimum(high, np.uint64(self.top)).astype(np.int64))
        low = wanted & np.uint64((1 << self.width) - 1)
        stop, same = end.copy(), np.zeros(len(wanted), bool)
        open_ = np.flatnonzero(at < stop)
        while len(open_):  # as many turns as the largest bucket has bits in its size
            middle = (at[open_] + stop[open_]) >> 1
            held = self._low(middle)
            less = held < low[open_]
            same[open_] |= held == low[open_]
            at[open_] = np.where(less, middle + 1, at[open_])
            stop[open_] = np.where(less, stop[open_], middle)
            open_ = open_[at[open_] < stop[open_]]
        return np.where(beyond, self.size, at), same & ~beyond


class Trie:
    """Levels of words by context. Entry k of a level is the context of range k of the next one."""

    def __init__(self, roots: np.ndarray, words: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], codes: list[np.ndarray]):
        """roots: ascending keys of the first level; words: ascending keys of the words below it; levels: (context entry, place of the word in
        words), ascending, for each level below the first; codes: of each level's entries."""
        parts = [elias_fano(roots), elias_fano(words)]
        contexts = len(roots)
        for context, word in levels:
            pointers = np.searchsorted(context, np.arange(contexts + 1))
            last = np.flatnonzero(np.diff(np.append(context, -1)) != 0)
            ends = np.cumsum(word[last] + 1)
            reached = np.repeat(ends - (word[last] + 1), np.diff(np.concatenate([[-1], last])))
            parts += [elias_fano(pointers), elias_fano(reached + word + 1)]
            contexts = len(context)
        views = self._map([*parts, *([c] for c in codes)])
        self.roots, self.words, *rest = map(Sequence, views[: len(parts)])
        self.levels = list(zip(rest[::2], rest[1::2], strict=True))
        self.codes = [v[0] for v in views[len(parts) :]]

    def _map(self, parts: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
        """The arrays, moved into one anonymous memory map."""
        self.bytes = sum(-(-a.nbytes // 8) * 8 for part in parts for a in part)
        self.map, at, out = mmap.mmap(-1, max(self.bytes, 1)), 0, []
        for part in parts:
            out.append([])
            for a in part:
                view = np.frombuffer(self.map, a.dtype, a.size, at)
                view[:] = a
                out[-1].append(view)
                at += -(-a.nbytes // 8) * 8
        return out

    @staticmethod
    def _found(sequence: Sequence, keys: np.ndarray) -> np.ndarray:
        at, same = sequence.successor(keys)
        return np.where(same, at, -1)

    def root(self, keys: np.ndarray) -> np.ndarray:
        """Entries of the first level with these keys, -1 where there is none."""
        return self._found(self.roots, keys)

    def word(self, keys: np.ndarray) -> np.ndarray:
        """Places of these words, -1 where the trie has none such below its first level."""
        return self._found(self.words, keys)

    def below(self, level: int, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Entries of a level (0 is the one below the first) for (context entry of the level above, place of the word); -1 where there is none, or where either is -1."""
        pointers, values = self.levels[level]
        out = np.full(len(words), -1)
        some = np.flatnonzero((contexts >= 0) & (words >= 0))
        if not len(some):
            return out
        # A context is read once however many words are asked of it.
        context = contexts[some]
        first = np.concatenate([[True], context[1:] != context[:-1]])
        asked = context[first]
        low, high = pointers.read(asked).astype(np.int64), pointers.read(asked + 1).astype(np.int64)
        reached = np.zeros(len(asked), np.uint64)
        after = np.flatnonzero((low > 0) & (low < high))
        reached[after] = values.read(low[after] - 1)
        place = np.cumsum(first) - 1
        at, same = values.successor(reached[place] + words[some].astype(np.uint64) + _ONE)
        same &= (at >= low[place]) & (at < high[place])
        out[some[same]] = at[same]
        return out
