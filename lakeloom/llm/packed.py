"""Sorted 64-bit keys, and numbers of so many bits, as short byte strings."""

from __future__ import annotations

import numpy as np

from lakeloom.llm.trie import elias_fano

FEW = 8


def bits_of(values: np.ndarray, width: int) -> bytes:
    """Numbers below 2**width, one after another, width bits each; width is at most 56."""
    out = np.zeros(len(values) * width // 8 + 9, np.uint8)
    bit = np.arange(len(values), dtype=np.int64) * width
    at, held = bit >> 3, values.astype(np.uint64) << (bit & 7).astype(np.uint64)
    for k in range((width + 14) // 8):
        np.bitwise_or.at(out, at + k, (held >> np.uint64(8 * k)).astype(np.uint8))
    return out[: (len(values) * width + 7) // 8].tobytes()


def from_bits(data: bytes, count: int, width: int) -> np.ndarray:
    held = np.frombuffer(data + bytes(8), np.uint8)
    bit = np.arange(count, dtype=np.int64) * width
    at, out = bit >> 3, np.zeros(count, np.uint64)
    for k in range((width + 14) // 8):
        out |= held[at + k].astype(np.uint64) << np.uint64(8 * k)
    return (out >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)


def small(values: np.ndarray) -> bytes:
    """A byte a number; those from 255 on follow in eight bytes each."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<i8").tobytes()


def numbers(data: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, size).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", -1, size)
    return out


def pack(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys, repeats allowed: a few as they are; more as the first one and the Elias-Fano coded distances from it."""
    if len(keys) < FEW:
        return keys.astype("<u8").tobytes()
    (count, width, _), low, high, _ = elias_fano(keys - keys[0])
    words = int(count * width + 63) // 64
    return bytes([width]) + b"".join(x.astype("<u8").tobytes() for x in (keys[:1], np.array([count], np.uint64), low[:words], high))


def unpack(data: bytes) -> np.ndarray:
    if len(data) % 8 == 0:
        return np.frombuffer(data, "<u8")
    width, held = data[0], np.frombuffer(data, "<u8", -1, 1)
    first, count = held[0], int(held[1])
    words = (count * width + 63) // 64
    low, high = held[2 : 2 + words], held[2 + words :]
    at = np.flatnonzero(np.unpackbits(high.view(np.uint8), bitorder="little"))[:count]
    values = (at - np.arange(count)).astype(np.uint64) << np.uint64(width)
    if width:
        low = np.append(low, np.uint64(0))
        bit = np.arange(count, dtype=np.uint64) * np.uint64(width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        part = low[word] >> shift
        over = shift > np.uint64(64 - width)
        part[over] |= low[word[over] + 1] << (np.uint64(64) - shift[over])
        values |= part & np.uint64((1 << width) - 1)
    return values + first
