"""Words of many texts at once, as arrays: where they lie, which text has them, and a hash of each.

Everything here is numpy over the bytes of an Arrow batch, so a task spends some tens of
nanoseconds a word. Bytes of UTF-8 sequences are never separators.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_SEED = U64(0x9E3779B97F4A7C15)
_ONE, _TWO = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
# Longer words are hashed one by one; they are rare, or few bytes of the batch are left for others.
LONG_BYTES = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = (x ^ (x >> U64(30))) * _ONE
    x = (x ^ (x >> U64(27))) * _TWO
    return x ^ (x >> U64(31))


def pair_hash(left: np.ndarray, right: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of two hashes in this order."""
    return mixed((left + U64(salt)) * _SEED + mixed(right ^ U64(salt)))


def _table(separators: bytes) -> np.ndarray:
    inside = np.ones(256, bool)
    inside[np.frombuffer(separators, np.uint8)] = False
    return inside


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins and the last ends; a NULL is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    return data[edges[0]:edges[-1]], edges - edges[0]


class Words:
    """``begin`` and ``end`` of every word in ``data``, its ``text`` number, its ``at`` in that text,
    and ``edges``: where the words of each text begin in these arrays."""

    def __init__(self, texts: pa.Array, separators: bytes, lower: bool = False):
        self.data, bounds = text_bytes(texts)
        if lower:
            upper = (self.data >= 65) & (self.data <= 90)
            self.data = self.data + upper.astype(np.uint8) * np.uint8(32)
        size = len(self.data)
        inside = np.zeros(size + 2, bool)
        inside[1:-1] = _table(separators)[self.data]
        heads = np.zeros(size + 1, bool)
        heads[bounds] = True
        self.begin = np.flatnonzero(inside[1:] & (~inside[:-1] | heads))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | heads))
        self.edges = np.searchsorted(self.begin, bounds)
        counts = np.diff(self.edges)
        self.text = np.repeat(np.arange(len(counts)), counts)
        self.at = np.arange(len(self.begin)) - np.repeat(self.edges[:-1], counts)
        self.left = np.repeat(counts, counts) - self.at

    def __len__(self) -> int:
        return len(self.begin)

    def hashes(self) -> np.ndarray:
        """64 bits a word, of its bytes and length."""
        size = (self.end - self.begin).astype(np.int64)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        found = size.astype(U64) * _SEED
        live = np.flatnonzero(size <= LONG_BYTES)
        begin, rest = self.begin[live], size[live]
        while len(live):
            part = eight[begin] & _MASKS[np.minimum(rest, 8)]
            found[live] = mixed(found[live] ^ part) + _SEED
            more = rest > 8
            live, begin, rest = live[more], begin[more] + 8, rest[more] - 8
        for i in np.flatnonzero(size > LONG_BYTES).tolist():
            found[i] = xxhash.xxh3_64_intdigest(self.data[self.begin[i]:self.end[i]].tobytes())
        return mixed(found)


def windows(hashes: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """A hash of the ``length`` words from every place on, made by doubling.

    The last ``length`` - 1 places, and those whose window leaves their text, hold nonsense.
    """
    found, now, size, left = None, hashes, 1, length
    taken = 0
    while left:
        if left & 1:
            part = shifted(now, taken)
            found = part if found is None else pair_hash(found, part, salt + size)
            taken += size
        left >>= 1
        if left:
            now = pair_hash(now, shifted(now, size), salt)
            size *= 2
    return found


def shifted(values: np.ndarray, by: int) -> np.ndarray:
    """Every place gets the value ``by`` places on; the last ones get 0."""
    if not by:
        return values
    out = np.zeros_like(values)
    if by < len(values):
        out[:-by] = values[by:]
    return out


def sliding(values: np.ndarray, size: int, choose) -> np.ndarray:
    """``choose`` (np.minimum or np.maximum) over ``size`` places from every place on; short at the end."""
    now, reach = values, 1
    while reach < size:
        step = min(reach, size - reach)
        now = now.copy() if step >= len(now) else np.concatenate([choose(now[:-step], now[step:]), now[-step:]])
        reach += step
    return now
