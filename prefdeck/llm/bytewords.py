"""Words of many texts at once: numpy over UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
# Odd multipliers of the word hash and of its finishing steps (fixed values).
STEP, MIX_1, MIX_2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# A word of letters and digits: 0-9, a-z and everything outside ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

# A word is what stands between ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[0x09:0x0E] = NOT_SPACE[0x20] = False


# Masks for the lowest 0 to 8 bytes.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> U(30))) * MIX_1
    x = (x ^ (x >> U(27))) * MIX_2
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words in text order. Those of text i are ``first[i]:first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of a ``kind`` (a table of 256 truth values) that stay in one text."""
    inside = kind[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    after = np.empty(len(data), bool)  # the byte before is outside, or of another text
    after[1:] = ~inside[:-1]
    if len(data):
        after[0] = True
    after |= edges[:-1]
    before = np.empty(len(data), bool)
    before[:-1] = ~inside[1:]
    if len(data):
        before[-1] = True
    before |= edges[1:]
    start = np.flatnonzero(inside & after)
    end = np.flatnonzero(inside & before) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def tokens_of(data: np.ndarray, words: Words) -> pa.DictionaryArray:
    """The words as codes into their distinct values, compared byte by byte. ``words``: all runs of bytes
    outside white space."""
    ends = np.append(0, np.cumsum(words.end - words.start)).astype(np.int64)
    packed = data[NOT_SPACE[data]]  # the words without what stands between them
    column = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(packed)])
    return column.dictionary_encode()


def lanes_of(data: np.ndarray, words: Words, n: int) -> np.ndarray:
    """The first 8 n bytes of each word as ``n`` numbers, zeros behind its end. Words of no more bytes are
    equal exactly if their numbers and sizes are."""
    padded = np.concatenate([data, np.zeros(8 * n + 8, np.uint8)])
    view = np.ndarray((len(data) + 8 * n,), "<u8", padded, strides=(1,))
    size = words.end - words.start
    out = np.empty((len(size), n), U)
    for k in range(n):
        out[:, k] = view[words.start + 8 * k] & KEEP[np.clip(size - 8 * k, 0, 8)]
    return out


def hash_words(data: np.ndarray, words: Words) -> np.ndarray:
    """64 bits for each word. Words of up to 8 bytes never collide with one another before mixing;
    longer ones are folded in steps of 8 bytes."""
    n = len(words.start)
    size = words.end - words.start
    out = mix(size.astype(U) * STEP)
    if not n:
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    # Eight bytes from any place on, as one number: an unaligned view, one entry per byte.
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    at, left, live = words.start, size, np.arange(n)
    while len(live):
        window = lanes[at] & KEEP[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ window) * STEP + U(1))
        going = left > 8
        live, at, left = live[going], at[going] + 8, left[going] - 8
    return out
