"""Words and word shingles as hashes, for whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is a block of its own.
BLOCK = 1 << 20

_RNG = np.random.default_rng(20240501)
BYTE = _RNG.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
TURN = np.uint64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII that is neither letter nor digit.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about BLOCK bytes each."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > BLOCK:
            yield start, i
            start, total = i, 0
        total += int(n)
    if len(sizes):
        yield start, len(sizes)


def word_hashes(texts: pa.Array, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z in lower case, and for each text where its words begin (one more at the end).

    A word is a run of bytes that aren't blank; by default, than space and tab to carriage return. A null text has none.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    ends = offsets - lo
    if hi == lo:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi]
    solid = np.flatnonzero(~blank[raw])
    if not len(solid):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    first = np.ones(len(solid), bool)
    first[1:] = np.diff(solid) > 1
    at = np.searchsorted(solid, ends[:-1])  # a word also begins where a text does
    first[at[at < len(solid)]] = True
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(solid)))
    place = np.arange(len(solid)) - np.repeat(starts, sizes)
    value = BYTE[LOWER[raw[solid]]] * _powers(STEP, int(sizes.max()) + 1)[place]
    hashes = scramble(np.add.reduceat(value, starts) + sizes.astype(np.uint64))
    return hashes, np.searchsorted(solid[starts], ends)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, or of the whole sequence if it is shorter."""
    n = min(size, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * TURN + words[k : len(words) - n + 1 + k]
    return scramble(out + np.uint64(n))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    for a, b in blocks(texts):
        words, at = word_hashes(texts.slice(a, b - a))
        for i in range(b - a):
            s = np.sort(shingles(words[at[i] : at[i + 1]], size))
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
