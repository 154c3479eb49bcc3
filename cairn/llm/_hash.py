"""Vectorised 64-bit fingerprints of byte and word spans."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = x ^ (x >> U(32))
        x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers and those of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + n // 4, U(base))
            steps[0] = U(1)
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class SpanHash:
    """Fingerprints of any short spans of a sequence of 64-bit values, by polynomial prefix sums.

    Modulo 2^64 some texts over two symbols collide for every base, from 1,024 symbols on. So spans have at most some
    hundred values here, and each value is itself a hash: of a whole word (`word_hashes`) or of eight bytes (`grams`).
    """

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(len(values) + 1)[0][:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = powers(len(self.sums))[1]
        return mix((self.sums[end] - self.sums[start]) * inverse[start] + (end - start).astype(np.uint64))


#: Bytes in a gram.
GRAM = 8
#: Words up to this many bytes are hashed together, longer ones by xxh3.
LONG_WORD = 64
_INSIDE = np.array([(1 << 8 * n) - 1 for n in range(GRAM)] + [(1 << 64) - 1], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """A view of the eight bytes from each place on, zeros after the end."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(GRAM, np.uint8)]), GRAM)


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the eight bytes from each place on."""
    return mix(np.ascontiguousarray(eights(data)[: len(data)]).view(np.uint64).ravel() + U(_BASE))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: eight at a time go through a mixing step that depends on all before them."""
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) + U(_BASE))
    windows, at = eights(data), np.flatnonzero(sizes <= LONG_WORD)
    for lo in range(0, LONG_WORD, GRAM):
        at = at[sizes[at] > lo]
        if not len(at):
            break
        part = windows[starts[at] + lo].view(np.uint64).ravel() & _INSIDE[np.minimum(sizes[at] - lo, GRAM)]
        out[at] = mix((out[at] ^ part) * U(_BASE))
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each row the number of words before it."""
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    starts[rows] = inside[rows]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, in linear time."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
