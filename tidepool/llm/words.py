"""Vectorised word hashing over the bytes of many texts at once.

A text is cut into words at separator bytes, and every word becomes a 64-bit
hash without a Python object for each word: with ``T`` a random value for each
byte and ``R`` an odd number, prefix sums of ``T[byte] * R**i`` give the hash
of any byte range in three operations.  Windows of k words are hashed by
doubling, so a window of 20 words costs five array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed together; a longer text is cut at a separator.
BLOCK = 1 << 20

_MASK = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_T = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
#: A second value for each byte, for hashes that are independent of the first.
OTHER = mix(np.arange(513, 769, dtype=np.uint64) * np.uint64(_R))

#: Separators of plain words: space and the ASCII control blanks 9 to 13.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True


def _folding() -> bytes:
    table = bytearray(b" " * 256)
    for c in range(256):
        if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A:
            table[c] = c
        elif 0x41 <= c <= 0x5A:
            table[c] = c + 32
    return bytes(table)


#: ``bytes.translate`` table: A-Z to lower case, all ASCII but letters and digits to blanks.
FOLD = _folding()

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _R), ("down", _R_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _hash_block(data: np.ndarray, values: np.ndarray = _T) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank = np.ones(len(data) + 2, dtype=np.int8)
    blank[1:-1] = BLANKS[data]
    edges = np.flatnonzero(np.diff(blank))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts, ends
    up, down = _power_table(len(data))
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def hash_words(data: bytes, values: np.ndarray = _T) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (byte offsets) of the words of one text; memory beyond the result is bounded by BLOCK and the longest word."""
    if len(data) <= 2 * BLOCK:
        return _hash_block(np.frombuffer(data, dtype=np.uint8), values)
    parts, at = [], 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and not BLANKS[data[end]]:
            end += 1
        h, s, e = _hash_block(np.frombuffer(data[at:end], dtype=np.uint8), values)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Hashes the words of many texts: yields (first, last, hashes, bounds), where the words of text first + i are hashes[bounds[i]:bounds[i + 1]]."""
    first = 0
    while first < len(texts):
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= BLOCK:
            size += len(texts[last]) + 1
            last += 1
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[first:last]])))
        h, starts, _ = hash_words(b" ".join(texts[first:last]))
        yield first, last, h, np.searchsorted(starts, offsets)
        first = last


def windows(h: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of every k consecutive values: len(h) - k + 1 of them, or none."""
    if k < 1 or len(h) < k:
        return np.empty(0, dtype=np.uint64)
    level, width, power, out, done = h, 1, base, None, 0
    while True:
        if k & width:
            if out is None:
                out, done = level, width
            else:
                n = len(h) - done - width + 1
                out = out[:n] * np.uint64(power) + level[done : done + n]
                done += width
        if done == k:
            return mix(out[: len(h) - k + 1])
        level = level[: len(level) - width] * np.uint64(power) + level[width:]
        power = power * power & _MASK
        width *= 2


def inside(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """For n = len(h) - k + 1 windows: which lie in one text."""
    ok = np.ones(n, dtype=bool)
    for b in bounds[1:-1]:
        ok[max(0, b - k + 1) : b] = False
    return ok


def slices(batches: Iterator[pa.RecordBatch], at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts in column ``at`` are a few MB together: a worker's memory follows that, not the rows in a batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        sums, first = np.cumsum(sizes), 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(sums, most + (sums[first - 1] if first else 0), side="right")))
            yield batch.slice(first, last - first)
            first = last


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """The distinct k-word shingles of one text, sorted; a shorter text is one shingle, a text without words has none."""
    if not len(h):
        return np.empty(0, dtype=np.uint64)
    return np.unique(windows(h, min(k, len(h))))
