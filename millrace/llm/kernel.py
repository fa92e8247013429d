"""Small numpy helpers that run inside Arrow batches.

All of them work on the UTF-8 bytes of a whole Arrow string column at once, in
slices of at most SLICE bytes (a longer text makes a slice of its own), so a
task's memory follows one slice and not its partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
STEP = U(0x9E3779B97F4A7C15 | 1)
BACK = U(pow(int(STEP), -1, 1 << 64))
PLACE = [U(int(x)) for x in (_rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1))]
#: Span hashes are two polynomials modulo this prime, each with values for the bytes, a base and its inverse.
PRIME = U((1 << 31) - 1)
BITS = U(31)
PARTS = [(_rng.permutation(1 << 20)[:256].astype(np.uint64) * U(2039) + U(int(_rng.integers(1, 1000))), int(_rng.integers(1 << 30, int(PRIME)))) for _ in range(2)]
_powers: dict[tuple[int, bool], np.ndarray] = {}


def fold(x: np.ndarray) -> np.ndarray:
    """A smaller number with the same rest modulo PRIME."""
    return (x & PRIME) + (x >> BITS)


def powers(base: int, n: int, prime: bool = True) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo PRIME or 2 ** 64; kept up to one slice."""
    have = _powers.get((base, prime))
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        out = np.ones(size, np.uint64)
        done = 1
        while done < size:
            step = min(done, size - done)
            more = out[:step] * U(pow(base, done, int(PRIME) if prime else 1 << 64))
            out[done : done + step] = fold(fold(more)) if prime else more
            done += step
        if size > 2 * SLICE:
            return out[:n]
        _powers[base, prime] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """From one pass over data, a function that gives a 64-bit hash of each data[start:end].

    The hash is made of two polynomials modulo a prime, so texts of a simple structure do not collide as
    they do modulo a power of two; two different spans of n bytes agree with probability (n / PRIME) ** 2.
    """
    totals = []
    for table, base in PARTS:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(fold(table[data] * powers(base, len(data))), out=total[1:])
        totals.append(total)

    def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93)
        for (_, base), total, shift in zip(PARTS, totals, (U(0), U(31))):
            back = powers(pow(base, -1, int(PRIME)), len(data) + 1)
            x = fold(fold(fold(fold(total[end] - total[start])) * back[start]))
            h += np.where(x >= PRIME, x - PRIME, x) << shift
        return mix(h)

    return spans


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k bytes, cheap and only good for picking places: equal bytes have equal hashes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(int(STEP), len(data), False), out=total[1:])
    n = len(data) - k + 1
    return mix((total[k:] - total[:n]) * powers(int(BACK), n, False))


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    return hasher(data)(start, end)


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags in each row's stretch."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines, and each row's first line; an empty row has one empty line."""
    breaks = np.flatnonzero(data == 10)
    n = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    first = np.concatenate(([0], np.cumsum(n)))
    start, end = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
    is_head, is_tail = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    is_head[first[:-1]] = True
    is_tail[first[1:] - 1] = True
    start[is_head], start[~is_head] = offsets[:-1], breaks + 1
    end[is_tail], end[~is_tail] = offsets[1:], breaks
    return start, end, first


def slices(column: pa.Array | pa.ChunkedArray, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of at most size (SLICE) bytes; nulls count as empty texts."""
    size = size or SLICE
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        last = min(last, len(column))
        yield row, raw[at[row] : at[last]], at[row : last + 1] - at[row]
        row = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and each row's first word (one more entry than rows)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    start, end = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive entries within each row, and each row's first window."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    begin = np.concatenate(([0], np.cumsum(n)))
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    total = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        total += h[j : j + len(total)] * PLACE[j]
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], n)
    return mix(total[at]), begin


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its lower-cased k-word shingles.

    A row with fewer words has one hash, of all of them; a row without words none.
    """
    start, end, first = words(data, offsets)
    low = LOWER[data]
    h = spans_hash(low, start, end)
    shingle, begin = windows(h, first, k)
    out = []
    for i in range(len(offsets) - 1):
        n = int(first[i + 1] - first[i])
        if n >= k:
            s = np.sort(shingle[begin[i] : begin[i + 1]])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif n:
            few = sum((h[first[i] + j : first[i] + j + 1] * PLACE[k + j] for j in range(n)), np.full(1, n, np.uint64))
            out.append(mix(few))
        else:
            out.append(shingle[:0])
    return out
