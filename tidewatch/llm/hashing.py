"""Hashes of words, word shingles and byte windows of many texts at once, in numpy.

A text's hash is the polynomial of its bytes in BASE, modulo 2**64, read off running
sums and mixed; so all windows of a buffer are hashed by a few passes over it, without
a Python object for any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PIECE = 1 << 18
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)

_powers: dict[np.uint64, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, ..., base ** n."""
    if len(_powers.get(base, ())) <= n:
        steps = np.full(max(2 * n, 2 * PIECE) + 1, base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][: n + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads differences over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def running_sums(b: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """s with s[j] - s[i] = sum of (b[t] + 1) * base ** t over i <= t < j."""
    s = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(base, len(b))[: len(b)], out=s[1:])
    return s


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, one after the other, and the offsets of the texts."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    b = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return b, at - at[0]


def _pieces(b: np.ndarray, at: np.ndarray, spaces: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end at a text's end or before a space."""
    a = 0
    while a < len(b):
        e = min(len(b), a + PIECE)
        while e < len(b):
            k = np.searchsorted(at, e)  # the end of a text
            more = b[e : min(len(b), e + PIECE)]
            space = np.flatnonzero(spaces[more[:4096]])
            space = space if len(space) else np.flatnonzero(spaces[more])
            stop = min(at[k], e + space[0] if len(space) else e + len(more))
            if len(space) or at[k] <= e + len(more):
                e = int(stop)
                break
            e += len(more)
        yield a, e
        a = e


def words(column: pa.Array, spaces: np.ndarray = SPACES, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """(hashes, texts): of every word of a column of texts, with A-Z in lower case, in
    order, the hash and the number of its text. `spaces` tells of each byte whether it parts words.
    With a `prefix`, also the hash of its first so many bytes; 0 for a shorter word."""
    b, at = utf8(column)
    hashes, texts, stems = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    starts = at[:-1]
    for a, e in _pieces(b, at, spaces):
        own = LOWER[b[a:e]]
        ink = ~spaces[own]
        first = ink.copy()
        first[1:] &= ~ink[:-1]
        cut = starts[(starts > a) & (starts < e)] - a
        first[cut] |= ink[cut]
        s = np.flatnonzero(first)
        if not len(s):
            continue
        # A word ends before the next space, text or end of the range.
        stop = np.ones(len(own) + 1, bool)
        stop[:-1] = ~ink
        stop[cut] = True
        ends = np.flatnonzero(stop)
        ends = ends[np.searchsorted(ends, s, side="right")]
        sums = running_sums(own)
        h = (sums[ends] - sums[s]) * powers(INVERSE, len(own))[s]
        hashes.append(mixed(h ^ (ends - s).astype(np.uint64)))
        texts.append(np.searchsorted(at, s + a, side="right") - 1)
        if prefix:
            stem = (sums[np.minimum(s + prefix, len(own))] - sums[s]) * powers(INVERSE, len(own))[s]
            stems.append(np.where(ends - s >= prefix, mixed(stem ^ np.uint64(1 << 62)), np.uint64(0)))
    return (np.concatenate(hashes), np.concatenate(texts), np.concatenate(stems))[: 3 if prefix else 2]


def shingles(hashes: np.ndarray, texts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first words) of the k-word shingles that lie within one text. A text of
    fewer words has none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    if k > 8:  # the same sums, as differences of running ones
        sums = np.append(np.uint64(0), np.cumsum(hashes * powers(BASE, len(hashes))[: len(hashes)], dtype=np.uint64))
        h = (sums[k:] - sums[:-k]) * powers(INVERSE, n)[:n]
    else:
        for i, c in enumerate(powers(BASE, k)[:k]):
            h += hashes[i : i + n] * c
    inside = np.flatnonzero(texts[:n] == texts[k - 1 :])
    return mixed(h[inside]), inside
