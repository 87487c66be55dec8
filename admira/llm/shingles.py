"""Hashes of words and word shingles for many texts at once, in numpy.

A word is cut into runs of eight bytes; every run goes through a non-linear mixer together with its place, and the mixed
runs are summed and mixed again with the word's length. No polynomial in the letters is left that chosen words could
cancel, as patterns of repeated letters do in hashes modulo a power of two.
"""

from __future__ import annotations

import numpy as np

_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_gap = np.zeros(256, dtype=bool)
_gap[[32, *range(9, 14)]] = True
#: The lowest 0 to 8 bytes of a run.
_bytes = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
#: Bytes that are cut into words at a time, about.
WINDOW = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start[i] .. start[i] + length[i] - 1 of all i, one after another."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def runs(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first run of each word; the further runs of the words that have more, one after another; and how many each has.

    ``data`` ends with eight bytes that belong to no word.
    """
    view = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    size = end - start
    first = view[start] & _bytes[np.minimum(size, 8)]
    more = np.maximum((size + 7 >> 3) - 1, 0)
    long = np.flatnonzero(more)
    n = more[long]
    at = np.repeat(start[long], n) + 8 * (ragged(np.zeros(len(n), dtype=np.int64), n) + 1)
    return first, view[at] & _bytes[np.minimum(np.repeat(end[long], n) - at, 8)], more


def hashes_of(first: np.ndarray, further: np.ndarray, more: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of words given as ``runs`` gives them."""
    out = mix(first ^ mix(size.astype(np.uint64) + np.uint64(_MULT)))
    long = np.flatnonzero(more)
    if len(long):
        n = more[long]
        place = ragged(np.ones(len(n), dtype=np.int64), n).astype(np.uint64)
        begins = np.cumsum(n) - n
        out[long] = mix(out[long] + np.add.reduceat(mix(further ^ mix(place * np.uint64(_MULT))), begins))
    return out


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and the number of words of each text."""
    stops = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    joined = b" ".join(texts).lower() + b" "
    parts, before, lo = [np.empty(0, dtype=np.uint64)], np.zeros(len(texts), dtype=np.int64), 0
    made = 0
    while lo < len(joined):
        hi = joined.rfind(b" ", lo, lo + WINDOW) + 1 or joined.find(b" ", lo) + 1
        part = joined[lo:hi] + bytes(8)
        edges = np.flatnonzero(np.diff(_gap[np.frombuffer(part, dtype=np.uint8, count=hi - lo)], prepend=True))
        start, end = edges[0::2], edges[1::2]
        first, further, more = runs(part, start, end)
        parts.append(hashes_of(first, further, more, end - start))
        a, b = np.searchsorted(stops, [lo, hi], side="right")
        before[a:b] = made + np.searchsorted(start, stops[a:b] - lo)
        made, lo = made + len(start), hi
    return np.concatenate(parts), np.diff(before, prepend=0)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of ``k`` words of each text; of fewer words, their whole sequence as one."""
    hashes, counts = words(texts)
    rolled = np.zeros(max(len(hashes) - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        rolled += hashes[j : j + len(rolled)] * np.uint64((_MULT * (2 * j + 3) | 1) & _MASK)
    rolled = mix(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            s = np.sort(rolled[at : at + n - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n:
            s = mix(np.array([sum(int(h) * (_MULT * (2 * j + 3) | 1) for j, h in enumerate(hashes[at : at + n])) + n & _MASK], dtype=np.uint64))
        else:
            s = np.empty(0, dtype=np.uint64)
        out.append(s)
        at += n
    return out
