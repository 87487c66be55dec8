"""Adaptive context-mixing range coder for token ids, in blocks that are coded side by side.

A chunk is cut into blocks of ``BLOCK`` ids. Every block starts from the same fresh models and carries a checksum, so it
can be decoded alone, with the chunk's head. Blocks are independent, which lets numpy code the n-th id of all blocks of a
chunk in one step.

Model of an id: order 2 names one id from the last two ids, order 1 one from the last id; order 0 gives every id of the
chunk a probability by its count there. The choice between the three is mixed from two adaptive distributions, one by the
confidence of each naming order, with weights that follow their success. An id that neither order names is coded by
order 0. The chunk's head holds the counts, and for every id its commonest successor, which order 1 names until the block
has shown another.

Intervals go to a range coder with 48-bit low ends: 16 bits leave at a time, carries run back into what was written when all
is coded. Steps work in arrays that are made once, on whole rows of blocks rather than on picked ones.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
_T2, _T1 = 4096, 1024
#: Counts of a chunk are scaled to this sum.
_SCALE = 20
_LOW, _MASK48, _MASK49 = 1 << 32, (1 << 48) - 1, (1 << 49) - 1
#: An entry of a naming table that names no id yet.
_EMPTY = 4 << 16
#: What a choice adds to a distribution of which a 32nd is taken, by choice, and the bits of both 32nds.
_GAIN = np.array([2040, 2040 << 32, 0])
_FIFTH = 0x7FF << 32 | 0x7FF
#: What an entry gains, by its confidence: where its id did not come, then where it came. ``_REPLACE``: the id that came takes its place.
_REPLACE = 1 << 30
_STEP = np.array([_REPLACE, -65536, -65536, -65536, _REPLACE, 65536, 65536, 65536, 0, -_EMPTY], np.int32)
_FIVE = np.int32(5)


class _Head:
    """What all blocks of a chunk start from: scaled counts and the commonest successor of each id."""

    def __init__(self, known: np.ndarray, width: np.ndarray, successor: np.ndarray):
        self.known, self.narrow, self.follows = known, width, successor
        self.width, self.start, self.successor = (np.zeros(1 << 16, np.int32) for _ in range(3))
        self.width[known], self.start[known], self.successor[known] = width, np.cumsum(width) - width, successor

    @classmethod
    def of(cls, ids: np.ndarray) -> _Head:
        """``ids`` are unsigned 16-bit integers."""
        counts = np.bincount(ids, minlength=1 << 16)
        known = np.flatnonzero(counts)
        width = np.maximum(counts[known] * ((1 << _SCALE) - len(known)) // len(ids), 0) + 1
        width[counts[known].argmax()] += (1 << _SCALE) - width.sum()
        pairs = np.sort(ids[:-1].astype(np.uint32) << 16 | ids[1:])
        new = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
        n, pairs = np.diff(new, append=len(pairs)), pairs[new].astype(np.int64)
        first = pairs >> 16
        at = np.flatnonzero(np.diff(first, prepend=-1))
        best = np.zeros(1 << 16, np.int64)
        if len(at):
            best[first[at]] = np.maximum.reduceat(n << 16 | pairs & 0xFFFF, at) & 0xFFFF
        return cls(known, width, best[known])

    def pack(self) -> bytes:
        parts = np.diff(self.known, prepend=0).astype("<u2").tobytes() + self.narrow.astype("<u4").tobytes() + self.follows.astype("<u2").tobytes()
        data = zlib.compress(parts, 6)
        return struct.pack("<II", len(self.known), len(data)) + data

    @classmethod
    def unpack(cls, data: bytes, at: int) -> tuple[_Head, int]:
        n, size = struct.unpack_from("<II", data, at)
        try:
            parts = zlib.decompress(data[at + 8 : at + 8 + size])
        except zlib.error as e:
            raise ValueError("the head is damaged") from e
        known = np.cumsum(np.frombuffer(parts, "<u2", n).astype(np.int64))
        return cls(known, np.frombuffer(parts, "<u4", n, 2 * n).astype(np.int64), np.frombuffer(parts, "<u2", n, 6 * n).astype(np.int64)), at + 8 + size


class _Models:
    """The models of ``n`` blocks at the same place, in whole numbers, so that every machine decodes alike.

    A row of a naming table holds an id and, above bit 16, its confidence from 0 to 3, or ``_EMPTY``. A distribution
    holds the chances, of 65536, of order 2's and order 1's id, 32 bits apart; the rest is order 0's. Both orders' tables
    and distributions are one array each, order 2's first, and what is read from them has ``n`` values of order 2, then
    ``n`` of order 1.
    """

    def __init__(self, n: int, head: _Head):
        self.n, self.lane, self.successor = n, np.arange(n), head.successor
        self.tables = np.full(n * (_T2 + _T1), _EMPTY, np.int32)
        self.mixes = np.full(n * 10, 6554 | 9830 << 32)  # by confidence, or where the table has no entry
        self.table_lane = np.concatenate([self.lane * _T2, n * _T2 + self.lane * _T1])
        self.mix_lane = np.arange(2 * n) * 5
        self.weight = np.full(n, 2048, np.float32)  # of order 2's distribution, of 4096
        self.last, self.before = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.bounds, self.parts = np.zeros((4, n), np.int64), np.zeros((3, n), np.int64)
        self.bounds[3] = 65536
        self.slot, self.at = np.empty(2 * n, np.int64), np.empty(2 * n, np.int64)
        self.key, self.near, self.far = (np.empty(n, np.uint32) for _ in range(3))
        self.taken, self.ids = np.empty(2 * n, np.int64), np.empty((2, n), np.int32)
        self.chosen = np.empty(n, np.int64)

    def predict(self) -> tuple[np.ndarray, ...]:
        """The ids named by order 2 and order 1 and the upper ends, of 65536, of their choices."""
        n, near, far = self.n, self.near, self.far
        np.multiply(self.last.view(np.uint32), 0x9E3B, out=near)
        np.multiply(self.before.view(np.uint32), 0x5BD1, out=far)
        np.add(far, near, out=far)
        np.right_shift(far, 3, out=far)
        np.bitwise_and(far, _T2 - 1, out=self.slot[:n], casting="unsafe")
        np.right_shift(near, 4, out=near)
        np.bitwise_and(near, _T1 - 1, out=self.slot[n:], casting="unsafe")
        np.add(self.slot, self.table_lane, out=self.slot)
        self.entry = self.tables.take(self.slot)
        self.conf = self.entry >> 16
        self.named = self.entry & 0xFFFF
        np.add(self.mix_lane, self.conf, out=self.at)
        self.chance = self.mixes.take(self.at)
        weight = self.weight.astype(np.int64)
        mixed = self.chance[:n] * weight
        np.subtract(4096, weight, out=weight)
        np.multiply(weight, self.chance[n:], out=weight)
        np.add(mixed, weight, out=mixed)
        upper1, upper2 = self.bounds[1], self.bounds[2]
        np.bitwise_and(mixed, 0xFFFFFFFF, out=upper1)
        np.right_shift(upper1, 12, out=upper1)
        np.right_shift(mixed, 44, out=mixed)
        np.add(upper1, mixed, out=upper2)
        return self.named[:n], np.where(self.conf[n:] == 4, self.successor.take(self.last), self.named[n:]), upper1, upper2

    def interval(self, choice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width, of 65536, of each block's choice."""
        np.multiply(choice, self.n, out=self.chosen)
        np.add(self.chosen, self.lane, out=self.chosen)
        start, self.width = self.bounds.take(self.chosen), self.bounds[1:].take(self.chosen)
        np.subtract(self.width, start, out=self.width)
        return start, self.width

    def learn(self, ids: np.ndarray, choice: np.ndarray) -> None:
        """``ids`` are 32-bit integers."""
        n, p2 = self.n, self.chance[: self.n]
        named, other = np.bitwise_and(p2, 0xFFFF, out=self.parts[0]), np.right_shift(p2, 32, out=self.parts[1])
        np.subtract(65536 - named, other, out=self.parts[2])
        ratio = self.parts.take(self.chosen).astype(np.float32)
        np.divide(ratio, self.width.astype(np.float32), out=ratio)
        np.multiply(ratio, np.float32(0.06), out=ratio)
        np.add(ratio, np.float32(0.94), out=ratio)
        np.multiply(self.weight, ratio, out=self.weight)
        np.clip(self.weight, 82, 4014, out=self.weight)
        np.right_shift(self.chance, 5, out=self.taken)
        np.bitwise_and(self.taken, _FIFTH, out=self.taken)
        np.subtract(self.chance, self.taken, out=self.taken)
        both = self.taken.reshape(2, n)
        np.add(both, _GAIN.take(choice), out=both)
        self.mixes[self.at] = self.taken
        self.ids[:] = ids
        ids = self.ids.reshape(-1)
        key = np.multiply(self.named == ids, _FIVE)
        np.add(key, self.conf, out=key)
        step = _STEP.take(key)
        self.tables[self.slot] = np.where(step == _REPLACE, ids, np.add(step, self.entry))
        self.before, self.last = self.last, ids[:n].copy()


def _encode_blocks(ids: np.ndarray, head: _Head) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` is (BLOCK, blocks), of unsigned 16-bit integers. The 16-bit words, (most, blocks), and how many each block has.

    Every settling puts a block's upper bits behind its words, where they stay if the place moves on. A carry stays with its
    word, as bit 16, until all is coded.
    """
    steps, n = ids.shape
    models = _Models(n, head)
    out = np.zeros((2 * steps + 4, n), np.uint32)
    words, pos = out.reshape(-1), np.arange(n)
    low, size = np.zeros(n, np.int64), np.full(n, _MASK48)
    upper = low.view("<u4")[1::2]
    unit, part = np.empty(n, np.int64), np.empty(n, np.int64)

    def settle() -> None:
        small = size < _LOW
        words[pos] = upper
        np.multiply(small, n, out=part)
        np.add(pos, part, out=pos)
        shift = np.left_shift(small, 4, out=part)
        np.left_shift(low, shift, out=low)
        np.left_shift(size, shift, out=size)
        np.bitwise_and(low, np.subtract(_MASK49, np.left_shift(small, 48, out=part), out=part), out=low)  # the carry leaves with its word

    for t in range(steps):
        x = ids[t].astype(np.int32)
        c2, c1, _, _ = models.predict()
        other = x != c2
        spelled = other & (x != c1)
        choice = np.add(other, spelled, dtype=np.int64)
        start, width = models.interval(choice)
        np.right_shift(size, 16, out=unit)
        np.add(low, np.multiply(unit, start, out=part), out=low)
        np.multiply(unit, width, out=size)
        settle()
        who = np.flatnonzero(spelled)
        value, one = x.take(who), size.take(who) >> _SCALE
        low[who] += one * head.start.take(value)
        size[who] = one * head.width.take(value)
        settle()
        models.learn(x, choice)
    for last in (upper, low >> 16 & 0xFFFF, low & 0xFFFF):
        words[pos] = last
        pos += n
    counts = pos // n
    out = out[: counts.max()]
    for above, row in zip(out[-2::-1], out[:0:-1], strict=True):
        above += row >> 16
    return out.astype(np.uint16), counts


def _decode_blocks(words: np.ndarray, steps: int, head: _Head) -> np.ndarray:
    """The inverse: ``words`` is (most, blocks), zeros behind each block's own."""
    n, last = words.shape[1], words.size - words.shape[1] + np.arange(words.shape[1])
    models = _Models(n, head)
    owner = np.repeat(head.known.astype(np.uint16), head.narrow)  # the id at each place of the scale
    ids = np.zeros((steps, n), np.uint16)
    first = words[:3].astype(np.int64)
    code = first[0] << 32 | first[1] << 16 | first[2]
    pos, size, words = np.arange(n) + 3 * n, np.full(n, _MASK48), words.reshape(-1)
    unit, part, shift = (np.empty(n, np.int64) for _ in range(3))

    def settle() -> None:
        small = size < _LOW
        np.multiply(words.take(pos), small, out=part)
        np.left_shift(small, 4, out=shift)
        np.left_shift(code, shift, out=code)
        np.bitwise_or(code, part, out=code)
        np.left_shift(size, shift, out=size)
        np.add(pos, np.multiply(small, n, out=part), out=pos)
        np.minimum(pos, last, out=pos)

    for t in range(steps):
        c2, c1, upper1, upper2 = models.predict()
        np.right_shift(size, 16, out=unit)
        other, spelled = code >= np.multiply(unit, upper1, out=part), code >= np.multiply(unit, upper2, out=shift)
        choice = np.add(other, spelled, dtype=np.int64)
        start, width = models.interval(choice)
        np.subtract(code, np.multiply(unit, start, out=part), out=code)
        np.multiply(unit, width, out=size)
        settle()
        x = np.where(other, c1, c2)
        who = np.flatnonzero(spelled)
        if len(who):
            one, rest = size.take(who) >> _SCALE, code.take(who)
            value = owner.take(np.minimum(rest // one, len(owner) - 1))
            code[who] = rest - one * head.start.take(value)
            size[who] = one * head.width.take(value)
            settle()
            x[who] = value
        ids[t] = x
        models.learn(x, choice)
    return ids


def encode(ids: np.ndarray) -> bytes:
    """A chunk: number of ids and blocks, the head, then each block's words and checksum, then the words of all blocks."""
    n = len(ids)
    if n and (ids.min() < 0 or ids.max() > 65535):
        raise ValueError("ids must be below 65536")
    if not n:
        return struct.pack("<II", 0, 0)
    steps = min(BLOCK, n)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * steps, ids[-1], np.uint16)
    padded[:n] = ids
    head = _Head.of(padded)
    words, counts = _encode_blocks(np.ascontiguousarray(padded.reshape(blocks, steps).T), head)
    sums = [zlib.crc32(ids[a : a + BLOCK].astype("<u4").tobytes()) for a in range(0, n, BLOCK)]
    mask = np.arange(len(words))[None, :] < counts[:, None]
    table = np.stack([counts, np.array(sums)], axis=1).astype("<u4")
    return struct.pack("<II", n, blocks) + head.pack() + table.tobytes() + words.T[mask].astype("<u2").tobytes()


def decode(data: bytes) -> np.ndarray:
    """The ids of a chunk; ValueError where the head is damaged or a block's checksum does not hold."""
    n, blocks = struct.unpack_from("<II", data)
    if not n:
        return np.zeros(0, np.int64)
    head, at = _Head.unpack(data, 8)
    table = np.frombuffer(data, "<u4", 2 * blocks, at).reshape(blocks, 2).astype(np.int64)
    flat = np.frombuffer(data, "<u2", int(table[:, 0].sum()), at + 8 * blocks)
    words = np.zeros((blocks, int(table[:, 0].max()) + 4), np.uint16)
    words[np.arange(words.shape[1])[None, :] < table[:, :1]] = flat
    ids = _decode_blocks(np.ascontiguousarray(words.T), min(BLOCK, n), head).T.reshape(-1)[:n].astype(np.int64)
    for i, a in enumerate(range(0, n, BLOCK)):
        if zlib.crc32(ids[a : a + BLOCK].astype("<u4").tobytes()) != table[i, 1]:
            raise ValueError(f"block {i} is damaged")
    return ids
