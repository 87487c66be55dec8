"""Token ids of whole texts by the tokenizers library; words that come again are encoded once.

The byte-level vocabularies start a new token at every space that a visible character follows. Texts are therefore cut
there, each distinct piece is encoded once by the library and the ids are put together by numpy. A text in which white
space or its end follows a space is encoded as it stands. A new token also starts where a letter ends before an ASCII mark
other than the apostrophe, and where a letter follows a line's end that follows a visible ASCII character; texts are cut
there, too (of letters, those up to U+00FF are looked for), so a word has one piece whatever mark comes after it.

Pieces of up to seven bytes are their own keys. Longer ones have hashes as keys, and every use of a stored piece compares
its bytes first: where they differ, the text goes to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from .shingles import hashes_of, ragged, runs

#: Distinct pieces whose ids a worker keeps; the store is emptied beyond. Some 60 MB.
STORE_PIECES = 800_000
#: Pieces that are looked up at a time, so that a very long text needs no long arrays.
WINDOW = 1 << 19
#: Bytes that may begin white space: a space before one of them is no safe cut.
_unsafe = np.zeros(256, dtype=bool)
_unsafe[[*range(9, 14), 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Pieces that go to the library in one string: longer strings take more time a piece.
TOGETHER = 256
#: What a byte is: an ASCII letter, an ASCII mark, another visible ASCII character, the second byte of a letter after 0xC3.
_LETTER, _MARK, _OTHER, _SECOND = 1, 2, 3, 4
_kind = np.zeros(256, dtype=np.uint8)
_kind[33:127] = _OTHER
_kind[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = _MARK
_kind[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
_kind[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = _SECOND  # U+00D7 and U+00F7 are no letters
_LONG, _FIRST = np.uint64(1 << 63), np.uint64(1 << 62)
_encoders: dict = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file: tasks that follow in the same worker find its pieces again."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """``encode(texts)`` gives each text's ids as an array of unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        vocab = self.model.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)  # bytes of a token: its string has a letter for each
        self.width[list(vocab.values())] = [len(t) for t in vocab]
        self._empty()

    def _empty(self) -> None:
        self.known = np.empty(0, dtype=np.uint64)
        self.start, self.length = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
        self.ids = np.empty(0, dtype=np.uint32)
        self.first, self.size, self.at = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.further = np.empty(0, dtype=np.uint64)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin with a space, and their numbers."""
        if not pieces:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        ids = np.concatenate([self._raw([b"".join(pieces[a : a + TOGETHER]).decode()])[0] for a in range(0, len(pieces), TOGETHER)])
        stops = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(p) for p in pieces]), side="left") + 1
        return ids, np.diff(stops, prepend=0)

    def _learn(self, data: bytes, keys: np.ndarray, start: np.ndarray, end: np.ndarray, lead: np.ndarray) -> None:
        """Store new pieces; ``keys`` are sorted."""
        inner, own = np.flatnonzero(~lead), np.flatnonzero(lead)
        ids, counts = self._pieces([data[a - 1 : b] for a, b in zip(start[inner].tolist(), end[inner].tolist(), strict=True)])
        raw = self._raw([data[a:b].decode() for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)])
        length = np.zeros(len(keys), dtype=np.int32)
        length[inner], length[own] = counts, [len(x) for x in raw]
        starts = np.zeros(len(keys), dtype=np.int64)
        starts[inner] = len(self.ids) + np.cumsum(length[inner]) - length[inner]
        starts[own] = len(self.ids) + len(ids) + np.cumsum(length[own]) - length[own]
        self.ids = np.concatenate([self.ids, ids, *raw])
        first, further, more = runs(data, start, end)
        at = np.searchsorted(self.known, keys)
        for name, new in (("known", keys), ("start", starts), ("length", length), ("first", first), ("size", end - start), ("at", len(self.further) + np.cumsum(more) - more)):
            setattr(self, name, np.insert(getattr(self, name), at, new))
        self.further = np.concatenate([self.further, further])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b" ".join([*raw, b" "]), dtype=np.uint8)
        space = np.flatnonzero(data[:-1] == 32)
        risky = space[_unsafe[data[space + 1]]]
        stops = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1) - 1  # the space behind each text
        inside = risky[~np.isin(risky, stops)]
        whole = set(np.searchsorted(stops, inside).tolist())
        rest = [i for i in range(len(texts)) if i not in whole]
        out: list = [None] * len(texts)
        if rest:
            for i, ids in zip(rest, self._fast([raw[i] for i in rest]), strict=True):
                out[i] = ids
        whole = [i for i in range(len(texts)) if out[i] is None]
        if whole:
            for i, ids in zip(whole, self._raw([raw[i].decode() for i in whole]), strict=True):
                out[i] = ids
        return out

    def _fast(self, raw: list[bytes]) -> list[np.ndarray | None]:
        """The ids of each text, None where a piece has the key of another."""
        joined = b" ".join([*raw, bytes(8)])
        data = np.frombuffer(joined, dtype=np.uint8)
        end = np.flatnonzero(_stops(data))
        space = data[end[:-1]] == 32
        start = np.concatenate([[0], end[:-1] + space])
        lead = np.concatenate([[True], ~space])
        begins = np.searchsorted(start, np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1) - 1, side="right")
        begins = np.concatenate([[0], begins])  # the first piece of each text, and their number
        lead[begins[:-1]] = True
        ids, ends, wrong = [], [np.zeros(1, dtype=np.int64)], np.zeros(len(start), dtype=bool)
        for w in range(0, len(start), WINDOW):
            got, length, other = self._window(joined, start[w : w + WINDOW], end[w : w + WINDOW], lead[w : w + WINDOW])
            ids.append(got)
            ends.append(ends[-1][-1] + np.cumsum(length))
            wrong[w : w + WINDOW] = other
        cuts = np.concatenate(ends)[begins[1:-1]]
        out: list = np.split(np.concatenate(ids), cuts)
        for i in np.unique(np.searchsorted(begins, np.flatnonzero(wrong), side="right") - 1).tolist():
            out[i] = None
        return out

    def _window(self, joined: bytes, start: np.ndarray, end: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of some pieces, the number of each piece's, and whether its bytes are not those of the stored piece."""
        size = end - start
        first, further, more = runs(joined, start, end)
        keys = np.where(size < 8, first | size.astype(np.uint64) << np.uint64(56), hashes_of(first, further, more, size) >> np.uint64(2) | _LONG) | lead * _FIRST
        back, distinct = pd.factorize(keys)
        rank = distinct.argsort()
        place, ranked = np.empty(len(distinct), dtype=np.int64), distinct[rank]
        if len(self.known) > STORE_PIECES:
            self._empty()
        place[rank] = np.searchsorted(self.known, ranked)
        new = np.ones(len(distinct), dtype=bool) if not len(self.known) else self.known[np.minimum(place, len(self.known) - 1)] != distinct
        if new.any():
            at = np.flatnonzero(np.diff(np.maximum.accumulate(back), prepend=-1))[new]  # distinct keys are in the order of their first places
            at = at[keys[at].argsort()]
            self._learn(joined, keys[at], start[at], end[at], lead[at])
            place[rank] = np.searchsorted(self.known, ranked)
        entry = place[back]
        length = self.length[entry].astype(np.int64)
        other = (self.first[entry] != first) | (self.size[entry] != size)
        long = np.flatnonzero((more > 0) & ~other)
        stored = self.further[ragged(self.at[entry[long]], more[long])]
        mine = further if len(long) == np.count_nonzero(more) else further[ragged((np.cumsum(more) - more)[long], more[long])]
        differs = np.flatnonzero(stored != mine)
        other[long[np.searchsorted(np.cumsum(more[long]), differs, side="right")]] = True
        return self.ids[ragged(self.start[entry], length)], length, other


def _stops(data: np.ndarray) -> np.ndarray:
    """Where a piece ends: at a space, which is not of it, or where the next piece begins."""
    kind = _kind[data]
    letter = kind == _LETTER
    ends = letter.copy()
    ends[1:] |= (kind[1:] == _SECOND) & (data[:-1] == 0xC3)
    stops = data == 32
    stops[1:] |= ends[:-1] & (kind[1:] == _MARK)
    line = np.flatnonzero(data[1:-1] == 10) + 2  # what follows a line's end
    seen = kind[line - 2]
    stops[line[(seen >= _LETTER) & (seen <= _OTHER) & (letter[line] | (data[line] == 0xC3))]] = True
    return stops


def text_slices(texts, chars: int = 1 << 20):
    """(from, to) of runs of rows with about ``chars`` characters, so that work arrays stay small."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
