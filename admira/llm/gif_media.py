"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames and colour histograms.

``decode_gifs`` turns a table with GIF files into a row for each frame: timing, size, the composited colours and a
histogram of them. ``store_texts`` writes payloads losslessly as GIFs of 8-bit grey samples, 64 to a line, in timed frames
of ``FRAME_LINES`` lines; ``read_texts`` reads them back through the same decoder.

The decoder follows the format's rules: code widths grow with the code table, clear codes restart it, interlaced lines
are put in order, a frame's own palette overrides the common one, transparent samples leave what is below, and before the
next frame the area is kept, cleared or restored as the frame's disposal says.

Everything runs row by row within tasks; no data are shuffled and a task holds one file and one of its frames at a time
besides its batch.

Defined results: null files give no frames; a file that is no GIF or ends early gives one row with ``error`` set and null
pixels behind its good frames; a screen of more than ``MOST_PIXELS`` is an error before anything is made for it; null texts are empty payloads; equal texts give equal files; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = 64
FRAME_LINES = 4096
#: Hundredths of a second that a stored frame is shown.
DELAY = 10
#: Bits of a colour channel that the histogram tells apart.
HISTOGRAM_BITS = 2
#: Samples of a screen at most: 256 MB of colours. The format's own bound is 65535 x 65535.
MOST_PIXELS = 1 << 26
_MOST = 4096
_GREY = bytes(x for v in range(256) for x in (v, v, v))


def _widths(count: int, bits: int) -> np.ndarray:
    """Bits of the code at each place behind a clear code. The table gets an entry with every code but the first."""
    entries = (1 << bits) + 1 + np.arange(count)
    return np.minimum(np.maximum(np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1, bits + 1), 12)


@lru_cache(8)
def _room(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The widths of twice as many codes as a table has, and the bits before each."""
    room = _widths(_MOST * 2, bits)
    return room, np.concatenate([[0], np.cumsum(room)])


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of up to 12 bits, the first in the lowest bits. A code touches at most three bytes."""
    at = np.cumsum(widths) - widths
    size = int(at[-1] + widths[-1] + 7) // 8
    shifted = codes.astype(np.int64) << (at & 7)
    first = at >> 3
    out = np.bincount(first, shifted & 255, size + 2) + np.bincount(first + 1, shifted >> 8 & 255, size + 2) + np.bincount(first + 2, shifted >> 16, size + 2)
    return out[:size].astype(np.uint8).tobytes()


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of samples below ``1 << bits``."""
    clear = 1 << bits
    runs: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    add, emit = table.setdefault, codes.append
    now, free, full = data[0] << 8 if data else -1, (clear + 2) << 8, _MOST << 8  # codes, with room for a sample
    for sample in data[1:]:
        found = add(now | sample, free)
        if found != free:
            now = found
            continue
        emit(now)
        if free < full:
            free += 256
        else:
            runs.append(codes)
            codes = []
            emit = codes.append
            table.clear()
            free = (clear + 2) << 8
        now = sample << 8
    if now >= 0:
        codes.append(now)
    runs.append(codes)
    parts, widths = [], []
    last = bits + 1
    for run in runs:
        own = _room(bits)[0][: len(run) + 1]
        parts += [[clear], np.asarray(run, dtype=np.int64) >> 8]
        widths += [[last], own[:-1]]
        last = int(own[-1]) if len(run) else bits + 1
    parts.append([clear + 1])
    widths.append([last])
    return _pack(np.concatenate([np.asarray(p, dtype=np.int64) for p in parts]), np.concatenate([np.asarray(w, dtype=np.int64) for w in widths]))


def lzw_decode(stream: bytes, bits: int, expected: int) -> bytes:
    """Samples of a code stream: until its end code, its end or ``expected`` samples."""
    clear, stop = 1 << bits, (1 << bits) + 1
    data = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    total, bit = 8 * len(stream), 0
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    made = 0
    room, ahead = _room(bits)
    place, table, previous = 0, list(base), b""
    while made < expected:
        # all codes up to the table's end are cut at once: their widths depend on their places alone
        count = min(len(room) - place, _MOST) if place < len(room) else _MOST
        at = bit + (ahead[place : place + count] - ahead[place] if place < len(room) else 12 * np.arange(count))
        width = room[place : place + count] if place < len(room) else np.full(count, 12)
        fits = int(np.searchsorted(at + width, total, side="right"))
        if not fits:
            break
        at, width = at[:fits], width[:fits]
        byte = at >> 3
        codes = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (at & 7) & ((1 << width) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        n = int(marks[0]) if len(marks) else fits
        got: list[bytes] = []
        emit, add, rest = got.append, table.append, codes[:n].tolist()
        try:
            if rest and not previous:  # the first code adds no entry
                previous = table[rest[0]]
                emit(previous)
                rest = rest[1:]
            new = _MOST - len(table)
            for code in rest[:new]:
                if code < len(table):
                    entry = table[code]
                    add(previous + entry[:1])
                elif code == len(table):
                    entry = previous + previous[:1]
                    add(entry)
                else:
                    raise IndexError
                emit(entry)
                previous = entry
            got += [table[code] for code in rest[new:]]
        except IndexError:
            raise ValueError("a code beyond the table") from None
        out.append(b"".join(got))
        made += len(out[-1])
        if n < fits:
            bit = int(at[n] + width[n])
            if codes[n] == stop:
                break
            place, table, previous = 0, list(base), b""
        else:
            bit, place = int(at[-1] + width[-1]), place + fits
    return b"".join(out)[:expected]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(samples: bytes, width: int = LINE, lines: int = FRAME_LINES, delay: int = DELAY) -> bytes:
    """Grey samples, ``width`` to a line, as a GIF of frames of ``lines`` lines."""
    size = width * lines
    height = min(len(samples) // width, lines)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), _GREY]
    for at in range(0, len(samples), size):
        part = samples[at : at + size]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08" + _blocks(lzw_encode(part)))
    return b"".join(out) + b"\x3b"


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def decode_gif(data: bytes):
    """For each frame: number, delay in hundredths, disposal, left, top, width, height, canvas (height x width x 4, RGBA)."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    wide, high, flags = struct.unpack_from("<HHB", data, 6)
    if wide * high > MOST_PIXELS:
        raise ValueError(f"a screen of {wide} x {high}")
    at = 13
    common = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((high, wide, 4), dtype=np.uint8)
    delay, disposal, transparent, number = 0, 0, -1, 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", data, at + 3)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else -1
            _, at = _read_blocks(data, at + 2)
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        bits = data[at]
        stream, at = _read_blocks(data, at + 1)
        if top + h > high or left + w > wide:
            raise ValueError("a frame beyond the screen")
        if not 0 < bits < 9:
            raise ValueError("a code size beyond 8 bits")
        pixels = np.frombuffer(lzw_decode(stream, bits, w * h), np.uint8)
        if len(pixels) < w * h or palette is None:
            raise ValueError("a frame is incomplete")
        pixels = pixels.reshape(h, w)
        if flags & 0x40:
            rows = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
            pixels = pixels[np.argsort(rows)]
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        solid = np.full((256, 4), 255, dtype=np.uint8)  # indices beyond the palette take its last colour
        solid[:, :3] = palette[np.minimum(np.arange(256), len(palette) - 1)]
        if transparent < 0:
            area[:] = solid[pixels]
        else:
            seen = pixels != transparent
            area[seen] = solid[pixels[seen]]
        yield number, delay, disposal, left, top, w, h, canvas
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent, number = 0, 0, -1, number + 1


def histogram(canvas: np.ndarray, bits: int = HISTOGRAM_BITS) -> np.ndarray:
    """Visible samples by the leading bits of red, green and blue."""
    flat = np.ascontiguousarray(canvas).view("<u4").reshape(-1)
    flat = flat[flat >> 24 > 0]
    most = (1 << bits) - 1
    red, green, blue = (flat >> (8 * c + 8 - bits) & most for c in range(3))
    return np.bincount(red << (2 * bits) | green << bits | blue, minlength=1 << (3 * bits))


def decode_gifs(files: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row for each frame of each file: key, frame, delay_ms, disposal, width, height, pixels (RGBA), histogram, error."""

    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]
    names = ["id", "frame", "delay_ms", "disposal", "width", "height", "pixels", "histogram", "error"]

    def frame(where, *values):
        return pa.RecordBatch.from_arrays([where, *[pa.array([v], t) for v, t in zip(values, types, strict=True)]], names=names)

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                if data is None:
                    continue
                where, number = batch.column(0).slice(i, 1), 0
                try:
                    for number, delay, disposal, _, _, _, _, canvas in decode_gif(data):
                        yield frame(where, number, 10 * delay, disposal, canvas.shape[1], canvas.shape[0], canvas.tobytes(), histogram(canvas).tolist(), None)
                        number += 1
                except (ValueError, IndexError, struct.error) as e:
                    yield frame(where, number, None, None, None, None, None, None, str(e) or type(e).__name__)

    kind = files.schema[key].dataType.simpleString()
    schema = f"id {kind}, frame int, delay_ms int, disposal int, width int, height int, pixels binary, histogram array<bigint>, error string"
    return files.select(F.col(key).alias("id"), F.col(media)).mapInArrow(run, schema).withColumnRenamed("id", key)


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled up with zeros to lines, as a GIF."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a in range(0, len(ids), 64):
                raw = [(t or "").encode("utf-8", "replace") for t in batch.column(1).slice(a, 64).to_pylist()]
                files = [encode_gif(r + bytes(-len(r) % LINE if r else LINE)) for r in raw]
                yield pa.RecordBatch.from_arrays([ids.slice(a, 64), pa.array([len(r) for r in raw], pa.int64()), pa.array(files, pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", doc_id)


def read_texts(stored: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The payloads as read from the stored files: sizes, checksums and features, frames in order."""
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ms", "histogram"]

    def run(batches):
        for batch in batches:
            rows = []
            for n, media in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                payload, frames, shown, counts = [], 0, 0, 0
                for _, delay, _, left, top, w, h, canvas in decode_gif(media):
                    area = canvas[top : top + h, left : left + w]
                    payload.append(area[:, :, 0].tobytes())
                    counts, frames, shown = counts + histogram(area), frames + 1, shown + 10 * delay
                data = b"".join(payload)
                grey = counts[[0, 21, 42, 63]].tolist()
                feature = f"frames={frames};grey={'/'.join(map(str, grey))}"
                rows.append((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-LINE:]), len(media), hashlib.sha256(media).hexdigest(), feature, frames, shown, counts.tolist()))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_ms long, histogram array<bigint>"
    return stored.select(F.col(doc_id).alias("id"), "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("id", doc_id)
