"""Operator 6: media columns from GIF files.

decode() reads any GIF87a/89a stream: LZW code streams (with clear codes anywhere, and full tables), global and local palettes,
interlacing, transparency and the disposal rules, as frames with their start, delay, palette samples, picture and colour
histogram. encode() writes samples losslessly as frames of SIDE x SIDE, one palette colour per byte value.

Defined results: a null or empty text is one frame of bytes 255; equal texts give equal values; repeated rows each give a row;
a damaged stream raises ValueError; an empty table gives no rows; extra columns are not read. A task holds one slice of texts,
their samples and one picture at a time, so a very long text takes a few times its own size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, row_op, text_or_empty

SIDE, DELAY_CS = 24, 4
UNIT = SIDE * SIDE
#: Levels of each of red, green and blue in a colour histogram.
LEVELS = 4


@lru_cache(16)
def _widths(depth: int) -> np.ndarray:
    """Bits of the k-th code after a clear code, as many codes as the table lets a segment have and two more."""
    first = (1 << depth) + 2
    k = np.arange(4096 - first + 3)
    return np.clip(np.frexp(np.maximum(first + k - 1, 1).astype(np.float64))[1], depth + 1, 12).astype(np.int64)


def lzw_encode(samples: bytes, depth: int = 8) -> bytes:
    """Samples of so many bits as a GIF code stream: a clear code, the codes, an end code; low bits first."""
    clear = 1 << depth
    codes: list[int] = [clear]
    starts = [1]  # where segments start in codes, each after its clear code
    free, prefix = clear + 2, -1
    table: dict[int, int] = {}
    get, emit = table.get, codes.append
    for b in samples:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        code = get(key)
        if code is not None:
            prefix = code
            continue
        emit(prefix)
        if free < 4096:
            table[key] = free
            free += 1
        else:
            emit(clear)
            starts.append(len(codes))
            table.clear()
            free = clear + 2
        prefix = b
    if prefix >= 0:
        emit(prefix)
    emit(clear + 1)
    widths, of = np.full(len(codes), depth + 1, np.int64), _widths(depth)
    for a, z in zip(starts, [*starts[1:], len(codes)], strict=True):
        widths[a:z] = of[: z - a]
    bits = np.unpackbits(np.array(codes, "<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(data: bytes, depth: int, n: int) -> bytes:
    """n samples from a code stream. An entry of the table is a stretch of the output, so the table holds places, not strings."""
    clear, end = 1 << depth, (1 << depth) + 1
    first = end + 1
    width, limit, mask = depth + 1, 1 << (depth + 1), (1 << (depth + 1)) - 1
    acc = bits = at = 0
    out = bytearray()
    literal = [bytes([i]) for i in range(clear)]
    places: list[int] = []  # of entry first + k: where it starts in out; it is one longer than the code that made it
    sizes: list[int] = []
    previous = 0  # length of the last code's string, 0 after a clear
    total = len(data)
    while len(out) < n:
        while bits < width:
            if at >= total:
                raise ValueError("the code stream ends early")
            chunk = data[at : at + 48]
            acc |= int.from_bytes(chunk, "little") << bits
            bits += 8 * len(chunk)
            at += len(chunk)
        code = acc & mask
        acc >>= width
        bits -= width
        if code == clear:
            width, limit, mask, previous = depth + 1, 1 << (depth + 1), (1 << (depth + 1)) - 1, 0
            places.clear()
            sizes.clear()
            continue
        if code == end:
            break
        here = len(out)
        if previous and len(places) + first < 4096:
            places.append(here - previous)
            sizes.append(previous + 1)
        if code < clear:
            out += literal[code]
            previous = 1
        else:
            k = code - first
            if k >= len(places):
                raise ValueError("a code without an entry")
            start, previous = places[k], sizes[k]
            if start + previous > here:  # the entry being made: it ends with its own first sample
                out += out[start:here]
                out.append(out[start])
            else:
                out += out[start : start + previous]
        if len(places) + first + 1 > limit and width < 12 and previous:
            width += 1
            limit <<= 1
            mask = limit - 1
    if len(out) < n:
        raise ValueError("too few samples")
    return bytes(out[:n])


def lzw_decode_many(streams: list[bytes], depth: int, n: int) -> list[bytes]:
    """n samples from each stream. Streams of one segment are decoded together, column by column; others one by one.

    With no clear code after the first, the k-th code's place is known beforehand. The string of an entry lies in the output,
    so every sample points to an earlier one or is a literal, and doubling the pointers resolves them all.
    """
    clear, end, first = 1 << depth, (1 << depth) + 1, (1 << depth) + 2
    most = min(n + 1, 4096 - first + 1)  # data codes and the end code
    out: list[bytes | None] = [None] * len(streams)
    widths = _widths(depth)[:most]
    places = depth + 1 + np.concatenate([[0], np.cumsum(widths)[:-1]])
    for lo in range(0, len(streams), max(1, (1 << 20) // max(n, 1))):
        part = streams[lo : lo + max(1, (1 << 20) // max(n, 1))]
        size = max(int(places[-1]) // 8 + 4, max(map(len, part)))
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in part), np.uint8).reshape(len(part), size)
        head = (raw[:, 0].astype(np.int32) | raw[:, 1].astype(np.int32) << 8) & ((1 << (depth + 1)) - 1)
        byte = places >> 3
        codes = (raw[:, byte].astype(np.int32) | raw[:, byte + 1].astype(np.int32) << 8 | raw[:, byte + 2].astype(np.int32) << 16) >> (places & 7).astype(np.int32) & ((1 << widths) - 1).astype(np.int32)
        ended = codes == end
        count = np.where(ended.any(axis=1), ended.argmax(axis=1), -1)  # data codes
        entry = codes - first
        within = np.arange(most)[None, :] < count[:, None]
        sound = (head == clear) & (count > 0) & ~((codes == clear) & within).any(axis=1) & ~((entry >= np.arange(most)[None, :]) & within).any(axis=1)
        rows = np.flatnonzero(sound)
        if len(rows):
            codes, entry, count, within = codes[rows], entry[rows], count[rows], within[rows]
            lengths = np.ones((most, len(rows)), np.int64)
            across = np.arange(len(rows))
            for k in range(1, int(count.max())):
                e = entry[:, k]
                lengths[k] = np.where(e >= 0, lengths[np.maximum(e, 0), across] + 1, 1)
            lengths = np.where(within, lengths.T, 0)
            starts = np.cumsum(lengths, axis=1) - lengths
            whole = lengths.sum(axis=1)
            base = np.cumsum(whole) - whole
            flat = lengths.ravel()
            literal = (entry < 0).ravel()
            own = (starts + base[:, None]).ravel()
            source = (np.take_along_axis(starts, np.maximum(entry, 0), axis=1) + base[:, None]).ravel()
            shift = np.where(literal, 0, source - own)
            total = int(whole.sum())
            point = np.arange(total) + np.repeat(shift, flat)
            values = np.repeat(codes.ravel().astype(np.uint16), flat)
            while True:
                further = point[point]
                if np.array_equal(further, point):
                    break
                point = further
            samples = values[point].astype(np.uint8)
            for i, r in enumerate(rows.tolist()):
                if whole[i] >= n:
                    out[lo + r] = samples[base[i] : base[i] + n].tobytes()
    return [x if x is not None else lzw_decode(streams[i], depth, n) for i, x in enumerate(out)]


#: Byte values as colours: three bits of red, three of green, two of blue, each spread over 0 to 255.
_COLOURS = bytes(v for i in range(256) for v in ((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85))


def encode(samples: bytes, side: int = SIDE, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF of frames that hold the samples, a positive multiple of side * side, row by row."""
    unit = side * side
    if not samples or len(samples) % unit:
        raise ValueError("samples fill whole frames")
    size = side.to_bytes(2, "little")
    out = [b"GIF89a", size, size, b"\xf7\x00\x00", _COLOURS]
    control = b"\x21\xf9\x04\x04" + delay_cs.to_bytes(2, "little") + b"\x00\x00"
    head = control + b"\x2c\x00\x00\x00\x00" + size + size + b"\x00\x08"
    for i in range(0, len(samples), unit):
        codes = lzw_encode(samples[i : i + unit])
        out.append(head)
        for k in range(0, len(codes), 255):
            part = codes[k : k + 255]
            out.append(bytes([len(part)]) + part)
        out.append(b"\x00")
    out.append(b"\x3b")
    return b"".join(out)


@dataclass
class Frame:
    at_ms: int
    delay_ms: int
    left: int
    top: int
    samples: np.ndarray  # palette numbers, height x width, as stored (interlacing undone)
    picture: np.ndarray  # the canvas once this frame is drawn: height x width x (red, green, blue, opaque); copied if kept
    histogram: np.ndarray | None = None


def _blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(raw):
            raise ValueError("the file ends early")
        n = raw[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(raw[at + 1 : at + 1 + n])
        at += n + 1


@dataclass
class _Image:
    """An image block as it lies in the file."""

    left: int
    top: int
    width: int
    height: int
    interlaced: bool
    palette: np.ndarray | None
    depth: int
    codes: bytes
    delay_ms: int
    disposal: int
    clear: int | None  # the transparent palette number


def _parse(raw: bytes) -> tuple[int, int, list[_Image]]:
    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        raise ValueError("not a GIF")
    width, height = int.from_bytes(raw[6:8], "little"), int.from_bytes(raw[8:10], "little")
    at, shared = 13, None
    if raw[10] & 0x80:
        n = 3 << ((raw[10] & 7) + 1)
        shared, at = np.frombuffer(raw, np.uint8, n, at).reshape(-1, 3), at + n
    images: list[_Image] = []
    delay, disposal, clear = 0, 0, None
    while at < len(raw) and raw[at] != 0x3B:
        kind, at = raw[at], at + 1
        if kind == 0x21:
            label = raw[at]
            data, at = _blocks(raw, at + 1)
            if label == 0xF9 and len(data) >= 4:
                disposal, delay = data[0] >> 2 & 7, int.from_bytes(data[1:3], "little") * 10
                clear = data[3] if data[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h = (int.from_bytes(raw[at + k : at + k + 2], "little") for k in (0, 2, 4, 6))
        flags, at = raw[at + 8], at + 9
        palette = shared
        if flags & 0x80:
            n = 3 << ((flags & 7) + 1)
            palette, at = np.frombuffer(raw, np.uint8, n, at).reshape(-1, 3), at + n
        depth = raw[at]
        if not 2 <= depth <= 8:
            raise ValueError("a code size out of range")
        codes, at = _blocks(raw, at + 1)
        images.append(_Image(left, top, w, h, bool(flags & 0x40), palette, depth, codes, delay, disposal, clear))
        delay, disposal, clear = 0, 0, None
    return width, height, images


def decode(raw: bytes) -> list[Frame]:
    return [replace(f, picture=f.picture.copy()) for f in decode_many([raw])[0]]


def decode_many(files: list[bytes]) -> list[Iterator[Frame]]:
    """The frames of each file, drawn as they are asked for; code streams of the same size are decoded together."""
    parsed = [_parse(raw) for raw in files]
    by_size: dict[tuple[int, int], list[_Image]] = {}
    for _, _, images in parsed:
        for x in images:
            by_size.setdefault((x.depth, x.width * x.height), []).append(x)
    samples: dict[int, bytes] = {}
    for (depth, n), own in by_size.items():
        samples.update(zip(map(id, own), lzw_decode_many([x.codes for x in own], depth, n), strict=True))
    return [_draw(width, height, images, samples) for width, height, images in parsed]


def _draw(width: int, height: int, images: list[_Image], decoded: dict[int, bytes]) -> Iterator[Frame]:
    canvas = np.zeros((height, width, 4), np.uint8)
    clock = 0
    for x in images:
        w, h, left, top = x.width, x.height, x.left, x.top
        samples = np.frombuffer(decoded[id(x)], np.uint8).reshape(h, w)
        if x.interlaced:
            order = [y for start, by in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, h, by)]
            plain = np.empty_like(samples)
            plain[order] = samples
            samples = plain
        if x.palette is None:
            raise ValueError("no palette")
        kept = canvas.copy() if x.disposal == 3 else None
        y2, x2 = min(height, top + h), min(width, left + w)
        part = samples[: max(0, y2 - top), : max(0, x2 - left)]
        area = canvas[top:y2, left:x2]
        drawn = slice(None) if x.clear is None else part != x.clear
        if len(x.palette) < 256 and part.size and int(part[drawn].max(initial=0)) >= len(x.palette):
            raise ValueError("a sample beyond the palette")
        if part.size:
            area[drawn, ..., :3] = x.palette[part[drawn]]
            area[drawn, ..., 3] = 255
        yield Frame(clock, x.delay_ms, left, top, samples, canvas)
        if x.disposal == 2:
            canvas[top:y2, left:x2] = 0
        elif kept is not None:
            canvas = kept
        clock += x.delay_ms


def histogram(p: np.ndarray) -> np.ndarray:
    """Counts of a picture's opaque pixels by LEVELS steps of red, green and blue each, red first."""
    step = p[..., :3].astype(np.int64) * LEVELS // 256
    colour = (step[..., 0] * LEVELS + step[..., 1]) * LEVELS + step[..., 2]
    return np.bincount(colour[p[..., 3] > 0], minlength=LEVELS**3)


def timed_frames(files: list[bytes]) -> Iterator[tuple[int, Frame]]:
    """(file number, frame with its histogram) of all files, in order."""
    for i, frames in enumerate(decode_many(files)):
        for f in frames:
            f.histogram = histogram(f.picture)
            yield i, f


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


MEDIA = "doc_id long, n_bytes long, media binary"


def store(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_bytes, media (a GIF file): no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def rows(cols: dict) -> dict:
        return {"doc_id": cols["doc_id"], "n_bytes": [len((t or "").encode()) for t in cols["text"]], "media": [encode(payload(t)) for t in cols["text"]]}

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), row_op(rows, schema), MEDIA)


FRAMES = "doc_id long, frame int, at_ms long, delay_ms long, width int, height int, samples binary, histogram array<long>"


def frames_of(media: DataFrame) -> DataFrame:
    """doc_id, media to a row per frame: timed, with its samples and colour histogram. A row without media gives none."""
    names = [("doc_id", pa.int64()), ("frame", pa.int32()), ("at_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.binary()), ("histogram", pa.list_(pa.int64()))]

    def rows(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k, _ in names}
        some = [(key, raw) for key, raw in zip(cols["doc_id"], cols["media"], strict=True) if raw]
        number = [0] * len(some)
        for i, f in timed_frames([raw for _, raw in some]):
            for k, v in zip(out, (some[i][0], number[i], f.at_ms, f.delay_ms, f.samples.shape[1], f.samples.shape[0], f.samples.tobytes(), f.histogram.tolist()), strict=True):
                out[k].append(v)
            number[i] += 1
        return out

    return in_arrow(media.select("doc_id", "media"), row_op(rows, pa.schema(names), "media"), FRAMES)


def digest(media: DataFrame) -> DataFrame:
    """Stored files read back: the samples of all frames in order, and the colour histograms of the frames together as the feature."""
    names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def rows(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k, _ in names}
        found = groupby(timed_frames(cols["media"]), key=lambda x: x[0])
        for (_, own), key, n, raw in zip(found, cols["doc_id"], cols["n_bytes"], cols["media"], strict=True):
            data, hist, count, end = bytearray(), np.zeros(LEVELS**3, np.int64), 0, 0
            for _, f in own:
                data += f.samples.tobytes()
                hist += f.histogram
                count, end = count + 1, f.at_ms + f.delay_ms
            feature = f"{count}x{end}ms:" + ",".join(map(str, hist.tolist()))
            for k, v in zip(out, (key, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature), strict=True):
                out[k].append(v)
        return out

    return in_arrow(media, row_op(rows, pa.schema(names), "media"), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
