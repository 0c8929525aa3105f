"""GIF media columns: a decoder for LZW code streams, palettes, disposal and transparency, and a writer.

Frames are timed rows with colour-histogram columns. The writer stores bytes losslessly as 8-bit
palette indices, one frame for every ``ROWS`` rows of ``WIDTH`` samples.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.llm.common import slices

WIDTH, ROWS, DELAY_CS = 64, 1024, 10
_GREYS = bytes(v for i in range(256) for v in (i, i, i))
_MOST = 4096


def _code_widths(clear: int, first: int, n: int) -> np.ndarray:
    """Bits of the codes first, first+1, ... (from 1) after a clear code."""
    top = clear + np.arange(first, first + n)
    least = clear.bit_length()
    return np.minimum(12, np.maximum(least, np.floor(np.log2(top)).astype(np.int64) + 1))


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    clear, end = 1 << bits, (1 << bits) + 1
    codes, starts, table, free = [clear], [0], {}, end + 1
    put, get = codes.append, table.get
    it = iter(samples)
    at = next(it, None)
    if at is not None:
        for b in it:
            key = at << 8 | b
            longer = get(key)
            if longer is not None:
                at = longer
                continue
            put(at)
            at = b
            table[key] = free
            free += 1
            if free == _MOST:
                starts.append(len(codes))
                put(clear)
                table.clear()
                free = end + 1
        put(at)
    put(end)
    c = np.array(codes, np.uint32)
    widths = np.empty(len(c), np.int64)
    widths[0] = bits + 1
    for a, b in zip(starts, [*starts[1:], len(c) - 1], strict=True):
        widths[a + 1 : b + 1] = _code_widths(clear, 1, b - a)
    on = np.arange(12) < widths[:, None]
    return np.packbits((c[:, None] >> np.arange(12, dtype=np.uint32) & 1).astype(np.uint8)[on], bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int, size: int) -> bytes:
    """At most ``size`` samples of a code stream; what is missing or broken is left out."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    limit, at, out, got = 8 * len(stream), 0, [], 0
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, before, seen = list(base), b"", 1
    while at < limit and got < size:
        widths = _code_widths(clear, seen, 4000)
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, limit, side="right"))
        if not n:
            break
        where = ends[:n] - widths[:n]
        k = where >> 3
        codes = (raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) >> (where & 7).astype(np.uint32) & ((1 << widths[:n]) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        m = int(stop[0]) if len(stop) else n
        for c in codes[:m].tolist():
            if c < len(table):
                e = table[c]
            elif c == len(table) and before:
                e = before + before[:1]
            else:
                return b"".join(out)[:size]
            out.append(e)
            got += len(e)
            if before and len(table) < _MOST:
                table.append(before + e[:1])
            before = e
        seen += m
        if m < n:
            if codes[m] == end:
                break
            at = int(ends[m])
            table, before, seen = list(base), b"", 1
        else:
            at = int(ends[n - 1])
    return b"".join(out)[:size]


def encode_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF of ``payload`` (a whole number of lines) as grey palette indices."""
    height = min(rows, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), _GREYS]
    for a in range(0, len(payload), width * rows):
        part = payload[a : a + width * rows]
        out += [b"\x21\xf9\x04\x04", struct.pack("<H", delay_cs), b"\0\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08"]
        data = lzw_encode(part)
        out += [b"".join(bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))), b"\0"]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    box: tuple[int, int, int, int]  # left, top, width, height
    disposal: int
    samples: np.ndarray  # palette indices, height x width
    canvas: np.ndarray  # colours after this frame, height x width x 3


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(data) and data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out), at + 1


def decode_gif(data: bytes) -> Iterator[Frame]:
    """Frames in order, each with the canvas it shows; nothing for bytes that are no GIF.

    A truncated stream gives the frames that are whole and the samples that are there.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return
    width, height, flags, back = struct.unpack("<HHBB", data[6:12])
    at = 13
    common = None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        common = np.frombuffer(data[at : at + n].ljust(n, b"\0"), np.uint8).reshape(-1, 3)
        at += n
    empty = common[back] if common is not None and back < len(common) else np.zeros(3, np.uint8)
    canvas = np.empty((height, width, 3), np.uint8)
    canvas[:] = empty
    start, delay, disposal, clear = 0, 0, 0, None
    while at < len(data):
        kind = data[at]
        if kind == 0x21:
            if data[at + 1 : at + 2] == b"\xf9" and len(data) >= at + 8:
                packed, delay, index = struct.unpack("<BHB", data[at + 3 : at + 7])
                disposal, clear = packed >> 2 & 7, index if packed & 1 else None
            _, at = _blocks(data, at + 2)
        elif kind == 0x2C and len(data) >= at + 11:
            left, top, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            colours = common
            if packed & 0x80:
                n = 3 << (packed & 7) + 1
                colours = np.frombuffer(data[at : at + n].ljust(n, b"\0"), np.uint8).reshape(-1, 3)
                at += n
            if colours is None:
                colours = np.zeros((256, 3), np.uint8)
            bits = data[at] if at < len(data) else 8
            stream, at = _blocks(data, at + 1)
            flat = lzw_decode(stream, min(max(bits, 2), 8), w * h)
            samples = np.frombuffer(flat.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if packed & 0x40:
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                straight = np.empty_like(samples)
                straight[order] = samples
                samples = straight
            before = canvas.copy() if disposal == 3 else None
            hh, ww = max(0, min(h, height - top)), max(0, min(w, width - left))
            part = samples[:hh, :ww]
            shown = np.take(colours, part, axis=0, mode="clip")
            area = canvas[top : top + hh, left : left + ww]
            np.copyto(area, shown, where=np.True_ if clear is None else (part != clear)[..., None])
            yield Frame(start, 10 * delay, (left, top, w, h), disposal, samples, canvas)
            if disposal == 2:
                area[:] = empty
            elif before is not None:
                canvas = before
            start += 10 * delay
            delay, disposal, clear = 0, 0, None
        else:
            return


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels in each of 64 colour boxes, four levels for red, green and blue."""
    q = canvas.reshape(-1, 3) >> 6
    return np.bincount(q[:, 0] << 4 | q[:, 1] << 2 | q[:, 2], minlength=64)


def payload(text: Column, multiple: int = WIDTH) -> Column:
    """The text's UTF-8 bytes with zero bytes up to a positive multiple; null counts as empty."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    full = F.greatest(F.lit(multiple), (n + multiple - 1).cast("long") - (n + multiple - 1).cast("long") % multiple).cast("int")
    return F.concat(raw, F.repeat(F.lit("\0"), full - n).cast("binary"))


def to_gif(samples: Column) -> Column:
    """Bytes (a multiple of ``WIDTH``) stored as a GIF with frames of at most ``ROWS`` rows; equal bytes, equal files."""

    @F.arrow_udf("binary")
    def stored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            yield pa.array([encode_gif(x.as_py()) if x.is_valid else None for x in batch], pa.binary())

    return stored(samples)


def summary(media: Column) -> Column:
    """struct<samples: binary, n_frames, duration_ms, histogram: array<bigint>> of a decoded GIF column.

    ``samples`` are the palette indices of all frames in order; the histogram adds up the canvases
    shown. Null, empty or foreign bytes give no frames.
    """

    @F.arrow_udf("struct<samples:binary,n_frames:int,duration_ms:bigint,histogram:array<bigint>>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            rows = []
            for x in batch:
                parts, total, ms = [], np.zeros(64, np.int64), 0
                for f in decode_gif(x.as_py() or b""):
                    parts.append(f.samples.tobytes())
                    total += histogram(f.canvas)
                    ms += f.delay_ms
                rows.append((b"".join(parts), len(parts), ms, total.tolist()))
            a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.StructArray.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.list_(pa.int64()))], ["samples", "n_frames", "duration_ms", "histogram"])

    return read(media)


_FRAME = "array<struct<frame:int,start_ms:bigint,delay_ms:int,x:int,y:int,width:int,height:int,disposal:int,rgb:binary,histogram:array<bigint>>>"


def frames(media: Column) -> Column:
    """Timed frames: position, delay, disposal, the canvas shown as RGB bytes and its colour histogram."""

    @F.arrow_udf(_FRAME)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("disposal", pa.int32()), ("rgb", pa.binary()), ("histogram", pa.list_(pa.int64()))]))
        for batch in slices(batches):
            out = []
            for x in batch:
                got = []
                for k, f in enumerate(decode_gif(x.as_py() or b"")):
                    got.append({"frame": k, "start_ms": f.start_ms, "delay_ms": f.delay_ms, "x": f.box[0], "y": f.box[1], "width": f.box[2], "height": f.box[3], "disposal": f.disposal, "rgb": f.canvas.tobytes(), "histogram": histogram(f.canvas).tolist()})
                out.append(got)
            yield pa.array(out, kind)

    return read(media)
