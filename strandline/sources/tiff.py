"""TIFF rasters as a Spark source that reads only the strips or tiles of the asked bands and window.

``spark.read.format("tiff").load(folder)`` has a row for each file and band: path, band (from 1), the
window's place and size, its pixels in row order (null for no data) and how many strips or tiles were
read. Options: ``bands`` (``2,4``), ``window`` (``x,y,width,height``, cut to the image), ``files``
(files of a partition). Conditions on ``band`` and ``path`` are pushed into the source.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "path string, band int, x int, y int, width int, height int, pixels array<double>, blocks int"
#: Fixed values of the format: field types' sizes and codes, and the tags that are read.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, NODATA = 317, 322, 323, 324, 325, 339, 42113
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
_CLEAR, _END = 256, 257


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, that grow one code early."""
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    out, last, width, held, bits = [], None, 9, 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == _END:
            break
        if code == _CLEAR:
            del table[258:]
            last, width = None, 9
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    codes, table, width, run = [(_CLEAR, 9)], {bytes([i]): i for i in range(256)}, 9, b""
    following = 258
    for i in range(len(data)):
        more = run + data[i : i + 1]
        if more in table:
            run = more
            continue
        codes.append((table[run], width))
        table[more] = following
        following += 1
        run = data[i : i + 1]
        if following == 4094:
            codes.append((_CLEAR, width))
            table, width, following = {bytes([k]): k for k in range(256)}, 9, 258
        elif following >= (1 << width):
            width += 1
    codes += [(table[run], width)] if run else []
    codes.append((_END, width + (following + 1 >= (1 << width) and width < 12) if run else width))
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


class Tiff:
    """The first image of a file of which ``read(offset, size)`` gives bytes; ``blocks`` counts the strips and tiles read."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read, self.blocks = read, 0
        head = read(0, 8)
        if head[:4] not in (b"II*\0", b"MM\0*"):
            raise ValueError("not a TIFF file")
        self.order = "<" if head[:1] == b"I" else ">"
        at = self._of("I", head[4:])[0]
        count = self._of("H", read(at, 2))[0]
        self.tags = dict(self._field(read(at + 2, 12 * count)[12 * i : 12 * i + 12]) for i in range(count))
        self.width, self.height, self.samples = self.tags[WIDTH][0], self.tags[HEIGHT][0], self.tags.get(SAMPLES, (1,))[0]
        self.apart = self.tags.get(PLANAR, (1,))[0] == 2 and self.samples > 1
        kind = {1: "u", 2: "i", 3: "f"}[self.tags.get(FORMAT, (1,))[0]]
        self.dtype = np.dtype(f"{self.order}{kind}{self.tags.get(BITS, (8,))[0] // 8}")
        tiled = TILES in self.tags
        self.block = (self.tags[TILE_WIDTH][0], self.tags[TILE_HEIGHT][0]) if tiled else (self.width, min(self.height, self.tags.get(ROWS, (self.height,))[0]))
        self.tiled, self.offsets, self.sizes = tiled, self.tags[TILES if tiled else STRIPS], self.tags[TILE_BYTES if tiled else STRIP_BYTES]
        raw = self.tags.get(NODATA)
        self.nodata = float(raw[0].rstrip(b"\0 ")) if raw else None

    def _of(self, kind: str, data: bytes) -> tuple:
        return struct.unpack(self.order + kind, data[: struct.calcsize(self.order + kind)])

    def _field(self, entry: bytes) -> tuple[int, tuple]:
        tag, code, n = self._of("HHI", entry)
        if code not in _TYPES:
            return tag, ()
        kind = f"{n}s" if code == 2 else _TYPES[code] * n
        size = struct.calcsize(self.order + kind)
        return tag, self._of(kind, entry[8:] if size <= 4 else self.read(self._of("I", entry[8:])[0], size))

    def _block(self, index: int, band_index: int, rows: int) -> np.ndarray:
        """Rows x columns x samples of one strip or tile."""
        self.blocks += 1
        data = self.read(self.offsets[index], self.sizes[index])
        how = self.tags.get(COMPRESSION, (PLAIN,))[0]
        data = {PLAIN: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}[how](data)
        samples = 1 if self.apart else self.samples
        out = np.frombuffer(data, self.dtype, rows * self.block[0] * samples).reshape(rows, self.block[0], samples)
        if self.tags.get(PREDICTOR, (1,))[0] == 2:
            out = np.cumsum(out, 1, dtype=self.dtype.newbyteorder("="))
        return out if self.apart else out[:, :, band_index : band_index + 1]

    def window(self, band: int, x: int, y: int, width: int, height: int) -> np.ndarray:
        """Pixels of a band (from 1) inside the window, which must be inside the image."""
        bw, bh = self.block
        across, down = -(-self.width // bw), -(-self.height // bh)
        out = np.empty((height, width), self.dtype.newbyteorder("="))
        for j in range(y // bh, -(-(y + height) // bh)):
            for i in range(x // bw, -(-(x + width) // bw)):
                rows = bh if self.tiled else min(bh, self.height - j * bh)
                part = self._block(((band - 1) * across * down if self.apart else 0) + j * across + i, band - 1, rows)[:, :, 0]
                top, left = max(y, j * bh), max(x, i * bw)
                low, right = min(y + height, j * bh + rows), min(x + width, (i + 1) * bw)
                out[top - y : low - y, left - x : right - x] = part[top - j * bh : low - j * bh, left - i * bw : right - i * bw]
        return out


def encode(bands: np.ndarray, nodata: float | None = None, block: tuple[int, int] | None = None, rows: int | None = None, apart: bool = True, compression: int = PLAIN, predictor: bool = False, order: str = "<") -> bytes:
    """A TIFF file of bands x height x width, in tiles of ``block`` (width, height) or strips of ``rows``."""
    n, height, width = bands.shape
    bw, bh = block or (width, rows or height)
    image = bands.astype(bands.dtype.newbyteorder(order))
    planes = [image[k : k + 1] for k in range(n)] if apart else [image]
    blocks = []
    for plane in planes:
        for y in range(0, height, bh):
            for x in range(0, width, bw):
                part = plane[:, y : y + bh, x : x + bw]
                if block:
                    part = np.pad(part, ((0, 0), (0, bh - part.shape[1]), (0, bw - part.shape[2])))
                part = part.transpose(1, 2, 0)
                if predictor:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], 1)
                data = part.astype(image.dtype).tobytes()
                blocks.append({PLAIN: bytes, LZW: pack_lzw, DEFLATE: zlib.compress}[compression](data))
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    fields = {WIDTH: ("I", [width]), HEIGHT: ("I", [height]), BITS: ("H", [8 * image.itemsize] * n), COMPRESSION: ("H", [compression]), 262: ("H", [1]), SAMPLES: ("H", [n]), PLANAR: ("H", [2 if apart else 1]), PREDICTOR: ("H", [2 if predictor else 1]), FORMAT: ("H", [kind] * n)}
    sizes, places = [len(b) for b in blocks], [8 + sum(map(len, blocks[:i])) for i in range(len(blocks))]
    fields |= {TILE_WIDTH: ("I", [bw]), TILE_HEIGHT: ("I", [bh]), TILES: ("I", places), TILE_BYTES: ("I", sizes)} if block else {ROWS: ("I", [bh]), STRIPS: ("I", places), STRIP_BYTES: ("I", sizes)}
    if nodata is not None:
        fields[NODATA] = ("s", [f"{nodata:g}".encode() + b"\0"])
    body = b"".join(blocks)
    body += b"\0" * (len(body) % 2)
    at = 8 + len(body)
    more, entries = b"", b""
    for tag in sorted(fields):
        code, values = fields[tag]
        data = values[0] if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
        count = len(data) if code == "s" else len(values)
        place = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", at + 2 + 12 * len(fields) + 4 + len(more))
        more += data if len(data) > 4 else b""
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "s": 2}[code], count) + place
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at)
    return head + body + struct.pack(order + "H", len(fields)) + entries + struct.pack(order + "I", 0) + more


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class _Files(InputPartition):
    def __init__(self, paths: Sequence[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        listed = options.get("bands")
        self.bands = {int(b) for b in listed.split(",")} if listed else None
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("band",):
                self.bands = set(values) if self.bands is None else self.bands & set(values)
            elif values is not None and f.attribute == ("path",):
                self.paths = set(values) if self.paths is None else self.paths & set(values)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        root, at = _open(self.options["path"])
        info = root.get_file_info(at)
        found = root.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
        scheme = self.options["path"].split(at)[0] if ":/" in self.options["path"] else ""
        names = sorted(scheme + f.path for f in found if f.is_file and f.path.lower().endswith((".tif", ".tiff")))
        names = [n for n in names if self.paths is None or n in self.paths]
        size = int(self.options.get("files", 64))
        return [_Files(names[i : i + size]) for i in range(0, len(names), size)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        asked = [int(v) for v in self.options["window"].split(",")] if "window" in self.options else None
        for path in partition.paths:
            root, at = _open(path)
            with root.open_input_file(at) as f:
                image = Tiff(lambda offset, size, f=f: f.read_at(size, offset))
                x, y, w, h = asked or (0, 0, image.width, image.height)
                x, y, right, low = max(x, 0), max(y, 0), min(x + w, image.width), min(y + h, image.height)
                for band in range(1, image.samples + 1):
                    if self.bands is None or band in self.bands:
                        before, w, h = image.blocks, max(right - x, 0), max(low - y, 0)
                        pixels = image.window(band, x, y, w, h).astype(float).ravel() if w and h else np.empty(0)
                        gone = np.isnan(pixels) if image.nodata is None else np.isnan(pixels) | (pixels == image.nodata)
                        yield path, band, x, y, w, h, [None if g else p for p, g in zip(pixels.tolist(), gone.tolist(), strict=True)], image.blocks - before


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``tiff`` known to the session, with pushed conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)


def write_tiffs(df: DataFrame, folder: str, name: str, bands: str, shape: tuple[int, int, int], nodata: float | None = None, **layout) -> DataFrame:
    """Writes a file ``<name>.tif`` for each row whose ``bands`` (array<float>) holds bands x rows x columns; nulls become ``nodata``.

    Gives (path, bytes) of the files. A file is put in place whole, so a repeated attempt leaves one copy.
    """

    def put(batches):
        root, at = _open(folder)
        for pdf in batches:
            out = []
            for key, values in zip(pdf[name], pdf[bands], strict=True):
                image = np.array([np.nan if v is None else v for v in values], np.float32).reshape(shape)
                if nodata is not None:
                    image = np.where(np.isnan(image), np.float32(nodata), image)
                data, to = encode(image, nodata, **layout), f"{at}/{key}.tif"
                with root.open_output_stream(f"{to}.{id(out)}.part") as f:
                    f.write(data)
                root.move(f"{to}.{id(out)}.part", to)
                out.append((to, len(data)))
            yield type(pdf)(out, columns=["path", "bytes"])

    root, at = _open(folder)
    root.create_dir(at)
    return df.select(name, bands).mapInPandas(put, "path string, bytes long")
