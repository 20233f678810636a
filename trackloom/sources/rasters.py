"""Rasters from files as pixel tables: TIFF by its strips or tiles, PNG by its rows.

The public layouts are read directly: TIFF and BigTIFF in either byte order, strips or tiles, interleaved or planar, uncompressed or deflate,
with or without the horizontal predictor, integers of 8 to 32 bits and floats of 32 and 64; PNG of 1 to 16 bits, not interlaced.
A query's window (options, or filters on row and col, which are pushed down) decides which blocks are read at all; each task
reads some blocks of one file, so a raster of any size spreads over many. A PNG is one compressed stream and so one task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .files import listed, opened

#: Decoded bytes of a task's blocks, and pixels of a batch.
PART_BYTES, BATCH = 64 << 20, 1 << 18
PIXELS = "source_path string, row int, col int, bands array<double>, valid boolean"
HEADERS = "path string, width int, height int, bands int, dtype string, nodata double, epsg int, transform array<double>, x_min double, y_min double, x_max double, y_max double"
#: Bytes and codes of TIFF's field types, and the numbers of its tags and GeoTIFF's.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "s", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _STRIPS, _SAMPLES, _ROWS, _STRIP_SIZES, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
_TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_SIZES, _EXTRA, _FORMAT = 322, 323, 324, 325, 338, 339
_SCALE, _TIEPOINT, _TRANSFORM, _GEOKEYS, _NODATA = 33550, 33922, 34264, 34735, 42113


@dataclass(frozen=True)
class Raster:
    """What a file says of itself; `blocks` are (row, col, height, width, offset, bytes, plane)."""

    path: str
    width: int
    height: int
    bands: int
    dtype: str
    kind: str
    compression: int = 1
    predictor: int = 1
    planar: bool = False
    alpha: bool = False
    nodata: float | None = None
    epsg: int | None = None
    transform: tuple[float, ...] | None = None
    blocks: tuple = field(default=(), repr=False)


def _tags(f) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first directory."""
    head = f.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    big = struct.unpack_from(order + "H", head, 2)[0] == 43
    start = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
    many = struct.unpack(order + ("Q" if big else "H"), f.read_at(8 if big else 2, start))[0]
    entry, room = (20, 8) if big else (12, 4)
    raw = f.read_at(many * entry, start + (8 if big else 2))
    out = {}
    for k in range(many):
        tag, kind, n = struct.unpack_from(order + ("HHQ" if big else "HHI"), raw, k * entry)
        if kind not in _TYPES:
            continue
        code = _TYPES[kind]
        form = f"{order}{n}{code}"
        size, at = struct.calcsize(form), k * entry + entry - room
        data = raw[at : at + size] if size <= room else f.read_at(size, struct.unpack_from(order + ("Q" if big else "I"), raw, at)[0])
        out[tag] = struct.unpack(form, data)
    return order, out


def _tiff(path: str, f) -> Raster:
    order, tags = _tags(f)
    one = lambda tag, other=None: tags[tag][0] if tag in tags else other
    width, height, bands = one(_WIDTH), one(_HEIGHT), one(_SAMPLES, 1)
    compression, predictor, planar = one(_COMPRESSION, 1), one(_PREDICTOR, 1), one(_PLANAR, 1) == 2
    bits, kind = one(_BITS, 1), one(_FORMAT, 1)
    if compression not in (1, 8, 32946) or predictor not in (1, 2) or bits not in (8, 16, 32, 64):
        raise ValueError(f"{path}: compression {compression}, predictor {predictor} or {bits} bits cannot be read")
    tiled = _TILES in tags
    bw, bh = (one(_TILE_WIDTH), one(_TILE_HEIGHT)) if tiled else (width, min(one(_ROWS, height), height))
    offsets, sizes = tags[_TILES if tiled else _STRIPS], tags[_TILE_SIZES if tiled else _STRIP_SIZES]
    places = [(r, c) for r in range(0, height, bh) for c in range(0, width, bw)]
    blocks = tuple(
        (r, c, bh if tiled else min(bh, height - r), bw, offsets[p * len(places) + k], sizes[p * len(places) + k], p)
        for p in range(bands if planar else 1) for k, (r, c) in enumerate(places)
    )
    transform = None
    if _TRANSFORM in tags:
        t = tags[_TRANSFORM]
        transform = (t[0], t[1], t[3], t[4], t[5], t[7])
    elif _SCALE in tags and _TIEPOINT in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[_SCALE], tags[_TIEPOINT]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    keys = tags.get(_GEOKEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    nodata = tags[_NODATA][0].split(b"\0")[0].decode() if _NODATA in tags else ""
    letter = {1: "u", 2: "i", 3: "f"}[kind]
    return Raster(path, width, height, bands, f"{order}{letter}{bits // 8}", "tiff", compression, predictor, planar, any(x in (1, 2) for x in tags.get(_EXTRA, ())), float(nodata) if nodata.strip() else None, codes.get(3072) or codes.get(2048), transform, blocks)


def _png(path: str, f) -> Raster:
    head = f.read_at(29, 0)
    width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", head[16:29])
    if laced:
        raise ValueError(f"{path} is interlaced")
    return Raster(path, width, height, {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}[colour], f"png{depth}", "png", alpha=colour in (4, 6), blocks=((0, 0, height, width, 0, 0, colour),))


def header(path: str) -> Raster:
    store, place = opened(path)
    with store.open_input_file(place) as f:
        head = f.read_at(8, 0)
        if head[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
            return _tiff(path, f)
        if head == b"\x89PNG\r\n\x1a\n":
            return _png(path, f)
    raise ValueError(f"{path} is no TIFF or PNG file")


def _block(raster: Raster, f, block: tuple) -> np.ndarray:
    """A block's samples: height, width, samples (one where the file is planar)."""
    _, _, h, w, offset, size, _ = block
    samples, kind = 1 if raster.planar else raster.bands, np.dtype(raster.dtype)
    data = f.read_at(size, offset) if size else b""
    if raster.compression != 1 and data:
        data = zlib.decompress(data)
    need = h * w * samples * kind.itemsize
    out = np.frombuffer(data[:need].ljust(need, b"\0"), kind).reshape(h, w, samples)  # a block of no bytes is empty, as sparse writers leave it
    if raster.predictor == 2:
        out = np.cumsum(out, axis=1, dtype=kind.newbyteorder("="))
    return out


def _unfiltered(rows: np.ndarray, bpp: int) -> np.ndarray:
    """The bytes of PNG rows (first byte: filter)."""
    out, above = np.zeros((len(rows), rows.shape[1] - 1), np.uint8), np.zeros(rows.shape[1] - 1, np.uint8)
    for k, row in enumerate(rows):
        kind, line = int(row[0]), row[1:]
        if kind == 1:
            padded = np.concatenate([line, np.zeros(-len(line) % bpp, np.uint8)]).reshape(-1, bpp)
            line = np.cumsum(padded, axis=0, dtype=np.uint8).ravel()[: len(line)]
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            raw, up, now = line.tolist(), above.tolist(), [0] * len(line)
            for i, x in enumerate(raw):
                left, corner = (now[i - bpp], up[i - bpp]) if i >= bpp else (0, 0)
                if kind == 3:
                    guess = (left + up[i]) >> 1
                else:
                    p = left + up[i] - corner
                    near = [(abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner)]
                    guess = min(near)[2]
                now[i] = (x + guess) & 255
            line = np.array(now, np.uint8)
        out[k] = above = line
    return out


def _png_pixels(raster: Raster, f) -> np.ndarray:
    depth, colour = int(raster.dtype[3:]), raster.blocks[0][6]
    at, packed, palette = 8, [], None
    while True:
        size, kind = struct.unpack(">I4s", f.read_at(8, at))
        if kind == b"IDAT":
            packed.append(f.read_at(size, at + 8))
        elif kind == b"PLTE":
            palette = np.frombuffer(f.read_at(size, at + 8), np.uint8).reshape(-1, 3)
        elif kind == b"IEND":
            break
        at += 12 + size
    samples = 1 if colour == 3 else raster.bands
    line = (raster.width * samples * depth + 7) // 8
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(raster.height, line + 1)
    data = _unfiltered(rows, max(1, samples * depth // 8))
    if depth == 16:
        values = data.view(">u2").astype(np.float64)
    elif depth == 8:
        values = data
    else:
        bits = np.unpackbits(data, axis=1).reshape(raster.height, -1, depth)
        values = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)
    values = values[:, : raster.width * samples].reshape(raster.height, raster.width, samples)
    return palette[values[:, :, 0]] if colour == 3 else values


@dataclass
class Blocks(InputPartition):
    raster: Raster
    blocks: list[tuple]


class _Window:
    def __init__(self, options: dict):
        self.row, self.col = int(options.get("row", 0)), int(options.get("col", 0))
        self.rows = self.row + int(options["height"]) if "height" in options else None
        self.cols = self.col + int(options["width"]) if "width" in options else None
        self.step = int(options.get("step", 1))
        if self.step < 1 or self.row < 0 or self.col < 0:
            raise ValueError("a window starts at 0 or later and steps by 1 or more")
        self.low, self.high = [0, 0], [2**31, 2**31]

    def take(self, f: Filter) -> None:
        if not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or f.attribute not in (("row",), ("col",)) or f.value is None:
            return
        k, value = ("row", "col").index(f.attribute[0]), int(f.value)
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.low[k] = max(self.low[k], value)
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            self.high[k] = min(self.high[k], value + 1)

    def of(self, raster: Raster) -> tuple[int, int, int, int]:
        """First and last row and column, the last ones not included."""
        rows = raster.height if self.rows is None else min(self.rows, raster.height)
        cols = raster.width if self.cols is None else min(self.cols, raster.width)
        return max(self.row, self.low[0]), min(rows, self.high[0]), max(self.col, self.low[1]), min(cols, self.high[1])

    def steps(self, first: int, a: int, b: int) -> np.ndarray:
        """The rows (or columns) from a to b that a step from `first` meets."""
        return np.arange(a + (first - a) % self.step, b, self.step)


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.window = options["path"], _Window(options)
        self.part_bytes = int(options.get("partbytes", PART_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            self.window.take(f)
            yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, _ in listed(self.path, ".tif", ".tiff", ".png"):
            raster = header(path)
            r0, r1, c0, c1 = self.window.of(raster)
            places: dict[tuple, list] = {}
            for b in raster.blocks:
                if b[0] < r1 and b[0] + b[2] > r0 and b[1] < c1 and b[1] + b[3] > c0:
                    places.setdefault(b[:2], []).append(b)  # the planes of a place stay together
            bare = Raster(**{**raster.__dict__, "blocks": raster.blocks if raster.kind == "png" else ()})
            size, part = 0, []
            for blocks in places.values():
                part += blocks
                size += blocks[0][2] * blocks[0][3] * raster.bands * 8
                if size >= self.part_bytes:
                    out.append(Blocks(bare, part))
                    size, part = 0, []
            if part:
                out.append(Blocks(bare, part))
        return out

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        raster, places = partition.raster, {}
        for b in partition.blocks:
            places.setdefault(b[:2], []).append(b)
        store, place = opened(raster.path)
        with store.open_input_file(place) as f:
            for (row, col), planes in places.items():
                if raster.kind == "png":
                    values = _png_pixels(raster, f)
                else:
                    values = np.concatenate([_block(raster, f, b) for b in sorted(planes, key=lambda b: b[6])], axis=2)
                yield from self._rows(raster, row, col, values)

    def _rows(self, raster: Raster, row: int, col: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        r0, r1, c0, c1 = self.window.of(raster)
        rows = self.window.steps(self.window.row, max(r0, row), min(r1, row + values.shape[0]))
        cols = self.window.steps(self.window.col, max(c0, col), min(c1, col + values.shape[1]))
        if not len(cols):
            return
        many = max(1, BATCH // len(cols))
        for k in range(0, len(rows), many):
            some = rows[k : k + many]
            part = values[np.ix_(some - row, cols - col)].astype(np.float64).reshape(len(some) * len(cols), -1)
            valid = self._valid(raster, part)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
            path = pa.array([raster.path]).take(pa.array(np.zeros(len(part), np.int32)))
            yield pa.RecordBatch.from_arrays([path, pa.array(np.repeat(some, len(cols)).astype(np.int32)), pa.array(np.tile(cols, len(some)).astype(np.int32)), lists, pa.array(valid)], names=["source_path", "row", "col", "bands", "valid"])

    @staticmethod
    def _valid(raster: Raster, part: np.ndarray) -> np.ndarray:
        """The mask: an alpha band above 0, else any band that is not no data, else all."""
        if raster.alpha:
            return part[:, -1] > 0
        if raster.nodata is None:
            return np.ones(len(part), bool)
        return (~np.isnan(part) if np.isnan(raster.nodata) else part != raster.nodata).any(axis=1)


class RasterSource(DataSource):
    """spark.read.format("raster").load(path): a row a pixel. Options: row, col, height, width (a window), step (every n-th row and column of it)."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> RasterReader:
        return RasterReader(dict(self.options))


@dataclass
class Files(InputPartition):
    paths: list[str]


class RasterHeaderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        paths = [p for p, _ in listed(self.path, ".tif", ".tiff", ".png")]
        return [Files(paths[k : k + 100]) for k in range(0, len(paths), 100)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths if partition else []:
            r = header(path)
            a, b, c, d, e, f = r.transform or (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
            corners = [(a * x + b * y + c, d * x + e * y + f) for x in (0, r.width) for y in (0, r.height)]
            xs, ys = zip(*corners, strict=True)
            yield (path, r.width, r.height, r.bands, r.dtype.lstrip("<>"), r.nodata, r.epsg, list(r.transform) if r.transform else None, min(xs), min(ys), max(xs), max(ys))


class RasterHeaderSource(DataSource):
    """spark.read.format("raster_headers").load(path): a row a file, from its directory."""

    @classmethod
    def name(cls) -> str:
        return "raster_headers"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema) -> RasterHeaderReader:
        return RasterHeaderReader(self.options["path"])


def register(spark: SparkSession) -> None:
    from ..shipping import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
    spark.dataSource.register(RasterHeaderSource)


def pixels(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """source_path, row, col, bands, valid of the pixels of raster files. Options as of RasterSource."""
    register(spark)
    return spark.read.format("raster").options(**options).load(path)


def raster_headers(spark: SparkSession, path: str) -> DataFrame:
    """Size, bands, kind, no data, reference system, transform and bounds of raster files."""
    register(spark)
    return spark.read.format("raster_headers").load(path)
