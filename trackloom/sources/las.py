"""LAS point clouds (public ASPRS layout, versions 1.0 to 1.4, point formats 0 to 10, not compressed) as a data source.

Headers are read first, 375 bytes a file. A query's bounds on x, y and z are pushed down: files whose header bounds lie outside are not opened
again, and of the others each task drops the rows outside before it hands them on. Files are cut into ranges of whole records,
so a file of any size is read by many tasks, and a task holds one chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .files import heads, listed, opened

#: Bytes of the longest public header block, of the records of a task, and records of a chunk.
HEAD, PART_BYTES, CHUNK = 375, 64 << 20, 250_000
#: Where the colours of a point format start.
COLOUR = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
SCHEMA = "x double, y double, z double, intensity float, classification int, red int, green int, blue int, source_path string"
HEADERS = "path string, n long, x_min double, x_max double, y_min double, y_max double, z_min double, z_max double, has_rgb boolean, version string, point_format int"


@dataclass(frozen=True)
class Header:
    path: str
    version: tuple[int, int]
    form: int
    start: int
    size: int
    n: int
    scale: tuple[float, ...]
    shift: tuple[float, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]

    @classmethod
    def of(cls, path: str, head: bytes) -> Header:
        if len(head) < 227 or head[:4] != b"LASF":
            raise ValueError(f"{path} is no LAS file")
        if head[104] & 0x80:
            raise ValueError(f"{path} is compressed; LAZ needs an external library")
        at = lambda kind, pos, n=1: np.frombuffer(head, kind, n, pos).tolist()
        # From 1.4 on the count has 64 bits, and the field of before may be 0.
        n = at("<u8", 247)[0] if (head[24], head[25]) >= (1, 4) and len(head) >= 255 else 0
        box = at("<f8", 179, 6)
        return cls(path, (head[24], head[25]), head[104] & 0x3F, at("<u4", 96)[0], at("<u2", 105)[0], n or at("<u4", 107)[0], tuple(at("<f8", 131, 3)), tuple(at("<f8", 155, 3)), tuple(box[1::2]), tuple(box[::2]))


@dataclass
class Records(InputPartition):
    header: Header
    first: int
    last: int


class _Bounds:
    """What filters say of x, y and z; each is also left to Spark, which judges exactly."""

    def __init__(self):
        self.low, self.high = [-np.inf] * 3, [np.inf] * 3

    def take(self, f: Filter) -> None:
        if not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or f.attribute not in (("x",), ("y",), ("z",)) or f.value is None:
            return
        k, value = "xyz".index(f.attribute[0]), float(f.value)
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.low[k] = max(self.low[k], value)
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            self.high[k] = min(self.high[k], value)

    def meets(self, h: Header) -> bool:
        # Header bounds are rounded by some writers: a record's own scale is the slack.
        return h.n > 0 and all(h.low[k] - h.scale[k] <= self.high[k] and h.high[k] + h.scale[k] >= self.low[k] for k in range(3))

    def within(self, columns: list[np.ndarray]) -> np.ndarray:
        ok = np.ones(len(columns[0]), bool)
        for k, c in enumerate(columns):
            if self.low[k] > -np.inf:
                ok &= c >= self.low[k]
            if self.high[k] < np.inf:
                ok &= c <= self.high[k]
        return ok


class LasReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes, self.bounds = path, part_bytes, _Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            self.bounds.take(f)
            yield f

    def partitions(self) -> list[InputPartition]:
        paths = [p for p, _ in listed(self.path, ".las")]
        out = []
        for h in (Header.of(p, b) for p, b in zip(paths, heads(paths, HEAD), strict=True)):
            if self.bounds.meets(h):
                step = max(1, self.part_bytes // h.size)
                out += [Records(h, k, min(k + step, h.n)) for k in range(0, h.n, step)]
        return out

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has what the filters ask for
            return
        h = partition.header
        store, place = opened(h.path)
        kinds = [pa.float64()] * 3 + [pa.float32()] + [pa.int32()] * 4 + [pa.string()]
        with store.open_input_file(place) as f:
            for first in range(partition.first, partition.last, CHUNK):
                many = min(CHUNK, partition.last - first)
                raw = np.frombuffer(f.read_at(many * h.size, h.start + first * h.size), np.uint8)
                if len(raw) < many * h.size:
                    raise ValueError(f"{h.path} ends before its {h.n} records")
                raw = raw.reshape(many, h.size)
                field = lambda pos, kind, p=raw: np.ascontiguousarray(p[:, pos : pos + np.dtype(kind).itemsize]).view(kind).ravel()
                xyz = [field(4 * k, "<i4") * h.scale[k] + h.shift[k] for k in range(3)]
                ok = self.bounds.within(xyz)
                kept = int(ok.sum())
                if not kept:
                    continue
                kind = field(16, "u1") if h.form >= 6 else field(15, "u1") & 0x1F
                columns = [*xyz, field(12, "<u2").astype("f4"), kind.astype("i4")]
                colour = COLOUR.get(h.form)
                rgb = [pa.nulls(kept, pa.int32()) if colour is None else pa.array(field(colour + 2 * k, "<u2").astype("i4")[ok]) for k in range(3)]
                arrays = [pa.array(c[ok]) for c in columns] + rgb + [pa.array([h.path]).take(pa.array(np.zeros(kept, np.int32)))]
                yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


class LasSource(DataSource):
    """spark.read.format("las").load(path); option partBytes: the records of a task."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(self.options["path"], int(self.options.get("partbytes", PART_BYTES)))


@dataclass
class Files(InputPartition):
    paths: list[str]


class HeaderReader(DataSourceReader):
    def __init__(self, path: str, files: int):
        self.path, self.files = path, files

    def partitions(self) -> list[InputPartition]:
        paths = [p for p, _ in listed(self.path, ".las")]
        return [Files(paths[k : k + self.files]) for k in range(0, len(paths), self.files)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, head in zip(partition.paths if partition else [], heads(partition.paths if partition else [], HEAD), strict=True):
            h = Header.of(path, head)
            box = [x for pair in zip(h.low, h.high, strict=True) for x in pair]
            yield (path, h.n, *box, h.form in COLOUR, f"{h.version[0]}.{h.version[1]}", h.form)


class HeaderSource(DataSource):
    """spark.read.format("las_headers").load(path): one row a file, from its header; option files: how many a task reads."""

    @classmethod
    def name(cls) -> str:
        return "las_headers"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options["path"], int(self.options.get("files", 1000)))


def register(spark: SparkSession) -> None:
    """Make both sources known to the session, and let filters reach them."""
    from ..shipping import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasSource)
    spark.dataSource.register(HeaderSource)


def las_points(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Points of LAS files. Filters on x, y and z reach the files."""
    register(spark)
    return spark.read.format("las").option("partBytes", part_bytes).load(path)


def las_headers(spark: SparkSession, path: str) -> DataFrame:
    """Count, bounds and kinds of LAS files, from their headers alone."""
    register(spark)
    return spark.read.format("las_headers").load(path)
