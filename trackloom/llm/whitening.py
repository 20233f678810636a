"""Embedding whitening: vectors are centred and turned onto the eigenvectors of their covariance, each scaled to variance one.

Every task streams its vectors through Welford's update, one rank-one step a vector, which centres before it multiplies. The
states of tasks are merged by the parallel update formula, MERGED at a time, until one is left; a state has the size of a covariance,
whatever the number of vectors, and only the last one reaches the driver. There a symmetric QR iteration (Householder
reflections to tridiagonal form, then implicit shifts) gives eigenvalues and vectors. A second pass whitens, and a third, by the same updates, measures
the covariance of what came out.

Entries become whole numbers, floor(scale * c), so sums and deviations are exact. A constant added to all of them moves the
mean alone, and nothing that is returned, so none is added: what is centred stays small and loses no digits.

Defined results: rows whose vector is null or empty, or has a null, NaN or infinite entry, are left out; so are vectors of
another length than most have (of two lengths with equally many rows, the longer is taken). Repeated rows count as often as
they stand; a null id stays null. Components whose eigenvalue is zero but for rounding cannot be scaled and are left out, so
a table of one vector, or of equal ones, gives no components. An empty table gives an empty one. Entries beyond 2**62 when scaled count as
2**62. A deviation beyond a long is null. Extra columns pass through `Whitening.transform` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

SCALE, COMPONENTS = 64, 32
#: States that one task merges.
MERGED = 16
#: Vectors whitened at a time.
ROWS = 2048
_MOST, _LONG = 2.0**62, 2**63


class Moments:
    """Number, mean and summed outer products of deviations of the vectors seen so far."""

    def __init__(self, size: int):
        self.n, self.mean, self.products, self.sums = 0, np.zeros(size), np.zeros((size, size)), [0] * size
        self._step = np.empty((size, size))

    def add(self, rows: np.ndarray) -> None:
        """Welford's update by each row in turn."""
        for row in rows:
            self.n += 1
            away = row - self.mean
            self.mean += away / self.n
            np.multiply(away[:, None], row - self.mean, out=self._step)
            self.products += self._step

    def count(self, whole: np.ndarray) -> None:
        """Exact sums of whole numbers."""
        if np.abs(whole).max(initial=0) < _MOST / max(len(whole), 1):
            self.sums = [a + b for a, b in zip(self.sums, whole.sum(axis=0).tolist(), strict=True)]
        else:
            self.sums = [a + sum(column) for a, column in zip(self.sums, whole.T.tolist(), strict=True)]

    def merge(self, other: Moments) -> None:
        """The state of both parts together."""
        if not other.n:
            return
        total, away = self.n + other.n, other.mean - self.mean
        self.products += other.products + np.multiply.outer(away, away) * (self.n / total * other.n)
        self.mean += away * (other.n / total)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = total

    @property
    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * max(self.n, 1))


_STATE = "size int, slot long, n long, sums array<decimal(38,0)>, mean array<double>, products array<double>"


def _packed(states: dict[int, Moments], slot: int) -> pa.RecordBatch:
    rows = [(size, slot, m.n, [Decimal(x) for x in m.sums], m.mean.tolist(), m.products.ravel().tolist()) for size, m in sorted(states.items())]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in _STATE.split(", ")])


def _unpacked(size: int, n: int, sums, mean, products) -> Moments:
    m = Moments(size)
    m.n, m.mean, m.products, m.sums = n, np.array(mean, float), np.array(products, float).reshape(size, size), [int(x) for x in sums]
    return m


def vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the usable vectors of a list column, one for each length."""
    lists = column.cast(pa.list_(pa.float64()))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    sizes = np.diff(offsets)
    usable = np.asarray(pc.is_valid(lists)) & (sizes > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    for size in np.unique(sizes[usable]).tolist():
        rows = np.flatnonzero(usable & (sizes == size))
        yield size, rows, values[offsets[rows][:, None] + np.arange(size)]


def whole(matrix: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(matrix * scale), -_MOST, _MOST)


def _moments(df: DataFrame, read) -> Moments | None:
    """The merged state of the vectors that `read` finds in the batches of all tasks; of the length that most have."""

    def run(batches):
        states: dict[int, Moments] = {}
        for batch in batches:
            for size, rows, exact in read(batch):
                m = states.setdefault(size, Moments(size))
                m.add(rows)
                if exact is not None:
                    m.count(exact)
        if states:
            yield _packed(states, TaskContext.get().partitionId())

    def join(batches):
        states: dict[int, Moments] = {}
        slot = None
        for batch in batches:
            for r in batch.to_pylist():
                slot = r["slot"] if slot is None else min(slot, r["slot"])
                states.setdefault(r["size"], Moments(r["size"])).merge(_unpacked(r["size"], r["n"], r["sums"], r["mean"], r["products"]))
        if states:
            yield _packed(states, slot)

    states = base.stored(base.map_arrow(df, run, _STATE), "moments")
    most = states.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return None
    states = states.filter(F.col("size") == most["size"])
    while (many := states.count()) > 1:
        parts = -(-many // MERGED)
        dealt = states.repartition(parts, F.pmod("slot", F.lit(parts))).sortWithinPartitions("slot") if parts > 1 else states.coalesce(1).sortWithinPartitions("slot")
        merged = base.stored(base.map_arrow(dealt, join, _STATE), "moments")
        base.discard(states)
        states = merged
    last = states.first()
    return _unpacked(last["size"], last["n"], last["sums"], last["mean"], last["products"])


def eigen(matrix: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and the unit eigenvectors beside them (in rows) of a symmetric matrix.

    Of either sign, that one is taken in which the entry of largest size is positive.
    """
    size = len(matrix)
    a, turned = np.array(matrix, float), np.eye(size)
    for k in range(size - 2):  # reflections that clear column k below the subdiagonal
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        length = v @ v
        if length == 0:
            continue
        half = a[k + 1 :, k + 1 :] @ v * (2 / length)
        half -= v * (half @ v / length)
        a[k + 1 :, k + 1 :] -= np.multiply.outer(v, half) + np.multiply.outer(half, v)
        a[k + 1 :, k] -= v * (2 * (v @ a[k + 1 :, k]) / length)
        turned[k + 1 :] -= np.multiply.outer(v, v @ turned[k + 1 :]) * (2 / length)
    main, beside = np.diag(a).copy(), np.append(np.diag(a, -1), 0.0)
    tiny, high = np.finfo(float).eps, size - 1
    spent = 0
    while high > 0:
        low = high
        while low > 0 and abs(beside[low - 1]) > tiny * (abs(main[low - 1]) + abs(main[low])):
            low -= 1
        if low > 0:
            beside[low - 1] = 0.0
        if low == high:
            high, spent = high - 1, 0
            continue
        spent += 1
        if spent > rounds:
            raise ArithmeticError("the QR iteration did not settle")
        gap = (main[high - 1] - main[high]) / 2
        edge = beside[high - 1]
        x = main[low] - (main[high] - edge * edge / (gap + np.copysign(np.hypot(gap, edge), gap)))  # the eigenvalue of the last two rows nearer to the last
        z = beside[low]
        for k in range(low, high):  # a bulge is chased down the diagonal by rotations
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                beside[k - 1] = r
            p, q, e = main[k], main[k + 1], beside[k]
            main[k], main[k + 1] = c * c * p + 2 * c * s * e + s * s * q, s * s * p - 2 * c * s * e + c * c * q
            beside[k] = c * s * (q - p) + (c * c - s * s) * e
            if k < high - 1:
                x, z = beside[k], s * beside[k + 1]
                beside[k + 1] *= c
            upper, lower = turned[k].copy(), turned[k + 1].copy()
            turned[k], turned[k + 1] = c * upper + s * lower, c * lower - s * upper
    order = np.argsort(-main, kind="stable")
    turned = turned[order]
    signs = np.where(turned[np.arange(size), np.abs(turned).argmax(axis=1)] < 0, -1.0, 1.0)
    return main[order], turned * signs[:, None]


@dataclass(frozen=True)
class Whitening:
    """n vectors with exact sums of their whole numbers, and the components fitted to them."""

    n: int
    sums: list[int]
    scale: float
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def size(self) -> int:
        return len(self.sums)

    def deviations(self, exact: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Of rows of whole numbers: the summed squares of n * x - sums, and x less the mean."""
        most = self.n * int(np.abs(exact).max(initial=0)) + max(map(abs, self.sums))
        if most * most * self.size < _LONG:
            away = self.n * exact.astype(np.int64) - np.array(self.sums, np.int64)
            return (away * away).sum(axis=1).tolist(), away / self.n
        rows = [[self.n * int(x) - s for x, s in zip(row, self.sums, strict=True)] for row in exact.tolist()]
        squares = [sum(x * x for x in row) for row in rows]
        return [x if x < _LONG else None for x in squares], np.array([[x / self.n for x in row] for row in rows]).reshape(-1, self.size)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.axes.T / np.sqrt(self.values)

    def transform(self, df: DataFrame, column: str = "embedding") -> DataFrame:
        """The usable rows with `whitened` (array<double>) and `deviation` (long), named free of the table's own columns."""
        names = base.free(df, "whitened"), base.free(df, "deviation")
        at, me, kept = df.columns.index(column), self, list(df.schema)

        def run(batches):
            for batch in batches:
                for size, rows, matrix in vectors(batch.column(at)):
                    if size != me.size:
                        continue
                    for k in range(0, len(rows), ROWS):
                        squares, centred = me.deviations(whole(matrix[k : k + ROWS], me.scale))
                        out = me.project(centred)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(me.values), pa.int32()), pa.array(out.ravel()))
                        own = batch.take(pa.array(rows[k : k + ROWS]))
                        yield pa.RecordBatch.from_arrays([*own.columns, lists, pa.array(squares, pa.int64())], names=[*own.schema.names, *names])

        return base.map_arrow(df, run, T.StructType([*kept, T.StructField(names[0], T.ArrayType(T.DoubleType())), T.StructField(names[1], T.LongType())]))

    def identity_error(self, df: DataFrame, column: str = "embedding") -> float:
        """The largest entry, in size, of the covariance of whitened vectors less the identity; measured over all rows."""
        me, size = self, self.size

        def read(batch):
            for found, _, matrix in vectors(batch.column(0)):
                if found == size:
                    for k in range(0, len(matrix), ROWS):
                        yield len(me.values), me.project(me.deviations(whole(matrix[k : k + ROWS], me.scale))[1]), None

        found = _moments(df.select(F.col(f"`{column}`").alias("vector")), read)
        return 0.0 if found is None else float(np.abs(found.covariance - np.eye(len(me.values))).max())


def fit(df: DataFrame, column: str = "embedding", scale: float = SCALE, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors, by up to so many components; None if no component has a variance."""

    def read(batch):
        for size, _, matrix in vectors(batch.column(0)):
            exact = whole(matrix, scale)
            yield size, exact, exact.astype(np.int64)

    found = _moments(df.select(F.col(f"`{column}`").alias("vector")), read)
    if found is None:
        return None
    values, axes = eigen(found.covariance)
    some = int((values > values[0] * len(values) * np.finfo(float).eps).sum()) if values[0] > 0 else 0
    some = min(some, components)
    return Whitening(found.n, found.sums, scale, values[:some], axes[:some], float(np.trace(found.covariance))) if some else None


def digest(df: DataFrame, key: str, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component."""
    rows = df.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{column}`").alias("embedding"))
    made = fit(rows, components=components)
    kind = df.schema[key].dataType.simpleString()
    if made is None:
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = made.identity_error(rows)
    shares = F.array(*(F.lit(float(x / made.trace)) for x in made.values))
    out = made.transform(rows).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(made.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "at").alias("explained"), F.lit(error).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(base.table(spark, sf_dir, "embeddings"), "vec_id")
