"""Functions over tables for SQL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class DensifyLine:
    """SELECT * FROM densify_line(TABLE(v) PARTITION BY line_id ORDER BY (seq), spacing): samples of each line (line_id, seq, x, y) at equal stations about
    `spacing` apart, ends included. A task holds one line at a time, and is called for each of its rows; for many lines see `DensifyLines`."""

    @staticmethod
    def analyze(lines: AnalyzeArgument, spacing: AnalyzeArgument) -> AnalyzeResult:
        if not lines.isTable:
            raise ValueError("the first argument is a table")
        known = {f.name.lower(): f for f in lines.dataType.fields}
        if not {"line_id", "seq", "x", "y"} <= known.keys():
            raise ValueError("the table needs line_id, seq, x and y")
        if spacing.value is not None and not spacing.value > 0:
            raise ValueError("the spacing is positive")
        fields = [known["line_id"], StructField("k", IntegerType()), *(StructField(c, DoubleType()) for c in ("station", "x", "y"))]
        return AnalyzeResult(StructType(fields))

    def __init__(self):
        self.points, self.line, self.spacing = [], None, 1.0

    def eval(self, row, spacing):
        self.line, self.spacing = row["line_id"], float(spacing)
        self.points.append((float(row["x"]), float(row["y"])))

    def terminate(self):
        steps = [(a, b, math.hypot(b[0] - a[0], b[1] - a[1])) for a, b in zip(self.points, self.points[1:], strict=False)]
        steps = [s for s in steps if s[2] > 0]
        total = math.fsum(s[2] for s in steps)
        if not steps:
            return
        many, at, passed = max(2, math.ceil(total / self.spacing) + 1), 0, 0.0
        for k in range(many):
            station = k * total / (many - 1)
            while at < len(steps) - 1 and passed + steps[at][2] <= station:
                passed += steps[at][2]
                at += 1
            (ax, ay), (bx, by), length = steps[at]
            u = min(1.0, (station - passed) / length)
            yield self.line, k, station, ax + u * (bx - ax), ay + u * (by - ay)


class DensifyLines:
    """SELECT * FROM densify_lines(TABLE(v) PARTITION BY pmod(hash(line_id), 1024) ORDER BY (line_id, seq), spacing): `densify_line` for partitions of many
    lines. Each Arrow batch is worked on as a whole, and a task holds one batch and one line at a time. Segments without length, or with a null place, count for
    nothing. Spark lets no such function say its columns by its arguments, so the type of line_id is given when it is registered."""

    def __init__(self):
        self.held, self.spacing = [], 1.0

    def eval(self, lines: pa.RecordBatch, spacing: pa.Array):
        self.spacing = float(spacing[0].as_py())
        if not self.spacing > 0:
            raise ValueError("the spacing is positive")
        at = {n.lower(): k for k, n in enumerate(lines.schema.names)}
        batch = pa.RecordBatch.from_arrays([lines.column(at["line_id"]), *(lines.column(at[c]).cast(pa.float64()) for c in ("x", "y"))], names=["line_id", "x", "y"])
        begin = int(_starts(batch.column("line_id"))[-1])
        if begin or self.held and self.held[-1].column("line_id")[-1] != batch.column("line_id")[0]:
            yield from self.sampled([*self.held, batch.slice(0, begin)])  # all lines but the last, which may go on
            self.held = []
        self.held.append(batch.slice(begin))

    def terminate(self):
        yield from self.sampled(self.held)

    def sampled(self, parts: list[pa.RecordBatch]):
        if not sum(p.num_rows for p in parts):
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        names = rows.column("line_id").combine_chunks()
        line = np.zeros(len(names), np.int64)
        line[_starts(names)[1:]] = 1
        line = np.cumsum(line)
        x, y = (rows.column(c).to_numpy() for c in ("x", "y"))
        length = np.where(line[1:] == line[:-1], np.hypot(np.diff(x), np.diff(y)), 0.0)
        begin = np.flatnonzero(length > 0)  # a segment is the place where it begins
        if not len(begin):
            return
        length, own = length[begin], line[begin]
        upto = pd.Series(length).groupby(own).cumsum().to_numpy()
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        last = np.append(first[1:], len(own)) - 1
        total = upto[last]
        many = np.maximum(2, np.ceil(total / self.spacing).astype(np.int64) + 1)
        of = np.repeat(np.arange(len(first)), many)
        k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        station = k * total[of] / (many - 1)[of]
        # The segments of a line that end at or before a station, by sorting both; at the end of a line its last segment stands.
        order = np.lexsort((np.repeat([0, 1], [len(own), len(of)]), np.append(upto, station), np.append(own, own[first][of])))
        before = np.cumsum(order < len(own))[order >= len(own)]
        at = np.empty(len(of), np.int64)
        at[order[order >= len(own)] - len(own)] = before
        at = np.minimum(at, last[of])
        passed = np.where(at > first[of], upto[at - 1], 0.0)
        u, a = np.minimum(1.0, (station - passed) / length[at]), begin[at]
        out = {"line_id": names.take(pa.array(a)), "k": k.astype(np.int32), "station": station, "x": x[a] + u * (x[a + 1] - x[a]), "y": y[a] + u * (y[a + 1] - y[a])}
        yield pa.table(out)


def _starts(names: pa.Array) -> np.ndarray:
    """Where runs of equal values begin; null equals null."""
    a, b = names.slice(1), names.slice(0, len(names) - 1)
    differs = np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | (np.asarray(pc.is_null(a)) != np.asarray(pc.is_null(b)))
    return np.append(0, np.flatnonzero(differs) + 1)


def register(spark: SparkSession, line_type: str = "string") -> None:
    """Make `densify_line` and `densify_lines` known to SQL, the latter for line_ids of a type."""
    from ..shipping import ship

    ship(spark)
    spark.udtf.register("densify_line", udtf(DensifyLine))
    spark.udtf.register("densify_lines", arrow_udtf(DensifyLines, returnType=f"line_id {line_type}, k int, station double, x double, y double"))
