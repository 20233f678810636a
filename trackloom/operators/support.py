"""How well evidence carries lines, sampled at even steps: samples are made and judged in the task that holds the line, and never shuffled.

Cells of an eighth of the threshold tell most samples' verdicts; a cell along the edge of what the evidence reaches comes with the segments that may
decide there. Both are counted against bounds and broadcast; beyond the bounds samples are judged by joins, with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow, map_runs
from .lines import sampled, support
from .ranges import reached, segment_ends, spots, spread

#: Cells, and pairs of a cell and a segment, that are broadcast at most: 32 MB each.
CELLS, PAIRS = 4_000_000, 1_000_000
#: Samples at once, and lengths that are added up line by line beyond.
BLOCK, SHORT = 1 << 18, 32


@dataclass(frozen=True)
class Reach:
    """Cells (their keys in order) that evidence reaches: all of a cell, or, with segments (cell k has those from starts[k] to starts[k + 1]), parts of it."""

    radius: float
    size: float
    box: tuple[int, int, int, int]
    whole: np.ndarray
    edge: np.ndarray
    starts: np.ndarray
    segments: np.ndarray

    def holds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether any segment lies within the radius of each place."""
        ok = np.zeros(len(x), bool)
        x0, y0, x1, y1 = self.box
        cx, cy = np.floor(x / self.size), np.floor(y / self.size)
        at = np.flatnonzero((cx >= x0) & (cx <= x1) & (cy >= y0) & (cy <= y1))
        if not len(at):
            return ok
        key = (cx[at].astype(np.int64) - x0) * (y1 - y0 + 1) + (cy[at].astype(np.int64) - y0)
        ok[at] = self.found(self.whole, key)[0]
        found, place = self.found(self.edge, key)
        at, place = at[found], place[found]
        many = np.diff(self.starts)[place]
        cuts = np.searchsorted(np.cumsum(many), np.arange(BLOCK, many.sum() + BLOCK, BLOCK))  # so many pairs at once, and one place more
        for a, b in zip([0, *(cuts + 1)], [*(cuts + 1), len(at)], strict=True):
            n = many[a:b]
            if not len(n):
                continue
            first = np.cumsum(n) - n
            ax, ay, bx, by = self.segments[:, np.repeat(self.starts[place[a:b]] - first, n) + np.arange(n.sum())]
            px, py = (np.repeat(v[at[a:b]], n) - o for v, o in ((x, ax), (y, ay)))
            dx, dy = bx - ax, by - ay
            size = dx * dx + dy * dy
            u = np.clip(np.where(size == 0, 0.0, (px * dx + py * dy) / np.where(size == 0, 1.0, size)), 0.0, 1.0)
            rx, ry = px - u * dx, py - u * dy
            ok[at[a:b]] = np.logical_or.reduceat(np.sqrt(rx * rx + ry * ry) <= self.radius, first)
        return ok

    @staticmethod
    def found(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return keys[place] == key, place


def _reach(evidence: DataFrame, radius: float) -> Reach | None:
    """The cells and segments to broadcast, or None where there are too many."""
    seg, near = reached(evidence, radius)
    size, half, slack = radius / 8, radius / 8 / 2**0.5, 1e-9 * radius
    n, *box = near.agg(F.count("*"), F.min("_sx"), F.min("_sy"), F.max("_sx"), F.max("_sy")).first()
    if n > CELLS or n and (box[2] - box[0] + 1) * (box[3] - box[1] + 1) >= 2**62:
        return None
    x0, y0, _, y1 = box = tuple(box) if n else (0, 0, -1, -1)
    high = y1 - y0 + 1
    cells = near.select(((F.col("_sx") - x0) * high + (F.col("_sy") - y0)).alias("key"), "_d", "_all").toArrow()
    key, d, whole = (cells.column(c).to_numpy() for c in ("key", "_d", "_all"))
    edge = np.flatnonzero(~whole)[np.argsort(key[~whole])]
    # The segment nearest to a place of the cell is no farther from the middle than the nearest one and the way across.
    sent = near.sparkSession.sparkContext.broadcast((key[edge], np.minimum(d[edge] + 2 * half, radius + half) + slack))

    def pairs_of(batches):
        keys, most = sent.value
        for batch in batches:
            ends = segment_ends(batch)
            for k, x, y, d in spots(ends, size, radius + half + slack):
                found, place = Reach.found(keys, (x - x0) * high + (y - y0))
                found &= d <= most[place] if len(most) else False
                yield pa.RecordBatch.from_arrays([pa.array((x[found] - x0) * high + (y[found] - y0)), *map(pa.array, ends[:, k[found]])], ["key", "ax", "ay", "bx", "by"])

    pairs = map_arrow(spread(seg), pairs_of, "key long, ax double, ay double, bx double, by double").limit(PAIRS + 1).toArrow()
    if len(pairs) > PAIRS:
        return None
    keys, *ends = (pairs.column(c).to_numpy() for c in range(5))
    order = np.argsort(keys, kind="stable")
    edge, starts = np.unique(keys[order], return_index=True)
    return Reach(radius, size, box, np.sort(key[whole]), edge, np.append(starts, len(keys)), np.stack(ends)[:, order])


def _before(length: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The length of a line before each of its segments, added up in their order."""
    out = np.zeros(len(length))
    for k in range(1, SHORT):
        at = first[many > k] + k
        if not len(at):
            break
        out[at] = out[at - 1] + length[at - 1]
    for a, n in zip(first[many > SHORT], many[many > SHORT], strict=True):
        out[a + 1 : a + n] = np.cumsum(length[a : a + n - 1])
    return out


def judged(x: np.ndarray, y: np.ndarray, starts: np.ndarray, reach: Reach, step: float) -> tuple[np.ndarray, ...]:
    """Of lines (line k has the vertices from starts[k] to starts[k + 1]) that have a length: their numbers, samples, samples near evidence and longest run of others."""
    on = np.ones(len(x), bool)
    on[starts[1:] - 1] = False
    at = np.flatnonzero(on)
    with np.errstate(invalid="ignore"):
        dx, dy = x[at + 1] - x[at], y[at + 1] - y[at]
        length = np.sqrt(dx * dx + dy * dy)
        good = (length > 0) & np.isfinite(length)
    at, dx, dy, length = at[good], dx[good], dy[good], length[good]
    number, first, many = np.unique(np.searchsorted(starts, at, "right") - 1, return_index=True, return_counts=True)
    if not len(number):
        return number, number, number, number
    s0 = _before(length, first, many)
    last = first + many - 1
    total = s0[last] + length[last]
    whole = np.floor(total / step)
    n = whole.astype(np.int64) + 1 + (total != whole * step)
    # A sample belongs to the last segment that begins at or before it.
    k = np.ceil(s0 / step)
    k = k - ((k - 1) * step >= s0) + (k * step < s0)
    line = np.repeat(np.arange(len(number)), many)
    begin = np.minimum(k.astype(np.int64), n[line] - 1)  # the first sample of a segment, as its line counts
    begin[first] = 0
    end = np.append(begin[1:], 0)
    end[last] = n
    base = np.cumsum(n) - n  # the first sample of a line, as all lines count
    ends = base[line] + end
    ok = np.empty(int(n.sum()), bool)
    for p in range(0, len(ok), BLOCK):
        q = min(p + BLOCK, len(ok))
        a, b = np.searchsorted(ends, [p, q - 1], "right") + (0, 1)
        times = np.minimum(ends[a:b], q) - np.maximum(base[line[a:b]] + begin[a:b], p)
        of = np.repeat(np.arange(a, b), times)
        u = (np.minimum((np.arange(p, q) - base[line[of]]) * step, total[line[of]]) - s0[of]) / length[of]
        ok[p:q] = reach.holds(x[at[of]] + u * dx[of], y[at[of]] + u * dy[of])
    place = np.arange(len(ok))
    run = place - np.maximum(np.maximum.accumulate(np.where(ok, place, -1)), np.repeat(base - 1, n))
    return number, n, np.add.reduceat(ok.astype(np.int64), base), np.maximum.reduceat(run, base)


def of_lines(vertices: DataFrame, evidence: DataFrame, threshold: float, step: float, line: str = "line_id", seq: str = "seq") -> DataFrame:
    """What `lines.support` says of the samples of `lines.sampled`, without distances: line, support_ratio, n_samples, max_unsupported. Vertices without a finite
    place bound no segment; lines without a length have no row."""
    each = max(step, 0.25)
    reach = _reach(evidence, threshold)
    if reach is None:
        return support(sampled(vertices, step, line), evidence, threshold, step, [line], distances=False).select(line, "support_ratio", "n_samples", "max_unsupported")
    sent = vertices.sparkSession.sparkContext.broadcast(reach)

    def run(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
        number, n, ok, longest = judged(x, y, starts, sent.value, each)
        columns = [batch.column(0).take(pa.array(starts[number])), pa.array(ok / n), pa.array(n), pa.array(longest * float(step))]
        return pa.RecordBatch.from_arrays(columns, ["line", "support_ratio", "n_samples", "max_unsupported"])

    rows = vertices.filter(F.col(line).isNotNull()).select(F.col(line).alias("line"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(seq).alias("seq"))
    kind = vertices.schema[line].dataType.simpleString()
    return map_runs(rows, ["line"], ["seq"], run, f"line {kind}, support_ratio double, n_samples long, max_unsupported double").withColumnRenamed("line", line)
