"""Turnouts: the best ways through the rail pairs found slice by slice, the main track among them, and the branch that leaves it.

A key's candidates (slice, s, t, z, score) are one region, some hundreds of slices with a few pairs each; regions are dealt out
by Spark, and a task works through many of them. A way may jump over empty slices and slices whose candidates are wrong. It gains
by every slice it takes, more for a better candidate and for one near an anchor, and pays for gaps and for moving sideways or up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_runs
from .ranges import interpolate


#: Cells of a matrix at once: places of ways, or pairs of candidates.
CELLS = 1 << 18


@dataclass(frozen=True)
class Tracing:
    """Defaults are fixed values."""

    slice_length: float = 1.0
    #: Candidates of a slice that are looked at, the best first.
    most_candidates: int = 8
    #: Gain of a slice, and of the best candidate of a slice over its worst.
    length_weight: float = 2.0
    score_weight: float = 1.0
    #: Longest gap, and the price of each metre of it, of moving sideways, and of moving up or down.
    most_gap: float = 3.0
    gap_weight: float = 0.9
    lateral_weight: float = 8.0
    height_weight: float = 1.5
    #: Sideways moves allowed: so much a metre and a bit, but never less than `least_move`.
    move_per_metre: float = 0.55
    move_slack: float = 0.1
    least_move: float = 0.35
    #: Slices of a way at least; ways kept; two ways are one if the median of their distances in three common slices is less than `alike`.
    least_slices: int = 6
    alike: float = 0.2
    main_ways: int = 16
    branch_ways: int = 96
    #: Candidates that may belong to a branch; a branch's least length, and how near to the main track it starts.
    apart: float = 0.45
    least_branch: float = 8.0
    start_apart: float = 1.75
    #: A branch start is drawn onto the main track if its next place is no farther from it.
    anchored: float = 1.0
    #: How far from its anchor a candidate may be, and what one on it gains.
    snap: float = 2.5
    anchor_weight: float = 14.0


def normalised(candidates: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The best candidates of each slice with `quality`, their score between the slice's least (0) and greatest (1); 0.5 where all are alike."""
    by = Window.partitionBy(*keys, "slice")
    rows = candidates.withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "t"))).filter(F.col("place") <= most)
    low, high = F.min("score").over(by), F.max("score").over(by)
    return rows.withColumn("quality", F.when(high - low <= 1e-9, 0.5).otherwise((F.col("score") - low) / (high - low)))


class Ways:
    """The best way to each candidate of one region, by a programme over the candidates in order of slices."""

    def __init__(self, number: np.ndarray, s: np.ndarray, t: np.ndarray, z: np.ndarray, gain: np.ndarray, rule: Tracing):
        self.slices, self.s, self.t = number, s, t
        n = len(s)
        self.total, self.back = gain.astype(float), np.full(n, -1)
        begins = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if n else np.zeros(0, np.int64)
        ends = np.append(begins[1:], n)
        if not n:
            return
        far, near = np.maximum.accumulate(np.maximum.reduceat(s, begins)), np.minimum.reduceat(s, begins)
        past = np.minimum(np.searchsorted(far, near - rule.most_gap), np.arange(len(begins)))  # the first slice that a way may come from
        # Of equal ways the one over the nearest slice, then the better candidate: slices from last to first, so what lies before a slice is one stretch.
        turned = np.lexsort((np.arange(n), -number))
        reach, many = begins - begins[past], ends - begins
        upto = np.cumsum(reach * many)
        total = np.zeros(n)
        total[n - ends[0] :] = self.total[: ends[0]]
        done = 1
        while done < len(begins):
            to = max(done + 1, int(np.searchsorted(upto, upto[done - 1] + CELLS, side="right")))
            price = self._prices(turned, z, rule, begins[done:to], many[done:to], reach[done:to])
            for a, b, wide, at in zip(*(c.tolist() for c in (begins[done:to], ends[done:to], reach[done:to], upto[done - 1 : to - 1] - upto[done - 1])), strict=True):
                if wide:
                    before = total[n - a : n - a + wide] - price[at : at + wide * (b - a)].reshape(b - a, wide)
                    best = before.argmax(axis=1)
                    more = before.max(axis=1)
                    take = more > 0
                    self.total[a:b] += np.maximum(more, 0.0)
                    self.back[a:b][take] = turned[n - a + best[take]]
                total[n - b : n - a] = self.total[a:b]
            done = to

    def _prices(self, turned: np.ndarray, z: np.ndarray, rule: Tracing, begins: np.ndarray, many: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """What each candidate of some slices pays for coming from each one before within reach, the nearest slice first; infinite where it may not."""
        each = np.repeat(reach, many)
        row = np.repeat(np.arange(begins[0], begins[0] + many.sum()), each)
        ends = np.cumsum(each)
        other = turned[np.repeat(np.repeat(len(turned) - begins, many) - ends + each, each) + np.arange(len(row))]
        ds, dt = self.s[row] - self.s[other], np.abs(self.t[row] - self.t[other])
        allowed = (ds > 1e-6) & (ds <= rule.most_gap) & (dt <= np.maximum(rule.least_move, rule.move_per_metre * ds + rule.move_slack))
        price = rule.lateral_weight * dt + rule.gap_weight * np.maximum(0.0, ds - rule.slice_length) + rule.height_weight * np.abs(z[row] - z[other])
        return np.where(allowed, price, np.inf)

    def to(self, end: int) -> list[int]:
        out = []
        while end >= 0:
            out.append(end)
            end = int(self.back[end])
        return out[::-1]

    def best(self, most: int, rule: Tracing) -> list[list[int]]:
        """Ways by falling total, none too short, none like one before.

        Ways are rows of a matrix with a column for each slice, some ways at a time; each way that is kept is held against all that are left at once.
        """
        _, column = np.unique(self.slices, return_inverse=True)
        order, wide = np.argsort(-self.total, kind="stable"), int(column.max(initial=0)) + 1
        at_once = max(1, CELLS // wide)
        kept: list[int] = []
        rows: list[np.ndarray] = []
        for begin in range(0, len(order), at_once):
            ends = order[begin : begin + at_once]
            places, size = self._places(ends, column, wide)
            ends, places = ends[size >= rule.least_slices], places[size >= rule.least_slices]
            for row in rows:
                left = ~_alike(places, row, rule.alike)
                ends, places = ends[left], places[left]
            while len(ends):
                kept.append(int(ends[0]))
                rows.append(places[0])
                if len(kept) == most:
                    return [self.to(end) for end in kept]
                left = ~_alike(places[1:], rows[-1], rule.alike)
                ends, places = ends[1:][left], places[1:][left]
        return [self.to(end) for end in kept]

    def _places(self, ends: np.ndarray, column: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """For the way to each end its t in each slice, NaN where it takes none, and how many it takes."""
        places = np.full(len(ends) * wide, np.nan)
        row, at = np.arange(len(ends)) * wide, ends
        while len(at):
            places[row + column[at]] = self.t[at]
            at = self.back[at]
            on = np.flatnonzero(at >= 0)
            row, at = row[on], at[on]
        places = places.reshape(len(ends), wide)
        return places, (~np.isnan(places)).sum(axis=1)


def _alike(ways: np.ndarray, way: np.ndarray, alike: float) -> np.ndarray:
    """Which ways (rows of t by slice, NaN where none) have three slices or more in common with one, and a median distance there of less than `alike`.

    Where more than half of the distances are less, the median is; where exactly half are, it is the mean of the two in the middle.
    """
    apart = np.abs(ways[:, ~np.isnan(way)] - way[~np.isnan(way)])
    common, near = (~np.isnan(apart)).sum(axis=1), (apart < alike).sum(axis=1)
    out = (common >= 3) & (2 * near > common)
    for k in np.flatnonzero((common >= 3) & (2 * near == common)):
        out[k] = np.median(apart[k][~np.isnan(apart[k])]) < alike
    return out


def branch_score(total: float, s: np.ndarray, separation: np.ndarray, rule: Tracing) -> float | None:
    """How good a way (with signed distances from the main track) is as a branch; None if it is none.

    It is long enough, starts near the main track and leaves it. A way that grows apart and starts close gains, one that
    has run beside the main track from its start loses. The weights are fixed values.
    """
    away = np.abs(separation)
    length, most = float(s.max() - s.min()), float(away.max(initial=0.0))
    if length < rule.least_branch or len(away) < 3 or most < rule.apart:
        return None
    window = max(1, min(8, len(away) // 5 if len(away) >= 10 else len(away)))
    near = float(away[:window].min())
    if near > rule.start_apart:
        return None
    growth = most - float(away[0])
    beside = 12.0 if away[0] > rule.apart + 0.75 and growth < 0.35 else 0.0
    return total + 4.0 * min(max(growth, 0.0), 1.5) + min(most, 2.5) + 3.0 * max(0.0, rule.start_apart - near) + 0.05 * min(length, 60.0) - beside


def _region(number, s, t, z, gain, branch_gain, rule: Tracing) -> tuple[list[int], list[int]]:
    """Row numbers of the main way and of the branch, the latter led by the place where it leaves; either may be empty."""
    able = np.flatnonzero(np.isfinite(gain))
    ways = Ways(number[able], s[able], t[able], z[able], gain[able], rule).best(rule.main_ways, rule) if len(able) else []
    if not ways:
        return [], []
    main = able[ways[0]]
    order = np.argsort(s[main], kind="stable")
    beside = t - np.interp(s, s[main][order], t[main][order])
    left = np.flatnonzero(np.isfinite(branch_gain) & (np.abs(beside) >= rule.apart))
    found, best = None, -np.inf
    if len(left):
        tried = Ways(number[left], s[left], t[left], z[left], branch_gain[left], rule)
        for way in tried.best(rule.branch_ways, rule):
            rows = left[way]
            score = branch_score(float(tried.total[way[-1]]), s[rows], beside[rows], rule)
            if score is not None and score > best:
                found, best = rows, score
    if found is None:
        return main.tolist(), []
    before = main[s[main] < s[found[0]] - 1e-6]
    switch = int(before[np.argmax(s[before])]) if len(before) else int(main[np.argmin(np.abs(s[main] - s[found[0]]))])
    return main.tolist(), [switch, *found.tolist()]


def turnouts(candidates: DataFrame, keys: list[str], rule: Tracing | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """keys, role (main, branch), place, slice, s, t, z of the main track and the branch of each region.

    `candidates` hold keys, slice (long), s, t, z, score. A branch starts with the switch, a place of the main track. A region
    without a way of enough slices gives no rows, one without a branch only its main track. `anchors` (keys, role, s, t) are
    places the track passes: between the first and the last of them candidates too far beside are left out, near ones gain.
    Candidates without s, t or score are left out; a null z counts as 0, a null key as a key of its own.
    """
    rule = rule or Tracing()
    numbers = [F.col(c).cast("double").alias(c) for c in ("s", "t")]
    rows = candidates.filter("slice is not null and s is not null and t is not null and score is not null and not isnan(s) and not isnan(t) and not isnan(score)")
    rows = normalised(rows.select(*keys, F.col("slice").cast("long"), *numbers, F.coalesce(F.col("z").cast("double"), F.lit(0.0)).alias("z"), F.col("score").cast("double")), keys, rule.most_candidates)
    gain = F.lit(rule.length_weight) + rule.score_weight * F.col("quality")
    rows = rows.withColumns({"gain": gain, "branch_gain": gain})
    if anchors is not None:
        from ..functions.scalars import anchor_bonus, anchor_far

        for role, name in (("main", "gain"), ("branch", "branch_gain")):
            given = anchors.filter(F.col("role") == role).select(*keys, F.col("s").cast("double"), F.col("t").cast("double").alias("_at"))
            rows = interpolate(rows, given, "s", "s", "_at", keys)
            bonus = F.coalesce(anchor_bonus(F.abs(F.col("t") - F.col("_at")), rule.snap, rule.anchor_weight), F.lit(0.0))
            rows = rows.withColumn(name, F.when(~anchor_far(F.col("t"), F.col("_at"), rule.snap), F.col(name) + bonus)).drop("_at")  # null: left out
    rows = rows.select(*keys, "slice", "s", "t", "z", "gain", "branch_gain", "place")
    key_types = "".join(f"{k} {candidates.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batch, starts):
        number, s, t, z = (np.asarray(batch.column(c)) for c in ("slice", "s", "t", "z"))
        gains, branch_gains = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("gain", "branch_gain"))
        taken, roles, places = [], [], []
        for a, b in zip(starts, starts[1:], strict=False):
            for role, way in zip(("main", "branch"), _region(number[a:b], s[a:b], t[a:b], z[a:b], gains[a:b], branch_gains[a:b], rule), strict=True):
                taken += [a + k for k in way]
                roles += [role] * len(way)
                places += range(len(way))
        out = batch.take(pa.array(taken, pa.int64())).select([*keys, "slice", "s", "t", "z"])
        return out.append_column("role", pa.array(roles, pa.string())).append_column("place", pa.array(places, pa.int32())).select([*keys, "role", "place", "slice", "s", "t", "z"])

    return map_runs(rows, keys, ["slice", "place"], run, f"{key_types}role string, place int, slice long, s double, t double, z double")


def anchored_starts(rows: DataFrame, keys: list[str], rule: Tracing | None = None) -> DataFrame:
    """Smoothed turnouts whose branch starts on the main track: at place 0 of a branch t and z are the main track's at that s,
    where place 1 is no farther from it than allowed."""
    rule = rule or Tracing()
    starts = rows.filter("role = 'branch' and place = 0")
    main = rows.filter("role = 'main'")
    ahead = rows.filter("role = 'branch' and place = 1").select(*keys, F.col("t").alias("_ahead"))
    at = interpolate(starts, main.select(*keys, "s", F.col("t").alias("_t")), "s", "s", "_t", keys, "clamp")
    at = interpolate(at, main.select(*keys, "s", F.col("z").alias("_z")), "s", "s", "_z", keys, "clamp")
    at = at.join(ahead, keys, "left") if keys else at.join(F.broadcast(ahead), F.lit(True), "left")
    near = F.abs(F.coalesce("_ahead", "t") - F.col("_t")) <= rule.anchored
    drawn = at.withColumns({"t": F.when(near, F.col("_t")).otherwise(F.col("t")), "z": F.when(near, F.col("_z")).otherwise(F.col("z"))}).select(rows.columns)
    return rows.filter("not (role = 'branch' and place = 0)").unionByName(drawn)
