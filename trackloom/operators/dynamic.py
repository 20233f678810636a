"""Steps that depend on the ones before: dynamic programmes, greedy matching and tracking. A key's rows are one track, station or
image row, which bounds what meets in a task; short ones are folded as arrays, long ones run in a grouped kernel over Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_groups, map_runs


def best_disjoint_pairs(peaks: DataFrame, keys: list[str], low: float, high: float, target: float) -> DataFrame:
    """Of neighbouring peaks (x, score) of each key the disjoint pairs of the largest total confidence. A pair's confidence is its mean score times how
    near its gap is to the target; gaps outside low..high make none. A fold that carries the best with and without the last peak."""
    listed = peaks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("score").cast("double").alias("score")))).alias("p"))
    pair = "struct<left:double,right:double,gap:double,confidence:double>"
    empty = F.array().cast(f"array<{pair}>")
    state = F.struct(F.lit(0.0).alias("before"), empty.alias("before_pairs"), F.lit(0.0).alias("now"), empty.alias("now_pairs"))

    def step(s, k):
        a, b = F.element_at("p", k), F.element_at("p", k + 1)
        gap = b["x"] - a["x"]
        confidence = 0.5 * (a["score"] + b["score"]) * F.greatest(F.lit(0.0), 1 - F.abs(gap - target) / max(target, 1e-6))
        made = F.struct(a["x"].alias("left"), b["x"].alias("right"), gap.alias("gap"), confidence.alias("confidence"))
        take = gap.between(low, high) & (s["before"] + confidence > s["now"])
        return F.struct(s["now"].alias("before"), s["now_pairs"].alias("before_pairs"), F.when(take, s["before"] + confidence).otherwise(s["now"]).alias("now"), F.when(take, F.array_append(s["before_pairs"], made)).otherwise(s["now_pairs"]).alias("now_pairs"))

    steps = F.when(F.size("p") > 1, F.sequence(F.lit(1), F.size("p") - 1)).otherwise(F.array().cast("array<int>"))
    return listed.select(*keys, F.explode(F.aggregate(steps, state, step, lambda s: s["now_pairs"])).alias("m")).select(*keys, "m.*")


def gauge_pairs(peaks: DataFrame, keys: list[str], gauge: float, tolerance: float, most: int) -> DataFrame:
    """Pairs of peaks (offset, score) about a gauge apart, best first, each peak once, `most` per key. Ties go to the pair farther left."""
    a = peaks.select(*keys, F.col("offset").cast("double").alias("left"), F.col("score").alias("ls"))
    b = peaks.select(*keys, F.col("offset").cast("double").alias("right"), F.col("score").alias("rs"))
    error = F.abs(F.col("right") - F.col("left") - gauge)
    pairs = a.join(b, keys).filter((F.col("right") > F.col("left")) & (error <= tolerance))
    score = F.least("ls", "rs") * F.greatest(F.lit(0.05), 1 - error / max(tolerance, 1e-6))
    item = F.struct((-score.cast("double")).alias("neg"), "left", "right")
    listed = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))
    kept = F.aggregate("all", F.array().cast("array<struct<neg:double,left:double,right:double>>"), lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda y: y["left"].isin(x["left"], x["right"]) | y["right"].isin(x["left"], x["right"])), acc).otherwise(F.array_append(acc, x)))
    return listed.select(*keys, F.explode(kept).alias("p")).select(*keys, ((F.col("p.left") + F.col("p.right")) / 2).alias("center"), (F.col("p.right") - F.col("p.left")).alias("gauge"), (-F.col("p.neg")).alias("score"))


class Linker:
    """Tracks that samples join station by station: each the open track whose prediction is nearest and near enough, else a new one.
    `live` holds each open track's last station, centre and slope; a track too far behind is closed."""

    def __init__(self, max_gap: float, max_offset: float, max_slope: float, made: int = 0):
        self.max_gap, self.max_offset, self.max_slope, self.made = max_gap, max_offset, max_slope, made
        self.live: dict[int, tuple[float, float, float]] = {}

    def close(self, station: float) -> None:
        self.live = {k: v for k, v in self.live.items() if station - v[0] <= self.max_gap}

    def take(self, station: float, centers: list[float]) -> list[int]:
        """Track numbers of the samples of a station, given best first."""
        self.close(station)
        out, used = [], {}
        for center in centers:
            best, cost = None, np.inf
            for k, (s, c, slope) in self.live.items():
                miss = abs(center - c - slope * (station - s))
                if k not in used and miss <= self.max_offset + self.max_slope * (station - s) and miss < cost:
                    best, cost = k, miss
            slope = 0.0
            if best is None:
                self.made += 1
                best = self.made
            else:
                s, c, _ = self.live[best]
                slope = (center - c) / max(station - s, 1e-6)
            used[best] = (station, center, slope)
            out.append(best)
        self.live |= used
        return out


def _tracks(station: np.ndarray, center: np.ndarray, *rule: float) -> list[int]:
    """Track numbers of samples sorted by station, best first."""
    linker, centers, out = Linker(*rule), center.tolist(), []
    cuts = [0, *(1 + np.flatnonzero(np.diff(station))).tolist(), len(station)] if len(station) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        out += linker.take(float(station[a]), centers[a:b])
    return out


def linked_tracks(samples: DataFrame, keys: list[str], max_gap: float, max_offset: float, max_slope: float, least: int, length: float) -> DataFrame:
    """Pair samples (station, center, score) of each key linked to tracks; those with too few samples or too short go."""
    key_types = "".join(f"{k} {samples.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batch, starts):
        station, center = (np.asarray(batch.column(c)) for c in ("station", "center"))
        tracks, kept = [], []
        for a, b in zip(starts, starts[1:], strict=False):
            found = np.array(_tracks(station[a:b], center[a:b], max_gap, max_offset, max_slope))
            order = np.argsort(found, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(found[order]) > 0))
            n, at = np.diff(np.append(first, len(found))), station[a:b][order]
            long = (n >= least) & (at[np.append(first[1:], len(found)) - 1] - at[first] >= length)
            rows = np.sort(order[np.repeat(long, n)])
            kept.append(a + rows)
            tracks.append(found[rows])
        out = batch.take(pa.array(np.concatenate(kept), pa.int64()))
        return out.append_column("track", pa.array(np.concatenate(tracks), pa.int64()))

    rows = samples.select(*keys, F.col("station").cast("double"), F.col("center").cast("double"), F.col("score").cast("double"))
    return map_runs(rows, keys, ["station", F.desc("score"), "center"], run, f"{key_types}station double, center double, score double, track long")


def path(scores: list[np.ndarray], places: list[np.ndarray], null: float = -0.45, switch: float = -0.2, weight: float = 1.0) -> list[int]:
    """The best sequence of candidates, one or none (-1) per step: candidates give their score, a step without one costs `null`, changing between having
    one and not costs `switch`, and moving sideways costs the distance times a weight."""
    best, back = np.zeros(1), []
    last = np.array([np.nan])
    for s, p in zip(scores, places, strict=True):
        here, gain = np.append(p, np.nan), np.append(s, null)
        move = -weight * np.abs(here[:, None] - last[None, :])
        cost = np.where(np.isnan(move), np.where(np.isnan(here)[:, None] == np.isnan(last)[None, :], 0.0, switch if back else 0.0), move)
        total = best[None, :] + cost
        choice = total.argmax(axis=1)
        back.append((choice, len(last)))
        best, last = total[np.arange(len(here)), choice] + gain, here
    out, k = [], int(best.argmax())
    for (choice, _), s in zip(reversed(back), reversed(scores), strict=True):
        out.append(k if k < len(s) else -1)
        k = int(choice[k])
    return out[::-1]


def traced(candidates: DataFrame, keys: list[str], **weights: float) -> DataFrame:
    """One candidate (station, offset, score) per station along the best path of each key; stations where none is best are left out."""
    key_types = "".join(f"{k} {candidates.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batch, starts):
        station, offset, score = (np.asarray(batch.column(c)) for c in ("station", "offset", "score"))
        kept = []
        for a, b in zip(starts, starts[1:], strict=False):
            cuts = [a, *(a + 1 + np.flatnonzero(np.diff(station[a:b]) != 0)).tolist(), b]
            steps = [slice(x, y) for x, y in zip(cuts, cuts[1:], strict=False)]
            chosen = path([score[x] for x in steps], [offset[x] for x in steps], **weights)
            kept += [x.start + k for x, k in zip(steps, chosen, strict=True) if k >= 0]
        return batch.take(pa.array(kept, pa.int64()))

    picked = candidates.select(*keys, F.col("station").cast("double"), F.col("offset").cast("double"), F.col("score").cast("double"))
    return map_runs(picked, keys, ["station", "offset"], run, f"{key_types}station double, offset double, score double")


def _chain(s0: np.ndarray, s1: np.ndarray, max_gap: float, gap_cost: float) -> list[int]:
    """The best chain of segments sorted by their starts."""
    total, back = s1 - s0, np.full(len(s0), -1)
    for i in range(1, len(s0)):
        gap = s0[i] - s1[:i]
        gain = np.where((gap >= 0) & (gap <= max_gap), total[:i] - gap_cost * gap, -np.inf)
        best = int(gain.argmax())
        if gain[best] > 0:
            back[i] = best
            total[i] += gain[best]
    chain, k = [], int(total.argmax())
    while k >= 0:
        chain.append(k)
        k = int(back[k])
    return chain[::-1]


def best_chain(segments: DataFrame, keys: list[str], max_gap: float = 60.0, gap_cost: float = 0.25) -> DataFrame:
    """The chain of segments (segment_id, s0, s1) of each key that maximises length less the gaps' cost; segments of a chain do not overlap."""
    key_types = "".join(f"{k} {segments.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batch, starts):
        s0, s1 = (np.asarray(batch.column(c)) for c in ("s0", "s1"))
        kept, place = [], []
        for a, b in zip(starts, starts[1:], strict=False):
            chain = _chain(s0[a:b], s1[a:b], max_gap, gap_cost)
            kept += [a + k for k in chain]
            place += range(len(chain))
        return batch.take(pa.array(kept, pa.int64())).select([*keys, "segment_id"]).append_column("place", pa.array(place, pa.int32()))

    picked = segments.select(*keys, "segment_id", F.col("s0").cast("double"), F.col("s1").cast("double"))
    return map_runs(picked, keys, ["s0", "s1", "segment_id"], run, f"{key_types}segment_id {segments.schema['segment_id'].dataType.simpleString()}, place int")


def smoothing_matrix(window: int, order: int) -> np.ndarray:
    """Row k: the weights with which a window's least-squares polynomial gives the value at its k-th place (Savitzky and Golay)."""
    powers = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    return powers @ np.linalg.pinv(powers)


def savgol(values: np.ndarray, window: int, order: int) -> np.ndarray:
    """Smoothed values; the ends come from the polynomials of the first and last windows."""
    if len(values) < window or window < 3:
        return values.astype(float)
    m, half = smoothing_matrix(window, min(order, window - 1)), window // 2
    out = np.convolve(values, m[half][::-1], mode="same")
    out[:half], out[-half:] = (m @ values[:window])[:half], (m @ values[-window:])[-half:]
    return out


def smoothed(rows: DataFrame, keys: list[str], order: str, value: str, window: int, degree: int, output: str = "smooth") -> DataFrame:
    """Savitzky-Golay smoothing of each key's rows."""
    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in rows.schema.fields if f.name != output), T.StructField(output, T.DoubleType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(order)
        size = window if len(g) >= window else (len(g) if len(g) % 2 else len(g) - 1)
        return g.assign(**{output: savgol(g[value].to_numpy(float), size, degree)})[[f.name for f in schema.fields]]

    return map_groups(rows.groupBy(*keys), run, schema, rows.sparkSession)


def prominences(scores: np.ndarray) -> np.ndarray:
    """Of each local maximum, its height over the higher of the lowest points on the ways to higher ground; 0 elsewhere."""
    out = np.zeros(len(scores))
    for k in range(1, len(scores) - 1):
        if scores[k] > scores[k - 1] and scores[k] >= scores[k + 1]:
            left, right = scores[:k][::-1], scores[k + 1 :]
            base = [side[: int(np.argmax(side > scores[k]))].min(initial=scores[k]) if (side > scores[k]).any() else side.min(initial=scores[k]) for side in (left, right)]
            out[k] = scores[k] - max(base)
    return out


def greedy_matches(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (left, right, score) taken best first, each end once."""
    picked = pairs.select(*keys, "left", "right", "score")

    def run(batch, starts):
        left, right, kept = batch.column("left").to_pylist(), batch.column("right").to_pylist(), []
        for a, b in zip(starts, starts[1:], strict=False):
            lefts, rights = set(), set()
            for k in range(a, b):
                if left[k] not in lefts and right[k] not in rights:
                    lefts.add(left[k])
                    rights.add(right[k])
                    kept.append(k)
        return batch.take(pa.array(kept, pa.int64()))

    return map_runs(picked, keys, [F.desc("score"), "left", "right"], run, picked.schema)
