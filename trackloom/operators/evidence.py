"""Bands, transitions and connectors: how evidence across tracks is grouped, thinned, scored and fitted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, smoothstep
from ..shipping import map_groups
from ..storage import stored
from .graph import labelled
from .ranges import cells, interpolate
from .sequences import islands, runs


def band_clusters(peaks: DataFrame, keys: list[str], gap: float, most: int) -> DataFrame:
    """Offsets (offset, count) of each key in bands: sorted, cut where the next lies more than a gap from the running median; then the two bands whose
    medians are nearest merge until at most `most` are left. Adds band (from 0, by offset)."""
    kinds = ", ".join(f"{k} {peaks.schema[k].dataType.simpleString()}" for k in keys)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["offset", "count"]).reset_index(drop=True)
        bands: list[list[int]] = []
        for k, o in enumerate(g["offset"]):
            if bands and o - np.median(g["offset"].to_numpy()[bands[-1]]) <= gap:
                bands[-1].append(k)
            else:
                bands.append([k])
        centre = lambda b: float(np.median(g["offset"].to_numpy()[b]))
        while len(bands) > most:
            k = int(np.argmin(np.diff([centre(b) for b in bands])))
            bands[k : k + 2] = [bands[k] + bands[k + 1]]
        band = np.zeros(len(g), np.int32)
        for k, b in enumerate(bands):
            band[b] = k
        return g.assign(band=band)[[*keys, "offset", "count", "band"]]

    picked = peaks.select(*keys, F.col("offset").cast("double"), F.col("count").cast("long"))
    return map_groups(picked.groupBy(*keys), run, f"{kinds}, offset double, count long, band int", peaks.sparkSession)


def transitions(points: DataFrame, keys: list[str], low: float, high: float, gap: float, least: int = 4) -> DataFrame:
    """Where evidence (station, offset) crosses from one band centre to another: islands of points strictly between, with their chord."""
    between = points.filter((F.col("offset") > low) & (F.col("offset") < high))
    rows = islands(between, keys, "station", gap)
    out = rows.groupBy(*keys, "island").agg(F.min("station").alias("s0"), F.max("station").alias("s1"), F.min_by("offset", "station").alias("t0"), F.max_by("offset", "station").alias("t1"), F.count("*").alias("n"), F.regr_slope("offset", "station").alias("slope"))
    return out.filter(F.col("n") >= least).drop("island")


def one_per_start(found: DataFrame, keys: list[str], near: float = 6.0) -> DataFrame:
    """Transitions (s0, n) that start within `near` of each other are one: the one of more points, then the earlier. Best first, each drops those near it."""
    from .sequences import suppressed

    kept = suppressed(found.withColumn("_n", F.col("n").cast("double")), keys, "s0", "_n", near).select(*keys, "s0")
    w = Window.partitionBy(*keys, "s0").orderBy(F.desc("n"))
    return found.join(kept, [*keys, "s0"], "left_semi").withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def distinct_evidence(found: DataFrame, pair: str, station_share: float = 0.55, offset_share: float = 0.50) -> DataFrame:
    """Evidence (evidence_id, s0, s1, t0, t1, score) of a pair, best first: what overlaps one that was taken, by both shares of the shorter, goes."""
    schema = found.select(pair, "evidence_id", "s0", "s1", "t0", "t1", "score").schema

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.assign(_span=group["s1"] - group["s0"]).sort_values(["score", "_span", "evidence_id"], ascending=[False, False, True]).drop(columns="_span")
        taken: list = []
        for r in g.itertuples(index=False):
            def share(a0, a1, b0, b1):
                return max(0.0, min(a1, b1) - max(a0, b0)) / max(min(a1 - a0, b1 - b0), 1e-9)

            if not any(share(r.s0, r.s1, q.s0, q.s1) >= station_share and share(min(r.t0, r.t1), max(r.t0, r.t1), min(q.t0, q.t1), max(q.t0, q.t1)) >= offset_share for q in taken):
                taken.append(r)
        return pd.DataFrame(taken, columns=g.columns)

    return map_groups(found.select(*schema.names).groupBy(pair), run, schema, found.sparkSession)


def spaced(rows: DataFrame, keys: list[str], distance: str, length: Column, tolerance: float) -> DataFrame:
    """Distances along a line, each more than a tolerance after the one kept before; 0 and the length always present."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(distance).cast("double"))).alias("all"), F.first(length).cast("double").alias("_l"))
    start = F.array(F.lit(0.0))
    kept = F.aggregate("all", start, lambda acc, x: F.when((x - F.element_at(acc, -1) > tolerance) & (F.col("_l") - x > tolerance), F.array_append(acc, x)).otherwise(acc))
    return listed.select(*keys, F.explode(F.concat(kept, F.array("_l"))).alias(distance))


def review_targets(points: DataFrame, priority: str, s: str, apart: float, most: int) -> DataFrame:
    """Targets (id, priority: lower first, s) at least `apart` along the line from those taken before, `most` in all. A top-k report: the fold sees one
    row per cell of half the distance, the best of it, so it does not grow with the points."""
    cell = F.floor(F.col(s) / (apart / 2))
    best = points.groupBy(cell.alias("_cell")).agg(F.min(F.struct(F.col(priority).alias("p"), F.col(s).cast("double").alias("s"), "id")).alias("b"))
    listed = best.agg(F.array_sort(F.collect_list("b")).alias("all"))
    kind = best.schema["b"].dataType.simpleString()
    taken = F.aggregate("all", F.array().cast(f"array<{kind}>"), lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda y: F.abs(y["s"] - x["s"]) < apart), acc).otherwise(F.array_append(acc, x)))
    return listed.select(F.explode(taken).alias("b")).select("b.id", F.col("b.p").alias(priority), F.col("b.s").alias(s))


def workzones(boxes: DataFrame, size: float) -> DataFrame:
    """Boxes (box_id, x0, y0, x1, y1) that overlap, directly or through others, as one rectangle around all."""
    a = boxes.withColumn("_x", F.explode(cells(F.col("x0"), F.col("x1"), size))).withColumn("_y", F.explode(cells(F.col("y0"), F.col("y1"), size)))
    b = a.select(*(F.col(c).alias(f"o_{c}") for c in boxes.columns), "_x", "_y")
    met = a.join(b, ["_x", "_y"]).filter((F.col("box_id") < F.col("o_box_id")) & (F.col("x0") <= F.col("o_x1")) & (F.col("o_x0") <= F.col("x1")) & (F.col("y0") <= F.col("o_y1")) & (F.col("o_y0") <= F.col("y1")))
    rows = labelled(boxes, met.select(F.col("box_id").alias("a"), F.col("o_box_id").alias("b")).distinct(), "box_id")
    return rows.groupBy("component").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


def support_score(rows: DataFrame, keys: list[str], near: Column, inner: Column, confidence: Column, distance: Column, reach: float) -> DataFrame:
    """Score of a connector's samples: .45 of the share near evidence, .45 of that share inside the transition, .15 of the mean confidence, less .15 of the mean
    distance over the reach."""
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    out = rows.groupBy(*keys).agg(share(near).alias("coverage"), share(F.when(inner, near)).alias("transition"), F.coalesce(F.avg(confidence), F.lit(0.0)).alias("confidence"), F.coalesce(F.avg(distance), F.lit(float(reach))).alias("distance"))
    return out.withColumn("score", 0.45 * F.col("coverage") + 0.45 * F.col("transition") + 0.15 * F.col("confidence") - 0.15 * clamp(F.col("distance") / reach, 0.0, 1.0))


def crossover(ends: DataFrame, evidence: DataFrame, many: int, reach: float, most: float = 0.88, taper: float = 0.15) -> DataFrame:
    """A crossover (line_id, s0, s1, t0, t1): a smoothstep drawn towards its evidence (line_id, station, offset, confidence), weighted by confidence and nearness,
    by at most `most` and less near its ends."""
    from .curves import eased

    base = eased(ends, many).select("line_id", "k", "u", "station", "offset")
    e = evidence.select("line_id", F.col("station").alias("es"), F.col("offset").alias("et"), "confidence")
    near = base.withColumn("_c", F.floor(F.col("station") / reach)).join(e.withColumn("_c", F.explode(cells(F.col("es") - reach, F.col("es") + reach, reach))), ["line_id", "_c"])
    weight = F.greatest("confidence", F.lit(0.05)) * (1 - F.abs(F.col("es") - F.col("station")) / reach)
    pull = near.filter(F.abs(F.col("es") - F.col("station")) < reach).groupBy("line_id", "k").agg((F.sum(weight * F.col("et")) / F.sum(weight)).alias("et"), F.sum(weight).alias("w"))
    share = F.least(F.col("w"), F.lit(most)) * smoothstep(F.least(F.col("u"), 1 - F.col("u")) / taper)
    return base.join(pull, ["line_id", "k"], "left").select("line_id", "k", "station", F.coalesce(F.col("offset") + share * (F.col("et") - F.col("offset")), "offset").alias("offset"))


def best_parameters(curves: DataFrame, keys: list[str], parameter: str, guard: Column, penalty: Column) -> DataFrame:
    """Of the same curve drawn with several parameters (samples with columns for guard and penalty) the parameter of the least total penalty among those all of
    whose samples pass the guard; the smaller one of equals."""
    tried = curves.groupBy(*keys, parameter).agg(F.min(guard.cast("int")).alias("ok"), F.sum(penalty).alias("penalty")).filter("ok = 1")
    return tried.groupBy(*keys).agg(F.min(F.struct("penalty", parameter)).alias("b")).select(*keys, F.col(f"b.{parameter}").alias(parameter), F.col("b.penalty").alias("penalty"))


def limited_turns(vertices: DataFrame, keys: list[str], order: str, degrees: float, rounds: int = 12) -> DataFrame:
    """Vertices moved half-way to the middle of their neighbours, all at once and again, as long as they turn by more than an angle; ends stay."""
    schema = vertices.select(*keys, order, "x", "y").schema

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(order)
        p = g[["x", "y"]].to_numpy(float)
        for _ in range(rounds if len(p) > 2 else 0):
            a, b = p[1:-1] - p[:-2], p[2:] - p[1:-1]
            size = np.hypot(*a.T) * np.hypot(*b.T)
            turn = np.degrees(np.arccos(np.clip((a * b).sum(axis=1) / np.maximum(size, 1e-12), -1, 1)))
            sharp = (turn > degrees) & (size > 0)
            if not sharp.any():
                break
            middle = (p[:-2] + p[2:]) / 2
            p[1:-1][sharp] = (p[1:-1][sharp] + middle[sharp]) / 2
        return g.assign(x=p[:, 0], y=p[:, 1])[schema.names]

    return map_groups(vertices.select(*schema.names).groupBy(*keys), run, schema, vertices.sparkSession)


def partner(profile: DataFrame, keys: list[str], at: str, value: str, gauge: float, tolerance: float) -> DataFrame:
    """Of a rail's outside profile (at, value) the place of the largest value within a tolerance of the gauge; the nearer of equals."""
    near = profile.filter(F.abs(F.col(at) - gauge) <= tolerance)
    return near.groupBy(*keys).agg(F.max_by(F.col(at), F.struct(F.col(value).alias("v"), (-F.abs(F.col(at) - gauge)).alias("d"), (-F.col(at)).alias("a"))).alias(at), F.max(value).alias(value))


def mirrored_templates(template: DataFrame, ends: DataFrame) -> DataFrame:
    """A template (k, u, v in its own frame) at each end (line_id, s, t, direction, side): all roles and sides are rows."""
    return ends.crossJoin(F.broadcast(template)).withColumns({"station": F.col("s") + F.col("direction") * F.col("u"), "offset": F.col("t") + F.col("side") * F.col("v")})


def kinds_along(samples: DataFrame, keys: list[str], order: str, kind: str) -> DataFrame:
    """Runs of one kind of support: start, end, n."""
    return runs(samples, keys, order, F.col(kind)).groupBy(*keys, "run").agg(F.first(kind).alias(kind), F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("run")


def arc_probe(curve: DataFrame, arc: DataFrame, keys: list[str], s0: Column, s1: Column) -> DataFrame:
    """A curve (station, offset) whose part between two stations is replaced by an arc; with how far each sample moved."""
    both = interpolate(curve, arc.withColumnRenamed("offset", "arc_offset"), "station", "station", "arc_offset", keys)
    inside = F.col("station").between(s0, s1) & F.col("arc_offset").isNotNull()
    return both.withColumn("moved", F.when(inside, F.col("arc_offset") - F.col("offset")).otherwise(F.lit(0.0))).withColumn("offset", F.when(inside, F.col("arc_offset")).otherwise(F.col("offset"))).drop("arc_offset")


def constrained(candidates: DataFrame, gauges: DataFrame, keys: list[str], longest: float = 45.0, shift: float = 1.2, step: float = 1.0) -> DataFrame:
    """Candidates (keys, s, t) rebuilt along the gauge centreline (keys, s, t) that was matched to them: keys, place, s, t, kind.

    Between the ends of the gauge line its own vertices stand. Where the candidate begins before it or ends after it, by no more than `longest`, a
    stub of `step` metres eases over to the candidate's end (kind prefix, suffix). A suffix that has to move sideways by more than `shift` does so early,
    as evidence that ends before the tangent gives no reason for a line beside the main track, and the whole line is then evened out
    (kind smoothed). A key with fewer than two vertices on either side keeps its candidate (kind candidate). Defaults are fixed values.
    """
    ends = lambda df, a: df.groupBy(*keys).agg(F.count("*").alias(f"{a}n"), F.min(F.struct("s", "t")).alias(f"{a}0"), F.max(F.struct("s", F.struct((-F.col("t")).alias("m"), "t").alias("o"))).alias(f"{a}1"))
    both = ends(candidates, "c").join(ends(gauges, "g"), keys).filter("cn > 1 and gn > 1")
    c0, g0, c1, g1 = F.col("c0"), F.col("g0"), F.struct(F.col("c1.s").alias("s"), F.col("c1.o.t").alias("t")), F.struct(F.col("g1.s").alias("s"), F.col("g1.o.t").alias("t"))
    both = both.select(*keys, c0.alias("c0"), g0.alias("g0"), c1.alias("c1"), g1.alias("g1"))
    before, after = F.col("g0.s") - F.col("c0.s"), F.col("c1.s") - F.col("g1.s")
    early = F.abs(F.col("c1.t") - F.col("g1.t")) > shift
    both = both.withColumns({"_pre": (before > 0) & (before <= longest), "_post": (after > 0) & (after <= longest)}).withColumn("_early", F.col("_post") & early)
    both = stored(both, "ends")  # read five times below

    def stub(a, b, power, kind):
        many = F.greatest(F.lit(2), F.ceil(F.abs(b["s"] - a["s"]) / max(step, 0.1)).cast("int") + 1)

        def at(k):
            u = k / (many - 1)
            d = F.pow(u, power)
            return F.struct((a["s"] + (b["s"] - a["s"]) * u).alias("s"), (a["t"] + (b["t"] - a["t"]) * d * d * (3 - 2 * d)).alias("t"), F.lit(kind).alias("kind"))

        return F.transform(F.sequence(F.lit(0), many - 1), at)

    own = gauges.join(both.select(*keys, "_early"), keys).select(*keys, "s", "t", F.lit("gauge").alias("kind"), F.lit(1).alias("_rank"), "_early")
    pre = both.filter("_pre").select(*keys, "_early", F.explode(stub(F.col("c0"), F.col("g0"), F.lit(1.0), "prefix")).alias("p"))
    post = both.filter("_post").select(*keys, "_early", F.explode(stub(F.col("g1"), F.col("c1"), F.when(F.col("_early"), 0.35).otherwise(1.0), "suffix")).alias("p"))
    rows = own
    for stubs, rank in ((pre, 0), (post, 0)):  # where a stub meets the gauge line, the gauge's own vertex stands
        rows = rows.unionByName(stubs.select(*keys, "p.s", "p.t", "p.kind", F.lit(rank).alias("_rank"), "_early"))
    # Of vertices nearer than a micrometre the last stands; the gauge's rank puts it last.
    w = Window.partitionBy(*keys).orderBy("s", "_rank", "t")
    rows = rows.withColumn("_next", F.lead("s").over(w)).filter(F.col("_next").isNull() | (F.col("_next") - F.col("s") >= 1e-6)).drop("_next")
    rows = stored(rows, "rebuilt")  # read four times below
    even = evened(rows.filter("_early"), keys).withColumn("kind", F.lit("smoothed"))
    kept = candidates.join(both.select(*keys), keys, "left_anti").select(*keys, "s", "t", F.lit("candidate").alias("kind"))
    out = rows.filter("not _early").select(*keys, "s", "t", "kind").unionByName(even.select(*keys, "s", "t", "kind")).unionByName(kept)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("s", "t")) - 1)


def evened(rows: DataFrame, keys: list[str], step: float = 0.75, window: int = 5, passes: int = 4) -> DataFrame:
    """Lines (keys, s, t) at even stations, smoothed by a moving mean `passes` times; the two places at either end stay. Lines of fewer than five vertices are left as they are."""
    from .ranges import interpolate

    ends = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("s").alias("_a"), F.max("s").alias("_b"))
    long = ends.filter("_n >= 5 and _b > _a")
    many = F.greatest(F.lit(5), F.ceil((F.col("_b") - F.col("_a")) / max(step, 0.1)).cast("int") + 1)
    grid = long.withColumn("_m", many).select(*keys, "_m", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("_m") - 1), lambda k: F.col("_a") + (F.col("_b") - F.col("_a")) * k / (F.col("_m") - 1))).alias("_k", "s"))
    out = interpolate(grid, rows.select(*keys, F.col("s").alias("_at"), "t"), "s", "_at", "t", keys, "clamp")
    half = max(1, window // 2)
    w = Window.partitionBy(*keys).orderBy("_k").rowsBetween(-half, half)
    locked = (F.col("_k") < 2) | (F.col("_k") > F.col("_m") - 3)
    for _ in range(passes):
        out = out.withColumn("_t", F.avg("t").over(w)).withColumn("t", F.when(locked, F.col("t")).otherwise(F.col("_t"))).drop("_t")
    short = rows.join(long.select(*keys), keys, "left_anti")
    return out.select(*keys, "s", "t").unionByName(short.select(*keys, "s", "t"))
