"""A point cloud by its settings: guided paths, turnouts, several tracks or one, whichever the settings name first.

Settings name regions. Points are dealt to the regions that hold them in one pass, all regions go through one plan keyed by region, and each has its own frame: given by
an oriented region or a guiding path, else estimated from its points. Regions are parameters; their frames are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Frame
from ..operators import aggregates, dynamic, filters, frames, graph, turnouts
from ..operators.quantiles import exact_quantiles
from ..sources.readers import merged_config
from .centreline import Config, detections
from .turnouts import pair_candidates

#: Fixed values.
DEFAULTS = {
    "roi": {}, "oriented_roi": None, "tracks": [], "turnout": {"enabled": False}, "guided_paths": {"enabled": False, "tracks": [], "turnouts": [], "default_corridor_width": 5.0, "longitudinal_margin": 3.0},
    "manual_anchor": {"snap_distance": 2.5, "score_weight": 14.0}, "guided_anchor": {"snap_distance": 1.4, "score_weight": 24.0},
    "advanced_las": {"enabled": True, "ground_cell_size": 1.0, "ground_percentile": 0.1, "rail_height_min": 0.05, "rail_height_max": 0.22, "intensity_quantile_max": 0.5, "occupancy_threshold": 6, "component_cell_size": 1.0, "min_component_points": 5000, "corridor_quantile_low": 0.02, "corridor_quantile_high": 0.98, "corridor_margin": 1.5},
}
LEAST_WIDTH, LEAST_HALF = 2.4, 1.2


@dataclass
class Region:
    """Where a track or turnout is looked for, and what guides it."""

    name: str
    kind: str  # track, guided or turnout
    bounds: dict = field(default_factory=dict)
    frame: Frame | None = None
    box: dict = field(default_factory=dict)
    anchors: list[tuple[str, float, float]] = field(default_factory=list)

    def holds(self):
        x, y, z = F.col("x"), F.col("y"), F.col("z")
        ok = F.lit(True)
        at = dict(zip("xyz", (x, y, z), strict=True))
        if self.frame:
            s, t, _ = self.frame.local(x, y, z)
            at |= {"s": s, "t": t}
        for name, value in {**self.bounds, **self.box}.items():
            axis, side = name[0], name[2:]
            if value is not None and axis in at and side in ("min", "max"):
                ok &= (at[axis] >= float(value)) if side == "min" else (at[axis] <= float(value))
        return ok


def mode_of(config: dict) -> str:
    """guided_paths, turnout, multi_track or single, by what the settings name first."""
    guided = config.get("guided_paths") or {}
    if guided.get("enabled") and any(x.get("enabled", True) for x in (*(guided.get("tracks") or []), *(guided.get("turnouts") or []))):
        return "guided_paths"
    if (config.get("turnout") or {}).get("enabled"):
        return "turnout"
    return "multi_track" if any(t.get("enabled", True) for t in config.get("tracks") or []) else "single"


def use_corridor(config: dict, source_format: str, has_intensity: bool) -> bool:
    """Whether the corridor of laser points is looked for: switched on, with intensities, from LAS files."""
    return bool((config.get("advanced_las") or {}).get("enabled", True)) and has_intensity and any(x in source_format.lower() for x in (".las", ".laz"))


def _path(points) -> np.ndarray:
    xy = np.array([[float(p["x"]), float(p["y"])] if isinstance(p, dict) else [float(p[0]), float(p[1])] for p in points or []])
    if len(xy) < 2:
        raise ValueError("a guiding path has two points or more")
    return xy


def guided_frame(axis: np.ndarray) -> Frame:
    """The frame along a path's chord, or along its spread where it ends where it began."""
    centre, chord = axis.mean(axis=0), axis[-1] - axis[0]
    if np.linalg.norm(chord) <= 1e-6:
        spread, axes = np.linalg.eigh(np.cov((axis - centre).T, bias=True))
        if spread[-1] <= 1e-12:
            raise ValueError("the points of a guiding path are too near each other")
        chord = axes[:, -1]
    return Frame(*map(float, centre), 0.0, *map(float, chord))


def _guided(name: str, kind: str, item: dict, guided: dict, bounds: dict, paths: dict[str, np.ndarray]) -> Region:
    frame = guided_frame(paths["main"])
    local = lambda xy: np.column_stack([(xy - [frame.ox, frame.oy]) @ [frame.ux, frame.uy], (xy - [frame.ox, frame.oy]) @ [-frame.uy, frame.ux]])
    every = local(np.vstack(list(paths.values())))
    width = max(float(item.get("corridor_width", guided["default_corridor_width"])), float(item.get("min_corridor_width", LEAST_WIDTH)))
    half, margin = max(width / 2, LEAST_HALF), max(0.0, float(item.get("longitudinal_margin", guided["longitudinal_margin"])))
    (s0, t0), (s1, t1) = every.min(axis=0), every.max(axis=0)
    box = {"s_min": s0 - margin, "s_max": s1 + margin, "t_min": t0 - half, "t_max": t1 + half}
    anchors = [(role, float(s), float(t)) for role, xy in paths.items() for s, t in local(xy)]
    return Region(name, kind, merged_config(bounds, item.get("roi") or {}), frame, box, anchors)


def _oriented(given: dict | None) -> tuple[Frame | None, dict]:
    if not given or given.get("enabled") is False or given.get("origin") is None or given.get("axis_s") is None:
        return None, {}
    box = {k: v for k, v in given.items() if k[1:] in ("_min", "_max") and v is not None}
    if not box:
        return None, {}
    return Frame(float(given["origin"][0]), float(given["origin"][1]), 0.0, float(given["axis_s"][0]), float(given["axis_s"][1])), box


def regions(config: dict) -> list[Region]:
    """The regions that the settings name, in their order. Names are ids; a guided turnout's is its id after 'turnout '."""
    mode, bounds = mode_of(config), config["roi"] or {}
    if mode == "guided_paths":
        guided = merged_config(DEFAULTS["guided_paths"], config["guided_paths"])
        on = lambda kind: [(k, x) for k, x in enumerate(guided[kind] or [], 1) if x.get("enabled", True)]
        out = [_guided(str(x.get("id") or k), "guided", x, guided, bounds, {"main": _path(x.get("points"))}) for k, x in on("tracks")]
        out += [_guided(f"turnout {x.get('id') or k}", "turnout", x, guided, bounds, {"main": _path(x.get("main_points")), "branch": _path(x.get("branch_points"))}) for k, x in on("turnouts")]
    else:
        items = [config["turnout"]] if mode == "turnout" else [t for t in config["tracks"] if t.get("enabled", True)] if mode == "multi_track" else [{"oriented_roi": config["oriented_roi"]}]
        out = [Region(f"turnout {x.get('id') or k}" if mode == "turnout" else str(x.get("id") or k), "turnout" if mode == "turnout" else "track", merged_config(bounds, x.get("roi") or {}), *_oriented(x.get("oriented_roi"))) for k, x in enumerate(items, 1)]
    if len({r.name for r in out}) < len(out):
        raise ValueError("two regions have one id")
    return out


def laser_corridor(points: DataFrame, config: dict) -> DataFrame:
    """Points beside the largest component of rail-like ones: height above ground in a band and low intensity, in cells that hold enough of them. All points where
    no component is large enough."""
    a = config["advanced_las"]
    rail = filters.above_ground(points, a["ground_cell_size"], a["rail_height_min"], a["rail_height_max"], a["ground_percentile"], a["intensity_quantile_max"])
    size = a["component_cell_size"]
    cells = rail.withColumns({"cx": F.floor(F.col("x") / size).cast("long"), "cy": F.floor(F.col("y") / size).cast("long")})
    found = graph.grid_components(cells.groupBy("cx", "cy").agg(F.count("*").alias("n")), a["occupancy_threshold"])
    best = found.groupBy("component").agg(F.sum("n").alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"), F.max("n").alias("n")).first()
    if best is None or best["n"] is None or best["n"] < a["min_component_points"]:
        return points
    own = cells.join(found.filter(F.col("component") == best["component"]).select("cx", "cy"), ["cx", "cy"], "left_semi")
    frame = frames.pca_frame(own)
    low, high = exact_quantiles(frames.to_local(own, frame), "t", [a["corridor_quantile_low"], a["corridor_quantile_high"]])
    _, t, _ = frame.local(F.col("x"), F.col("y"), F.col("z"))
    return points.filter(t.between(low - a["corridor_margin"], high + a["corridor_margin"]))


def analyse(points: DataFrame, config: dict, detection: Config | None = None, source_format: str = "", rule: turnouts.Tracing | None = None) -> DataFrame:
    """mode, region, role, place, s, t, z, x, y of the centrelines that the settings ask for. points: x, y, z and perhaps intensity.

    A guided path or turnout follows its anchors; a region in which nothing is found gives no rows (see `report`).
    """
    config, detection = merged_config(DEFAULTS, config), detection or Config()
    rule, mode, found = rule or turnouts.Tracing(slice_length=detection.slice_length), mode_of(config), regions(config)
    spark = points.sparkSession
    if mode == "single" and use_corridor(config, source_format, "intensity" in points.columns):
        points = laser_corridor(points, config)
    names = F.filter(F.array(*(F.when(r.holds(), F.lit(r.name)) for r in found)), lambda x: x.isNotNull())
    dealt = points.select("x", "y", "z", F.explode(names).alias("track"))
    known = {r.name: r.frame for r in found}
    if None in known.values():
        for r in frames.pca_axes(dealt.filter(F.col("track").isin([n for n, f in known.items() if f is None])), "track").collect():  # one row a region
            known[r["track"]] = Frame(r["ox"], r["oy"], r["oz"], float(np.cos(r["angle"])), float(np.sin(r["angle"])))
    rows = [(n, f.ox, f.oy, f.oz, f.ux, f.uy) for n, f in known.items() if f]
    placed = F.broadcast(spark.createDataFrame(rows, "track string, _ox double, _oy double, _oz double, _ux double, _uy double"))
    dx, dy = F.col("x") - F.col("_ox"), F.col("y") - F.col("_oy")
    local = dealt.join(placed, "track").select("track", (dx * F.col("_ux") + dy * F.col("_uy")).alias("s"), (dy * F.col("_ux") - dx * F.col("_uy")).alias("t"), (F.col("z") - F.col("_oz")).alias("z"))
    plain, traced = [r.name for r in found if r.kind == "track"], [r for r in found if r.kind != "track"]
    parts = []
    if plain:
        one = filters.without_outliers(detections(local.filter(F.col("track").isin(plain)), detection), ["track"])
        parts.append(one.select("track", F.lit("main").alias("role"), F.col("slice").alias("place"), "s", "t", "z"))
    if traced:
        anchors = [(r.name, *a) for r in traced for a in r.anchors]
        if anchors:
            rule = replace(rule, snap=config["guided_anchor"]["snap_distance"], anchor_weight=config["guided_anchor"]["score_weight"])
        given = spark.createDataFrame(anchors, "track string, role string, s double, t double") if anchors else None
        ways = turnouts.turnouts(pair_candidates(local.filter(F.col("track").isin([r.name for r in traced])), detection), ["track"], rule, given)
        guided = [r.name for r in traced if r.kind == "guided"]
        parts.append(ways.filter(~F.col("track").isin(guided) | (F.col("role") == "main")).select("track", "role", F.col("place").cast("long"), "s", "t", "z"))
    lines = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if detection.lateral == "smooth":
        lines = dynamic.smoothed(lines, ["track", "role"], "place", "t", detection.smooth_window, 2, "_t").withColumn("t", F.col("_t")).drop("_t")
    elif detection.lateral == "straight":
        fit = aggregates.robust_fit(lines.select("track", "role", F.col("s").alias("station"), F.col("t").alias("offset")), ["track", "role"]).select("track", "role", "slope", "intercept")
        lines = lines.join(fit, ["track", "role"]).withColumn("t", F.col("intercept") + F.col("slope") * F.col("s")).drop("slope", "intercept")
    if any(r.kind == "turnout" for r in traced):
        lines = turnouts.anchored_starts(lines, ["track"], rule)
    out = lines.join(placed, "track")
    x, y = F.col("s") * F.col("_ux") - F.col("t") * F.col("_uy") + F.col("_ox"), F.col("s") * F.col("_uy") + F.col("t") * F.col("_ux") + F.col("_oy")
    return out.select(F.lit(mode).alias("mode"), F.col("track").alias("region"), "role", "place", "s", "t", (F.col("z") + F.col("_oz")).alias("z"), x.alias("x"), y.alias("y"))


def report(lines: DataFrame, config: dict) -> DataFrame:
    """region, kind, role, n, length of every region that the settings name; n is 0 where nothing was found."""
    named = [(r.name, r.kind) for r in regions(merged_config(DEFAULTS, config))]
    got = lines.groupBy("region", "role").agg(F.count("*").alias("n"), (F.max("s") - F.min("s")).alias("length"))
    return lines.sparkSession.createDataFrame(named, "region string, kind string").join(got, "region", "left").fillna(0, ["n"])
