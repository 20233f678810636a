"""Column functions for numbers, angles, text and properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def finite(x: Column, default=None) -> Column:
    """x as double; the default where it does not parse, is NaN or is infinite."""
    v = x.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default).cast("double")).otherwise(F.coalesce(v, F.lit(default).cast("double")))


def whole(x: Column, default=None) -> Column:
    """x as a whole number, cut towards zero; the default where it is none."""
    return finite(x, default).cast("long")


def ratio(part: Column, total: Column) -> Column:
    """0 where the total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(part / total)


def fixed(x: Column, digits: int) -> Column:
    """Rounded half to even."""
    return F.bround(x, digits)


def trimmed(x: Column, digits: int = 6) -> Column:
    """Decimal text without trailing zeros."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", x), r"\.?0+$", "")


def sigmoid(x: Column, limit: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -limit, limit)))


def smoothstep(x: Column) -> Column:
    u = clamp(x, 0.0, 1.0)
    return u * u * (3 - 2 * u)


def threshold_byte(t: Column) -> Column:
    """A share as a byte, rounded up, so that a pixel at the threshold is in."""
    return F.ceil(clamp(t, 0.0, 1.0) * 255).cast("int")


def byte_scale(x: Column, low: Column, high: Column) -> Column:
    return F.when(high <= low, F.lit(0)).otherwise(F.bround(clamp((x - low) / (high - low), 0.0, 1.0) * 255)).cast("int")


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two directions; 0 if one has no length."""
    size = F.hypot(ax, ay) * F.hypot(bx, by)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.degrees(F.acos(clamp((ax * bx + ay * by) / size, -1.0, 1.0))))


def axis_angle(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Degrees between two axes, whose sign does not matter."""
    size = F.hypot(ux, uy) * F.hypot(vx, vy)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.degrees(F.acos(clamp(F.abs(ux * vx + uy * vy) / size, 0.0, 1.0))))


def node_key(x: Column, y: Column, tolerance: float) -> Column:
    return F.struct(F.bround(x / tolerance).cast("long").alias("kx"), F.bround(y / tolerance).cast("long").alias("ky"))


def first_text(*names: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(n.cast("string")) != "", F.trim(n.cast("string"))) for n in names))


def stable_id(position: Column, *names: Column) -> Column:
    """The first id that is set, else feature_<position>."""
    return F.coalesce(first_text(*names), F.concat(F.lit("feature_"), position.cast("string")))


def numbered(prefix: str, k: Column, width: int = 3) -> Column:
    return F.concat(F.lit(prefix), F.lpad(k.cast("string"), width, "0"))


def file_safe(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"[^A-Za-z0-9._-]+", "_")


def path_key(path: Column) -> Column:
    """Base name in lower case, whatever the separators."""
    return F.substring_index(F.translate(F.lower(path), "\\", "/"), "/", -1)


def natural_key(name: Column, width: int = 12) -> Column:
    """Sorts numbers inside names by value."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p)), "")


def interval_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over the shorter interval."""
    return interval_overlap(a0, a1, b0, b1) / F.greatest(F.least(a1 - a0, b1 - b0), F.lit(1e-9))


def json_safe(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def property_of(props: Column, *names: str) -> Column:
    """The first property of these names that is set."""
    return F.coalesce(*(F.when(F.try_element_at(props, F.lit(n)) != "", F.try_element_at(props, F.lit(n))) for n in names))


def merged(base: Column, extra: Column) -> Column:
    """Two property maps; the second wins."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(extra), k)), extra)


# Classes by radius in metres, and the quality of the ways a pair of rails was found.
RADIUS_CLASSES = ((120.0, "sharp_or_noisy"), (260.0, "tight_curve"), (520.0, "turnout_curve_range"), (2500.0, "large_radius_curve"))
RADIUS_STRAIGHT = "straight_or_flat"
PAIR_QUALITY = {"dual": 1.0, "quantile_fallback": 0.92, "single_left": 0.72, "single_right": 0.72}
PAIR_QUALITY_OTHER = 0.85


def radius_class(radius: Column) -> Column:
    (c0, n0), (c1, n1), (c2, n2), (c3, n3) = RADIUS_CLASSES
    return F.when(radius.isNull() | F.isnan(radius) | (radius >= c3), RADIUS_STRAIGHT).when(radius < c0, n0).when(radius < c1, n1).when(radius <= c2, n2).otherwise(n3)


def pair_quality(mode: Column) -> Column:
    out = None
    for name, value in PAIR_QUALITY.items():
        out = F.when(mode == name, value) if out is None else out.when(mode == name, value)
    return out.otherwise(PAIR_QUALITY_OTHER)


def risk_class(invalid: Column, single: Column, high: float = 0.25, middle: float = 0.20) -> Column:
    return F.when(invalid >= high, "high").when(single >= middle, "medium").otherwise("low")


def text_predicate(words: str, *columns: Column) -> Column:
    """Whether any of the columns holds the words, in any case."""
    return F.lower(F.concat_ws(" ", *columns)).contains(words.lower())


# Metres within which a place counts as near its anchor, and the most that nearness adds to a score.
ANCHOR_SNAP, ANCHOR_WEIGHT = 2.5, 14.0


def anchor_far(place: Column, anchor: Column, snap: float = ANCHOR_SNAP) -> Column:
    """Whether a place is farther from its anchor than may be; without an anchor it is not."""
    return F.coalesce(F.abs(place - anchor) > max(snap, 1e-6), F.lit(False))


def anchor_bonus(distance: Column, snap: float = ANCHOR_SNAP, weight: float = ANCHOR_WEIGHT) -> Column:
    """What nearness to an anchor adds to a score: all of the weight on it, nothing from the snap distance on."""
    return F.greatest(F.lit(0.0), 1 - distance / max(snap, 1e-6)) * weight
