"""Column functions for frames, transforms and shapes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import clamp


@dataclass(frozen=True)
class Frame:
    """A local frame: origin and unit axis along the track. s runs along, t to the left, z up."""

    ox: float
    oy: float
    oz: float
    ux: float
    uy: float

    def __post_init__(self):
        size = (self.ux**2 + self.uy**2) ** 0.5
        if size == 0:
            raise ValueError("the axis of a frame needs a length")
        object.__setattr__(self, "ux", self.ux / size)
        object.__setattr__(self, "uy", self.uy / size)

    def local(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        dx, dy = x - self.ox, y - self.oy
        return dx * self.ux + dy * self.uy, dy * self.ux - dx * self.uy, z - self.oz

    def world(self, s: Column, t: Column, z: Column) -> tuple[Column, Column, Column]:
        return s * self.ux - t * self.uy + self.ox, s * self.uy + t * self.ux + self.oy, z + self.oz


@dataclass(frozen=True)
class Guide:
    """The chord from a start to an end: station along it, offset to its left."""

    x0: float
    y0: float
    x1: float
    y1: float

    def __post_init__(self):
        if self.length == 0:
            raise ValueError("a guide needs a length")

    @property
    def length(self) -> float:
        return ((self.x1 - self.x0) ** 2 + (self.y1 - self.y0) ** 2) ** 0.5

    @property
    def unit(self) -> tuple[float, float]:
        return (self.x1 - self.x0) / self.length, (self.y1 - self.y0) / self.length

    def project(self, x: Column, y: Column) -> tuple[Column, Column]:
        (ux, uy), dx, dy = self.unit, x - self.x0, y - self.y0
        return dx * ux + dy * uy, dy * ux - dx * uy

    def point(self, station: Column, offset: Column) -> tuple[Column, Column]:
        ux, uy = self.unit
        return station * ux - offset * uy + self.x0, station * uy + offset * ux + self.y0

    def shifted(self, offset: float) -> Guide:
        ux, uy = self.unit
        return Guide(self.x0 - offset * uy, self.y0 + offset * ux, self.x1 - offset * uy, self.y1 + offset * ux)


@dataclass(frozen=True)
class Affine:
    """Column, row -> x, y by six numbers."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    def apply(self, col: Column, row: Column) -> tuple[Column, Column]:
        return col * self.a + row * self.b + self.c, col * self.d + row * self.e + self.f

    def gap(self, row: Column, left: Column, right: Column) -> Column:
        """Distance on the map of two columns of one row; null where the row is unknown."""
        (x0, y0), (x1, y1) = self.apply(left, row), self.apply(right, row)
        return F.hypot(x1 - x0, y1 - y0)

    def inverse(self) -> Affine:
        det = self.a * self.e - self.b * self.d
        if det == 0:
            raise ValueError("the transform has no inverse")
        a, b, d, e = self.e / det, -self.b / det, -self.d / det, self.a / det
        return Affine(a, b, -(a * self.c + b * self.f), d, e, -(d * self.c + e * self.f))

    @property
    def pixel(self) -> tuple[float, float]:
        return (self.a**2 + self.d**2) ** 0.5, (self.b**2 + self.e**2) ** 0.5


def affine_columns(t: Column, col: Column, row: Column) -> tuple[Column, Column]:
    """The transform in an array column of six doubles."""
    g = lambda k: F.element_at(t, k)
    return col * g(1) + row * g(2) + g(3), col * g(4) + row * g(5) + g(6)


def unit(dx: Column, dy: Column, default: tuple[float, float] = (1.0, 0.0)) -> tuple[Column, Column]:
    size = F.hypot(dx, dy)
    return tuple(F.when(size == 0, F.lit(d)).otherwise(v / size) for v, d in zip((dx, dy), default, strict=True))


def orientation(sxx: Column, sxy: Column, syy: Column) -> Column:
    """Angle of the longer axis of a 2 x 2 covariance."""
    return 0.5 * F.atan2(2 * sxy, sxx - syy)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Distance of a point from a segment, and the share of the segment at which its nearest point lies."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    u = F.when(size == 0, F.lit(0.0)).otherwise(clamp(((px - ax) * dx + (py - ay) * dy) / size, 0.0, 1.0))
    rx, ry = px - ax - u * dx, py - ay - u * dy
    return F.sqrt(rx * rx + ry * ry), u  # not hypot, whose last bit SQL does not give


def segment_crossing(ax, ay, bx, by, cx, cy, dx, dy) -> tuple[Column, Column, Column]:
    """Whether two segments cross, and at which share of each; parallel ones do not."""
    rx, ry, qx, qy = bx - ax, by - ay, dx - cx, dy - cy
    det = rx * qy - ry * qx
    u = F.when(det != 0, ((cx - ax) * qy - (cy - ay) * qx) / det)
    v = F.when(det != 0, ((cx - ax) * ry - (cy - ay) * rx) / det)
    return F.coalesce(u.between(0, 1) & v.between(0, 1), F.lit(False)), u, v


def shoelace(points: Column) -> Column:
    """Signed area of a ring of structs x, y; positive if it turns left."""
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, after, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]).cast("double"))
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2)


def clipped(points: Column, width: Column, height: Column) -> Column:
    """Points moved to the nearest place of the image."""
    return F.transform(points, lambda p: F.struct(clamp(p["x"], 0.0, width).alias("x"), clamp(p["y"], 0.0, height).alias("y")))


def rectangle_overlap(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(zero, F.least(ay1, by1) - F.greatest(ay0, by0))


def tile_offsets(length: int, tile: int, stride: int) -> list[int]:
    """Where tiles start; the last one is flush with the end."""
    if tile <= 0 or stride <= 0:
        raise ValueError("tiles and strides need a length")
    if length <= tile:
        return [0]
    return sorted({*range(0, length - tile, stride), length - tile})


def tile_size(length: Column, overlap: float) -> tuple[Column, Column]:
    """A tile of a multiple of 32 within the length, and the stride that leaves the overlap."""
    size = F.greatest(F.floor(length / 32) * 32, F.lit(32))
    return size, F.greatest(F.lit(1), F.bround(size * (1 - overlap)).cast("long"))


def lateral_bands(low: float, high: float, many: int, overlap: float) -> list[tuple[float, float]]:
    """Equal bands over a range, each widened on both sides by half the overlap, within the range."""
    width = (high - low) / many
    return [(max(low, low + k * width - overlap / 2), min(high, low + (k + 1) * width + overlap / 2)) for k in range(many)]


def fit_canvas(x: Column, y: Column, bounds: dict, width: float, height: float, margin: float = 0.0) -> tuple[Column, Column]:
    """Uniform scale into a canvas, with y down."""
    sx, sy = bounds["x_max"] - bounds["x_min"], bounds["y_max"] - bounds["y_min"]
    scale = min((width - 2 * margin) / max(sx, 1e-9), (height - 2 * margin) / max(sy, 1e-9))
    return (x - bounds["x_min"]) * scale + margin, F.lit(height - margin) - (y - bounds["y_min"]) * scale


def utm_forward(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Geographic degrees on WGS 84 to the northern UTM zone, by the published series to the sixth order."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    n = a / F.sqrt(1 - e2 * F.sin(phi) ** 2)
    t, c, q = F.tan(phi) ** 2, ep2 * F.cos(phi) ** 2, F.cos(phi) * lam
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = k0 * n * (q + (1 - t + c) * q**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * q**5 / 120) + 500000.0
    north = k0 * (m + n * F.tan(phi) * (q**2 / 2 + (5 - t + 9 * c + 4 * c**2) * q**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * q**6 / 720))
    return east, north


#: WGS 84 and the scale of UTM's central meridian, fixed values.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)


def _series(rows: list[list[float]]) -> list[float]:
    """Row j holds the factors of n to the powers j, j + 1 and so on."""
    return [sum(c * _N ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(rows, 1)]


# Krueger's series to the sixth order, to the plane, back to the conformal sphere, and from conformal to geographic latitude.
_TO_PLANE = _series([
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800], [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440], [49561 / 161280, -179 / 168, 6601661 / 7257600], [34729 / 80640, -3418889 / 1995840], [212378941 / 319334400],
])
_FROM_PLANE = _series([
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800], [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720], [4397 / 161280, -11 / 504, -830251 / 7257600], [4583 / 161280, -108847 / 3991680], [20648693 / 638668800],
])
_TO_LATITUDE = _series([
    [2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675], [7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945],
    [56 / 15, -136 / 35, -1262 / 105, 73814 / 2835], [4279 / 630, -332 / 35, -399572 / 14175], [4174 / 315, -144838 / 6237], [601676 / 22275],
])
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def to_utm(rows: DataFrame, zone: int, south: bool = False, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """Rows with x, y in a UTM zone (WGS 84), of degrees; exact to less than a micrometre within some thousand kilometres of the central meridian."""
    e = (_F * (2 - _F)) ** 0.5
    phi, lam = F.radians(lat), F.radians(F.col(lon) - (zone * 6 - 183))
    rows = rows.withColumns({"_s": F.sin(phi), "_l": lam})
    rows = rows.withColumn("_t", F.sinh(F.atanh("_s") - e * F.atanh(e * F.col("_s"))))
    rows = rows.withColumns({"_xi": F.atan2(F.col("_t"), F.cos("_l")), "_eta": F.asinh(F.sin("_l") / F.hypot(F.col("_t"), F.cos("_l")))})
    xi, eta = F.col("_xi"), F.col("_eta")
    east, north = eta, xi
    for j, c in enumerate(_TO_PLANE, 1):
        east, north = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta), north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return rows.withColumns({x: _K0 * _RADIUS * east + 500000.0, y: _K0 * _RADIUS * north + (10000000.0 if south else 0.0)}).drop("_s", "_l", "_t", "_xi", "_eta")


def from_utm(rows: DataFrame, zone: int, south: bool = False, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows with lon, lat in degrees, of x, y in a UTM zone (WGS 84)."""
    rows = rows.withColumns({"_xi": (F.col(y) - (10000000.0 if south else 0.0)) / (_K0 * _RADIUS), "_eta": (F.col(x) - 500000.0) / (_K0 * _RADIUS)})
    xi, eta = F.col("_xi"), F.col("_eta")
    a, b = xi, eta
    for j, c in enumerate(_FROM_PLANE, 1):
        a, b = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta), b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    rows = rows.withColumns({"_a": a, "_b": b})
    rows = rows.withColumn("_chi", F.asin(F.sin("_a") / F.cosh("_b")))
    chi = F.col("_chi")
    phi = chi
    for j, c in enumerate(_TO_LATITUDE, 1):
        phi = phi + c * F.sin(2 * j * chi)
    return rows.withColumns({lon: F.degrees(F.atan2(F.sinh("_b"), F.cos("_a"))) + (zone * 6 - 183), lat: F.degrees(phi)}).drop("_xi", "_eta", "_a", "_b", "_chi")


def utm_zone(epsg: int) -> tuple[int, bool]:
    """Zone and hemisphere (True: south) of a WGS 84 UTM code."""
    zone, south = epsg % 100, epsg // 100 == 327
    if epsg // 100 not in (326, 327) or not 1 <= zone <= 60:
        raise ValueError(f"{epsg} is no code of a WGS 84 UTM zone")
    return zone, south


def reprojected(rows: DataFrame, source: int, target: int, x: str = "x", y: str = "y") -> DataFrame:
    """x and y of one system in another: 4326 (degrees) or any WGS 84 UTM zone, by EPSG codes."""
    if source == target:
        return rows
    if source != 4326:
        rows = from_utm(rows, *utm_zone(source), x=x, y=y, lon="_lon", lat="_lat")
    else:
        rows = rows.withColumns({"_lon": F.col(x), "_lat": F.col(y)})
    if target != 4326:
        rows = to_utm(rows, *utm_zone(target), lon="_lon", lat="_lat", x=x, y=y)
    else:
        rows = rows.withColumns({x: F.col("_lon"), y: F.col("_lat")})
    return rows.drop("_lon", "_lat")


def reprojected_boxes(boxes: DataFrame, source: int, target: int, steps: int = 32) -> DataFrame:
    """Boxes (x_min, x_max, y_min, y_max) in another system, so that all points of a box are in the new one: each side is walked in `steps`, as the image of
    a straight side is curved, and the new box is widened by the most that a curve can rise between two steps."""
    if source == target:
        return boxes
    k = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("_k")
    rows = boxes.withColumn("_id", F.monotonically_increasing_id()).withColumn("_box", F.struct(*boxes.columns))
    u = F.col("_k") / steps
    across, up = F.col("x_min") + u * (F.col("x_max") - F.col("x_min")), F.col("y_min") + u * (F.col("y_max") - F.col("y_min"))
    sides = F.array(*(F.struct(F.lit(n).alias("side"), a.alias("px"), b.alias("py")) for n, (a, b) in enumerate(((across, F.col("y_min")), (across, F.col("y_max")), (F.col("x_min"), up), (F.col("x_max"), up)))))
    points = rows.select("_id", "_box", "x_min", "x_max", "y_min", "y_max", k).select("_id", "_box", "_k", F.explode(sides).alias("_p")).select("_id", "_box", "_k", "_p.side", "_p.px", "_p.py")
    points = reprojected(points, source, target, "px", "py")
    w = Window.partitionBy("_id", "side").orderBy("_k")
    bend = lambda c: F.abs(F.lead(c).over(w) - 2 * F.col(c) + F.lag(c).over(w))
    points = points.withColumns({"_bx": bend("px"), "_by": bend("py")})
    rise = lambda c: F.coalesce(F.max(c), F.lit(0.0))  # noqa: E731  a parabola rises by an eighth of its second difference, so all of it is ample
    new = {"x_min": F.min("px") - rise("_bx"), "x_max": F.max("px") + rise("_bx"), "y_min": F.min("py") - rise("_by"), "y_max": F.max("py") + rise("_by")}
    found = points.groupBy("_id").agg(F.first("_box").alias("_box"), *(c.alias(f"_{n}") for n, c in new.items()))
    return found.select(*(F.col(f"_{c}").alias(c) if c in new else F.col(f"_box.{c}").alias(c) for c in boxes.columns))
