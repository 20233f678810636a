"""Writers of points, lines and features. All go through Spark's committed writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import json_safe


def xyz(points: DataFrame, path: str) -> None:
    """x y z in six decimals, a point a line."""
    points.select(F.format_string("%.6f %.6f %.6f", "x", "y", "z").alias("value")).write.text(path)


def csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def feature_json(features: DataFrame, digits: int = 6) -> DataFrame:
    """A GeoJSON feature per line (feature_id, vertices as array of seq, x, y[, z], props), as text."""
    point = lambda p: F.array(F.bround(p["x"], digits), F.bround(p["y"], digits), *([F.bround(p["z"], digits)] if "z" in features.schema["vertices"].dataType.elementType.names else []))
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform(F.array_sort("vertices"), point).alias("coordinates"))
    return features.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.map_concat(F.col("props"), F.create_map(F.lit("id"), F.col("feature_id").cast("string"))).alias("properties"), geometry.alias("geometry"))).alias("value"))


def geojson(features: DataFrame, path: str, epsg: int | None = None, one_file: bool = False) -> None:
    """GeoJSON: a feature per line (text sequence), in parallel; with one_file a FeatureCollection, for sets that fit one task."""
    rows = feature_json(features)
    if not one_file:
        rows.write.text(path)
        return
    crs = f'"crs":{{"type":"name","properties":{{"name":"EPSG:{epsg}"}}}},' if epsg else ""
    body = rows.agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("v"))
    body.select(F.concat(F.lit(f'{{"type":"FeatureCollection",{crs}"features":['), F.coalesce("v", F.lit("")), F.lit("]}")).alias("value")).coalesce(1).write.text(path)


def basis_curves(lines: DataFrame, path: str, name: str = "curves") -> None:
    """USD text of linear curves (line_id, seq, x, y, z), with their extent; a line of fewer than two points is an error."""
    if lines.groupBy("line_id").count().filter("count < 2").limit(1).count():
        raise ValueError("a curve needs two points")
    one = lines.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z"))).alias("p"))
    text = F.array_join(F.transform("p", lambda q: F.format_string("(%.6f, %.6f, %.6f)", q["x"], q["y"], q["z"])), ", ")
    low, high = (F.format_string("(%.6f, %.6f, %.6f)", *(f(F.col(f"p.{c}")) for c in "xyz")) for f in (F.array_min, F.array_max))
    body = F.concat(F.lit('    def BasisCurves "line_'), F.col("line_id").cast("string"), F.lit('"\n    {\n        uniform token type = "linear"\n        int[] curveVertexCounts = ['), F.size("p").cast("string"), F.lit("]\n        point3f[] points = ["), text, F.lit("]\n        float3[] extent = ["), low, F.lit(", "), high, F.lit("]\n    }"))
    whole = one.agg(F.array_join(F.sort_array(F.collect_list(body)), "\n").alias("v"))
    whole.select(F.concat(F.lit(f'#usda 1.0\n\ndef Xform "{name}"\n{{\n'), "v", F.lit("\n}")).alias("value")).coalesce(1).write.text(path)


def delivery(lines: DataFrame, path: str, widths: dict[str, int]) -> None:
    """Lines as Parquet, text columns cut to the widths a delivery format allows."""
    cut = {c: F.substring(c, 1, n) for c, n in widths.items() if c in lines.columns}
    lines.withColumns(cut).write.parquet(path)


def summary(rows: DataFrame, path: str) -> None:
    """Rows as JSON without NaN or infinite numbers."""
    safe = [json_safe(F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in rows.schema.fields]
    rows.select(*safe).write.json(path)
