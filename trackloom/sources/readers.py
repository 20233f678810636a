"""Readers of point, line, tile and annotation files into tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import natural_key, stable_id
from .las import las_headers as las_headers
from .las import las_points as las_points

POINT = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])


def text_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a text file: commas in .csv, white space elsewhere. Lines that do not start with three numbers are left out."""
    parts = F.split(F.trim("value"), r"\s*,\s*" if path.lower().endswith(".csv") else r"\s+")
    rows = spark.read.text(path).select(*(F.get(parts, F.lit(k)).try_cast("double").alias(c) for k, c in enumerate("xyz")), F.col("_metadata.file_path").alias("source_path"))
    return rows.filter("x is not null and y is not null and z is not null")


def pruned(headers: DataFrame, x_min: float, x_max: float, y_min: float, y_max: float) -> list[str]:
    """Paths of files whose bounds meet a rectangle, in natural order."""
    met = headers.filter((F.col("x_min") <= x_max) & (F.col("x_max") >= x_min) & (F.col("y_min") <= y_max) & (F.col("y_max") >= y_min))
    return [r.path for r in met.orderBy(natural_key(F.col("path"))).select("path").collect()]


def npy_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of .npy files of n rows and three columns or more."""
    from ..shipping import map_arrow

    def run(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                a = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False)).astype(float)
                if a.shape[1] < 3:
                    raise ValueError(f"{p} has fewer than three columns")
                yield pa.RecordBatch.from_arrays([*(pa.array(a[:, k].copy()) for k in range(3)), pa.array([p] * len(a))], names=["x", "y", "z", "source_path"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path).select("path", "content")
    return map_arrow(files, run, "x double, y double, z double, source_path string")


def together(parts: list[DataFrame]) -> DataFrame:
    """All points; an optional column stays only if every part has it."""
    common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*common) for p in parts])


_COORDS = {"LineString": "array<array<double>>", "Polygon": "array<array<array<double>>>", "Point": "array<double>"}


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """source, feature_id, kind, coordinates (JSON), props of every feature."""
    doc = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("source"), F.from_json("value", "features array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>").alias("d"))
    rows = doc.select("source", F.posexplode("d.features").alias("pos", "f"))
    p = F.col("f.properties")
    ids = [F.try_element_at(p, F.lit(n)) for n in ("chain_id", "id_text", "candidate_id", "bridge_id", "fid", "qgis_fid")]
    return rows.select("source", stable_id(F.col("pos"), *ids).alias("feature_id"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.coalesce(p, F.create_map().cast("map<string,string>")).alias("props"))


def line_vertices(features: DataFrame) -> DataFrame:
    """feature_id, seq, x, y, z (null in the plane) of line features of two vertices or more."""
    lines = features.filter("kind = 'LineString'").withColumn("_c", F.from_json("coordinates", _COORDS["LineString"])).filter("size(_c) >= 2")
    return lines.select("feature_id", F.posexplode("_c").alias("seq", "p")).select("feature_id", "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), F.get("p", F.lit(2)).alias("z"))


TILE = "tile_id int, tile_name string, image_path string, source_path string, row_off int, col_off int, width int, height int, tile_transform string, x_min double, y_min double, x_max double, y_max double, epsg int, valid_ratio double"


def tile_index(spark: SparkSession, path: str) -> DataFrame:
    """The tile table of a CSV with a header; the transform is an array of six doubles."""
    rows = spark.read.option("header", True).csv(path)
    names = [f.split() for f in TILE.split(", ")]
    rows = rows.select(*((F.col(n).try_cast(t) if n in rows.columns else F.lit(None).cast(t)).alias(n) for n, t in names))
    return rows.withColumn("tile_transform", F.from_json("tile_transform", "array<double>"))


_SHAPE = "array<struct<_label:string,_points:string,_z_order:int,_xtl:double,_ytl:double,_xbr:double,_ybr:double,attribute:array<struct<_name:string,_VALUE:string>>>>"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """image, width, height, label, kind, z_order, points (array of x, y) and attributes of the polygons, polylines and boxes of annotation XML."""
    schema = T._parse_datatype_string(f"_id int, _name string, _width int, _height int, polygon {_SHAPE}, polyline {_SHAPE}, box {_SHAPE}")
    images = spark.read.format("xml").option("rowTag", "image").schema(schema).load(path)

    def of_kind(kind: str):
        return F.transform(F.coalesce(F.col(kind), F.array().cast(_SHAPE)), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("s")))

    shapes = F.concat(*(of_kind(k) for k in ("polygon", "polyline", "box")))
    rows = images.select(F.col("_name").alias("image"), F.col("_width").alias("width"), F.col("_height").alias("height"), F.explode(shapes).alias("e"))
    point = lambda p: F.struct(F.split(p, ",")[0].try_cast("double").alias("x"), F.split(p, ",")[1].try_cast("double").alias("y"))
    s = F.col("e.s")
    corner = lambda a, b: F.struct(s[a].alias("x"), s[b].alias("y"))
    box = F.array(corner("_xtl", "_ytl"), corner("_xbr", "_ytl"), corner("_xbr", "_ybr"), corner("_xtl", "_ybr"))
    points = F.when(F.col("e.kind") == "box", box).otherwise(F.transform(F.split(s["_points"], ";"), point))
    attributes = F.map_from_entries(F.transform(F.coalesce(s["attribute"], F.array().cast("array<struct<_name:string,_VALUE:string>>")), lambda a: F.struct(a["_name"], a["_VALUE"])))
    return rows.select("image", "width", "height", s["_label"].alias("label"), F.col("e.kind").alias("kind"), s["_z_order"].alias("z_order"), points.alias("points"), attributes.alias("attributes"))


def yolo_polygons(spark: SparkSession, path: str) -> DataFrame:
    """file, label, points (normalised x, y) of label files: a class and pairs of numbers in a line."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), parts.alias("p")).filter("size(p) >= 7 and size(p) % 2 = 1")
    xy = F.transform(F.sequence(F.lit(1), F.size("p") - 2, F.lit(2)), lambda k: F.struct(F.get("p", k).try_cast("double").alias("x"), F.get("p", k + 1).try_cast("double").alias("y")))
    return rows.select("file", F.get("p", F.lit(0)).try_cast("int").alias("label"), xy.alias("points"))


def merged_config(defaults: dict, given: dict) -> dict:
    """Given settings over defaults, level by level; unknown ones are kept."""
    out = dict(defaults)
    for key, value in given.items():
        out[key] = merged_config(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def last_writer(tables: list[DataFrame], key: str) -> DataFrame:
    """Tables of one key joined; a column of a later table wins where it is not null."""
    out = tables[0]
    for t in tables[1:]:
        both = [c for c in t.columns if c != key and c in out.columns]
        renamed = t.select(key, *(F.col(c).alias(f"_new_{c}") if c in both else F.col(c) for c in t.columns if c != key))
        out = out.join(renamed, key, "full").select(key, *(F.coalesce(f"_new_{c}", c).alias(c) if c in both else F.col(c) for c in out.columns if c != key), *(c for c in t.columns if c != key and c not in both))
    return out
