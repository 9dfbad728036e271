"""GeoJSON and WKT geometry as nested arrays: polygon -> ring -> vertex struct(x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLYGONS = "ARRAY<ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>"

# --- Fixed values: messages and the WKT number-pair pattern -------------------------------------------
ERR_COLLECTION = "FeatureCollection AOI must contain exactly one feature"
ERR_TYPE = "AOI must be a Polygon or MultiPolygon"
ERR_RING = "AOI rings must be closed with at least 4 positions"
ERR_RANGE = "AOI coordinates must be lon/lat (EPSG:4326)"
WKT_PAIR = r"(-?\d+(?:\.\d+)?) (-?\d+(?:\.\d+)?)"
# --------------------------------------------------------------------------------------------------------


def _ring_error(ring: Column) -> Column:
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    open_ring = (F.size(ring) < 4) | ~first.eqNullSafe(last)
    inside = lambda v: F.get(v, F.lit(0)).between(-180, 180) & F.get(v, F.lit(1)).between(-90, 90)
    return F.when(open_ring, F.lit(ERR_RING)).when(~F.coalesce(F.forall(ring, inside), F.lit(False)), F.lit(ERR_RANGE))


def with_aoi(df: DataFrame, json: str, polys: str = "polys", error: str = "aoi_error") -> DataFrame:
    """Add polygons and error of a GeoJSON geometry, Feature or one-feature FeatureCollection; one of them is NULL.

    The text is parsed once, into one struct that covers all accepted shapes; coordinates stay text until the type is
    known.
    """
    geom = "STRUCT<type: STRING, coordinates: STRING>"
    feature = f"STRUCT<type: STRING, coordinates: STRING, geometry: {geom}>"
    shape = f"type STRING, coordinates STRING, geometry {geom}, features ARRAY<{feature}>"
    df = df.withColumn("__j", F.from_json(json, shape))
    j, only = F.col("__j"), F.get(F.col("__j.features"), F.lit(0))
    is_coll = F.col("__j.type") == "FeatureCollection"
    plain = lambda f: F.when(f["type"] == "Feature", f["geometry"]).otherwise(
        F.struct(f["type"].alias("type"), f["coordinates"].alias("coordinates")))
    df = df.withColumns(
        {"__g": F.when(is_coll, plain(only)).otherwise(plain(j)),
         "__bad": is_coll & (F.coalesce(F.size("__j.features"), F.lit(0)) != 1)}
    ).drop("__j")
    gtype, coords = F.col("__g.type"), F.col("__g.coordinates")
    df = df.withColumn(
        "__p",
        F.when(gtype == "Polygon", F.array(F.from_json(coords, "ARRAY<ARRAY<ARRAY<DOUBLE>>>")))
        .when(gtype == "MultiPolygon", F.from_json(coords, "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>")),
    )
    ring_errors = F.filter(F.transform(F.flatten("__p"), _ring_error), lambda e: e.isNotNull())
    df = df.withColumn(
        error,
        F.when(F.col("__bad"), F.lit(ERR_COLLECTION))
        .when(~F.coalesce(gtype.isin("Polygon", "MultiPolygon"), F.lit(False)), F.lit(ERR_TYPE))
        .when(F.flatten("__p").isNull(), F.lit(ERR_RING))
        .otherwise(F.get(ring_errors, F.lit(0))),
    )
    to_xy = lambda v: F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y"))
    vertices = F.transform("__p", lambda p: F.transform(p, lambda ring: F.transform(ring, to_xy)))
    return df.withColumn(polys, F.when(F.col(error).isNull(), vertices)).drop("__g", "__bad", "__p")


def bounds(polys: Column) -> Column:
    """struct(w, s, e, n) over all vertices."""
    pts = F.flatten(F.flatten(polys))
    xs, ys = F.transform(pts, lambda v: v["x"]), F.transform(pts, lambda v: v["y"])
    return _box(xs, ys)


def _box(xs: Column, ys: Column) -> Column:
    box = F.struct(F.array_min(xs).alias("w"), F.array_min(ys).alias("s"), F.array_max(xs).alias("e"), F.array_max(ys).alias("n"))
    return F.when(F.size(xs) > 0, box)


def bbox_wkt(wkt: Column) -> Column:
    """Box of all "x y" pairs in a WKT text; NULL without any."""
    xs = F.transform(F.regexp_extract_all(wkt, F.lit(WKT_PAIR), F.lit(1)), lambda v: v.cast("double"))
    ys = F.transform(F.regexp_extract_all(wkt, F.lit(WKT_PAIR), F.lit(2)), lambda v: v.cast("double"))
    return _box(xs, ys)


def bbox_json(coords: Column) -> Column:
    """Box of arbitrarily nested JSON coordinates: every innermost array contributes its first two numbers."""
    pair = r"\[\s*(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*,\s*(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    xs = F.transform(F.regexp_extract_all(coords, F.lit(pair), F.lit(1)), lambda v: v.cast("double"))
    ys = F.transform(F.regexp_extract_all(coords, F.lit(pair), F.lit(2)), lambda v: v.cast("double"))
    return _box(xs, ys)


def box_polygon(w: Column, s: Column, e: Column, n: Column) -> Column:
    """A box as polygons, counter-clockwise and closed."""
    v = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(F.array(v(w, s), v(e, s), v(e, n), v(w, n), v(w, s))))


def event_geometry(bbox: Column, polys: Column) -> Column:
    """An event's geometry: its box when given, else its polygons."""
    return F.when(bbox.isNotNull(), box_polygon(bbox["w"], bbox["s"], bbox["e"], bbox["n"])).otherwise(polys)
