"""Pixel grids of study areas: area, grid, cells, tile windows, masks, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terradelta.functions import geo, geometry

EDGE_POINTS = 21  # extra points per box edge when its projected bounds are taken


TASK_ROWS = 1 << 16  # geometries whose vertices one task sorts


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Geometries dealt by key to as many tasks as keep each near ``TASK_ROWS`` of them. Their bytes do not tell: a task makes
    many vertices of each, so by size they would be gathered into a few tasks that grow with the table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // TASK_ROWS)), key)


def projected_edges(df: DataFrame, key: str, polys: str, *keep: str, spread: bool = True) -> DataFrame:
    """One row per polygon edge in UTM metres: ``poly``, ``ring`` (0 = outer), end points x0, y0, x1, y1.

    Needs column ``epsg``. Vertices become rows, are projected in generated code and meet their successor in a window
    over one ring, whose size is that of the ring.
    """
    # Geometries are spread by key while they are still one row each: the window and the sums per key that follow find
    # their rows in place, and one file of geometries does not keep one task busy. (``spread=False``: they are dealt already.)
    # The outer form is on purpose: the inner one adds a filter on the array's size, which the optimiser copies, with
    # everything the polygon is computed from, down to the scan. Rows without polygons fall out one line later.
    rings = (dealt(df, key) if spread else df).select(key, "epsg", *keep, F.posexplode_outer(polys).alias("poly", "rings"))
    rings = rings.select(key, "epsg", *keep, "poly", F.posexplode("rings").alias("ring", "pts"))
    pts = rings.select(key, "epsg", *keep, "poly", "ring", F.posexplode("pts").alias("pos", "v"))
    pts = pts.select(key, "epsg", *keep, "poly", "ring", "pos", F.col("v.x").alias("lon"), F.col("v.y").alias("lat"))
    pts = geo.with_utm(pts, "lon", "lat", "epsg", "x0", "y0")
    along = Window.partitionBy(key, "poly", "ring").orderBy("pos")
    edges = pts.withColumns({"x1": F.lead("x0").over(along), "y1": F.lead("y0").over(along)})
    return edges.where(F.col("x1").isNotNull()).select(key, *keep, "poly", "ring", "x0", "y0", "x1", "y1")


def local_epsg(df: DataFrame, polys: str) -> DataFrame:
    """Add the EPSG code of the UTM zone around the centre of the bounds."""
    b = geometry.bounds(F.col(polys))
    df = df.withColumn("__b", b)
    return df.withColumn("epsg", geo.utm_epsg((F.col("__b.w") + F.col("__b.e")) / 2, (F.col("__b.s") + F.col("__b.n")) / 2)).drop("__b")


def polygon_area_km2(df: DataFrame, key: str, polys: str, spread: bool = True) -> DataFrame:
    """Planar area in the local UTM zone, holes subtracted, parts added: (key, aoi_km2).

    The shoelace sum is an ordinary aggregate over edges, so partial sums are made where the polygon is read.
    """
    edges = projected_edges(local_epsg(df.select(key, polys), polys), key, polys, spread=spread)
    # Relative to the zone's false easting the products stay small, which keeps precision.
    ex0, ex1 = F.col("x0") - geo.FALSE_EASTING, F.col("x1") - geo.FALSE_EASTING
    ring = edges.groupBy(key, "poly", "ring").agg((F.abs(F.sum(ex0 * F.col("y1") - ex1 * F.col("y0"))) / 2).alias("a"))
    signed = F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))
    return ring.groupBy(key).agg((F.sum(signed) / 1e6).alias("aoi_km2"))


def make_grid(df: DataFrame, key: str, box: str = "box", res: str = "res") -> DataFrame:
    """Grid of every box struct(w, s, e, n): (key, epsg, res, x0, y0, width, height), edges snapped to the resolution.

    Boxes are spread by key before their edges are densified, so the 88 points of a box are made, projected and reduced
    where the box is: one shuffle, of one row per box. It names its number of tasks, as by their bytes these rows would be
    gathered into few, while the work on them is in computing.
    """
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    b = lambda f: F.col(f"{box}.{f}")
    base = df.select(key, box, F.col(res).alias("res"), geo.utm_epsg((b("w") + b("e")) / 2, (b("s") + b("n")) / 2).alias("epsg"))
    steps = base.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(EDGE_POINTS + 1)),
                                                       lambda i: i / F.lit(float(EDGE_POINTS + 1)))))
    lon, lat = b("w") + F.col("t") * (b("e") - b("w")), b("s") + F.col("t") * (b("n") - b("s"))
    side = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    pts = steps.withColumn("p", F.explode(F.array(side(lon, b("s")), side(lon, b("n")), side(b("w"), lat), side(b("e"), lat))))
    pts = geo.with_utm(pts.select(key, "res", "epsg", "p.lon", "p.lat"), "lon", "lat", "epsg", "x", "y")
    ext = pts.groupBy(key).agg(F.max("epsg").alias("epsg"), F.max("res").alias("res"), F.min("x").alias("minx"),
                               F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    res_ = F.col("res")
    lo = lambda c: F.floor(F.col(c) / res_) * res_
    hi = lambda c: F.ceil(F.col(c) / res_) * res_
    return ext.select(key, "epsg", "res", lo("minx").alias("x0"), hi("maxy").alias("y0"),
                      F.round((hi("maxx") - lo("minx")) / res_).cast("int").alias("width"),
                      F.round((hi("maxy") - lo("miny")) / res_).cast("int").alias("height"))


def grid_props(grids: DataFrame) -> DataFrame:
    """Add bounds, area and CRS name of a grid."""
    w, h, res = F.col("width"), F.col("height"), F.col("res")
    return grids.withColumns(
        {"minx": F.col("x0"), "miny": F.col("y0") - h * res, "maxx": F.col("x0") + w * res, "maxy": F.col("y0"),
         "area_km2": w * h * res * res / 1e6, "crs": F.concat(F.lit("EPSG:"), F.col("epsg").cast("string"))}
    )


def grid_cells(grids: DataFrame, key: str) -> DataFrame:
    """One row per pixel with its centre (x, y). Rows are generated first and spread over the cluster, then columns:
    a single large grid does not stay in one task."""
    rows = grids.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    rows = rows.repartition(F.col(key), F.floor(F.col("r") / 64))
    cells = rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return cells.select(key, "epsg", "r", "c", (F.col("x0") + (F.col("c") + 0.5) * F.col("res")).alias("x"),
                        (F.col("y0") - (F.col("r") + 0.5) * F.col("res")).alias("y"))


def starts(n: Column, size: Column | int, stride: Column | int) -> Column:
    """Window origins that cover 0..n-1: every stride, the last one shifted inward; [0] when one window is enough."""
    size, stride = (F.lit(v) if isinstance(v, int) else v for v in (size, stride))
    body = F.filter(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), stride), lambda v: v < n - size)
    return F.when(n <= size, F.array(F.lit(0))).otherwise(F.concat(body, F.array(n - size)))


def tile_windows(grids: DataFrame, size: int, stride: int | None = None) -> DataFrame:
    """One row per tile window (win_r, win_c) of every grid."""
    step = stride or size
    out = grids.withColumn("win_r", F.explode(starts(F.col("height"), size, step)))
    return out.withColumn("win_c", F.explode(starts(F.col("width"), size, step)))


def windows_of(pos: Column, n: Column, size: int, stride: int) -> Column:
    """Origins of the windows that contain position ``pos`` on an axis of length n: arithmetic instead of a join."""
    first = F.greatest(F.ceil((pos - size + 1) / F.lit(stride)), F.lit(0)).cast("int")
    last = F.floor(pos / F.lit(stride)).cast("int")
    regular = F.filter(F.transform(F.sequence(first, F.greatest(last, first)), lambda i: (i * stride).cast("int")),
                       lambda v: (v < n - size) & (v <= pos) & (v > pos - size))
    shifted = F.when(pos >= n - size, F.concat(regular, F.array((n - size).cast("int")))).otherwise(regular)
    return F.when(n <= size, F.array(F.lit(0))).otherwise(shifted)


def aoi_spans(aois: DataFrame, grids: DataFrame, key: str, polys: str) -> DataFrame:
    """Scanline form of the study areas: (key, r, xs), the sorted crossings of each pixel row's centre line with the
    polygon edges. A pixel lies inside when an odd number of crossings is to its left. Work is edges x rows they cross.
    """
    tagged = aois.select(key, polys).join(grids.withColumnsRenamed({"x0": "gx", "y0": "gy"}), key)
    edges = projected_edges(tagged, key, polys, "res", "gy", "height")
    top, bottom = F.greatest("y0", "y1"), F.least("y0", "y1")
    # Row r has its centre at gy - (r + 0.5) res; keep rows with bottom <= centre < top.
    r0 = F.floor((F.col("gy") - top) / F.col("res") - 0.5).cast("int") + 1
    r1 = F.floor((F.col("gy") - bottom) / F.col("res") - 0.5).cast("int")
    r0, r1 = F.greatest(r0, F.lit(0)), F.least(r1, F.col("height") - 1)
    rows = edges.withColumns({"r0": r0, "r1": r1}).where(F.col("r0") <= F.col("r1"))
    rows = rows.withColumn("r", F.explode(F.sequence("r0", "r1")))
    y = F.col("gy") - (F.col("r") + 0.5) * F.col("res")
    x = F.col("x0") + (y - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    return rows.groupBy(key, "r").agg(F.sort_array(F.collect_list(x)).alias("xs"))


def aoi_mask(cells: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Add ``inside`` (pixel centre in the polygon, even-odd rule) to cells with key, r and centre x."""
    joined = cells.join(spans, [key, "r"], "left")
    left_of = F.size(F.filter("xs", lambda v: v <= F.col("x")))
    return joined.withColumn("inside", F.coalesce(left_of % 2 == 1, F.lit(False))).drop("xs")


def resample(cells: DataFrame, pixels: DataFrame, key: str, value: str, method: str = "bilinear") -> DataFrame:
    """Value of a source image at each cell (key, r, c, u, v, src_w, src_h); NULL outside the image or without data.

    ``pixels(key, row, col, value)`` is the source. Nearest is one equi-join; bilinear joins four weighted neighbours
    and renormalises over those with data. Join keys are single pixels, so no key is hot.
    """
    inside = (F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") < F.col("src_w")) & (F.col("v") < F.col("src_h"))
    src = pixels.where(F.col(value).isNotNull()).select(key, "row", "col", F.col(value).alias("val"))
    if method == "nearest":
        asked = cells.withColumns({"row": F.when(inside, F.floor("v").cast("int")), "col": F.when(inside, F.floor("u").cast("int"))})
        return asked.join(src, [key, "row", "col"], "left").select(key, "r", "c", F.col("val").alias(value))
    i, j = F.floor(F.col("u") - 0.5), F.floor(F.col("v") - 0.5)
    tx, ty = F.col("u") - 0.5 - i, F.col("v") - 0.5 - j
    clamp = lambda p, n: F.least(F.greatest(p, F.lit(0)), F.col(n) - 1).cast("int")
    near = F.array(*[
        F.struct(clamp(j + dj, "src_h").alias("row"), clamp(i + di, "src_w").alias("col"),
                 ((tx if di else 1 - tx) * (ty if dj else 1 - ty)).alias("wt"))
        for dj in (0, 1) for di in (0, 1)
    ])
    asked = cells.select(key, "r", "c", F.explode(F.when(inside, near).otherwise(F.array(
        F.struct(F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.lit(0.0).alias("wt"))))).alias("n"))
    asked = asked.select(key, "r", "c", "n.*")
    got = asked.join(src, [key, "row", "col"], "left")
    hit = F.col("val").isNotNull() & (F.col("wt") > 0)
    total = F.sum(F.when(hit, F.col("wt")))
    return got.groupBy(key, "r", "c").agg((F.sum(F.when(hit, F.col("wt") * F.col("val"))) / total).alias(value))


def web_mercator_layer(pixels: DataFrame, grids: DataFrame, key: str) -> DataFrame:
    """Nearest-neighbour copy of grid pixels ``pixels(key, r, c, ...)`` onto a Web Mercator grid as wide as the source.

    Target cells are generated row by row, projected to the source grid and joined to exactly one source pixel. Adds
    the layer's lon/lat bounds.
    """
    side = F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: i / F.lit(20.0)))
    b = grids.withColumn("t", side)
    w_m, h_m, x0, y0, t = F.col("width") * F.col("res"), F.col("height") * F.col("res"), F.col("x0"), F.col("y0"), F.col("t")
    edge = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    b = b.select(key, "epsg", F.explode(F.array(edge(x0 + t * w_m, y0), edge(x0 + t * w_m, y0 - h_m),
                                                edge(x0, y0 - t * h_m), edge(x0 + w_m, y0 - t * h_m))).alias("p"))
    b = geo.with_lonlat(b.select(key, "epsg", "p.x", "p.y"), "x", "y", "epsg", "lon", "lat")
    b = b.groupBy(key).agg(
        F.min(geo.mercator_x(F.col("lon"))).alias("mx0"), F.max(geo.mercator_x(F.col("lon"))).alias("mx1"),
        F.min(geo.mercator_y(F.col("lat"))).alias("my0"), F.max(geo.mercator_y(F.col("lat"))).alias("my1"))
    frame = grids.join(b, key).withColumn(
        "out_h", F.greatest(F.round(F.col("width") * (F.col("my1") - F.col("my0")) / (F.col("mx1") - F.col("mx0"))), F.lit(1)).cast("int"))
    rows = frame.withColumn("out_r", F.explode(F.sequence(F.lit(0), F.col("out_h") - 1))).repartition(F.col(key), F.floor(F.col("out_r") / 64))
    cells = rows.withColumn("out_c", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    mx = F.col("mx0") + (F.col("out_c") + 0.5) / F.col("width") * (F.col("mx1") - F.col("mx0"))
    my = F.col("my1") - (F.col("out_r") + 0.5) / F.col("out_h") * (F.col("my1") - F.col("my0"))
    cells = cells.withColumns({"lon": geo.mercator_lon(mx), "lat": geo.mercator_lat(my)})
    cells = geo.with_utm(cells, "lon", "lat", "epsg", "sx", "sy")
    cells = cells.withColumns({"c": F.floor((F.col("sx") - F.col("x0")) / F.col("res")).cast("int"),
                               "r": F.floor((F.col("y0") - F.col("sy")) / F.col("res")).cast("int")})
    layer = cells.select(key, "out_r", "out_c", "r", "c", geo.mercator_lon(F.col("mx0")).alias("west"), geo.mercator_lat(F.col("my0")).alias("south"),
                         geo.mercator_lon(F.col("mx1")).alias("east"), geo.mercator_lat(F.col("my1")).alias("north"))
    # No broadcast: the planner takes pixels that come from exploded grids for as small as the grids.
    return layer.join(pixels.hint("merge"), [key, "r", "c"], "left").drop("r", "c")
