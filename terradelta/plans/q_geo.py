"""Registered queries: requests, geometry, projections, grids."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta import constants as K
from terradelta.functions import geo, geometry
from terradelta.operators import grids as G
from terradelta.operators import requests as R
from terradelta.plans.fixtures import SQL, derive, fixture
from terradelta.plans.kit import Book, r6, rounded

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


# ------------------------------------------------------------------------------------------ windows and requests

def request_rows(spark, sf) -> DataFrame:
    """Raw requests; every 11th window text is malformed, every 13th study area is broken."""
    text = lambda a, b: F.concat_ws("/", F.col(a).cast("string"), F.col(b).cast("string"))
    return fixture(spark, sf, "requests").withColumns(
        {
            "before": F.when(F.col("request_id") % 11 == 0, F.concat(F.col("before_start").cast("string"), F.lit("/soon"))).otherwise(text("before_start", "before_end")),
            "after": text("after_start", "after_end"),
            "sensors": F.split("sensors", ","),
            "aoi_error": F.when(F.col("request_id") % 13 == 0, F.lit(geometry.ERR_TYPE)),
            "resolution": F.when(F.col("request_id") % 17 == 0, F.lit(5.0)).otherwise(F.lit(10.0)),
        }).drop("before_start", "before_end", "after_start", "after_end")


_B = "CASE WHEN request_id % 11 = 0 THEN before_start || '/soon' ELSE before_start || '/' || before_end END"
_A = "after_start || '/' || after_end"
REQ = f"""req AS (SELECT *, {_B} AS before, {_A} AS after, CASE WHEN request_id % 11 <> 0 THEN before_end END AS b1,
  abs(dayofyear(before_start + CAST(floor((before_end - before_start) / 2) AS INT)) - dayofyear(after_start + CAST(floor((after_end - after_start) / 2) AS INT))) AS d FROM requests)"""


@book.query("parse_window", f"WITH {REQ} SELECT request_id, CASE WHEN true THEN before_start END AS start, b1 AS end_, CAST(b1 - before_start AS INTEGER) AS days FROM req", "requests")
def q_window(spark, sf):
    a, b = R.parse_window(F.col("before"))
    return request_rows(spark, sf).select("request_id", a.alias("start"), b.alias("end_"), F.datediff(b, a).alias("days"))


@book.query("season_gap", f"WITH {REQ} SELECT request_id, CAST(least(d, 365 - d) AS INTEGER) AS gap FROM req", "requests")
def q_gap(spark, sf):
    r = fixture(spark, sf, "requests")
    return r.select("request_id", R.season_gap(*[F.col(c) for c in ("before_start", "before_end", "after_start", "after_end")]).alias("gap"))


_WARN = """CASE WHEN task = 'vegetation' AND least(d, 365 - d) > 45 THEN 'before/after windows are ' || CAST(least(d, 365 - d) AS VARCHAR) ||
  ' days apart in the seasonal cycle: phenology may be mapped as disturbance; use the same season in different years' END"""


@book.query("seasonal_warning", f"WITH {REQ} SELECT request_id, {_WARN} AS warning FROM req", "requests")
def q_warning(spark, sf):
    r = fixture(spark, sf, "requests")
    gap = R.season_gap(*[F.col(c) for c in ("before_start", "before_end", "after_start", "after_end")])
    return r.select("request_id", R.seasonal_warning(F.col("task"), gap).alias("warning"))


@book.query("validate_request", f"""WITH {REQ}, e AS (SELECT *, CASE
   WHEN task = 'landslide' THEN 'unknown task ''landslide''; supported: [''flood'', ''wildfire'', ''vegetation'']'
   WHEN sensors = 'landsat' THEN 'unknown sensor ''landsat''; use s1, s2'
   WHEN request_id % 13 = 0 THEN 'invalid AOI: AOI must be a Polygon or MultiPolygon'
   WHEN aoi_km2 < 0.01 OR aoi_km2 > 1000 THEN 'AOI area outside'
   WHEN request_id % 11 = 0 THEN 'bad date window ''' || before || ''': use YYYY-MM-DD/YYYY-MM-DD'
   WHEN before_end - before_start > 120 THEN 'window ''' || before || ''' must be ordered and at most 120 days'
   WHEN after_end - after_start > 120 THEN 'window ''' || after || ''' must be ordered and at most 120 days'
   WHEN before_end >= after_start THEN 'the before window must end before the after window starts'
   WHEN request_id % 17 = 0 THEN 'resolution must be 10–100 m' END AS error FROM req)
  SELECT request_id, error, CASE sensors WHEN 'sentinel-1,S2' THEN 's1,s2' WHEN 's2' THEN 's2' END AS sensors, CASE WHEN error IS NULL THEN coalesce({_WARN}, '') END AS warnings FROM e""", "requests")
def q_validate(spark, sf):
    v = R.validate_request(request_rows(spark, sf))
    # The number inside the area message is formatted by the engine; compare the rule only.
    err = F.when(F.col("error").startswith("AOI area"), "AOI area outside").otherwise(F.col("error"))
    return v.select("request_id", err.alias("error"), F.array_join("sensor_keys", ",").alias("sensors"), F.array_join("warnings", ";").alias("warnings"))


# ------------------------------------------------------------------------------------------ geometry

def _num(x):
    return f"CAST(round({x}, 3) AS DECIMAL(18, 3))"


_RING = ("'[[' || {w} || ',' || {s} || '],[' || {e} || ',' || {s} || '],[' || {e} || ',' || {n} || '],[' || {w} || ',' || {n} || ']' || "
         "CASE WHEN kind = 5 THEN ']' ELSE ',[' || {w} || ',' || {s} || ']]' END")
_NUMS = {"w": "CAST(w AS VARCHAR(30))", "s": "CAST(s AS VARCHAR(30))", "e": "CAST(e AS VARCHAR(30))", "n": "CAST(n AS VARCHAR(30))"}
# Eight shapes of input: polygon, multipolygon, feature, collection of one, point, open ring, projected, collection of two.
AOI_JSON = f"""SELECT request_id, kind, w, s, e, n, CASE kind
  WHEN 0 THEN poly WHEN 1 THEN '{{"type":"MultiPolygon","coordinates":[[' || ring || ']]}}' WHEN 2 THEN '{{"type":"Feature","properties":{{}},"geometry":' || poly || '}}'
  WHEN 3 THEN '{{"type":"FeatureCollection","features":[{{"type":"Feature","geometry":' || poly || '}}]}}' WHEN 4 THEN '{{"type":"Point","coordinates":[1,2]}}'
  WHEN 7 THEN '{{"type":"FeatureCollection","features":[{{"type":"Feature","geometry":' || poly || '}},{{"type":"Feature","geometry":' || poly || '}}]}}' ELSE poly END AS aoi
  FROM (SELECT *, '{{"type":"Polygon","coordinates":[' || ring || ']}}' AS poly FROM (SELECT *, {_RING.format(**_NUMS)} AS ring FROM (
    SELECT request_id, CAST(o_k % 8 AS INT) AS kind, {_num('CASE WHEN o_k % 8 = 6 THEN 500000 ELSE lon - half_lon END')} AS w, {_num('lat - half_lat')} AS s, {_num('lon + half_lon')} AS e, {_num('lat + half_lat')} AS n
    FROM (SELECT request_id, request_id AS o_k, lon, lat, half_lon, half_lat FROM {{requests}}) q0) q1) q2) q3"""


def aoi_json(spark, sf) -> DataFrame:
    return derive(spark, sf, AOI_JSON.replace("{requests}", f"({SQL['requests']}) rq"))


AOI_CTE = "aj AS (" + AOI_JSON.replace("{requests}", "requests") + ")"
_AOIERR = f"""CASE kind WHEN 4 THEN '{geometry.ERR_TYPE}' WHEN 5 THEN '{geometry.ERR_RING}' WHEN 6 THEN '{geometry.ERR_RANGE}' WHEN 7 THEN '{geometry.ERR_COLLECTION}' END"""


@book.query("aoi_parse", f"WITH {AOI_CTE} SELECT request_id, {_AOIERR} AS error, CASE WHEN kind < 4 THEN 5 END AS vertices FROM aj", "requests")
def q_aoi(spark, sf):
    out = geometry.with_aoi(aoi_json(spark, sf), "aoi", "p", "error")
    return out.select("request_id", "error", F.size(F.flatten(F.flatten("p"))).alias("vertices"))


@book.query("geom_bounds", f"WITH {AOI_CTE} SELECT request_id, CAST(w AS DOUBLE) AS w, CAST(s AS DOUBLE) AS s, CAST(e AS DOUBLE) AS e, CAST(n AS DOUBLE) AS n FROM aj WHERE kind < 4 UNION ALL SELECT request_id, NULL, NULL, NULL, NULL FROM aj WHERE kind >= 4", "requests")
def q_bounds(spark, sf):
    """Bounds of every area; one that is no valid area has none."""
    df = geometry.with_aoi(aoi_json(spark, sf), "aoi", "p", "error")
    return df.select("request_id", geometry.bounds(F.col("p")).alias("b")).select("request_id", "b.*")


@book.query("bbox_of", f"""WITH {AOI_CTE} SELECT request_id, CAST(CASE kind WHEN 4 THEN 1 ELSE least(w, e) END AS DOUBLE) AS w, CAST(CASE kind WHEN 4 THEN 2 ELSE s END AS DOUBLE) AS s,
  CAST(CASE kind WHEN 4 THEN 1 ELSE greatest(w, e) END AS DOUBLE) AS e, CAST(CASE kind WHEN 4 THEN 2 ELSE n END AS DOUBLE) AS n, CAST(least(w, e) AS DOUBLE) AS wkt_w, CAST(n AS DOUBLE) AS wkt_n FROM aj""", "requests")
def q_bbox(spark, sf):
    """The box of every request's coordinates, whatever holds them: a point is a box without size, a collection has one box."""
    df = aoi_json(spark, sf)
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", F.col(a).cast("string"), F.col(b).cast("string")) for a, b in ("ws", "es", "en", "wn", "ws")]), F.lit("))"))
    df = df.select("request_id", geometry.bbox_json(F.col("aoi")).alias("b"), geometry.bbox_wkt(wkt).alias("k"))
    return df.select("request_id", "b.*", F.col("k.w").alias("wkt_w"), F.col("k.n").alias("wkt_n"))


@book.query("event_geometry", """SELECT event_id, w, s, e, n, 5 AS vertices FROM manifest_events""", "manifest_events")
def q_event_geometry(spark, sf):
    ev = fixture(spark, sf, "manifest_events").withColumns(
        {"bbox": F.when(F.col("event_id") % 2 == 0, F.struct("w", "s", "e", "n")),
         "polys": geometry.box_polygon(F.col("w"), F.col("s"), F.col("e"), F.col("n"))})
    g = geometry.event_geometry(F.col("bbox"), F.col("polys"))
    return ev.select("event_id", g.alias("g")).select("event_id", geometry.bounds(F.col("g")).alias("b"), F.size(F.flatten(F.flatten("g"))).alias("vertices")).select("event_id", "b.*", "vertices")


# ------------------------------------------------------------------------------------------ projections

def epsg_sql(lon, lat):
    return f"(CASE WHEN {lat} >= 0 THEN 32600 ELSE 32700 END + CAST(least(floor(({lon} + 180) / 6) + 1, 60) AS INTEGER))"


def utm_sql(src, lon, lat, epsg, x, y, tag):
    """CTEs that add x, y to ``src``: the textbook forward series, spelled out."""
    a = f"{geo.RECTIFYING * geo.SCALE!r}"
    tau, e = "tan(radians({}))".format(lat), repr(geo.ECC)
    north = " + ".join(f"({c!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(geo.ALPHA, 1))
    east = " + ".join(f"({c!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(geo.ALPHA, 1))
    return f"""{tag}1 AS (SELECT *, {tau} AS tau, radians({lon}) - radians((({epsg}) % 100) * 6 - 183e0) AS lam FROM {src}),
  {tag}2 AS (SELECT *, sinh({e} * atanh({e} * tau / sqrt(1 + tau * tau))) AS sg FROM {tag}1),
  {tag}3 AS (SELECT *, tau * sqrt(1 + sg * sg) - sg * sqrt(1 + tau * tau) AS tp FROM {tag}2),
  {tag}4 AS (SELECT *, atan2(tp, cos(lam)) AS xi, asinh(sin(lam) / sqrt(tp * tp + cos(lam) * cos(lam))) AS eta FROM {tag}3),
  {tag} AS (SELECT * EXCLUDE (tau, lam, sg, tp, xi, eta), 500000e0 + {a} * (eta + {east}) AS {x}, CASE WHEN ({epsg}) > 32700 THEN 10000000e0 ELSE 0e0 END + {a} * (xi + {north}) AS {y} FROM {tag}4)"""


@book.query("utm_zone", f"SELECT request_id, {epsg_sql('lon', 'lat')} AS epsg FROM requests", "requests")
def q_zone(spark, sf):
    return fixture(spark, sf, "requests").select("request_id", geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


def projected(spark, sf) -> DataFrame:
    r = fixture(spark, sf, "requests").withColumns({"plon": F.col("lon") + F.col("half_lon"), "plat": F.col("lat") + F.col("half_lat")})
    r = r.withColumn("epsg", geo.utm_epsg(F.col("plon"), F.col("plat")))
    return geo.with_utm(r, "plon", "plat", "epsg", "x", "y")


PROJ = f"pts AS (SELECT request_id, lon + half_lon AS plon, lat + half_lat AS plat, {epsg_sql('lon + half_lon', 'lat + half_lat')} AS epsg FROM requests), " + utm_sql("pts", "plon", "plat", "epsg", "x", "y", "u")


@book.query("utm_forward", f"WITH {PROJ} SELECT request_id, epsg, {r6('x', 'y', digits=4)} FROM u", "requests")
def q_forward(spark, sf):
    return rounded(projected(spark, sf).select("request_id", "epsg", "x", "y"), 4)


# A point projected and brought back is where it was.
@book.query("utm_inverse", f"SELECT request_id, {r6('lon + half_lon AS lon', 'lat + half_lat AS lat', digits=9)} FROM requests", "requests")
def q_inverse(spark, sf):
    back = geo.with_lonlat(projected(spark, sf), "x", "y", "epsg", "blon", "blat")
    return rounded(back.select("request_id", F.col("blon").alias("lon"), F.col("blat").alias("lat")), 9)


@book.query("web_mercator", f"""SELECT request_id, {r6('6378137e0 * radians(lon) AS x', '6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y', digits=4)},
  {r6('lon AS lon', 'lat AS lat', digits=9)} FROM requests""", "requests")
def q_mercator(spark, sf):
    r = fixture(spark, sf, "requests").withColumns({"x": geo.mercator_x(F.col("lon")), "y": geo.mercator_y(F.col("lat"))})
    out = r.select("request_id", F.round("x", 4) + 0.0, F.round("y", 4) + 0.0, F.round(geo.mercator_lon(F.col("x")), 9) + 0.0, F.round(geo.mercator_lat(F.col("y")), 9) + 0.0)
    return out.toDF("request_id", "x", "y", "lon", "lat")


@book.query("haversine_km", f"""SELECT request_id, {r6('2 * 6371.0088e0 * asin(sqrt(pow(sin(radians(half_lat * 20) / 2), 2) + cos(radians(lat)) * cos(radians(lat + half_lat * 20)) * pow(sin(radians(half_lon * 30) / 2), 2))) AS km')} FROM requests""", "requests")
def q_haversine(spark, sf):
    c = F.col
    km = geo.haversine_km(c("lon"), c("lat"), c("lon") + c("half_lon") * 30, c("lat") + c("half_lat") * 20)
    return rounded(fixture(spark, sf, "requests").select("request_id", km.alias("km")))


_BOX = "radians(lat)"


@book.query("box_around", f"""SELECT request_id, {r6(f'lon - 7.5e0 / (111.32e0 * cos({_BOX})) AS w', 'lat - half_lat * 50 / 110.574e0 AS s', f'lon + 7.5e0 / (111.32e0 * cos({_BOX})) AS e', 'lat + half_lat * 50 / 110.574e0 AS n', digits=5)} FROM requests""", "requests")
def q_box(spark, sf):
    b = geo.box_around(F.col("lon"), F.col("lat"), F.lit(15.0), F.col("half_lat") * 100)
    return rounded(fixture(spark, sf, "requests").select("request_id", b.alias("b")).select("request_id", "b.*"), 5)


# ------------------------------------------------------------------------------------------ areas and grids

# A diamond with a triangular hole around every request point.
DIAMOND = [("lon - half_lon", "lat"), ("lon", "lat - half_lat"), ("lon + half_lon", "lat"), ("lon", "lat + half_lat"), ("lon - half_lon", "lat")]
HOLE = [("lon - half_lon * 0.3e0", "lat"), ("lon + half_lon * 0.3e0", "lat"), ("lon", "lat + half_lat * 0.4e0"), ("lon - half_lon * 0.3e0", "lat")]


def diamonds(df: DataFrame) -> DataFrame:
    ring = lambda pts: F.array(*[F.struct(F.expr(x).alias("x"), F.expr(y).alias("y")) for x, y in pts])
    return df.withColumn("polys", F.array(F.array(ring(DIAMOND), ring(HOLE))))


def _edge_rows(src):
    rows = []
    for k, pts in enumerate((DIAMOND, HOLE)):
        for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
            rows.append(f"SELECT *, {k} AS ring, {x0} AS ex0, {y0} AS ey0, {x1} AS ex1, {y1} AS ey1 FROM {src}")
    return " UNION ALL ".join(rows)


def edges_sql(src, epsg):
    return f"ed AS ({_edge_rows(src)}), " + utm_sql("ed", "ex0", "ey0", epsg, "px0", "py0", "ua") + ", " + utm_sql("ua", "ex1", "ey1", epsg, "px1", "py1", "ub")


@book.query("polygon_area_km2", f"""WITH {edges_sql('requests', epsg_sql('lon', 'lat'))}, ra AS (SELECT request_id, ring, abs(sum((px0 - 500000) * py1 - (px1 - 500000) * py0)) / 2 AS a FROM ub GROUP BY ALL)
  SELECT request_id, {r6('sum(CASE ring WHEN 0 THEN a ELSE -a END) / 1e6 AS aoi_km2', digits=4)} FROM ra GROUP BY request_id""", "requests")
def q_area(spark, sf):
    return rounded(G.polygon_area_km2(diamonds(fixture(spark, sf, "requests")), "request_id", "polys"), 4)


def boxes(df: DataFrame) -> DataFrame:
    c = F.col
    box = F.struct((c("lon") - c("half_lon")).alias("w"), (c("lat") - c("half_lat")).alias("s"), (c("lon") + c("half_lon")).alias("e"), (c("lat") + c("half_lat")).alias("n"))
    return df.withColumns({"box": box, "res": F.lit(10.0)})


def grids_sql(src, key, res):
    pts = f"""bx AS (SELECT {key}, {epsg_sql('lon', 'lat')} AS epsg, lon - half_lon AS w, lat - half_lat AS s, lon + half_lon AS e, lat + half_lat AS n FROM {src}),
  st AS (SELECT bx.*, t / 22e0 AS t FROM bx, range(0, 23) g(t)),
  pt AS (SELECT {key}, epsg, w + t * (e - w) AS lo, s AS la FROM st UNION ALL SELECT {key}, epsg, w + t * (e - w), n FROM st
         UNION ALL SELECT {key}, epsg, w, s + t * (n - s) FROM st UNION ALL SELECT {key}, epsg, e, s + t * (n - s) FROM st)"""
    return pts + ", " + utm_sql("pt", "lo", "la", "epsg", "x", "y", "ug") + f""",
  mm AS (SELECT {key}, epsg, floor(min(x) / {res}) * {res} AS x0, ceil(max(y) / {res}) * {res} AS y0, ceil(max(x) / {res}) * {res} AS x1, floor(min(y) / {res}) * {res} AS y1 FROM ug GROUP BY ALL),
  gr AS (SELECT {key}, epsg, {res}e0 AS res, x0, y0, CAST(round((x1 - x0) / {res}) AS INTEGER) AS width, CAST(round((y0 - y1) / {res}) AS INTEGER) AS height FROM mm)"""


def request_grids(spark, sf) -> DataFrame:
    return G.make_grid(boxes(fixture(spark, sf, "requests")), "request_id")


GRIDS = grids_sql("requests", "request_id", 10)


@book.query("make_grid", f"WITH {GRIDS} SELECT * FROM gr", "requests")
def q_grid(spark, sf):
    return request_grids(spark, sf)


@book.query("grid_props", f"WITH {GRIDS} SELECT request_id, 'EPSG:' || epsg AS crs, x0 AS minx, y0 - height * res AS miny, x0 + width * res AS maxx, y0 AS maxy, {r6('width * height * res * res / 1e6 AS area_km2')} FROM gr", "requests")
def q_props(spark, sf):
    return rounded(G.grid_props(request_grids(spark, sf)).select("request_id", "crs", "minx", "miny", "maxx", "maxy", "area_km2"))


_STARTS = lambda n: f"SELECT request_id, unnest(CASE WHEN {n} <= 256 THEN [0] ELSE list_append(range(0, {n} - 256, 192), {n} - 256) END) AS v FROM gr"


@book.query("tile_windows", f"""WITH {GRIDS}, rr AS ({_STARTS('height')}), cc AS ({_STARTS('width')})
  SELECT request_id, CAST(rr.v AS INTEGER) AS win_r, CAST(cc.v AS INTEGER) AS win_c FROM rr JOIN cc USING (request_id)""", "requests")
def q_tiles(spark, sf):
    return G.tile_windows(request_grids(spark, sf), K.WINDOW_SIZE, K.WINDOW_STRIDE).select("request_id", "win_r", "win_c")


# Small study areas for per-pixel grids: one diamond per supplier at 100 m.
AREA_POINTS = """SELECT s_suppkey AS area_id, -60e0 + s_nationkey * 5.1e0 AS lon, -45e0 + (s_suppkey % 97) * 1.1e0 AS lat,
  0.006e0 + (s_suppkey % 5) * 0.004e0 AS half_lon, 0.005e0 + (s_suppkey % 4) * 0.004e0 AS half_lat FROM {supplier}"""
AREAS_CTE = "ap AS (" + AREA_POINTS.replace("{supplier}", "supplier") + ")"


def area_points(spark, sf) -> DataFrame:
    return diamonds(boxes(derive(spark, sf, AREA_POINTS)).withColumn("res", F.lit(100.0)))


def area_grids(spark, sf) -> DataFrame:
    return G.make_grid(area_points(spark, sf), "area_id")


AGRIDS = AREAS_CTE + ", " + grids_sql("ap", "area_id", 100)
ACELLS = AGRIDS + """, ce AS (SELECT area_id, epsg, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, x0 + (c + 0.5e0) * res AS x, y0 - (r + 0.5e0) * res AS y
  FROM (SELECT *, unnest(range(0, width)) AS c FROM (SELECT *, unnest(range(0, height)) AS r FROM gr) z) zz)"""


@book.query("grid_cells", f"WITH {ACELLS} SELECT area_id, r, c, x, y FROM ce")
def q_cells(spark, sf):
    return G.grid_cells(area_grids(spark, sf), "area_id").select("area_id", "r", "c", "x", "y")


@book.query("aoi_mask", f"""WITH {ACELLS}, {edges_sql('ap', epsg_sql('lon', 'lat'))},
  hit AS (SELECT ce.area_id, ce.r, ce.c, count(CASE WHEN (py0 <= ce.y) <> (py1 <= ce.y) AND px0 + (ce.y - py0) / (py1 - py0) * (px1 - px0) <= ce.x THEN 1 END) AS k
    FROM ce JOIN ub ON ub.area_id = ce.area_id GROUP BY ALL)
  SELECT area_id, r, c, k % 2 = 1 AS inside FROM hit""")
def q_aoi_mask(spark, sf):
    areas, gr = area_points(spark, sf), area_grids(spark, sf)
    spans = G.aoi_spans(areas, gr, "area_id", "polys")
    return G.aoi_mask(G.grid_cells(gr, "area_id"), spans, "area_id").select("area_id", "r", "c", "inside")


# The pix fixture as a source image, read onto a grid that is shifted by 3.3 columns and 1.4 rows.
SHIFT_U, SHIFT_V = 3.3, 1.4


def _resample(spark, sf, method):
    px = fixture(spark, sf, "pix").select("request_id", F.col("r").alias("row"), F.col("c").alias("col"), "r", "c", "elev")
    cells = px.select("request_id", "r", "c", (F.col("c") + 0.5 - SHIFT_U).alias("u"), (F.col("r") + 0.5 - SHIFT_V).alias("v"), F.lit(100).alias("src_w"), F.lit(20).alias("src_h"))
    return rounded(G.resample(cells, px.select("request_id", "row", "col", "elev"), "request_id", "elev", method))


_UV = f"cells AS (SELECT request_id, r, c, c + 0.5e0 - {SHIFT_U}e0 AS u, r + 0.5e0 - {SHIFT_V}e0 AS v FROM pix)"


@book.query("resample_nearest", f"""WITH {_UV} SELECT a.request_id, a.r, a.c, {r6('p.elev AS elev')} FROM cells a LEFT JOIN pix p ON p.request_id = a.request_id AND a.u >= 0 AND a.v >= 0 AND a.u < 100 AND a.v < 20
  AND p.c = CAST(floor(a.u) AS INTEGER) AND p.r = CAST(floor(a.v) AS INTEGER)""", "pix")
def q_nearest(spark, sf):
    return _resample(spark, sf, "nearest")


@book.query("resample_to_grid", f"""WITH {_UV}, nb AS (SELECT request_id, r, c, u >= 0 AND v >= 0 AND u < 100 AND v < 20 AS ok, floor(u - 0.5e0) AS i, floor(v - 0.5e0) AS j, u - 0.5e0 AS fu, v - 0.5e0 AS fv FROM cells),
  w AS (SELECT request_id, r, c, CAST(least(greatest(i + di, 0), 99) AS INTEGER) AS col, CAST(least(greatest(j + dj, 0), 19) AS INTEGER) AS row,
     (CASE di WHEN 1 THEN fu - i ELSE 1 - (fu - i) END) * (CASE dj WHEN 1 THEN fv - j ELSE 1 - (fv - j) END) AS wt, ok FROM nb, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(di, dj))
  SELECT w.request_id, w.r, w.c, {r6('sum(wt * p.elev) / nullif(sum(CASE WHEN p.elev IS NOT NULL THEN wt END), 0) AS elev')} FROM w LEFT JOIN pix p ON ok AND p.request_id = w.request_id AND p.r = w.row AND p.c = w.col GROUP BY ALL""", "pix")
def q_bilinear(spark, sf):
    return _resample(spark, sf, "bilinear")


@book.query("web_mercator_layer")
def q_layer(spark, sf):
    gr = area_grids(spark, sf)
    px = G.grid_cells(gr, "area_id").select("area_id", "r", "c", ((F.col("r") + F.col("c")) % 256).alias("red"))
    return G.web_mercator_layer(px, gr, "area_id")
