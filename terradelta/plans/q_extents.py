"""Registered queries: connected regions and extents of a mask."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta import constants as K
from terradelta.operators import extents as X
from terradelta.plans.fixtures import fixture
from terradelta.plans.kit import Book, r6, rounded
from terradelta.session import persist_table

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

# A smooth field with some noise: connected shapes of all sizes.
FIELD = "sin(r * 0.45e0) + cos(c * 0.31e0 + request_id) + (k - 50) / 90e0 > 0.2e0"
TILE = 16


def mask(spark, sf) -> DataFrame:
    return fixture(spark, sf, "pix").select("request_id", "r", "c", F.expr(FIELD).cast("int").alias("value"))


def grids(spark, sf) -> DataFrame:
    """Each request on its own 10 m grid in zone 31."""
    ids = fixture(spark, sf, "pix").select("request_id").distinct()
    return ids.select("request_id", F.lit(32631).alias("epsg"), F.lit(10.0).alias("res"), (500000.0 + F.col("request_id") * 2000).alias("x0"), F.lit(4900000.0).alias("y0"))




MASK = f"mask AS (SELECT request_id, r, c, CAST({FIELD} AS INTEGER) AS value FROM pix)"


def regions_sql(name: str, src: str) -> str:
    """CTEs that label the 4-connected regions of ``src(request_id, r, c, value)``: ``name``, with the smallest pixel as label."""
    return f"""{name}_p AS (SELECT *, (CAST(r AS BIGINT) << 31) + c AS id FROM {src}),
{name}_e AS (SELECT a.request_id, a.id AS a, b.id AS b FROM (SELECT *, unnest([id + 1, id - 1, id + (1::BIGINT << 31), id - (1::BIGINT << 31)]) AS near FROM {name}_p) a
  JOIN {name}_p b ON a.request_id = b.request_id AND a.near = b.id AND a.value = b.value),
{name}_l(request_id, id, label) USING KEY (request_id, id) AS (SELECT request_id, id, id FROM {name}_p UNION
  SELECT e.request_id, e.b, min(l.label) FROM {name}_l l JOIN {name}_e e ON e.request_id = l.request_id AND e.a = l.id
    JOIN recurring.{name}_l o ON o.request_id = e.request_id AND o.id = e.b WHERE l.label < o.label GROUP BY e.request_id, e.b),
{name} AS (SELECT request_id, r, c, value, label FROM {name}_p JOIN {name}_l USING (request_id, id))"""


# Regions under 20 pixels point to their largest neighbour, on and on; one that reaches a larger region takes its value.
SIEVE = f"""{MASK}, {regions_sql('reg', 'mask')},
size AS (SELECT request_id, label, count(*) AS n, max(value) AS value FROM reg GROUP BY ALL),
touch AS (SELECT DISTINCT a.request_id, a.label AS me, b.label AS other FROM (SELECT *, unnest([(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]) AS near FROM reg) a
  JOIN reg b ON a.request_id = b.request_id AND a.near = (b.r, b.c) AND a.label <> b.label),
ptr AS (SELECT t.request_id, t.me, arg_min(t.other, (-s.n, t.other)) AS goal FROM touch t JOIN size m ON m.request_id = t.request_id AND m.label = t.me AND m.n < 20
  JOIN size s ON s.request_id = t.request_id AND s.label = t.other GROUP BY t.request_id, t.me),
chain AS (SELECT request_id, me, goal, 1 AS step FROM ptr UNION ALL SELECT h.request_id, h.me, p.goal, h.step + 1 FROM chain h JOIN ptr p ON p.request_id = h.request_id AND p.me = h.goal WHERE h.step < 60),
turned AS (SELECT h.request_id, h.me, arg_min(s.value, h.step) AS value FROM chain h JOIN size s ON s.request_id = h.request_id AND s.label = h.goal AND s.n >= 20 GROUP BY h.request_id, h.me),
sieved AS (SELECT reg.request_id, reg.r, reg.c, coalesce(t.value, reg.value) AS value FROM reg LEFT JOIN turned t ON t.request_id = reg.request_id AND t.me = reg.label)"""
EXTENTS = f"""{SIEVE}, flooded AS (SELECT * FROM sieved WHERE value = 1), {regions_sql('ext', 'flooded')},
feats AS (SELECT request_id, label, round(count(*) * 1e-4, 5) AS area_km2, count(*) AS pixels, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM ext GROUP BY request_id, label),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY area_km2 DESC, label) AS INTEGER) AS rank FROM feats)"""


@book.query("connected_components", f"WITH RECURSIVE {MASK}, {regions_sql('reg', 'mask')} SELECT request_id, r, c, value, label FROM reg", "pix")
def q_components(spark, sf):
    return X.connected_components(mask(spark, sf), "request_id", TILE).select("request_id", "r", "c", "value", "label")


def sieved(spark, sf) -> DataFrame:
    return X.sieve(mask(spark, sf), "request_id", K.SIEVE_PIXELS, TILE)


@book.query("sieve", f"WITH RECURSIVE {SIEVE} SELECT request_id, r, c, value FROM sieved", "pix")
def q_sieve(spark, sf):
    return sieved(spark, sf)


def regions(spark, sf) -> DataFrame:
    kept = sieved(spark, sf).where("value = 1")
    return persist_table(X.connected_components(kept, "request_id", TILE).select("request_id", "r", "c", "label"), "extents")


def features(spark, sf, regions: DataFrame) -> DataFrame:
    return X.top_extents(X.extent_features(regions, grids(spark, sf), "request_id"), "request_id")


@book.query("extent_features", f"WITH RECURSIVE {EXTENTS} SELECT request_id, label, {r6('area_km2')}, pixels, r0, r1, c0, c1 FROM feats", "pix")
def q_features(spark, sf):
    f = X.extent_features(regions(spark, sf), grids(spark, sf), "request_id")
    return rounded(f.select("request_id", "label", "area_km2", "pixels", "r0", "r1", "c0", "c1"))


@book.query("extent_outlines")
def q_outlines(spark, sf):
    return X.outline_lonlat(X.outline_rings(regions(spark, sf), "request_id"), grids(spark, sf), "request_id")


@book.query("top_extents", f"WITH RECURSIVE {EXTENTS} SELECT request_id, label, {r6('area_km2')}, rank FROM ranked", "pix")
def q_top(spark, sf):
    return rounded(features(spark, sf, regions(spark, sf)).select("request_id", "label", "area_km2", "rank"))


def extent_records(spark, sf) -> DataFrame:
    """Ranked extents with their polygons: the whole way from the mask."""
    on = regions(spark, sf)
    polygons = X.extent_polygons(X.outline_rings(on, "request_id"), grids(spark, sf), "request_id")
    return features(spark, sf, on).join(polygons, ["request_id", "label"])


@book.query("extent_polygons", f"""WITH RECURSIVE {EXTENTS} SELECT request_id, label, pixels AS outline_pixels, true AS closed FROM feats""", "pix")
def q_polygons(spark, sf):
    rings = F.transform("coordinates", lambda line: F.element_at(line, 1) == F.element_at(line, F.size(line)))
    return extent_records(spark, sf).select("request_id", "label", "outline_pixels", F.forall(rings, lambda x: x).alias("closed"))
