"""Registered queries: scene catalog, selection, masks, composites, terrain."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta import constants as K
from terradelta.operators import composite as C
from terradelta.operators import scenes as S
from terradelta.operators import terrain
from terradelta.plans.fixtures import SQL, derive, fixture, table
from terradelta.plans.kit import Book, r6, rounded

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


# ------------------------------------------------------------------------------------------ search

def searches(spark, sf) -> DataFrame:
    """Every area is searched for both sensors in both windows, and once for terrain."""
    a = fixture(spark, sf, "areas")
    parts = [("s1", "pre", "before"), ("s1", "post", "after"), ("s2", "pre", "before"), ("s2", "post", "after"),
             ("dem", "pre", "before")]
    asks = F.array(*[F.struct(F.lit(s).alias("sensor"), F.lit(p).alias("period"), F.col(f"{w}_start").alias("start"),
                              F.col(f"{w}_end").alias("end")) for s, p, w in parts])
    return a.select("area_id", "w", "s", "e", "n", F.explode(asks).alias("q")).select(
        F.concat_ws("-", F.col("area_id").cast("string"), "q.period").alias("search_id"), "area_id", "q.*", "w", "s", "e", "n")


def found(spark, sf) -> DataFrame:
    return S.search(fixture(spark, sf, "scene_catalog"), searches(spark, sf))


FOUND = """found AS (
    SELECT a.area_id, c.sensor, a.period, c.scene_id, c.ts, c.cloud, c.relative_orbit,
           row_number() OVER (PARTITION BY a.area_id, a.sensor, a.period ORDER BY c.ts NULLS FIRST, c.scene_id) AS seq
    FROM (SELECT area_id, w, s, e, n, sensor, period, CASE period WHEN 'pre' THEN before_start ELSE after_start END AS d0,
                 CASE period WHEN 'pre' THEN before_end ELSE after_end END AS d1
          FROM areas, (VALUES ('s1','pre'),('s1','post'),('s2','pre'),('s2','post'),('dem','pre')) v(sensor, period)) a
    JOIN scene_catalog c ON c.sensor = a.sensor AND a.w <= c.e AND c.w <= a.e AND a.s <= c.n AND c.s <= a.n
     AND (a.sensor = 'dem' OR (CAST(c.ts AS DATE) BETWEEN a.d0 AND a.d1)) AND (a.sensor <> 's2' OR c.cloud < 60e0))"""


@book.query("scene_search", f"WITH {FOUND} SELECT area_id, sensor, period, scene_id, CAST(seq AS INTEGER) AS seq FROM found",
            "areas", "scene_catalog")
def q_search(spark, sf):
    return found(spark, sf).select("area_id", "sensor", "period", "scene_id", "seq")


_ITEM = """'{"id":"S' || CAST(event_id AS VARCHAR(20)) || '","collection":"' || CASE WHEN event_type = 'view' THEN 'sentinel-1-rtc' ELSE 'sentinel-2-l2a' END
  || '","properties":{"datetime":' || CASE WHEN event_id % 9 = 0 THEN 'null' ELSE '"2024-01-' || lpad(CAST(1 + event_id % 28 AS VARCHAR(2)), 2, '0') || 'T10:20:30Z"' END
  || ',"eo:cloud_cover":' || CASE WHEN event_type = 'view' THEN 'null' ELSE CAST(event_id % 100 AS VARCHAR(4)) || '.5' END
  || ',"sat:orbit_state":"ascending"' || CASE WHEN event_id % 17 = 0 THEN '' ELSE ',"sat:relative_orbit":' || CAST(event_id % 5 AS VARCHAR(4)) END
  || ',"platform":"p' || CAST(user_id % 4 AS VARCHAR(4)) || '"},"assets":{}}'"""


@book.query("scene_describe", """SELECT 'S' || event_id AS id, CASE WHEN event_type = 'view' THEN 'sentinel-1-rtc' ELSE 'sentinel-2-l2a' END AS collection,
  CASE WHEN event_id % 9 <> 0 THEN '2024-01-' || lpad(CAST(1 + event_id % 28 AS VARCHAR), 2, '0') || ' 10:20:30' END AS datetime,
  CASE WHEN event_type <> 'view' THEN event_id % 100 + 0.5e0 END AS cloud_cover, 'ascending' AS orbit,
  CASE WHEN event_id % 17 <> 0 THEN CAST(event_id % 5 AS INTEGER) END AS relative_orbit, 'p' || (user_id % 4) AS platform FROM events""")
def q_describe(spark, sf):
    items = derive(spark, sf, f"SELECT {_ITEM} AS item FROM {{events}}")
    return S.describe(items).withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))


@book.query("sensor_alias", """SELECT request_id, CASE sensors WHEN 'sentinel-1,S2' THEN 's1,s2' WHEN 's2' THEN 's2' END AS sensors,
  CASE sensors WHEN 'sentinel-1,S2' THEN 'sentinel-1-rtc' WHEN 's2' THEN 'sentinel-2-l2a' END AS collection,
  CASE WHEN sensors = 'landsat' THEN 'landsat' END AS unknown FROM requests""", "requests")
def q_alias(spark, sf):
    r = fixture(spark, sf, "requests").withColumn("names", F.split("sensors", ","))
    keys = S.sensor_alias(F.concat("names", "names"))
    return r.select("request_id", F.array_join(keys, ",").alias("sensors"), S.collection_of(F.get(keys, F.lit(0))).alias("collection"),
                    S.unknown_sensor(F.col("names")).alias("unknown"))


# ------------------------------------------------------------------------------------------ selection

def _closest(spark, sf):
    return S.search_closest(fixture(spark, sf, "scene_catalog"), searches(spark, sf), ["area_id", "sensor"])


@book.query("select_closest", f"""WITH {FOUND} SELECT area_id, sensor, period, scene_id, CAST(row_number() OVER (PARTITION BY area_id, sensor, period ORDER BY seq) AS INTEGER) AS scene_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY area_id, sensor, period ORDER BY CASE period WHEN 'pre' THEN -seq ELSE seq END) AS k FROM found) x
  WHERE k <= 4 AND sensor <> 'dem'""", "areas", "scene_catalog")
def q_closest(spark, sf):
    return _closest(spark, sf).select("area_id", "sensor", "period", "scene_id", "scene_rank")


@book.query("select_spread", f"""WITH {FOUND}, n AS (SELECT *, count(*) OVER (PARTITION BY area_id, sensor, period) AS total FROM found WHERE sensor <> 'dem'),
  k AS (SELECT * FROM n WHERE total <= 4 OR seq - 1 IN (0, CAST(floor((total - 1) / 3e0 + 0.5e0) AS BIGINT), CAST(floor(2 * (total - 1) / 3e0 + 0.5e0) AS BIGINT), total - 1))
  SELECT area_id, sensor, period, scene_id, CAST(row_number() OVER (PARTITION BY area_id, sensor, period ORDER BY seq) AS INTEGER) AS scene_rank FROM k""",
            "areas", "scene_catalog")
def q_spread(spark, sf):
    return S.search_spread(fixture(spark, sf, "scene_catalog"), searches(spark, sf).where("sensor <> 'dem'")).select(
        "area_id", "sensor", "period", "scene_id", "scene_rank")


@book.query("match_orbits", f"""WITH {FOUND}, s1 AS (SELECT * FROM found WHERE sensor = 's1'),
  orb AS (SELECT DISTINCT area_id, coalesce(relative_orbit, -1) AS o FROM s1 WHERE period = 'post' AND seq <= 4),
  pre AS (SELECT s1.*, (orb.o IS NOT NULL) AS same FROM s1 LEFT JOIN orb ON orb.area_id = s1.area_id AND orb.o = coalesce(relative_orbit, -1) WHERE period = 'pre'),
  dec AS (SELECT area_id, bool_or(same) AS any_same FROM pre GROUP BY area_id)
  SELECT area_id, period, scene_id FROM pre JOIN dec USING (area_id) WHERE same OR NOT any_same
  UNION ALL SELECT area_id, period, scene_id FROM s1 WHERE period = 'post'""", "areas", "scene_catalog")
def q_orbits(spark, sf):
    s1 = [t.where("sensor = 's1'") for t in (fixture(spark, sf, "scene_catalog"), searches(spark, sf))]
    return S.search_orbits(*s1, ["area_id"]).select("area_id", "period", "scene_id")


# ------------------------------------------------------------------------------------------ availability

# Every candidate report is checked as a 15 km box with a window before and after it.
CASES_SQL = """SELECT seq AS id, lon - 0.09e0 AS w, lon + 0.09e0 AS e, lat - 0.07e0 AS s, lat + 0.07e0 AS n,
  start_date - CAST(10 AS INT) AS before_start, start_date - CAST(2 AS INT) AS before_end, start_date AS after_start, start_date + CAST(6 AS INT) AS after_end FROM ({candidates})"""


def case_boxes(spark, sf) -> DataFrame:
    return derive(spark, sf, CASES_SQL.replace("{candidates}", SQL["candidates"]) + " x")


_COUNT = """count(CASE WHEN c.sensor = '{s}' AND CAST(c.ts AS DATE) BETWEEN b.{p}_start AND b.{p}_end THEN 1 END)"""
COUNTS = ("boxes AS (" + CASES_SQL.replace("({candidates})", "candidates") + """),
  scenes AS (SELECT sensor, w, s, e, n, CAST(ts AS DATE) AS ts, count(*) AS k FROM scene_catalog WHERE sensor IN ('s1','s2') AND (sensor <> 's2' OR cloud < 60e0) GROUP BY ALL),
  counts AS (SELECT b.id, """ + ", ".join(
    f"coalesce(sum(CASE WHEN c.sensor = '{s}' AND c.ts BETWEEN b.{p}_start AND b.{p}_end THEN c.k END), 0)::BIGINT AS {s}_{p}"
    for s in K.SENSORS for p in ("before", "after")) + """
    FROM boxes b LEFT JOIN scenes c ON b.w <= c.e AND c.w <= b.e AND b.s <= c.n AND c.s <= b.n AND c.ts BETWEEN b.before_start AND b.after_end GROUP BY b.id)""")


@book.query("imagery_counts", f"WITH {COUNTS} SELECT * FROM counts", "candidates", "scene_catalog")
def q_counts(spark, sf):
    return S.imagery_counts(case_boxes(spark, sf), fixture(spark, sf, "scene_catalog"))


@book.query("imagery_status", f"""WITH {COUNTS} SELECT id,
  CASE WHEN u1 AND u2 THEN 's1,s2' WHEN u1 THEN 's1' WHEN u2 THEN 's2' ELSE 's1,s2' END AS sensors,
  CASE WHEN u1 OR u2 THEN 'ready' WHEN s1_after + s2_after > 0 THEN 'partial imagery' ELSE 'waiting for imagery' END AS status
  FROM (SELECT *, s1_before > 0 AND s1_after > 0 AS u1, s2_before > 0 AND s2_after > 0 AS u2 FROM counts) y""", "candidates", "scene_catalog")
def q_status(spark, sf):
    counts = S.imagery_counts(case_boxes(spark, sf), fixture(spark, sf, "scene_catalog"))
    return S.imagery_status(counts).select("id", F.array_join("sensors", ",").alias("sensors"), "status")


def stacks(spark, sf) -> DataFrame:
    """Scenes found per area, sensor and period; the clear-sky share stands in for the valid fraction."""
    got = S.search_counts(fixture(spark, sf, "scene_catalog"), searches(spark, sf).where("sensor <> 'dem'")).select(
        F.col("area_id").alias("request_id"), "sensor", "period", "scenes", (1 - F.col("cloud") / 30).alias("valid_fraction"))
    areas = fixture(spark, sf, "areas").select(
        F.col("area_id").alias("request_id"), F.array(F.lit("s1"), F.lit("s2")).alias("sensors"),
        F.element_at(F.array(*[F.lit(t) for t in K.TASKS]), (F.col("area_id") % 3 + 1).cast("int")).alias("task"))
    return areas, S.expected_stacks(areas, got)


STACKS = FOUND + """, got AS (SELECT area_id, sensor, period, count(*) AS scenes, 1 - avg(coalesce(cloud, 0e0)) / 30 AS vf FROM found GROUP BY ALL),
  stacks AS (SELECT a.area_id AS request_id, v.sensor, v.period, coalesce(scenes, 0) AS scenes, vf,
      CASE a.area_id % 3 WHEN 0 THEN 'flood' WHEN 1 THEN 'wildfire' ELSE 'vegetation' END AS task
    FROM (SELECT area_id, s.sensor, p.period FROM areas, (VALUES ('s1'), ('s2')) s(sensor), (VALUES ('pre'), ('post')) p(period)) a
    JOIN (VALUES ('s1','pre'),('s1','post'),('s2','pre'),('s2','post')) v(sensor, period) ON v.sensor = a.sensor AND v.period = a.period
    LEFT JOIN got ON got.area_id = a.area_id AND got.sensor = v.sensor AND got.period = v.period)"""


@book.query("acquisition_warnings", f"""WITH {STACKS} SELECT request_id, sensor, period, scenes,
  CASE WHEN scenes = 0 THEN 'no ' || upper(sensor) || ' scenes in ' || period || '-event window'
       WHEN coalesce(vf, 0e0) < 0.01e0 THEN upper(sensor) || ' ' || period || '-event composite has no valid pixels (clouds?)' END AS warning FROM stacks""",
            "areas", "scene_catalog")
def q_warnings(spark, sf):
    return S.acquisition_warnings(stacks(spark, sf)[1]).select("request_id", "sensor", "period", "scenes", "warning")


@book.query("request_feasibility", f"""WITH {STACKS} SELECT request_id, task, pre AS has_pre, post AS has_post,
  CASE WHEN NOT post THEN 'no usable post-event observations for this AOI/window'
       WHEN NOT pre AND task <> 'flood' THEN task || ' mapping needs pre-event observations; none were usable in the before window' END AS error,
  CASE WHEN post AND NOT pre AND task = 'flood' THEN 'no pre-event observations: permanent water cannot be separated from flood water' END AS warning
  FROM (SELECT request_id, task, bool_or(period = 'pre' AND scenes > 0 AND coalesce(vf, 0) >= 0.01) AS pre, bool_or(period = 'post' AND scenes > 0 AND coalesce(vf, 0) >= 0.01) AS post
        FROM stacks GROUP BY ALL) x""", "areas", "scene_catalog")
def q_feasible(spark, sf):
    areas, st = stacks(spark, sf)
    return S.request_feasibility(st, areas)


@book.query("scene_count_summary", f"WITH {FOUND} SELECT area_id, sensor || '_' || period AS key, count(*) AS scenes FROM found GROUP BY ALL",
            "areas", "scene_catalog")
def q_scene_counts(spark, sf):
    counts = S.search_counts(fixture(spark, sf, "scene_catalog"), searches(spark, sf))
    return counts.select("area_id", F.concat_ws("_", "sensor", "period").alias("key"), "scenes")


# ------------------------------------------------------------------------------------------ masks and composites

def scene_px(spark, sf) -> DataFrame:
    return fixture(spark, sf, "scene_px")


ORDER = ["scene_ts", "k1", "k2", "k3"]


def optical(spark, sf) -> DataFrame:
    """Masked optical observations with two bands."""
    px = scene_px(spark, sf).withColumns({"b08": F.col("dn"), "b04": F.when(F.col("k1") % 9 != 0, F.col("dn") / 3)})
    return C.mask_s2(px, ["b08", "b04"])


def ranked(df: DataFrame) -> DataFrame:
    return S.select_closest(df, ["pixel_id", "period"], ORDER)


REFL = """refl AS (SELECT pixel_id, period, scene_id, scene_ts, k1, k2, k3, scl NOT IN (0,1,3,8,9,10) AS usable,
  CASE WHEN scl NOT IN (0,1,3,8,9,10) THEN (dn - CASE WHEN processing_baseline >= 4 THEN 1000e0 ELSE 0e0 END) / 10000e0 END AS b08,
  CASE WHEN scl NOT IN (0,1,3,8,9,10) AND k1 % 9 <> 0 THEN (dn / 3 - CASE WHEN processing_baseline >= 4 THEN 1000e0 ELSE 0e0 END) / 10000e0 END AS b04 FROM scene_px)"""
RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY pixel_id, period ORDER BY scene_ts, k1, k2, k3) AS scene_rank FROM (
  SELECT *, CASE period WHEN 'pre' THEN row_number() OVER (PARTITION BY pixel_id, period ORDER BY scene_ts DESC, k1 DESC, k2 DESC, k3 DESC)
     ELSE row_number() OVER (PARTITION BY pixel_id, period ORDER BY scene_ts, k1, k2, k3) END AS near FROM {src}) z WHERE near <= 4)"""


@book.query("mask_s2", f"""WITH {REFL}, keep AS (SELECT scene_id, avg(usable::INT) AS u FROM refl GROUP BY scene_id HAVING avg(usable::INT) >= 0.02)
  SELECT pixel_id, scene_id, k1, k3, scene_ts, {r6('b08', 'b04', digits=9)} FROM refl JOIN keep USING (scene_id)""", "scene_px")
def q_mask_s2(spark, sf):
    good = C.usable_scenes(scene_px(spark, sf), ["scene_id"])
    kept = optical(spark, sf).join(good, "scene_id")
    return rounded(kept.select("pixel_id", "scene_id", "k1", "k3", "scene_ts", "b08", "b04"), 9)


@book.query("mask_s1", "SELECT pixel_id, k1, k3, scene_ts, CASE WHEN vv_power > 0 THEN vv_power END AS vv, CASE WHEN vh_power > 0 THEN vh_power END AS vh FROM scene_px", "scene_px")
def q_mask_s1(spark, sf):
    px = scene_px(spark, sf).withColumnsRenamed({"vv_power": "vv", "vh_power": "vh"})
    return C.mask_s1(px).select("pixel_id", "k1", "k3", "scene_ts", "vv", "vh")


@book.query("composite_median", f"WITH {REFL}, {RANKED.replace('{src}', 'refl')} SELECT pixel_id, period, {r6('median(b08) AS b08', 'median(b04) AS b04', digits=9)} FROM ranked GROUP BY ALL", "scene_px")
def q_median(spark, sf):
    return rounded(C.composite(ranked(optical(spark, sf)), ["pixel_id", "period"], ["b08", "b04"], "median"), 9)


@book.query("composite_first", f"""WITH {REFL}, {RANKED.replace('{src}', 'refl')}, pick AS (SELECT *, row_number() OVER (PARTITION BY pixel_id, period ORDER BY b08 IS NULL OR b04 IS NULL, scene_rank) AS p FROM ranked)
  SELECT pixel_id, period, {r6('b08', 'b04', digits=9)} FROM pick WHERE p = 1""", "scene_px")
def q_first(spark, sf):
    return rounded(C.composite(ranked(optical(spark, sf)), ["pixel_id", "period"], ["b08", "b04"], "first"), 9)


SAR = "sar AS (SELECT *, CASE WHEN vv_power > 0 THEN vv_power END AS vv, CASE WHEN vh_power > 0 THEN vh_power END AS vh FROM scene_px)"


def sar(spark, sf) -> DataFrame:
    return C.mask_s1(scene_px(spark, sf).withColumnsRenamed({"vv_power": "vv", "vh_power": "vh"}))


@book.query("to_db", f"""WITH {SAR}, {RANKED.replace('{src}', 'sar')} SELECT pixel_id, period, {r6('10 * log10(median(vv)) AS vv', '10 * log10(median(vh)) AS vh')} FROM ranked GROUP BY ALL""", "scene_px")
def q_db(spark, sf):
    return rounded(C.composite(ranked(sar(spark, sf)), ["pixel_id", "period"], ["vv", "vh"], "median", db=True))


@book.query("valid_fraction", f"""WITH {REFL}, {RANKED.replace('{src}', 'refl')}, comp AS (SELECT pixel_id, period, median(b08) AS b08, median(b04) AS b04 FROM ranked GROUP BY ALL)
  SELECT pixel_id % 10 AS request_id, period, {r6('avg((b08 IS NOT NULL AND b04 IS NOT NULL)::INT) AS valid_fraction')} FROM comp GROUP BY ALL""", "scene_px")
def q_valid(spark, sf):
    comp = C.composite(ranked(optical(spark, sf)), ["pixel_id", "period"], ["b08", "b04"], "median")
    return rounded(C.valid_fraction(comp.withColumn("request_id", F.col("pixel_id") % 10), ["request_id", "period"], ["b08", "b04"]))


def long_stacks(spark, sf) -> DataFrame:
    """Both sensors' masked observations in one long table."""
    px = ranked(scene_px(spark, sf))
    s1 = C.mask_s1(px.withColumnsRenamed({"vv_power": "vv", "vh_power": "vh"})).withColumn("sensor", F.lit("s1"))
    s2 = C.mask_s2(px.withColumns({b: F.col("dn") / (i + 1) for i, b in enumerate(K.S2_BANDS)}), K.S2_BANDS).withColumn("sensor", F.lit("s2"))
    cols = ["pixel_id", "sensor", "period", "scene_rank"]
    return s1.select(*cols, *K.S1_BANDS).unionByName(s2.select(*cols, *K.S2_BANDS), allowMissingColumns=True)


_S2L = ", ".join(f"CASE WHEN scl NOT IN (0,1,3,8,9,10) THEN (dn / {i + 1} - CASE WHEN processing_baseline >= 4 THEN 1000e0 ELSE 0e0 END) / 10000e0 END AS {b}"
                 for i, b in enumerate(K.S2_BANDS))
_FIRSTB = lambda b, ok: f"coalesce(arg_min({b}, scene_rank) FILTER (period = 'post' AND {ok}), max({b}) FILTER (period = 'post' AND scene_rank = 1))"
_S2OK = " AND ".join(f"{b} IS NOT NULL" for b in K.S2_BANDS)
_PREP = ", ".join([f"10 * log10(median({b}) FILTER (period = 'pre')) AS s1_pre_{b}" for b in K.S1_BANDS]
                  + [f"10 * log10({_FIRSTB(b, 'vv IS NOT NULL AND vh IS NOT NULL')}) AS s1_post_{b}" for b in K.S1_BANDS]
                  + [f"median({b}) FILTER (period = 'pre') AS s2_pre_{b}" for b in K.S2_BANDS]
                  + [f"{_FIRSTB(b, _S2OK)} AS s2_post_{b}" for b in K.S2_BANDS])


@book.query("prepare_inputs", f"""WITH {RANKED.replace('{src}', 'scene_px')}, obs AS (SELECT pixel_id, period, scene_rank, CASE WHEN vv_power > 0 THEN vv_power END AS vv,
  CASE WHEN vh_power > 0 THEN vh_power END AS vh, {_S2L} FROM ranked), wide AS (SELECT pixel_id, {_PREP} FROM obs GROUP BY pixel_id)
  SELECT pixel_id, {r6(*[f'{s}_{p}_{b}' for s in K.SENSORS for p in K.PERIODS for b in K.BANDS[s]], digits=9)} FROM wide""", "scene_px")
def q_prepare(spark, sf):
    return rounded(C.prepare_inputs(long_stacks(spark, sf), ["pixel_id"]), 9)


# ------------------------------------------------------------------------------------------ terrain

@book.query("dem_mosaic", f"""SELECT l_orderkey AS cell, {r6('max(l_extendedprice) FILTER (l_discount > 0.02 AND k = 1) AS elev')} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount <= 0.02, l_partkey, l_suppkey, l_linenumber, l_shipdate) AS k FROM lineitem) x GROUP BY 1""")
def q_mosaic(spark, sf):
    px = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("cell"), F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_shipdate").alias("item"),
        F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice")).alias("elev"))
    return rounded(C.dem_mosaic(px, ["cell"], "elev", "item"))


_G = lambda axis, other: f"""CASE WHEN lag({axis}) OVER {axis}w IS NULL AND lead({axis}) OVER {axis}w IS NULL THEN 0e0
  WHEN lag({axis}) OVER {axis}w IS NULL THEN (lead(elev) OVER {axis}w - elev) / 10 WHEN lead({axis}) OVER {axis}w IS NULL THEN (elev - lag(elev) OVER {axis}w) / 10
  ELSE (lead(elev) OVER {axis}w - lag(elev) OVER {axis}w) / 20 END"""  # noqa: E731


@book.query("slope_deg", f"""SELECT pixel_id, {r6('degrees(atan(sqrt(gx * gx + gy * gy))) AS slope')} FROM (
  SELECT pixel_id, {_G('c', 'r')} AS gx, {_G('r', 'c')} AS gy FROM pix
  WINDOW cw AS (PARTITION BY request_id, r ORDER BY c), rw AS (PARTITION BY request_id, c ORDER BY r)) x""", "pix")
def q_slope(spark, sf):
    return rounded(terrain.slope_deg(fixture(spark, sf, "pix"), ["request_id"]).select("pixel_id", "slope"))
