"""Registered queries: post-processing, summaries, colours and records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta import constants as K
from terradelta.functions import colors
from terradelta.functions import physics as P
from terradelta.operators import maps as M
from terradelta.operators import post
from terradelta.plans import sql_physics as S
from terradelta.plans.fixtures import fixture
from terradelta.plans.kit import Book, r6, rounded
from terradelta.plans.q_physics import task_maps
from terradelta.plans.q_scenes import FOUND, _closest

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

# The study area of the pix fixture: a band of its grid.
INSIDE_SQL = "(r + c) % 9 <> 0"
MAPS = S.chain() + S.MAPS
POST = MAPS + f""", w AS (SELECT *, coalesce(water_s2_pre, water_s1_pre, 0e0) > 0.8e0 AS water, {INSIDE_SQL} AS inside FROM maps),
  post AS (SELECT * REPLACE (
     CASE WHEN inside AND water AND task <> 'flood' THEN 0e0 WHEN inside THEN target END AS target, CASE WHEN inside THEN change END AS change,
     CASE WHEN inside AND water AND task <> 'flood' THEN 0e0 WHEN inside THEN uncertainty END AS uncertainty) FROM w),
  done AS (SELECT * REPLACE (CASE WHEN inside AND target IS NOT NULL AND severity IS NOT NULL THEN CASE WHEN target >= 0.5e0 THEN severity ELSE 0 END END AS severity) FROM post)"""


def inside():
    return (F.col("r") + F.col("c")) % 9 != 0


def water():
    return P.pre_water(F.col("water_s1_pre"), F.col("water_s2_pre"))


def results(spark, sf) -> DataFrame:
    return post.post_process(task_maps(spark, sf), inside(), F.col("task"), water())


@book.query("clip_to_aoi", MAPS + f" SELECT pixel_id, task, {r6(*[f'CASE WHEN {INSIDE_SQL} THEN {m} END AS {m}' for m in ('target', 'change', 'uncertainty')])} FROM maps", "pix")
def q_clip(spark, sf):
    return rounded(post.clip_to_aoi(task_maps(spark, sf), inside()).select("pixel_id", "task", "target", "change", "uncertainty"))


@book.query("water_override", POST + f" SELECT pixel_id, task, {r6('target', 'uncertainty')} FROM post", "pix")
def q_water(spark, sf):
    df = post.clip_to_aoi(task_maps(spark, sf), inside())
    return rounded(post.water_override(df, inside(), water(), F.col("task")).select("pixel_id", "task", "target", "uncertainty"))


@book.query("gate_severity", POST + " SELECT pixel_id, severity, coalesce(severity, 255) AS code FROM done WHERE task = 'wildfire'", "pix")
def q_gate(spark, sf):
    return results(spark, sf).where("task = 'wildfire'").select("pixel_id", "severity", F.coalesce("severity", F.lit(K.IGNORE)).alias("code"))


@book.query("threshold_mask", POST + " SELECT pixel_id, task, coalesce(target >= 0.5e0, false) AS affected FROM done", "pix")
def q_mask(spark, sf):
    return results(spark, sf).select("pixel_id", "task", post.threshold_mask(F.col("target")).alias("affected"))


SUMMARY = """SELECT request_id, task, sum(CASE WHEN target IS NOT NULL THEN 1e-4 ELSE 0e0 END) AS observed_km2,
  sum(CASE WHEN target >= 0.5e0 THEN 1e-4 ELSE 0e0 END) AS affected_km2, sum(CASE WHEN target IS NOT NULL AND uncertainty >= 0.8e0 THEN 1e-4 ELSE 0e0 END) AS review_km2,
  avg(CASE WHEN target >= 0.5e0 THEN greatest(target, 1 - target) END) AS mean_confidence_affected, avg(CASE WHEN target IS NOT NULL THEN uncertainty END) AS mean_uncertainty
  FROM done GROUP BY request_id, task"""
_SUMCOLS = ("observed_km2", "affected_km2", "review_km2", "mean_confidence_affected", "mean_uncertainty")


@book.query("request_summary", POST + f" SELECT request_id, task, {r6(*_SUMCOLS)} FROM ({SUMMARY}) s", "pix")
def q_summary(spark, sf):
    return rounded(post.request_summary(results(spark, sf), ["request_id", "task"]))


@book.query("severity_area", POST + " SELECT request_id, " + r6(*[f"sum(CASE WHEN severity = {i + 1} THEN 1e-4 ELSE 0e0 END) AS {n.replace('-', '_')}" for i, n in enumerate(K.SEVERITY_CLASSES)]) + " FROM done WHERE task = 'wildfire' GROUP BY request_id", "pix")
def q_sev_area(spark, sf):
    return rounded(post.severity_area(results(spark, sf).where("task = 'wildfire'"), ["request_id"]))


@book.query("summary_sink", POST + f""" SELECT request_id, task, CASE task WHEN 'flood' THEN 'flood' WHEN 'wildfire' THEN 'burn' ELSE 'disturbance' END AS target_name,
  CASE task WHEN 'flood' THEN 'flooded' WHEN 'wildfire' THEN 'burned' ELSE 'disturbed' END AS affected_label, {r6(*_SUMCOLS, digits=3)},
  0.5e0 AS threshold, 0.8e0 AS review_if_uncertainty_ge FROM (SELECT request_id, task, {r6(*_SUMCOLS, digits=9)} FROM ({SUMMARY}) s0) s""", "pix")
def q_sink(spark, sf):
    # Area sums are rounded to 9 places first so that adding in another order cannot move a half.
    return post.summary_record(rounded(post.request_summary(results(spark, sf), ["request_id", "task"]), 9))


# ------------------------------------------------------------------------------------------ colours

def _ramp_sql(v, stops):
    cols = []
    for i, n in enumerate("rgba"):
        cases = " ".join(f"WHEN {v} < {x1}e0 THEN CAST(floor({c0[i]}e0 + ({v} - {x0}e0) / ({x1}e0 - {x0}e0) * ({c1[i]}e0 - {c0[i]}e0)) AS INTEGER)"
                         for (x0, c0), (x1, c1) in zip(stops, stops[1:]))
        cols.append(f"CASE WHEN {v} IS NULL OR {v} < {stops[0][0]}e0 THEN 0 {cases} ELSE {stops[-1][1][i]} END")
    return cols


def _join(cols):
    return " || ',' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)


def _text(color):
    return lambda names: F.concat_ws(",", *[color[n].cast("string") for n in names])


_UNIT = lambda x: f"CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, 1e0), 0e0) END"
_RGBSQL = [f"coalesce(CAST(floor(pow({_UNIT(f's2_post_{b} / 0.3e0')}, {1 / 1.4!r}) * 255) AS INTEGER), 0)" for b in ("b04", "b03", "b02")]
_SEVSQL = [f"CASE coalesce(severity, 0) " + " ".join(f"WHEN {i} THEN {c[k]}" for i, c in enumerate(K.SEVERITY_RGBA)) + " END" for k in range(4)]
_TGT = {t: _join(_ramp_sql("target", colors.probability_stops(s["target"]))) for t, s in K.TASKS.items()}
_DEEP = {t: K.TARGET_COLORS[s["target"]][1] for t, s in K.TASKS.items()}
_QL = {t: _join([f"CASE WHEN target >= 0.5e0 THEN CAST(floor(0.45e0 * {c} + 0.55e0 * {_DEEP[t][i]}) AS INTEGER) ELSE {c} END" for i, c in enumerate(_RGBSQL)]) for t in K.TASKS}


@book.query("map_layer_colors", POST + f""" SELECT pixel_id, task, CASE task WHEN 'flood' THEN {_TGT['flood']} WHEN 'wildfire' THEN {_TGT['wildfire']} ELSE {_TGT['vegetation']} END AS target_rgba,
  {_join(_ramp_sql('change', K.PALETTES['change']))} AS change_rgba, {_join(_ramp_sql('uncertainty', K.PALETTES['uncertainty']))} AS uncertainty_rgba,
  {_join(_SEVSQL)} AS severity_rgba, {_join(_RGBSQL)} AS rgb, coalesce(CAST(floor({_UNIT('(s1_post_vv + 25) / 25')} * 255) AS INTEGER), 0) AS gray,
  CASE task WHEN 'flood' THEN {_QL['flood']} WHEN 'wildfire' THEN {_QL['wildfire']} ELSE {_QL['vegetation']} END AS quicklook
  FROM (SELECT * REPLACE (round(target, 9) AS target, round(change, 9) AS change, round(uncertainty, 9) AS uncertainty) FROM done) d""", "pix")
def q_colors(spark, sf):
    df = results(spark, sf).withColumns({m: F.round(m, 9) for m in ("target", "change", "uncertainty")})
    rgb = colors.true_color(F.col("s2_post_b04"), F.col("s2_post_b03"), F.col("s2_post_b02"))
    df = df.withColumns({"base": rgb, "gray3": colors.sar_gray(F.col("s1_post_vv")), "sev": colors.severity_color(F.col("severity")),
                         "chg": colors.ramp(F.col("change"), K.PALETTES["change"]), "unc": colors.ramp(F.col("uncertainty"), K.PALETTES["uncertainty"])})
    hit = post.threshold_mask(F.col("target"))
    tgt, ql = None, None
    for t, spec in K.TASKS.items():
        here = F.col("task") == t
        a, b = colors.ramp(F.col("target"), colors.probability_stops(spec["target"])), colors.quicklook(F.col("base"), hit, spec["target"])
        tgt, ql = (F.when(here, a), F.when(here, b)) if tgt is None else (tgt.when(here, a), ql.when(here, b))
    df = df.withColumns({"tgt": tgt, "ql": ql})
    flat = lambda name, names: F.concat_ws(",", *[F.col(name)[n].cast("string") for n in names])
    return df.select("pixel_id", "task", flat("tgt", "rgba").alias("target_rgba"), flat("chg", "rgba").alias("change_rgba"),
                     flat("unc", "rgba").alias("uncertainty_rgba"), flat("sev", "rgba").alias("severity_rgba"),
                     flat("base", "rgb").alias("rgb"), F.col("gray3")["r"].alias("gray"), flat("ql", "rgb").alias("quicklook"))


# ------------------------------------------------------------------------------------------ records

def area_requests(spark, sf) -> DataFrame:
    """The searched areas as finished requests."""
    t = F.element_at(F.array(*[F.lit(x) for x in K.TASKS]), (F.col("area_id") % 3 + 1).cast("int"))
    return fixture(spark, sf, "areas").withColumns(
        {
            "request_id": F.col("area_id"), "task": t, "model": F.lit(f"{K.BASELINE_ID}-v{K.BASELINE_VERSION}"),
            "before": F.concat_ws("/", F.col("before_start").cast("string"), F.col("before_end").cast("string")),
            "after": F.concat_ws("/", F.col("after_start").cast("string"), F.col("after_end").cast("string")),
            "crs": F.lit("EPSG:32631"), "resolution": F.lit(10.0),
            "affected_km2": F.col("area_id") * 0.25, "has_severity": t == "wildfire", "created": F.lit("2024-02-01 12:30:00").cast("timestamp"),
            "width": F.col("area_id").cast("int") + 100, "height": F.lit(200), "x0": 500000.0 + F.col("area_id") * 10, "y0": F.lit(4900000.0),
            "coordinates": F.array(F.array(*[F.array(x, y) for x, y in (("w", "s"), ("e", "s"), ("e", "n"), ("w", "n"), ("w", "s"))])),
        })


_TASKSQL = "CASE area_id % 3 WHEN 0 THEN 'flood' WHEN 1 THEN 'wildfire' ELSE 'vegetation' END"


# Both records are read back field by field.
@book.query("provenance_record", f"""WITH {FOUND}, near AS (SELECT *, row_number() OVER (PARTITION BY area_id, sensor, period ORDER BY CASE period WHEN 'pre' THEN -seq ELSE seq END) AS k FROM found WHERE sensor <> 'dem'),
  pick AS (SELECT * FROM near WHERE k <= 4 AND sensor = 's2' AND period = 'post'),
  per AS (SELECT area_id, '[' || string_agg(CAST(scene_id AS VARCHAR), ',' ORDER BY seq) || ']' AS ids, count(*) AS n, arg_min(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), seq) AS first_time, arg_min(cloud, seq) AS first_cloud FROM pick GROUP BY area_id)
  SELECT a.area_id AS request_id, 'threshold-baseline-v1.1.0' AS model, '0.1.0' AS pipeline, {_TASKSQL} AS task, CAST(before_start AS VARCHAR) || '/' || CAST(before_end AS VARCHAR) AS before,
   CAST(after_start AS VARCHAR) || '/' || CAST(after_end AS VARCHAR) AS after, CASE area_id % 3 WHEN 0 THEN 'first' ELSE 'median' END AS post_rule, CASE area_id % 3 WHEN 2 THEN 'spread' ELSE 'closest' END AS scene_rule,
   p.ids, p.first_time, round(p.first_cloud, 6) + 0e0 AS first_cloud, 'EPSG:32631' AS crs, area_id + 100 AS width, 500000e0 + area_id * 10 AS x0, 'fp32' AS inference, '2024-02-01T12:30:00Z' AS created
  FROM areas a LEFT JOIN per p USING (area_id)""", "areas", "scene_catalog")
def q_provenance(spark, sf):
    sel = _closest(spark, sf).withColumnsRenamed({"area_id": "request_id", "scene_rank": "n"}).withColumn("seq", F.col("n"))
    record = post.provenance_record(area_requests(spark, sf), sel)
    g = lambda path, kind="string": F.get_json_object("provenance", path).cast(kind)
    return rounded(record.select(
        "request_id", g("$.model").alias("model"), g("$.dataset_pipeline").alias("pipeline"), g("$.request.task").alias("task"), g("$.request.before").alias("before"), g("$.request.after").alias("after"),
        g("$.compositing.post").alias("post_rule"), g("$.compositing.scenes").alias("scene_rule"), g("$.sensors.s2_post").alias("ids"), g("$.scenes.s2_post[0].datetime").alias("first_time"),
        g("$.scenes.s2_post[0].cloud_cover", "double").alias("first_cloud"), g("$.grid.crs").alias("crs"), g("$.grid.width", "bigint").alias("width"), g("$.grid.x0", "double").alias("x0"),
        g("$.inference_precision").alias("inference"), g("$.created").alias("created")))


@book.query("stac_item_record", f"""SELECT area_id AS request_id, 'Feature' AS type, '1.0.0' AS version, 'https://stac-extensions.github.io/projection/v1.1.0/schema.json' AS extension, 'terradelta-' || {_TASKSQL} || '-' || area_id AS id, {_TASKSQL} AS task,
  before_start || 'T00:00:00Z' AS start_datetime, after_end || 'T23:59:59Z' AS end_datetime, '2024-02-01T12:30:00Z' AS created, area_id * 0.25e0 AS affected_km2, 'Polygon' AS kind, w AS ring_w, n AS ring_n,
  w, n, './' || CASE area_id % 3 WHEN 0 THEN 'flood' WHEN 1 THEN 'burn' ELSE 'disturbance' END || '_probability.tif' AS href, CASE area_id % 3 WHEN 1 THEN './burn_severity.tif' END AS severity_href, '[]' AS links FROM areas""", "areas")
def q_item(spark, sf):
    item = post.stac_item_record(area_requests(spark, sf))
    g = lambda path, kind="string": F.get_json_object("item", path).cast(kind)
    return item.select("request_id", g("$.type").alias("type"), g("$.stac_version").alias("version"), g("$.stac_extensions[0]").alias("extension"), g("$.id").alias("id"), g("$.properties.task").alias("task"),
                       g("$.properties.start_datetime").alias("start_datetime"), g("$.properties.end_datetime").alias("end_datetime"), g("$.properties.created").alias("created"),
                       g("$.properties.affected_km2", "double").alias("affected_km2"), g("$.geometry.type").alias("kind"), g("$.geometry.coordinates[0][0][0]", "double").alias("ring_w"),
                       g("$.geometry.coordinates[0][2][1]", "double").alias("ring_n"), g("$.bbox[0]", "double").alias("w"), g("$.bbox[3]", "double").alias("n"),
                       g("$.assets.classification.href").alias("href"), g("$.assets.severity.href").alias("severity_href"), g("$.links").alias("links"))


@book.query("composite_cache_key", f"""WITH {FOUND}, near AS (SELECT *, row_number() OVER (PARTITION BY area_id, sensor, period ORDER BY CASE period WHEN 'pre' THEN -seq ELSE seq END) AS k FROM found WHERE sensor = 's1'),
  per AS (SELECT area_id, sensor, period, string_agg(CAST(scene_id AS VARCHAR), ',' ORDER BY scene_id) AS ids FROM near WHERE k <= 4 GROUP BY ALL)
  SELECT substr(sha1('{{"version":"0.1.0","p0":"s1","p1":"median","p2":' || area_id || ',"ids":[' || ids || ']}}'), 1, 20) AS cache_key, area_id, sensor, period FROM per""".replace("{{", "{").replace("}}", "}"), "areas", "scene_catalog")
def q_cache(spark, sf):
    """Keys of every selected stack, minus those an earlier run has composited (here: everything optical)."""
    sel = _closest(spark, sf).groupBy("area_id", "sensor", "period").agg(F.collect_list("scene_id").alias("ids"))
    keyed = post.composite_cache_key(sel, F.col("ids"), F.col("sensor"), F.lit("median"), F.col("area_id"))
    return post.not_cached(keyed, keyed.where("sensor = 's2'")).select("cache_key", "area_id", "sensor", "period")
