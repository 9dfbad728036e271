"""Registered queries: model inputs, scoring, registry, labels, datasets and evaluation."""

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta import constants as K
from terradelta.operators import evaluate as E
from terradelta.operators import grids as G
from terradelta.operators import labels as L
from terradelta.operators import leakage
from terradelta.operators import maps as M
from terradelta.operators import scoring as X
from terradelta.operators import terrain
from terradelta.plans import sql_physics as S
from terradelta.plans.fixtures import derive, fixture, table
from terradelta.plans.kit import Book, r6, rounded
from terradelta.plans.q_physics import _CHANGE_LABEL, _FLOOD_LABEL, evidence, pix

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
STACKS = [f"{s}_{t}_{b}" for s in K.SENSORS for t in K.PERIODS for b in K.BANDS[s]]


# ------------------------------------------------------------------------------------------ model inputs

def _valid(s, t):
    return "(" + " AND ".join(f"{s}_{t}_{b} IS NOT NULL" for b in K.BANDS[s]) + ")"


_NORM = ", ".join([f"CASE WHEN {_valid(s, t)} THEN ({s}_{t}_{b} - ({m!r})) / {d!r} ELSE 0e0 END AS {s}_{t}_{b}"
                   for s in K.SENSORS for t in K.PERIODS for b, m, d in zip(K.BANDS[s], K.NORM_MEAN[s], K.NORM_STD[s])])
_NORM_R = _NORM.replace("CASE WHEN", "round(CASE WHEN").replace("END AS", "END, 6) + 0e0 AS")
_FLAGS = ", ".join(f"{_valid(s, t)} AS {s}_{t}_valid" for s in K.SENSORS for t in K.PERIODS)


@book.query("normalize_inputs", f"SELECT pixel_id, {_NORM_R}, {_FLAGS} FROM pix", "pix")
def q_norm(spark, sf):
    return rounded(X.normalize_inputs(pix(spark, sf)).select("pixel_id", *STACKS, *[f"{s}_{t}_valid" for s in K.SENSORS for t in K.PERIODS]))


@book.query("denormalize", "SELECT pixel_id, " + ", ".join(f"round(CASE WHEN {_valid(n[:2], n.split('_')[1])} THEN {n} END, 6) + 0e0 AS {n}" for n in STACKS) + " FROM pix", "pix")
def q_denorm(spark, sf):
    return rounded(X.denormalize(X.normalize_inputs(pix(spark, sf))).select("pixel_id", *STACKS))


@book.query("terrain_inputs", f"""SELECT pixel_id, {r6('coalesce((elev - median(elev) OVER (PARTITION BY request_id)) / 20, 0) AS rel_elev', 'coalesce(k / 100e0, 0) AS rel_slope')} FROM pix""", "pix")
def q_terrain(spark, sf):
    px = pix(spark, sf).withColumn("slope", F.col("k") / 10.0)
    return rounded(X.terrain_inputs(px, ["request_id"]).select("pixel_id", "rel_elev", "rel_slope"))


@book.query("sensor_gate", f"""SELECT pixel_id, {r6("CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0.5e0 END AS w_s1", "CASE WHEN a + b > 0 THEN b / (a + b) ELSE 0.5e0 END AS w_s2")} FROM (
  SELECT pixel_id, CASE WHEN {_valid('s1', 'post')} THEN exp((s1_post_vv + 10) / 3) ELSE 0e0 END AS a, CASE WHEN {_valid('s2', 'post')} THEN exp(s2_post_b08 * 4) ELSE 0e0 END AS b FROM pix) x""", "pix")
def q_gate(spark, sf):
    px = X.normalize_inputs(pix(spark, sf))
    raw = X.denormalize(px)
    w = X.sensor_gate({"s1": (F.col("s1_post_vv") + 10) / 3, "s2": F.col("s2_post_b08") * 4}, {"s1": F.col("s1_post_valid"), "s2": F.col("s2_post_valid")})
    return rounded(raw.select("pixel_id", w["s1"].alias("w_s1"), w["s2"].alias("w_s2")))


# ------------------------------------------------------------------------------------------ scoring

TILE, STRIDE = 16, 12


def contrast_scorer(window: pd.DataFrame, k: int) -> pd.DataFrame:
    """A stand-in model: SAR darkness against the window's mean; each pass shifts the threshold and the weights a little."""
    vv = window["s1_post_vv"].fillna(-9.0)
    nir = window["s2_post_b08"].fillna(0.3)
    z = (vv.mean() - vv) / 2 - 0.1 * k
    p = 1 / (1 + (-z).map(math.exp))
    seen = window["s1_post_vv"].notna()
    return pd.DataFrame({"p_target": p, "p_change": (0.5 * p + nir).clip(0, 1), "w_s1": seen * (0.6 - 0.2 * k), "w_s2": 1 - seen * (0.6 - 0.2 * k)})


def grid_sizes(px: DataFrame) -> DataFrame:
    return px.groupBy("request_id").agg((F.max("c") + 1).alias("width"), (F.max("r") + 1).alias("height"))


def scored(spark, sf, each_pass: bool = False) -> DataFrame:
    px = pix(spark, sf)
    return X.score_tiles(px, grid_sizes(px), "request_id", contrast_scorer, ["s1_post_vv", "s2_post_b08"], TILE, STRIDE, passes=2, each_pass=each_pass)


def _win(n, size, stride):
    return f"SELECT request_id, unnest(CASE WHEN {n} <= {size} THEN [0] ELSE list_append(range(0, {n} - {size}, {stride}), {n} - {size}) END) AS o FROM gs"


SCORED = f"""gs AS (SELECT request_id, max(c) + 1 AS width, max(r) + 1 AS height FROM pix GROUP BY ALL), wr AS ({_win('height', TILE, STRIDE)}), wc AS ({_win('width', TILE, STRIDE)}),
  pw AS (SELECT p.*, wr.o AS win_r, wc.o AS win_c, coalesce(s1_post_vv, -9e0) AS vv, coalesce(s2_post_b08, 0.3e0) AS nir FROM pix p JOIN wr ON wr.request_id = p.request_id AND p.r >= wr.o AND p.r < wr.o + {TILE}
         JOIN wc ON wc.request_id = p.request_id AND p.c >= wc.o AND p.c < wc.o + {TILE}),
  pm AS (SELECT *, avg(vv) OVER (PARTITION BY request_id, win_r, win_c) AS m FROM pw),
  ps AS (SELECT pm.*, k.pass, 1 / (1 + exp(-((m - vv) / 2 - 0.1e0 * k.pass))) AS p_target, CASE WHEN s1_post_vv IS NOT NULL THEN 0.6e0 - 0.2e0 * k.pass ELSE 0e0 END AS w_s1 FROM pm, (VALUES (0), (1)) k(pass)),
  sc AS (SELECT request_id, win_r, win_c, r, c, avg(p_target) AS p_target, avg(greatest(least(0.5e0 * p_target + nir, 1e0), 0e0)) AS p_change,
         max(w_s1) FILTER (WHERE pass = 0) AS w_s1, max(1 - w_s1) FILTER (WHERE pass = 0) AS w_s2 FROM ps GROUP BY request_id, win_r, win_c, r, c),
  bl AS (SELECT request_id, r, c, avg(p_target) AS target, avg(p_change) AS change, avg(w_s1) AS w_s1, avg(w_s2) AS w_s2 FROM sc GROUP BY ALL),
  fin AS (SELECT bl.request_id, bl.r, bl.c, o.observed, CASE WHEN observed THEN target END AS target, CASE WHEN observed THEN change END AS change, w_s1, w_s2
          FROM bl JOIN (SELECT request_id, r, c, {_valid('s1', 'post')} OR {_valid('s2', 'post')} AS observed FROM pix) o USING (request_id, r, c))"""


@book.query("score_tiles", f"WITH {SCORED} SELECT request_id, CAST(win_r AS INTEGER) AS win_r, CAST(win_c AS INTEGER) AS win_c, pass, r, c, {r6('p_target', 'greatest(least(0.5e0 * p_target + nir, 1e0), 0e0) AS p_change', 'w_s1', '1 - w_s1 AS w_s2')} FROM ps", "pix")
def q_score(spark, sf):
    return rounded(scored(spark, sf, each_pass=True))


@book.query("blend_windows", f"WITH {SCORED} SELECT request_id, r, c, {r6('target', 'change', 'w_s1', 'w_s2')} FROM bl", "pix")
def q_blend(spark, sf):
    return rounded(X.blend_windows(scored(spark, sf), "request_id"))


def finished(spark, sf) -> DataFrame:
    return X.finish_scores(X.blend_windows(scored(spark, sf), "request_id"), pix(spark, sf), "request_id")


@book.query("mc_mean_uncertainty", f"WITH {SCORED} SELECT request_id, r, c, {r6('target', S.entropy('target') + ' AS uncertainty')} FROM fin", "pix")
def q_mc(spark, sf):
    return rounded(finished(spark, sf).select("request_id", "r", "c", "target", "uncertainty"))


@book.query("modality_weights", f"WITH {SCORED} SELECT request_id, {r6('avg(CASE WHEN observed THEN w_s1 END) AS s1', 'avg(CASE WHEN observed THEN w_s2 END) AS s2')} FROM fin GROUP BY ALL", "pix")
def q_weights(spark, sf):
    return rounded(X.modality_weights(finished(spark, sf), ["request_id"]))


@book.query("score_dispatch", f"{S.chain()}, maps AS ({S.task_maps('wildfire')}), mc AS (SELECT * FROM (VALUES (0)) z(zero)), {SCORED} "
            f"""SELECT request_id, r, c, 'threshold-baseline' AS model_id, {r6('target', 'uncertainty')}, severity FROM maps WHERE request_id % 2 = 0
  UNION ALL SELECT f.request_id, f.r, f.c, 'contrast', {r6('f.target AS target', S.entropy('f.target') + ' AS uncertainty')}, m.severity FROM fin f JOIN maps m ON m.request_id = f.request_id AND m.r = f.r AND m.c = f.c WHERE f.request_id % 2 = 1""", "pix")
def q_dispatch(spark, sf):
    px = pix(spark, sf).withColumn("model_id", F.when(F.col("request_id") % 2 == 0, K.BASELINE_ID).otherwise("contrast"))
    cols = ["request_id", "r", "c", "model_id", "target", "uncertainty", "severity"]

    def physics(df):
        return M.predict(df, "wildfire").select(*cols)

    def model(df):
        s = X.score_tiles(df, grid_sizes(df), "request_id", contrast_scorer, ["s1_post_vv", "s2_post_b08"], TILE, STRIDE, passes=2)
        done = X.finish_scores(X.blend_windows(s, "request_id"), df, "request_id")
        # Severity classes stay physical: they come from the burn ratio whatever the model.
        sev = M.predict(df, "wildfire").select("request_id", "r", "c", "model_id", "severity")
        return done.select("request_id", "r", "c", "target", "uncertainty").join(sev, ["request_id", "r", "c"]).select(*cols)

    return rounded(X.score_dispatch(px, F.col("model_id"), physics, model))


# ------------------------------------------------------------------------------------------ registry

# Trained cards: one per part, for one or two tasks, dated by size.
CARDS = """SELECT 'm' || CAST(p_partkey AS VARCHAR(20)) AS model_id, CAST(p_size AS VARCHAR(4)) || '.0' AS version, TIMESTAMP '2024-01-01 00:00:00' AS base, p_size, p_partkey, p_retailprice FROM {part}"""


def cards(spark, sf) -> DataFrame:
    tasks = F.array_compact(F.array(*[F.when((F.col("p_partkey") % (i + 2)) == 0, F.lit(t)) for i, t in enumerate(K.TASKS)]))
    return derive(spark, sf, CARDS).select(
        "model_id", "version", tasks.alias("tasks"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=F.col("p_size"))).alias("created"),
        F.create_map(*[x for t in K.TASKS for x in (F.lit(t), F.create_map(F.lit("s1+s2"), F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice") / 2500)))]).alias("metrics"))


_CARDTASK = " OR ".join(f"(t = '{t}' AND p_partkey % {i + 2} = 0)" for i, t in enumerate(K.TASKS))
CARDS_CTE = f"""cards AS (SELECT 'm' || p_partkey AS model_id, p_size || '.0' AS version, p_partkey, p_size, p_retailprice FROM part),
  ct AS (SELECT cards.*, t FROM cards, (VALUES ('flood'), ('wildfire'), ('vegetation')) x(t) WHERE {_CARDTASK})"""


@book.query("model_registry", f"WITH {CARDS_CTE} SELECT CAST(row_number() OVER (ORDER BY base DESC, p_size DESC, model_id, version) AS BIGINT) AS position, model_id, version FROM (SELECT model_id, version, p_size, 0 AS base FROM cards UNION ALL SELECT 'threshold-baseline', '1.1.0', NULL, 1) u".replace("base DESC, p_size DESC", "base DESC, p_size DESC NULLS LAST"))
def q_registry(spark, sf):
    return X.model_registry(cards(spark, sf)).select("position", "model_id", "version")


@book.query("resolve_model", f"""WITH {CARDS_CTE}, rq AS (SELECT request_id, task, CASE request_id % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'threshold-baseline' WHEN 2 THEN 'm' || (request_id % 300) WHEN 3 THEN 'm' || (request_id % 300) || '-v' || (request_id % 50 + 1) || '.0' ELSE 'nope' END AS model FROM requests),
  au AS (SELECT t, arg_min(model_id, (-p_size, model_id, version)) AS model_id, arg_min(version, (-p_size, model_id, version)) AS version FROM (SELECT t, p_size, model_id, version FROM ct) q GROUP BY t)
  SELECT rq.request_id, rq.model, CASE WHEN rq.model = 'auto' THEN CASE WHEN rq.task <> 'landslide' THEN coalesce(au.model_id, 'threshold-baseline') END WHEN rq.model = 'threshold-baseline' AND rq.task <> 'landslide' THEN 'threshold-baseline' ELSE ct.model_id END AS model_id,
    CASE WHEN rq.model = 'auto' THEN CASE WHEN rq.task <> 'landslide' THEN coalesce(au.version, '1.1.0') END WHEN rq.model = 'threshold-baseline' AND rq.task <> 'landslide' THEN '1.1.0' ELSE ct.version END AS version
  FROM rq LEFT JOIN au ON au.t = rq.task LEFT JOIN ct ON ct.t = rq.task AND (rq.model = ct.model_id OR rq.model = ct.model_id || '-v' || ct.version)""".replace("(-p_size, model_id, version)", "row(-p_size, model_id, version)"), "requests")
def q_resolve(spark, sf):
    rid = F.col("request_id")
    base = F.concat(F.lit("m"), (rid % 300).cast("string"))
    model = (F.when(rid % 5 == 0, "auto").when(rid % 5 == 1, K.BASELINE_ID).when(rid % 5 == 2, base)
             .when(rid % 5 == 3, F.concat(base, F.lit("-v"), (rid % 50 + 1).cast("string"), F.lit(".0"))).otherwise("nope"))
    rq = fixture(spark, sf, "requests").select("request_id", "task", model.alias("model"))
    return X.resolve_model(rq, cards(spark, sf)).select("request_id", "model", "model_id", "version")


@book.query("model_leaderboard", f"""WITH {CARDS_CTE} SELECT model_id, version, t AS task, {r6('p_retailprice / 2500 AS iou')} FROM cards, (VALUES ('flood'), ('wildfire'), ('vegetation')) x(t) WHERE p_size % 3 <> 0""")
def q_leaderboard(spark, sf):
    return rounded(E.model_leaderboard(cards(spark, sf)))


@book.query("fit_pixel_classifier")
def q_fit(spark, sf):
    """Learn the consensus flood label from normalised bands, then score every pixel."""
    px = M.with_weak_labels(evidence(spark, sf)).withColumn("flood_label", F.col("flood_label").cast("double"))
    px = X.normalize_inputs(px)
    model = X.fit_pixel_classifier(px, STACKS, "flood_label")
    out = model.transform(px.drop("flood_label"))
    from pyspark.ml.functions import vector_to_array

    return out.select("pixel_id", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6).alias("p"))


# ------------------------------------------------------------------------------------------ labels

_SEV, _LOSS, _COVER, _RAST = "CASE WHEN k % 8 < 7 THEN k % 8 END", "CASE WHEN k % 10 = 9 THEN NULL ELSE k % 25 END", "(pixel_id * 13) % 101", "CASE WHEN k % 6 = 5 THEN NULL WHEN k % 6 = 4 THEN 255 ELSE k % 2 END"


def label_px(spark, sf) -> DataFrame:
    """Pixels with the rasters every label source needs; the source goes by request."""
    e = M.with_weak_labels(evidence(spark, sf))
    src = F.element_at(F.array(*[F.lit(x) for x in (None, "mtbs", "hansen", "raster")]), (F.col("request_id") % 4 + 1).cast("int"))
    return e.withColumns({"sev": F.expr(_SEV), "loss": F.expr(_LOSS), "cover": F.expr(_COVER), "rast": F.expr(_RAST), "source": src,
                          "task": F.lit("flood"), "year": F.lit(2020), "width": F.lit(100), "height": F.lit(20)})


@book.query("mtbs_labels", f"SELECT pixel_id, CASE WHEN sev IS NULL OR sev = 5 THEN 0 WHEN sev BETWEEN 2 AND 4 THEN 1 END AS label FROM (SELECT pixel_id, {_SEV} AS sev FROM pix) x", "pix")
def q_mtbs(spark, sf):
    return pix(spark, sf).select("pixel_id", L.mtbs_labels(F.expr(_SEV)).alias("label"))


@book.query("hansen_labels", f"SELECT pixel_id, CASE WHEN loss = 20 THEN 1 WHEN loss = 0 AND cover >= 30 THEN 0 END AS label FROM (SELECT pixel_id, {_LOSS} AS loss, {_COVER} AS cover FROM pix) x", "pix")
def q_hansen(spark, sf):
    return pix(spark, sf).select("pixel_id", L.hansen_labels(F.expr(_LOSS), F.expr(_COVER), F.lit(2020)).alias("label"))


@book.query("raster_labels", f"SELECT pixel_id, CASE WHEN v <> 255 THEN CAST(v AS INTEGER) END AS label FROM (SELECT pixel_id, {_RAST} AS v FROM pix) x", "pix")
def q_raster(spark, sf):
    return pix(spark, sf).select("pixel_id", L.raster_labels(F.expr(_RAST)).alias("label"))


@book.query("gfc_tile_names", """SELECT event_id, array_to_string(list_sort(list_distinct(flatten([[
   lpad(abs(t)::VARCHAR, 2, '0') || CASE WHEN t >= 0 THEN 'N' ELSE 'S' END || '_' || lpad(abs(l)::VARCHAR, 3, '0') || CASE WHEN l >= 0 THEN 'E' ELSE 'W' END
     FOR l IN range(CAST(floor(w / 10) * 10 AS BIGINT), CAST(floor(e / 10) * 10 AS BIGINT) + 1, 10)]
     FOR t IN range(CAST(ceil(s / 10) * 10 AS BIGINT), CAST(ceil(n / 10) * 10 AS BIGINT) + 1, 10)]))), ',') AS tiles
  FROM (SELECT request_id AS event_id, lon - half_lon * 400 AS w, lon + half_lon * 400 AS e, lat - half_lat * 200 AS s, lat + half_lat * 200 AS n FROM requests) x""", "requests")
def q_gfc(spark, sf):
    c = F.col
    names = L.gfc_tile_names(c("lon") - c("half_lon") * 400, c("lat") - c("half_lat") * 200, c("lon") + c("half_lon") * 400, c("lat") + c("half_lat") * 200)
    return fixture(spark, sf, "requests").select(c("request_id").alias("event_id"), F.array_join(names, ",").alias("tiles"))


@book.query("gfc_mosaic", """SELECT l_orderkey AS cell, max(loss) FILTER (k = 1) AS loss FROM (SELECT l_orderkey, loss, row_number() OVER (PARTITION BY l_orderkey ORDER BY loss IS NULL, tile, loss) AS k FROM (
  SELECT l_orderkey, lpad(CAST(l_suppkey AS VARCHAR), 8, '0') || '_' || CAST(l_partkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) || '_' || strftime(l_shipdate, '%Y%m%d') AS tile, CASE WHEN l_tax > 0.03 THEN CAST(l_quantity AS INTEGER) END AS loss FROM lineitem) y) x GROUP BY 1""")
def q_gfc_mosaic(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("cell"), F.concat_ws("_", F.lpad(F.col("l_suppkey").cast("string"), 8, "0"), F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"), F.date_format("l_shipdate", "yyyyMMdd")).alias("tile"),
        F.when(F.col("l_tax") > 0.03, F.col("l_quantity").cast("int")).alias("loss"))
    return L.gfc_mosaic(li, ["cell"], "loss")


LABELS = f"""lab AS (SELECT pixel_id, request_id, r, c, CASE request_id % 4 WHEN 0 THEN {_FLOOD_LABEL} WHEN 1 THEN CASE WHEN sev IS NULL OR sev = 5 THEN 0 WHEN sev BETWEEN 2 AND 4 THEN 1 END
    WHEN 2 THEN CASE WHEN loss = 20 THEN 1 WHEN loss = 0 AND cover >= 30 THEN 0 END ELSE CASE WHEN rast <> 255 THEN CAST(rast AS INTEGER) END END AS label, {_CHANGE_LABEL} AS change_label,
    CASE request_id % 4 WHEN 0 THEN 'weak:s1+s2-consensus' WHEN 1 THEN 'mtbs:2020' WHEN 2 THEN 'hansen:2020' ELSE 'raster:/labels/' || request_id || '.tif' END AS label_source
  FROM (SELECT *, {_SEV} AS sev, {_LOSS} AS loss, {_COVER} AS cover, {_RAST} AS rast FROM ev) e)"""


def labelled(spark, sf) -> DataFrame:
    c = F.col
    return L.task_labels(label_px(spark, sf), c("source"), c("task"), c("flood_label"), c("sev"), c("loss"), c("cover"), c("rast"), c("year"), F.concat(F.lit("/labels/"), c("request_id").cast("string"), F.lit(".tif")))


@book.query("task_labels", f"{S.chain()}, {LABELS} SELECT pixel_id, label, change_label, label_source FROM lab", "pix")
def q_task_labels(spark, sf):
    return labelled(spark, sf).select("pixel_id", "label", "change_label", "label_source")


@book.query("expand_labels", f"""{S.chain()}, {LABELS} SELECT pixel_id, CASE WHEN request_id % 3 = 0 THEN label END AS y0, CASE WHEN request_id % 3 = 1 THEN label END AS y1, CASE WHEN request_id % 3 = 2 THEN label END AS y2, change_label AS y3 FROM lab""", "pix")
def q_expand(spark, sf):
    t = F.element_at(F.array(*[F.lit(x) for x in K.TASKS]), (F.col("request_id") % 3 + 1).cast("int"))
    df = labelled(spark, sf).withColumn("y", L.expand_labels(t, F.col("label"), F.col("change_label")))
    return df.select("pixel_id", *[F.get("y", F.lit(i)).alias(f"y{i}") for i in range(4)])


LT = 16
_LW = f"""wl AS (SELECT lab.*, a.o AS win_r, b.o AS win_c FROM lab, unnest(list_append(range(0, 20 - {LT}, {LT}), 20 - {LT})) a(o), unnest(list_append(range(0, 100 - {LT}, {LT}), 100 - {LT})) b(o)
  WHERE r >= a.o AND r < a.o + {LT} AND c >= b.o AND c < b.o + {LT}),
  ts AS (SELECT request_id, win_r, win_c, avg((label IS NOT NULL)::INT) AS labeled_fraction, avg(label) AS positive_fraction, count(*) AS pixels FROM wl GROUP BY ALL HAVING avg((label IS NOT NULL)::INT) >= 0.02)"""


@book.query("tile_label_stats", f"{S.chain()}, {LABELS}, {_LW} SELECT request_id, CAST(win_r AS INTEGER) AS win_r, CAST(win_c AS INTEGER) AS win_c, {r6('labeled_fraction', 'positive_fraction')}, pixels FROM ts", "pix")
def q_tile_stats(spark, sf):
    return rounded(L.tile_label_stats(labelled(spark, sf), "request_id", LT))


EVENT_STATS = """es AS (SELECT l.request_id, l.labeled_fraction, l.positive_fraction, coalesce(t.tiles, 0) AS tiles FROM (SELECT request_id, avg((label IS NOT NULL)::INT) AS labeled_fraction, avg(label) AS positive_fraction FROM lab GROUP BY ALL) l
  LEFT JOIN (SELECT request_id, count(*) AS tiles FROM ts GROUP BY ALL) t USING (request_id))"""


def event_stats(spark, sf) -> DataFrame:
    px = labelled(spark, sf)
    return L.event_label_stats(px, L.tile_label_stats(px, "request_id", LT), "request_id")


@book.query("event_label_stats", f"{S.chain()}, {LABELS}, {_LW}, {EVENT_STATS} SELECT request_id, tiles, {r6('labeled_fraction', 'positive_fraction')} FROM es", "pix")
def q_event_stats(spark, sf):
    return rounded(event_stats(spark, sf))


@book.query("dataset_index", f"""{S.chain()}, {LABELS}, {_LW}, {EVENT_STATS} SELECT 'demo' AS dataset, '1' AS version, 'flood' AS task, '0.1.0' AS pipeline, {LT} AS tile, es.request_id, split, w, s, e, n, tiles,
  {r6('labeled_fraction', 'positive_fraction', digits=4)} FROM es JOIN manifest_events m ON m.event_id = es.request_id + 1""", "pix", "manifest_events")
def q_index(spark, sf):
    ev = fixture(spark, sf, "manifest_events").withColumn("request_id", (F.col("event_id") - 1).cast("int")).drop("event_id")
    return rounded(L.dataset_index(ev, rounded(event_stats(spark, sf), 9), "demo", "1", "flood", LT, "request_id"), 4)


@book.query("load_tiles", f"""{S.chain()}, {LABELS} SELECT pixel_id, split, CASE WHEN request_id % 3 = 0 THEN label END AS y0, CASE WHEN request_id % 3 = 1 THEN label END AS y1, change_label AS y_change,
  CASE WHEN request_id % 3 = 2 THEN 'not a task of this model: vegetation' END AS error FROM (SELECT *, CASE request_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split FROM lab) l WHERE split IN ('train', 'val')""".replace("change_label AS y_change", "CASE WHEN request_id % 3 <> 2 THEN change_label END AS y_change"), "pix")
def q_load_tiles(spark, sf):
    t = F.element_at(F.array(*[F.lit(x) for x in K.TASKS]), (F.col("request_id") % 3 + 1).cast("int"))
    split = F.when(F.col("request_id") % 5 == 3, "val").when(F.col("request_id") % 5 == 4, "test").otherwise("train")
    df = labelled(spark, sf).withColumns({"split": split, "ds_task": t})
    out = L.load_tiles(df, ["train", "val"], F.col("ds_task"), ("flood", "wildfire"))
    return out.select("pixel_id", "split", F.get("y", F.lit(0)).alias("y0"), F.get("y", F.lit(1)).alias("y1"), F.get("y", F.lit(2)).alias("y_change"), "error")


@book.query("audit_duplicates", "SELECT s_nationkey AS event_id, count(*) AS times FROM supplier GROUP BY 1 HAVING count(*) > 1")
def q_dupes(spark, sf):
    return L.audit_duplicates(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("event_id")), "event_id")


@book.query("audit_leakage", """SELECT a.event_id, a.split, min(b.event_id) AS conflict_id FROM manifest_events a JOIN manifest_events b ON a.split <> b.split AND a.w < b.e AND b.w < a.e AND a.s < b.n AND b.s < a.n GROUP BY ALL""", "manifest_events")
def q_leakage(spark, sf):
    return leakage.audit_leakage(fixture(spark, sf, "manifest_events"), "event_id")


# ------------------------------------------------------------------------------------------ evaluation

@book.query("restrict_sensors", f"""SELECT pixel_id, subset, {r6(*[f"CASE WHEN subset <> 's2 only' THEN {n} END AS {n}" if n.startswith('s1') else f"CASE WHEN subset <> 's1 only' THEN {n} END AS {n}" for n in ('s1_pre_vv', 's1_post_vh', 's2_pre_b08', 's2_post_b12')])}
  FROM pix, (VALUES ('s1+s2'), ('s1 only'), ('s2 only')) s(subset)""", "pix")
def q_restrict(spark, sf):
    df = M.restrict_sensors(E.explode_subsets(pix(spark, sf)), F.col("sensors"))
    return rounded(df.select("pixel_id", "subset", "s1_pre_vv", "s1_post_vh", "s2_pre_b08", "s2_post_b12"))


_DRAW = lambda seed: f"(('0x' || substr(md5('{seed}/' || request_id || '/' || tile_r || '/' || tile_c), 1, 8))::BIGINT / 4294967296e0)"


@book.query("sensor_dropout", f"""WITH t AS (SELECT request_id, CAST(floor(c / 16e0) AS BIGINT) AS tile_c, CAST(floor(r / 16e0) AS BIGINT) AS tile_r, bool_or(s1_post_vv IS NOT NULL) AS has_s1, bool_or(s2_post_b08 IS NOT NULL) AS has_s2 FROM pix GROUP BY ALL),
  d AS (SELECT *, has_s1 AND {_DRAW(0)} < 0.3 AS d1, has_s2 AND {_DRAW(1)} < 0.5 AS d2 FROM t)
  SELECT request_id, tile_c, tile_r, has_s1, has_s2, NOT (d1 AND (has_s1 AND NOT d1 OR has_s2 AND NOT d2)) AS keep_s1, NOT (d2 AND (has_s1 AND NOT d1 OR has_s2 AND NOT d2)) AS keep_s2 FROM d""", "pix")
def q_dropout(spark, sf):
    tiles = pix(spark, sf).groupBy("request_id", F.floor(F.col("c") / 16).alias("tile_c"), F.floor(F.col("r") / 16).alias("tile_r")).agg(
        F.max(F.col("s1_post_vv").isNotNull()).alias("has_s1"), F.max(F.col("s2_post_b08").isNotNull()).alias("has_s2"))
    return E.sensor_dropout(tiles, F.concat_ws("/", *[F.col(c).cast("string") for c in ("request_id", "tile_r", "tile_c")]), {"s1": 0.3, "s2": 0.5})


@book.query("augment_tiles", """SELECT pixel_id, CAST(nr AS INTEGER) AS r, CAST(CASE WHEN flip THEN 19 - nc ELSE nc END AS INTEGER) AS c FROM (
  SELECT pixel_id, k % 2 = 1 AS flip, CASE t WHEN 0 THEN r WHEN 1 THEN 19 - c WHEN 2 THEN 19 - r ELSE c END AS nr, CASE t WHEN 0 THEN c WHEN 1 THEN r WHEN 2 THEN 19 - c ELSE 19 - r END AS nc
  FROM (SELECT pixel_id, request_id, r, c % 20 AS c, c // 20 % 4 AS t, request_id AS k FROM pix) a) b""", "pix")
def q_augment(spark, sf):
    """Square chips of 20 x 20 cut from the strips, each turned by its position and flipped in odd requests."""
    col = (F.col("c") % 20).cast("int")
    turns = (F.floor(F.col("c") / 20) % 4).cast("int")
    r, c = E.augment(F.col("r"), col, 20, turns, F.col("request_id") % 2 == 1)
    return pix(spark, sf).select("pixel_id", r.cast("int").alias("r"), c.cast("int").alias("c"))


def logit_rows(spark, sf) -> DataFrame:
    p = fixture(spark, sf, "predictions")
    return p.withColumn("z", F.log(F.col("p") / (1 - F.col("p"))))


_BCE = lambda z, y: f"(greatest({z}, 0e0) - {z} * {y} + ln(1 + exp(-abs({z}))))"
_LOSS_CH = lambda z, y: f"(avg({_BCE(z, y)}) + 1 - (2 * sum({S.sig(z)} * {y}) + 1) / (sum(CASE WHEN {y} IS NOT NULL THEN {S.sig(z)} END) + sum({y}) + 1))"


@book.query("masked_loss", f"""SELECT event, {r6(f"coalesce({_LOSS_CH('z', 'ya')}, 0) + coalesce({_LOSS_CH('zb', 'yb')}, 0) + coalesce(0.5e0 * avg({_BCE('zc', 'yc')}), 0) AS loss")} FROM (
  SELECT *, ln(p / (1 - p)) AS z, -ln(p / (1 - p)) / 2 AS zb, ln(p / (1 - p)) * 2 AS zc, y * 1e0 AS ya, CASE WHEN px % 3 = 0 THEN y * 1e0 END AS yb, CASE WHEN px % 4 <> 0 THEN y_change * 1e0 END AS yc FROM predictions) x GROUP BY event""", "predictions")
def q_loss(spark, sf):
    px = F.col("px")
    df = logit_rows(spark, sf).withColumns(
        {"z_a": F.col("z"), "z_b": -F.col("z") / 2, "z_change": F.col("z") * 2, "y_a": F.col("y"), "y_b": F.when(px % 3 == 0, F.col("y")), "y_change": F.when(px % 4 != 0, F.col("y_change"))})
    return rounded(E.masked_loss(df, ["a", "b"], "change", ["event"]))


def _metric_sql(src, keys):
    by = f"{keys}, " if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    join = f"USING ({keys})" if keys else "ON true"
    return f"""m AS (SELECT {by} sum((p >= 0.5 AND y = 1)::INT)::DOUBLE AS tp, sum((p >= 0.5 AND y = 0)::INT)::DOUBLE AS fp, sum((p < 0.5 AND y = 1)::INT)::DOUBLE AS fn, avg((p - y) * (p - y)) AS brier, count(*) AS pixels, avg(y) AS positive_fraction FROM {src} {grp}),
  b AS (SELECT {by} least(CAST(floor(p * 15) AS INT), 14) AS bin, avg(p) AS mp, avg(y) AS my, count(*) AS k FROM {src} GROUP BY ALL),
  ec AS (SELECT {by} sum(abs(mp - my) * k) / sum(k) AS ece FROM b {grp}),
  f AS (SELECT m.*, ec.ece, tp / nullif(tp + fp + fn, 0) AS iou, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM m JOIN ec {join}),
  mt AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM f)"""


_M7 = ("iou", "f1", "precision", "recall", "brier", "ece", "positive_fraction")


@book.query("segmentation_metrics", f"WITH {_metric_sql('predictions', 'event')} SELECT event, {r6(*_M7)}, pixels FROM mt", "predictions")
def q_metrics(spark, sf):
    return rounded(E.segmentation_metrics(fixture(spark, sf, "predictions"), ["event"]))


@book.query("ece", f"SELECT CAST(bin AS BIGINT) AS bin, {r6('mp AS mean_p', 'my AS mean_y')}, pixels FROM (SELECT least(floor(p * 15), 14) AS bin, avg(p) AS mp, avg(y) AS my, count(*) AS pixels FROM predictions GROUP BY ALL) b", "predictions")
def q_ece(spark, sf):
    return rounded(E.ece_bins(fixture(spark, sf, "predictions")))


@book.query("collect_labelled", f"SELECT doc_id, quality AS y, {r6('1 / (1 + exp(-((doc_id % 1000) / 250e0 - 2))) AS p')} FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def q_collect(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", (1 / (1 + F.exp(-((F.col("doc_id") % 1000) / 250.0 - 2)))).alias("p"))
    return rounded(E.collect_labelled(p, table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id").select("doc_id", "y", "p"))


def subset_predictions(spark, sf) -> DataFrame:
    """Single-sensor predictions are less sure than those of both sensors."""
    sub = F.col("subset")
    p = F.when(sub == "s1+s2", F.col("p")).when(sub == "s1 only", 0.2 + 0.6 * F.col("p")).otherwise(0.3 * F.col("p") + 0.4)
    return E.explode_subsets(fixture(spark, sf, "predictions")).withColumn("p", p)


_SUBP = "sp AS (SELECT event, y, subset, CASE subset WHEN 's1+s2' THEN p WHEN 's1 only' THEN 0.2e0 + 0.6e0 * p ELSE 0.3e0 * p + 0.4e0 END AS p FROM predictions, (VALUES ('s1+s2'), ('s1 only'), ('s2 only')) s(subset))"
MATRIX = f"""per AS (WITH {_metric_sql('sp', 'subset, event')} SELECT subset, event, {', '.join(_M7)}, pixels FROM mt), pool AS (WITH {_metric_sql('sp', 'subset')} SELECT subset, {', '.join(_M7)}, pixels FROM mt),
  mx AS (SELECT subset, event, {', '.join(_M7)}, pixels, NULL::DOUBLE AS event_mean_iou FROM per UNION ALL SELECT subset, NULL, {', '.join('pool.' + c for c in _M7)}, pool.pixels, (SELECT avg(iou) FROM per WHERE per.subset = pool.subset) FROM pool)"""


@book.query("robustness_matrix", f"WITH {_SUBP}, {MATRIX} SELECT subset, event, {r6(*_M7, 'event_mean_iou')}, pixels FROM mx", "predictions")
def q_matrix(spark, sf):
    return rounded(E.robustness_matrix(subset_predictions(spark, sf)))


@book.query("eval_report", f"WITH {_SUBP}, {MATRIX} SELECT subset, {r6('iou', 'f1', 'precision', 'recall', 'ece', 'brier', 'event_mean_iou', digits=4)} FROM mx WHERE event IS NULL", "predictions")
def q_report(spark, sf):
    return rounded(E.eval_report(E.robustness_matrix(subset_predictions(spark, sf))), 4)


_BT = S.chain("restricted") + ", maps AS (" + S.task_maps("vegetation") + ")"


@book.query("baseline_scores", f"WITH {S.IDX.replace('{src}', 'restricted')}, ".replace("WITH ", "WITH restricted AS (SELECT pixel_id, request_id, r, c, " + ", ".join(
    f"CASE WHEN {_valid(n[:2], n.split('_')[1])} THEN {n} END AS {n}" for n in STACKS) + " FROM pix), ", 1) + S.EV + f", maps AS ({S.task_maps('vegetation')}) SELECT pixel_id, round(coalesce(target, 0), 6) + 0e0 AS p FROM maps", "pix")
def q_baseline(spark, sf):
    return rounded(X.baseline_tile_scores(X.normalize_inputs(pix(spark, sf)), "vegetation").select("pixel_id", "p"))


_TEMPS = ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(E.temperatures()))


@book.query("fit_temperature", f"""WITH t AS (SELECT * FROM (VALUES {_TEMPS}) v(i, t)), n AS (SELECT i, t, avg({_BCE('(z / t)', 'y')}) AS nll FROM (SELECT ln(p / (1 - p)) * 1.7e0 AS z, y FROM predictions) p, t GROUP BY ALL)
  SELECT round(t, 9) AS temperature, round(nll, 9) AS nll FROM n ORDER BY n.nll, i LIMIT 1""", "predictions")
def q_temperature(spark, sf):
    return rounded(E.fit_temperature(logit_rows(spark, sf).withColumn("z", F.col("z") * 1.7)), 9)
