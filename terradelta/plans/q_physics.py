"""Registered queries of the per-pixel physics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta import constants as K
from terradelta.functions import physics as P
from terradelta.operators import maps as M
from terradelta.plans import sql_physics as S
from terradelta.plans.fixtures import fixture
from terradelta.plans.kit import Book, r6, rounded

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


def pix(spark, sf) -> DataFrame:
    return fixture(spark, sf, "pix")


def evidence(spark, sf) -> DataFrame:
    return M.with_evidence(M.with_indices(pix(spark, sf)))


def all_tasks(df: DataFrame) -> DataFrame:
    """One copy of every pixel per task: each pixel row is exploded into the three tasks, no join."""
    return df.withColumn("task", F.explode(F.array(*[F.lit(t) for t in K.TASKS])))


def task_maps(spark, sf) -> DataFrame:
    return M.with_maps(all_tasks(evidence(spark, sf)), F.col("task"))


@book.query("sigmoid", f"SELECT pixel_id, {r6(S.sig('s1_pre_vv + 9e0') + ' AS p', S.sig('s1_post_vv * 4e0') + ' AS q')} FROM pix", "pix")
def q_sigmoid(spark, sf):
    return rounded(pix(spark, sf).select("pixel_id", P.sigmoid(F.col("s1_pre_vv") + 9).alias("p"),
                                         P.sigmoid(F.col("s1_post_vv") * 4).alias("q")))


@book.query("norm_diff", f"SELECT pixel_id, {r6(S.nd('s2_pre_b08', 's2_post_b08') + ' AS d')} FROM pix", "pix")
def q_norm_diff(spark, sf):
    return rounded(pix(spark, sf).select("pixel_id", P.norm_diff(F.col("s2_pre_b08"), F.col("s2_post_b08")).alias("d")))


def _index(name):
    sql = S.chain() + f" SELECT pixel_id, {r6(f'{name}_pre', f'{name}_post')} FROM ev"

    @book.query(name, sql, "pix")
    def q(spark, sf):
        return rounded(M.with_indices(pix(spark, sf)).select("pixel_id", f"{name}_pre", f"{name}_post"))


for _n in ("mndwi", "ndvi", "nbr"):
    _index(_n)


def _evidence(name, *cols):
    @book.query(name, S.chain() + f" SELECT pixel_id, {r6(*cols)} FROM ev", "pix")
    def q(spark, sf):
        return rounded(evidence(spark, sf).select("pixel_id", *cols))


_evidence("dnbr", "dnbr")
_evidence("water_prob", "water_s1_pre", "water_s1_post", "water_s2_pre", "water_s2_post")
_evidence("vh_drop", "vh_drop")
_evidence("burn_prob", "burn_s2", "vh_drop")
_evidence("disturbance_prob", "disturbance_s2", "vh_drop")
_evidence("change_prob", "change_s1", "change_s2")


@book.query("pre_water", S.chain() + " SELECT pixel_id, coalesce(water_s2_pre, water_s1_pre, 0e0) > 0.8e0 AS water FROM ev", "pix")
def q_pre_water(spark, sf):
    return evidence(spark, sf).select("pixel_id", P.pre_water(F.col("water_s1_pre"), F.col("water_s2_pre")).alias("water"))


@book.query("sensor_mean", S.chain() + f" SELECT pixel_id, {r6(S.mean2('water_s1_post', 'water_s2_post') + ' AS m')} FROM ev", "pix")
def q_sensor_mean(spark, sf):
    return rounded(evidence(spark, sf).select("pixel_id", P.sensor_mean(F.col("water_s1_post"), F.col("water_s2_post")).alias("m")))


@book.query("binary_entropy", S.chain() + f" SELECT pixel_id, {r6(S.entropy('water_s1_post') + ' AS h')} FROM ev", "pix")
def q_entropy(spark, sf):
    return rounded(evidence(spark, sf).select("pixel_id", P.binary_entropy(F.col("water_s1_post")).alias("h")))


@book.query("burn_severity", S.chain() + f" SELECT pixel_id, {S.SEVERITY} AS severity, coalesce({S.SEVERITY}, 255) AS code FROM ev", "pix")
def q_severity(spark, sf):
    sev = P.burn_severity(F.col("dnbr"))
    return evidence(spark, sf).select("pixel_id", sev.alias("severity"), F.coalesce(sev, F.lit(K.IGNORE)).alias("code"))


def _predict(task):
    sql = f"{S.chain()}, maps AS ({S.task_maps(task)}) SELECT pixel_id, {r6('target', 'change', 'uncertainty')}, severity FROM maps"

    @book.query(f"predict_{task}", sql, "pix")
    def q(spark, sf):
        return rounded(M.predict(pix(spark, sf), task).select("pixel_id", "target", "change", "uncertainty", "severity"))


for _t in K.TASKS:
    _predict(_t)

# Requests with an odd id lost their SAR stack, every third one its optical pre stack; where no sensor has both
# periods the change map equals the target.
_PARTIAL = """src AS (SELECT * REPLACE (
  CASE WHEN request_id % 2 = 0 THEN s1_pre_vv END AS s1_pre_vv, CASE WHEN request_id % 2 = 0 THEN s1_pre_vh END AS s1_pre_vh,
  CASE WHEN request_id % 2 = 0 THEN s1_post_vv END AS s1_post_vv, CASE WHEN request_id % 2 = 0 THEN s1_post_vh END AS s1_post_vh,
  CASE WHEN request_id % 3 <> 0 THEN s2_pre_b03 END AS s2_pre_b03, CASE WHEN request_id % 3 <> 0 THEN s2_pre_b04 END AS s2_pre_b04,
  CASE WHEN request_id % 3 <> 0 THEN s2_pre_b08 END AS s2_pre_b08, CASE WHEN request_id % 3 <> 0 THEN s2_pre_b11 END AS s2_pre_b11,
  CASE WHEN request_id % 3 <> 0 THEN s2_pre_b12 END AS s2_pre_b12) FROM pix)"""


@book.query(
    "predict_change",
    f"WITH {_PARTIAL}, {S.IDX.replace('{src}', 'src')}, {S.EV}, maps AS ({S.task_maps('flood')}) SELECT pixel_id, "
    + r6("CASE WHEN request_id % 2 = 0 OR request_id % 3 <> 0 THEN change ELSE target END AS change") + " FROM maps", "pix")
def q_predict_change(spark, sf):
    df = pix(spark, sf)
    has_s1, has_s2_pre = F.col("request_id") % 2 == 0, F.col("request_id") % 3 != 0
    df = df.withColumns(
        {n: F.when(has_s1, F.col(n)) for n in df.columns if n.startswith("s1_")}
        | {n: F.when(has_s2_pre, F.col(n)) for n in df.columns if n.startswith("s2_pre_")})
    return rounded(M.predict(df, "flood", has_pair=has_s1 | has_s2_pre).select("pixel_id", "change"))


_FLOOD_LABEL = """CASE WHEN water_s1_post < 0.1e0 AND water_s2_post < 0.1e0 THEN 0
  WHEN water_s1_post > 0.9e0 AND water_s2_post > 0.9e0 AND water_s1_pre > 0.9e0 AND water_s2_pre > 0.9e0 THEN 0
  WHEN water_s1_post > 0.9e0 AND water_s2_post > 0.9e0 AND water_s1_pre < 0.1e0 AND water_s2_pre < 0.1e0 THEN 1 END"""
_CHANGE_LABEL = "CASE WHEN change_s1 > 0.9e0 AND change_s2 > 0.9e0 THEN 1 WHEN change_s1 < 0.1e0 AND change_s2 < 0.1e0 THEN 0 END"


@book.query("weak_flood_labels", S.chain() + f" SELECT pixel_id, CASE WHEN request_id % 5 <> 4 THEN {_FLOOD_LABEL} END AS label FROM ev", "pix")
def q_weak_flood(spark, sf):
    labelled = M.with_weak_labels(evidence(spark, sf), complete=F.col("request_id") % 5 != 4)
    return labelled.select("pixel_id", F.col("flood_label").alias("label"))


@book.query("weak_change_labels", S.chain() + f" SELECT pixel_id, {_CHANGE_LABEL} AS label FROM ev", "pix")
def q_weak_change(spark, sf):
    return M.with_weak_labels(evidence(spark, sf)).select("pixel_id", F.col("change_label").alias("label"))
