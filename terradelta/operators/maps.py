"""Physics maps over a wide pixel table (columns ``{sensor}_{period}_{band}``).

Work is staged in layers (indices, sensor evidence, maps) so that every layer refers to plain columns of the one
before: each expression is evaluated once and the whole chain stays one code-generated projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta import constants as K
from terradelta.functions import physics as P



def _bands(df: DataFrame, *names: str) -> list[Column]:
    """Band columns, NULL where the table has no such stack (the table's columns are looked up once)."""
    have = set(df.columns)
    return [F.col(n) if n in have else F.lit(None).cast("double") for n in names]


def with_indices(df: DataFrame) -> DataFrame:
    """Add mndwi/ndvi/nbr per period and their differences (post - pre), plus dNBR (pre - post)."""
    per, need = {}, ("b03", "b04", "b08", "b11", "b12")
    found = _bands(df, *[f"s2_{t}_{x}" for t in K.PERIODS for x in need])
    for i, t in enumerate(K.PERIODS):
        b = dict(zip(need, found[i * len(need):]))
        per[f"mndwi_{t}"] = P.mndwi(b["b03"], b["b11"])
        per[f"ndvi_{t}"] = P.ndvi(b["b08"], b["b04"])
        per[f"nbr_{t}"] = P.nbr(b["b08"], b["b12"])
    df = df.withColumns(per)
    return df.withColumns({"dnbr": F.col("nbr_pre") - F.col("nbr_post")})


def with_evidence(df: DataFrame) -> DataFrame:
    """Add per-sensor probabilities: water (pre, post), burn, disturbance and generic change."""
    vv0, vv1, vh0, vh1 = _bands(df, "s1_pre_vv", "s1_post_vv", "s1_pre_vh", "s1_post_vh")
    c = F.col
    return df.withColumns(
        {
            "water_s1_pre": P.sar_water(vv0),
            "water_s1_post": P.sar_water(vv1, vv0),
            "water_s2_pre": P.optical_water(c("mndwi_pre")),
            "water_s2_post": P.optical_water(c("mndwi_post")),
            "vh_drop": P.vh_drop(vh0, vh1),
            "burn_s2": P.optical_burn(c("dnbr"), c("ndvi_pre")),
            "disturbance_s2": P.optical_disturbance(c("ndvi_pre"), c("ndvi_post")),
            "change_s1": P.sar_change(vv0, vv1, vh0, vh1),
            "change_s2": P.optical_change(
                c("mndwi_post") - c("mndwi_pre"), c("ndvi_post") - c("ndvi_pre"), c("nbr_post") - c("nbr_pre")
            ),
        }
    )


def with_maps(df: DataFrame, task: str | Column, has_pair: Column | None = None) -> DataFrame:
    """Add target, change, uncertainty and severity for ``task`` (a name, or a column of names).

    ``has_pair`` tells whether any sensor of the request has both periods; where it is false, change equals target.
    """
    which = F.lit(task) if isinstance(task, str) else task
    c = F.col
    target = (
        F.when(which == "flood", P.flood_target(P.sensor_mean(c("water_s1_post"), c("water_s2_post")),
                                                P.sensor_mean(c("water_s1_pre"), c("water_s2_pre"))))
        .when(which == "wildfire", F.coalesce(c("burn_s2"), c("vh_drop")))
        .when(which == "vegetation", P.sensor_mean(c("vh_drop"), c("disturbance_s2")))
    )
    df = df.withColumns({"target": target, "change": P.sensor_mean(c("change_s1"), c("change_s2"))})
    if has_pair is not None:
        df = df.withColumn("change", F.when(has_pair, c("change")).otherwise(c("target")))
    df = df.withColumn("entropy", P.binary_entropy(c("target")))
    sar_only = c("burn_s2").isNull() & c("vh_drop").isNotNull()
    unc = (
        F.when(c("target").isNull(), F.lit(None).cast("double"))
        .when(which == "flood", F.greatest(c("entropy"), F.abs(c("water_s1_post") - c("water_s2_post"))))
        .when((which == "wildfire") & sar_only, F.greatest(c("entropy"), F.lit(K.SAR_ONLY_BURN_UNCERTAINTY)))
        .when(which == "vegetation", F.greatest(c("entropy"), F.abs(c("vh_drop") - c("disturbance_s2"))))
        .otherwise(c("entropy"))
    )
    severity = F.when(which == "wildfire", P.burn_severity(c("dnbr")))
    return df.withColumns({"uncertainty": unc, "severity": severity}).drop("entropy")


def restrict_sensors(df: DataFrame, sensors) -> DataFrame:
    """Hide every band of the sensors outside ``sensors`` (a list of names, or an array column)."""
    if not isinstance(sensors, Column) and set(K.SENSORS) <= set(sensors):
        return df
    hide, columns = {}, df.columns
    for s in K.SENSORS:
        names = [n for n in columns if n.startswith((f"{s}_pre_", f"{s}_post_"))]
        if isinstance(sensors, Column):
            hide |= {n: F.when(F.array_contains(sensors, s), F.col(n)) for n in names}
        elif s not in sensors:
            hide |= {n: F.lit(None).cast(df.schema[n].dataType) for n in names}
    return df.withColumns(hide) if hide else df


def predict(df: DataFrame, task: str | Column, sensors=K.SENSORS, has_pair: Column | None = None) -> DataFrame:
    """The physics baseline end to end: indices, evidence, maps, optionally from a subset of the sensors."""
    return with_maps(with_evidence(with_indices(restrict_sensors(df, sensors))), task, has_pair)


def with_weak_labels(df: DataFrame, complete: Column | None = None) -> DataFrame:
    """Add consensus labels (flood_label, change_label); NULL = ignore. Needs :func:`with_evidence` columns."""
    c = F.col
    return df.withColumns(
        {
            "flood_label": P.weak_flood_label(
                c("water_s1_pre"), c("water_s2_pre"), c("water_s1_post"), c("water_s2_post"), complete=complete
            ),
            "change_label": P.weak_change_label(c("change_s1"), c("change_s2")),
        }
    )
