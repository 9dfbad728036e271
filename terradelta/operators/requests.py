"""Request validation: one error per bad request, normalised values and warnings for good ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta import constants as K
from terradelta.operators import scenes


def parse_window(text: Column) -> tuple[Column, Column]:
    """(start, end) dates of "YYYY-MM-DD/YYYY-MM-DD"; NULL where a part is not a strict ISO date."""
    part = lambda i: F.get(F.split(text, "/"), F.lit(i))
    ok = F.size(F.split(text, "/")) == 2
    day = lambda i: F.when(ok & part(i).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(part(i), "yyyy-MM-dd"))
    return day(0), day(1)


def window_error(text: Column, start: Column, end: Column) -> Column:
    return (
        F.when(start.isNull() | end.isNull(), F.concat(F.lit("bad date window '"), F.coalesce(text, F.lit("")), F.lit("': use YYYY-MM-DD/YYYY-MM-DD")))
        .when((start > end) | (F.datediff(end, start) > K.MAX_WINDOW_DAYS),
              F.concat(F.lit("window '"), text, F.lit(f"' must be ordered and at most {K.MAX_WINDOW_DAYS} days")))
    )


def season_gap(b0: Column, b1: Column, a0: Column, a1: Column) -> Column:
    """Days between the window midpoints on the annual circle (0 = same season)."""
    middle = lambda lo, hi: F.dayofyear(F.date_add(lo, F.floor(F.datediff(hi, lo) / 2).cast("int")))
    d = F.abs(middle(b0, b1) - middle(a0, a1))
    return F.least(d, 365 - d)


def seasonal_warning(task: Column, gap: Column) -> Column:
    seasonal = task.isin(*[t for t, spec in K.TASKS.items() if spec["seasonal"]])
    text = F.concat(F.lit("before/after windows are "), gap.cast("string"),
                    F.lit(" days apart in the seasonal cycle: phenology may be mapped as disturbance; "
                          "use the same season in different years"))
    return F.when(seasonal & (gap > K.MAX_SEASON_GAP_DAYS), text)


def validate_request(df: DataFrame, max_km2: float = K.MAX_AOI_KM2) -> DataFrame:
    """Check ``request(task, sensors ARRAY, aoi_error, aoi_km2, before, after, resolution)`` in the order of the rules.

    Adds ``error`` (the first broken rule, NULL = valid), the parsed window dates, ``sensor_keys`` and ``warnings``. A table
    that has the four dates already (before_start ... after_end) needs no window texts.
    """
    dated = "before_start" in df.columns
    if dated:
        text = lambda w: F.concat_ws("/", F.col(f"{w}_start").cast("string"), F.col(f"{w}_end").cast("string"))
        df = df.withColumns({"before": text("before"), "after": text("after")})
    else:
        b0, b1 = parse_window(F.col("before"))
        a0, a1 = parse_window(F.col("after"))
        df = df.withColumns({"before_start": b0, "before_end": b1, "after_start": a0, "after_end": a1})
    df = df.withColumns({"sensor_keys": scenes.sensor_alias(F.col("sensors")), "bad_sensor": scenes.unknown_sensor(F.col("sensors"))})
    c = F.col
    km2 = c("aoi_km2")
    supported = "[" + ", ".join(f"'{t}'" for t in K.TASKS) + "]"
    error = (
        F.when(F.coalesce(~c("task").isin(*K.TASKS), F.lit(True)),
               F.concat(F.lit("unknown task '"), F.coalesce("task", F.lit("")), F.lit(f"'; supported: {supported}")))
        .when(c("bad_sensor").isNotNull(), F.concat(F.lit("unknown sensor '"), c("bad_sensor"), F.lit("'; use s1, s2")))
        .when(F.coalesce(F.size("sensor_keys") < 1, F.lit(True)), F.lit("at least one sensor is required"))
        .when(c("aoi_error").isNotNull(), F.concat(F.lit("invalid AOI: "), c("aoi_error")))
        .when(km2.isNull(), F.lit("invalid AOI: no area"))
        .when(~km2.between(K.MIN_AOI_KM2, max_km2),
              F.format_string(f"AOI area %.1f km² outside allowed range {K.MIN_AOI_KM2:g}–{max_km2:g} km²", km2))
        .otherwise(F.coalesce(window_error(c("before"), c("before_start"), c("before_end")),
                              window_error(c("after"), c("after_start"), c("after_end"))))
    )
    df = df.withColumn("error", error)
    late = (
        F.when(c("before_end") >= c("after_start"), F.lit("the before window must end before the after window starts"))
        .when(~F.coalesce(c("resolution").between(K.MIN_RES, K.MAX_RES), F.lit(False)), F.lit("resolution must be 10–100 m"))
    )
    df = df.withColumn("error", F.coalesce("error", late)).drop("bad_sensor")
    gap = season_gap(c("before_start"), c("before_end"), c("after_start"), c("after_end"))
    return df.withColumn("warnings", F.when(c("error").isNull(), F.array_compact(F.array(seasonal_warning(c("task"), gap)))))
