"""From raw maps to results: clipping, water override, severity gate, summaries, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta import constants as K


def clip_to_aoi(df: DataFrame, inside: Column) -> DataFrame:
    """NULL out target, change and uncertainty outside the study area."""
    return df.withColumns({m: F.when(inside, F.col(m)) for m in ("target", "change", "uncertainty")})


def water_override(df: DataFrame, inside: Column, water: Column, task: Column) -> DataFrame:
    """Except for floods, water from before the event is confidently unaffected, even where nothing was mapped."""
    dry_task = inside & water & (task != "flood")
    return df.withColumns({m: F.when(dry_task, F.lit(0.0)).otherwise(F.col(m)) for m in ("target", "uncertainty")})


def threshold_mask(p: Column, threshold: float = K.THRESHOLD) -> Column:
    return F.coalesce(p >= threshold, F.lit(False))


def gate_severity(severity: Column, target: Column, inside: Column) -> Column:
    """Severity class where the pixel is called affected, 0 where it is not, NULL outside or unobserved."""
    known = inside & target.isNotNull() & severity.isNotNull()
    return F.when(known, F.when(threshold_mask(target), severity).otherwise(F.lit(0)))


def post_process(df: DataFrame, inside: Column, task: Column, water: Column) -> DataFrame:
    """Clip, override and gate in the order a run applies them. ``severity`` is NULL for tasks without classes."""
    df = water_override(clip_to_aoi(df, inside), inside, water, task)
    return df.withColumn("severity", gate_severity(F.col("severity"), F.col("target"), inside))


def request_summary(df: DataFrame, keys, res: float | Column = 10.0) -> DataFrame:
    """Observed, affected and review area with mean confidence and uncertainty: one partial + final aggregate."""
    px = (F.lit(res) if not isinstance(res, Column) else res) ** 2 / F.lit(1e6)
    p, u = F.col("target"), F.col("uncertainty")
    seen = p.isNotNull()
    hit, review = seen & (p >= K.THRESHOLD), seen & (u >= K.REVIEW_UNCERTAINTY)
    km2 = lambda cond: F.sum(F.when(cond, px).otherwise(F.lit(0.0)))
    return df.groupBy(*keys).agg(
        km2(seen).alias("observed_km2"),
        km2(hit).alias("affected_km2"),
        km2(review).alias("review_km2"),
        F.avg(F.when(hit, F.greatest(p, 1 - p))).alias("mean_confidence_affected"),
        F.avg(F.when(seen, u)).alias("mean_uncertainty"),
    )


def severity_area(df: DataFrame, keys, res: float = 10.0) -> DataFrame:
    px = F.lit(res**2 / 1e6)
    return df.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("severity") == k + 1, px).otherwise(F.lit(0.0))).alias(name.replace("-", "_"))
        for k, name in enumerate(K.SEVERITY_CLASSES)
    ])


def _task_map(field: str) -> Column:
    return F.create_map(*[F.lit(x) for t, spec in K.TASKS.items() for x in (t, spec[field])])


def summary_record(summary: DataFrame, digits: int = 3) -> DataFrame:
    """The published summary row: task wording, rounded numbers, decision policy."""
    areas = [c for c in summary.columns if c.endswith("_km2") or c.startswith("mean_")]
    return summary.withColumns(
        {
            "target_name": _task_map("target")[F.col("task")],
            "affected_label": _task_map("verb")[F.col("task")],
            **{c: F.round(c, digits) for c in areas},
            "threshold": F.lit(K.THRESHOLD),
            "review_if_uncertainty_ge": F.lit(K.REVIEW_UNCERTAINTY),
        }
    )


def provenance_record(requests: DataFrame, scenes: DataFrame) -> DataFrame:
    """One JSON record per request: model, request, compositing rules, the scenes behind every stack, grid and time.

    ``scenes(request_id, sensor, period, scene_id, seq, ts, cloud, relative_orbit)`` holds the selected scenes of a request's
    stacks, which are few. The grid comes as the columns ``width``, ``height``, ``x0``, ``y0``.
    """
    facts = F.struct(F.col("scene_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), F.col("cloud").alias("cloud_cover"), "relative_orbit")
    kept = F.array_sort(F.collect_list(F.struct("seq", facts.alias("scene"))))
    per_key = scenes.groupBy("request_id", F.concat_ws("_", "sensor", "period").alias("key")).agg(F.transform(kept, lambda s: s["scene"]).alias("scenes"))
    per_key = per_key.withColumn("ids", F.transform("scenes", lambda s: s["id"]))
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", c))))
    lists = per_key.groupBy("request_id").agg(entries("ids").alias("sensors"), entries("scenes").alias("scenes"))
    rules = F.struct(*[
        F.element_at(F.create_map(*[F.lit(x) for t, s in K.TASKS.items() for x in (t, s["composite"][i])]), F.col("task")).alias(p)
        for i, p in enumerate(K.PERIODS)
    ], _task_map("scenes")[F.col("task")].alias("scenes"))
    body = F.struct(
        F.col("model"), F.lit(K.PIPELINE_VERSION).alias("dataset_pipeline"),
        F.struct("task", "before", "after").alias("request"), rules.alias("compositing"), F.col("sensors"), F.col("scenes"),
        F.col("crs").alias("target_crs"), F.col("resolution").alias("resolution_m"),
        F.struct("crs", F.col("resolution").alias("res"), "x0", "y0", "width", "height").alias("grid"), F.lit("fp32").alias("inference_precision"),
        F.date_format("created", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created"),
    )
    return requests.join(lists, "request_id", "left").select("request_id", F.to_json(body).alias("provenance"))


def stac_item_record(results: DataFrame) -> DataFrame:
    """A catalog item per finished run: area (``coordinates``), time span, bounds, headline number and the assets written for
    the task. ``created`` is the time of the run."""
    cog = "image/tiff; application=geotiff; profile=cloud-optimized"
    target = _task_map("target")[F.col("task")]
    asset = lambda href, kind, role: F.struct(
        F.concat(F.lit("./"), href).alias("href"), F.lit(kind).alias("type"), F.array(F.lit(role)).alias("roles"))
    assets = F.struct(
        asset(F.concat(target, F.lit("_probability.tif")), cog, "data").alias("classification"),
        asset(F.lit("change_probability.tif"), cog, "data").alias("change_probability"),
        asset(F.lit("uncertainty.tif"), cog, "data").alias("uncertainty"),
        asset(F.concat(target, F.lit("_extent.geojson")), "application/geo+json", "data").alias("vectorized_change"),
        asset(F.lit("quicklook.png"), "image/png", "overview").alias("quicklook"),
        asset(F.lit("provenance.json"), "application/json", "metadata").alias("provenance"),
        F.when(F.col("has_severity"), asset(F.concat(target, F.lit("_severity.tif")), cog, "data")).alias("severity"),
    )
    props = F.struct(
        F.lit(None).cast("string").alias("datetime"), F.date_format("created", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created"),
        F.concat(F.col("before_start").cast("string"), F.lit("T00:00:00Z")).alias("start_datetime"),
        F.concat(F.col("after_end").cast("string"), F.lit("T23:59:59Z")).alias("end_datetime"),
        F.col("crs").alias("proj:code"), F.col("task"), F.col("model"), F.col("affected_km2"),
    )
    item = F.struct(
        F.lit("Feature").alias("type"), F.lit("1.0.0").alias("stac_version"), F.array(F.lit(K.STAC_PROJECTION)).alias("stac_extensions"),
        F.concat_ws("-", F.lit("terradelta"), "task", F.col("request_id").cast("string")).alias("id"),
        F.struct(F.lit("Polygon").alias("type"), "coordinates").alias("geometry"),
        F.array("w", "s", "e", "n").alias("bbox"), props.alias("properties"), assets.alias("assets"), F.array().cast("array<string>").alias("links"),
    )
    return results.select("request_id", F.to_json(item, {"ignoreNullFields": "false"}).alias("item"))


def composite_cache_key(stacks: DataFrame, ids: Column, *parts: Column) -> DataFrame:
    """Content key of a composite: 20 hex digits of SHA-1 over version, its parts and the sorted scene ids."""
    content = F.to_json(F.struct(F.lit(K.PIPELINE_VERSION).alias("version"), *[p.alias(f"p{i}") for i, p in enumerate(parts)],
                                 F.array_sort(ids).alias("ids")))
    return stacks.withColumn("cache_key", F.substring(F.sha1(content), 1, 20))


def not_cached(stacks: DataFrame, done: DataFrame) -> DataFrame:
    """Stacks whose key has not been materialised yet."""
    return stacks.join(done.select("cache_key").distinct(), "cache_key", "left_anti")
