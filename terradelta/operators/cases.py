"""Cases: windows, study areas, confidence, retention, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terradelta import constants as K
from terradelta.functions import geo, geometry
from terradelta.operators import grids, requests


def case_windows(df: DataFrame, today: Column) -> DataFrame:
    """Add before/after windows of (hazard, event_start, event_end); all NULL where the event is too recent to map."""
    c, d = F.col, F.date_add
    start, end, hazard = c("event_start"), c("event_end"), c("hazard")
    flood_first = F.greatest(start, d(end, -10))
    fire_first = F.when(end >= d(today, -2), F.greatest(d(start, 2), d(today, -30))).otherwise(d(end, 1))
    veg_end = F.least(start, today)
    pick = lambda flood, fire, veg: F.when(hazard == "flood", flood).when(hazard == "wildfire", fire).otherwise(veg)
    df = df.withColumns(
        {
            "before_start": pick(d(start, -35), d(start, -40), d(start, -60 - 365)),
            "before_end": pick(d(start, -5), d(start, -2), d(veg_end, -365)),
            "after_start": pick(flood_first, fire_first, d(start, -60)),
            "after_end": pick(F.least(d(flood_first, 14), today), F.least(d(fire_first, 40), today), veg_end),
        }
    )
    ok = c("after_start") <= c("after_end")
    names = ("before_start", "before_end", "after_start", "after_end")
    return df.withColumn("__ok", ok).withColumns({n: F.when(c("__ok"), c(n)) for n in names}).drop("__ok")


def study_area(df: DataFrame) -> DataFrame:
    """Add the study area aoi_w, aoi_s, aoi_e, aoi_n: the extent held to 5-30 km sides, else 15 x 15 km around the point."""
    c = F.col
    df = df.withColumns({f"__{k}": c("bbox")[k] for k in "wsen"})
    df = df.withColumn("__lat", (c("__s") + c("__n")) / 2)
    df = df.withColumns({"__wkm": (c("__e") - c("__w")) * geo.KM_PER_LON * F.cos(F.radians("__lat")),
                         "__hkm": (c("__n") - c("__s")) * geo.KM_PER_LAT})
    hold = lambda v: F.least(F.greatest(v, F.lit(K.MIN_SIDE_KM)), F.lit(K.MAX_SIDE_KM))
    inside = lambda v, lo, hi: F.least(F.greatest(c(v), c(lo)), c(hi))
    known = c("__lat").isNotNull()
    df = df.withColumns(
        {
            "__cx": F.when(c("__wkm") <= K.MAX_SIDE_KM, (c("__w") + c("__e")) / 2).when(known, inside("lon", "__w", "__e")).otherwise(c("lon")),
            "__cy": F.when(c("__hkm") <= K.MAX_SIDE_KM, c("__lat")).when(known, inside("lat", "__s", "__n")).otherwise(c("lat")),
            "__bw": F.when(known, hold(c("__wkm"))).otherwise(F.lit(K.POINT_KM)),
            "__bh": F.when(known, hold(c("__hkm"))).otherwise(F.lit(K.POINT_KM)),
        }
    )
    box = geo.box_columns(c("__cx"), c("__cy"), c("__bw"), c("__bh"))
    return df.withColumns({f"aoi_{k}": v for k, v in box.items()}).drop(*[f"__{n}" for n in ("w", "s", "e", "n", "lat", "wkm", "hkm", "cx", "cy", "bw", "bh")])


def case_title(df: DataFrame) -> Column:
    label = F.create_map(*[F.lit(x) for kv in K.CASE_LABEL.items() for x in kv])[F.col("hazard")]
    parts = F.array_distinct(F.filter(F.array("place", "country"), lambda p: F.coalesce(p, F.lit("")) != ""))
    where = F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("unknown place")
    return F.concat(label, F.lit(" · "), where, F.lit(" ("), F.col("event_start").cast("string"), F.lit(")"))


def plan_case(cases: DataFrame, today: Column, key: str = "id") -> DataFrame:
    """Study area, windows, title and area of every case; status 'too recent' where no window fits.

    The planned request goes through the ordinary request rules; a broken one would show in ``error``. Cases are dealt by key
    once, and their areas meet them there.
    """
    c = F.col
    planned = study_area(case_windows(cases, today)).withColumn("title", case_title(cases))
    planned = planned.withColumn("polys", geometry.box_polygon(*[c(f"aoi_{k}") for k in "wsen"]))
    planned = grids.dealt(planned, key)
    area = grids.polygon_area_km2(planned, key, "polys", spread=False).withColumnRenamed("aoi_km2", "km2")
    planned = planned.join(area, key)
    recent = c("before_start").isNull()
    req = planned.select(
        F.struct("*").alias("planned"), c("hazard").alias("task"), F.array(F.lit("s1"), F.lit("s2")).alias("sensors"), F.lit(None).cast("string").alias("aoi_error"),
        c("km2").alias("aoi_km2"), "before_start", "before_end", "after_start", "after_end", F.lit(10.0).alias("resolution"))
    out = requests.validate_request(req).select("planned.*", "error")
    return out.select(
        *cases.columns, "title", c("hazard").alias("task"), *[f"aoi_{k}" for k in "wsen"], F.when(~recent, F.round("km2", 3)).alias("aoi_km2"), "before_start", "before_end",
        "after_start", "after_end", F.when(recent, "too recent").alias("status"), F.when(~recent, c("error")).alias("error"))


def score_case(sources: DataFrame, keys) -> DataFrame:
    """Confidence from independent sources: one aggregate over the source rows of each case."""
    kind = F.col("kind")
    agg = sources.groupBy(*keys).agg(
        F.bool_or(kind == "cems").alias("has_cems"), F.bool_or(kind.isin("gdacs", "eonet")).alias("has_alert"),
        F.count_distinct(F.when(kind == "news", F.coalesce("outlet", F.lit("")))).alias("outlets"))
    value = F.when(F.col("has_cems"), 0.5).otherwise(0.0) + F.when(F.col("has_alert"), 0.35).otherwise(0.0) + F.least(F.lit(0.45), 0.15 * F.col("outlets"))
    # Compare in hundredths: 0.35 + 0.15 + ... must not miss a limit by a rounding bit.
    return agg.withColumn("score", F.round(value, 2)).select(
        *keys, "score", F.when(F.col("score") >= 0.6, "high").when(F.col("score") >= 0.35, "medium").otherwise("low").alias("confidence"))


def retain_cases(cases: DataFrame, today: Column, days: int = K.KEEP_DAYS) -> DataFrame:
    return cases.where(F.coalesce("updated", "first_seen") >= F.date_sub(today, days))


def changed_cases(cases: DataFrame, before: DataFrame) -> DataFrame:
    """Cases whose number of sources changed, or which are not ready: ``cases(id, n_sources, status)``."""
    old = before.select("id", F.col("n_sources").alias("old_n"))
    return cases.join(old, "id", "left").where(~F.col("old_n").eqNullSafe(F.col("n_sources")) | (F.coalesce("status", F.lit("")) != "ready")).drop("old_n")


def new_cases(cases: DataFrame, before: DataFrame) -> DataFrame:
    return cases.join(before.select("id"), "id", "left_anti")


def listing_order() -> list[Column]:
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in K.CASE_STATUS_ORDER]), F.col("status")), F.lit(0)), F.lit(5))
    return [rank, F.coalesce("score", F.lit(0.0)).desc(), F.col("event_start").desc()]


def rank_cases(cases: DataFrame) -> DataFrame:
    """Ready cases first, then by score and newest event; a distributed sort."""
    return cases.orderBy(*listing_order(), "id")


def combine_cases(published: DataFrame, local: DataFrame) -> DataFrame:
    """Published and local lists joined by id; the local version of a case wins."""
    both = published.withColumn("__src", F.lit(1)).unionByName(local.withColumn("__src", F.lit(0)))
    w = Window.partitionBy("id").orderBy("__src")
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__src")


def refresh_saved(saved: DataFrame, latest: DataFrame) -> DataFrame:
    """Saved cases with the latest list's view of them where it has one."""
    cols = [c for c in saved.columns if c != "id"]
    new = latest.select("id", F.struct(*cols).alias("__new"))
    out = saved.join(new, "id", "left")
    return out.select("id", *[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in cols])


# How official sources are named in listings.
SOURCE_NAMES = {"gdacs": "GDACS alert", "cems": "Copernicus EMS activation", "eonet": "NASA EONET"}


def search_cases(cases: DataFrame, sources: DataFrame, query: str, hazard: str | None = None) -> DataFrame:
    """Cases of a hazard whose title, place, country or sources contain every word of ``query``.

    A case's text is never assembled: each word is looked for in every field, and the answers are folded per case, so
    cases with very many sources cost no memory.
    """
    words = [w for w in query.lower().split() if w]
    names = F.create_map(*[F.lit(x) for kv in SOURCE_NAMES.items() for x in kv])
    found = lambda cols, w: F.contains(F.lower(F.concat_ws(" ", *cols)), F.lit(w))
    src_cols = [F.col(n) for n in ("title", "outlet", "quote") if n in sources.columns] + [F.try_element_at(names, F.col("kind"))]
    hits = sources.groupBy("id").agg(*[F.bool_or(found(src_cols, w)).alias(f"__w{i}") for i, w in enumerate(words)], F.count("*").alias("__any"))
    out = cases.join(hits, "id", "left")
    if hazard:
        out = out.where(F.col("hazard") == hazard)
    for i, w in enumerate(words):
        out = out.where(found([F.col(n) for n in ("title", "place", "country")], w) | F.coalesce(F.col(f"__w{i}"), F.lit(False)))
    return out.select(*cases.columns)
