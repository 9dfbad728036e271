"""Masks and per-pixel composites of scene stacks.

Scenes are selected first, so a composite knows how many observations of a pixel and period there can be
(``max_scenes``). A stack is folded with one plain hash aggregate: one buffer per (band, scene rank). That keeps partial
aggregation and code generation, where a generic median or a collected list would not. An observation without a slot, or
a second one of the same rank, is an error: nothing is left out silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta import constants as K


def mask_s2(df: DataFrame, bands, scl: str = "scl", baseline: str = "processing_baseline") -> DataFrame:
    """Digital numbers -> reflectance; NULL under clouds, shadow, saturation or without a scene class. Adds ``usable``."""
    ok = F.coalesce(~F.col(scl).isin(*K.S2_INVALID_SCL), F.lit(False))
    offset = F.when(F.coalesce(baseline, F.lit(0.0)) >= K.S2_OFFSET_BASELINE, K.S2_OFFSET_DN).otherwise(0.0)
    return df.withColumns({"usable": ok, **{b: F.when(ok, (F.col(b) + offset) / K.S2_SCALE) for b in bands}})


def usable_scenes(df: DataFrame, scene_keys, scl: str = "scl", pixels: Column | None = None) -> DataFrame:
    """Scenes whose share of usable pixels reaches 2 %: only keys and the scene class are read for this decision."""
    ok = F.coalesce(~F.col(scl).isin(*K.S2_INVALID_SCL), F.lit(False)).cast("int")
    share = F.avg(ok) if pixels is None else F.sum(ok) / F.max(pixels)
    return df.groupBy(*scene_keys).agg(share.alias("usable_fraction")).where(F.col("usable_fraction") >= K.S2_MIN_USABLE)


def mask_s1(df: DataFrame, bands=K.S1_BANDS) -> DataFrame:
    """Linear power; NULL where it is not positive."""
    return df.withColumns({b: F.when(F.col(b) > 0, F.col(b)) for b in bands})


def to_db(power: Column) -> Column:
    return 10 * F.log10(power)


def _with_slots(df: DataFrame, bands, slot: Column) -> DataFrame:
    """Add the number of the stack slot a row fills and whether the row is valid in all ``bands``: once per row, so the
    many aggregates that follow compare one integer each."""
    full = F.lit(True)
    for b in bands:
        full = full & F.col(b).isNotNull()
    return df.withColumns({"__slot": slot, "__full": full})


def slots(bands, max_scenes: int = K.MAX_SCENES, first_slot: int = 0, prefix: str = "") -> list[Column]:
    """Aggregates that hold every band of every ranked scene: columns ``{prefix}{band}__{k}``, plus ``{prefix}__{k}``
    (true when all bands of scene k are valid). Scene k fills slot ``first_slot + k``."""
    pick = lambda value, k, name: F.expr(f"max(CASE WHEN __slot = {first_slot + k} THEN {value} END) AS `{name}`")
    out = [pick(b, k, f"{prefix}{b}__{k}") for b in bands for k in range(1, max_scenes + 1)]
    return out + [pick("__full", k, f"{prefix}__{k}") for k in range(1, max_scenes + 1)]


def median_of(values: list[Column]) -> Column:
    """Median of the non-NULL ones of a few columns (mean of the middle two); NULL when all are NULL."""
    ordered = F.sort_array(F.array(*values), asc=False)  # NULLs come last
    n = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, (F.get(ordered, low - 1) + F.get(ordered, high - 1)) / 2)


def median_from_slots(bands, max_scenes: int = K.MAX_SCENES, prefix: str = "") -> dict[str, Column]:
    return {f"{prefix}{b}": median_of([F.col(f"{prefix}{b}__{k}") for k in range(1, max_scenes + 1)]) for b in bands}


def first_from_slots(bands, max_scenes: int = K.MAX_SCENES, prefix: str = "") -> dict[str, Column]:
    """All bands of the earliest scene that is valid in every band; else those of the first scene as they are."""
    out = {}
    for b in bands:
        pick = F.when(F.col(f"{prefix}__1"), F.col(f"{prefix}{b}__1"))
        for k in range(2, max_scenes + 1):
            pick = pick.when(F.col(f"{prefix}__{k}"), F.col(f"{prefix}{b}__{k}"))
        out[f"{prefix}{b}"] = pick.otherwise(F.col(f"{prefix}{b}__1"))
    return out


def checked_rank(max_scenes: int) -> Column:
    """``scene_rank``, or an error where it has no slot."""
    rank = F.col("scene_rank")
    text = F.concat(F.lit("scene_rank "), F.coalesce(rank.cast("string"), F.lit("NULL")), F.lit(f" is outside 1..{max_scenes}; raise max_scenes"))
    return F.when(rank.between(1, max_scenes), rank).otherwise(F.raise_error(text).cast("int"))


def composite(df: DataFrame, keys, bands, method: str, max_scenes: int = K.MAX_SCENES, db: bool = False) -> DataFrame:
    """One row per ``keys`` from rows ranked by ``scene_rank`` (1..max_scenes, each once)."""
    seen = [F.count("*").alias("__n"), F.expr("bit_or(shiftleft(1L, CAST(__slot AS INT))) AS __seen")]
    folded = _with_slots(df, bands, checked_rank(max_scenes)).groupBy(*keys).agg(*slots(bands, max_scenes), *seen)
    make = median_from_slots if method == "median" else first_from_slots
    once = F.bit_count("__seen") == F.col("__n")
    twice = F.raise_error(F.lit("two observations share a scene_rank")).cast("double")
    out = folded.select(*keys, *[F.when(once, v).otherwise(twice).alias(k) for k, v in make(bands, max_scenes).items()])
    return out.withColumns({b: to_db(F.col(b)) for b in bands}) if db else out


def valid_fraction(df: DataFrame, keys, bands) -> DataFrame:
    """Share of pixels observed in all bands, rounded to 4 places as in scene metadata."""
    full = F.lit(True)
    for b in bands:
        full = full & F.col(b).isNotNull()
    return df.groupBy(*keys).agg(F.avg(full.cast("int")).alias("valid_fraction"))


def prepare_inputs(scene_pixels: DataFrame, keys, methods=("median", "first"), max_scenes: int = K.MAX_SCENES, request_keys=None) -> DataFrame:
    """Wide before/after pixels from one long table ``keys + (sensor, period, scene_rank, vv, vh, b02 ... b12)``.

    Each stack (sensor and period) is composited on its own from its own rows: with sensor and period as partition
    columns only its files are read, and the aggregate stays small enough to be compiled. The four results are joined by
    the keys. With ``request_keys`` a stack valid in under 1 % of a request's pixels is dropped (:func:`drop_empty_stacks`).
    """
    wide = None
    for sensor, bands in K.BANDS.items():
        for period, method in zip(K.PERIODS, methods):
            rows = scene_pixels.where((F.col("sensor") == sensor) & (F.col("period") == period))
            one = composite(rows, keys, bands, method, max_scenes, db=sensor == "s1")
            one = one.withColumnsRenamed({b: f"{sensor}_{period}_{b}" for b in bands})
            wide = one if wide is None else wide.join(one, keys, "full")
    return drop_empty_stacks(wide, request_keys) if request_keys else wide


def drop_empty_stacks(wide: DataFrame, request_keys) -> DataFrame:
    """NULL out every stack whose valid share within a request is below 1 %."""
    share = {}
    for sensor, bands in K.BANDS.items():
        for period in K.PERIODS:
            full = F.lit(True)
            for b in bands:
                full = full & F.col(f"{sensor}_{period}_{b}").isNotNull()
            share[f"{sensor}_{period}"] = F.avg(full.cast("int"))
    stats = wide.groupBy(*request_keys).agg(*[v.alias(f"__{k}") for k, v in share.items()])
    joined = wide.join(stats, request_keys)
    keep = {
        f"{k}_{b}": F.when(F.col(f"__{k}") >= K.MIN_VALID_FRACTION, F.col(f"{k}_{b}"))
        for k in share for b in K.BANDS[k[:2]]
    }
    return joined.withColumns(keep).select(*wide.columns)


def dem_mosaic(df: DataFrame, keys, elev: str, order: str) -> DataFrame:
    """First non-NULL elevation per cell in item order."""
    seen = F.col(elev).isNotNull()
    return df.groupBy(*keys).agg(F.min_by(F.when(seen, F.col(elev)), F.when(seen, F.col(order))).alias(elev))
