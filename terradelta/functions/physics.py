"""Per-pixel physics as Column expressions. NULL means "not observed" and propagates unless stated otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terradelta import constants as K


def sigmoid(x: Column) -> Column:
    """Logistic function with the argument limited to +-30 (greatest/least skip NULL, hence the guard)."""
    return F.when(x.isNotNull(), 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0)))))


def logistic(x: Column) -> Column:
    """:func:`sigmoid` as a chain of conditions: NULL stays NULL by itself, and the short expression keeps a whole map inside
    one method the JVM still compiles. The limit matters: values next to 1 round to it or not."""
    return 1.0 / (1.0 + F.exp(F.when(x > 30.0, F.lit(-30.0)).when(x < -30.0, F.lit(30.0)).otherwise(-x)))


def norm_diff(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b + F.lit(1e-6))


def mndwi(green: Column, swir1: Column) -> Column:
    return norm_diff(green, swir1)


def ndvi(nir: Column, red: Column) -> Column:
    return norm_diff(nir, red)


def nbr(nir: Column, swir2: Column) -> Column:
    return norm_diff(nir, swir2)


def sensor_mean(*maps: Column) -> Column:
    """Mean over the sensors that observed the pixel; NULL when none did."""
    if len(maps) == 2:
        a, b = maps
        return F.coalesce((a + b) * 0.5, a, b)
    total = reduce(lambda a, b: a + b, [F.coalesce(m, F.lit(0.0)) for m in maps])
    n = reduce(lambda a, b: a + b, [m.isNotNull().cast("int") for m in maps])
    return F.when(n > 0, total / n)


def binary_entropy(p: Column) -> Column:
    """Entropy in bits of a probability kept away from 0 and 1 by 1e-6."""
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.when(p.isNotNull(), -(q * F.log2(q) + (1 - q) * F.log2(1 - q)))


def burn_severity(dnbr: Column) -> Column:
    """Severity class 0..4 of a dNBR value; class edges belong to the upper class, NULL stays NULL."""
    out = F.when(dnbr.isNull(), F.lit(None).cast("int"))
    for k in range(len(K.DNBR_SEVERITY), 0, -1):
        out = out.when(dnbr >= K.DNBR_SEVERITY[k - 1], F.lit(k))
    return out.otherwise(F.lit(0))


def sar_water(vv: Column, vv_pre: Column | None = None) -> Column:
    """Open-water probability from VV; with the earlier VV, a strong drop into a low range counts as water too."""
    low = logistic((K.VV_WATER_DB - vv) / 1.5)
    if vv_pre is None:
        return low
    drop = logistic(vv_pre - vv - K.VV_DROP_DB) * logistic((K.VV_DROP_CEILING_DB - vv) / 1.5)
    return F.greatest(low, drop)


def optical_water(mndwi_value: Column) -> Column:
    return logistic((mndwi_value - K.MNDWI_WATER) / 0.05)


def vh_drop(vh_pre: Column, vh_post: Column) -> Column:
    """Loss of canopy volume scattering, only where the pixel looked vegetated before."""
    return logistic((vh_pre - vh_post - K.VH_DROP_DB) / 0.6) * logistic(vh_pre - K.VH_CANOPY_DB)


def optical_burn(dnbr: Column, ndvi_pre: Column) -> Column:
    return logistic((dnbr - K.DNBR_BURN) / 0.025) * logistic((ndvi_pre - K.NDVI_FUEL) / 0.03)


def optical_disturbance(ndvi_pre: Column, ndvi_post: Column) -> Column:
    return logistic((ndvi_pre - ndvi_post - K.NDVI_DROP) / 0.04) * logistic((ndvi_pre - K.NDVI_CANOPY) / 0.05)


def largest_abs(*deltas: Column) -> Column:
    """max(|d|) that is NULL as soon as one delta is NULL."""
    known = reduce(lambda a, b: a & b, [d.isNotNull() for d in deltas])
    return F.when(known, F.greatest(*[F.abs(d) for d in deltas]))


def sar_change(vv_pre: Column, vv_post: Column, vh_pre: Column, vh_post: Column) -> Column:
    return logistic((largest_abs(vv_post - vv_pre, vh_post - vh_pre) - K.CHANGE_DB) / 0.5)


def optical_change(*index_deltas: Column) -> Column:
    return logistic((largest_abs(*index_deltas) - K.CHANGE_INDEX) / 0.05)


def pre_water(sar_pre: Column, optical_pre: Column, threshold: float = K.PRE_WATER_THRESHOLD) -> Column:
    """Open water before the event: optical where observed, SAR elsewhere, unobserved counts as dry."""
    return F.coalesce(optical_pre, sar_pre, F.lit(0.0)) > threshold


def flood_target(post_mean: Column, pre_mean: Column) -> Column:
    return post_mean * (1 - F.coalesce(pre_mean, F.lit(0.0)))


def weak_flood_label(sar_pre, opt_pre, sar_post, opt_post, hi=K.WEAK_HIGH, lo=K.WEAK_LOW, complete=None) -> Column:
    """1 new water, 0 dry or permanent water, NULL where SAR and optical do not both say so confidently.

    ``complete`` is the request-level flag "both sensors have a stack in both periods"; without it nothing is labelled.
    """
    wet_post, dry_post = (sar_post > hi) & (opt_post > hi), (sar_post < lo) & (opt_post < lo)
    label = (
        F.when(wet_post & (sar_pre < lo) & (opt_pre < lo), F.lit(1))
        .when(wet_post & (sar_pre > hi) & (opt_pre > hi), F.lit(0))
        .when(dry_post, F.lit(0))
    )
    return label if complete is None else F.when(complete, label)


def weak_change_label(sar: Column, opt: Column, hi=K.WEAK_HIGH, lo=K.WEAK_LOW) -> Column:
    return F.when((sar > hi) & (opt > hi), F.lit(1)).when((sar < lo) & (opt < lo), F.lit(0))
