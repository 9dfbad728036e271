"""Map colours per pixel: RGBA structs of bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terradelta import constants as K

CHANNELS = "rgba"


def _byte(x: Column) -> Column:
    """Truncate to 0..255, as a cast to an unsigned byte does for values already in range."""
    return F.floor(x).cast("int")


def ramp(v: Column, stops) -> Column:
    """Piecewise-linear colour; fully transparent black below the first stop and where v is NULL."""
    channels = []
    for i, name in enumerate(CHANNELS):
        col = F.when(v.isNull() | (v < stops[0][0]), F.lit(0))
        for (x0, c0), (x1, c1) in zip(stops, stops[1:]):
            col = col.when(v < x1, _byte(F.lit(float(c0[i])) + (v - x0) / (x1 - x0) * (c1[i] - c0[i])))
        channels.append(col.otherwise(F.lit(stops[-1][1][i])).alias(name))
    return F.struct(*channels)


def probability_stops(target: str):
    rgb, deep = K.TARGET_COLORS[target]
    return [(0.2, (*rgb, 0)), (0.5, (*rgb, 150)), (1.0, (*deep, 235))]


def severity_color(severity: Column) -> Column:
    s = F.coalesce(severity, F.lit(0))
    return F.struct(*[
        F.get(F.array(*[F.lit(c[i]) for c in K.SEVERITY_RGBA]), s).alias(name) for i, name in enumerate(CHANNELS)
    ])


def _unit(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))


def true_color(red: Column, green: Column, blue: Column) -> Column:
    """Gamma-stretched optical colour; unobserved pixels are black."""
    return F.struct(*[
        F.coalesce(_byte(F.pow(_unit(b / 0.3), F.lit(1 / 1.4)) * 255), F.lit(0)).alias(n)
        for n, b in zip("rgb", (red, green, blue))
    ])


def sar_gray(vv: Column) -> Column:
    g = F.coalesce(_byte(_unit((vv + 25) / 25) * 255), F.lit(0))
    return F.struct(*[g.alias(n) for n in "rgb"])


def quicklook(base: Column, hit: Column, target: str) -> Column:
    """The task's deep colour blended 0.55 over the base where a pixel is affected."""
    deep = K.TARGET_COLORS[target][1]
    return F.struct(*[
        F.when(hit, _byte(0.45 * base[n] + 0.55 * deep[i])).otherwise(base[n]).alias(n) for i, n in enumerate("rgb")
    ])
