"""Geodesy as Column expressions: UTM, spherical Mercator, distances, boxes.

The transverse Mercator series are those of Kruger in the third flattening n, to order 6 (Karney 2011).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta import constants as K

# --- Fixed values: WGS84 and UTM ------------------------------------------------------------------
A, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500000.0, 10000000.0
# Row j holds the coefficients of n^j, n^(j+1), ... n^6.
ALPHA_SERIES = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [49561 / 161280, -179 / 168, 6601661 / 7257600],
    [34729 / 80640, -3418889 / 1995840],
    [212378941 / 319334400],
]
BETA_SERIES = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [4397 / 161280, -11 / 504, -830251 / 7257600],
    [4583 / 161280, -108847 / 3991680],
    [20648693 / 638668800],
]
# ----------------------------------------------------------------------------------------------------

THIRD = FLATTENING / (2 - FLATTENING)
ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
RECTIFYING = A / (1 + THIRD) * (1 + THIRD**2 / 4 + THIRD**4 / 64 + THIRD**6 / 256)


def _series(rows):
    return [sum(c * THIRD ** (j + i) for i, c in enumerate(row)) for j, row in enumerate(rows, start=1)]


ALPHA, BETA = _series(ALPHA_SERIES), _series(BETA_SERIES)


def utm_zone(lon: Column) -> Column:
    return F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return (F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)).cast("int")


def _central(epsg: Column) -> Column:
    """Central meridian of a UTM EPSG code, in radians."""
    return F.radians(((epsg % 100) * 6 - 183).cast("double"))


def _south(epsg: Column) -> Column:
    return F.when(epsg > 32700, FALSE_NORTHING).otherwise(0.0)


def _conformal(tau: Column) -> Column:
    """Tangent of the conformal latitude from the tangent of the geodetic one."""
    root = F.sqrt(1 + tau * tau)
    sigma = F.sinh(ECC * F.atanh(ECC * tau / root))
    return tau * F.sqrt(1 + sigma * sigma) - sigma * root


def with_utm(df: DataFrame, lon: str, lat: str, epsg: str, x: str, y: str) -> DataFrame:
    """Add UTM ``x`` and ``y`` in metres. Layered projections keep every step evaluated once, in generated code."""
    p = f"__{x}_"
    lam = F.radians(F.col(lon)) - _central(F.col(epsg))
    df = df.withColumns({f"{p}tau": F.tan(F.radians(F.col(lat))), f"{p}lam": lam})
    df = df.withColumn(f"{p}conf", _conformal(F.col(f"{p}tau")))
    conf, lam = F.col(f"{p}conf"), F.col(f"{p}lam")
    df = df.withColumns(
        {f"{p}xi": F.atan2(conf, F.cos(lam)), f"{p}eta": F.asinh(F.sin(lam) / F.sqrt(conf * conf + F.cos(lam) * F.cos(lam)))}
    )
    xi, eta = F.col(f"{p}xi"), F.col(f"{p}eta")
    north = sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1)), xi)
    east = sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1)), eta)
    df = df.withColumns(
        {x: FALSE_EASTING + SCALE * RECTIFYING * east, y: _south(F.col(epsg)) + SCALE * RECTIFYING * north}
    )
    return df.drop(*[f"{p}{n}" for n in ("tau", "lam", "conf", "xi", "eta")])


def with_lonlat(df: DataFrame, x: str, y: str, epsg: str, lon: str, lat: str) -> DataFrame:
    """Add geographic ``lon``/``lat`` of UTM coordinates: inverse series, then Newton steps that converge quadratically
    (three reach machine precision from the conformal start value)."""
    p = f"__{lon}_"
    df = df.withColumns(
        {f"{p}xi": (F.col(y) - _south(F.col(epsg))) / (SCALE * RECTIFYING),
         f"{p}eta": (F.col(x) - FALSE_EASTING) / (SCALE * RECTIFYING)}
    )
    xi, eta = F.col(f"{p}xi"), F.col(f"{p}eta")
    df = df.withColumns(
        {
            f"{p}u": xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(BETA, 1)), F.lit(0.0)),
            f"{p}v": eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(BETA, 1)), F.lit(0.0)),
        }
    )
    u, v = F.col(f"{p}u"), F.col(f"{p}v")
    sh = F.sinh(v)
    df = df.withColumns(
        {f"{p}conf": F.sin(u) / F.sqrt(sh * sh + F.cos(u) * F.cos(u)),
         lon: F.degrees(F.atan2(sh, F.cos(u)) + _central(F.col(epsg)))}
    )
    df = df.withColumn(f"{p}tau", F.col(f"{p}conf"))
    e2 = 1 - ECC**2
    for _ in range(3):
        tau = F.col(f"{p}tau")
        df = df.withColumn(f"{p}got", _conformal(tau))
        got = F.col(f"{p}got")
        step = ((F.col(f"{p}conf") - got) / F.sqrt(1 + got * got)) * (1 + e2 * tau * tau) / (e2 * F.sqrt(1 + tau * tau))
        df = df.withColumn(f"{p}tau", tau + step)
    df = df.withColumn(lat, F.degrees(F.atan(F.col(f"{p}tau"))))
    return df.drop(*[f"{p}{n}" for n in ("xi", "eta", "u", "v", "conf", "tau", "got")])


def mercator_x(lon: Column) -> Column:
    return A * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return A * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / A)


def mercator_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((p2 - p1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * K.EARTH_KM * F.asin(F.sqrt(s * s + F.cos(p1) * F.cos(p2) * t * t))


# --- Fixed values: kilometres per degree used to draw boxes ------------------------------------------
KM_PER_LON, KM_PER_LAT = 111.32, 110.574


def box_columns(lon: Column, lat: Column, w_km: Column, h_km: Column, digits: int | None = 5) -> dict[str, Column]:
    """w, s, e, n of a w_km x h_km box around a point; unrounded when ``digits`` is None."""
    dx = w_km / 2 / (KM_PER_LON * F.cos(F.radians(lat)))
    dy = h_km / 2 / KM_PER_LAT
    near = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    return {"w": near(lon - dx), "s": near(lat - dy), "e": near(lon + dx), "n": near(lat + dy)}


def box_around(lon: Column, lat: Column, w_km: Column, h_km: Column, digits: int | None = 5) -> Column:
    """:func:`box_columns` as one struct(w, s, e, n)."""
    return F.struct(*[v.alias(k) for k, v in box_columns(lon, lat, w_km, h_km, digits).items()])
