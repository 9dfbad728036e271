"""Slope of an elevation grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _gradient(df: DataFrame, line_keys, along: str, elev: str, res: float, name: str) -> DataFrame:
    """Central difference along one axis, one-sided at the two ends; NULL when a needed neighbour is unknown."""
    w = Window.partitionBy(*line_keys).orderBy(along)
    z = F.col(elev)
    at_start, at_end = F.lag(along).over(w).isNull(), F.lead(along).over(w).isNull()
    before, after = F.lag(elev).over(w), F.lead(elev).over(w)
    return df.withColumn(
        name,
        F.when(at_start & at_end, F.lit(0.0))
        .when(at_start, (after - z) / res)
        .when(at_end, (z - before) / res)
        .otherwise((after - before) / (2 * res)),
    )


def slope_deg(df: DataFrame, grid_keys, elev: str = "elev", res: float = 10.0) -> DataFrame:
    """Add ``slope`` in degrees. Every cell of the grid must be a row (elevation may be NULL).

    A window holds one grid line, so its size is bounded by the grid's side, not by the grid.
    """
    df = _gradient(df, [*grid_keys, "r"], "c", elev, res, "__gx")
    df = _gradient(df, [*grid_keys, "c"], "r", elev, res, "__gy")
    return df.withColumn("slope", F.degrees(F.atan(F.hypot("__gx", "__gy")))).drop("__gx", "__gy")
