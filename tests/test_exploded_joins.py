"""Rows that are listed after the planner's estimate (bins of cases, cells of grids) are not broadcast."""

import datetime as dt

from pyspark.sql import functions as F

from terradelta.operators import clusters as CL
from terradelta.operators import extents as X
from terradelta.operators import merge as MG
from terradelta.plans import q_geo
from terradelta.session import persist_table


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_first_case_joins_points_not_reports(spark):
    day = dt.date(2024, 3, 5)
    spots = [(0.0, 0.0), (0.4, 0.0), (3.0, 1.0)]
    reports = [(i, "flood", *spots[i % 3], day) for i in range(60)] + [(60, "fire", 0.0, 0.0, day), (61, "flood", None, 0.0, day), (62, "flood", 0.0, 0.0, None)]
    cases = [(i, "flood", *spots[(i + 1) % 2], day) for i in range(5, 45)] + [(3, "flood", 0.0, 0.0, dt.date(2024, 3, 16))]
    r = spark.createDataFrame(reports, "seq LONG, hazard STRING, lon DOUBLE, lat DOUBLE, start_date DATE")
    k = spark.createDataFrame(cases, "case_ord LONG, hazard STRING, lon DOUBLE, lat DOUBLE, event_start DATE")
    got = MG.first_case(r, k)
    # 0.4 degrees are 44.5 km, so both places have the first case of either.
    assert {x.seq: x.case_ord for x in got.collect()} == {i: 5 if i % 3 < 2 and i < 60 else None for i in range(63)}
    assert got._jdf.queryExecution().analyzed().toString().count("min(case_ord") >= 2  # of a place and day, then of a report's point
    assert "BroadcastHashJoin [hazard" not in plan(got) or "cx" not in plan(got).split("BroadcastHashJoin [hazard")[1].split("\n")[0]


def test_layer_does_not_broadcast_pixels(spark, sf):
    top = next(x for x in plan(q_geo.q_layer(spark, sf)).splitlines() if "Join [area_id" in x and "r#" in x)
    assert "SortMergeJoin" in top


def test_persisted_tables_are_not_broadcast(spark, sf):
    """Cells of reports with their neighbours, and labels with their copies per salt."""
    points = spark.range(50).selectExpr("'flood' AS hazard", "id AS cell", "0L AS y", "id AS x", "0L AS b", "id * 0.2 AS lon", "0.1D AS lat", "1 AS day", "id AS seq")
    cells = persist_table(CL._boxes(points, [*CL._CELL, "cell"]), "cells")
    assert "Broadcast" not in plan(CL._neighbours(cells))
    low = points.selectExpr("hazard", "cell AS u", "seq AS m").groupBy("hazard", "u").agg(F.min("m").alias("m"))
    assert "Broadcast" not in plan(X._join_low(points.selectExpr("hazard", "cell AS u", "seq AS v"), "hazard", low, 8))
