"""Counts and nearest scenes of searches equal those of the whole list of found scenes, which they never build."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from terradelta.operators import scenes as S
from terradelta.plans import q_scenes


@pytest.fixture(scope="module")
def crowded(spark):
    """Two footprints that overlap, many scenes a day with equal times, cloudy ones, scenes without time or cloud."""
    at = lambda i: dt.datetime(2024, 3, 1 + i % 12, 6 * (i % 3))
    rows = [(i, ("s1", "s2", "dem")[i % 3], None if i % 41 == 0 else at(i // 3), None if i % 7 == 0 else float(i % 80), i % 2 + 0.0, 0.0, i % 2 + 1.5, 1.0) for i in range(1500)]
    catalog = spark.createDataFrame(rows, "scene_id INT, sensor STRING, ts TIMESTAMP, cloud DOUBLE, w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE")
    asks = [(f"{a}-{p}", a, s, p, dt.date(2024, 3, d), dt.date(2024, 3, d + 3), w, 0.4, w + 0.3, 0.7)
            for a, w in ((1, 0.2), (2, 1.2), (3, 2.0), (4, 7.0)) for s in ("s1", "s2", "dem") for p, d in (("pre", 2), ("post", 7))]
    return catalog, spark.createDataFrame(asks, "search_id STRING, area_id INT, sensor STRING, period STRING, start DATE, end DATE, w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE")


def test_counts_of_searches(crowded):
    catalog, asks = crowded
    keys = ["area_id", "sensor", "period"]
    want = S.search(catalog, asks).groupBy(*keys).agg(F.count("*").alias("scenes"), F.round(F.avg(F.coalesce("cloud", F.lit(0.0))), 9).alias("cloud"))
    got = S.search_counts(catalog, asks).select(*keys, "scenes", F.round("cloud", 9).alias("cloud"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 18


def test_closest_of_searches(crowded):
    catalog, asks = crowded
    cols = ["area_id", "sensor", "period", "scene_id", "scene_rank"]
    want = S.select_closest(S.search(catalog, asks).where("sensor <> 'dem'"), ["area_id", "sensor"], ["ts", "scene_id"]).select(*cols)
    got = S.search_closest(catalog, asks, ["area_id", "sensor"]).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 3 * 4 * 4


def test_found_scenes_are_not_listed_for_counts(spark, sf):
    """Counts rank no scenes."""
    assert "Window" not in q_scenes.q_scene_counts(spark, sf)._jdf.queryExecution().toString()
