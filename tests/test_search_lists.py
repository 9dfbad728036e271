"""Searches answered from shared scene lists equal the plain list of found scenes."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from terradelta.operators import scenes as S
from terradelta.plans import q_scenes


@pytest.fixture(scope="module")
def world(spark):
    """Footprints that overlap in several ways over 40 days, equal times, scenes without time, and windows over several buckets."""
    rng = random.Random(3)
    at = lambda: dt.datetime(2024, 3, 1 + rng.randrange(30), 6 * rng.randrange(4)) + dt.timedelta(days=rng.randrange(10))
    rows = []
    for i in range(2000):
        x, y = rng.randrange(6) * 0.7, rng.randrange(3) * 0.9
        rows.append((i, rng.choice(["s1", "s2", "dem"]), None if i % 19 == 0 else at(), float(i % 80), rng.choice([None, 0, 1, 2, 3, 4]), x, y, x + 1.5, y + 1.0))
    catalog = spark.createDataFrame(rows, "scene_id INT, sensor STRING, ts TIMESTAMP, cloud DOUBLE, relative_orbit INT, w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE")
    asks = []
    for a in range(40):
        x, y, d = rng.random() * 7, rng.random() * 4, rng.randrange(20)
        for sensor in ("s1", "s2", "dem"):
            for p, lag in (("pre", 0), ("post", 9)):
                start = dt.date(2024, 3, 1) + dt.timedelta(days=d + lag)
                asks.append((f"{a}-{p}", a, sensor, p, start, start + dt.timedelta(days=rng.choice([-1, 0, 2, 25])), x, y, x + 0.6, y + 0.3))
    areas = spark.createDataFrame(asks, "search_id STRING, area_id INT, sensor STRING, period STRING, start DATE, end DATE, w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE")
    return catalog, areas


def plain(catalog, areas):
    c, a = catalog.alias("c"), areas.alias("a")
    hit = "a.sensor = c.sensor AND a.w <= c.e AND c.w <= a.e AND a.s <= c.n AND c.s <= a.n AND (a.sensor = 'dem' OR to_date(c.ts) BETWEEN a.start AND a.end) AND (a.sensor <> 's2' OR c.cloud < 60)"
    found = a.join(c, F.expr(hit)).select("a.search_id", "a.area_id", "a.sensor", "a.period", "c.scene_id", "c.ts", "c.relative_orbit")
    return found.withColumn("seq", F.row_number().over(Window.partitionBy("search_id", "sensor").orderBy("ts", "scene_id"))).cache()


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("block", [4096, 16])
def test_search_equals_the_plain_list(world, block, monkeypatch):
    monkeypatch.setattr(S, "_BLOCK", block)
    cols = ["area_id", "sensor", "period", "scene_id", "seq"]
    want = plain(*world).select(*cols)
    assert rows_of(S.search(*world).select(*cols)) == rows_of(want) and want.count() > 5000
    assert rows_of(S.search(*world, limit=5).select(*cols)) == rows_of(want.where("seq <= 5"))


def test_spread_equals_the_plain_selection(world):
    cols = ["area_id", "sensor", "period", "scene_id", "scene_rank"]
    want = S.select_spread(plain(*world), ["area_id", "sensor"], ["ts", "scene_id"]).select(*cols)
    assert rows_of(S.search_spread(*world).select(*cols)) == rows_of(want)


@pytest.mark.parametrize("n", [1, 4])
def test_orbits_equal_the_plain_match(world, n):
    cols = ["area_id", "sensor", "period", "scene_id"]
    s1 = plain(*world).where("sensor = 's1'")
    post = S.select_closest(s1, ["area_id", "sensor"], ["ts", "scene_id"], n).where("period = 'post'")
    want = S.match_orbits(s1, post, ["area_id"]).select(*cols)
    got = S.search_orbits(*[t.where("sensor = 's1'") for t in world], ["area_id"], n).select(*cols)
    assert rows_of(got) == rows_of(want) and 0 < want.count() < s1.count()


def above_the_last_join(df):
    """The optimized plan's lines above its first join: what is done to joined rows."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[:plan.index("Join")]


def test_found_scenes_are_not_ranked_after_the_join(spark, sf):
    assert not {"Window", "Aggregate", "Sort"} & set(above_the_last_join(q_scenes.q_search(spark, sf)).split())


def test_match_and_spread_do_not_shuffle_what_is_found(spark, sf):
    assert not {"Window", "Aggregate", "Sort"} & set(above_the_last_join(q_scenes.q_spread(spark, sf)).split())
    assert not {"Window", "Aggregate", "Sort"} & set(above_the_last_join(q_scenes.q_orbits(spark, sf)).split())
