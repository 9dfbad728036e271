"""Clusters of reports against union-find over every pair."""

import datetime as dt
import math
import random

import pytest

from terradelta import constants as K
from terradelta.operators import clusters as CL
from terradelta.session import persist_table

DAY0 = dt.date(2026, 9, 1)
SCHEMA = "seq BIGINT, hazard STRING, lon DOUBLE, lat DOUBLE, start_date DATE"


def km(a, b):
    (x1, y1), (x2, y2) = [tuple(map(math.radians, p)) for p in (a, b)]
    return 2 * K.EARTH_KM * math.asin(math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2))


def plain(rows):
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if None not in a and None not in b and a[1] == b[1] and abs((a[4] - b[4]).days) <= 10 and km(a[2:4], b[2:4]) <= 50:
                up[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        low[root(i)] = min(r[0], low.get(root(i), r[0]))
    return {r[0]: low[root(i)] for i, r in enumerate(rows)}


def scattered(rng, n, lon, lat, days):
    return [(rng.choice(["flood", "wildfire"]), lon(), lat(), DAY0 + dt.timedelta(days=rng.randrange(days))) for _ in range(n)]


def sets():
    rng = random.Random(5)
    u = rng.uniform
    yield "near the limit", scattered(rng, 220, lambda: u(3, 9), lambda: u(43, 48), 60)
    yield "date line", scattered(rng, 200, lambda: rng.choice([u(176, 180), u(-180, -176), u(180, 181)]), lambda: u(-3, 3), 25)
    yield "poles", scattered(rng, 160, lambda: u(-180, 180), lambda: rng.choice([u(88, 90), u(-90, -88.5), 90.0, -90.0]), 25)
    yield "hot cell", scattered(rng, 270, lambda: u(5.0, 5.2), lambda: u(45.05, 45.2), 6) + scattered(rng, 30, lambda: u(4.3, 6.0), lambda: u(44.5, 45.7), 30)
    row = [("flood", 3 + i * 0.62, 45.0, DAY0) for i in range(40)]  # a chain of links just below 50 km
    yield "chain", row + [("flood", 3 + i * 0.64, 20.0, DAY0) for i in range(20)] + [(None, 1.0, 1.0, DAY0), ("flood", None, 1.0, DAY0), ("flood", 1.0, None, DAY0), ("flood", 1.0, 1.0, None)]


@pytest.mark.parametrize("levels", [CL.LEVELS, 1])
def test_clusters_equal_union_find(spark, levels):
    """All sets at once, each under hazards of its own; with one level most pairs are left to the last comparison."""
    rows, want = [], {}
    for name, part in sets():
        mine = [(len(rows) + i, h and f"{name} {h}", x, y, d) for i, (h, x, y, d) in enumerate(part)]
        rows += mine
        want |= plain(mine)
    random.Random(1).shuffle(rows)
    got = CL.cluster_events(spark.createDataFrame(rows, SCHEMA), levels)
    assert {r.seq: r.cluster for r in got.collect()} == want and got.count() == len(rows)
    assert len(set(want.values())) > 30


def test_no_reports(spark):
    assert CL.cluster_events(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pairs_within_one_set_are_left_alone(spark, monkeypatch):
    """Cells that chains over other cells join are not cut into quarters, although many of their pairs are undecided."""
    written = []
    monkeypatch.setattr(CL, "persist_table", lambda df, name: written.append(name) or persist_table(df, name))
    rows = [(i, "flood", 3 + (i % 30) * 0.07, 45 + i // 30 * 0.07, DAY0) for i in range(600)]
    got = CL.cluster_events(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 600 and {r.cluster for r in got} == {0}
    assert "cell-pairs" in written and "cell-parts" not in written


def test_members_of_a_cell_link(spark):
    """The cover's promise: no cell is wider than 50 km across."""
    for y in range(-300, 300, 7):
        nearest = (y if y >= 0 else -(y + 1)) * CL.BAND_DEG
        n = max(1, math.ceil(2 * math.pi * K.EARTH_KM * math.cos(math.radians(nearest)) / CL.WIDTH_KM))
        a, b = y * CL.BAND_DEG, (y + 1) * CL.BAND_DEG
        assert max(km((0, p), (360 / n, q)) for p in (a, b) for q in (a, b)) <= 50
