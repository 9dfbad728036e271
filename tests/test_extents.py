"""Regions, sieve and outlines against flood fill on small grids."""

import random

import pytest
from pyspark.sql import functions as F

from terradelta.operators import extents as X


def grid_df(spark, grid, key=0):
    rows = [(key, r, c, int(v)) for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "request_id INT, r INT, c INT, value INT")


def fill(grid):
    """{pixel: smallest pixel of its region} by flood fill."""
    h, w, out = len(grid), len(grid[0]), {}
    for r in range(h):
        for c in range(w):
            if (r, c) in out:
                continue
            todo, seen = [(r, c)], {(r, c)}
            while todo:
                a, b = todo.pop()
                for p in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= p[0] < h and 0 <= p[1] < w and p not in seen and grid[p[0]][p[1]] == grid[a][b]:
                        seen.add(p)
                        todo.append(p)
            for p in seen:
                out[p] = (r, c)
    return out


def noise(seed, h, w, p):
    rng = random.Random(seed)
    return [[int(rng.random() < p) for _ in range(w)] for _ in range(h)]


SPIRAL = [[1, 1, 1, 1, 1, 1, 1], [0, 0, 0, 0, 0, 0, 1], [1, 1, 1, 1, 1, 0, 1], [1, 0, 0, 0, 1, 0, 1], [1, 0, 1, 1, 1, 0, 1], [1, 0, 0, 0, 0, 0, 1], [1, 1, 1, 1, 1, 1, 1]]


@pytest.mark.parametrize("grid", [noise(1, 23, 31, 0.55), noise(2, 9, 40, 0.65), SPIRAL])
def test_components_equal_flood_fill(spark, grid):
    got = X.connected_components(grid_df(spark, grid), "request_id", tile=4)
    want = fill(grid)
    for r in got.collect():
        a, b = want[(r.r, r.c)]
        assert r.label == (a << X.SHIFT) + b


def sieve_by_hand(grid, n):
    comp = fill(grid)
    size = {}
    for p, k in comp.items():
        size[k] = size.get(k, 0) + 1
    near = {k: set() for k in size}
    for (r, c), k in comp.items():
        for p in ((r + 1, c), (r, c + 1)):
            if p in comp and comp[p] != k:
                near[k].add(comp[p])
                near[comp[p]].add(k)
    biggest = {k: min(v, key=lambda j: (-size[j], j)) if v else None for k, v in near.items()}
    out = [list(line) for line in grid]
    for (r, c), k in comp.items():
        if size[k] >= n:
            continue
        at, been = k, {k}
        while True:
            at = biggest[at]
            if at is None or at in been:
                break
            if size[at] >= n:
                out[r][c] = grid[at[0]][at[1]]
                break
            been.add(at)
    return out


@pytest.mark.parametrize(("grid", "n"), [(noise(3, 24, 30, 0.3), 6), (noise(4, 30, 30, 0.5), 20), ([[1, 1], [0, 0]], 20)])
def test_sieve_equals_the_definition(spark, grid, n):
    got = X.sieve(grid_df(spark, grid), "request_id", n, tile=8).collect()
    want = sieve_by_hand(grid, n)
    assert all(r.value == want[r.r][r.c] for r in got) and len(got) == len(grid) * len(grid[0])


def test_nested_speck_follows_the_chain(spark):
    grid = [[1] * 11 for _ in range(11)]
    for r in range(4, 7):
        for c in range(4, 7):
            grid[r][c] = 0
    grid[5][5] = 1  # inside a small hole of a large region: both end as the large region
    got = X.sieve(grid_df(spark, grid), "request_id", 20, tile=4)
    assert got.agg(F.min("value")).first()[0] == 1


@pytest.mark.parametrize("grid", [noise(5, 14, 17, 0.6), SPIRAL, [[1, 0], [0, 1]]])
def test_outlines_enclose_their_pixels(spark, grid):
    """Signed ring areas add up to the pixel count, every ring is closed and its corners alternate direction."""
    on = X.connected_components(grid_df(spark, grid).where("value = 1"), "request_id", 4).select("request_id", "r", "c", "label")
    area = dict(on.groupBy("label").count().collect())
    rings = {}
    for row in X.outline_rings(on, "request_id").orderBy("pos").collect():
        rings.setdefault((row.label, row.ring), []).append((row.vr, row.vc))
    total = dict.fromkeys(area, 0.0)
    for (label, _), pts in rings.items():
        closed = [*pts, pts[0]]
        assert len(pts) >= 4 and all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(closed, closed[1:]))
        total[label] += sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(closed, closed[1:])) / 2
    assert {k: abs(v) for k, v in total.items()} == pytest.approx(area)


def test_polygons_have_holes_and_the_right_area(spark):
    """A ring of pixels around a hole, and a single pixel: outer rings counter-clockwise, holes clockwise, all closed."""
    grid = [[1, 1, 1, 1, 0], [1, 0, 0, 1, 0], [1, 1, 1, 1, 0], [0, 0, 0, 0, 1]]
    on = X.connected_components(grid_df(spark, grid).where("value = 1"), "request_id", 2).select("request_id", "r", "c", "label")
    g = spark.createDataFrame([(0, 32631, 10.0, 500000.0, 4900000.0)], "request_id INT, epsg INT, res DOUBLE, x0 DOUBLE, y0 DOUBLE")
    rows = {r.outline_pixels: r.coordinates for r in X.extent_polygons(X.outline_rings(on, "request_id"), g, "request_id").collect()}
    assert sorted(rows) == [1, 10] and [len(x) for x in rows[10]] == [5, 5] and len(rows[1]) == 1
    turn = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
    outer, hole = rows[10]
    assert turn(outer) > 0 > turn(hole) and outer[0] == outer[-1] and hole[0] == hole[-1]


def test_extent_of_a_box(spark):
    grid = [[int(50 <= r < 110 and 60 <= c < 140) for c in range(150)] for r in range(120)]
    on = X.connected_components(grid_df(spark, grid), "request_id", 64).where("value = 1")
    g = spark.createDataFrame([(0, 32617, 10.0, 674000.0, 3828000.0)], "request_id INT, epsg INT, res DOUBLE, x0 DOUBLE, y0 DOUBLE")
    rows = X.extent_features(on, g, "request_id").collect()
    assert len(rows) == 1 and rows[0].area_km2 == pytest.approx(0.48) and (rows[0].r0, rows[0].c1) == (50, 139)
    assert -79.2 < rows[0].lon < -79.0 and 34.5 < rows[0].lat < 34.7
    assert X.outline_rings(on.select("request_id", "r", "c", "label"), "request_id").count() == 4
