"""Leaking boxes against every pair."""

import random

import pytest

from terradelta.operators import leakage

SCHEMA = "event_id BIGINT, split STRING, w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE"


def plain(rows):
    out = {}
    for i, split, w, s, e, n in rows:
        hit = [j for j, other, w2, s2, e2, n2 in rows if other != split and None not in (split, other, w, w2) and w < e2 and w2 < e and s < n2 and s2 < n]
        if hit:
            out[i, split] = min(min(hit), out.get((i, split), min(hit)))
    return out


def boxes(rng, n, x, y, size, first=0, splits=("train", "val", "test")):
    out = []
    for i in range(n):
        w, s = x(), y()
        out.append((first + i, rng.choice(splits), w, s, w + size(), s + size()))
    return out


def worlds():
    rng = random.Random(3)
    u = rng.uniform
    yield "all sizes", boxes(rng, 300, lambda: u(-180, 170), lambda: u(-80, 70), lambda: 10 ** u(-4, 1.2))
    yield "crowd", boxes(rng, 270, lambda: u(5, 5.02), lambda: u(45, 45.02), lambda: u(0.01, 0.03)) + boxes(rng, 30, lambda: u(-20, 20), lambda: u(30, 60), lambda: u(0.1, 9), 270)
    grid = [(i, ("train", "val")[(i % 20) // 10], (i % 20) * 0.1, (i // 20) * 0.1, (i % 20) * 0.1 + 0.1, (i // 20) * 0.1 + 0.1) for i in range(200)]
    yield "tiles side by side", grid + [(500, "test", 0.05, 0.05, 0.05, 0.05), (501, "test", 1.0, 1.0, 1.0, 1.0), (502, None, 0.0, 0.0, 9.0, 9.0), (503, "test", None, 0.0, 1.0, 1.0)]
    yield "halves that never meet", boxes(rng, 80, lambda: u(0, 0.004), lambda: u(0, 0.01), lambda: 0.006, 0, ["train"]) + boxes(rng, 80, lambda: u(0.0101, 0.02), lambda: u(0, 0.01), lambda: 0.006, 80, ["val"])
    twice = boxes(rng, 40, lambda: u(0, 3), lambda: u(0, 3), lambda: u(0.1, 2))
    yield "repeated ids", twice + [(i, "val", w + 0.01, s, e, n) for i, _, w, s, e, n in twice[:20]] + twice[:5]


@pytest.mark.parametrize(("name", "rows"), list(worlds()), ids=[n for n, _ in worlds()])
def test_leakage_equals_all_pairs(spark, name, rows):
    got = leakage.audit_leakage(spark.createDataFrame(rows, SCHEMA), "event_id").collect()
    assert {(r.event_id, r.split): r.conflict_id for r in got} == plain(rows) and len(got) == len(plain(rows))


def test_last_comparison(spark):
    rows = boxes(random.Random(8), 120, lambda: random.uniform(0, 1), lambda: random.uniform(0, 1), lambda: random.uniform(0.02, 0.2))
    got = leakage.audit_leakage(spark.createDataFrame(rows, SCHEMA), "event_id", rounds=0).collect()
    assert {(r.event_id, r.split): r.conflict_id for r in got} == plain(rows)


def test_no_boxes(spark):
    assert leakage.audit_leakage(spark.createDataFrame([], SCHEMA), "event_id").count() == 0
