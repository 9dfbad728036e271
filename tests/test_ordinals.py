"""Ordinals against a sorted list, and plans without a window."""

import random
from collections import Counter

from pyspark.sql import functions as F

from terradelta.operators.ordinals import ordinals
from terradelta.operators.scoring import model_registry
from terradelta.sources.feeds import interleave_hazards


def test_ordinals_in_groups_and_over_all(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.choice([None, 1, 2, 3, 4, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, key string, v int").repartition(7)
    got = ordinals(df, [F.desc_nulls_last("v"), "id"], ["key"], "place").collect()
    seen, want = Counter(), {}
    for i, k, _ in sorted(rows, key=lambda x: (x[2] is None, -(x[2] or 0), x[0])):
        seen[k] += 1
        want[i] = seen[k]
    assert {x.id: x.place for x in got} == want
    assert {x.id: x.ordinal for x in ordinals(df, ["id"]).collect()} == {i: i + 1 for i, _, _ in rows}
    assert ordinals(df.limit(0), ["id"], ["key"]).count() == 0


def test_no_window_over_a_hot_group(spark):
    a = spark.range(300).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'flood' ELSE 'wildfire' END AS hazard")
    cards = spark.range(50).selectExpr("concat('m', id) AS model_id", "'1.0' AS version", "array('flood') AS tasks", "timestamp_seconds(id) AS created")
    turns, listed = interleave_hazards(a, ["id"], 20), model_registry(cards)
    for df in (turns, listed):
        assert "Window" not in df._jdf.queryExecution().toString()
    assert turns.count() == 40 and turns.where("hazard = 'flood' AND round = 20").first().id == 190
    assert [r.model_id for r in listed.orderBy("position").limit(2).collect()] == ["threshold-baseline", "m49"]
