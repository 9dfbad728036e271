"""The number of tasks that sort vertices follows the number of geometries."""

from terradelta.operators import cases, grids


def test_tasks_follow_geometries(spark, monkeypatch):
    monkeypatch.setattr(grids, "TASK_ROWS", 10)
    xy = ", ".join(f"struct({x}D AS x, {y}D AS y)" for x, y in ((7.0, 45.0), (7.1, 45.0), (7.1, 45.1), (7.0, 45.1), (7.0, 45.0)))
    box = f"array(array(array({xy})))"
    polys = spark.range(1000).selectExpr("id", f"{box} AS polys")
    assert grids.dealt(polys, "id").rdd.getNumPartitions() == 100
    areas = grids.polygon_area_km2(polys, "id", "polys")
    assert areas.count() == 1000 and areas.where("aoi_km2 NOT BETWEEN 86 AND 89").isEmpty()
    assert "hashpartitioning(id" in areas._jdf.queryExecution().toString() and ", 100)" in areas._jdf.queryExecution().toString()


def test_plan_case_meets_its_area_in_place(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20).selectExpr("id", "'flood' AS hazard", "7.0D + id AS lon", "45.0D AS lat", "DATE '2026-08-01' AS event_start", "DATE '2026-08-03' AS event_end",
                                      "'a' AS place", "'b' AS country").withColumn("bbox", F.lit(None).cast("struct<w: double, s: double, e: double, n: double>"))
    plan = cases.plan_case(rows, F.lit("2026-09-30").cast("date"))
    assert plan.count() == 20 and plan.where("aoi_km2 NOT BETWEEN 220 AND 230 OR error IS NOT NULL").isEmpty()
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
