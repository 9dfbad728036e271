"""The tile scores list every pass."""

from pyspark.sql import functions as F

from terradelta.plans import q_bench


def test_every_pass_is_listed(spark, sf):
    rows = q_bench.q_score(spark, sf)
    n = q_bench.scored(spark, sf).count()
    assert {r["pass"]: r["count"] for r in rows.groupBy("pass").count().collect()} == {0: n, 1: n}
    assert rows.groupBy("request_id", "win_r", "win_c", "r", "c").agg(F.countDistinct("p_target").alias("k")).where("k = 1").count() < n / 100
