"""The sigmoid's limit in the maps: pixels next to 1 keep the colours of the check SQL."""

import math

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terradelta.functions import physics as P


def test_limit_and_null(spark):
    x = [None, -1000.0, -31.0, -3.0, 0.0, 3.0, 31.0, 1000.0]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").select("i", P.logistic(F.col("x")).alias("p")).orderBy("i").collect()
    want = [None if v is None else 1 / (1 + math.exp(-max(min(v, 30.0), -30.0))) for v in x]
    assert [r["p"] is None for r in got] == [w is None for w in want]
    assert all(abs(r["p"] - w) < 1e-15 for r, w in zip(got, want) if w is not None)


def test_colors_next_to_one(spark, tmp_path):
    ids = [3867928, 1886326, 3135830]
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where(F.col("event_id").isin([i % 100000 for i in ids]))
    shift = F.lit(0)
    for i in ids:
        shift = F.when(F.col("event_id") == i % 100000, F.lit(i)).otherwise(shift)
    events.withColumn("event_id", shift.cast("bigint")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["map_layer_colors"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["map_layer_colors"])
    names = [d[0] for d in want.description]
    assert len(got.columns) == len(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
