"""Job records and request counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta import constants as K


def job_listing(jobs: DataFrame) -> DataFrame:
    """Jobs newest first with their task, area and summary."""
    return jobs.select("id", "status", "created", "finished", "summary", "task", "aoi_km2").orderBy(F.col("created").desc(), "id")


def job_status_counts(jobs: DataFrame) -> DataFrame:
    """One row per known status, zeros included: conditional counts of one aggregate, turned into rows."""
    counts = jobs.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in K.JOB_STATUSES])
    rows = F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("jobs")) for s in K.JOB_STATUSES])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def request_counters(log: DataFrame) -> DataFrame:
    """Requests and seconds per method, route and status code."""
    return log.groupBy("method", "route", "code").agg(F.count("*").alias("requests"), F.sum("seconds").alias("seconds"))


def upgrade_job_summary(jobs: DataFrame) -> DataFrame:
    """Summaries written before there were several tasks (no ``target``) in the general schema."""
    old = F.col("target").isNull()
    return jobs.withColumns(
        {
            "affected_km2": F.when(old, F.col("flooded_km2")).otherwise(F.col("affected_km2")),
            "mean_confidence_affected": F.when(old, F.col("mean_confidence_flooded")).otherwise(F.col("mean_confidence_affected")),
            "affected_label": F.when(old, "flooded").otherwise(F.col("affected_label")),
            "target": F.coalesce("target", F.lit("flood")),
        }
    ).drop("flooded_km2", "mean_confidence_flooded")
