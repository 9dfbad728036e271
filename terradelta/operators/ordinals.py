"""Numbers of rows in an order, over a whole table or within groups, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.session import persist_table


def ordinals(df: DataFrame, order: list[str | Column], keys: list[str] | None = None, name: str = "ordinal") -> DataFrame:
    """``df`` with the 1-based place (bigint) of every row in ``order`` among the rows of equal ``keys`` (all rows without).

    Rows are sorted by ranges of (keys, order), so a group of any size lies over several ranges. The ranges' sizes (one row
    a range) are added up, a group begins at its smallest number. Null keys are a group; ties are numbered as they lie.
    """
    keys = keys or []
    sort = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    local = persist_table(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()), name)
    local = local.withColumns({"__range": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)})
    before, starts = 0, []
    for r in local.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():
        starts.append((r["__range"], before))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "__range bigint, __before bigint")
    numbered = local.join(offsets, "__range").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__range", "__before", "__at")
    if not keys:
        return numbered
    first = numbered.groupBy(*keys).agg(F.min(name).alias("__first")).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return numbered.join(first, same).withColumn(name, F.col(name) - F.col("__first") + 1).drop("__first", *[f"__{k}" for k in keys])
