"""Small helpers to declare a query next to the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terradelta.plans.fixtures import with_fixtures

DIGITS = 6


class Book:
    """Collects queries and oracles of one module."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def query(self, name: str, sql: str | None = None, *fixtures: str):
        """Register the decorated (spark, sf_dir) function; ``fixtures`` are put in front of ``sql`` as CTEs."""

        def add(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = with_fixtures(sql, *fixtures)
            return fn

        return add


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column, so that two engines may add in different orders."""
    return df.select(
        *[(F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
          for f in df.schema.fields]
    )


def r6(*items: str, digits: int = DIGITS) -> str:
    """SQL select list rounding like :func:`rounded`: plain names, or ``expr AS name``."""
    out = []
    for it in items:
        expr, _, name = it.rpartition(" AS ")
        out.append(f"round({expr or name}, {digits}) + 0e0 AS {name}")
    return ", ".join(out)
