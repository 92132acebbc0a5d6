"""Checks between layers: each is a name, two numbers and PASS or FAIL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECK = "check_name string, lhs double, rhs double, status string"


def check(name: str, left: DataFrame, right: DataFrame, lhs: Column | None = None, rhs: Column | None = None) -> DataFrame:
    """Compare one aggregate of each side; by default their counts."""
    a = left.agg(F.coalesce(lhs if lhs is not None else F.count(F.lit(1)), F.lit(0)).cast("double").alias("lhs"))
    b = right.agg(F.coalesce(rhs if rhs is not None else F.count(F.lit(1)), F.lit(0)).cast("double").alias("rhs"))
    same = F.abs(F.col("lhs") - F.col("rhs")) < 0.005
    return a.join(b).select(F.lit(name).alias("check_name"), "lhs", "rhs", F.when(same, "PASS").otherwise("FAIL").alias("status"))  # one row each


def none_of(name: str, rows: DataFrame) -> DataFrame:
    """Passes if there are no such rows."""
    return rows.agg(F.count(F.lit(1)).cast("double").alias("lhs")).select(F.lit(name).alias("check_name"), "lhs", F.lit(0.0).alias("rhs"), F.when(F.col("lhs") == 0, "PASS").otherwise("FAIL").alias("status"))


def unique(name: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return none_of(name, df.groupBy(*keys).count().filter("count > 1"))


def report(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def profile(df: DataFrame, key: str) -> DataFrame:
    """Physical and distinct rows, and how many are surplus."""
    return df.agg(F.count(F.lit(1)).alias("physical_rows"), F.count_distinct(key).alias("distinct_keys")).withColumn("surplus_rows", F.col("physical_rows") - F.col("distinct_keys"))
