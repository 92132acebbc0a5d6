"""Joins Spark has no single operator for, written for its shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def star(facts: DataFrame, dims: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Left joins of a fact to dimensions, in order.

    Each dimension is (name, table, fact column, dimension key).  The fact column may come
    from an earlier dimension (a chained key).  A flag ``<name>_dimension_match`` says
    whether a row was found.  Small dimensions are broadcast by AQE at their measured size.
    """
    out = facts
    for name, dim, on, key in dims:
        renamed = dim.withColumnRenamed(key, f"__{name}_key")
        clash = [c for c in renamed.columns if c in out.columns]
        if clash:
            raise ValueError(f"dimension {name} repeats columns {clash}")
        out = out.join(renamed, F.col(on) == F.col(f"__{name}_key"), "left").withColumn(f"{name}_dimension_match", F.col(f"__{name}_key").isNotNull()).drop(f"__{name}_key")
    return out


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, take: Sequence[str], bucket_seconds: int = 3600) -> DataFrame:
    """The last right row per key at or before each left row's time.

    Time is cut into buckets.  Inside a bucket a window carries the last right row on; what
    was valid when a bucket began comes from one row per key and bucket.  No task ever holds
    more than one bucket of a key.  Right rows of equal key and time must be unique or equal.
    """
    k, b = list(keys), "__bucket"
    cut = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / bucket_seconds)
    body = F.struct(F.col(right_ts).alias("__at"), *[F.col(c) for c in take])
    r = right.filter(F.col(right_ts).isNotNull()).select(*k, F.col(right_ts).cast("timestamp").alias("__t"), cut(right_ts).alias(b), body.alias("__hit"), F.lit(0).alias("__side"))
    rows = left.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in left.columns]))
    li = rows.select(*k, F.col(left_ts).cast("timestamp").alias("__t"), cut(left_ts).alias(b), "__row", F.lit(1).alias("__side"))
    # Level 1: what each bucket starts with
    ends = r.groupBy(*k, b).agg(F.max_by("__hit", "__t").alias("__end"))
    slots = ends.unionByName(li.select(*k, b).distinct().withColumn("__end", F.lit(None).cast(ends.schema["__end"].dataType))).groupBy(*k, b).agg(F.first("__end", ignorenulls=True).alias("__end"))
    start = F.last("__end", ignorenulls=True).over(Window.partitionBy(*k).orderBy(b).rowsBetween(Window.unboundedPreceding, -1))
    starts = slots.select(*k, b, start.alias("__start"))
    # Level 2: inside the bucket
    both = r.withColumn("__row", F.lit(None).cast(li.schema["__row"].dataType)).unionByName(li.withColumn("__hit", F.lit(None).cast(r.schema["__hit"].dataType)))
    upto = Window.partitionBy(*k, b).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__near", F.last("__hit", ignorenulls=True).over(upto)).filter("__side = 1")
    joined = seen.join(starts, [*k, b], "left")
    hit = F.coalesce("__near", "__start")
    return joined.select("__row.*", *[hit[c].alias(c if c not in left.columns else f"{c}_asof") for c in take], hit["__at"].alias("asof_timestamp"))


def in_force(left: DataFrame, right: DataFrame, equal: Mapping[str, str], at: str, start: str, end: str, row_id: Sequence[str], latest_by: Column, carry: Sequence[str]) -> DataFrame:
    """Left join to the row in force: equal keys, ``start <= at`` and (``end`` null or ``at < end``).

    Where periods overlap, the greatest ``latest_by`` wins: one row per ``row_id`` comes out.
    The range is a residual of an equi join, so the join hashes or sorts on the keys.
    """
    r = right.select(*[F.col(v).alias(f"__{v}") for v in equal.values()], F.col(start).alias("__s"), F.col(end).alias("__e"), latest_by.alias("__rank"), *carry)
    cond = F.lit(True)
    for a, c in equal.items():
        cond = cond & (F.col(a) == F.col(f"__{c}"))
    cond = cond & (F.col("__s") <= F.col(at)) & (F.col("__e").isNull() | (F.col(at) < F.col("__e")))
    w = Window.partitionBy(*row_id).orderBy(F.col("__rank").desc_nulls_last())
    return left.join(r, cond, "left").withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(*left.columns, *carry)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """``EXCEPT ALL`` both ways over the columns of ``left``: rows and the side that has them, multiplicities kept."""
    cols = left.columns
    a = left.exceptAll(right.select(*cols)).withColumn("only_in", F.lit("left"))
    return a.unionByName(right.select(*cols).exceptAll(left).withColumn("only_in", F.lit("right")))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    p = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.filter(F.col(key).isNotNull()).join(p, key, "left_anti")


def merged_days(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join with coalesced keys; the other columns must differ in name."""
    return a.join(b, list(on), "full_outer")
