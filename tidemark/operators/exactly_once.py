"""Messages delivered at least once: keep exactly one copy of each (problem 1).

Method: aggregation by identifier with ``min_by`` over a struct of delivery time
and a deterministic tie-break.  Spark combines map-side before the shuffle, so an
identifier that holds a third of all rows leaves one row per map task and cannot
form a hot group.

The aggregate carries only the physical position of a delivery.  Whole rows are
recovered by a join on that position, which is unique: the join has no hot key
either, whatever the identifiers look like.

Defined results: null or blank identifiers are never duplicates and always stay;
a null delivery time sorts last; equal times fall to the tie-break; an empty table
gives an empty result; a delivery that occurs twice with the same position is one
delivery; columns the caller adds, whatever their names, come through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FAR = 2**63 - 1


def winners(df: DataFrame, identifier: Column, arrival_us: Column, position: Sequence[str]) -> DataFrame:
    """One row per non-null identifier: ``msg_id`` and the position of the delivery that stays."""
    where = F.struct(*[F.col(c) for c in position])
    order = F.struct(F.coalesce(arrival_us, F.lit(_FAR)).alias("at"), *[F.col(c) for c in position])
    narrow = df.select(identifier.alias("msg_id"), where.alias("pos"), order.alias("ord")).filter("msg_id is not null")
    kept = narrow.groupBy("msg_id").agg(F.min_by("pos", "ord").alias("pos"))
    return kept.select("msg_id", *[F.col(f"pos.{c}").alias(c) for c in position])


def surplus(df: DataFrame, identifier: Column, arrival_us: Column, position: Sequence[str]) -> DataFrame:
    """Every delivery that does not stay: ``msg_id`` and its position."""
    first = winners(df, identifier, arrival_us, position).select(*position)
    rows = df.select(identifier.alias("msg_id"), *position).filter("msg_id is not null")
    return rows.join(first, list(position), "left_anti").select("msg_id", *position)


def keep_one(df: DataFrame, identifier: Column, arrival_us: Column, position: Sequence[str]) -> DataFrame:
    """The whole rows of ``df`` without surplus deliveries."""
    gone = surplus(df, identifier, arrival_us, position).select(*position)
    return df.join(gone, list(position), "left_anti").select(*df.columns)


def keep_one_narrow(df: DataFrame, identifier: Column, arrival_us: Column, position: Sequence[str], payload: dict[str, Column]) -> DataFrame:
    """Like :func:`keep_one` for a few columns: ``min_by`` carries them, so one shuffle does it.

    Rows without identifier are grouped by their own position, so they neither
    merge nor meet in one task.
    """
    group = F.coalesce(identifier, F.concat_ws("\x00", F.lit(""), *[F.col(c).cast("string") for c in position]))
    order = F.struct(F.coalesce(arrival_us, F.lit(_FAR)).alias("at"), *[F.col(c) for c in position])
    body = F.struct(identifier.alias("msg_id"), *[v.alias(k) for k, v in payload.items()])
    kept = df.select(group.alias("grp"), body.alias("body"), order.alias("ord")).groupBy("grp").agg(F.min_by("body", "ord").alias("body"))
    return kept.select("body.*")
