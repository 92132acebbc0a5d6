"""Sequence-aware change data: current state (type 1) and history (type 2) from a change log.

Both are pure functions of the log, deduplicated on key and version, so neither the order
nor the batching of arrivals matters.  Hot keys: the log is deduplicated map-side; a key's
versions are then what one window sorts, and Spark spills that sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_log(changes: DataFrame, key: str, version: str, deleted: str, tie: str) -> DataFrame:
    """One row per key and version; of copies the greatest ``tie``, then the greatest row, stands."""
    body = F.struct(F.col(tie).alias("__tie"), F.struct(*[F.col(f"`{c}`") for c in changes.columns]).alias("__row"))
    usable = changes.filter(F.col(key).isNotNull() & F.col(version).isNotNull())
    out = usable.groupBy(F.col(key).alias("__k"), F.col(version).alias("__v")).agg(F.max(body).alias("b")).select("b.__row.*")
    return out.withColumn(deleted, F.coalesce(F.col(deleted), F.lit(False)))


def after_baseline(changes: DataFrame, snapshot: DataFrame, key: str, version: str) -> DataFrame:
    """Changes newer than the snapshot row of their key, and all changes of new keys.

    The snapshot side is static, so this also runs on a stream.
    """
    base = snapshot.groupBy(F.col(key).alias("__k")).agg(F.max(version).alias("__base"))
    joined = changes.join(base, changes[key] == base["__k"], "left")
    return joined.filter(F.col("__base").isNull() | (F.col(version) > F.col("__base"))).drop("__k", "__base")


def scd1(log: DataFrame, key: str, version: str, deleted: str) -> DataFrame:
    """The latest version per key; keys whose latest version is a delete are absent."""
    row = F.struct(*[F.col(f"`{c}`") for c in log.columns])
    return log.groupBy(F.col(key).alias("__k")).agg(F.max_by(row, version).alias("r")).select("r.*").filter(~F.col(deleted)).drop(deleted)


def scd2(log: DataFrame, key: str, version: str, deleted: str) -> DataFrame:
    """Every version with ``__START_AT`` and ``__END_AT`` (null while open); a delete closes and adds none."""
    following = F.lead(version).over(Window.partitionBy(key).orderBy(version))
    return log.withColumns({"__START_AT": F.col(version), "__END_AT": following}).filter(~F.col(deleted)).drop(deleted)


def tombstones(log: DataFrame, key: str, version: str, deleted: str, at: str, now_us: int, retention_seconds: int = 604_800) -> DataFrame:
    """Deleted keys still to be remembered, so that a late lower version cannot revive them."""
    last = log.groupBy(key).agg(F.max_by(F.struct(deleted, at), version).alias("l"))
    age = F.lit(now_us) - F.unix_micros(F.col(f"l.{at}").cast("timestamp"))
    return last.filter(F.col(f"l.{deleted}") & (age <= retention_seconds * 1_000_000)).select(key, F.col(f"l.{at}").alias(at))


def invariant(current: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of the current state must equal the open rows of the history."""
    a = current.agg(F.count(F.lit(1)).alias("current_rows"))
    b = history.filter(F.col("__END_AT").isNull()).agg(F.count(F.lit(1)).alias("open_rows"))
    return a.join(b).withColumn("status", F.when(F.col("current_rows") == F.col("open_rows"), "PASS").otherwise("FAIL"))


def latest_definition(rows: DataFrame, keys: Sequence[str], changed: str, deleted_at: str) -> DataFrame:
    """The latest row per key, ranked before the delete test: a deleted definition never falls back."""
    w = Window.partitionBy(*keys).orderBy(F.col(changed).desc_nulls_last())
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").filter(F.col(deleted_at).isNull()).drop("__n")
