"""Inserts, updates and deletes applied in their true order (problem 3).

Method: equality-delete files with sequence numbers.  A change never rewrites what
is there.  ``append`` writes two sets of files: data files with the inserted rows and
their sequence number, and delete files with a key and a sequence number.  An update
writes both.  ``read`` anti-joins data rows against later deletes of the same key.
Order of arrival therefore cannot matter: only sequence numbers are compared.

Sequence numbers are twice the record version; a real delete takes the odd number
above, so of a delete and an insert with the same version the delete wins.

Scale: deletes are compacted to one row per key with map-side combination before the
join; data rows of a hot key are split by AQE's skew join, which may split the left
side of an anti join.  Copies that survive (all of one version) are reduced to one by
an aggregation, again combined map-side.

Defined results: changes without key or version apply to nobody; repeated changes
count once (the last delivered copy gives the attributes); a key whose highest version
is a delete is absent; gaps in versions do not matter; an empty feed gives no rows;
payload columns may have any name but those with the prefix ``__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import work_dir


class ChangeTable:
    """An append-only table of data files and equality-delete files in one folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or work_dir(spark, "change-table")

    def append(self, changes: DataFrame, key: Column, version: Column, deleted: Column, arrival: Column, payload: list[str] | None = None) -> None:
        """Add one delivery of the feed; repeating a delivery after a failure is harmless."""
        named = [c for c in (changes.columns if payload is None else payload)]
        seq = version.cast("long") * 2
        gone = F.coalesce(deleted, F.lit(False))
        rows = changes.select(key.alias("__key"), seq.alias("__seq"), gone.alias("__gone"), arrival.cast("long").alias("__at"), F.struct(*[F.col(f"`{c}`") for c in named]).alias("__row"))
        rows = rows.filter("__key is not null and __seq is not null")
        rows.filter("not __gone").drop("__gone").write.mode("append").parquet(f"{self.path}/data")
        rows.select("__key", (F.col("__seq") + F.col("__gone").cast("long")).alias("__seq")).write.mode("append").parquet(f"{self.path}/deletes")

    def read(self) -> DataFrame:
        """The current state: ``__key``, ``__version`` and the payload."""
        data = self.spark.read.parquet(f"{self.path}/data")
        deletes = self.spark.read.parquet(f"{self.path}/deletes").groupBy("__key").agg(F.max("__seq").alias("__last"))
        d = deletes.select(F.col("__key").alias("__dkey"), "__last")
        alive = data.join(d, (data["__key"] == d["__dkey"]) & (d["__last"] > data["__seq"]), "left_anti")
        # Copies of one change may differ in spelling: the last delivered one stands, then the greatest row.
        last = F.max(F.struct("__at", "__row")).alias("m") if _orderable(data.schema["__row"].dataType) else F.max_by("__row", "__at").alias("m")
        one = alive.groupBy("__key", "__seq").agg(last)
        row = "m.__row.*" if _orderable(data.schema["__row"].dataType) else "m.*"
        return one.select(F.col("__key"), (F.col("__seq") / 2).cast("long").alias("__version"), row)


def _orderable(kind) -> bool:
    text = kind.simpleString()
    return "map<" not in text and "variant" not in text


def current_state(changes: DataFrame, key: Column, version: Column, deleted: Column, arrival: Column, payload: list[str], path: str | None = None) -> DataFrame:
    """Append the whole feed to a new change table and read its state."""
    held = ChangeTable(changes.sparkSession, path)
    held.append(changes, key, version, deleted, arrival, payload)
    return held.read()
