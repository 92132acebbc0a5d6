"""Structured Streaming flows, all triggered: they take what is there and stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import cdc, late
from tidemark.operators.events import LATE_SECONDS, is_late

WATERMARK = "6 hours"


def run(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all available rows to a table, exactly once per checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def trusted(stream: DataFrame, event_time: str = "event_timestamp", watermark: str = WATERMARK, threshold: int = LATE_SECONDS) -> DataFrame:
    """One delivery per event_id within the watermark, with its timing class.

    State is one key per event of the last ``watermark``; older events are dropped by Spark,
    so a first load must come in event-time order or in one batch.
    """
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, watermark)
    once = timed.dropDuplicatesWithinWatermark(["event_id"])
    hit = is_late(threshold=threshold)
    return once.withColumns({"is_late_arrival": hit, "event_arrival_classification": F.when(hit, "LATE_ACCEPTED").otherwise("ON_TIME"), "event_watermark_policy": F.lit(watermark)})


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers N of the finished folders ``name=N`` below ``path``, in order."""
    if not _exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    names = [f.getPath().getName() for f in found]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{name}=") and n.split("=")[1].isdigit() and _exists(spark, f"{path}/{n}/_SUCCESS"))


#: Batches after which what they left is written together.
COMPACT = 8


class ChangeFeed:
    """Applies a stream of changes: an append-only log, from which both states are derived.

    A batch that is delivered again after a failure adds repeated log rows, which the log's
    deduplication removes: the result does not depend on batching, order or repeats.  Every
    COMPACT batches the log so far is written once more, deduplicated; from then on that and
    the batches after it are read, so a state costs the log's size, not that of all deliveries.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, version: str = "record_version", deleted: str = "is_deleted", tie: str = "source_updated_at", compact: int = COMPACT):
        self.spark, self.path, self.key, self.version, self.deleted, self.tie, self.compact = spark, path, key, version, deleted, tie, compact

    def step(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id:08d}")
        if (batch_id + 1) % self.compact == 0:
            self._log(upto=batch_id).write.mode("overwrite").parquet(f"{self.path}/base={batch_id:08d}")

    def seed(self, snapshot: DataFrame) -> None:
        """Hydrate from a snapshot, once: later calls find it done."""
        if _exists(self.spark, f"{self.path}/seed/_SUCCESS"):
            return
        snapshot.write.mode("overwrite").parquet(f"{self.path}/seed")

    def _log(self, upto: int | None = None) -> DataFrame:
        """Read from the newest base before the end, and the batches after it."""
        bases = [n for n in _numbers(self.spark, self.path, "base") if upto is None or n < upto]
        after = [n for n in _numbers(self.spark, self.path, "batch") if (upto is None or n <= upto) and (not bases or n > bases[-1])]
        paths = [f"{self.path}/base={bases[-1]:08d}"] if bases else []
        if _exists(self.spark, f"{self.path}/seed/_SUCCESS"):
            paths.append(f"{self.path}/seed")
        paths += [f"{self.path}/batch={n:08d}" for n in after]
        return cdc.change_log(self.spark.read.parquet(*paths), self.key, self.version, self.deleted, self.tie)

    def log(self) -> DataFrame:
        return self._log()

    def current(self) -> DataFrame:
        return cdc.scd1(self.log(), self.key, self.version, self.deleted)

    def history(self) -> DataFrame:
        return cdc.scd2(self.log(), self.key, self.version, self.deleted)


class LateAggregates:
    """Hourly aggregates kept by retraction over micro-batches.

    Keyed state is a table of (period, version, aggregate), written per batch.  A batch
    changes only the periods it touches: for each it emits the old aggregate with
    multiplicity -1 and the new one with +1, and stores the new version.  Events must
    arrive deduplicated, with ``event_us``, ``arrival_us`` and ``amount``.

    Every ``compact`` batches the state is written together, without the periods that can
    no longer change: those whose cut-off lies more than ``slack_us`` before the latest
    arrival.  A batch reads that and the batches since, so its cost does not grow with their
    number.  Batches must come in order of arrival up to ``slack_us``; a later event of a
    period that has expired is refused with an error, not lost.
    """

    STATE = "period long, version int, n long, amount decimal(38,2), seen_us long"

    def __init__(self, spark: SparkSession, path: str, compact: int = COMPACT, slack_us: int = 24 * late.HOUR, cutoff_us: int = 6 * late.HOUR, period_us: int = late.HOUR):
        self.spark, self.path, self.compact, self.slack_us, self.cutoff_us, self.period_us = spark, path, compact, slack_us, cutoff_us, period_us

    def _folders(self, kind: str, before: int | None) -> list[str]:
        return [f"{self.path}/{kind}/batch={n}" for n in _numbers(self.spark, f"{self.path}/{kind}", "batch") if before is None or n < before]

    def _base(self, before: int | None) -> int | None:
        found = [n for n in _numbers(self.spark, f"{self.path}/base", "upto") if before is None or n <= before]
        return found[-1] if found else None

    def state(self, before: int | None = None) -> DataFrame:
        """The newest version of every period that can still change, or has since the last compaction."""
        base = self._base(before)
        paths = [f"{self.path}/state/batch={n}" for n in _numbers(self.spark, f"{self.path}/state", "batch") if (before is None or n < before) and (base is None or n >= base)]
        paths += [f"{self.path}/base/upto={base}"] if base is not None else []
        rows = self.spark.read.schema(self.STATE).parquet(*paths) if paths else self.spark.createDataFrame([], self.STATE)
        return rows.groupBy("period").agg(F.max_by(F.struct("version", "n", "amount"), "version").alias("s"), F.max("seen_us").alias("seen_us")).select("period", "s.*", "seen_us")

    def log(self) -> DataFrame:
        paths, schema = self._folders("log", None), "period long, version int, mult int, n long, amount decimal(38,2)"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _horizon(self, before: int | None) -> int | None:
        """Periods that begin before this have expired."""
        base = self._base(before)
        path = f"{self.path}/horizon/upto={base}"
        return self.spark.read.parquet(path).first()[0] if base is not None else None

    def step(self, batch: DataFrame, batch_id: int) -> None:
        """Idempotent: a repeated batch reads the state before it and rewrites its own rows."""
        if batch_id and batch_id % self.compact == 0 and self._base(batch_id) != batch_id:
            self._compact(batch_id)
        kept = late.input_deltas(batch, cutoff_us=self.cutoff_us, period_us=self.period_us).filter("outcome != 'DROPPED'")
        horizon = self._horizon(batch_id)
        if horizon is not None:
            gone = F.raise_error(F.lit("an event came for a period that has expired: raise slack_us"))
            kept = kept.withColumn("period", F.when(F.col("period") < horizon, gone.cast("long")).otherwise(F.col("period")))
        delta = kept.groupBy("period").agg(F.count(F.lit(1)).alias("dn"), F.sum(F.coalesce(F.col("amount"), F.lit(0)).cast("decimal(38,2)")).alias("da"), F.max("arrival_us").alias("seen_us"))
        both = delta.join(self.state(before=batch_id).drop("seen_us"), "period", "left")
        new = both.select("period", F.coalesce(F.col("version") + 1, F.lit(0)).alias("version"), "n", "amount", (F.coalesce("n", F.lit(0)) + F.col("dn")).alias("n2"), (F.coalesce("amount", F.lit(0)) + F.col("da")).cast("decimal(38,2)").alias("a2"), "seen_us")
        new = new.persist()
        try:
            new.select("period", "version", F.col("n2").alias("n"), F.col("a2").alias("amount"), "seen_us").write.mode("overwrite").parquet(f"{self.path}/state/batch={batch_id}")
            old_row = F.struct(F.lit(-1).alias("mult"), F.col("n"), F.col("amount"))
            new_row = F.struct(F.lit(1).alias("mult"), F.col("n2").alias("n"), F.col("a2").alias("amount"))
            pair = F.when(F.col("n").isNotNull(), F.array(old_row, new_row)).otherwise(F.array(new_row))
            new.select("period", "version", F.explode(pair).alias("c")).select("period", "version", "c.*").write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_id}")
        finally:
            new.unpersist()

    def _compact(self, upto: int) -> None:
        held = self.state(before=upto)
        last = held.agg(F.max("seen_us")).first()[0]
        old = self._horizon(upto)
        horizon = max(x for x in (old, None if last is None else last - self.slack_us - self.cutoff_us - self.period_us, -(2**62)) if x is not None)
        self.spark.createDataFrame([(horizon,)], "horizon long").write.mode("overwrite").parquet(f"{self.path}/horizon/upto={upto}")
        held.filter(F.col("period") >= horizon).write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")
