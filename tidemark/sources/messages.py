"""Kafka-shaped message sources: the connector where it is installed, else a file replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import schemas


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """One topic from its earliest offset; data loss fails the query.  Needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.options(**{"startingOffsets": "earliest", "failOnDataLoss": "true", **options}).load()


def replay_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same columns from recorded files."""
    reader = spark.readStream.schema(schemas.KAFKA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def to_records(envelopes: DataFrame, topic: str, key: str, arrival: str, partitions: int = 6) -> DataFrame:
    """Validated envelopes as records: key, value, partition by key hash, offsets in arrival order.

    Envelopes without key or payload are refused.  Offsets are contiguous per partition.
    Records are numbered inside a minute of arrival, and the minutes before add their counts,
    so numbering is as many tasks as there are minutes, however few partitions the topic has.
    """
    from pyspark.sql import Window

    body = F.to_json(F.struct(*[F.col(c) for c in envelopes.columns if c != key]))
    ok = F.col(key).isNotNull() & F.col("payload").isNotNull()
    checked = envelopes.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("envelope without key or payload")).cast("boolean")))
    part = F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")
    rows = checked.select(F.col(key).cast("binary").alias("key"), body.cast("binary").alias("value"), F.lit(topic).alias("topic"), part.alias("partition"), F.col(arrival).cast("timestamp").alias("timestamp"))
    minutes = rows.withColumn("__m", F.date_trunc("minute", "timestamp"))
    before = F.sum("__n").over(Window.partitionBy("partition").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1))
    starts = minutes.groupBy("partition", "__m").agg(F.count(F.lit(1)).alias("__n")).select(F.col("partition").alias("__p"), F.col("__m").alias("__s"), F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("partition", "__m").orderBy("timestamp", "key", "value")) - 1
    numbered = minutes.withColumn("__i", inside)
    both = numbered.join(starts, (numbered["partition"] == starts["__p"]) & numbered["__m"].eqNullSafe(starts["__s"]))
    return both.select("key", "value", "topic", "partition", (F.col("__before") + F.col("__i")).cast("long").alias("offset"), "timestamp", F.lit(0).alias("timestampType"))


def publish(records: DataFrame, path: str, limit: int | None = None) -> int:
    """Append records to a replay folder, at most ``limit`` of them in offset order; returns how many."""
    out = records if limit is None else records.orderBy("timestamp", "partition", "offset").limit(limit)
    out.write.mode("append").parquet(path)
    return out.count()
