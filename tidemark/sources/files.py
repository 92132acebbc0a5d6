"""File sources and sinks: batch and streaming readers with lineage, a load ledger, exports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.standardize import blank_to_null
from tidemark.session import staged, work_dir
from tidemark.sources import schemas

LINEAGE = {"source_file": "_metadata.file_path", "source_file_name": "_metadata.file_name"}


def with_lineage(df: DataFrame, loaded_at: str | None = None) -> DataFrame:
    """Adds the file each row came from and, where given, a fixed load time (else now)."""
    at = F.current_timestamp() if loaded_at is None else F.lit(loaded_at).cast("timestamp")
    return df.select("*", *[F.col(path).alias(name) for name, path in LINEAGE.items()], at.alias("bronze_ingested_at"))


def read_json_lines(spark: SparkSession, path: str, schema: str, loaded_at: str | None = None) -> DataFrame:
    """JSON lines below ``path`` at any depth; malformed fields are null, never an error."""
    raw = spark.read.schema(schema).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").json(path)
    return with_lineage(raw, loaded_at)


def read_csv(spark: SparkSession, path: str, schema: str, loaded_at: str | None = None) -> DataFrame:
    return with_lineage(spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path), loaded_at)


def transactions(spark: SparkSession, path: str, loaded_at: str | None = None) -> DataFrame:
    raw = read_json_lines(spark, path, schemas.TRANSACTIONS, loaded_at)
    return raw.withColumns({"event_timestamp": F.try_to_timestamp("event_timestamp"), "amount": F.col("amount").try_cast("decimal(18,2)")})


def fraud_cases(spark: SparkSession, path: str, loaded_at: str | None = None) -> DataFrame:
    return read_csv(spark, path, schemas.FRAUD_CASES, loaded_at).withColumn("closed_at", blank_to_null("closed_at", "timestamp"))


def stream_csv(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A directory of CSV files as a stream, existing files included."""
    reader = spark.readStream.schema(schema).option("header", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return with_lineage(reader.csv(path))


def stream_table(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stored table as a stream of its new files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def in_event_order(df: DataFrame, at: str, path: str, buckets: int) -> None:
    """Write a replay whose files follow event time, for sources that cannot sort a first snapshot.

    A range partitioning by event time makes bucket i entirely earlier than i + 1, and file
    names and modification times rise with it.
    """
    aside = work_dir(df.sparkSession, "event-order")
    df.repartitionByRange(buckets, at).withColumn("__b", F.spark_partition_id()).write.mode("overwrite").partitionBy("__b").parquet(aside)
    for b in range(buckets):  # one small job per file, so that modification times rise in order
        rows = df.sparkSession.read.schema(f"{_ddl(df)}, __b int").parquet(aside).filter(F.col("__b") == b).drop("__b")
        rows.coalesce(1).write.mode("append").parquet(path)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


class Ledger:
    """Files already loaded into a table; loading again skips them."""

    SCHEMA = "target string, file_path string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def loaded(self, target: str) -> DataFrame:
        try:
            known = self.spark.read.schema(self.SCHEMA).parquet(self.path)
            known.schema
            return known.filter(F.col("target") == target)
        except Exception:  # nothing has been loaded yet
            return self.spark.createDataFrame([], self.SCHEMA)

    def load(self, target: str, rows: DataFrame, table_path: str, force: bool = False) -> int:
        """Append the rows of files not loaded before; returns the number of new files."""
        files = rows.select(F.col("source_file").alias("file_path")).distinct()
        fresh = files if force else files.join(self.loaded(target), "file_path", "left_anti")
        fresh = staged(fresh, "fresh-files")  # fixed before the ledger grows
        count = fresh.count()
        if count:
            rows.join(fresh, rows["source_file"] == fresh["file_path"], "left_semi").write.mode("append").parquet(table_path)
            fresh.select(F.lit(target).alias("target"), "file_path").coalesce(1).write.mode("append").parquet(self.path)
        return count


def read_files(spark: SparkSession, path: str, fmt: str = "csv", view: str | None = None, **options: str) -> DataFrame:
    """An ad-hoc read with inferred schema, optionally as a temporary view."""
    df = spark.read.format(fmt).options(**{"header": "true", "inferSchema": "true", **options}).load(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = (), properties: Mapping[str, str] | None = None) -> None:
    """Append, or replace rows and schema; table properties are kept beside the data."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if properties is not None:
        set_properties(df.sparkSession, path, properties)


def set_properties(spark: SparkSession, path: str, properties: Mapping[str, str]) -> None:
    spark.createDataFrame([(json.dumps(dict(properties), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_properties")


def properties(spark: SparkSession, path: str) -> dict[str, str]:
    return json.loads(spark.read.text(f"{path}/_properties").first()[0])


def replace_rows(df: DataFrame, path: str) -> None:
    """Delete all rows and insert these; safe where ``df`` reads the same table."""
    staged(df, "replace").write.mode("overwrite").parquet(path)


def insert(spark: SparkSession, path: str, query: str, args: Mapping[str, object]) -> None:
    """Append the rows of a parameterised query; values are bound, never pasted into the text."""
    spark.sql(query, args=dict(args)).write.mode("append").parquet(path)


def export(tables: Mapping[str, DataFrame], root: str) -> DataFrame:
    """Source-system layout: CSV snapshots, date-partitioned JSON lines, and a manifest of row counts."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        if "event_date" in df.columns:
            target = f"{root}/historical/{name}"
            df.write.mode("overwrite").partitionBy("event_date").json(target)
        else:
            target = f"{root}/snapshots/{name}"
            df.write.mode("overwrite").option("header", True).csv(target)
        rows.append((name, target, df.count()))
    manifest = spark.createDataFrame(rows, "name string, path string, row_count long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    return manifest
