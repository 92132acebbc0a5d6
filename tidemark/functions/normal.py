"""Normalisation shared by every operator: ids, codes, labels and timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space when values are trimmed.
BLANK = " \t\r\n\x0b\x0c "


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _trimmed(c: Column | str) -> Column:
    text = F.trim(_col(c).cast("string"), F.lit(BLANK))
    return F.when(text != "", text)


def ident(c: Column | str) -> Column:
    """An id, trimmed and lower-cased; blank becomes null."""
    return F.lower(_trimmed(c))


def code(c: Column | str) -> Column:
    """A coded value, trimmed and upper-cased; blank becomes null."""
    return F.upper(_trimmed(c))


def label(c: Column | str) -> Column:
    """A ``source`` or ``lang`` label, trimmed and lower-cased; blank becomes null."""
    return F.lower(_trimmed(c))


def as_ts(c: Column | str) -> Column:
    """A zoned timestamp; parquet's zone-less values are read as UTC by a UTC session."""
    return _col(c).cast("timestamp")


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(as_ts(c))


def pick(df: DataFrame, **columns: Column) -> DataFrame:
    """Only the named columns, computed from ``df``: extra and clashing columns fall away at the scan."""
    return df.select(*[value.alias(name) for name, value in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
