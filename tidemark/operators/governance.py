"""Column masks, row filters, tags and read-only access, applied by rewriting a projection.

Policies are data.  A secured view is a plain projection and filter, so pruning and
pushdown go through it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASKED = "***MASKED***"

#: One definition of each mask; the SQL functions are made from it.
_MASKS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "string": ("STRING", lambda c: F.nvl2(c, F.lit(MASKED), c)),
    "email": ("STRING", lambda c: F.nvl2(c, F.nvl2(F.nullif(F.regexp_extract(c, "(?s)^[^@].*@", 0), F.lit("")), F.concat(F.lit("***@"), F.substring_index(c, "@", -1)), F.lit(MASKED)), c)),
    "birth": ("DATE", lambda c: F.trunc(c, "YEAR")),
}
#: The names the SQL functions have: fixed values.
_NAMES = {"mask_string": "string", "mask_email": "email", "mask_date_of_birth": "birth"}


def register(spark: SparkSession) -> None:
    """The masks as temporary SQL functions, and the row filter as one of a country and the home country."""
    for name, kind in _NAMES.items():
        of, made = _MASKS[kind]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v {of}) RETURNS {of} RETURN {made(F.col('v'))._jc.node().sql()}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION allow_country(c STRING, home STRING) RETURNS BOOLEAN RETURN upper(trim(c)) = home")


def mask(kind: str, c: Column) -> Column:
    if kind not in _MASKS:
        raise ValueError(f"unknown mask {kind}")
    return _MASKS[kind][1](c)


@dataclass(frozen=True)
class Policy:
    """Columns tagged ``tag=value`` are masked for everyone outside ``exempt`` groups."""

    tag: str
    value: str
    kind: str
    exempt: frozenset[str] = frozenset()


@dataclass(frozen=True)
class RowFilter:
    """Members of ``group`` see only rows whose column tagged ``tag`` equals ``value``."""

    tag: str
    group: str
    value: str


def tag_columns(df: DataFrame, tags: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Tags as column metadata, which travels with the schema."""
    return df.select(*[F.col(f"`{f.name}`").alias(f.name, metadata={**f.metadata, "tags": {**f.metadata.get("tags", {}), **tags[f.name]}}) if f.name in tags else F.col(f"`{f.name}`") for f in df.schema])


def secured(df: DataFrame, groups: Collection[str], masks: Sequence[Policy], filters: Sequence[RowFilter] = ()) -> DataFrame:
    """``df`` as a principal in ``groups`` may see it."""
    tags = {f.name: f.metadata.get("tags", {}) for f in df.schema}
    out = df
    for f in filters:
        if f.group in groups:
            hits = [c for c, t in tags.items() if f.tag in t]
            for c in hits:
                out = out.filter(F.upper(F.trim(F.col(c))) == f.value)
    cols = []
    for c in df.columns:
        kind = next((p.kind for p in masks if tags[c].get(p.tag) == p.value and not p.exempt & set(groups)), None)
        cols.append(mask(kind, F.col(f"`{c}`")).alias(c) if kind else F.col(f"`{c}`"))
    return out.select(*cols)


def tag_coverage(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Per column the value of each wanted tag, and whether all are there."""
    rows = [(f.name, t, v) for f in df.schema for t, v in (f.metadata.get("tags") or {"": None}).items()]
    long = df.sparkSession.createDataFrame(rows, "column_name string, tag string, value string")
    out = long.groupBy("column_name").agg(*[F.max(F.when(F.col("tag") == t, F.col("value"))).alias(t) for t in wanted])
    full = F.lit(True)
    for t in wanted:
        full = full & F.col(t).isNotNull()
    return out.withColumn("is_covered", full)


def grants_check(grants: DataFrame, expected: DataFrame) -> DataFrame:
    """Grants missing from, or beyond, the expected matrix."""
    keys = ["principal", "privilege", "securable"]
    a, b = grants.select(*keys).distinct(), expected.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("finding", F.lit("MISSING")).unionByName(a.join(b, keys, "left_anti").withColumn("finding", F.lit("UNEXPECTED")))


def forbid_columns(df: DataFrame, forbidden: Collection[str]) -> DataFrame:
    """``df``, or an error naming the columns it must not have."""
    hit = sorted(set(df.columns) & set(forbidden))
    if hit:
        raise ValueError(f"forbidden columns: {hit}")
    return df


_WRITES = re.compile(r"(?i)\b(insert|update|delete|merge|drop|alter|create|truncate|replace|grant|revoke|copy)\b")


def read_only(spark: SparkSession, query: str) -> DataFrame:
    """Run a query that only reads.  The text must begin as one and the plan must hold no command."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", query)  # without string literals
    if not re.match(r"(?is)\s*(select|with)\b", bare) or _WRITES.search(bare) or ";" in bare.strip().rstrip(";"):
        raise PermissionError("only SELECT statements are allowed")
    df = spark.sql(query)
    if "Command" in df._jdf.queryExecution().analyzed().getClass().getSimpleName():
        raise PermissionError("only SELECT statements are allowed")
    return df


def identifier(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def transaction_id(value: str) -> str:
    if not re.fullmatch(r"txn-\d{8}", value):
        raise ValueError(f"not a transaction id: {value!r}")
    return value


def table_function(spark: SparkSession, name: str, argument: str, view: str, columns: Mapping[str, str]) -> None:
    """A temporary SQL table function: the row of ``view`` with that key, at most one."""
    out = ", ".join(f"{identifier(c)} {t}" for c, t in columns.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {identifier(name)}(wanted STRING) RETURNS TABLE({out}) RETURN SELECT {', '.join(columns)} FROM {identifier(view)} WHERE {identifier(argument)} = wanted LIMIT 1")
