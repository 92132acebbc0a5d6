"""Keyed merges without a table format: full-outer rewrites, one shuffle per side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DuplicateKeys(ValueError):
    """The source of a merge has two rows for one key."""


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise DuplicateKeys(f"several source rows for one of {list(keys)}")


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], *, only_changed: bool = False, delete_missing: bool = False, keep: Sequence[str] = (), stamp: dict[str, Column] | None = None, check: bool = True) -> DataFrame:
    """The target after the merge.

    ``only_changed``: a matched row is replaced only where a value differs, null-safe;
    ``delete_missing``: target rows without source row go; ``keep``: target columns that a
    matched row retains (``created_at``); ``stamp``: columns set on every inserted or
    changed row (``updated_at``).  Raises :class:`DuplicateKeys` where a key repeats in the
    source.
    """
    if check:
        require_unique(source, keys)
    k, stamp = list(keys), stamp or {}
    values = [c for c in target.columns if c not in k]
    fresh = [c for c in values if c in source.columns]
    t = target.select(*k, F.struct(*values).alias("__t"))
    s = source.select(*k, F.struct(*fresh).alias("__s"))
    both = t.join(s, k, "full_outer")
    old, new = F.col("__t").isNotNull(), F.col("__s").isNotNull()
    compared = [c for c in fresh if c not in keep and c not in stamp]
    differs = F.lit(False)
    for c in compared:
        differs = differs | ~F.col(f"__t.{c}").eqNullSafe(F.col(f"__s.{c}"))
    touched = new & (~old | (differs if only_changed else F.lit(True)))
    cols = []
    for c in values:
        own = F.col(f"__t.{c}")
        given = stamp[c] if c in stamp else (F.col(f"__s.{c}") if c in fresh else own)
        if c in keep:
            given = F.when(old, own).otherwise(given)
        cols.append(F.when(touched, given).otherwise(own).alias(c))
    return (both.filter(new) if delete_missing else both).select(*k, *cols)


def changes(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a change-only merge would do: the keys and INSERT, UPDATE, DELETE or SAME."""
    k = list(keys)
    values = [c for c in target.columns if c not in k and c in source.columns]
    t, s = target.select(*k, F.struct(*values).alias("__t")), source.select(*k, F.struct(*values).alias("__s"))
    act = F.when(F.col("__t").isNull(), "INSERT").when(F.col("__s").isNull(), "DELETE").when(F.col("__t").eqNullSafe(F.col("__s")), "SAME").otherwise("UPDATE")
    return t.join(s, k, "full_outer").select(*k, act.alias("action"))
