"""References to records that do not exist (problem 6).

Method: parents and children go into one long form tagged by their role, grouped by
parent table and key; groups without the parent flag are orphans, and their counts are
summed by period.  Children are reduced to one row per key (and period) before the
union, combined map-side, so a hot key is one row per map task, and buffers are
fixed-width; with periods, a key keeps one counter per period.

References that exist but not at the event's time are found in the same groups: parents
carry when they first existed and whether they ever ceased to, children the range of
their times.  A key all of whose children come before its first parent is LATER as a
whole; only children of keys in doubt (some before, or any gap) are then looked up at
their own time (:mod:`tidemark.operators.known_time`).

Defined results: null and blank keys refer to nothing; a key that has a row, but no
version, is neither missing nor judged in time; events without time are judged for
MISSING only; repeated child rows give one finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import known_time
from tidemark.session import staged

_LONG = {"parent": "boolean", "first_us": "long", "ceases": "boolean"}


def _verdict(lo: Column, hi: Column) -> Column:
    """What a group says about children between two times: a reason, DOUBT, or null."""
    first = F.col("first_us")
    doubt = F.coalesce(lo < first, F.lit(False)) | F.coalesce("ceases", F.lit(False))
    return F.when(~F.col("has_parent"), "MISSING").when(hi < first, "LATER").when(doubt, "DOUBT")


def _tagged(parents: DataFrame, children: DataFrame, counter: dict[str, str]) -> DataFrame:
    """The long form: parents with their lives, children with their counters."""
    above = parents.select("table", "key", F.lit(True).alias("parent"), "first_us", "ceases", *[F.lit(None).cast(t).alias(c) for c, t in counter.items()])
    below = children.select("table", "key", F.lit(False).alias("parent"), *[F.lit(None).cast(_LONG[c]).alias(c) for c in ("first_us", "ceases")], *counter)
    return above.unionByName(below)


def groups(parents: DataFrame, children: DataFrame) -> DataFrame:
    """One row per parent table and key that has children: ``refs`` and ``verdict``.

    ``parents``: table, key, ``first_us``, ``ceases`` (both may be null).
    ``children``: table, key, ``at_us``.
    """
    rows = children.filter("key is not null").select("table", "key", F.col("at_us").alias("lo"), F.col("at_us").alias("hi"), F.lit(1).cast("long").alias("refs"))
    long = _tagged(parents, rows, {"lo": "long", "hi": "long", "refs": "long"})
    made = long.groupBy("table", "key").agg(*_life(), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("refs").alias("refs")).filter("refs > 0")
    return made.select("table", "key", "refs", _verdict(F.col("lo"), F.col("hi")).alias("verdict"))


def groups_by_period(parents: DataFrame, children: DataFrame) -> DataFrame:
    """One row per parent table, key and period: ``refs``, ``timed`` and ``verdict``; ``children`` has ``period`` besides."""
    rows = children.filter("key is not null").groupBy("table", "key", "period").agg(F.count(F.lit(1)).alias("refs"), F.count("at_us").alias("timed"), F.min("at_us").alias("lo"), F.max("at_us").alias("hi"))
    counter = rows.select("table", "key", F.struct("period", "refs", "timed", "lo", "hi").alias("counter"))
    known = parents.groupBy("table", "key").agg(F.min("first_us").alias("first_us"), F.max("ceases").alias("ceases"))
    long = _tagged(known, counter, {"counter": counter.schema["counter"].dataType.simpleString()})
    made = long.groupBy("table", "key").agg(*_life(), F.collect_list("counter").alias("by"))
    flat = made.select("table", "key", "has_parent", "first_us", "ceases", F.explode("by").alias("c"))
    return flat.select("table", "key", "c.period", "c.refs", "c.timed", _verdict(F.col("c.lo"), F.col("c.hi")).alias("verdict"))


def _life() -> list[Column]:
    return [F.max("parent").alias("has_parent"), F.min("first_us").alias("first_us"), F.max("ceases").alias("ceases")]


def missing_by_period(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Orphans per parent table and period, by grouping alone: no join at all."""
    made = groups_by_period(parents, children).filter("verdict = 'MISSING'")
    return made.groupBy("table", "period").agg(F.sum("refs").alias("orphans"))


def _looked_up(doubtful: DataFrame, versions: DataFrame, carry: list[str]) -> DataFrame:
    """The children that refer, at their own time, to nothing: ``carry``, table and ``reason``."""
    asked = doubtful.filter("at_us is not null").select("table", *carry, F.concat_ws("|", "table", "key").alias("entity"), F.col("at_us").alias("known_us"), F.col("probe").alias("key"))
    found = known_time.lookup(asked, versions, ["table", *carry])
    reason = F.when(F.col("state") == "EARLY", "LATER").when(F.col("state") == "GONE", "DELETED")
    return found.select("table", *carry, reason.alias("reason")).filter("reason is not null")


def _asking(children: DataFrame) -> DataFrame:
    """``children`` with the valid-time probe; the last version where they name none."""
    rows = children.filter("key is not null")
    return rows if "probe" in rows.columns else rows.withColumn("probe", F.lit(known_time.TOP))


def findings(parents: DataFrame, versions: DataFrame, children: DataFrame, carry: list[str]) -> DataFrame:
    """The children with a reference that does not hold: ``carry``, table, ``reason``.

    ``versions``: entity (``table|key``), ``known_us``, ``key``, ``value``, ``deleted``.
    ``children`` may have ``probe``, where to look on the valid-time axis.
    """
    suspects = groups(parents, children).filter("verdict is not null").select("table", "key", "verdict")
    # Stored once: both branches below read it, and the lookup reads its branch twice.
    rows = staged(_asking(children).select("table", "key", "at_us", "probe", *carry).join(suspects, ["table", "key"]), "suspect-references")
    decided = rows.filter("verdict = 'MISSING' or (verdict = 'LATER' and at_us is not null)").select("table", *carry, F.col("verdict").alias("reason"))
    return decided.unionByName(_looked_up(rows.filter("verdict = 'DOUBT'"), versions, carry)).distinct()


def report(parents: DataFrame, versions: DataFrame, children: DataFrame) -> DataFrame:
    """``table``, ``period``, ``reason``, ``refs``: the groups' counters summed by period.

    What a group decides is counted from its counters alone; only children of groups in
    doubt are looked up and counted one by one.  Each child counts: pass every reference once.
    """
    by = groups_by_period(parents, children)
    decided = by.filter("verdict in ('MISSING', 'LATER')").select("table", "period", F.col("verdict").alias("reason"), F.when(F.col("verdict") == "LATER", F.col("timed")).otherwise(F.col("refs")).alias("refs"))
    doubt = by.filter("verdict = 'DOUBT'").select("table", "key", F.col("period").alias("doubt_period"))
    rows = _asking(children)
    same = (rows["table"] == doubt["table"]) & (rows["key"] == doubt["key"]) & rows["period"].eqNullSafe(doubt["doubt_period"])
    asked = staged(rows.join(doubt, same, "left_semi").select("table", "key", "at_us", "probe", "period"), "doubtful-references")
    looked = _looked_up(asked, versions, ["period"]).select("table", "period", "reason", F.lit(1).cast("long").alias("refs"))
    return decided.unionByName(looked).groupBy("table", "period", "reason").agg(F.sum("refs").alias("refs")).filter("refs > 0")
