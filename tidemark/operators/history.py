"""Full history of changing attributes from snapshots and published history (problem 2).

Method: tree-reduction coalescing.  Every snapshot row is a unit interval, every
published row an interval of its own.  Snapshot times are numbered, and the times at which
rows of one entity agree in all but time are the bits of one row; of rows that share a time
the greater keeps the bit.  Each run of ones is an interval, too.  Intervals of one entity
get positions in time order.  In round r, blocks of 2^r positions are merged in pairs: the
run that ends at the middle of a pair and the run that starts there become one if they touch
in time and their payload is equal.  After ceil(log2(n)) rounds every maximal run is
one row.

Each round is one hash aggregation with fixed-width buffers.  Its key starts with
the entity, so the partitioning by entity that numbers the intervals serves all
rounds and none of them shuffles.  A run meets at most one partner per round: no
group ever holds more than two rows.

An entity's rows are reduced, map-side first, to one per distinct content and 62 snapshot
times, or per distinct start and content, before any window sees them: an entity that holds
a third of all rows has at most as many as it has versions.  Jobs that run when the plan is
made: two writes of the snapshot times, their number, and the most published rows of an entity.

Defined results: null is a payload value of its own; rows without entity or start
are ignored; intervals of no length are never valid and vanish; repeated rows count
once; of several rows of one entity in a snapshot the highest version counts, then
the later update, then the greater payload; the snapshots rule from the first one
on, so published rows are cut there; without snapshots the published history stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.session import staged

DAY = 86_400_000_000
#: Stands for "open" while intervals are compared; beyond any real timestamp in microseconds.
OPEN = 2**62
#: Up to so many units an entity may have at most, its rows are not counted for want of a closer bound.
FEW = 1024
#: Snapshot times that a row holds as bits; the sign stays free, so nothing here overflows.
BITS = 62
#: The first and last place of each run of ones in ``bits``; nearly always there is one.
RUNS = f"""
CASE WHEN bit_count(bits & ~shiftleft(bits, 1)) = 1
THEN array(named_struct('a', bit_count(~bits & (bits - 1)), 'b', bit_count(~bits & (bits - 1)) + bit_count(bits) - 1))
ELSE transform(filter(sequence(0, {BITS - 1}), i -> shiftright(bits & ~shiftleft(bits, 1), i) & 1 = 1),
  i -> named_struct('a', i, 'b', i + bit_count(shiftright(bits, i) & ~(shiftright(bits, i) + 1)) - 1)) END
"""


def coalesce_runs(units: DataFrame, payload: list[str], longest: int | None = None) -> DataFrame:
    """Merge touching intervals of equal payload.

    ``units``: entity, ``lo_us``, ``hi_us`` (exclusive, OPEN when open) and the payload
    columns.  Intervals of one entity must have a length and not overlap, so no two pairs
    of blocks meet at one time.  ``longest``: at least the most intervals of an entity;
    counted here, by a job, where it is not known.
    """
    numbered = units.withColumn("lo", F.row_number().over(_each().orderBy("lo_us")).cast("long") - 1)
    numbered = numbered.withColumn("hi", F.col("lo"))
    if longest is None:
        longest = _most(units)
    runs, rounds = numbered, max(0, (longest - 1).bit_length())
    for r in range(rounds):
        half, parent = F.shiftright("lo", r), F.shiftright("lo", r + 1)
        middle = parent * (2 << r) + (1 << r)
        left = half % 2 == 0
        at_middle = F.when(left, F.col("hi") == middle - 1).otherwise(F.col("lo") == middle)
        seam = F.when(at_middle, F.when(left, F.col("hi_us")).otherwise(F.col("lo_us")))
        own = F.when(at_middle, F.lit(-1)).otherwise(F.col("lo"))
        runs = (
            runs.withColumns({"seam": seam, "own": own})
            .groupBy("entity", *payload, "seam", "own")
            .agg(F.min("lo_us").alias("lo_us"), F.max("hi_us").alias("hi_us"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .drop("seam", "own")
        )
    return runs.select("entity", *payload, "lo_us", "hi_us")


def _each(*columns: str) -> WindowSpec:
    """A window for each entity; sorts compare a hash first, as ids often begin alike."""
    return Window.partitionBy(F.xxhash64("entity"), "entity", *columns)


def _most(rows: DataFrame) -> int:
    """The most rows of an entity."""
    named = rows.select("entity", F.col("entity").isNotNull().cast("int").alias("named"))
    return named.groupBy("entity").agg(F.sum("named").alias("n")).agg(F.max("n")).first()[0] or 0


def calendar(times: DataFrame) -> DataFrame:
    """``times``: each snapshot time once, as ``at_us`` -> with its number from 0, ``no``, and the next time, ``hi_us``.

    The next time is looked for inside a day, where there is none in the first of the next
    day with a snapshot: the only rows ordered as a whole are days.
    """
    times = times.withColumn("day", F.expr(f"cast(floor(at_us / {DAY}D) as bigint)"))
    of_day, by_day = Window.partitionBy("day").orderBy("at_us"), Window.orderBy("day")
    inside = times.withColumns({"near": F.lead("at_us").over(of_day), "place": F.row_number().over(of_day)})
    days = times.groupBy("day").agg(F.min("at_us").alias("begins"), F.count(F.lit(1)).alias("n"))
    days = days.withColumns({"far": F.lead("begins").over(by_day), "upto": F.sum("n").over(by_day.rowsBetween(Window.unboundedPreceding, 0))})
    no = F.col("upto") - F.col("n") + F.col("place") - 1
    return inside.join(days.select("day", "n", "far", "upto"), "day").select("at_us", no.alias("no"), F.coalesce("near", "far", F.lit(OPEN)).alias("hi_us"))


def snapshot_units(snapshots: DataFrame, payload: list[str], dates: DataFrame) -> DataFrame:
    """``snapshots``: entity, ``at_us``, ``version``, ``updated_us``, ``gone`` and payload -> a unit for each time in a row that a row is valid.

    ``dates``: the ``calendar`` of the snapshots' times.
    """
    order = ["version", "updated_us", *payload, "gone"]
    # Rows without entity or time have no bits: a filter on these would be made at the scan and clean each id twice.
    seen = (
        snapshots.withColumns({"gone": F.coalesce("gone", F.lit(False)), "named": F.col("entity").isNotNull()})
        .join(dates.select("at_us", F.expr(f"no div {BITS}").alias("block"), F.expr(f"shiftleft(1L, cast(no % {BITS} as int))").alias("bit")), "at_us", "left")
        .groupBy("entity", "block", *order)
        .agg(F.bit_or(F.when(F.col("named"), F.col("bit"))).alias("bits"))
        .filter("bits is not null")
    )
    greater = _each("block").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.bit_or("bits").over(greater), F.lit(0).cast("long"))
    best = seen.repartition("entity").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(taken))).filter("not gone and bits != 0")
    runs = best.select("entity", "block", *payload, F.inline(F.expr(RUNS)))
    first, last = dates.select(F.col("no").alias("first"), F.col("at_us").alias("lo_us")), dates.select(F.col("no").alias("last"), "hi_us")
    numbered = runs.select("entity", *payload, (F.col("block") * BITS + F.col("a")).alias("first"), (F.col("block") * BITS + F.col("b")).alias("last"))
    return numbered.join(first, "first").join(last, "last").select("entity", "lo_us", "hi_us", *payload)


def published_units(published: DataFrame, dates: DataFrame, payload: list[str]) -> DataFrame:
    """``published``: entity, ``start_us``, ``end_us``, ``version`` and payload -> units that end before the first snapshot."""
    order = ["version", *payload]
    named = F.col("entity").isNotNull() & F.col("start_us").isNotNull()
    seen = (
        published.withColumn("named", named)
        .groupBy("entity", "start_us", *order)
        .agg(F.max(F.when(F.col("named"), F.coalesce("end_us", F.lit(OPEN)))).alias("end_us"))
        .filter("end_us is not null")
        .repartition("entity")
    )
    # Of rows with one start all but the greatest are followed by that start: they have no length.
    following = F.lead("start_us", 1, OPEN).over(_each().orderBy("start_us", *order))
    first = F.coalesce(dates.agg(F.min("at_us")).scalar(), F.lit(OPEN))
    return (
        seen.withColumn("next_us", following)
        .select("entity", F.col("start_us").alias("lo_us"), F.least("end_us", "next_us", first).alias("hi_us"), *payload)
        .filter("hi_us > lo_us")
    )


def full_history(published: DataFrame, snapshots: DataFrame, payload: list[str]) -> DataFrame:
    """All versions: entity, payload, ``start_at`` and ``end_at`` (null while open), with ``lo_us`` and ``hi_us``."""
    times = staged(snapshots.select("at_us").distinct(), "history-times")
    dates = staged(calendar(times.filter("at_us is not null")), "history-calendar")
    units = published_units(published, dates, payload).unionByName(snapshot_units(snapshots, payload, dates))
    # Repeated rows count too here, and every snapshot for each entity: a round too many changes nothing.
    longest = dates.count() + _most(published)
    if longest > FEW:
        starts = _most(published.select("entity", "start_us").distinct())
        longest = min(dates.count() + starts, _most(published.select("entity").unionByName(snapshots.select("entity"))))
    runs = coalesce_runs(units, payload, longest)
    return runs.withColumns({
        "start_at": F.timestamp_micros("lo_us"),
        "end_at": F.when(F.col("hi_us") < OPEN, F.timestamp_micros(F.when(F.col("hi_us") < OPEN, F.col("hi_us")))),
    })
