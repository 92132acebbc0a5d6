"""Per-period aggregates by event time, corrected by late events up to a cut-off (problem 4).

Method: retraction-based differential updates.  Every event is an input delta.
Deltas are summed per (period, arrival epoch), combined map-side.  A period is first
published when it closes (version 0: what arrived within ``on_time_us``).  Each later
epoch that brings a late event emits two rows: the old aggregate with multiplicity -1
and the new one with +1.  The rows carry the version of the period's state, so a
consumer that keeps versioned keyed state can apply them once, and downstream
aggregates are updated by the same rule from the rows alone (:func:`downstream`).

Scale: state is one row per (period, epoch) and a period can only see the epochs up to
the cut-off, so the window that numbers versions sorts at most
``(period + cutoff) / epoch`` rows.  Events of a hot period leave one row per map task.

Defined results: events without event time take no part; a null arrival is never late
and belongs to version 0; a null amount adds 0 but counts; delay is compared in
microseconds, limits inclusive; early arrivals (negative delay) are on time; events
beyond the cut-off are left out of the aggregates and come out as dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
#: Sequence numbers are compared in blocks of this size, see :func:`out_of_order`.
BLOCK = 1024


def input_deltas(events: DataFrame, on_time_us: int = 2 * HOUR, cutoff_us: int = 6 * HOUR, period_us: int = HOUR, epoch_us: int = HOUR // 6) -> DataFrame:
    """``events`` with ``event_us`` and ``arrival_us``: adds period, epoch and outcome.

    Epoch -1 is the first publication.
    """
    delay = F.coalesce(F.col("arrival_us") - F.col("event_us"), F.lit(0))
    outcome = F.when(delay > cutoff_us, "DROPPED").when(delay > on_time_us, "CORRECTS").otherwise("ON_TIME")
    return (
        events.filter("event_us is not null")
        .withColumn("outcome", outcome)
        .withColumn("period", F.expr(f"event_us - pmod(event_us, {period_us}L)"))
        .withColumn("epoch", F.when(F.col("outcome") == "CORRECTS", F.expr(f"(arrival_us - pmod(arrival_us, {epoch_us}L))")).otherwise(F.lit(-1)))
    )


def versions(deltas: DataFrame) -> DataFrame:
    """The versioned state: per period and epoch the aggregate before and after it."""
    kept = deltas.filter("outcome != 'DROPPED'")
    summed = kept.groupBy("period", "epoch").agg(
        F.count(F.lit(1)).alias("d_count"), F.sum(F.coalesce(F.col("amount"), F.lit(0)).cast("decimal(38,2)")).alias("d_amount")
    )
    return _versioned(summed)


def _versioned(summed: DataFrame) -> DataFrame:
    """Number the epochs of a period and run their deltas up.

    A period of late events only was published as empty: its first correction is
    version 1 and retracts zero.
    """
    w = Window.partitionBy("period").orderBy("epoch")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    money = "decimal(38,2)"
    state = summed.withColumns({
        "new_count": F.sum("d_count").over(running), "new_amount": F.sum("d_amount").over(running).cast(money),
        "rank": F.row_number().over(w), "first_epoch": F.min("epoch").over(running),
    })
    return state.select(
        "period", "epoch",
        (F.col("rank") - F.when(F.col("first_epoch") == -1, 1).otherwise(0)).alias("version"),
        (F.col("new_count") - F.col("d_count")).alias("old_count"), (F.col("new_amount") - F.col("d_amount")).cast(money).alias("old_amount"),
        "new_count", "new_amount",
    )


def retractions(state: DataFrame) -> DataFrame:
    """The change log: period, version, epoch, multiplicity and the aggregate it takes away or adds."""
    old = F.struct(F.lit(-1).alias("mult"), F.col("old_count").alias("n"), F.col("old_amount").alias("amount"))
    new = F.struct(F.lit(1).alias("mult"), F.col("new_count").alias("n"), F.col("new_amount").alias("amount"))
    pair = F.when(F.col("version") > 0, F.array(old, new)).otherwise(F.array(new))
    return state.select("period", "version", "epoch", F.explode(pair).alias("c")).select("period", "version", "epoch", "c.*")


def downstream(changes: DataFrame, period_us: int) -> DataFrame:
    """Versioned state of a coarser period, from the change log of a finer one alone.

    ``changes`` may be the log of :func:`retractions`; the result has the shape of
    :func:`versions` and can be retracted again.
    """
    coarse = changes.select(F.expr(f"period - pmod(period, {period_us}L)").alias("period"), "epoch", (F.col("mult") * F.col("n")).alias("n"), (F.col("mult") * F.col("amount")).alias("amount"))
    summed = coarse.groupBy("period", "epoch").agg(F.sum("n").alias("d_count"), F.sum("amount").cast("decimal(38,2)").alias("d_amount"))
    return _versioned(summed)


def settled(changes: DataFrame) -> DataFrame:
    """What a consumer holds after applying the whole log: the sum of multiplicities times values."""
    return changes.groupBy("period").agg(
        F.sum(F.col("mult") * F.col("n")).alias("n"), F.sum(F.col("mult") * F.col("amount")).cast("decimal(38,2)").alias("amount"), F.max("version").alias("version")
    )


def corrections(deltas: DataFrame, state: DataFrame) -> DataFrame:
    """The input deltas behind the corrections in the change log, each with the version it led to.

    The log decides: an event corrects if the log has a new aggregate (multiplicity +1) of
    its period and epoch beyond the first publication.
    """
    made = retractions(state).filter("mult = 1 and version > 0").select("period", "epoch", "version")
    return deltas.filter("outcome != 'DROPPED' and epoch != -1").join(made, ["period", "epoch"])


def out_of_order(events: DataFrame, group: str, sequence: str, arrival: str) -> DataFrame:
    """Adds ``overtaken``: a higher sequence number of the same group arrived strictly earlier.

    Rows are first reduced to the least arrival per group and sequence number, combined
    map-side, so rows that repeat a number do not meet in a window.  Groups are cut into
    blocks of BLOCK numbers: inside a block a running minimum takes the earliest arrival of
    the higher numbers, and blocks above contribute their own minimum, one row each.  The
    result is joined back by group and number, where AQE splits a number of many rows.
    Rows without group, sequence number or arrival are never overtaken and overtake none.
    """
    usable = F.col(group).isNotNull() & F.col(sequence).isNotNull() & F.col(arrival).isNotNull()
    rest = events.filter(~usable).withColumn("overtaken", F.lit(False))
    rows = events.filter(usable)
    block = F.expr(f"cast(floor({sequence} / {BLOCK}) as bigint)")
    least = rows.groupBy(F.col(group).alias("__g"), F.col(sequence).alias("__s")).agg(F.min(arrival).alias("__least")).withColumn("__block", F.expr(f"cast(floor(__s / {BLOCK}) as bigint)"))
    above = Window.partitionBy("__g", "__block").orderBy(F.col("__s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = least.withColumn("__near", F.min("__least").over(above)).select("__g", "__s", "__block", "__near")
    # Only groups that reach beyond one block need the second level; usually there are none.
    tall = rows.filter(block != 0).select(F.col(group).alias("__g")).distinct()
    higher = Window.partitionBy("__g").orderBy(F.col("__block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.select(F.col(group).alias("__g"), block.alias("__block"), F.col(arrival).alias("__a")).join(tall, "__g", "left_semi").groupBy("__g", "__block").agg(F.min("__a").alias("__least"))
    far = blocks.select("__g", "__block", F.min("__least").over(higher).alias("__far"))
    ahead = near.join(far, ["__g", "__block"], "left").select("__g", "__s", F.least("__near", "__far").alias("__ahead")).filter("__ahead is not null")
    found = rows.join(ahead, (rows[group] == ahead["__g"]) & (rows[sequence] == ahead["__s"]), "left")
    return found.select(*[rows[c] for c in events.columns], F.coalesce(F.col("__ahead") < rows[arrival], F.lit(False)).alias("overtaken")).unionByName(rest)
