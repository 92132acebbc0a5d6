"""Totals and averages over trailing whole days, with days without activity (problem 5).

Method: range-based window frames over integer day numbers on sparse daily totals.
Calendar rows of zero weight are added for the days asked for; the frame ``-n .. -1``
over the day number then covers exactly the n whole days before, whether or not they
had activity, so daily means divide by the fixed n.

Scale: repeated rows and then days are aggregated, combined map-side, before any
window.  A window partition holds one row per active day and one per calendar day of
an entity, whatever the number of payments: a hot merchant is no larger than others.

Defined results: a null amount adds 0 but counts; rows without key, entity or time take
no part; a repeated key counts once, by the copy with the least values; no activity
gives 0 and never null; negative amounts are summed as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_totals(payments: DataFrame, once: str, entities: dict[str, str], at_us: str, amount: str) -> DataFrame:
    """``kind, entity_id, day_no, n, total``: each key ``once`` counted once for every kind of entity.

    ``entities`` maps a kind to the column that holds its id.
    """
    body = F.struct(F.col(at_us).alias("at"), *[F.col(c).alias(k) for k, c in entities.items()], F.col(amount).cast("decimal(28,2)").alias("amount"))
    single = payments.filter(F.col(once).isNotNull()).groupBy(once).agg(F.min(body).alias("b"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"b.{k}").alias("entity_id")) for k in entities]))
    long = single.filter("b.at is not null").select(kinds.alias("e"), F.expr("cast(floor(b.at / 86400000000) as int)").alias("day_no"), F.coalesce("b.amount", F.lit(0)).alias("amount"))
    return (
        long.select("e.kind", "e.entity_id", "day_no", "amount").filter("entity_id is not null")
        .groupBy("kind", "entity_id", "day_no").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(38,2)").alias("total"))
    )


def trailing(daily: DataFrame, panel: DataFrame, first_day: int, last_day: int, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """One row per ``kind, entity_id`` of ``panel`` and day, with count, sum and averages per window.

    ``avg_amount`` divides by the payments, ``daily_amount`` by the fixed number of days.
    """
    days = F.explode(F.sequence(F.lit(first_day), F.lit(last_day)))
    money = F.lit(0).cast("decimal(38,2)")
    who = panel.select("kind", "entity_id").filter("entity_id is not null").distinct()
    calendar = who.select("kind", "entity_id", days.alias("day_no"), F.lit(0).cast("long").alias("n"), money.alias("total"), F.lit(True).alias("wanted"))
    reach = max(windows)
    near = daily.filter(F.col("day_no").between(first_day - reach, last_day)).join(who, ["kind", "entity_id"], "left_semi")
    rows = near.withColumn("wanted", F.lit(False)).unionByName(calendar)
    w = Window.partitionBy("kind", "entity_id").orderBy("day_no")
    made: dict[str, Column] = {}
    for n in windows:
        frame = w.rangeBetween(-n, -1)
        made[f"txn_count_{n}d"] = F.coalesce(F.sum("n").over(frame), F.lit(0))
        made[f"amount_sum_{n}d"] = F.coalesce(F.sum("total").over(frame), money).cast("double")
    out = rows.withColumns(made).filter("wanted")
    ratios = {f"avg_amount_{n}d": F.when(F.col(f"txn_count_{n}d") > 0, F.col(f"amount_sum_{n}d") / F.col(f"txn_count_{n}d")).otherwise(F.lit(0.0)) for n in windows}
    ratios |= {f"daily_amount_{n}d": F.col(f"amount_sum_{n}d") / F.lit(float(n)) for n in windows}
    return out.withColumns(ratios).drop("n", "total", "wanted")


def deviating(expected: DataFrame, published: DataFrame, counts: Sequence[str], amounts: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """Keys of ``expected`` whose published row is missing, null or off; of several published rows any may be the wrong one."""
    keys = ["kind", "entity_id", "day_no"]
    told = published.select(*keys, *[F.col(c).alias(f"p_{c}") for c in (*counts, *amounts)], F.lit(True).alias("there"))
    both = expected.join(told, keys, "left")
    wrong = F.col("there").isNull()
    for c in counts:
        wrong = wrong | F.coalesce(F.col(f"p_{c}") != F.col(c), F.lit(True))
    for c in amounts:
        # 1e-9 keeps a difference of exactly the tolerance right in floating point
        wrong = wrong | F.coalesce(F.abs(F.col(f"p_{c}") - F.col(c)) > tolerance + 1e-9, F.lit(True))
    return both.filter(wrong).select(*keys).distinct()
