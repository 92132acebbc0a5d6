"""Platform monitoring: run slices, definitions, freshness, cost in force, alerts.

Every status ladder is data: an ordered list of (condition, label).  ``as_of`` is always
given, so a view is reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import in_force


def ladder(steps: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first condition that holds; null conditions do not hold."""
    out = None
    for hit, name in steps:
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def collapse_slices(slices: DataFrame, keys: Sequence[str], start: str, end: str, state: str) -> DataFrame:
    """One row per run: first start, last end, seconds, and the state of the final slice.

    The final slice's state may be null: the run is in progress.
    """
    seconds = F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
    return slices.groupBy(*keys).agg(
        F.min(start).alias("run_start"), F.max(end).alias("run_end"), F.sum(seconds).alias("active_us"), F.max_by(state, F.struct(end, start)).alias("final_state"), F.count(F.lit(1)).alias("slices")
    )


def run_status(final_state: str = "final_state") -> Column:
    s = F.col(final_state)
    return ladder([(s.isNull(), "IN_PROGRESS"), (s.isin("SETTLED", "SUCCEEDED", "COMPLETED", "AUTHORIZED"), "HEALTHY"), (s.isin("DECLINED", "FAILED", "ERROR", "TIMED_OUT"), "FAILED"), (s.isin("SKIPPED", "CANCELED", "REVERSED", "REFUNDED"), "SKIPPED")], "UNKNOWN")


def latest_run(runs: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return runs.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def definition_health(definitions: DataFrame, latest: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """Every definition with its latest run; one that never ran says so."""
    return definitions.join(latest, list(keys), "left").withColumn("health", F.coalesce(F.col(status), F.lit("NEVER_RUN")))


def daily_reliability(runs: DataFrame, day: str, seconds: str, failed: Column) -> DataFrame:
    """Runs, failures and exact 95th percentile duration per day.

    The percentile is taken of (value, count) pairs: equal durations are combined first.
    """
    per = runs.groupBy(day, seconds).agg(F.count(F.lit(1)).alias("c"), F.count_if(failed).alias("f"))
    return per.groupBy(day).agg(F.sum("c").alias("runs"), F.sum("f").alias("failed_runs"), F.percentile(F.col(seconds), F.lit(0.95), F.col("c")).alias("p95_seconds"))


def performance(df: DataFrame) -> Column:
    """What is wrong with a statement, worst first."""
    ms, gib = F.col("total_ms"), 1 << 30
    return ladder([(F.col("execution_status") == "FAILED", "FAILED"), (F.col("spilled_bytes") > 0, "SPILLING"), (F.col("queue_ms") >= 30_000, "QUEUE_DELAY"), (ms >= 60_000, "LONG_RUNNING"), (F.col("read_bytes") >= gib, "HIGH_SCAN")], "HEALTHY")


def pruning_rate(read_files: str, pruned_files: str) -> Column:
    whole = F.col(read_files) + F.col(pruned_files)
    return F.when(whole > 0, F.col(pruned_files) / whole)


def freshness(tables: DataFrame, last: str, as_of: str) -> DataFrame:
    """RECENT within a day, AGING within a week, STALE beyond, NO_DATA without any row."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col(last).cast("timestamp"))
    state = ladder([(age.isNull(), "NO_DATA"), (age <= 24 * 3600, "RECENT"), (age <= 7 * 86_400, "AGING")], "STALE")
    return tables.withColumns({"age_seconds": age, "freshness": state})


def priced_usage(usage: DataFrame, prices: DataFrame, equal: dict[str, str], at: str, start: str, end: str, row_id: Sequence[str], quantity: str, price: str) -> DataFrame:
    """Usage at the list price in force; overlapping prices fall to the latest start; unpriced usage costs null."""
    found = in_force(usage, prices, equal, at, start, end, row_id, F.col(start), [price])
    return found.withColumn("list_cost", F.col(quantity) * F.col(price))


def signed_cost(priced: DataFrame, by: Sequence[str]) -> DataFrame:
    """Originals, retractions and restatements are all summed; groups that cancel out entirely are left out."""
    return priced.groupBy(*by).agg(F.sum("quantity").alias("quantity"), F.sum("list_cost").alias("list_cost")).filter((F.abs("quantity") > 0) | (F.abs("list_cost") > 0))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def alerts(summary: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule: how many it counts, and TRIGGERED where more than none."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("alert"), F.coalesce(c, F.lit(0)).cast("long").alias("alert_count")) for n, c in rules.items()])).alias("a")
    return summary.select(rows).select("a.*").withColumn("state", F.when(F.col("alert_count") > 0, "TRIGGERED").otherwise("OK"))


def cost_spike(daily: DataFrame, day: str, cost: str, factor: float = 2.0, least: float = 1.0) -> DataFrame:
    """Days whose cost exceeds ``least`` and ``factor`` times the mean of the seven calendar days before."""
    num = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    before = F.avg(cost).over(Window.partitionBy(F.lit(0)).orderBy(num).rangeBetween(-7, -1))
    return daily.withColumn("prior_mean", before).withColumn("is_spike", F.coalesce((F.col(cost) > least) & (F.col(cost) > factor * F.col("prior_mean")), F.lit(False)))


def in_scope(rows: DataFrame, scope: DataFrame, key: str, account_level: str | None = None) -> DataFrame:
    """Rows whose key is in the scope set, or that belong to the account as a whole."""
    marked = rows.join(scope.select(F.col(key).alias("__scope")).distinct(), F.col(key) == F.col("__scope"), "left")
    ok = F.col("__scope").isNotNull()
    if account_level is not None:
        ok = ok | (F.col(key).cast("string") == account_level)
    return marked.filter(ok).drop("__scope")
