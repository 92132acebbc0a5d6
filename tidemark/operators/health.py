"""Views over the platform's own tables: runs, statements, warehouses, cost, audit.

A definition counts as it stands last, and not at all once deleted; one without any run or
event keeps its row.  ``as_of`` is given, so that a view is the same whenever it is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cdc, ops
from tidemark.operators.joins import in_force

# The states in which a run has failed, and the patterns of audited actions.
BROKEN = ("FAILED", "CANCELED", "CANCELLED", "TIMED_OUT", "ERROR", "BLOCKED")
GUARDED, CHANGING = "(grant|revoke|permission|privilege|policy|tag|mask|rowfilter)", "(create|update|delete|edit)"


def current(definitions: DataFrame, keys: list[str]) -> DataFrame:
    return cdc.latest_definition(definitions, keys, "change_time", "delete_time")


def seconds_between(start: str, end: str) -> Column:
    return F.unix_seconds(F.col(end).cast("timestamp")) - F.unix_seconds(F.col(start).cast("timestamp"))


def hours_since(at: str, as_of: str) -> Column:
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col(at).cast("timestamp"))
    return F.floor(age / 3600)


def outcome(state: str, ran: Column) -> Column:
    """What a final state means; null while a run goes on, NEVER_RUN where there is none."""
    s = F.col(state)
    return ops.ladder([(~ran, "NEVER_RUN"), (s.isNull(), "IN_PROGRESS"), (s.isin("SUCCEEDED", "COMPLETED"), "HEALTHY"), (s.isin(*BROKEN), "FAILED"), (s == "SKIPPED", "SKIPPED")], "UNKNOWN")


def runs(timeline: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """One row per run: ``started``, ``ended``, ``duration_seconds``, and the final slice's ``result_state`` and ``carry``."""
    last = F.max_by(F.struct("result_state", *carry), F.struct("period_end_time", "period_start_time")).alias("z")
    made = timeline.withColumn("__s", seconds_between("period_start_time", "period_end_time")).groupBy(*keys).agg(F.min("period_start_time").alias("started"), F.max("period_end_time").alias("ended"), F.sum("__s").alias("duration_seconds"), F.count(F.lit(1)).alias("slices"), last)
    return made.select(*keys, "started", "ended", "duration_seconds", "slices", "z.*")


def operational(definitions: DataFrame, run: DataFrame, keys: list[str], run_id: str, as_of: str) -> DataFrame:
    """Every current definition with its latest run, its status, and how long ago that was."""
    last = ops.latest_run(run, keys, ["ended", "started", run_id])
    out = definitions.join(last, keys, "left").withColumn("operational_status", outcome("result_state", F.col(run_id).isNotNull()))
    return out.withColumn("hours_since_last_run", hours_since("ended", as_of))


def since(rows: DataFrame, at: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``; the bound is a literal and reaches the scan."""
    end = F.lit(as_of).cast(dict(rows.dtypes)[at])
    return rows.filter((F.col(at) >= end - F.expr(f"INTERVAL {days} DAY")) & (F.col(at) <= end))


def daily(run: DataFrame, at: str, name: str) -> DataFrame:
    """Per day the runs, those that succeeded and those that failed, and how long they took."""
    d = "duration_seconds"
    per = run.groupBy(F.to_date(at).alias("run_date"), d).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("result_state").isin("SUCCEEDED", "COMPLETED")).alias("ok"), F.count_if(F.col("result_state").isin(*BROKEN)).alias("bad"))
    return per.groupBy("run_date").agg(F.sum("c").alias(f"{name}_runs"), F.sum("ok").alias(f"successful_{name}_runs"), F.sum("bad").alias(f"failed_{name}_runs"), (F.sum(F.col(d) * F.col("c")) / F.sum("c")).alias(f"avg_{name}_seconds"), F.percentile(d, F.lit(0.95), F.col("c")).alias(f"p95_{name}_seconds"))


def statements(history: DataFrame, jobs: DataFrame, pattern: str) -> DataFrame:
    """Statements that belong to a current job, or whose text names the project, with their waits and what is wrong."""
    named = jobs.groupBy(F.col("job_id").alias("source_job_id")).agg(F.min("name").alias("job_name"))
    rows = history.join(named, "source_job_id", "left")
    by = ops.ladder([(F.col("job_name").isNotNull(), "JOB"), (F.lower(F.coalesce("statement_text", F.lit(""))).rlike(pattern), "SQL_TEXT")], "UNATTRIBUTED")
    none = F.lit(0).cast("long")
    rows = rows.withColumns({
        "attribution_method": by, "queue_ms": F.coalesce("waiting_for_compute_ms", none) + F.coalesce("waiting_at_capacity_ms", none), "pruned": F.coalesce("pruned_files", none), "read": F.coalesce("read_files", none),
        "execution_status": F.when(F.col("execution_status") == "CANCELED", "FAILED").otherwise(F.col("execution_status")),
    })
    return rows.filter("attribution_method != 'UNATTRIBUTED'").withColumns({"file_pruning_rate": ops.pruning_rate("read", "pruned"), "performance_status": ops.performance(rows)}).drop("pruned", "read")


def statements_daily(rows: DataFrame) -> DataFrame:
    gib = float(1 << 30)
    status = lambda s: F.count_if(F.col("performance_status") == s)
    size = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))) / gib
    return rows.groupBy(F.to_date("start_time").alias("query_date")).agg(
        F.count(F.lit(1)).alias("query_count"), status("FAILED").alias("failed_query_count"), status("LONG_RUNNING").alias("long_running_query_count"), status("SPILLING").alias("spilling_query_count"), status("QUEUE_DELAY").alias("queue_delayed_query_count"),
        (F.avg("total_ms") / 1000).alias("avg_seconds"), (F.percentile("total_ms", 0.95) / 1000).alias("p95_seconds"), size("read_bytes").alias("read_gb"), size("spilled_bytes").alias("spilled_gb"), F.avg("file_pruning_rate").alias("avg_pruning_rate"), F.avg(F.col("from_result_cache").cast("double")).alias("cache_hit_rate"),
    )


def warehouses(definitions: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """Every current warehouse with its latest event; one without any says so."""
    last = ops.latest_run(events, ["warehouse_id"], ["event_time", "event_id"]).select("warehouse_id", "event_type", "cluster_count", "event_time")
    kind = F.col("event_type")
    status = ops.ladder([(kind.isNull(), "NO_EVENT_HISTORY"), (kind.isin("RUNNING", "STARTING", "SCALED_UP"), "ACTIVE"), (kind.isin("STOPPING", "STOPPED", "SCALED_DOWN"), "INACTIVE_OR_SCALING_DOWN")], "UNKNOWN")
    return current(definitions, ["workspace_id", "warehouse_id"]).join(last, "warehouse_id", "left").withColumns({"warehouse_status": status, "hours_since_last_event": hours_since("event_time", as_of)})


def usage_cost(usage: DataFrame, prices: DataFrame, jobs: DataFrame, pipelines: DataFrame, houses: DataFrame) -> DataFrame:
    """Each usage record at the list price in force, and the workload it belongs to.

    Job and pipeline ids are numbers in usage and text in definitions: they meet as text.
    """
    priced = in_force(usage, prices.withColumnsRenamed({"sku_name": "p_sku", "account_id": "p_account", "usage_unit": "p_unit"}), {"account_id": "p_account", "sku_name": "p_sku", "usage_unit": "p_unit"}, "usage_start_time", "price_start_time", "price_end_time", ["record_id"], F.col("price_start_time"), ["currency_code", "unit_price"])
    cost = F.col("usage_quantity").cast("double") * F.coalesce(F.col("unit_price").cast("double"), F.lit(0.0))
    rows = priced.withColumns({"job_key": F.col("job_id").cast("string"), "pipeline_key": F.col("pipeline_id").cast("string"), "estimated_list_cost": cost})
    named = lambda df, key, out: df.select(F.col("workspace_id"), F.col(key).alias(out), F.col("name" if "name" in df.columns else "warehouse_name").alias(f"{out}_name"))
    rows = rows.join(named(jobs, "job_id", "job_key"), ["workspace_id", "job_key"], "left").join(named(pipelines, "pipeline_id", "pipeline_key"), ["workspace_id", "pipeline_key"], "left").join(named(houses, "warehouse_id", "warehouse_id"), ["workspace_id", "warehouse_id"], "left")
    kinds = [("JOB", "job_key", "job:"), ("PIPELINE", "pipeline_key", "pipeline:"), ("SQL_WAREHOUSE", "warehouse_id", "warehouse:")]
    kind = ops.ladder([(F.col(key).isNotNull(), name) for name, key, _ in kinds], "OTHER")
    called = F.col("sku_name")
    for _, key, mark in reversed(kinds):
        called = F.when(F.col(key).isNotNull(), F.coalesce(f"{key}_name", F.concat(F.lit(mark), F.col(key)))).otherwise(called)
    quality = ops.ladder([(F.col("job_key_name").isNotNull() | F.col("pipeline_key_name").isNotNull(), "DIRECT_RESOURCE"), (F.col("workspace_id").isNotNull(), "WORKSPACE")], "UNATTRIBUTED")
    return rows.withColumns({"workload_type": kind, "workload_name": called, "attribution_quality": quality})


def costs(detail: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Originals, retractions and restatements summed; groups that cancel out are left out."""
    made = detail.groupBy(*by).agg(F.sum("usage_quantity").cast("double").alias("usage_quantity"), F.sum("estimated_list_cost").alias("estimated_list_cost"), *more)
    return made.filter((F.abs("usage_quantity") > 0) | (F.abs("estimated_list_cost") > 0))


def cost_candidates(detail: DataFrame, run: DataFrame, houses: DataFrame, top: int = 5, idle_minutes: int = 30) -> DataFrame:
    """Where to look first: cost of failed runs, the dearest workloads, warehouses that stop late."""
    failed = run.filter(F.col("result_state").isin(*BROKEN)).select("workspace_id", F.col("job_id").alias("job_key"), F.col("run_id").alias("run_key"))
    lost = detail.withColumn("run_key", F.col("job_run_id").cast("string")).join(failed, ["workspace_id", "job_key", "run_key"]).groupBy("workload_name", "run_key", "currency_code").agg(F.sum("estimated_list_cost").alias("cost")).filter("cost > 0")
    one = lost.select(F.lit("FAILED_JOB_COST").alias("candidate_type"), F.concat("workload_name", F.lit(" / run "), "run_key").alias("resource_name"), "currency_code", "cost")
    dear = ops.top_per_group(costs(detail, ["workload_type", "workload_name", "currency_code"]).filter("estimated_list_cost > 0"), ["currency_code"], [F.round("estimated_list_cost", 4).desc(), F.col("workload_type"), F.col("workload_name")], top)
    two = dear.select(F.lit("TOP_COST_WORKLOAD"), F.concat("workload_type", F.lit(": "), "workload_name"), "currency_code", "estimated_list_cost")
    three = houses.filter(F.col("auto_stop_minutes") > idle_minutes).select(F.lit("WAREHOUSE_AUTOSTOP_REVIEW"), "warehouse_name", F.lit(None).cast("string"), F.lit(None).cast("double"))
    return one.union(two).union(three)


def security(audit: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Audit rows of the workspaces in scope or of the account ('0'), with severity and category."""
    rows = ops.in_scope(audit, workspaces, "workspace_id", "0")
    action, code = F.lower(F.coalesce("action_name", F.lit(""))), F.col("response_status_code")
    severity = ops.ladder([(code >= 500, "CRITICAL"), (code >= 400, "HIGH"), (action.rlike(GUARDED) | action.rlike(CHANGING), "MEDIUM")], "INFO")
    category = ops.ladder([(code >= 400, "OPERATION_FAILURE"), ((F.lower("service_name") == "catalog") & action.rlike(GUARDED), "GOVERNANCE_CHANGE"), (action.rlike(CHANGING), "RESOURCE_CHANGE")], "ACTIVITY")
    return rows.withColumns({"event_severity": severity, "event_category": category, "actor": F.coalesce("initiating_identity", "run_as_identity", F.lit("unknown"))})
