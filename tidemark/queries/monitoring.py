"""Queries over the platform's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import governance, health, joins, ops
from tidemark.sources.system import system_table

AS_OF, PROJECT = "2001-08-01 00:00:00", "payments"
STAMP, DATE = "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    return health.current(system_table(spark, sf, "jobs"), ["workspace_id", "job_id"])


def _pipelines(spark: SparkSession, sf: str) -> DataFrame:
    return health.current(system_table(spark, sf, "pipelines"), ["workspace_id", "pipeline_id"])


def _job_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of current jobs."""
    keys = ["workspace_id", "job_id"]
    return health.runs(system_table(spark, sf, "job_run_timeline").join(_jobs(spark, sf).select(*keys), keys, "left_semi"), [*keys, "run_id"], ["trigger_type", "termination_code"])


def _task_runs(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["workspace_id", "job_id"]
    return health.runs(system_table(spark, sf, "job_task_run_timeline").join(_jobs(spark, sf).select(*keys), keys, "left_semi"), [*keys, "run_id", "task_key"], [])


def _houses(spark: SparkSession, sf: str) -> DataFrame:
    return health.warehouses(system_table(spark, sf, "warehouses"), system_table(spark, sf, "warehouse_events"), AS_OF)


def _pipeline_health(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["workspace_id", "pipeline_id"]
    run = health.runs(system_table(spark, sf, "pipeline_update_timeline"), [*keys, "update_id"], ["update_type"])
    return health.operational(_pipelines(spark, sf), run, keys, "update_id", AS_OF)


def _statements(spark: SparkSession, sf: str) -> DataFrame:
    return health.statements(system_table(spark, sf, "query_history"), _jobs(spark, sf), PROJECT)


def _detail(spark: SparkSession, sf: str) -> DataFrame:
    return health.usage_cost(system_table(spark, sf, "billing_usage"), system_table(spark, sf, "list_prices"), _jobs(spark, sf), _pipelines(spark, sf), _houses(spark, sf))


def job_operational_health(spark: SparkSession, sf: str) -> DataFrame:
    out = health.operational(_jobs(spark, sf), _job_runs(spark, sf), ["workspace_id", "job_id"], "run_id", AS_OF)
    return out.select("workspace_id", "job_id", F.col("name").alias("job_name"), "paused", "timeout_seconds", "run_id", "trigger_type", F.date_format("started", STAMP).alias("run_start"), F.date_format("ended", STAMP).alias("run_end"), "duration_seconds", "slices", "result_state", "termination_code", "operational_status", "hours_since_last_run")


def task_run_health(spark: SparkSession, sf: str) -> DataFrame:
    rows = _task_runs(spark, sf).withColumn("status", health.outcome("result_state", F.lit(True)))
    return rows.select("workspace_id", "job_id", "run_id", "task_key", F.date_format("started", STAMP).alias("task_start"), "duration_seconds", "result_state", "status")


def job_daily_health(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs and tasks of the last thirty days, either of which may be without the other."""
    a = health.daily(health.since(_job_runs(spark, sf), "started", AS_OF, 30), "started", "job")
    b = health.daily(health.since(_task_runs(spark, sf), "started", AS_OF, 30), "started", "task")
    both = joins.merged_days(a, b, ["run_date"])
    counts = [c for c in both.columns if c.endswith("_runs")]
    return both.fillna(0, counts).select(F.date_format("run_date", DATE).alias("run_date"), *counts, *[F.round(c, 6).alias(c) for c in ("avg_job_seconds", "p95_job_seconds", "avg_task_seconds", "p95_task_seconds")])


def pipeline_operational_health(spark: SparkSession, sf: str) -> DataFrame:
    return _pipeline_health(spark, sf).select("workspace_id", "pipeline_id", F.col("name").alias("pipeline_name"), "update_id", "update_type", F.date_format("ended", STAMP).alias("update_end"), "duration_seconds", "result_state", "operational_status", "hours_since_last_run")


def query_performance(spark: SparkSession, sf: str) -> DataFrame:
    return _statements(spark, sf).select("statement_id", "source_job_id", "job_name", "attribution_method", "queue_ms", "total_ms", "read_bytes", F.round("file_pruning_rate", 9).alias("file_pruning_rate"), "performance_status")


def query_performance_daily(spark: SparkSession, sf: str) -> DataFrame:
    out = health.statements_daily(_statements(spark, sf))
    return out.select(F.date_format("query_date", DATE).alias("query_date"), *[c for c in out.columns if c.endswith("_count")], *[F.round(c, 6).alias(c) for c in ("avg_seconds", "p95_seconds", "read_gb", "spilled_gb", "avg_pruning_rate", "cache_hit_rate")])


def warehouse_health(spark: SparkSession, sf: str) -> DataFrame:
    return _houses(spark, sf).select("workspace_id", "warehouse_id", "warehouse_name", "auto_stop_minutes", "event_type", "cluster_count", F.date_format("event_time", STAMP).alias("latest_event_time"), "warehouse_status", "hours_since_last_event")


def usage_cost_detail(spark: SparkSession, sf: str) -> DataFrame:
    return _detail(spark, sf).select("record_id", "sku_name", "record_type", F.col("usage_quantity").cast("double").alias("usage_quantity"), "currency_code", F.col("unit_price").cast("double").alias("unit_price"), F.round("estimated_list_cost", 4).alias("estimated_list_cost"), "workload_type", "workload_name", "attribution_quality")


def cost_daily(spark: SparkSession, sf: str) -> DataFrame:
    out = health.costs(_detail(spark, sf), ["usage_date", "currency_code"], F.count(F.lit(1)).alias("records"), F.count_distinct("sku_name").alias("skus"), F.count_distinct("workload_name").alias("workloads"))
    return out.withColumns({"usage_date": F.date_format("usage_date", DATE), "estimated_list_cost": F.round("estimated_list_cost", 4)})


def cost_by_workload(spark: SparkSession, sf: str) -> DataFrame:
    rows = health.costs(_detail(spark, sf), ["workload_type", "workload_name", "attribution_quality", "currency_code"], F.min("usage_date").alias("first_usage"), F.max("usage_date").alias("latest_usage"))
    return rows.withColumns({"first_usage": F.date_format("first_usage", DATE), "latest_usage": F.date_format("latest_usage", DATE), "estimated_list_cost": F.round("estimated_list_cost", 4)})


def cost_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return health.cost_candidates(_detail(spark, sf), _job_runs(spark, sf), _houses(spark, sf)).withColumn("cost", F.round("cost", 4))


def security_daily(spark: SparkSession, sf: str) -> DataFrame:
    scope = _pipelines(spark, sf).select("workspace_id").union(_jobs(spark, sf).select("workspace_id")).distinct()
    rows = health.security(system_table(spark, sf, "audit"), scope)
    return rows.groupBy(F.date_format("event_date", DATE).alias("event_date"), "event_severity", "event_category").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("actor").alias("actors"))


def platform_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One row of figures, each by itself."""
    status = lambda s: F.count_if(F.col("operational_status") == s)
    pipes = _pipeline_health(spark, sf).agg(F.count(F.lit(1)).alias("pipelines"), status("HEALTHY").alias("healthy_pipelines"), status("FAILED").alias("failed_pipelines"), status("NEVER_RUN").alias("never_run_pipelines"))
    run = _job_runs(spark, sf)
    jobs = health.operational(_jobs(spark, sf), run, ["workspace_id", "job_id"], "run_id", AS_OF).agg(F.count(F.lit(1)).alias("jobs"), status("NEVER_RUN").alias("never_run_jobs"))
    bad = F.col("result_state").isin(*health.BROKEN)
    late = health.since(run, "started", AS_OF, 1).agg(F.count_if(bad).alias("failed_jobs_24h"))
    tasks = health.since(_task_runs(spark, sf), "started", AS_OF, 1).agg(F.count_if(bad).alias("failed_tasks_24h"))
    asked = health.since(_statements(spark, sf), "start_time", AS_OF, 1).agg(F.count_if(F.col("performance_status") == "FAILED").alias("failed_queries_24h"))
    cost = health.costs(_detail(spark, sf), ["usage_date"])
    end = F.lit(AS_OF).cast("date")
    money = cost.agg(F.round(F.sum(F.when(F.col("usage_date") == end, F.col("estimated_list_cost"))), 4).alias("cost_today"), F.round(F.sum(F.when(F.col("usage_date").between(F.date_sub(end, 6), end), F.col("estimated_list_cost"))), 4).alias("cost_7d"))
    return pipes.join(jobs).join(late).join(tasks).join(asked).join(money)  # one row each


def platform_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """What should be looked at; a paused rule is never triggered."""
    one = platform_summary(spark, sf)
    daily = health.costs(_detail(spark, sf), ["usage_date"])
    end = F.lit(AS_OF).cast("date")
    spike = ops.cost_spike(daily.filter(F.col("usage_date").between(F.date_sub(end, 7), end)), "usage_date", "estimated_list_cost").filter(F.col("usage_date") == end).agg(F.count_if("is_spike").alias("spikes"))
    rules = {"PIPELINE_FAILURE": F.col("failed_pipelines"), "JOB_FAILURE": F.col("failed_jobs_24h"), "QUERY_FAILURE": F.col("failed_queries_24h"), "NEVER_RUN": F.col("never_run_jobs"), "COST_SPIKE": F.col("spikes")}
    return ops.alerts(one.join(spike), rules).withColumn("state", F.when(F.col("alert") == "NEVER_RUN", "PAUSED").otherwise(F.col("state")))


def platform_validation(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot of a validation: how many rows of each kind there must be some of, and whether there are."""
    job = system_table(spark, sf, "jobs")
    run = _job_runs(spark, sf)
    kinds = {
        "deleted definitions": job.filter("delete_time is not null"), "runs in progress": run.filter("slices = 3 and result_state is null"), "failed after success": run.filter(F.col("result_state").isin(*health.BROKEN) & (F.col("slices") > 1)),
        "jobs never run": job_operational_health(spark, sf).filter("operational_status = 'NEVER_RUN'"), "retractions": system_table(spark, sf, "billing_usage").filter("record_type = 'RETRACTION' and usage_quantity < 0"), "warehouses without events": warehouse_health(spark, sf).filter("warehouse_status = 'NO_EVENT_HISTORY'"),
    }
    out = None
    for name, rows in kinds.items():
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("check_name"), "rows")
        out = one if out is None else out.unionAll(one)
    return out.withColumn("status", F.when(F.col("rows") > 0, "PASS").otherwise("FAIL"))


#: The grants that are meant to be: who may do what where.
EXPECTED_GRANTS = [(f"group-{g}", "SELECT", f"schema-{s}") for g in range(4) for s in range(3)] + [("group-0", "MODIFY", "schema-0"), ("group-9", "SELECT", "schema-0")]


def grants_check(spark: SparkSession, sf: str) -> DataFrame:
    expected = spark.createDataFrame(EXPECTED_GRANTS, "principal string, privilege string, securable string")
    return governance.grants_check(system_table(spark, sf, "table_privileges"), expected)


def queries() -> dict:
    named = (job_operational_health, task_run_health, job_daily_health, pipeline_operational_health, query_performance, query_performance_daily, warehouse_health, usage_cost_detail, cost_daily, cost_by_workload, cost_candidates, security_daily, platform_summary, platform_alerts, platform_validation, grants_check)
    return {f.__name__: f for f in named}
