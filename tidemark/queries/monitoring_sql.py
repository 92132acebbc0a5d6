"""SQL for the monitoring queries, as DuckDB runs it over the same tables."""

from __future__ import annotations

from tidemark.queries.monitoring import EXPECTED_GRANTS
from tidemark.sources.system import TABLES

_END = "TIMESTAMP '2001-08-01 00:00:00'"
_BROKEN = "('FAILED', 'CANCELED', 'CANCELLED', 'TIMED_OUT', 'ERROR', 'BLOCKED')"


def _t(*names: str) -> str:
    return ", ".join(f"{n} AS ({TABLES[n]})" for n in names)


def _stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _hours(c: str) -> str:
    return f"CAST(floor((epoch({_END}) - epoch({c})) / 3600) AS BIGINT)"


def _status(s: str, ran: str) -> str:
    return f"CASE WHEN {ran} IS NULL THEN 'NEVER_RUN' WHEN {s} IS NULL THEN 'IN_PROGRESS' WHEN {s} IN ('SUCCEEDED', 'COMPLETED') THEN 'HEALTHY' WHEN {s} IN {_BROKEN} THEN 'FAILED' WHEN {s} = 'SKIPPED' THEN 'SKIPPED' ELSE 'UNKNOWN' END"


def _runs(timeline: str, keys: str, carry: str, scope: str) -> str:
    """Runs from slices: sums and bounds by group, the final state from the slice that ends last."""
    return f"""(SELECT g.*, z.result_state {carry} FROM (SELECT {keys}, min(period_start_time) AS started, max(period_end_time) AS ended, CAST(sum(epoch(period_end_time) - epoch(period_start_time)) AS BIGINT) AS duration_seconds, count(*) AS slices FROM {timeline} t WHERE {scope} GROUP BY {keys}) g
JOIN (SELECT * FROM {timeline} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY period_end_time DESC, period_start_time DESC) = 1) z USING ({keys}))"""


_JOBS = f"{_t('jobs')}, job AS (SELECT * FROM (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY workspace_id, job_id ORDER BY change_time DESC) = 1) WHERE delete_time IS NULL)"
_PIPES = f"{_t('pipelines')}, pipe AS (SELECT * FROM (SELECT * FROM pipelines QUALIFY row_number() OVER (PARTITION BY workspace_id, pipeline_id ORDER BY change_time DESC) = 1) WHERE delete_time IS NULL)"
_IN_JOBS = "(workspace_id, job_id) IN (SELECT (workspace_id, job_id) FROM job)"
_RUN = f"{_JOBS}, {_t('job_run_timeline')}, run AS {_runs('job_run_timeline', 'workspace_id, job_id, run_id', ', z.trigger_type, z.termination_code', _IN_JOBS)}"
_TASK = f"{_t('job_task_run_timeline')}, task AS {_runs('job_task_run_timeline', 'workspace_id, job_id, run_id, task_key', '', _IN_JOBS)}"
_JOB_HEALTH = f"jh AS (SELECT job.workspace_id, job.job_id, job.name AS job_name, paused, timeout_seconds, l.run_id, l.trigger_type, started, ended, l.duration_seconds, l.slices, l.result_state, l.termination_code, {_status('l.result_state', 'l.run_id')} AS operational_status FROM job LEFT JOIN (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY workspace_id, job_id ORDER BY ended DESC, started DESC, run_id DESC) = 1) l USING (workspace_id, job_id))"
_PIPE_HEALTH = f"""{_PIPES}, {_t('pipeline_update_timeline')}, upd AS {_runs('pipeline_update_timeline', 'workspace_id, pipeline_id, update_id', ', z.update_type', 'true')},
ph AS (SELECT pipe.workspace_id, pipe.pipeline_id, pipe.name AS pipeline_name, l.update_id, l.update_type, l.ended, l.duration_seconds, l.result_state, {_status('l.result_state', 'l.update_id')} AS operational_status FROM pipe LEFT JOIN (SELECT * FROM upd QUALIFY row_number() OVER (PARTITION BY workspace_id, pipeline_id ORDER BY ended DESC, started DESC, update_id DESC) = 1) l USING (workspace_id, pipeline_id))"""
_QUERY = f"""{_t('query_history')}, qs AS (SELECT * FROM (SELECT q.*, jn.job_name, CASE WHEN jn.job_name IS NOT NULL THEN 'JOB' WHEN lower(coalesce(statement_text, '')) LIKE '%payments%' THEN 'SQL_TEXT' ELSE 'UNATTRIBUTED' END AS attribution_method, coalesce(waiting_for_compute_ms, 0) + coalesce(waiting_at_capacity_ms, 0) AS queue_ms,
  CASE WHEN coalesce(pruned_files, 0) + coalesce(read_files, 0) > 0 THEN coalesce(pruned_files, 0)::DOUBLE / (coalesce(pruned_files, 0) + coalesce(read_files, 0)) END AS file_pruning_rate FROM query_history q LEFT JOIN (SELECT job_id, min(name) AS job_name FROM job GROUP BY 1) jn ON jn.job_id = q.source_job_id) WHERE attribution_method <> 'UNATTRIBUTED'),
qp AS (SELECT *, CASE WHEN execution_status IN ('FAILED', 'CANCELED') THEN 'FAILED' WHEN spilled_bytes > 0 THEN 'SPILLING' WHEN queue_ms >= 30000 THEN 'QUEUE_DELAY' WHEN total_ms >= 60000 THEN 'LONG_RUNNING' WHEN read_bytes >= 1073741824 THEN 'HIGH_SCAN' ELSE 'HEALTHY' END AS performance_status FROM qs)"""
_HOUSES = f"""{_t('warehouses', 'warehouse_events')}, wh AS (SELECT w.*, e.event_type, e.cluster_count, e.event_time, CASE WHEN e.event_type IS NULL THEN 'NO_EVENT_HISTORY' WHEN e.event_type IN ('RUNNING', 'STARTING', 'SCALED_UP') THEN 'ACTIVE' WHEN e.event_type IN ('STOPPING', 'STOPPED', 'SCALED_DOWN') THEN 'INACTIVE_OR_SCALING_DOWN' ELSE 'UNKNOWN' END AS warehouse_status
 FROM (SELECT * FROM (SELECT * FROM warehouses QUALIFY row_number() OVER (PARTITION BY workspace_id, warehouse_id ORDER BY change_time DESC) = 1) WHERE delete_time IS NULL) w LEFT JOIN (SELECT * FROM warehouse_events QUALIFY row_number() OVER (PARTITION BY warehouse_id ORDER BY event_time DESC, event_id DESC) = 1) e USING (warehouse_id))"""
_COST = f"""{_PIPES}, {_HOUSES}, {_t('billing_usage', 'list_prices')},
pu AS (SELECT u.*, p.currency_code, p.unit_price FROM billing_usage u LEFT JOIN list_prices p ON p.account_id = u.account_id AND p.sku_name = u.sku_name AND p.usage_unit = u.usage_unit AND p.price_start_time <= u.usage_start_time AND (p.price_end_time IS NULL OR u.usage_start_time < p.price_end_time) QUALIFY row_number() OVER (PARTITION BY u.record_id ORDER BY p.price_start_time DESC NULLS LAST) = 1),
dt AS (SELECT pu.*, usage_quantity::DOUBLE * coalesce(unit_price::DOUBLE, 0) AS cost, CASE WHEN pu.job_id IS NOT NULL THEN 'JOB' WHEN pu.pipeline_id IS NOT NULL THEN 'PIPELINE' WHEN pu.warehouse_id IS NOT NULL THEN 'SQL_WAREHOUSE' ELSE 'OTHER' END AS workload_type,
 CASE WHEN pu.job_id IS NOT NULL THEN coalesce(job.name, 'job:' || pu.job_id) WHEN pu.pipeline_id IS NOT NULL THEN coalesce(pipe.name, 'pipeline:' || pu.pipeline_id) WHEN pu.warehouse_id IS NOT NULL THEN coalesce(wh.warehouse_name, 'warehouse:' || pu.warehouse_id) ELSE pu.sku_name END AS workload_name,
 CASE WHEN job.job_id IS NOT NULL OR pipe.pipeline_id IS NOT NULL THEN 'DIRECT_RESOURCE' WHEN pu.workspace_id IS NOT NULL THEN 'WORKSPACE' ELSE 'UNATTRIBUTED' END AS attribution_quality
 FROM pu LEFT JOIN job ON job.workspace_id = pu.workspace_id AND job.job_id = CAST(pu.job_id AS VARCHAR) LEFT JOIN pipe ON pipe.workspace_id = pu.workspace_id AND pipe.pipeline_id = CAST(pu.pipeline_id AS VARCHAR) LEFT JOIN wh ON wh.workspace_id = pu.workspace_id AND wh.warehouse_id = pu.warehouse_id)"""
_LIVE = "HAVING abs(sum(usage_quantity)) > 0 OR abs(sum(cost)) > 0"
_SUM = "CAST(sum(usage_quantity) AS DOUBLE) AS usage_quantity, round(sum(cost), 4) AS estimated_list_cost"


def _daily(name: str) -> str:
    return f"SELECT CAST(started AS DATE) AS d, count(*) AS {name}_runs, count(*) FILTER (result_state IN ('SUCCEEDED', 'COMPLETED')) AS successful_{name}_runs, count(*) FILTER (result_state IN {_BROKEN}) AS failed_{name}_runs, round(avg(duration_seconds), 6) AS avg_{name}_seconds, round(quantile_cont(duration_seconds::DOUBLE, 0.95), 6) AS p95_{name}_seconds FROM {'run' if name == 'job' else 'task'} WHERE started >= {_END} - INTERVAL 30 DAY AND started <= {_END} GROUP BY 1"


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["job_operational_health"] = f"WITH {_RUN}, {_JOB_HEALTH} SELECT * EXCLUDE (started, ended), {_stamp('started')} AS run_start, {_stamp('ended')} AS run_end, {_hours('ended')} AS hours_since_last_run FROM jh"
    q["task_run_health"] = f"WITH {_JOBS}, {_TASK} SELECT workspace_id, job_id, run_id, task_key, {_stamp('started')} AS task_start, duration_seconds, result_state, {_status('result_state', 'run_id')} AS status FROM task"
    zero = ", ".join(f"coalesce({p}{n}_runs, 0) AS {p}{n}_runs" for n in ("job", "task") for p in ("", "successful_", "failed_"))
    q["job_daily_health"] = f"WITH {_RUN}, {_TASK}, a AS ({_daily('job')}), b AS ({_daily('task')}) SELECT strftime(coalesce(a.d, b.d), '%Y-%m-%d') AS run_date, {zero}, avg_job_seconds, p95_job_seconds, avg_task_seconds, p95_task_seconds FROM a FULL JOIN b ON a.d = b.d"
    q["pipeline_operational_health"] = f"WITH {_PIPE_HEALTH} SELECT * EXCLUDE (ended), {_stamp('ended')} AS update_end, {_hours('ended')} AS hours_since_last_run FROM ph"
    q["query_performance"] = f"WITH {_JOBS}, {_QUERY} SELECT statement_id, source_job_id, job_name, attribution_method, queue_ms, total_ms, read_bytes, round(file_pruning_rate, 9) AS file_pruning_rate, performance_status FROM qp"
    status = ", ".join(f"count(*) FILTER (performance_status = '{s}') AS {n}_query_count" for s, n in (("FAILED", "failed"), ("LONG_RUNNING", "long_running"), ("SPILLING", "spilling"), ("QUEUE_DELAY", "queue_delayed")))
    q["query_performance_daily"] = f"WITH {_JOBS}, {_QUERY} SELECT strftime(start_time, '%Y-%m-%d') AS query_date, count(*) AS query_count, {status}, round(avg(total_ms) / 1000, 6) AS avg_seconds, round(quantile_cont(total_ms::DOUBLE, 0.95) / 1000, 6) AS p95_seconds, round(sum(coalesce(read_bytes, 0)) / 1073741824.0::DOUBLE, 6) AS read_gb, round(sum(coalesce(spilled_bytes, 0)) / 1073741824.0::DOUBLE, 6) AS spilled_gb, round(avg(file_pruning_rate), 6) AS avg_pruning_rate, round(avg(from_result_cache::INT), 6) AS cache_hit_rate FROM qp GROUP BY 1"
    q["warehouse_health"] = f"WITH {_HOUSES} SELECT workspace_id, warehouse_id, warehouse_name, auto_stop_minutes, event_type, cluster_count, {_stamp('event_time')} AS latest_event_time, warehouse_status, {_hours('event_time')} AS hours_since_last_event FROM wh"
    q["usage_cost_detail"] = f"WITH {_JOBS}, {_COST} SELECT record_id, sku_name, record_type, usage_quantity::DOUBLE AS usage_quantity, currency_code, unit_price::DOUBLE AS unit_price, round(cost, 4) AS estimated_list_cost, workload_type, workload_name, attribution_quality FROM dt"
    q["cost_daily"] = f"WITH {_JOBS}, {_COST} SELECT strftime(usage_date, '%Y-%m-%d') AS usage_date, currency_code, {_SUM}, count(*) AS records, count(DISTINCT sku_name) AS skus, count(DISTINCT workload_name) AS workloads FROM dt GROUP BY dt.usage_date, currency_code {_LIVE}"
    by = "workload_type, workload_name, attribution_quality, currency_code"
    q["cost_by_workload"] = f"WITH {_JOBS}, {_COST} SELECT {by}, {_SUM}, strftime(min(usage_date), '%Y-%m-%d') AS first_usage, strftime(max(usage_date), '%Y-%m-%d') AS latest_usage FROM dt GROUP BY {by} {_LIVE}"
    q["cost_candidates"] = f"""WITH {_RUN}, {_COST}, dear AS (SELECT workload_type, workload_name, currency_code, sum(cost) AS c FROM dt GROUP BY workload_type, workload_name, currency_code HAVING sum(cost) > 0 QUALIFY row_number() OVER (PARTITION BY currency_code ORDER BY round(sum(cost), 4) DESC, workload_type, workload_name) <= 5)
SELECT 'FAILED_JOB_COST' AS candidate_type, workload_name || ' / run ' || run_id AS resource_name, currency_code, round(sum(cost), 4) AS cost FROM dt JOIN run ON run.workspace_id = dt.workspace_id AND run.job_id = CAST(dt.job_id AS VARCHAR) AND run.run_id = CAST(dt.job_run_id AS VARCHAR) WHERE run.result_state IN {_BROKEN} GROUP BY workload_name, run_id, currency_code HAVING sum(cost) > 0
UNION ALL SELECT 'TOP_COST_WORKLOAD', workload_type || ': ' || workload_name, currency_code, round(c, 4) FROM dear UNION ALL SELECT 'WAREHOUSE_AUTOSTOP_REVIEW', warehouse_name, NULL, NULL FROM wh WHERE auto_stop_minutes > 30"""
    change, guard = "(create|update|delete|edit)", "(grant|revoke|permission|privilege|policy|tag|mask|rowfilter)"
    q["security_daily"] = f"""WITH {_JOBS}, {_PIPES}, {_t('audit')}, s AS (SELECT *, lower(coalesce(action_name, '')) AS act, coalesce(initiating_identity, run_as_identity, 'unknown') AS actor FROM audit WHERE workspace_id = '0' OR workspace_id IN (SELECT workspace_id FROM job UNION SELECT workspace_id FROM pipe))
SELECT strftime(event_date, '%Y-%m-%d') AS event_date, CASE WHEN response_status_code >= 500 THEN 'CRITICAL' WHEN response_status_code >= 400 THEN 'HIGH' WHEN regexp_matches(act, '{guard}') OR regexp_matches(act, '{change}') THEN 'MEDIUM' ELSE 'INFO' END AS event_severity,
 CASE WHEN response_status_code >= 400 THEN 'OPERATION_FAILURE' WHEN service_name = 'catalog' AND regexp_matches(act, '{guard}') THEN 'GOVERNANCE_CHANGE' WHEN regexp_matches(act, '{change}') THEN 'RESOURCE_CHANGE' ELSE 'ACTIVITY' END AS event_category, count(*) AS entries, count(DISTINCT actor) AS actors FROM s GROUP BY ALL"""
    day = f">= {_END} - INTERVAL 1 DAY"
    live = "(SELECT usage_date, sum(cost) AS c FROM dt GROUP BY 1 HAVING abs(sum(usage_quantity)) > 0 OR abs(sum(cost)) > 0)"
    figures = f"""(SELECT count(*) FROM ph) AS pipelines, (SELECT count(*) FROM ph WHERE operational_status = 'HEALTHY') AS healthy_pipelines, (SELECT count(*) FROM ph WHERE operational_status = 'FAILED') AS failed_pipelines, (SELECT count(*) FROM ph WHERE operational_status = 'NEVER_RUN') AS never_run_pipelines,
 (SELECT count(*) FROM jh) AS jobs, (SELECT count(*) FROM jh WHERE operational_status = 'NEVER_RUN') AS never_run_jobs, (SELECT count(*) FROM run WHERE started {day} AND started <= {_END} AND result_state IN {_BROKEN}) AS failed_jobs_24h, (SELECT count(*) FROM task WHERE started {day} AND started <= {_END} AND result_state IN {_BROKEN}) AS failed_tasks_24h,
 (SELECT count(*) FROM qp WHERE start_time {day} AND start_time <= {_END} AND performance_status = 'FAILED') AS failed_queries_24h, (SELECT round(sum(c), 4) FROM {live} WHERE usage_date = DATE '2001-08-01') AS cost_today, (SELECT round(sum(c), 4) FROM {live} WHERE usage_date BETWEEN DATE '2001-07-26' AND DATE '2001-08-01') AS cost_7d"""
    base = f"{_RUN}, {_TASK}, {_JOB_HEALTH}, {_PIPE_HEALTH}, {_QUERY}, {_COST.replace(_PIPES + ', ', '')}"
    q["platform_summary"] = f"WITH {base} SELECT {figures}"
    q["platform_alerts"] = f"""WITH {base}, f AS (SELECT {figures}, (SELECT count(*) FROM (SELECT (SELECT sum(c) FROM {live} WHERE usage_date = DATE '2001-08-01') AS t, (SELECT avg(c) FROM {live} WHERE usage_date BETWEEN DATE '2001-07-25' AND DATE '2001-07-31') AS p) WHERE t > 1 AND t > 2 * p) AS spikes)
SELECT alert, CAST(n AS BIGINT) AS alert_count, CASE WHEN alert = 'NEVER_RUN' THEN 'PAUSED' WHEN n > 0 THEN 'TRIGGERED' ELSE 'OK' END AS state FROM (SELECT unnest(['PIPELINE_FAILURE', 'JOB_FAILURE', 'QUERY_FAILURE', 'NEVER_RUN', 'COST_SPIKE']) AS alert, unnest([failed_pipelines, failed_jobs_24h, failed_queries_24h, never_run_jobs, spikes]) AS n FROM f)"""
    kinds = {
        "deleted definitions": "jobs WHERE delete_time IS NOT NULL", "runs in progress": "run WHERE slices = 3 AND result_state IS NULL", "failed after success": f"run WHERE result_state IN {_BROKEN} AND slices > 1", "jobs never run": "jh WHERE operational_status = 'NEVER_RUN'",
        "retractions": "billing_usage WHERE record_type = 'RETRACTION' AND usage_quantity < 0", "warehouses without events": "wh WHERE warehouse_status = 'NO_EVENT_HISTORY'",
    }
    counted = " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) AS rows FROM {t}" for n, t in kinds.items())
    q["platform_validation"] = f"WITH {_RUN}, {_JOB_HEALTH}, {_HOUSES}, {_t('billing_usage')}, k AS ({counted}) SELECT *, CASE WHEN rows > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM k"
    wanted = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in EXPECTED_GRANTS)
    q["grants_check"] = f"WITH {_t('table_privileges')}, e(principal, privilege, securable) AS (VALUES {wanted}) SELECT *, 'MISSING' AS finding FROM (SELECT * FROM e EXCEPT SELECT * FROM table_privileges) UNION ALL SELECT *, 'UNEXPECTED' FROM (SELECT * FROM table_privileges EXCEPT SELECT * FROM e)"
    return q
