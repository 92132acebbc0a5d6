"""The platform's own tables, made from the driver tables at any size.

Each table is one SELECT that Spark and other engines read alike: definitions with a later
deletion, runs in one to three slices of which the last may be open or failed after one that
succeeded, jobs that never ran, retracted usage, prices that overlap, warehouses without
events.  Nothing is random, so a table is the same every time it is made.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import table

_LINES = "(SELECT l_orderkey, l_linenumber, max(l_partkey) AS part, max(l_suppkey) AS supp, max(l_quantity) AS qty, max(l_returnflag) AS flag, max(l_linestatus) AS line, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey, l_linenumber) l"


def _union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


def _definition(key: str, name: str, source: str, label: str) -> str:
    """Two versions of every second definition; of every fourteenth the later one is deleted."""
    held = f"'acct' AS account_id, CAST({key} % 3 AS STRING) AS workspace_id, CAST({key} AS STRING) AS {label}_id"
    first = f"SELECT {held}, concat('{label} ', {name}) AS name, {key} % 11 = 0 AS paused, CAST({key} % 7 * 600 AS INTEGER) AS timeout_seconds, TIMESTAMP '2001-01-01 00:00:00' AS change_time, CAST(NULL AS TIMESTAMP) AS delete_time FROM {source}"
    later = f"SELECT {held}, concat('{label} ', {name}, ' v2') AS name, {key} % 11 = 0 AS paused, CAST({key} % 7 * 600 AS INTEGER) AS timeout_seconds, TIMESTAMP '2001-06-01 00:00:00' AS change_time, CASE WHEN {key} % 14 = 0 THEN TIMESTAMP '2001-06-02 00:00:00' END AS delete_time FROM {source} WHERE {key} % 2 = 0"
    return _union(first, later)


def _slice(i: int) -> str:
    """One slice of an order's run; the last one, number ``o_orderkey % 3``, has its final state."""
    final = "CASE WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 'TIMED_OUT' WHEN o_orderstatus = 'P' THEN 'FAILED' WHEN o_orderkey % 5 = 0 THEN 'SKIPPED' WHEN o_orderkey % 13 = 0 THEN 'ODD' END"
    state = f"CASE WHEN o_orderkey % 3 = {i} THEN {final} WHEN o_orderkey % 5 = 0 THEN 'SUCCEEDED' END"
    return f"SELECT 'acct' AS account_id, CAST(o_custkey % 3 AS STRING) AS workspace_id, CAST(o_custkey AS STRING) AS job_id, CAST(o_orderkey AS STRING) AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'PERIODIC' ELSE 'MANUAL' END AS trigger_type, o_orderdate + INTERVAL '{i}' HOUR AS period_start_time, o_orderdate + INTERVAL '{i}' HOUR + (o_orderkey % 50 + 1) * INTERVAL '1' MINUTE AS period_end_time, {state} AS result_state, CASE WHEN o_orderkey % 3 = {i} AND o_orderstatus = 'P' THEN 'USER_ERROR' END AS termination_code FROM orders WHERE o_orderkey % 3 >= {i}"


def _price(change: str, until: str, factor: str) -> str:
    return f"SELECT 'acct' AS account_id, concat('sku-', CAST(n_nationkey % 10 AS STRING)) AS sku_name, 'HOUR' AS usage_unit, 'USD' AS currency_code, TIMESTAMP '{change}' AS price_start_time, {until} AS price_end_time, CAST(n_nationkey % 10 + 1 AS DECIMAL(18,4)) * {factor} AS unit_price FROM nation WHERE n_nationkey < 9"


#: Every table and the SELECT that makes it.
TABLES = {
    "jobs": _definition("c_custkey", "c_name", "customer", "job"),
    "pipelines": _definition("s_suppkey", "s_name", "supplier", "pipeline"),
    "job_run_timeline": _union(*[_slice(i) for i in range(3)]),
    "job_task_run_timeline": f"SELECT 'acct' AS account_id, CAST(o_custkey % 3 AS STRING) AS workspace_id, CAST(o_custkey AS STRING) AS job_id, CAST(l_orderkey AS STRING) AS run_id, concat('task-', CAST(l_linenumber AS STRING)) AS task_key, shipped AS period_start_time, shipped + (part % 90) * INTERVAL '1' SECOND AS period_end_time, CASE WHEN line = 'O' THEN NULL WHEN flag = 'R' THEN 'FAILED' ELSE 'SUCCEEDED' END AS result_state FROM {_LINES} JOIN orders ON o_orderkey = l_orderkey",
    "pipeline_update_timeline": f"SELECT 'acct' AS account_id, CAST(supp % 3 AS STRING) AS workspace_id, CAST(supp AS STRING) AS pipeline_id, concat('u-', CAST(l_orderkey AS STRING)) AS update_id, CASE WHEN part % 2 = 0 THEN 'REFRESH' ELSE 'FULL_REFRESH' END AS update_type, shipped AS period_start_time, shipped + (part % 300) * INTERVAL '1' SECOND AS period_end_time, CASE WHEN line = 'O' AND part % 5 = 0 THEN NULL WHEN flag = 'R' THEN 'FAILED' WHEN flag = 'A' THEN 'COMPLETED' ELSE 'CANCELED' END AS result_state FROM {_LINES} WHERE l_linenumber = 1 AND supp % 10 <> 9",
    "query_history": f"SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS statement_id, CASE WHEN flag = 'R' AND part % 4 = 0 THEN 'FAILED' WHEN flag = 'R' AND part % 4 = 1 THEN 'CANCELED' ELSE 'FINISHED' END AS execution_status, CAST(part % 50 * 1000 AS BIGINT) AS waiting_for_compute_ms, CASE WHEN part % 3 > 0 THEN CAST(part % 20 * 1000 AS BIGINT) END AS waiting_at_capacity_ms, CAST(qty * 2000 AS BIGINT) AS total_ms, CAST(part % 10 AS BIGINT) AS pruned_files, CASE WHEN supp % 10 > 0 THEN CAST(supp % 7 AS BIGINT) END AS read_files, CAST(part AS BIGINT) * 1000000 AS read_bytes, CASE WHEN supp % 13 = 0 THEN CAST(part * 1000 AS BIGINT) END AS spilled_bytes, part % 6 = 0 AS from_result_cache, CASE WHEN l_linenumber % 2 = 0 THEN CAST(part % 2000 AS STRING) END AS source_job_id, CASE WHEN part % 3 = 0 THEN 'select * from PAYMENTS.gold' ELSE 'select 1' END AS statement_text, shipped AS start_time FROM {_LINES}",
    "warehouses": _union(*[f"SELECT CAST(s_suppkey % 3 AS STRING) AS workspace_id, CAST(s_suppkey AS STRING) AS warehouse_id, concat('warehouse ', s_name{v}) AS warehouse_name, CAST(s_suppkey % 8 * 10 AS INTEGER) AS auto_stop_minutes, TIMESTAMP '2001-0{m}-01 00:00:00' AS change_time, {d} AS delete_time FROM supplier WHERE s_suppkey < 40{w}" for v, m, d, w in (("", 1, "CAST(NULL AS TIMESTAMP)", ""), (", ' v2'", 6, "CASE WHEN s_suppkey % 10 = 0 THEN TIMESTAMP '2001-06-02 00:00:00' END", " AND s_suppkey % 2 = 0"))]),
    "warehouse_events": "SELECT CAST(user_id % 35 AS STRING) AS warehouse_id, CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'STARTING' WHEN 'signup' THEN 'STOPPED' WHEN 'purchase' THEN 'SCALED_DOWN' ELSE 'ODD' END AS event_type, CAST(event_id % 4 AS INTEGER) AS cluster_count, event_id, ts AS event_time FROM events",
    "billing_usage": f"SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS record_id, 'acct' AS account_id, CAST(supp % 3 AS STRING) AS workspace_id, concat('sku-', CAST(supp % 10 AS STRING)) AS sku_name, 'HOUR' AS usage_unit, shipped AS usage_start_time, CAST(shipped AS DATE) AS usage_date, CAST(CASE WHEN flag = 'R' THEN -qty ELSE qty END AS DECIMAL(18,4)) AS usage_quantity, CASE flag WHEN 'N' THEN 'ORIGINAL' WHEN 'A' THEN 'RESTATEMENT' ELSE 'RETRACTION' END AS record_type, CASE WHEN l_linenumber % 4 = 0 THEN part % 2000 END AS job_id, CASE WHEN l_linenumber % 4 = 0 THEN l_orderkey END AS job_run_id, CASE WHEN l_linenumber % 4 = 1 THEN supp END AS pipeline_id, CASE WHEN l_linenumber % 4 = 2 THEN CAST(supp AS STRING) END AS warehouse_id FROM {_LINES}",
    "list_prices": _union(_price("1990-01-01 00:00:00", "TIMESTAMP '2000-06-01 00:00:00'", "1"), _price("2000-01-01 00:00:00", "CAST(NULL AS TIMESTAMP)", "2")),
    "audit": "SELECT event_id, CAST(user_id % 5 AS STRING) AS workspace_id, ts AS event_time, CAST(ts AS DATE) AS event_date, CASE WHEN event_type = 'signup' THEN 'catalog' ELSE 'jobs' END AS service_name, CASE event_type WHEN 'view' THEN 'getTable' WHEN 'click' THEN 'updateJob' WHEN 'signup' THEN 'updatePermissions' WHEN 'purchase' THEN 'createJob' ELSE 'runNow' END AS action_name, CASE WHEN value > 100 THEN concat('user-', CAST(user_id AS STRING)) END AS initiating_identity, CASE WHEN user_id % 2 = 0 THEN concat('svc-', CAST(user_id % 7 AS STRING)) END AS run_as_identity, CASE WHEN event_type = 'error' AND value > 300 THEN 503 WHEN event_type = 'error' THEN 403 ELSE 200 END AS response_status_code FROM events",
    "table_privileges": "SELECT DISTINCT concat('group-', CAST(user_id % 4 AS STRING)) AS principal, CASE WHEN event_type = 'purchase' THEN 'MODIFY' ELSE 'SELECT' END AS privilege, concat('schema-', CAST(event_id % 3 AS STRING)) AS securable FROM events WHERE user_id % 4 <> 3 OR event_type = 'view'",
}
_SOURCES = ("customer", "supplier", "orders", "lineitem", "events", "nation")


def system_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of TABLES; times are without a zone."""
    text = TABLES[name]
    for source in _SOURCES:
        if source in text:
            table(spark, sf_dir, source).createOrReplaceTempView(f"tm_source_{source}")
    text = re.sub(r"\b(FROM|JOIN) (" + "|".join(_SOURCES) + r")\b", r"\1 tm_source_\2", text).replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")
    return spark.sql(text)
