"""SQL for the queries of problems 1 to 7, as DuckDB runs it over the same tables."""

from __future__ import annotations

_KEPT = """
d AS (SELECT nullif(lower(trim(event_id)), '') AS eid, coalesce(simulated_arrival_at, kafka_timestamp) AS arr, * FROM payment_events),
ranked AS (SELECT *, CASE WHEN eid IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY eid ORDER BY arr, batch_id, kafka_partition, kafka_offset) END AS rn FROM d),
kept AS (SELECT * FROM ranked WHERE rn = 1)
"""

_HISTORY = """
h0 AS (SELECT lower(trim(merchant_id)) AS m, __start_at AS s, upper(trim(merchant_risk_rating)) AS r, upper(trim(merchant_status)) AS st,
              coalesce(__end_at, TIMESTAMP '9999-01-01') AS e, record_version AS v FROM merchant_history WHERE merchant_id IS NOT NULL),
h1 AS (SELECT m, s, r, st, e FROM (SELECT *, row_number() OVER (PARTITION BY m, s ORDER BY v DESC, r DESC, st DESC, e DESC) AS rn FROM h0) WHERE rn = 1),
h2 AS (SELECT m, r, st, s, least(e, coalesce(lead(s) OVER (PARTITION BY m ORDER BY s), TIMESTAMP '9999-01-01'), coalesce((SELECT min(snapshot_at) FROM merchant_snapshots), TIMESTAMP '9999-01-01')) AS e FROM h1),
cal AS (SELECT t, coalesce(lead(t) OVER (ORDER BY t), TIMESTAMP '9999-01-01') AS t2 FROM (SELECT DISTINCT snapshot_at AS t FROM merchant_snapshots)),
s1 AS (SELECT * FROM (SELECT lower(trim(merchant_id)) AS m, snapshot_at AS s, upper(trim(risk_rating)) AS r, upper(trim(status)) AS st, coalesce(is_deleted, false) AS gone,
       row_number() OVER (PARTITION BY lower(trim(merchant_id)), snapshot_at ORDER BY record_version DESC, source_updated_at DESC) AS rn FROM merchant_snapshots WHERE merchant_id IS NOT NULL) WHERE rn = 1 AND NOT gone),
u AS (SELECT m, r, st, s, e FROM h2 WHERE e > s UNION ALL SELECT s1.m, s1.r, s1.st, s1.s, cal.t2 FROM s1 JOIN cal ON cal.t = s1.s),
b AS (SELECT *, CASE WHEN lag(e) OVER w = s AND lag(r) OVER w IS NOT DISTINCT FROM r AND lag(st) OVER w IS NOT DISTINCT FROM st THEN 0 ELSE 1 END AS fresh FROM u WINDOW w AS (PARTITION BY m ORDER BY s)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY m ORDER BY s) AS grp FROM b),
hist AS (SELECT m, any_value(r) AS r, any_value(st) AS st, min(s) AS s, max(e) AS e FROM g GROUP BY m, grp)
"""

_TXN = """
t AS (SELECT * FROM (SELECT lower(trim(transaction_id)) AS txn, nullif(lower(trim(account_id)), '') AS account_id, nullif(lower(trim(customer_id)), '') AS customer_id, nullif(lower(trim(merchant_id)), '') AS merchant_id,
      event_timestamp AS ts, event_date, amount, upper(trim(customer_risk_rating)) AS crr, upper(trim(merchant_risk_rating)) AS mrr,
      row_number() OVER (PARTITION BY lower(trim(transaction_id)) ORDER BY event_timestamp, bronze_ingested_at, source_file_name) AS rn FROM payment_transactions_enriched) WHERE rn = 1)
"""

_DIMS = """
cv AS (SELECT DISTINCT lower(trim(customer_id)) AS k, record_version AS v, source_updated_at AS s, coalesce(is_deleted, false) AS gone, upper(trim(risk_rating)) AS val FROM master_data_cdc WHERE customer_id IS NOT NULL AND record_version IS NOT NULL),
av AS (SELECT DISTINCT lower(trim(account_id)) AS k, record_version AS v, source_updated_at AS s, coalesce(is_deleted, false) AS gone FROM accounts WHERE account_id IS NOT NULL AND record_version IS NOT NULL)
"""


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["p1_found"] = f"WITH {_KEPT} SELECT eid AS event_id, batch_id, kafka_partition, kafka_offset FROM ranked WHERE rn > 1"
    q["p1_exactly_once"] = f"WITH {_KEPT} SELECT * EXCLUDE (eid, arr, rn) FROM kept"
    stamp = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
    q["p2_found"] = f"WITH {_HISTORY} SELECT m AS merchant_id, {stamp.format('s')} AS start_at, CASE WHEN e = TIMESTAMP '9999-01-01' THEN 'open' ELSE {stamp.format('e')} END AS end_at FROM hist"
    q["p2_history"] = f"WITH {_HISTORY} SELECT m AS merchant_id, r AS merchant_risk_rating, st AS merchant_status, {stamp.format('s')} AS __start_at, CASE WHEN e < TIMESTAMP '9999-01-01' THEN {stamp.format('e')} END AS __end_at FROM hist"
    last = """
x AS (SELECT *, lower(trim(customer_id)) AS k, row_number() OVER (PARTITION BY lower(trim(customer_id)) ORDER BY record_version DESC, coalesce(is_deleted, false) DESC, feed_position DESC) AS rn FROM master_data_cdc WHERE customer_id IS NOT NULL AND record_version IS NOT NULL)
"""
    q["p3_found"] = f"WITH {last} SELECT k AS customer_id, record_version FROM x WHERE rn = 1 AND NOT coalesce(is_deleted, false)"
    q["p3_current"] = f"""WITH {last} SELECT k AS customer_id, record_version, first_name, last_name, email, city, state, country,
        nullif(upper(trim(risk_rating)), '') AS risk_rating, nullif(upper(trim(kyc_status)), '') AS kyc_status, nullif(upper(trim(status)), '') AS status FROM x WHERE rn = 1 AND NOT coalesce(is_deleted, false)"""
    timed = f"""{_KEPT},
e AS (SELECT eid, nullif(lower(trim(transaction_id)), '') AS txn, sequence_number AS seq, event_timestamp AS ts, arr, amount, epoch_us(arr) - epoch_us(event_timestamp) AS delay FROM kept WHERE event_timestamp IS NOT NULL)"""
    q["p4_found"] = f"""WITH {timed},
low AS (SELECT *, min(arr) OVER (PARTITION BY txn ORDER BY seq DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM e WHERE txn IS NOT NULL AND seq IS NOT NULL)
SELECT eid AS event_id, strftime(ts, '%Y-%m-%d %H') AS event_hour, outcome FROM (
  SELECT eid, ts, CASE WHEN delay > 21600000000 THEN 'DROPPED' ELSE 'CORRECTS' END AS outcome FROM e WHERE delay > 7200000000
  UNION ALL SELECT eid, ts, 'OUT_OF_ORDER' FROM low WHERE ahead < arr) WHERE eid IS NOT NULL"""
    q["p4_hourly"] = f"""WITH {timed},
f AS (SELECT date_trunc('hour', ts) AS h, amount, CASE WHEN delay > 7200000000 THEN epoch_us(arr) // 600000000 END AS ep FROM e WHERE delay <= 21600000000)
SELECT strftime(h, '%Y-%m-%d %H') AS event_hour, count(*) AS event_count, CAST(sum(coalesce(amount, 0)) AS DOUBLE) AS amount_sum, CAST(count(DISTINCT ep) AS INTEGER) AS corrections FROM f GROUP BY h"""
    q["p4_daily"] = f"""WITH {timed} SELECT strftime(ts, '%Y-%m-%d') AS event_date, count(*) AS event_count, CAST(sum(coalesce(amount, 0)) AS DOUBLE) AS amount_sum FROM e WHERE delay <= 21600000000 GROUP BY 1"""
    q["late_stream"] = f"""WITH {timed} SELECT strftime(ts, '%Y-%m-%d %H') AS event_hour, count(*) AS event_count, CAST(sum(coalesce(amount, 0)) AS DOUBLE) AS amount_sum FROM e WHERE delay <= 21600000000 GROUP BY 1"""
    roll = f"""{_TXN},
pay AS (SELECT 'customer' AS kind, customer_id AS id, CAST(ts AS DATE) AS d, coalesce(amount, 0) AS a FROM t WHERE ts IS NOT NULL AND customer_id IS NOT NULL
        UNION ALL SELECT 'merchant', merchant_id, CAST(ts AS DATE), coalesce(amount, 0) FROM t WHERE ts IS NOT NULL AND merchant_id IS NOT NULL),
daily AS (SELECT kind, id, d, count(*) AS n, sum(a) AS s FROM pay GROUP BY ALL),
days AS (SELECT unnest(generate_series(DATE '2026-07-02', DATE '2026-08-01', INTERVAL 1 DAY))::DATE AS day)"""
    window = """
want AS (SELECT kind, id, day FROM ({panel}) p, days),
w AS (SELECT want.kind, want.id, want.day,
  coalesce(sum(n) FILTER (d >= day - 7), 0)::BIGINT AS c7, coalesce(sum(s) FILTER (d >= day - 7), 0)::DOUBLE AS s7, coalesce(sum(n), 0)::BIGINT AS c30, coalesce(sum(s), 0)::DOUBLE AS s30
  FROM want LEFT JOIN daily ON daily.kind = want.kind AND daily.id = want.id AND d >= day - 30 AND d < day GROUP BY ALL)"""
    told = """
told AS (SELECT 'customer' AS kind, lower(trim(customer_id)) AS id, CAST(feature_timestamp AS DATE) AS day, customer_txn_count_7d AS c7, customer_amount_sum_7d AS s7, customer_txn_count_30d AS c30, customer_avg_amount_30d AS a30 FROM customer_behavior_features
  UNION SELECT 'merchant', lower(trim(merchant_id)), CAST(feature_timestamp AS DATE), merchant_txn_count_7d, merchant_amount_sum_7d, merchant_txn_count_30d, merchant_avg_amount_30d FROM merchant_behavior_features)"""
    avg30 = "CASE WHEN w.c30 > 0 THEN w.s30 / w.c30 ELSE 0 END"
    q["p5_found"] = f"""WITH {roll}, {told}, {window.format(panel="SELECT DISTINCT kind, id FROM told WHERE id IS NOT NULL")}
SELECT DISTINCT w.id AS entity_id, strftime(w.day, '%Y-%m-%d') AS feature_date FROM w LEFT JOIN told ON told.kind = w.kind AND told.id = w.id AND told.day = w.day
WHERE told.id IS NULL OR told.c7 IS NULL OR told.s7 IS NULL OR told.c30 IS NULL OR told.a30 IS NULL OR told.c7 <> w.c7 OR told.c30 <> w.c30 OR abs(told.s7 - w.s7) > 0.010000001 OR abs(told.a30 - {avg30}) > 0.010000001"""
    q["p5_rolling"] = f"""WITH {roll}, {window.format(panel="SELECT DISTINCT kind, id FROM daily")}
SELECT kind, id AS entity_id, strftime(day, '%Y-%m-%d') AS feature_date, c7 AS txn_count_7d, c30 AS txn_count_30d, s7 AS amount_sum_7d, s30 AS amount_sum_30d,
  CASE WHEN c7 > 0 THEN s7 / c7 ELSE 0 END AS avg_amount_7d, CASE WHEN c30 > 0 THEN s30 / c30 ELSE 0 END AS avg_amount_30d, s7 / 7 AS daily_amount_7d, s30 / 30 AS daily_amount_30d FROM w"""
    refs = f"""{_HISTORY}, {_TXN}, {_DIMS},
ref AS (SELECT txn, ts, event_date, 'account_id' AS f, account_id AS k FROM t UNION ALL SELECT txn, ts, event_date, 'customer_id', customer_id FROM t UNION ALL SELECT txn, ts, event_date, 'merchant_id', merchant_id FROM t),
par AS (SELECT 'account_id' AS f, lower(trim(account_id)) AS k FROM accounts UNION SELECT 'customer_id', lower(trim(customer_id)) FROM master_data_cdc UNION SELECT 'merchant_id', lower(trim(merchant_id)) FROM merchant_history UNION SELECT 'merchant_id', lower(trim(merchant_id)) FROM merchant_snapshots),
ver AS (SELECT 'account_id' AS f, k, v, s, gone FROM av UNION ALL SELECT 'customer_id', k, v, s, gone FROM cv),
stt AS (SELECT ref.txn, ref.f, ref.event_date, ref.ts, ref.k, par.k IS NULL AS missing,
   count(ver.k) AS n_ver, min(ver.s) AS first_s, arg_max(ver.gone, ver.v) FILTER (ver.s <= ref.ts) AS last_gone
   FROM ref LEFT JOIN par ON par.f = ref.f AND par.k = ref.k LEFT JOIN ver ON ver.f = ref.f AND ver.k = ref.k WHERE ref.k IS NOT NULL GROUP BY ALL),
mst AS (SELECT ref.txn, min(hist.s) AS first_s, count(*) FILTER (hist.s <= ref.ts AND hist.e > ref.ts) AS live FROM ref JOIN hist ON hist.m = ref.k WHERE ref.f = 'merchant_id' GROUP BY ref.txn),
found AS (SELECT stt.txn, stt.f, stt.event_date, CASE WHEN missing THEN 'MISSING' WHEN stt.ts IS NULL THEN NULL
   WHEN stt.f = 'merchant_id' THEN CASE WHEN mst.first_s > stt.ts THEN 'LATER' WHEN mst.live = 0 THEN 'DELETED' END
   WHEN stt.first_s > stt.ts THEN 'LATER' WHEN last_gone THEN 'DELETED' END AS reason
   FROM stt LEFT JOIN mst ON mst.txn = stt.txn AND stt.f = 'merchant_id')"""
    q["p6_found"] = f"WITH {refs} SELECT txn AS transaction_id, f AS ref_field, reason FROM found WHERE reason IS NOT NULL"
    q["p6_report"] = f"WITH {refs} SELECT f AS ref_field, strftime(event_date, '%Y-%m-%d') AS event_date, reason, count(*) AS refs FROM found WHERE reason IS NOT NULL GROUP BY ALL"
    q["p6_missing_rows"] = """WITH par AS (SELECT 'account_id' AS f, lower(trim(account_id)) AS k FROM accounts UNION SELECT 'customer_id', lower(trim(customer_id)) FROM master_data_cdc UNION SELECT 'merchant_id', lower(trim(merchant_id)) FROM merchant_history UNION SELECT 'merchant_id', lower(trim(merchant_id)) FROM merchant_snapshots),
ref AS (SELECT event_date, unnest(['account_id', 'customer_id', 'merchant_id']) AS f, unnest([nullif(lower(trim(account_id)), ''), nullif(lower(trim(customer_id)), ''), nullif(lower(trim(merchant_id)), '')]) AS k FROM payment_transactions_enriched)
SELECT f AS ref_field, strftime(event_date, '%Y-%m-%d') AS event_date, count(*) AS orphans FROM ref WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM par WHERE par.f = ref.f AND par.k = ref.k) GROUP BY ALL"""
    rated = f"""{_HISTORY}, {_TXN}, {_DIMS},
c AS (SELECT t.txn, arg_max(struct_pack(gone := cv.gone, val := cv.val), cv.v) AS hit FROM t JOIN cv ON cv.k = t.customer_id AND cv.s <= t.ts GROUP BY t.txn),
m AS (SELECT t.txn, any_value(hist.r) AS val FROM t JOIN hist ON hist.m = t.merchant_id AND hist.s <= t.ts AND hist.e > t.ts GROUP BY t.txn),
rate AS (SELECT t.txn, 'customer_risk_rating' AS f, t.crr AS stored, CASE WHEN NOT c.hit.gone THEN c.hit.val END AS val FROM t LEFT JOIN c ON c.txn = t.txn WHERE t.ts IS NOT NULL
   UNION ALL SELECT t.txn, 'merchant_risk_rating', t.mrr, m.val FROM t LEFT JOIN m ON m.txn = t.txn WHERE t.ts IS NOT NULL)"""
    q["p7_found"] = f"WITH {rated} SELECT txn AS transaction_id, f AS rating_field FROM rate WHERE stored IS DISTINCT FROM val"
    q["p7_ratings"] = f"WITH {rated} SELECT txn AS transaction_id, f AS rating_field, val AS rating FROM rate"
    q["p7_bitemporal"] = """WITH b AS (SELECT * FROM (SELECT lower(trim(transaction_id)) AS txn, nullif(lower(trim(customer_id)), '') AS k, event_timestamp AS ts, bronze_ingested_at AS loaded,
   row_number() OVER (PARTITION BY lower(trim(transaction_id)) ORDER BY bronze_ingested_at) AS rn FROM payment_transactions_enriched WHERE event_timestamp IS NOT NULL) WHERE rn = 1),
ask AS (SELECT txn, k, ts, 'event' AS known_at, ts AS known FROM b UNION ALL SELECT txn, k, ts, 'load', loaded FROM b),
cv AS (SELECT lower(trim(customer_id)) AS k, ingested_at AS i, source_updated_at AS s, record_version AS v, coalesce(is_deleted, false) AS gone, upper(trim(risk_rating)) AS val FROM master_data_cdc
   WHERE customer_id IS NOT NULL AND record_version IS NOT NULL AND ingested_at IS NOT NULL AND source_updated_at IS NOT NULL),
hit AS (SELECT ask.txn, ask.known_at, ask.k IS NULL OR ask.known IS NULL AS no_key, count(cv.k) AS n, arg_max(struct_pack(gone := gone, val := val), epoch_us(s) * 4096 + v) FILTER (i <= known AND s <= ts) AS h FROM ask LEFT JOIN cv ON cv.k = ask.k GROUP BY ALL)
SELECT txn AS transaction_id, known_at, CASE WHEN no_key THEN 'NO_KEY' WHEN n = 0 THEN 'UNKNOWN' WHEN h IS NULL THEN 'EARLY' WHEN h.gone THEN 'GONE' ELSE 'IN_FORCE' END AS state, CASE WHEN NOT no_key AND NOT h.gone THEN h.val END AS rating FROM hit"""
    return q
