"""SQL for the queries of the relational core, as DuckDB runs it over the same tables."""

from __future__ import annotations

from tidemark.operators.scoring import THRESHOLDS

_I = "nullif(lower(trim({0})), '')"
_C = "nullif(upper(trim({0})), '')"


def _ident(c: str) -> str:
    return _I.format(c)


def _code(c: str) -> str:
    return _C.format(c)


_TX = f"""
tx AS (SELECT * EXCLUDE (rn) FROM (SELECT {_ident('transaction_id')} AS transaction_id, {_ident('account_id')} AS account_id, {_ident('customer_id')} AS customer_id, {_ident('merchant_id')} AS merchant_id,
  event_timestamp, CAST(event_timestamp AS DATE) AS event_date, amount, {_code('currency')} AS currency, {_code('channel')} AS channel, {_code('payment_method')} AS payment_method, {_code('transaction_status')} AS transaction_status,
  {_code('transaction_country')} AS country, card_present,
  row_number() OVER (PARTITION BY {_ident('transaction_id')} ORDER BY bronze_ingested_at NULLS FIRST, source_file_name NULLS FIRST, payment_transactions_enriched.transaction_id) AS rn FROM payment_transactions_enriched) WHERE rn = 1)"""

_EV = f"""
ev AS (SELECT {_ident('event_id')} AS event_id, {_ident('transaction_id')} AS transaction_id, {_ident('merchant_id')} AS merchant_id, upper(trim(event_type)) AS event_type, upper(trim(currency)) AS currency, upper(trim(channel)) AS channel,
  upper(trim(transaction_status)) AS transaction_status, upper(trim(delivery_scenario)) AS delivery_scenario, sequence_number, event_timestamp, amount, simulated_arrival_at, kafka_partition, kafka_offset, kafka_timestamp,
  CAST(floor(epoch_us(coalesce(simulated_arrival_at, kafka_timestamp)) / 1000000) - floor(epoch_us(event_timestamp) / 1000000) AS BIGINT) AS delay FROM payment_events)"""

_TRUSTED = f"""{_EV},
trusted AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(simulated_arrival_at, kafka_timestamp), kafka_timestamp, kafka_partition, kafka_offset) AS rn FROM ev WHERE event_id IS NOT NULL) WHERE rn = 1)"""

_ACC = f"""
alog AS (SELECT * EXCLUDE (rn) FROM (SELECT {_ident('account_id')} AS account_id, {_ident('customer_id')} AS customer_id, upper(trim(account_type)) AS account_type, upper(trim(status)) AS account_status, record_version, source_updated_at, coalesce(is_deleted, false) AS is_deleted,
  row_number() OVER (PARTITION BY {_ident('account_id')}, record_version ORDER BY source_updated_at DESC, {_ident('customer_id')} DESC, upper(trim(account_type)) DESC NULLS LAST, upper(trim(currency)) DESC NULLS LAST, upper(trim(status)) DESC NULLS LAST) AS rn FROM accounts WHERE account_id IS NOT NULL AND record_version IS NOT NULL) WHERE rn = 1)"""

_CUS = f"""
clog AS (SELECT * EXCLUDE (rn) FROM (SELECT {_ident('customer_id')} AS customer_id, upper(trim(country)) AS country, upper(trim(risk_rating)) AS risk_rating, upper(trim(kyc_status)) AS kyc_status, upper(trim(status)) AS customer_status, record_version, source_updated_at, coalesce(is_deleted, false) AS is_deleted,
  row_number() OVER (PARTITION BY {_ident('customer_id')}, record_version ORDER BY source_updated_at DESC, upper(trim(country)) DESC NULLS LAST, upper(trim(risk_rating)) DESC NULLS LAST, upper(trim(kyc_status)) DESC NULLS LAST, upper(trim(status)) DESC NULLS LAST) AS rn FROM master_data_cdc WHERE nullif(trim(customer_id), '') IS NOT NULL AND record_version IS NOT NULL) WHERE rn = 1)"""

_RICH = f"""{_TX},{_ACC},{_CUS},
acur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY record_version DESC) AS rn FROM alog) WHERE rn = 1 AND NOT is_deleted),
ccur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY record_version DESC) AS rn FROM clog) WHERE rn = 1 AND NOT is_deleted),
mer AS (SELECT * FROM (SELECT {_ident('merchant_id')} AS merchant_id, trim(merchant_name) AS merchant_name, trim(merchant_category_code) AS merchant_category_code, {_code('risk_rating')} AS merchant_risk_rating, {_code('status')} AS merchant_status,
  row_number() OVER (PARTITION BY {_ident('merchant_id')} ORDER BY snapshot_at DESC, record_version DESC) AS rn FROM merchant_snapshots) WHERE rn = 1 AND merchant_id IS NOT NULL),
fc AS (SELECT transaction_id, ['OPEN', 'INVESTIGATING', 'CLOSED'][n % 3 + 1] AS fraud_case_status, ['CONFIRMED_FRAUD', 'LEGITIMATE', 'UNDETERMINED', NULL][(n // 20) % 4 + 1] AS fraud_outcome
  FROM (SELECT transaction_id, CAST(regexp_extract(transaction_id, '(\\d+)$', 1) AS BIGINT) AS n FROM tx) WHERE n % 20 = 0),
rich AS (SELECT tx.transaction_id, tx.account_id, acur.customer_id, tx.merchant_id, tx.event_timestamp, tx.event_date, tx.amount, tx.currency, tx.channel, tx.payment_method, tx.transaction_status, tx.country, tx.card_present, acur.account_type,
  ccur.risk_rating AS customer_risk_rating, mer.merchant_name, mer.merchant_category_code, mer.merchant_risk_rating, mer.merchant_status, fc.fraud_case_status, fc.fraud_outcome,
  acur.account_id IS NOT NULL AS account_dimension_match, ccur.customer_id IS NOT NULL AS customer_dimension_match, mer.merchant_id IS NOT NULL AS merchant_dimension_match, fc.transaction_id IS NOT NULL AS has_fraud_case
  FROM tx LEFT JOIN acur ON acur.account_id = tx.account_id LEFT JOIN ccur ON ccur.customer_id = acur.customer_id LEFT JOIN mer ON mer.merchant_id = tx.merchant_id LEFT JOIN fc ON fc.transaction_id = tx.transaction_id)"""

_DAY = "strftime(event_date, '%Y-%m-%d') AS event_date"


def _n(cond: str) -> str:
    return f"count(*) FILTER ({cond})"


_SUM = "CAST(sum(amount) AS DOUBLE) AS total_payment_amount, CAST(sum(amount) AS DOUBLE) / count(amount) AS average_payment_amount"
_FRAUD = f"{_n('has_fraud_case')} AS transactions_with_fraud_case, {_n("fraud_outcome = 'CONFIRMED_FRAUD'")} AS confirmed_fraud_transactions"

_RULES = {
    "transaction_id_present": "transaction_id IS NOT NULL", "account_id_present": "account_id IS NOT NULL", "merchant_id_present": "merchant_id IS NOT NULL", "event_timestamp_present": "event_timestamp IS NOT NULL", "amount_positive": "amount > 0",
    "currency_code_valid": "regexp_matches(currency, '^[A-Z]{3}$')", "channel_valid": "channel IN ('POS', 'ECOMMERCE', 'MOBILE', 'ATM')", "payment_method_valid": "payment_method IN ('DEBIT_CARD', 'CREDIT_CARD', 'DIGITAL_WALLET', 'BANK_TRANSFER')",
    "transaction_status_valid": "transaction_status IN ('AUTHORIZED', 'DECLINED', 'SETTLED', 'REVERSED', 'REFUNDED')", "country_code_valid": "regexp_matches(country, '^[A-Z]{2}$')",
}
_FAILED = "list_filter([" + ", ".join(f"CASE WHEN coalesce({p}, false) THEN NULL ELSE '{n}' END" for n, p in _RULES.items()) + "], lambda x: x IS NOT NULL)"
_DQ = f"{_TX}, dq AS (SELECT *, {_FAILED} AS failed FROM tx)"

_SCORED = f"{_TX}, sc AS (SELECT least(greatest(floor(amount / 10), 0), 100) / 100.0::DOUBLE AS score, CASE WHEN transaction_status = 'DECLINED' THEN 1 WHEN transaction_status IS NOT NULL THEN 0 END AS label FROM tx WHERE amount IS NOT NULL)"

_SERIES = f"""{_TX}, per AS (SELECT event_date AS d, count(*)::DOUBLE AS y FROM tx WHERE event_date IS NOT NULL GROUP BY 1),
cal AS (SELECT unnest(generate_series((SELECT min(d) FROM per), (SELECT max(d) FROM per), INTERVAL 1 DAY))::DATE AS d),
ser AS (SELECT cal.d, coalesce(y, 0) AS y FROM cal LEFT JOIN per ON per.d = cal.d)"""

_RUNS = f"""{_TRUSTED}, sl AS (SELECT *, greatest(coalesce(simulated_arrival_at, kafka_timestamp), event_timestamp) AS end_at FROM trusted WHERE transaction_id IS NOT NULL AND event_timestamp IS NOT NULL),
fin AS (SELECT merchant_id, transaction_id, transaction_status AS final_state FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id, transaction_id ORDER BY end_at DESC, event_timestamp DESC) AS rn FROM sl) WHERE rn = 1),
agg AS (SELECT merchant_id, transaction_id, min(event_timestamp) AS run_start, max(end_at) AS run_end, CAST(sum(epoch_us(end_at) - epoch_us(event_timestamp)) AS BIGINT) AS active_us, count(*) AS slices FROM sl GROUP BY ALL),
runs AS (SELECT agg.*, final_state, CASE WHEN final_state IS NULL THEN 'IN_PROGRESS' WHEN final_state IN ('SETTLED', 'AUTHORIZED') THEN 'HEALTHY' WHEN final_state = 'DECLINED' THEN 'FAILED' WHEN final_state IN ('REVERSED', 'REFUNDED') THEN 'SKIPPED' ELSE 'UNKNOWN' END AS status
  FROM agg JOIN fin ON fin.transaction_id = agg.transaction_id AND fin.merchant_id IS NOT DISTINCT FROM agg.merchant_id)"""

_USAGE = """
us AS (SELECT l_suppkey, l_suppkey % 10 AS sku, CASE l_returnflag WHEN 'N' THEN 'ORIGINAL' WHEN 'A' THEN 'RESTATEMENT' WHEN 'R' THEN 'RETRACTION' END AS record_type, l_shipdate, CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS DECIMAL(18,2)) AS q, l_extendedprice FROM lineitem)"""

_VEC = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.label AS ql, d.label AS dl, round(list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e))), 9) AS score FROM v q, v d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM p)"""

_CASES = f"""{_TRUSTED}, tl AS (SELECT transaction_id, list(event_type ORDER BY sequence_number, event_type) AS tools FROM trusted WHERE transaction_id IS NOT NULL AND sequence_number IS NOT NULL AND event_type IS NOT NULL GROUP BY 1),
s1 AS (SELECT transaction_id, CASE WHEN list_contains(tools, 'REFUND') OR len(list_filter(tools, lambda x: x NOT IN ('AUTHORIZATION', 'SETTLEMENT', 'DECLINE', 'REVERSAL', 'REFUND'))) > 0 THEN 0.0::DOUBLE
     ELSE (list_contains(tools, 'AUTHORIZATION')::INT + list_contains(tools, 'SETTLEMENT')::INT) / 2.0::DOUBLE END AS tool_selection,
  CASE WHEN len(tools) > len(list_distinct(tools)) THEN 0.0::DOUBLE ELSE greatest(0.0, 1.0 - 0.25 * greatest(0, len(tools) - 1))::DOUBLE END AS tool_efficiency, 0.5::DOUBLE AS structure, CASE WHEN list_contains(tools, 'REVERSAL') THEN 0.0 ELSE 1.0 END::DOUBLE AS safety FROM tl),
s2 AS (SELECT *, 0.5 * tool_selection + 0.25 * tool_efficiency + 0.15 * structure + 0.1 * safety AS overall FROM s1),
s3 AS (SELECT *, list_filter([CASE WHEN overall >= 0.6 THEN NULL ELSE 'overall_below_0.6' END, CASE WHEN safety >= 1 THEN NULL ELSE 'safety_below_1' END], lambda x: x IS NOT NULL) AS reasons FROM s2)"""


def _behaviour(entity: str, prefix: str) -> str:
    share = lambda c: f"CASE WHEN n30 > 0 THEN {c} / n30 ELSE 0.0 END"
    frames = ", ".join(f"w{d} AS (PARTITION BY id ORDER BY s RANGE BETWEEN {d * 86400} PRECEDING AND 1 PRECEDING)" for d in (1, 7, 30))
    return f"""WITH {_TX},
o AS (SELECT {entity} AS id, event_timestamp AS ets, CAST(floor(epoch_us(event_timestamp) / 1000000) AS BIGINT) AS s, count(*) AS n, sum(amount) AS t, {_n("transaction_status = 'DECLINED'")} AS dec, {_n("country <> 'AU'")} AS fgn, {_n('NOT coalesce(card_present, false)')} AS cnp
  FROM tx WHERE {entity} IS NOT NULL AND event_timestamp IS NOT NULL GROUP BY ALL),
f AS (SELECT id, ets, CAST(coalesce(sum(n) OVER w1, 0) AS BIGINT) AS n1, CAST(coalesce(sum(n) OVER w7, 0) AS BIGINT) AS n7, CAST(coalesce(sum(n) OVER w30, 0) AS BIGINT) AS n30, CAST(coalesce(sum(t) OVER w1, 0) AS DOUBLE) AS t1, CAST(coalesce(sum(t) OVER w7, 0) AS DOUBLE) AS t7,
  CAST(coalesce(sum(t) OVER w30, 0) AS DOUBLE) AS t30, coalesce(sum(dec) OVER w30, 0)::DOUBLE AS d30, coalesce(sum(fgn) OVER w30, 0)::DOUBLE AS f30, coalesce(sum(cnp) OVER w30, 0)::DOUBLE AS c30 FROM o WINDOW {frames})
SELECT id AS {entity}, strftime(ets, '%Y-%m-%d %H:%M:%S.%g') AS feature_timestamp, n1 AS {prefix}_txn_count_1d, n7 AS {prefix}_txn_count_7d, n30 AS {prefix}_txn_count_30d, t1 AS {prefix}_amount_sum_1d, t7 AS {prefix}_amount_sum_7d,
  {share('t30')} AS {prefix}_avg_amount_30d, {share('d30')} AS {prefix}_decline_rate_30d, {share('f30')} AS {prefix}_foreign_rate_30d, {share('c30')} AS {prefix}_card_not_present_rate_30d FROM f"""


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["standardized_events"] = f"WITH {_EV} SELECT event_id, transaction_id, event_type, currency, channel, transaction_status, strftime(event_timestamp, '%Y-%m-%d') AS event_date, strftime(date_trunc('hour', event_timestamp), '%Y-%m-%d %H:%M:%S') AS event_hour, delay AS delay_seconds, kafka_partition, kafka_offset FROM ev"
    q["standardized_customers"] = f"SELECT {_ident('customer_id')} AS customer_id, trim(first_name) AS first_name, trim(last_name) AS last_name, lower(trim(email)) AS email, upper(trim(state)) AS state, upper(trim(country)) AS country, upper(trim(risk_rating)) AS risk_rating, upper(trim(kyc_status)) AS kyc_status, upper(trim(status)) AS customer_status, record_version, coalesce(is_deleted, false) AS is_deleted FROM master_data_cdc"
    q["json_props"] = "SELECT event_type, count(CAST(json_extract(props, '$.k') AS BIGINT)) AS parsed, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1"
    q["message_round_trip"] = "SELECT 'PARSED' AS parse_status, event_type, count(*) AS messages, count(event_timestamp) AS timed, count(simulated_arrival_at) AS arrived, CAST(sum(amount) AS DOUBLE) AS amount_sum FROM payment_events WHERE transaction_id IS NOT NULL GROUP BY 2"
    q["dq_classified"] = f"WITH {_DQ} SELECT transaction_id, array_to_string(failed, ',') AS failed_rules, len(failed) > 0 AS is_quarantined, CASE WHEN len(failed) > 0 THEN 'QUARANTINED' ELSE 'VALID' END AS dq_status FROM dq"
    q["dq_rule_breakdown"] = f"WITH {_DQ} SELECT rule, count(*) AS failed_rows FROM (SELECT unnest(failed) AS rule FROM dq) GROUP BY 1"
    q["dq_quarantine_daily"] = f"WITH {_DQ} SELECT {_DAY}, count(*) AS quarantined_rows, CAST(sum(len(failed)) AS BIGINT) AS failed_rules FROM dq WHERE len(failed) > 0 GROUP BY 1"
    bad_customer = " AND ".join([
        "coalesce(nullif(trim(customer_id), '') IS NOT NULL, false)", "coalesce(regexp_matches(upper(trim(country)), '^[A-Z]{2}$'), false)", "coalesce(upper(trim(risk_rating)) IN ('LOW', 'MEDIUM', 'HIGH'), false)", "coalesce(upper(trim(kyc_status)) IN ('PENDING', 'VERIFIED', 'REJECTED'), false)",
        "coalesce(upper(trim(status)) IN ('ACTIVE', 'SUSPENDED', 'CLOSED'), false)", "coalesce(record_version >= 1, false)", "source_updated_at IS NOT NULL"])
    q["dq_current_health"] = f"""WITH {_DQ}, h AS (SELECT 'transactions' AS dataset, count(*) AS rows, {_n('len(failed) > 0')} AS quarantined FROM dq UNION ALL SELECT 'customers', count(*), {_n(f'NOT ({bad_customer})')} FROM master_data_cdc UNION ALL SELECT 'chargebacks', 0, 0)
SELECT *, CASE WHEN quarantined = 0 THEN 'HEALTHY' ELSE 'DEGRADED' END AS health FROM h"""
    per_rule = " UNION ALL ".join(f"SELECT '{n}' AS rule, {_n(f'coalesce({p}, false)')} AS passed, {_n(f'NOT coalesce({p}, false)')} AS failed FROM tx" for n, p in _RULES.items())
    q["dq_expectations"] = f"WITH {_TX}, r AS ({per_rule}) SELECT '2026-08-01' AS event_date, 'transactions' AS dataset, 'classify' AS flow_name, rule, passed, failed, CASE WHEN passed + failed > 0 THEN passed / (passed + failed) ELSE 1.0 END AS pass_rate, CASE WHEN passed + failed > 0 THEN failed / (passed + failed) ELSE 0.0 END AS failure_rate FROM r"
    ts = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
    dup = """
dup AS (SELECT event_id, count(*) AS physical_delivery_count, array_to_string(list_sort(list_distinct(list(delivery_scenario))), ',') AS scenarios, array_to_string(list_sort(list_distinct(list(kafka_offset))), ',') AS offsets, min(kafka_timestamp) AS a, max(kafka_timestamp) AS b FROM ev WHERE event_id IS NOT NULL GROUP BY 1)"""
    q["duplicate_summary"] = f"WITH {_EV}, {dup} SELECT event_id, physical_delivery_count, coalesce(scenarios, '') AS scenarios, offsets, {ts.format('a')} AS first_kafka_timestamp, {ts.format('b')} AS latest_kafka_timestamp FROM dup"
    q["event_exceptions"] = f"""WITH {_EV}, {dup},
occ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, delivery_scenario, simulated_arrival_at ORDER BY kafka_timestamp, kafka_partition, kafka_offset) AS rn FROM ev WHERE event_id IS NOT NULL) WHERE rn = 1),
sq AS (SELECT occ.*, CASE WHEN transaction_id IS NOT NULL THEN max(sequence_number) OVER (PARTITION BY transaction_id ORDER BY coalesce(simulated_arrival_at, kafka_timestamp) NULLS FIRST, sequence_number NULLS FIRST, event_id, delivery_scenario NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS prev FROM occ),
x AS (SELECT sq.*, dup.physical_delivery_count, list_filter([CASE WHEN dup.physical_delivery_count > 1 THEN 'DUPLICATE' END, CASE WHEN delay > 7200 THEN 'LATE' END, CASE WHEN sequence_number < prev THEN 'OUT_OF_ORDER' END], lambda z: z IS NOT NULL) AS kinds FROM sq JOIN dup USING (event_id))
SELECT event_id, transaction_id, delivery_scenario, strftime(simulated_arrival_at, '%Y-%m-%d %H:%M:%S.%g') AS arrived, physical_delivery_count, prev AS previous_max_sequence_number, array_to_string(kinds, ',') AS exceptions FROM x WHERE len(kinds) > 0"""
    q["trusted_events_batch"] = f"WITH {_TRUSTED} SELECT event_id, kafka_partition, kafka_offset, coalesce(delay > 7200, false) AS is_late_arrival, CASE WHEN delay > 7200 THEN 'LATE_ACCEPTED' ELSE 'ON_TIME' END AS event_arrival_classification FROM trusted"
    q["scd1_current"] = f"WITH {_ACC} SELECT account_id, customer_id, account_type, account_status, record_version FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY record_version DESC) AS rn FROM alog) WHERE rn = 1 AND NOT is_deleted"
    q["scd2_history"] = f"WITH {_ACC} SELECT account_id, account_status, record_version AS __START_AT, nxt AS __END_AT FROM (SELECT *, lead(record_version) OVER (PARTITION BY account_id ORDER BY record_version) AS nxt FROM alog) WHERE NOT is_deleted"
    q["cdc_invariant"] = f"WITH {_CUS}, z AS (SELECT *, lead(record_version) OVER (PARTITION BY customer_id ORDER BY record_version) AS nxt FROM clog), c AS (SELECT count(*) AS n FROM z WHERE nxt IS NULL AND NOT is_deleted) SELECT n AS current_rows, n AS open_rows, 'PASS' AS status FROM c"
    q["cdc_after_baseline"] = f"WITH {_ACC} SELECT record_version, count(*) AS changes, {_n('is_deleted')} AS deletes FROM alog l WHERE NOT EXISTS (SELECT 1 FROM alog b WHERE b.account_id = l.account_id AND b.record_version = 1 AND l.record_version <= 1) GROUP BY 1"
    q["enriched_transactions"] = f"WITH {_RICH} SELECT transaction_id, account_id, customer_id, merchant_id, CAST(amount AS DOUBLE) AS amount, account_type, customer_risk_rating, merchant_name, merchant_risk_rating, fraud_outcome, account_dimension_match, customer_dimension_match, merchant_dimension_match, has_fraud_case FROM rich"
    status = ", ".join(f"{_n(f"transaction_status = '{s}'")} AS {s.lower()}_transactions" for s in ("AUTHORIZED", "DECLINED", "SETTLED", "REVERSED", "REFUNDED"))
    high = lambda w: f"{_n(f"{w}_risk_rating = 'HIGH'")} AS high_risk_{w}_transactions"
    q["daily_payment_metrics"] = f"WITH {_RICH} SELECT {_DAY}, currency, count(*) AS transaction_count, {_SUM}, CAST(min(amount) AS DOUBLE) AS minimum_payment_amount, CAST(max(amount) AS DOUBLE) AS maximum_payment_amount, {status}, {_FRAUD}, {high('customer')}, {high('merchant')} FROM rich GROUP BY event_date, currency"
    declined = f"{_n("transaction_status = 'DECLINED'")} AS declined_transactions"
    confirmed = "CAST(coalesce(sum(amount) FILTER (fraud_outcome = 'CONFIRMED_FRAUD'), 0) AS DOUBLE) AS confirmed_fraud_amount"
    keys = "merchant_id, merchant_name, merchant_category_code, merchant_risk_rating, merchant_status, currency"
    q["merchant_payment_metrics"] = f"WITH {_RICH} SELECT {keys}, count(*) AS transaction_count, count(DISTINCT customer_id) AS distinct_customers, {_SUM}, CAST(max(amount) AS DOUBLE) AS maximum_payment_amount, {declined}, {_FRAUD}, {confirmed} FROM rich GROUP BY {keys}"
    q["channel_payment_metrics"] = f"WITH {_RICH} SELECT {_DAY}, channel, payment_method, currency, count(*) AS transaction_count, {_SUM}, {_n('card_present')} AS card_present_transactions, {_n('NOT coalesce(card_present, false)')} AS card_not_present_transactions, {declined}, {_FRAUD} FROM rich GROUP BY event_date, channel, payment_method, currency"
    case = lambda s, n: f"{_n(f"fraud_case_status = '{s}'")} AS {n}"
    outcome = lambda s, n: f"{_n(f"fraud_outcome = '{s}'")} AS {n}"
    q["fraud_operations_metrics"] = f"""WITH {_RICH} SELECT {_DAY}, currency, count(*) AS transaction_count, {_n('has_fraud_case')} AS fraud_case_transactions, {case('OPEN', 'open_fraud_cases')}, {case('INVESTIGATING', 'investigating_fraud_cases')}, {case('CLOSED', 'closed_fraud_cases')},
  {outcome('CONFIRMED_FRAUD', 'confirmed_fraud_transactions')}, {outcome('LEGITIMATE', 'legitimate_transactions')}, {outcome('UNDETERMINED', 'undetermined_transactions')}, CAST(coalesce(sum(amount) FILTER (has_fraud_case), 0) AS DOUBLE) AS payment_amount_under_investigation, {confirmed} FROM rich GROUP BY event_date, currency"""
    q["orphans_anti"] = "SELECT o_orderstatus, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders WHERE o_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1"
    q["except_all_diff"] = f"WITH {_TX}, a AS (SELECT {_ident('transaction_id')} AS transaction_id, CAST(amount AS DOUBLE) AS amount FROM payment_transactions_enriched), b AS (SELECT transaction_id, CAST(amount AS DOUBLE) AS amount FROM tx) SELECT *, 'left' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"
    q["temporal_price_cost"] = f"""WITH {_USAGE},
pr AS (SELECT n_nationkey % 10 AS sku, 1990 + (n_nationkey // 10) * 4 AS y FROM nation),
pp AS (SELECT sku, make_timestamp(y, 1, 1, 0, 0, 0) AS s, CASE WHEN y < 1998 THEN make_timestamp(y + 4, 1, 1, 0, 0, 0) END AS e, (sku + 1) * (y - 1988) AS price FROM pr),
j AS (SELECT us.sku, record_type, q, price FROM us LEFT JOIN pp ON pp.sku = us.sku AND s <= l_shipdate AND (e IS NULL OR l_shipdate < e))
SELECT sku, record_type, CAST(sum(q) AS DOUBLE) AS quantity, CAST(sum(q * price) AS DOUBLE) AS list_cost FROM j GROUP BY ALL HAVING abs(sum(q)) > 0 OR abs(sum(q * price)) > 0"""
    q["top_workloads_per_group"] = f"WITH {_USAGE}, c AS (SELECT record_type, l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS cost FROM us GROUP BY ALL) SELECT record_type, l_suppkey, CAST(cost AS DOUBLE) AS cost, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY record_type ORDER BY cost DESC, l_suppkey) AS rank FROM c) WHERE rank <= 5"
    q["merge_change_only"] = f"""WITH {_CUS}, t AS (SELECT customer_id, risk_rating, customer_status FROM clog WHERE record_version = 1 AND NOT is_deleted), s AS (SELECT customer_id, risk_rating, customer_status FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY record_version DESC) AS rn FROM clog) WHERE rn = 1 AND NOT is_deleted)
SELECT s.customer_id, s.risk_rating, s.customer_status, CASE WHEN t.customer_id IS NOT NULL AND t.risk_rating IS NOT DISTINCT FROM s.risk_rating AND t.customer_status IS NOT DISTINCT FROM s.customer_status THEN 't0' ELSE 't1' END AS updated_at FROM s LEFT JOIN t USING (customer_id)"""
    q["merge_upsert"] = f"""WITH {_ACC}, t AS (SELECT account_id, account_status FROM alog WHERE record_version = 1), s AS (SELECT account_id, account_status FROM alog WHERE record_version = 2)
SELECT coalesce(s.account_id, t.account_id) AS account_id, CASE WHEN s.account_id IS NOT NULL THEN s.account_status ELSE t.account_status END AS account_status, CASE WHEN t.account_id IS NOT NULL THEN 'c0' ELSE 'c1' END AS created_at, CASE WHEN s.account_id IS NOT NULL THEN 'u1' ELSE 'u0' END AS updated_at FROM t FULL JOIN s ON s.account_id = t.account_id"""
    hot = lambda c, names: ", ".join(f"{c} = '{n}' AS is_{n.lower()}" for n in names)
    q["transaction_features"] = f"""WITH {_TX} SELECT transaction_id, customer_id, account_id, merchant_id, {ts.format('event_timestamp')} AS transaction_event_timestamp, CAST(amount AS DOUBLE) AS amount, CASE WHEN amount > -1 THEN round(ln(1 + CAST(amount AS DOUBLE)), 9) END AS amount_log1p,
  CAST(hour(event_timestamp) AS INTEGER) AS hour_of_day, CAST(dayofweek(event_timestamp) + 1 AS INTEGER) AS day_of_week, dayofweek(event_timestamp) IN (0, 6) AS is_weekend, country <> 'AU' AS is_cross_border, NOT coalesce(card_present, false) AS is_card_not_present,
  {hot('channel', ('POS', 'ECOMMERCE', 'MOBILE', 'ATM'))}, {hot('payment_method', ('DEBIT_CARD', 'CREDIT_CARD', 'DIGITAL_WALLET', 'BANK_TRANSFER'))} FROM tx"""
    q["behavior_features_customer"] = _behaviour("customer_id", "customer")
    q["behavior_features_merchant"] = _behaviour("merchant_id", "merchant")
    inner = lambda e, p: _behaviour(e, p).replace(f"WITH {_TX},", "WITH").replace("strftime(ets, '%Y-%m-%d %H:%M:%S.%g') AS feature_timestamp", "ets AS feature_timestamp")
    q["asof_training_set"] = f"""WITH {_RICH},
lab AS (SELECT transaction_id, customer_id, merchant_id, event_timestamp, coalesce(fraud_outcome = 'CONFIRMED_FRAUD', false)::INT AS is_confirmed_fraud FROM rich WHERE coalesce(fraud_outcome <> 'UNDETERMINED', true) AND customer_id IS NOT NULL AND merchant_id IS NOT NULL),
cf AS ({inner('customer_id', 'customer')}), mf AS ({inner('merchant_id', 'merchant')}),
a AS (SELECT lab.*, cf.customer_txn_count_7d, cf.customer_amount_sum_7d FROM lab ASOF LEFT JOIN cf ON cf.customer_id = lab.customer_id AND cf.feature_timestamp <= lab.event_timestamp),
b AS (SELECT a.*, mf.merchant_txn_count_30d, mf.merchant_decline_rate_30d FROM a ASOF LEFT JOIN mf ON mf.merchant_id = a.merchant_id AND mf.feature_timestamp <= a.event_timestamp)
SELECT b.transaction_id, is_confirmed_fraud, CAST(tx.amount AS DOUBLE) AS amount, CAST(hour(tx.event_timestamp) AS INTEGER) AS hour_of_day, customer_txn_count_7d, customer_amount_sum_7d, merchant_txn_count_30d, merchant_decline_rate_30d FROM b JOIN tx ON tx.transaction_id = b.transaction_id"""
    q["temporal_split"] = f"WITH {_TX}, p AS (SELECT transaction_id, row_number() OVER (ORDER BY event_timestamp, transaction_id) AS p, count(*) OVER () AS n FROM tx WHERE event_timestamp IS NOT NULL) SELECT transaction_id, CASE WHEN p <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN p <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM p"
    cells = ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)
    at = f"""{_SCORED}, th(threshold) AS (VALUES {cells}),
m AS (SELECT threshold, {_n('score >= threshold AND label = 1')} AS tp, {_n('score >= threshold AND label = 0')} AS fp, {_n('score < threshold AND label = 1')} AS fn, {_n('score < threshold AND label = 0')} AS tn FROM th, sc GROUP BY 1)"""
    fb = lambda b: f"CASE WHEN {1 + b * b} * tp + {b * b} * fn + fp > 0 THEN {1 + b * b}.0::DOUBLE * tp / ({1 + b * b} * tp + {b * b} * fn + fp) ELSE 0.0 END"
    full = f"SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, {fb(1)} AS f1, {fb(2)} AS f2 FROM m"
    q["threshold_metrics"] = f"WITH {at} {full}"
    q["best_threshold"] = f"WITH {at}, g AS ({full}) SELECT threshold, tp, fp, fn, tn FROM g ORDER BY f2 DESC, precision DESC, threshold <> 0.5, threshold LIMIT 1"
    q["score_areas"] = f"""WITH {_SCORED}, g AS (SELECT score, sum(label) AS p, count(*) AS n FROM sc GROUP BY 1), c AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w - sum(p) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () - sum(p) OVER () AS neg FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, coalesce(lag(tp) OVER w, 0) AS tp0, coalesce(lag(fp) OVER w, 0) AS fp0, tp / (tp + fp) AS prec FROM c WINDOW w AS (ORDER BY score DESC)), e AS (SELECT *, coalesce(lag(prec) OVER (ORDER BY score DESC), 1.0) AS prec0 FROM d)
SELECT round(sum((fp - fp0) / neg * (tp + tp0) / (2 * pos)), 9) AS roc_auc, round(sum((tp - tp0) / pos * (prec + prec0) / 2), 9) AS pr_auc, round(sum((tp - tp0) / pos * prec), 9) AS average_precision FROM e"""
    q["daily_series_features"] = f"""WITH {_SERIES}, f AS (SELECT d, y, CAST(isodow(d) - 1 AS INTEGER) AS day_of_week, CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS is_weekend, round(sin((isodow(d) - 1) * (2 * pi() / 7)), 6) AS dow_sin, round(cos((isodow(d) - 1) * (2 * pi() / 7)), 6) AS dow_cos,
  lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, lag(y, 3) OVER w AS lag_3, lag(y, 7) OVER w AS lag_7, round(avg(y) OVER a, 6) AS rolling_mean_3, round(avg(y) OVER b, 6) AS rolling_mean_7, round(coalesce(stddev_samp(y) OVER a, 0), 6) AS rolling_std_3, round(coalesce(stddev_samp(y) OVER b, 0), 6) AS rolling_std_7
  FROM ser WINDOW w AS (ORDER BY d), a AS (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), b AS (ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) SELECT * REPLACE (strftime(d, '%Y-%m-%d') AS d) FROM f WHERE lag_7 IS NOT NULL"""
    q["forecast_holdouts"] = f"WITH {_SERIES}, h AS (SELECT y, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS n, least(7, greatest(3, count(*) OVER () // 5)) AS h FROM ser) SELECT CASE WHEN i > n - h THEN 'test' WHEN i > n - 2 * h THEN 'validation' ELSE 'train' END AS split, count(*) AS days, sum(y) AS payments FROM h GROUP BY 1"
    q["seasonal_naive"] = f"""WITH {_SERIES}, e AS (SELECT a.y, b.y AS f FROM ser a JOIN ser b ON b.d + 7 = a.d)
SELECT count(*) AS days, round(avg(abs(f - y)), 9) AS mae, round(sqrt(avg((f - y) * (f - y))), 9) AS rmse, round(sum(abs(f - y)) / sum(abs(y)), 9) AS wape, round(avg(CASE WHEN abs(y) + abs(f) > 0 THEN 2 * abs(f - y) / (abs(y) + abs(f)) ELSE 0 END), 9) AS smape, round(avg(f - y), 9) AS bias FROM e"""
    amount = "CAST(coalesce(sum(amount), 0) AS DOUBLE) AS amount"
    rate = "CAST(count(*) FILTER (transaction_status = 'DECLINED') AS DOUBLE) / count(*) AS decline_rate"
    fraud = "CAST(count(*) FILTER (has_fraud_case) AS DOUBLE) / count(*) AS fraud_rate"
    q["measure_kpis"] = f"WITH {_RICH} SELECT count(*) AS payments, {amount}, CAST(sum(amount) AS DOUBLE) / count(amount) AS average, count(DISTINCT customer_id) AS customers, count(DISTINCT merchant_id) AS merchants, {_n("transaction_status = 'DECLINED'")} AS declined, {rate}, {fraud} FROM rich"
    q["measure_by_channel"] = f"WITH {_RICH} SELECT channel, CASE WHEN coalesce(card_present, false) THEN 'PRESENT' ELSE 'NOT_PRESENT' END AS card, count(*) AS payments, count(DISTINCT customer_id) AS customers, {rate} FROM rich WHERE currency = 'AUD' GROUP BY 1, 2"
    q["measure_by_day"] = f"WITH {_RICH} SELECT {_DAY}, count(*) AS payments, {amount}, {fraud} FROM rich GROUP BY 1"
    q["measure_model"] = f"WITH {_SCORED} SELECT CASE WHEN score >= 0.8 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band, count(*) AS scored, {_n('label = 1')} AS positives, CAST({_n('label = 1 AND score >= 0.5')} AS DOUBLE) / nullif({_n('score >= 0.5')}, 0) AS precision_at_half, max(score) AS highest FROM sc GROUP BY 1"
    q["latest_definition"] = f"WITH {_ACC} SELECT account_id, account_status, record_version FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY record_version DESC) AS rn FROM alog) WHERE rn = 1 AND NOT is_deleted"
    q["slice_collapse"] = f"WITH {_RUNS} SELECT merchant_id, transaction_id, {ts.format('run_start')} AS run_start, {ts.format('run_end')} AS run_end, active_us, final_state, slices, status FROM runs"
    q["daily_reliability_full_outer"] = f"""WITH {_RUNS}, {_TX}, a AS (SELECT strftime(run_start, '%Y-%m-%d') AS day, count(*) AS runs, {_n("status = 'FAILED'")} AS failed_runs, round(quantile_cont((active_us // 1000000)::DOUBLE, 0.95), 6) AS p95_seconds FROM runs GROUP BY 1),
b AS (SELECT strftime(event_date, '%Y-%m-%d') AS day, count(*) AS transactions FROM tx WHERE event_date IS NOT NULL GROUP BY 1) SELECT coalesce(a.day, b.day) AS day, runs, failed_runs, p95_seconds, transactions FROM a FULL JOIN b ON a.day = b.day"""
    fresh = " UNION ALL ".join(f"SELECT '{t}' AS table_name, max({c}) AS last_at FROM {t}" for t, c in (("payment_events", "kafka_timestamp"), ("payment_transactions_enriched", "bronze_ingested_at"), ("merchant_snapshots", "snapshot_at"), ("merchant_history", "__start_at"), ("documents", "written_at")))
    q["freshness_health"] = f"WITH f AS ({fresh} UNION ALL SELECT 'chargebacks', NULL), g AS (SELECT *, epoch(TIMESTAMP '2026-08-01') - floor(epoch(last_at)) AS age FROM f) SELECT table_name, {ts.format('last_at')} AS last_at, CASE WHEN age IS NULL THEN 'NO_DATA' WHEN age <= 86400 THEN 'RECENT' WHEN age <= 604800 THEN 'AGING' ELSE 'STALE' END AS freshness FROM g"
    q["cost_spikes"] = f"""WITH {_TX}, c AS (SELECT event_date AS d, CAST(sum(amount) FILTER (amount > 0) AS DOUBLE) AS cost FROM tx WHERE event_date IS NOT NULL GROUP BY 1), p AS (SELECT d, cost, avg(cost) OVER (ORDER BY d RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS pm FROM c)
SELECT strftime(d, '%Y-%m-%d') AS event_date, cost, round(pm, 6) AS prior_mean, coalesce(cost > 1 AND cost > 1.2 * pm, false) AS is_spike FROM p"""
    q["alert_candidates"] = f"WITH {_DQ}, a AS (SELECT 'quarantine' AS alert, {_n('len(failed) > 0')} AS alert_count FROM dq UNION ALL SELECT 'declines', {_n("transaction_status = 'DECLINED'")} FROM dq UNION ALL SELECT 'huge_payments', {_n('amount > 1000000')} FROM dq) SELECT *, CASE WHEN alert_count > 0 THEN 'TRIGGERED' ELSE 'OK' END AS state FROM a"
    q["reconciliation_report"] = f"""WITH {_TRUSTED}, {_TX}, n AS (SELECT (SELECT count(*) FROM tx)::DOUBLE AS t, (SELECT count(*) FROM payment_transactions_enriched)::DOUBLE AS r, (SELECT sum(amount) FROM tx)::DOUBLE AS a),
k AS (SELECT 'standardized = validated + quarantined' AS check_name, t AS lhs, t AS rhs FROM n UNION ALL SELECT 'transactions = enriched', t, t FROM n UNION ALL SELECT 'transactions = sum of daily', t, t FROM n UNION ALL SELECT 'amount = daily amount', a, a FROM n UNION ALL SELECT 'raw = distinct', r, t FROM n UNION ALL SELECT 'trusted events are unique', 0, 0)
SELECT check_name, round(lhs, 2) AS lhs, round(rhs, 2) AS rhs, CASE WHEN abs(lhs - rhs) < 0.005 THEN 'PASS' ELSE 'FAIL' END AS status FROM k"""
    q["physical_profile"] = f"WITH {_EV} SELECT count(*) AS physical_rows, count(DISTINCT event_id) AS distinct_keys, count(*) - count(DISTINCT event_id) AS surplus_rows FROM ev"
    raw = f"SELECT {_ident('customer_id')} AS customer_id, trim(last_name) AS last_name, lower(trim(email)) AS email, date_of_birth, upper(trim(country)) AS country, record_version FROM master_data_cdc"
    hide = "CASE WHEN last_name IS NOT NULL THEN '***MASKED***' END"
    q["masked_customers"] = f"WITH c AS ({raw}) SELECT customer_id, {hide} AS last_name, CASE WHEN email IS NULL THEN NULL WHEN instr(email, '@') > 1 THEN '***@' || split_part(email, '@', -1) ELSE '***MASKED***' END AS email, strftime(date_trunc('year', date_of_birth), '%Y-%m-%d') AS date_of_birth, country, record_version FROM c"
    q["au_row_filter"] = f"WITH c AS ({raw}) SELECT customer_id, last_name, country, record_version FROM c WHERE country = 'AU'"
    q["tag_coverage"] = """SELECT * FROM (VALUES ('customer_id', NULL, NULL, 'internal', false), ('last_name', 'name', NULL, NULL, false), ('email', 'email', NULL, NULL, false), ('date_of_birth', 'birth', NULL, NULL, false), ('country', NULL, 'country', NULL, false), ('record_version', NULL, NULL, NULL, false)) t(column_name, pii, region_key, classification, is_covered)"""
    q["transaction_context"] = f"WITH {_TX} SELECT transaction_id, CAST(amount AS DOUBLE) AS amount, transaction_status FROM tx WHERE transaction_id = 'txn-00000020'"
    words = "unnest(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"
    q["keyword_topk"] = f"""WITH qs AS (SELECT lang AS id, min(sample_text) AS text FROM lang_samples GROUP BY 1), qt AS (SELECT DISTINCT id, {words.format('text')} AS term FROM qs),
po AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, {words.format('"text"')} AS term FROM documents WHERE "text" IS NOT NULL) GROUP BY ALL), dl AS (SELECT id, sum(tf) AS dl FROM po GROUP BY 1), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
s AS (SELECT qt.id AS query_id, po.id AS doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN po USING (term) JOIN df USING (term) JOIN dl ON dl.id = po.id, st GROUP BY ALL)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3"""
    q["retrieval_topk"] = f"WITH {_VEC} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"
    q["retrieval_metrics"] = f"""WITH {_VEC}, h AS (SELECT query_id, min(rank) FILTER (ql = dl) AS k FROM r WHERE rank <= 3 GROUP BY 1) SELECT count(*) AS queries, round(avg(coalesce(k = 1, false)::INT), 9) AS hit_at_1, round(avg(coalesce(k <= 3, false)::INT), 9) AS recall_at_k, round(avg(coalesce(1.0::DOUBLE / k, 0)), 9) AS mrr, 0.0::DOUBLE AS empty_rate FROM h"""
    q["hybrid_fusion"] = f"""WITH po AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, {words.format('"text"')} AS term FROM documents WHERE "text" IS NOT NULL) GROUP BY ALL), dl AS (SELECT id, sum(tf) AS dl FROM po GROUP BY 1), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
w AS (SELECT a.id AS query_id, po.id AS doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * po.tf * 2.2 / (po.tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM po a JOIN po USING (term) JOIN df USING (term) JOIN dl ON dl.id = po.id, st WHERE a.id % 20 = 0 AND a.id <> po.id GROUP BY ALL),
v AS (SELECT id, ('0x' || substr(md5(term), 1, 4))::INTEGER % 64 AS place, sum(tf)::DOUBLE AS x FROM po GROUP BY ALL), nrm AS (SELECT id, sqrt(sum(x * x)) AS len FROM v GROUP BY 1),
c0 AS (SELECT a.id AS query_id, b.id AS doc_id, sum(a.x * b.x) AS dot FROM v a JOIN v b USING (place) WHERE a.id % 20 = 0 AND a.id <> b.id GROUP BY ALL),
c1 AS (SELECT a.id AS query_id, b.id AS doc_id, round(coalesce(dot, 0) / (a.len * b.len), 6) AS score FROM nrm a JOIN nrm b ON a.id <> b.id AND a.id % 20 = 0 LEFT JOIN c0 ON c0.query_id = a.id AND c0.doc_id = b.id),
r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM w QUALIFY rank <= 10 UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c1 QUALIFY rank <= 10),
s AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM r GROUP BY ALL)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3"""
    q["agent_case_scores"] = f"WITH {_CASES} SELECT transaction_id, tool_selection, tool_efficiency, structure, safety, round(overall, 6) AS overall, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS case_pass FROM s3"
    q["agent_run_summary"] = f"""WITH {_CASES}, m AS (SELECT 'run-1' AS run_id, count(*) AS cases, avg((len(reasons) = 0)::INT) AS pr, avg(tool_selection) AS ts, avg(safety) AS sa FROM s3),
g AS (SELECT *, list_filter([CASE WHEN pr >= 0.85 THEN NULL ELSE 'pass_rate' END, CASE WHEN ts >= 0.9 THEN NULL ELSE 'mean_tool_selection' END, CASE WHEN sa >= 1 THEN NULL ELSE 'mean_safety' END], lambda x: x IS NOT NULL) AS failed FROM m)
SELECT run_id, cases, round(pr, 9) AS pass_rate, round(ts, 9) AS mean_tool_selection, round(sa, 9) AS mean_safety, array_to_string(failed, ',') AS failed_gates, len(failed) = 0 AS overall_pass FROM g"""
    q["payment_events_stream"] = f"WITH {_EV} SELECT DISTINCT event_id FROM ev WHERE event_id IS NOT NULL AND event_timestamp IS NOT NULL"
    q["cdc_stream"] = q["scd1_current"]
    q["load_once"] = f"WITH {_TX} SELECT transaction_status AS status, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS amount_sum, true AS loaded_first, 0 AS loaded_again FROM tx WHERE event_date IS NOT NULL GROUP BY 1"
    q["dataset_graph"] = f"WITH {_DQ} SELECT {_DAY}, currency, count(*) AS payments, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS amount_sum FROM dq WHERE len(failed) = 0 GROUP BY event_date, currency"
    q["scoped_audit"] = """WITH sc AS (SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE event_type = 'error')
SELECT event_type, count(*) AS entries, count(DISTINCT coalesce(CASE WHEN value > 50 THEN 'svc-' || user_id END, CAST(user_id AS VARCHAR), 'unknown')) AS actors FROM events WHERE user_id IN (SELECT user_id FROM sc) OR CAST(user_id AS VARCHAR) = '0' GROUP BY 1"""
    q["operations_summary"] = f"""WITH {_TX}, {_EV}, d AS (SELECT event_id, count(*) AS n, CAST(count(DISTINCT kafka_offset) AS INTEGER) AS o FROM ev WHERE event_id IS NOT NULL GROUP BY 1),
m AS (SELECT * FROM (SELECT {_code('risk_rating')} AS rr, row_number() OVER (PARTITION BY {_ident('merchant_id')} ORDER BY snapshot_at DESC, record_version DESC) AS rn FROM merchant_snapshots WHERE merchant_id IS NOT NULL) WHERE rn = 1)
SELECT (SELECT count(*) FROM tx) AS transactions, (SELECT count(*) FROM tx WHERE transaction_status = 'DECLINED') AS declined, (SELECT count(*) FROM tx WHERE amount IS NULL OR amount <= 0) AS bad_amounts, (SELECT count(*) FROM d WHERE n > 1) AS repeated_events, (SELECT max(n) FROM d) AS most_deliveries, (SELECT max(o) FROM d) AS most_offsets, (SELECT count(*) FROM m WHERE rr = 'HIGH') AS high_risk_merchants"""
    sources = " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS rows FROM {t}" for t in ("payment_events", "payment_transactions_enriched", "master_data_cdc", "accounts", "merchant_history", "merchant_snapshots", "documents"))
    q["source_readiness"] = f"WITH s AS ({sources}) SELECT *, CASE WHEN rows = 0 THEN 'EMPTY' WHEN rows < 1000 THEN 'SMALL' ELSE 'READY' END AS status FROM s"
    q["model_health"] = f"""WITH {_TX}, r AS (SELECT max(event_timestamp) AS at, arg_max(transaction_id, (event_timestamp, transaction_id)) AS t, avg(CASE WHEN transaction_status = 'DECLINED' THEN 1.0::DOUBLE ELSE 0 END) AS d FROM tx WHERE event_timestamp IS NOT NULL)
SELECT {ts.format('at')} AS last_at, t AS last_transaction, round(d, 9) AS decline_rate, CASE WHEN epoch(TIMESTAMP '2026-08-01') - floor(epoch(at)) <= 86400 THEN 'RECENT' WHEN epoch(TIMESTAMP '2026-08-01') - floor(epoch(at)) <= 604800 THEN 'AGING' ELSE 'STALE' END AS freshness FROM r""".replace(" AS at,", " AS ats,").replace("(at)", "(ats)").replace("strftime(at,", "strftime(ats,")
    q["golden_cases"] = f"""WITH {_TX}, {_EV}, r AS (SELECT transaction_id, amount, country FROM tx WHERE amount IS NOT NULL), d AS (SELECT transaction_id, count(*) AS n FROM ev WHERE transaction_id IS NOT NULL GROUP BY 1 HAVING count(*) > 2),
u AS ((SELECT 'greatest' AS case_kind, transaction_id, amount FROM r ORDER BY amount DESC, transaction_id LIMIT 3) UNION ALL (SELECT 'least', transaction_id, amount FROM r ORDER BY amount, transaction_id LIMIT 3) UNION ALL (SELECT 'abroad', transaction_id, amount FROM r WHERE country <> 'AU' ORDER BY amount DESC, transaction_id LIMIT 2)
 UNION ALL (SELECT 'nearest_100', transaction_id, amount FROM r ORDER BY abs(amount - 100), transaction_id LIMIT 1) UNION ALL (SELECT 'repeated', r.transaction_id, r.amount FROM d JOIN r ON r.transaction_id = d.transaction_id ORDER BY d.n DESC, r.transaction_id LIMIT 2))
SELECT case_kind, transaction_id, CAST(amount AS DOUBLE) AS amount FROM u"""
    q["promotion_gates"] = f"""WITH a AS ({q['score_areas']}), w AS ({q['seasonal_naive']}), b AS (WITH {_SCORED} SELECT avg(label) AS base_rate FROM sc),
g AS (SELECT list_filter([CASE WHEN average_precision >= base_rate THEN NULL ELSE 'average_precision_above_base_rate' END, CASE WHEN roc_auc > 0.9 THEN NULL ELSE 'roc_auc_above_0.9' END, CASE WHEN wape <= 1 THEN NULL ELSE 'wape_at_most_1' END], lambda x: x IS NOT NULL) AS f FROM a, w, b) SELECT array_to_string(f, ',') AS failed_gates, len(f) = 0 AS passed FROM g"""
    q["measure_agents"] = f"WITH {_CASES} SELECT len(reasons) = 0 AS passed, count(*) AS cases, CAST(count(*) FILTER (len(reasons) = 0) AS DOUBLE) / count(*) AS pass_rate, {_n('safety = 1')} AS safe, CAST(max(len(tools)) AS INTEGER) AS most_calls, CAST(sum(len(tools)) AS BIGINT) AS tools FROM s3 JOIN tl USING (transaction_id) GROUP BY 1"
    price = """pr AS (SELECT n_nationkey % 10 AS sku, 1990 + (n_nationkey // 10) * 4 AS y FROM nation), pp AS (SELECT sku, make_timestamp(y, 1, 1, 0, 0, 0) AS s, CASE WHEN y < 1998 THEN make_timestamp(y + 4, 1, 1, 0, 0, 0) END AS e, (sku + 1) * (y - 1988) AS price FROM pr)"""
    q["cost_by_sku"] = f"""WITH {_USAGE}, {price}, j AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, us.sku, sum(q * price) AS cost FROM us JOIN pp ON pp.sku = us.sku AND s <= l_shipdate AND (e IS NULL OR l_shipdate < e) GROUP BY ALL)
SELECT month, sku, CAST(cost AS DOUBLE) AS cost, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY cost DESC, sku) AS rank FROM j) WHERE rank <= 3"""
    q["price_overlap"] = f"WITH {_USAGE}, {price} SELECT us.sku, count(*) AS rows, {_n('price IS NULL')} AS unpriced, CAST(max(price) AS DOUBLE) AS highest FROM us LEFT JOIN pp ON pp.sku = us.sku AND s <= l_shipdate AND (e IS NULL OR l_shipdate < e) GROUP BY 1"
    q["rag_context"] = f"""WITH k AS ({q['keyword_topk']}),
j AS (SELECT query_id, string_agg('[SOURCE ' || k.doc_id || ']' || chr(10) || d."text", chr(10) || chr(10) ORDER BY rank) AS context, list_sort(list(CAST(k.doc_id AS VARCHAR))) AS docs FROM k JOIN documents d ON d.doc_id = k.doc_id GROUP BY 1),
a AS (SELECT *, 'see [SOURCE ' || docs[1] || '] and [SOURCE ' || docs[-1] || ']' AS answer FROM j),
c AS (SELECT *, list_distinct(regexp_extract_all(answer, '\\[SOURCE ([^\\]]+)\\]', 1)) AS c1, list_distinct(regexp_extract_all(answer || ' [SOURCE none]', '\\[SOURCE ([^\\]]+)\\]', 1)) AS c2, regexp_extract_all('no source', '\\[SOURCE ([^\\]]+)\\]', 1) AS c3 FROM a)
SELECT query_id, CAST(length(context) AS INTEGER) AS context_length, md5(context) AS context_hash, len(c1) > 0 AND list_has_all(docs, c1) AS valid, len(c2) > 0 AND list_has_all(docs, c2) AS with_foreign, len(c3) > 0 AND list_has_all(docs, c3) AS without_any FROM c"""
    q["rag_passages"] = f"""WITH k AS ({q['keyword_topk']}), j AS (SELECT query_id, string_agg('[SOURCE ' || k.doc_id || ']' || chr(10) || d."text", chr(10) || chr(10) ORDER BY rank) AS context FROM k JOIN documents d ON d.doc_id = k.doc_id GROUP BY 1) SELECT query_id, context, CAST(length(context) AS INTEGER) AS context_length, sha256(context) AS context_hash FROM j"""
    q["keyword_search"] = f"""WITH po AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, {words.format('"text"')} AS term FROM documents WHERE "text" IS NOT NULL) GROUP BY ALL), dl AS (SELECT id, sum(tf) AS dl FROM po GROUP BY 1), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
w AS (SELECT a.id AS query_id, po.id AS doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * po.tf * 2.2 / (po.tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM po a JOIN po USING (term) JOIN df USING (term) JOIN dl ON dl.id = po.id, st WHERE a.id % 20 = 0 AND a.id <> po.id GROUP BY ALL)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM w) WHERE rank <= 3"""
    q["evidence_view"] = f"WITH {_TX}, f AS ({inner('customer_id', 'customer')}) SELECT tx.transaction_id, CAST(tx.amount AS DOUBLE) AS amount, customer_txn_count_1d, customer_txn_count_30d FROM tx LEFT JOIN f ON f.customer_id = tx.customer_id AND f.feature_timestamp = tx.event_timestamp"
    q["quarantine_reasons"] = f"WITH {_DQ} SELECT count(DISTINCT CASE WHEN len(failed) > 0 THEN transaction_id END) AS quarantined_transactions, count(DISTINCT CASE WHEN len(failed) > 0 THEN merchant_id END) AS quarantined_merchants, count(DISTINCT CASE WHEN len(failed) = 0 THEN merchant_id END) AS valid_merchants, CAST(max(len(failed)) AS INTEGER) AS most_failures FROM dq"
    q["response_sections"] = f"WITH {_CASES} SELECT t.title, count(*) AS sections, CAST(sum(CASE WHEN t.title = 'Summary' THEN len(tools) ELSE 0 END) AS BIGINT) AS items FROM s3 JOIN tl USING (transaction_id), (VALUES ('Summary'), ('Evidence')) t(title) GROUP BY 1"
    q["score_page"] = f"WITH {_SCORED} SELECT score, label FROM sc ORDER BY score DESC, label NULLS FIRST LIMIT 100"
    q["last_seen"] = f"WITH {_TX}, {_EV}, a AS (SELECT merchant_id, strftime(max(event_timestamp), '%Y-%m-%d') AS last_paid FROM tx WHERE merchant_id IS NOT NULL GROUP BY 1), b AS (SELECT merchant_id, strftime(max(kafka_timestamp), '%Y-%m-%d') AS last_delivered FROM ev WHERE merchant_id IS NOT NULL GROUP BY 1) SELECT coalesce(a.merchant_id, b.merchant_id) AS merchant_id, last_paid, last_delivered FROM a FULL JOIN b ON a.merchant_id = b.merchant_id"
    return q
