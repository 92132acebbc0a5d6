"""SQL for the queries of loading, shapes, rules, change data, the registry and the gates, as DuckDB runs it over the same tables."""

from __future__ import annotations

from tidemark.operators import quality
from tidemark.queries.checks import ANSWER_GATES, HEADINGS, RUN_GATES, WEIGHTS
from tidemark.queries.core_sql import _ACC, _EV, _TX, _ident


def _up(c: str) -> str:
    return f"upper(trim({c}))"


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _failed(rules: dict[str, str]) -> str:
    """A list of the names of the rules that do not hold, in order."""
    return "list_filter([" + ", ".join(f"CASE WHEN coalesce({ok}, false) THEN NULL ELSE '{n}' END" for n, ok in rules.items()) + "], lambda x: x IS NOT NULL)"


def _full(c: str) -> str:
    return f"trim({c}) <> ''"


_CASES = """rc AS (SELECT 'case-' || lpad(CAST(n AS VARCHAR), 8, '0') AS case_id, transaction_id, ets AS opened_at, ['OPEN', 'INVESTIGATING', 'CLOSED'][n % 3 + 1] AS status, ['confirmed_fraud', 'legitimate', 'undetermined', NULL][(n // 20) % 4 + 1] AS outcome
  FROM (SELECT transaction_id, date_trunc('second', event_timestamp) AS ets, CAST(regexp_extract(transaction_id, '(\\d+)$', 1) AS BIGINT) AS n FROM tx) WHERE n % 20 = 0)"""


def sql() -> dict[str, str]:
    from tidemark.queries import core_sql

    core, q = core_sql.sql(), {}
    stamp = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
    q["standardized_transactions"] = f"SELECT {_ident('transaction_id')} AS transaction_id, {_ident('account_id')} AS account_id, {_ident('merchant_id')} AS merchant_id, strftime(event_timestamp, '%Y-%m-%d') AS event_date, {stamp.format("date_trunc('hour', event_timestamp)")} AS event_hour, CAST(amount AS DOUBLE) AS amount, {_up('currency')} AS currency, {_up('channel')} AS channel, {_up('payment_method')} AS payment_method, {_up('transaction_status')} AS transaction_status, card_present, {_up('transaction_country')} AS country FROM payment_transactions_enriched"
    q["standardized_merchants"] = f"SELECT {_ident('merchant_id')} AS merchant_id, trim(merchant_name) AS merchant_name, trim(merchant_category_code) AS merchant_category_code, trim(city) AS merchant_city, {_up('country')} AS merchant_country, {_up('risk_rating')} AS merchant_risk_rating, {_up('status')} AS merchant_status, record_version, coalesce(is_deleted, false) AS is_deleted FROM merchant_snapshots"
    q["csv_load"] = f"WITH {_TX}, {_CASES} SELECT case_id, transaction_id, {stamp.format('opened_at')} AS opened_at, status AS fraud_case_status, 'velocity' AS suspected_reason, upper(outcome) AS fraud_outcome, CASE WHEN status = 'CLOSED' THEN {stamp.format('opened_at')} END AS closed_at FROM rc"
    q["csv_lineage"] = f"WITH {_TX}, {_CASES} SELECT count(*) AS rows, count(*) AS with_file, count(*) AS with_load_time FROM rc"
    rules = {
        "event_id_present": _full("event_id"), "transaction_id_present": _full("transaction_id"), "account_id_present": _full("account_id"), "merchant_id_present": _full("merchant_id"), "event_timestamp_present": "event_timestamp IS NOT NULL", "transaction_timestamp_present": "event_timestamp IS NOT NULL",
        "sequence_number_positive": "sequence_number > 0", "amount_positive": "amount > 0", "currency_code_valid": f"regexp_matches({_up('currency')}, '^[A-Z]{{3}}$')", "event_type_valid": f"{_up('event_type')} IN {_in(quality.EVENT_TYPES)}", "channel_valid": f"{_up('channel')} IN {_in(quality.CHANNELS)}",
        "payment_method_valid": f"{_up('payment_method')} IN {_in(quality.METHODS)}", "transaction_status_valid": f"{_up('transaction_status')} IN {_in(quality.STATUSES)}", "country_code_valid": f"regexp_matches({_up('country')}, '^[A-Z]{{2}}$')", "payload_parsed": "true",
    }
    every = {**{n: f"ok AND {ok}" for n, ok in rules.items()}, "kafka_lineage_present": "true"}
    q["dq_events"] = f"""WITH m AS (SELECT *, sequence_number IS DISTINCT FROM 3 AS ok FROM payment_events WHERE transaction_id IS NOT NULL), r AS (SELECT ok, {_failed(every)} AS f FROM m)
SELECT CASE WHEN ok THEN 'PARSED' ELSE 'INVALID_JSON' END AS parse_status, array_to_string(f, ',') AS failed_rules, CASE WHEN len(f) > 0 THEN 'QUARANTINED' ELSE 'VALID' END AS dq_status, count(*) AS rows FROM r GROUP BY ALL"""
    versioned = {"record_version_valid": "record_version > 0", "source_updated_at_present": "source_updated_at IS NOT NULL"}
    acc = {"account_id_present": f"{_ident('account_id')} IS NOT NULL", "customer_id_present": f"{_ident('customer_id')} IS NOT NULL", "account_type_valid": f"{_up('account_type')} IN {_in(quality.ACCOUNT_TYPES)}", "account_currency_valid": f"regexp_matches({_up('currency')}, '^[A-Z]{{3}}$')", "account_status_valid": f"{_up('status')} IN {_in(quality.ACCOUNT_STATES)}", "opened_date_present": "opened_date IS NOT NULL", **versioned}
    mer = {"merchant_id_present": f"{_ident('merchant_id')} IS NOT NULL", "merchant_name_present": _full("merchant_name"), "merchant_category_code_valid": "regexp_matches(trim(merchant_category_code), '^[0-9]{4}$')", "merchant_country_valid": f"regexp_matches({_up('country')}, '^[A-Z]{{2}}$')", "merchant_risk_rating_valid": f"{_up('risk_rating')} IN {_in(quality.RATINGS)}", "merchant_status_valid": f"{_up('status')} IN {_in(quality.HOLDER)}", **versioned}
    cas = {"case_id_present": "true", "transaction_id_present": _full("transaction_id"), "opened_at_present": "opened_at IS NOT NULL", "fraud_case_status_valid": "true", "fraud_outcome_valid": "true", "closed_case_has_closed_at": "status <> 'CLOSED' OR opened_at IS NOT NULL"}
    counted = " UNION ALL ".join(f"SELECT '{n}' AS dataset, unnest({_failed(r)}) AS rule FROM {t}" for n, r, t in (("accounts", acc, "accounts"), ("merchants", mer, "merchant_snapshots"), ("fraud_cases", cas, "rc")))
    q["dq_entities"] = f"WITH {_TX}, {_CASES}, u AS ({counted}) SELECT dataset, rule, count(*) AS failed_rows FROM u GROUP BY ALL"
    q["expect_actions"] = f"WITH {_TX}, c AS (SELECT count(*) AS n, count(*) FILTER (amount > 0) AS good FROM tx) SELECT 'warn' AS action, n AS rows, 'kept' AS result FROM c UNION ALL SELECT 'drop', good, 'kept' FROM c UNION ALL SELECT 'fail', CASE WHEN good = n THEN n ELSE 0 END, CASE WHEN good = n THEN 'kept' ELSE 'failed' END FROM c"
    q["cdc_tombstones"] = f"WITH {_ACC}, l AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY record_version DESC) AS rn FROM alog) SELECT account_id, {stamp.format('source_updated_at')} AS deleted_at FROM l WHERE rn = 1 AND is_deleted AND 1785542400000000 - epoch_us(source_updated_at) <= 45 * 86400 * 1000000::BIGINT"
    q["cdc_seeded"] = core["scd1_current"]
    q["stream_static_baseline"] = f"SELECT record_version, count(*) AS changes, count(*) FILTER (coalesce(is_deleted, false)) AS deletes FROM accounts a WHERE {_ident('account_id')} IS NOT NULL AND record_version IS NOT NULL AND NOT EXISTS (SELECT 1 FROM accounts b WHERE nullif(lower(trim(b.account_id)), '') = nullif(lower(trim(a.account_id)), '') AND b.record_version = 1 AND a.record_version <= 1) GROUP BY 1"
    q["registry_lifecycle"] = "SELECT 'fraud' AS name, CAST(v AS INTEGER) AS version, CASE v WHEN 3 THEN 'Champion' WHEN 2 THEN 'PreviousChampion' WHEN 4 THEN 'Candidate' END AS alias, CASE v WHEN 4 THEN 0.9 ELSE 0.5 + (v - 1) / 10 END::DOUBLE AS average_precision FROM range(1, 5) r(v)"
    q["registry_audit"] = "SELECT CAST(s AS BIGINT) AS step, 'fraud' AS name, CAST(v AS INTEGER) AS version, e AS event, a AS alias FROM (VALUES (1, 1, 'REGISTERED', 'Candidate'), (2, 1, 'PROMOTED', 'Champion'), (3, 2, 'REGISTERED', 'Candidate'), (4, 2, 'PROMOTED', 'Champion'), (4, 1, 'REPLACED', 'PreviousChampion')) t(s, v, e, a)"
    found = f"m AS ({core['retrieval_metrics']})"
    checks = {"hit_at_1": "hit_at_1 >= 0.6", "recall_at_3": "recall_at_k >= 0.8", "mean_reciprocal_rank": "mrr >= 0.65", "empty_retrieval_rate": "empty_rate <= 0"}
    q["retrieval_gates"] = f"WITH {found}, f AS (SELECT queries, {_failed(checks)} AS f FROM m) SELECT queries, array_to_string(f, ',') AS failed_gates, len(f) = 0 AS passed FROM f"
    q["frozen_replay"] = f"WITH k AS ({core['keyword_topk']}) SELECT 'run-1' AS run_id, query_id, CAST(min(rank) FILTER (doc_id = best) AS INTEGER) AS found_at, count(*) AS passages FROM k JOIN (SELECT query_id, doc_id AS best FROM k WHERE rank = 1) USING (query_id) GROUP BY query_id"
    judged = ", ".join(f"avg(CASE WHEN doc_id % {s} = 0 THEN 0.5::DOUBLE ELSE 1 END) AS {n}" for n, s in zip(ANSWER_GATES, (2, 3, 10, 11, 7, 10**9), strict=True))
    full = {**checks, **{n: f"{n} >= {v}" for n, v in ANSWER_GATES.items()}}
    rounded = ", ".join(f"round({n}, 6) AS {n}" for n in ANSWER_GATES)
    q["rag_gates"] = f"WITH {found}, j AS (SELECT {judged} FROM documents WHERE \"text\" IS NOT NULL), f AS (SELECT *, {_failed(full)} AS f FROM m, j) SELECT {rounded}, array_to_string(f, ',') AS failed_gates, CASE WHEN len(f) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM f"
    shares = " + ".join(f"(len(tools) >= {i + 1})::INT" if i in (3, 4) else "1" for i, _ in enumerate(HEADINGS))
    judge = lambda m: f"greatest(0, 1 - (n % {m}) / 20.0::DOUBLE)"
    total = " + ".join(f"{w} * {n}" for n, w in WEIGHTS.items())
    scored = f"""{_EV}, kept AS (SELECT e.*, {_ident('account_id')} AS acct FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(simulated_arrival_at, kafka_timestamp), kafka_timestamp, kafka_partition, kafka_offset) AS rn FROM (SELECT ev.*, p.account_id FROM ev JOIN payment_events p USING (kafka_partition, kafka_offset, kafka_timestamp)) WHERE event_id IS NOT NULL) e WHERE rn = 1 AND transaction_id IS NOT NULL AND sequence_number IS NOT NULL AND event_type IS NOT NULL),
cs AS (SELECT transaction_id, list(struct_pack(s := sequence_number, t := event_type, m := merchant_id, a := acct) ORDER BY sequence_number, event_type, merchant_id NULLS FIRST, acct NULLS FIRST) AS calls, try_cast(nullif(regexp_extract(transaction_id, '(\\d+)$', 1), '') AS BIGINT) AS n FROM kept GROUP BY 1),
ct AS (SELECT *, list_transform(calls, lambda c: c.t) AS tools FROM cs WHERE n IS NOT NULL),
sc AS (SELECT *, CASE WHEN list_contains(tools, 'REFUND') OR len(list_filter(tools, lambda t: t NOT IN {_in(quality.EVENT_TYPES)})) > 0 THEN 0.0::DOUBLE ELSE list_contains(tools, 'AUTHORIZATION')::INT::DOUBLE END AS tool_selection,
 len(list_filter(calls, lambda c: c.m IS NOT DISTINCT FROM calls[1].m))::DOUBLE / len(calls) AS tool_arguments, CASE WHEN len(tools) > len(list_distinct(tools)) THEN 0.0::DOUBLE ELSE greatest(0, 1 - 0.25::DOUBLE * greatest(0, len(tools) - 2)) END AS tool_efficiency,
 (len(list_filter(calls, lambda c: coalesce(c.a, '?') <> coalesce(calls[1].a, '?'))) = 0)::INT::DOUBLE AS scope, list_contains(tools, 'DECLINE')::INT::DOUBLE AS citation, 1.0::DOUBLE AS human_review, (n % 97 <> 0)::INT::DOUBLE AS safety, ({shares}) / {len(HEADINGS)}.0::DOUBLE AS structure,
 {judge(3)} AS groundedness, {judge(5)} AS evidence_completeness, {judge(4)} AS investigation_quality, {judge(2)} AS risk_balance FROM ct),
so AS (SELECT *, least(1.0::DOUBLE, greatest(0, {total})) AS overall FROM sc),
gt AS (SELECT *, {_failed({'overall_below_0.8': 'overall >= 0.8', 'scope_below_1': 'scope >= 1', 'safety_below_1': 'safety >= 1'})} AS reasons FROM so)"""
    names = ("tool_selection", "tool_arguments", "tool_efficiency", "scope", "citation", "human_review", "safety", "structure", "overall")
    q["agent_evaluation"] = f"WITH {scored} SELECT transaction_id, {', '.join(f'round({c}, 6) AS {c}' for c in names)}, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS case_pass FROM gt"
    means = ", ".join("round(avg((len(reasons) = 0)::INT), 9) AS pass_rate" if g == "pass_rate" else f"round(avg({g.removeprefix('mean_')}), 9) AS {g}" for g in RUN_GATES)
    q["agent_run_gates"] = f"WITH {scored}, r AS (SELECT n % 10 AS run_id, count(*) AS cases, {means} FROM gt GROUP BY 1), f AS (SELECT *, {_failed({g: f'{g} >= {v}' for g, v in RUN_GATES.items()})} AS f FROM r) SELECT run_id, cases, {', '.join(f'round({g}, 6) AS {g}' for g in RUN_GATES)}, array_to_string(f, ',') AS failed_gates, len(f) = 0 AS overall_pass FROM f"
    return q
