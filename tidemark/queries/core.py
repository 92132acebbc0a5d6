"""Queries of the relational core, change data, features, metrics and operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import as_ts, ident, micros, table
from tidemark.operators import cdc, evaluation, features, forecast, governance, joins, merge, metrics, ops, quality, reconcile, retrieval, scoring, standardize
from tidemark.operators import events as trust
from tidemark.queries import base
from tidemark.session import staged
from tidemark.sources import messages

STAMP, DATE = "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"
AS_OF = "2026-08-01 00:00:00"


def _d(c: str) -> Column:
    return F.date_format(c, DATE).alias(c)


def _t(c: str) -> Column:
    return F.date_format(c, STAMP).alias(c)


# Standardisation and decoding


def standardized_events(spark: SparkSession, sf: str) -> DataFrame:
    return base.events(spark, sf).select("event_id", "transaction_id", "event_type", "currency", "channel", "transaction_status", _d("event_date"), _t("event_hour"), "delay_seconds", "kafka_partition", "kafka_offset")


def standardized_customers(spark: SparkSession, sf: str) -> DataFrame:
    return base.customer_changes(spark, sf).select("customer_id", "first_name", "last_name", "email", "state", "country", "risk_rating", "kyc_status", "customer_status", "record_version", "is_deleted")


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return rows.groupBy("event_type").agg(F.count("p.k").alias("parsed"), F.sum("p.k").alias("k_sum"))


def message_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries as messages and back: envelope, key, offset, JSON decode, typed fields."""
    raw = table(spark, sf, "payment_events").filter("transaction_id is not null")
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    tx = F.struct("transaction_id", "account_id", "merchant_id", text(as_ts("event_timestamp")).alias("event_timestamp"), F.col("amount").cast("string").alias("amount"), "currency", "channel", "payment_method", F.col("transaction_status").alias("status"), "card_present", "device_id", "ip_address", "country")
    payload = F.struct("event_id", "event_type", text(as_ts("event_timestamp")).alias("event_timestamp"), "sequence_number", tx.alias("transaction"))
    envelopes = raw.select(F.col("transaction_id").alias("message_key"), text(as_ts("simulated_arrival_at")).alias("simulated_arrival_at"), F.col("delivery_scenario").alias("scenario"), payload.alias("payload"), F.coalesce(as_ts("simulated_arrival_at"), as_ts("kafka_timestamp")).alias("at"))
    decoded = standardize.decode_messages(messages.to_records(envelopes, "payment-events", "message_key", "at"))
    return decoded.groupBy("parse_status", "event_type").agg(F.count(F.lit(1)).alias("messages"), F.count("event_timestamp").alias("timed"), F.count("simulated_arrival_at").alias("arrived"), F.sum("amount").cast("double").alias("amount_sum"))


# Quality


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(base.transactions(spark, sf), quality.transaction_rules())


def dq_classified(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).select("transaction_id", F.array_join("dq_failed_rules", ",").alias("failed_rules"), "is_quarantined", "dq_status")


def dq_rule_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return quality.by_rule(_classified(spark, sf))


def dq_quarantine_daily(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quarantine_daily(_classified(spark, sf), "event_date").select(_d("event_date"), "quarantined_rows", F.col("failed_rules").cast("long").alias("failed_rules"))


def dq_current_health(spark: SparkSession, sf: str) -> DataFrame:
    customers = quality.classify(base.customer_changes(spark, sf), quality.customer_rules()).select(F.lit("customers").alias("dataset"), "is_quarantined")
    tx = _classified(spark, sf).select(F.lit("transactions").alias("dataset"), "is_quarantined")
    return quality.current_health(["transactions", "customers", "chargebacks"], tx.unionByName(customers))


def dq_expectations(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.transactions(spark, sf)
    return quality.expectation_health(quality.expectation_events(rows, quality.transaction_rules(), "transactions", "classify", "update-1", "2026-08-01"))


# Event trust


def duplicate_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = trust.duplicate_summary(base.events(spark, sf))
    return out.select("event_id", "physical_delivery_count", F.array_join("observed_delivery_scenarios", ",").alias("scenarios"), F.array_join(F.transform("observed_kafka_offsets", lambda x: x.cast("string")), ",").alias("offsets"), _t("first_kafka_timestamp"), _t("latest_kafka_timestamp"))


def event_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    out = trust.exceptions(base.events(spark, sf))
    return out.select("event_id", "transaction_id", "delivery_scenario", F.date_format("simulated_arrival_at", "yyyy-MM-dd HH:mm:ss.SSS").alias("arrived"), "physical_delivery_count", "previous_max_sequence_number", F.array_join("exception_types", ",").alias("exceptions"))


def trusted_events_batch(spark: SparkSession, sf: str) -> DataFrame:
    return trust.trusted(base.events(spark, sf)).select("event_id", "kafka_partition", "kafka_offset", "is_late_arrival", "event_arrival_classification")


# Change data


def scd1_current(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.scd1(base.accounts_log(spark, sf), "account_id", "record_version", "is_deleted").select("account_id", "customer_id", "account_type", "account_status", "record_version")


def scd2_history(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.scd2(base.accounts_log(spark, sf), "account_id", "record_version", "is_deleted").select("account_id", "account_status", "__START_AT", "__END_AT")


def cdc_invariant(spark: SparkSession, sf: str) -> DataFrame:
    log = base.customers_log(spark, sf)
    keys = ("customer_id", "record_version", "is_deleted")
    return cdc.invariant(cdc.scd1(log, *keys), cdc.scd2(log, *keys))


def cdc_after_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """First versions as the snapshot; what the feed still adds to it."""
    log = base.accounts_log(spark, sf)
    out = cdc.after_baseline(log, log.filter("record_version = 1"), "account_id", "record_version")
    return out.groupBy("record_version").agg(F.count(F.lit(1)).alias("changes"), F.count_if("is_deleted").alias("deletes"))


# Enrichment and aggregates


def enriched_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return base.enriched(spark, sf).select("transaction_id", "account_id", "customer_id", "merchant_id", F.col("amount").cast("double").alias("amount"), "account_type", "customer_risk_rating", "merchant_name", "merchant_risk_rating", "fraud_outcome", "account_dimension_match", "customer_dimension_match", "merchant_dimension_match", "has_fraud_case")


def daily_payment_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.daily(base.enriched(spark, sf)).withColumn("event_date", F.date_format("event_date", DATE))


def merchant_payment_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.by_merchant(base.enriched(spark, sf))


def channel_payment_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.by_channel(base.enriched(spark, sf)).withColumn("event_date", F.date_format("event_date", DATE))


def fraud_operations_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.fraud_operations(base.enriched(spark, sf)).withColumn("event_date", F.date_format("event_date", DATE))


# Joins, sets, merges


def orphans_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Orders without any line item, and what they are worth, by status."""
    out = joins.orphans(table(spark, sf, "orders"), table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey")
    return out.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


def except_all_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Two loads of the transactions: as delivered, and each once."""
    raw = table(spark, sf, "payment_transactions_enriched").select(ident("transaction_id").alias("transaction_id"), F.col("amount").cast("double").alias("amount"))
    once = base.transactions(spark, sf).select("transaction_id", F.col("amount").cast("double").alias("amount"))
    return joins.differences(raw, once)


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.create_map(F.lit("N"), F.lit("ORIGINAL"), F.lit("A"), F.lit("RESTATEMENT"), F.lit("R"), F.lit("RETRACTION")), F.col("l_returnflag"))
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", kind.alias("record_type"), signed.cast("decimal(18,2)").alias("quantity"), (F.col("l_suppkey") % 10).alias("sku"))


def _prices(spark: SparkSession, sf: str) -> DataFrame:
    """List prices of ten products, each changed every January, the last one open."""
    years = table(spark, sf, "nation").select((F.col("n_nationkey") % 10).alias("price_sku"), (F.lit(1990) + F.floor(F.col("n_nationkey") / 10) * 4).cast("int").alias("y"))
    start = F.make_date("y", F.lit(1), F.lit(1)).cast("timestamp_ntz")
    end = F.when(F.col("y") < 1998, F.make_date(F.col("y") + 4, F.lit(1), F.lit(1)).cast("timestamp_ntz"))
    return years.select("price_sku", start.alias("price_start"), end.alias("price_end"), ((F.col("price_sku") + 1) * (F.col("y") - 1988)).cast("decimal(18,2)").alias("list_price"))


def temporal_price_cost(spark: SparkSession, sf: str) -> DataFrame:
    use = _usage(spark, sf).groupBy("sku", "record_type", "l_shipdate").agg(F.sum("quantity").cast("decimal(18,2)").alias("quantity"))
    priced = ops.priced_usage(use, _prices(spark, sf), {"sku": "price_sku"}, "l_shipdate", "price_start", "price_end", ["sku", "record_type", "l_shipdate"], "quantity", "list_price")
    out = ops.signed_cost(priced, ["sku", "record_type"])
    return out.select("sku", "record_type", F.col("quantity").cast("double").alias("quantity"), F.col("list_cost").cast("double").alias("list_cost"))


def top_workloads_per_group(spark: SparkSession, sf: str) -> DataFrame:
    cost = _usage(spark, sf).groupBy("record_type", "l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("cost"))
    return ops.top_per_group(cost, ["record_type"], [F.col("cost").desc(), F.col("l_suppkey").asc()], 5).withColumn("cost", F.col("cost").cast("double"))


def merge_change_only(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of the first version merged with the current state: only changed rows get a new stamp."""
    log = base.customers_log(spark, sf)
    cols = ["customer_id", "risk_rating", "customer_status"]
    target = log.filter("record_version = 1 and not is_deleted").select(*cols, F.lit("t0").alias("updated_at"))
    source = cdc.scd1(log, "customer_id", "record_version", "is_deleted").select(*cols)
    return merge.merge(target, source, ["customer_id"], only_changed=True, delete_missing=True, stamp={"updated_at": F.lit("t1")})


def merge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Upsert that keeps when a row was created and resets when it was updated."""
    log = base.accounts_log(spark, sf)
    cols = ["account_id", "account_status"]
    target = log.filter("record_version = 1").select(*cols, F.lit("c0").alias("created_at"), F.lit("u0").alias("updated_at"))
    source = log.filter("record_version = 2").select(*cols, F.lit("c1").alias("created_at"), F.lit("u1").alias("updated_at"))
    return merge.merge(target, source, ["account_id"], keep=["created_at"])


# Features, labels, splits, scores


def transaction_features(spark: SparkSession, sf: str) -> DataFrame:
    out = features.transaction_features(base.transactions(spark, sf)).withColumn("amount_log1p", F.round("amount_log1p", 9))
    return out.withColumn("transaction_event_timestamp", F.date_format("transaction_event_timestamp", STAMP))


def _behaviour(spark: SparkSession, sf: str, entity: str, prefix: str) -> DataFrame:
    return features.behaviour(base.transactions(spark, sf), entity, prefix)


def behavior_features_customer(spark: SparkSession, sf: str) -> DataFrame:
    return _behaviour(spark, sf, "customer_id", "customer").withColumn("feature_timestamp", F.date_format("feature_timestamp", "yyyy-MM-dd HH:mm:ss.SSS"))


def behavior_features_merchant(spark: SparkSession, sf: str) -> DataFrame:
    return _behaviour(spark, sf, "merchant_id", "merchant").withColumn("feature_timestamp", F.date_format("feature_timestamp", "yyyy-MM-dd HH:mm:ss.SSS"))


def asof_training_set(spark: SparkSession, sf: str) -> DataFrame:
    # Stored once: labels, own features and the behaviour of both entities read them.
    tx = staged(base.transactions(spark, sf), "transactions")
    rich = base.enriched(spark, sf, tx)
    labels = features.label_transactions(rich.select("transaction_id", "customer_id", "merchant_id", "event_timestamp", "fraud_outcome"))
    out = features.training_set(labels, features.transaction_features(tx), features.behaviour(tx, "customer_id", "customer"), features.behaviour(tx, "merchant_id", "merchant"))
    return out.select("transaction_id", "is_confirmed_fraud", "amount", "hour_of_day", "customer_txn_count_7d", "customer_amount_sum_7d", "merchant_txn_count_30d", "merchant_decline_rate_30d")


def temporal_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.transactions(spark, sf).filter("event_timestamp is not null").select("transaction_id", "event_timestamp")
    return features.temporal_split(rows, "event_timestamp", "transaction_id").select("transaction_id", "split")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scores with ties: the amount in steps, against whether the payment was declined."""
    rows = base.transactions(spark, sf).filter("amount is not null")
    return rows.select((F.least(F.greatest(F.floor(F.col("amount") / 10), F.lit(0)), F.lit(100)) / F.lit(100.0)).alias("score"), (F.col("transaction_status") == "DECLINED").cast("int").alias("label"))


def threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.at_thresholds(_scored(spark, sf), "score", "label", scoring.THRESHOLDS)


def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.best_threshold(threshold_metrics(spark, sf)).select("threshold", "tp", "fp", "fn", "tn")


def score_areas(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.areas(scoring.curve(_scored(spark, sf), "score", "label"))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


# Forecasting


def _series(spark: SparkSession, sf: str) -> DataFrame:
    counted = base.transactions(spark, sf).filter("event_date is not null").select("event_date", F.lit(1).alias("one"))
    return forecast.daily_series(counted, "event_date", "one")


def daily_series_features(spark: SparkSession, sf: str) -> DataFrame:
    out = forecast.series_features(_series(spark, sf))
    keep = ["y", "day_of_week", "is_weekend", "lag_1", "lag_2", "lag_3", "lag_7"]
    return out.select(F.date_format("d", DATE).alias("d"), *keep, *[F.round(c, 6).alias(c) for c in ("dow_sin", "dow_cos", "rolling_mean_3", "rolling_mean_7", "rolling_std_3", "rolling_std_7")])


def forecast_holdouts(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.holdouts(_series(spark, sf), 7).groupBy("split").agg(F.count(F.lit(1)).alias("days"), F.sum("y").alias("payments"))


def seasonal_naive(spark: SparkSession, sf: str) -> DataFrame:
    out = forecast.errors(forecast.seasonal_naive(_series(spark, sf)))
    return out.select("days", *[F.round(c, 9).alias(c) for c in ("mae", "rmse", "wape", "smape", "bias")])


# Metric layer


def payment_view(spark: SparkSession, sf: str) -> metrics.MetricView:
    n = F.count(F.lit(1))
    return metrics.MetricView(
        base.enriched(spark, sf),
        {"event_date": F.date_format("event_date", DATE), "currency": "currency", "channel": "channel", "payment_method": "payment_method", "status": "transaction_status", "country": "country", "merchant_name": "merchant_name", "merchant_risk": "merchant_risk_rating", "customer_risk": "customer_risk_rating", "card": F.when(F.coalesce("card_present", F.lit(False)), "PRESENT").otherwise("NOT_PRESENT")},
        {"payments": n, "amount": metrics.total("amount"), "average": metrics.mean("amount"), "customers": F.count_distinct("customer_id"), "merchants": F.count_distinct("merchant_id"), "declined": metrics.status_is("DECLINED"), "decline_rate": metrics.ratio(metrics.status_is("DECLINED"), n), "fraud_rate": metrics.ratio(F.count_if("has_fraud_case"), n)},
    )


def measure_kpis(spark: SparkSession, sf: str) -> DataFrame:
    view = payment_view(spark, sf)
    return view.query([], list(view.measures))


def measure_by_channel(spark: SparkSession, sf: str) -> DataFrame:
    return payment_view(spark, sf).sql("SELECT channel, card, MEASURE(payments) AS payments, MEASURE(customers) AS customers, MEASURE(decline_rate) AS decline_rate FROM payment_operations WHERE currency = 'AUD' GROUP BY channel, card ORDER BY payments DESC")


def measure_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return payment_view(spark, sf).query(["event_date"], ["payments", "amount", "fraud_rate"], order=["event_date"])


def measure_model(spark: SparkSession, sf: str) -> DataFrame:
    """Score measures by risk band."""
    risk = standardize.band(F.col("score"), [(0.80, "HIGH"), (0.50, "MEDIUM")], "LOW")
    y = F.col("label") == 1
    view = metrics.MetricView(_scored(spark, sf), {"risk_band": risk}, {"scored": F.count(F.lit(1)), "positives": F.count_if(y), "precision_at_half": metrics.ratio(F.count_if(y & (F.col("score") >= 0.5)), F.count_if(F.col("score") >= 0.5)), "highest": F.max("score")})
    return view.query(["risk_band"], list(view.measures), order=["risk_band"])


# Operations


def latest_definition(spark: SparkSession, sf: str) -> DataFrame:
    """Account versions as definitions: ranked first, deleted ones dropped after."""
    rows = base.accounts_log(spark, sf).withColumn("delete_time", F.when(F.col("is_deleted"), F.col("source_updated_at")))
    return cdc.latest_definition(rows, ["account_id"], "record_version", "delete_time").select("account_id", "account_status", "record_version")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries of a transaction as slices of a run."""
    slices = trust.trusted(base.events(spark, sf)).filter("transaction_id is not null and event_timestamp is not null")
    slices = slices.withColumn("end_at", F.greatest(trust.delivery_time(), "event_timestamp"))
    return ops.collapse_slices(slices, ["merchant_id", "transaction_id"], "event_timestamp", "end_at", "transaction_status").withColumn("status", ops.run_status())


def slice_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).select("merchant_id", "transaction_id", _t("run_start"), _t("run_end"), "active_us", "final_state", "slices", "status")


def daily_reliability_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf).withColumns({"day": F.date_format("run_start", DATE), "seconds": F.expr("cast(active_us div 1000000 as bigint)")})
    a = ops.daily_reliability(runs, "day", "seconds", F.col("status") == "FAILED").withColumn("p95_seconds", F.round("p95_seconds", 6))
    tasks = base.transactions(spark, sf).filter("event_date is not null").groupBy(F.date_format("event_date", DATE).alias("day")).agg(F.count(F.lit(1)).alias("transactions"))
    return joins.merged_days(a, tasks, ["day"])


def freshness_health(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("payment_events", "kafka_timestamp"), ("payment_transactions_enriched", "bronze_ingested_at"), ("merchant_snapshots", "snapshot_at"), ("merchant_history", "__start_at"), ("documents", "written_at")]
    rows = None
    for name, at in parts:
        one = table(spark, sf, name).agg(F.max(as_ts(at)).alias("last_at")).select(F.lit(name).alias("table_name"), "last_at")
        rows = one if rows is None else rows.unionByName(one)
    never = spark.range(1).select(F.lit("chargebacks").alias("table_name"), F.lit(None).cast("timestamp").alias("last_at"))
    return ops.freshness(rows.unionByName(never), "last_at", AS_OF).select("table_name", _t("last_at"), "freshness")


def cost_spikes(spark: SparkSession, sf: str) -> DataFrame:
    cost = base.transactions(spark, sf).filter("event_date is not null").groupBy("event_date").agg(F.sum(F.when(F.col("amount") > 0, F.col("amount"))).cast("double").alias("cost"))
    return ops.cost_spike(cost, "event_date", "cost", 1.2).select(_d("event_date"), "cost", F.round("prior_mean", 6).alias("prior_mean"), "is_spike")


def alert_candidates(spark: SparkSession, sf: str) -> DataFrame:
    one = _classified(spark, sf).agg(F.count_if("is_quarantined").alias("quarantined"), F.count_if(F.col("transaction_status") == "DECLINED").alias("declined"), F.count_if(F.col("amount") > 1_000_000).alias("huge"))
    return ops.alerts(one, {"quarantine": F.col("quarantined"), "declines": F.col("declined"), "huge_payments": F.col("huge")})


# Reconciliation


def reconciliation_report(spark: SparkSession, sf: str) -> DataFrame:
    raw, tx, rich = table(spark, sf, "payment_transactions_enriched"), base.transactions(spark, sf), base.enriched(spark, sf)
    valid, bad = quality.split(_classified(spark, sf))
    daily, ev = metrics.daily(rich), trust.trusted(base.events(spark, sf))
    out = reconcile.report([
        reconcile.check("standardized = validated + quarantined", tx, valid.select("transaction_id").unionByName(bad.select("transaction_id"))),
        reconcile.check("transactions = enriched", tx, rich), reconcile.check("transactions = sum of daily", tx, daily, rhs=F.sum("transaction_count")),
        reconcile.check("amount = daily amount", tx, daily, F.sum("amount"), F.sum("total_payment_amount")), reconcile.check("raw = distinct", raw, tx), reconcile.unique("trusted events are unique", ev, ["event_id"]),
    ])
    return out.withColumns({c: F.round(c, 2) for c in ("lhs", "rhs")})


def physical_profile(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.profile(base.events(spark, sf), "event_id")


# Governance

_TAGS = {"email": {"pii": "email"}, "date_of_birth": {"pii": "birth"}, "last_name": {"pii": "name"}, "country": {"region_key": "country"}, "customer_id": {"classification": "internal"}}
_MASKS = [governance.Policy("pii", "email", "email", frozenset({"privacy"})), governance.Policy("pii", "birth", "birth", frozenset({"privacy"})), governance.Policy("pii", "name", "string", frozenset({"privacy", "support"}))]


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.customer_changes(spark, sf).select("customer_id", "last_name", "email", "date_of_birth", "country", "record_version")
    return governance.tag_columns(rows, _TAGS)


def masked_customers(spark: SparkSession, sf: str) -> DataFrame:
    return governance.secured(_tagged(spark, sf), {"analysts"}, _MASKS).withColumn("date_of_birth", F.date_format("date_of_birth", DATE))


def au_row_filter(spark: SparkSession, sf: str) -> DataFrame:
    only_au = [governance.RowFilter("region_key", "au_analysts", "AU")]
    seen = governance.secured(_tagged(spark, sf), {"au_analysts", "support"}, _MASKS, only_au)
    return seen.select("customer_id", "last_name", "country", "record_version")


def tag_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return governance.tag_coverage(_tagged(spark, sf), ["pii", "region_key", "classification"])


def transaction_context(spark: SparkSession, sf: str) -> DataFrame:
    """The governed table function, called for one transaction."""
    base.transactions(spark, sf).createOrReplaceTempView("tm_transactions")
    governance.table_function(spark, "get_transaction_context", "transaction_id", "tm_transactions", {"transaction_id": "STRING", "amount": "DECIMAL(18,2)", "transaction_status": "STRING"})
    found = governance.read_only(spark, f"SELECT * FROM get_transaction_context('{governance.transaction_id('txn-00000020')}')")
    return found.withColumn("amount", F.col("amount").cast("double"))


# Retrieval


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.chunks(table(spark, sf, "documents"), "doc_id", "text")


def _keyword(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Reference sentences as questions, one per language, against all documents."""
    asked = table(spark, sf, "lang_samples").groupBy("lang").agg(F.min("sample_text").alias("text")).select(F.col("lang").alias("id"), "text")
    corpus = table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "text")
    scored = retrieval.bm25(asked, corpus).withColumn("score", F.round("score", 6))
    return retrieval.top_k(scored, k)


def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _keyword(spark, sf, 3).select("query_id", "doc_id", "rank")


def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth document as a question against all other documents; ``keyword_topk`` asks one sentence per language."""
    rows = table(spark, sf, "documents").filter("text is not null and doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    return retrieval.bm25_top_k(rows.filter("id % 20 = 0"), rows, 3).select("query_id", "doc_id", "rank")


def _vector(spark: SparkSession, sf: str, k: int) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return retrieval.cosine_top_k(rows.filter("id % 20 = 0"), rows, k)


def retrieval_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _vector(spark, sf, 3).select("query_id", "doc_id", "rank")


def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the label of the query counts as expected."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    ranked = _vector(spark, sf, 3)
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    right = ranked.join(asked, "query_id").join(rows.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("l2")), "doc_id").filter("label = l2").select("query_id", "doc_id")
    expected = right.unionByName(asked.join(right, "query_id", "left_anti").select("query_id", F.lit(-1).cast("long").alias("doc_id")))
    out = retrieval.retrieval_metrics(ranked, expected)
    return out.select("queries", *[F.round(c, 9).alias(c) for c in ("hit_at_1", "recall_at_k", "mrr", "empty_rate")])


def hybrid_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword and vector rankings of the same documents, fused by reciprocal ranks.

    Vectors are hashed word counts.  Every twentieth document asks, against all others.
    """
    texts = table(spark, sf, "documents").filter("text is not null and doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    by_words = retrieval.bm25_top_k(texts.filter("id % 20 = 0"), texts, 10)
    vectors = retrieval.hashed_vectors(texts)
    by_vector = retrieval.cosine_top_k(vectors.filter("id % 20 = 0"), vectors, 10, digits=6)
    return retrieval.fuse([by_words, by_vector], 3).select("query_id", "doc_id", "rank")


# Agent runs

_NAMES = ("AUTHORIZATION", "SETTLEMENT", "DECLINE", "REVERSAL", "REFUND")


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """The events of a transaction as the tool calls of a case."""
    kept = trust.trusted(base.events(spark, sf)).filter("transaction_id is not null and sequence_number is not null and event_type is not null")
    calls = F.transform(F.sort_array(F.collect_list(F.struct("sequence_number", "event_type"))), lambda x: x["event_type"])
    rows = kept.groupBy("transaction_id").agg(calls.alias("tools"))
    lit = lambda *v: F.array(*[F.lit(x) for x in v])
    made = rows.withColumns({
        "tool_selection": evaluation.tool_selection(F.col("tools"), lit("AUTHORIZATION", "SETTLEMENT"), lit(*_NAMES), lit("REFUND")), "tool_efficiency": evaluation.efficiency(F.col("tools"), F.lit(1)),
        "answer": F.concat(F.lit("## Summary\n- "), F.array_join("tools", "\n- "), F.lit("\n## Evidence")),
    })
    made = made.withColumns({"structure": evaluation.headings(F.col("answer"), ["Summary", "Evidence", "Risk", "Decision"]), "safety": evaluation.no_match(F.col("answer"), [r"\breversal\b"])})
    made = made.withColumn("overall", evaluation.weighted({"tool_selection": 0.5, "tool_efficiency": 0.25, "structure": 0.15, "safety": 0.1}))
    return evaluation.case_gates(made, {"overall": 0.6, "safety": 1.0})


def agent_case_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).select("transaction_id", "tool_selection", "tool_efficiency", "structure", "safety", F.round("overall", 6).alias("overall"), F.array_join("failure_reasons", ",").alias("reasons"), "case_pass")


def agent_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    cases = _cases(spark, sf).withColumn("run_id", F.lit("run-1"))
    out = evaluation.run_summary(cases, "run_id", ["tool_selection", "safety"], {"pass_rate": 0.85, "mean_tool_selection": 0.9, "mean_safety": 1.0})
    return out.select("run_id", "cases", *[F.round(c, 9).alias(c) for c in ("pass_rate", "mean_tool_selection", "mean_safety")], F.array_join("failed_gates", ",").alias("failed_gates"), "overall_pass")


def queries() -> dict:
    named = (
        standardized_events, standardized_customers, json_props, message_round_trip, dq_classified, dq_rule_breakdown, dq_quarantine_daily, dq_current_health, dq_expectations, duplicate_summary, event_exceptions, trusted_events_batch,
        scd1_current, scd2_history, cdc_invariant, cdc_after_baseline, enriched_transactions, daily_payment_metrics, merchant_payment_metrics, channel_payment_metrics, fraud_operations_metrics, orphans_anti, except_all_diff, temporal_price_cost,
        top_workloads_per_group, merge_change_only, merge_upsert, transaction_features, behavior_features_customer, behavior_features_merchant, asof_training_set, temporal_split, threshold_metrics, best_threshold, score_areas, daily_series_features,
        forecast_holdouts, seasonal_naive, measure_kpis, measure_by_channel, measure_by_day, measure_model, latest_definition, slice_collapse, daily_reliability_full_outer, freshness_health, cost_spikes,
        alert_candidates, reconciliation_report, physical_profile, masked_customers, au_row_filter, tag_coverage, transaction_context, chunk_documents, keyword_topk, keyword_search, retrieval_topk, retrieval_metrics, hybrid_fusion, agent_case_scores, agent_run_summary,
    )
    return {f.__name__: f for f in named}
