"""Queries of monitoring, selection and evaluation that combine several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import as_ts, table
from tidemark.operators import evaluation, forecast, governance, joins, metrics, ops, quality, retrieval, scoring
from tidemark.operators import events as trust
from tidemark.queries import base, core

DATE, AS_OF = "yyyy-MM-dd", "2026-08-01 00:00:00"


def scoped_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit rows of the workspaces in scope, or of the account level (user 0), per actor."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.when(F.col("value") > 50, F.concat(F.lit("svc-"), F.col("user_id").cast("string"))).alias("run_as"))
    first = table(spark, sf, "events").filter("event_type = 'purchase'").select("user_id")
    second = table(spark, sf, "events").filter("event_type = 'error'").select("user_id")
    out = ops.in_scope(rows, first.union(second).distinct(), "user_id", "0")
    actor = F.coalesce("run_as", F.col("user_id").cast("string"), F.lit("unknown"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct(actor).alias("actors"))


def operations_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One row of independent scalar figures."""
    base.transactions(spark, sf).createOrReplaceTempView("tm_ops_tx")
    trust.duplicate_summary(base.events(spark, sf)).createOrReplaceTempView("tm_ops_dup")
    base.merchants(spark, sf).createOrReplaceTempView("tm_ops_merchants")
    return spark.sql(
        """SELECT (SELECT count(*) FROM tm_ops_tx) AS transactions, (SELECT count(*) FROM tm_ops_tx WHERE transaction_status = 'DECLINED') AS declined, (SELECT count(*) FROM tm_ops_tx WHERE amount IS NULL OR amount <= 0) AS bad_amounts,
        (SELECT count(*) FROM tm_ops_dup WHERE physical_delivery_count > 1) AS repeated_events, (SELECT max(physical_delivery_count) FROM tm_ops_dup) AS most_deliveries, (SELECT max(size(observed_kafka_offsets)) FROM tm_ops_dup) AS most_offsets,
        (SELECT count(*) FROM tm_ops_merchants WHERE merchant_risk_rating = 'HIGH') AS high_risk_merchants"""
    )


def source_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and readiness of seven sources."""
    names = ["payment_events", "payment_transactions_enriched", "master_data_cdc", "accounts", "merchant_history", "merchant_snapshots", "documents"]
    out = None
    for n in names:
        one = table(spark, sf, n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("source"), "rows")
        out = one if out is None else out.unionAll(one)
    return out.withColumn("status", ops.ladder([(F.col("rows") == 0, "EMPTY"), (F.col("rows") < 1000, "SMALL")], "READY"))


def model_health(spark: SparkSession, sf: str) -> DataFrame:
    """One row about the scored payments: last score, its rows, rates and how fresh they are."""
    rows = base.transactions(spark, sf).filter("event_timestamp is not null")
    out = rows.agg(F.max("event_timestamp").alias("last_at"), F.max_by("transaction_id", F.struct("event_timestamp", "transaction_id")).alias("last_transaction"), F.avg(F.when(F.col("transaction_status") == "DECLINED", 1.0).otherwise(0.0)).alias("decline_rate"))
    out = ops.freshness(out, "last_at", AS_OF)
    return out.select(F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"), "last_transaction", F.round("decline_rate", 9).alias("decline_rate"), "freshness")


def golden_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Cases to evaluate on: the greatest, the least, the greatest abroad, and one with repeated deliveries."""
    rich = base.enriched(spark, sf).filter("amount is not null").select("transaction_id", "amount", "country")
    order = lambda c: [c, F.col("transaction_id").asc()]
    picks = {
        "greatest": rich.orderBy(*order(F.col("amount").desc())).limit(3), "least": rich.orderBy(*order(F.col("amount").asc())).limit(3),
        "abroad": rich.filter("country != 'AU'").orderBy(*order(F.col("amount").desc())).limit(2), "nearest_100": rich.orderBy(*order(F.abs(F.col("amount") - 100))).limit(1),
    }
    dup = base.events(spark, sf).filter("transaction_id is not null").groupBy("transaction_id").agg(F.count(F.lit(1)).alias("deliveries")).filter("deliveries > 2")
    picks["repeated"] = dup.join(rich, "transaction_id").orderBy(F.col("deliveries").desc(), "transaction_id").limit(2).select("transaction_id", "amount", "country")
    out = None
    for name, df in picks.items():
        one = df.select(F.lit(name).alias("case_kind"), "transaction_id", F.col("amount").cast("double").alias("amount"))
        out = one if out is None else out.unionByName(one)
    return out


def promotion_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Score and forecast metrics against their gates."""
    scored = scoring.areas(scoring.curve(core._scored(spark, sf), "score", "label")).select("average_precision", "roc_auc")
    wape = forecast.errors(forecast.seasonal_naive(core._series(spark, sf))).select("wape")
    rate = core._scored(spark, sf).agg(F.avg("label").alias("base_rate"))
    one = scored.join(wape).join(rate)  # one row each
    checked = scoring.gates(one, {"average_precision_above_base_rate": F.col("average_precision") >= F.col("base_rate"), "roc_auc_above_0.9": F.col("roc_auc") > 0.9, "wape_at_most_1": F.col("wape") <= 1.0})
    return checked.select(F.array_join("failed_gates", ",").alias("failed_gates"), "passed")


def measure_agents(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of agent runs by whether the case passed."""
    n = F.count(F.lit(1))
    view = metrics.MetricView(core._cases(spark, sf), {"passed": "case_pass", "calls": F.size("tools")}, {
        "cases": n, "pass_rate": metrics.ratio(F.count_if("case_pass"), n), "selection": F.avg("tool_selection"), "efficiency": F.avg("tool_efficiency"), "safe": F.count_if(F.col("safety") == 1), "most_calls": F.max(F.size("tools")), "tools": F.sum(F.size("tools")),
    })
    return view.query(["passed"], ["cases", "pass_rate", "safe", "most_calls", "tools"])


def cost_by_sku(spark: SparkSession, sf: str) -> DataFrame:
    """Usage per product and month at the price in force, with a rank inside the month."""
    use = core._usage(spark, sf).groupBy("sku", "l_shipdate").agg(F.sum("quantity").cast("decimal(18,2)").alias("quantity"))
    priced = ops.priced_usage(use, core._prices(spark, sf), {"sku": "price_sku"}, "l_shipdate", "price_start", "price_end", ["sku", "l_shipdate"], "quantity", "list_price")
    monthly = priced.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "sku").agg(F.sum("list_cost").alias("cost")).filter("cost is not null")
    return ops.top_per_group(monthly, ["month"], [F.col("cost").desc(), F.col("sku").asc()], 3).withColumn("cost", F.col("cost").cast("double"))


def rag_context(spark: SparkSession, sf: str) -> DataFrame:
    """Context of each question from its whole passages, and whether answers cite only those."""
    ranked = core._keyword(spark, sf, 3)
    made = retrieval.context(ranked, table(spark, sf, "documents").select("doc_id", "text"))
    got = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.col("doc_id").cast("string"))).alias("docs"))
    rows = made.join(got, "query_id").withColumn("answer", F.concat(F.lit("see [SOURCE "), F.element_at("docs", 1), F.lit("] and [SOURCE "), F.element_at("docs", -1), F.lit("]")))
    return rows.select(
        "query_id", F.length("context").alias("context_length"), F.md5("context").alias("context_hash"), retrieval.citations_valid(F.col("answer"), F.col("docs")).alias("valid"), retrieval.citations_valid(F.concat("answer", F.lit(" [SOURCE none]")), F.col("docs")).alias("with_foreign"),
        retrieval.citations_valid(F.lit("no source"), F.col("docs")).alias("without_any"),
    )


def rag_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Context of each question with the whole text of its passages; ``rag_context`` has its length and hash."""
    ranked = core._keyword(spark, sf, 3)
    made = retrieval.context(ranked, table(spark, sf, "documents").select("doc_id", "text"))
    return made.select("query_id", "context", F.length("context").alias("context_length"), F.sha2("context", 256).alias("context_hash"))


def evidence_view(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions with the customer's features of the same instant; no outcome column may be in it."""
    from tidemark.operators import features

    tx = base.transactions(spark, sf)
    known = features.behaviour(tx, "customer_id", "customer").withColumnRenamed("feature_timestamp", "event_timestamp")
    out = tx.select("transaction_id", "customer_id", "event_timestamp", "amount").join(known, ["customer_id", "event_timestamp"], "left")
    checked = governance.forbid_columns(out, {"fraud_outcome", "fraud_case_status", "email", "date_of_birth"})
    return checked.select("transaction_id", F.col("amount").cast("double").alias("amount"), "customer_txn_count_1d", "customer_txn_count_30d")


def quarantine_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional distinct counts: transactions, merchants and days with each failure."""
    rows = quality.classify(base.transactions(spark, sf), quality.transaction_rules())
    bad = F.col("is_quarantined")
    return rows.agg(F.count_distinct(F.when(bad, F.col("transaction_id"))).alias("quarantined_transactions"), F.count_distinct(F.when(bad, F.col("merchant_id"))).alias("quarantined_merchants"), F.count_distinct(F.when(~bad, F.col("merchant_id"))).alias("valid_merchants"), F.max(F.size("dq_failed_rules")).alias("most_failures"))


def price_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Usage rows without a price in force, by product."""
    use = core._usage(spark, sf).groupBy("sku", "l_shipdate").agg(F.count(F.lit(1)).alias("rows"))
    found = joins.in_force(use, core._prices(spark, sf), {"sku": "price_sku"}, "l_shipdate", "price_start", "price_end", ["sku", "l_shipdate"], F.col("price_start"), ["list_price"])
    return found.groupBy("sku").agg(F.sum("rows").alias("rows"), F.sum(F.when(F.col("list_price").isNull(), F.col("rows")).otherwise(0)).alias("unpriced"), F.max("list_price").cast("double").alias("highest"))


def response_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of the answers of agent cases and the items under each."""
    rows = core._cases(spark, sf).select(F.explode(evaluation.sections(F.col("answer"))).alias("s"))
    return rows.groupBy(F.col("s.title").alias("title")).agg(F.count(F.lit(1)).alias("sections"), F.sum(F.size("s.items")).alias("items"))


def score_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a table, a top-k report: the first hundred scored rows in a stable order."""
    return core._scored(spark, sf).orderBy(F.col("score").desc(), F.col("label").asc()).limit(100).select("score", "label")


def last_seen(spark: SparkSession, sf: str) -> DataFrame:
    """When each merchant was last paid and last delivered, from either side."""
    a = base.transactions(spark, sf).filter("merchant_id is not null").groupBy("merchant_id").agg(F.date_format(F.max("event_timestamp"), DATE).alias("last_paid"))
    b = base.events(spark, sf).filter("merchant_id is not null").groupBy("merchant_id").agg(F.date_format(F.max(as_ts("kafka_timestamp")), DATE).alias("last_delivered"))
    return joins.merged_days(a, b, ["merchant_id"])


def queries() -> dict:
    named = (scoped_audit, operations_summary, source_readiness, model_health, golden_cases, promotion_gates, measure_agents, cost_by_sku, rag_context, rag_passages, evidence_view, quarantine_reasons, price_overlap, response_sections, score_page, last_seen)
    return {f.__name__: f for f in named}
