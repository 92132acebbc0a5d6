"""The dashboard datasets, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import standardize
from tidemark.plans import views
from tidemark.queries import base, core, core_sql


def _payments(spark: SparkSession, sf: str) -> DataFrame:
    return base.enriched(spark, sf).withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    score = F.least(F.greatest(F.floor(F.col("amount") / 10), F.lit(0)), F.lit(100)) / F.lit(100.0)
    rows = base.enriched(spark, sf).filter("amount is not null").withColumn("fraud_probability", score)
    return rows.select(
        F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "channel", "payment_method", F.col("country").alias("transaction_country"), "merchant_id", "merchant_name", "fraud_probability", (F.col("fraud_probability") >= 0.5).cast("int").alias("predicted_fraud"),
        standardize.band(F.col("fraud_probability"), [(0.80, "HIGH"), (0.50, "MEDIUM")], "LOW").alias("risk_band"), (F.col("country") != "AU").alias("is_cross_border"), (~F.coalesce("card_present", F.lit(False))).alias("is_card_not_present"), F.lit("Champion").alias("model_alias"),
    )


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Agent cases with judge scores as input columns: quarters drawn from the transaction number."""
    n = F.regexp_extract("transaction_id", r"(\d+)$", 1).cast("long")
    quarter = lambda k: (F.floor(n / k) % 5 / 4).cast("double")
    rows = core._cases(spark, sf)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("ROUTINE", "AMBIGUOUS", "CONFLICTING")]), (n % 3 + 1).cast("int"))
    return rows.select(
        F.lit("run-1").alias("evaluation_run_id"), F.concat(F.lit("case-"), "transaction_id").alias("case_id"), kind.alias("scenario_type"), F.lit("model-a").alias("generation_model"), F.lit("model-b").alias("judge_model"), "case_pass", F.lit("2026-08-01").alias("created_at"),
        F.col("overall").alias("overall_score"), quarter(1).alias("groundedness_score"), quarter(2).alias("evidence_completeness_score"), quarter(3).alias("investigation_quality_score"), F.col("tool_selection").alias("tool_selection_score"), quarter(4).alias("tool_argument_score"),
        F.col("tool_efficiency").alias("tool_efficiency_score"), quarter(5).alias("citation_score"), quarter(6).alias("scope_compliance_score"), F.col("safety").alias("safety_score"), quarter(7).alias("human_review_score"), (n % 60).cast("double").alias("duration_seconds"),
        "transaction_id", F.array_join("failure_reasons", ",").alias("failure_reasons"),
    )


def _panel(name: str, spark: SparkSession, sf: str) -> DataFrame:
    build = {"payments": lambda: views.payments(_payments(spark, sf)), "model": lambda: views.model(_scored(spark, sf)), "agents": lambda: views.agents(_judged(spark, sf))}
    kind = views.PANELS[name].view
    return views.panel({kind: build[kind]()}, name)


def panel_failed_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = _judged(spark, sf).filter("not case_pass")
    return rows.select("evaluation_run_id", "case_id", "scenario_type", "groundedness_score", "tool_selection_score", "failure_reasons").orderBy("case_id")


def queries() -> dict:
    return {f"panel_{n}": partial(_panel, n) for n in views.PANELS} | {"panel_failed_cases": panel_failed_cases}


_DECLINED = "count(*) FILTER (transaction_status = 'DECLINED')"
_HIGH = "count(*) FILTER (risk_band = 'HIGH'{0})"
_MEASURES = {
    "transaction_count": "count(*)", "total_payment_value": "CAST(coalesce(sum(amount), 0) AS DOUBLE)", "average_transaction_value": "CAST(sum(amount) AS DOUBLE) / count(amount)", "unique_customers": "count(DISTINCT customer_id)", "decline_rate": f"CAST({_DECLINED} AS DOUBLE) / count(*)",
    "transactions_scored": "count(*)", "predicted_fraud_count": "count(*) FILTER (predicted_fraud = 1)", "predicted_fraud_rate": "CAST(count(*) FILTER (predicted_fraud = 1) AS DOUBLE) / count(*)", "average_fraud_probability": "round(avg(fraud_probability), 9)",
    "high_risk_transaction_count": _HIGH.format(""), "cross_border_high_risk_count": _HIGH.format(" AND is_cross_border"), "evaluated_cases": "count(*)", "case_pass_rate": "CAST(count(*) FILTER (case_pass) AS DOUBLE) / count(*)",
}


def sql() -> dict[str, str]:
    rich = f"WITH {core_sql._RICH}"
    score = "least(greatest(floor(amount / 10), 0), 100) / 100.0::DOUBLE"
    quarter = lambda k, name: f"(n // {k}) % 5 / 4.0::DOUBLE AS {name}"
    sources = {
        "payments": f"{rich}, v AS (SELECT * REPLACE (strftime(event_date, '%Y-%m-%d') AS event_date), country AS transaction_country FROM rich)",
        "model": f"""{rich}, v0 AS (SELECT strftime(event_date, '%Y-%m-%d') AS event_date, channel, merchant_name, country <> 'AU' AS is_cross_border, {score} AS fraud_probability FROM rich WHERE amount IS NOT NULL),
v AS (SELECT *, CASE WHEN fraud_probability >= 0.5 THEN 1 ELSE 0 END AS predicted_fraud, CASE WHEN fraud_probability >= 0.8 THEN 'HIGH' WHEN fraud_probability >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band FROM v0)""",
        "agents": f"""WITH {core_sql._CASES}, j AS (SELECT *, CAST(regexp_extract(transaction_id, '(\\d+)$', 1) AS BIGINT) AS n FROM s3),
v AS (SELECT transaction_id, 'case-' || transaction_id AS case_id, 'run-1' AS evaluation_run_id, ['ROUTINE', 'AMBIGUOUS', 'CONFLICTING'][n % 3 + 1] AS scenario_type, len(reasons) = 0 AS case_pass, array_to_string(reasons, ',') AS failure_reasons, overall AS overall_score, tool_selection AS tool_selection_score, tool_efficiency AS tool_efficiency_score, safety AS safety_score,
  {quarter(1, 'groundedness_score')}, {quarter(2, 'evidence_completeness_score')}, {quarter(4, 'tool_argument_score')}, {quarter(5, 'citation_score')}, {quarter(6, 'scope_compliance_score')}, {quarter(7, 'human_review_score')}, (n % 60)::DOUBLE AS duration_seconds FROM j)""",
    }
    out = {}
    for name, p in views.PANELS.items():
        cols = [*p.dims, *[f"{_MEASURES.get(m) or f'round(avg({views.AGENT_MEANS[m]}), 9)'} AS {m}" for m in p.measures]]
        out[f"panel_{name}"] = f"{sources[p.view]} SELECT {', '.join(cols)} FROM v" + (f" GROUP BY {', '.join(p.dims)}" if p.dims else "")
    out["panel_failed_cases"] = f"{sources['agents']} SELECT evaluation_run_id, case_id, scenario_type, groundedness_score, tool_selection_score, failure_reasons FROM v WHERE NOT case_pass"
    return out
