"""The three metric views of the engine and the datasets that dashboards ask of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import MetricView, mean, ratio, total



def payments(enriched: DataFrame) -> MetricView:
    rows = F.count(F.lit(1))
    fraud = F.col("fraud_outcome") == "CONFIRMED_FRAUD"
    dims = {c: c for c in ("event_date", "currency", "channel", "payment_method", "transaction_status", "merchant_id", "merchant_name", "merchant_category_code", "customer_risk_rating")}
    return MetricView(enriched, {**dims, "transaction_country": "country"}, {
        "transaction_count": rows, "total_payment_value": total("amount"), "average_transaction_value": mean("amount"), "unique_customers": F.count_distinct("customer_id"), "unique_merchants": F.count_distinct("merchant_id"),
        "declined_count": F.count_if(F.col("transaction_status") == "DECLINED"), "decline_rate": ratio(F.count_if(F.col("transaction_status") == "DECLINED"), rows), "confirmed_fraud_count": F.count_if(fraud),
    })


def model(scored: DataFrame) -> MetricView:
    """``scored``: dimension columns, ``fraud_probability``, ``predicted_fraud``, ``risk_band``."""
    rows, hit, high = F.count(F.lit(1)), F.col("predicted_fraud") == 1, F.col("risk_band") == "HIGH"
    names = ("event_date", "channel", "payment_method", "transaction_country", "merchant_id", "merchant_name", "risk_band", "predicted_fraud", "is_cross_border", "is_card_not_present", "model_alias")
    return MetricView(scored, {n: n for n in names}, {
        "transactions_scored": rows, "predicted_fraud_count": F.count_if(hit), "predicted_fraud_rate": ratio(F.count_if(hit), rows), "average_fraud_probability": F.round(F.avg("fraud_probability"), 9), "high_risk_transaction_count": F.count_if(high),
        "cross_border_high_risk_count": F.count_if(high & F.col("is_cross_border")), "card_not_present_high_risk_count": F.count_if(high & F.col("is_card_not_present")),
    })


#: Measure of the agent view -> the score column it averages.
AGENT_MEANS = {
    "average_overall_score": "overall_score", "average_groundedness": "groundedness_score", "average_evidence_completeness": "evidence_completeness_score", "average_investigation_quality": "investigation_quality_score", "average_tool_selection": "tool_selection_score",
    "average_tool_argument_score": "tool_argument_score", "average_tool_efficiency": "tool_efficiency_score", "average_citation_score": "citation_score", "scope_compliance_rate": "scope_compliance_score", "safety_compliance_rate": "safety_score",
    "human_review_compliance_rate": "human_review_score", "average_duration_seconds": "duration_seconds",
}


def agents(cases: DataFrame) -> MetricView:
    rows, ok = F.count(F.lit(1)), F.count_if("case_pass")
    names = ("evaluation_run_id", "case_id", "scenario_type", "generation_model", "judge_model", "case_pass", "created_at")
    return MetricView(cases, {n: n for n in names}, {"evaluated_cases": rows, "passed_cases": ok, "case_pass_rate": ratio(ok, rows), **{m: F.round(F.avg(c), 9) for m, c in AGENT_MEANS.items()}})


@dataclass(frozen=True)
class Panel:
    view: str
    dims: tuple[str, ...]
    measures: tuple[str, ...]
    order: tuple[str, ...] = ()


_VALUE, _RATE = ("transaction_count", "total_payment_value"), ("transaction_count", "total_payment_value", "decline_rate")
_FULL = ("transaction_count", "total_payment_value", "average_transaction_value", "decline_rate")
_RISK = ("transactions_scored", "predicted_fraud_rate", "average_fraud_probability", "high_risk_transaction_count")

PANELS: dict[str, Panel] = {
    "payment_kpis": Panel("payments", (), ("transaction_count", "total_payment_value", "average_transaction_value", "unique_customers", "decline_rate")),
    "payment_trend": Panel("payments", ("event_date",), _VALUE, ("event_date",)),
    "payment_channels": Panel("payments", ("channel",), _FULL, ("-total_payment_value",)),
    "payment_methods": Panel("payments", ("payment_method",), _RATE, ("-total_payment_value",)),
    "payment_countries": Panel("payments", ("transaction_country",), _VALUE, ("-total_payment_value",)),
    "payment_merchants": Panel("payments", ("merchant_name", "merchant_category_code"), _FULL, ("-total_payment_value",)),
    "model_kpis": Panel("model", (), ("transactions_scored", "predicted_fraud_count", "predicted_fraud_rate", "average_fraud_probability", "high_risk_transaction_count")),
    "model_trend": Panel("model", ("event_date",), _RISK, ("event_date",)),
    "model_bands": Panel("model", ("risk_band",), ("transactions_scored", "predicted_fraud_count", "average_fraud_probability"), ("-average_fraud_probability",)),
    "model_channels": Panel("model", ("channel",), _RISK, ("-average_fraud_probability",)),
    "model_borders": Panel("model", ("is_cross_border",), ("transactions_scored", "high_risk_transaction_count", "cross_border_high_risk_count", "average_fraud_probability"), ("-is_cross_border",)),
    "model_merchants": Panel("model", ("merchant_name",), _RISK, ("-average_fraud_probability",)),
    "agent_kpis": Panel("agents", (), ("evaluated_cases", "case_pass_rate", "average_overall_score", "average_groundedness", "average_evidence_completeness", "scope_compliance_rate", "safety_compliance_rate", "human_review_compliance_rate", "average_duration_seconds")),
    "agent_scenarios": Panel("agents", ("scenario_type",), ("evaluated_cases", "case_pass_rate", "average_overall_score", "average_groundedness", "average_evidence_completeness", "average_tool_efficiency"), ("scenario_type",)),
    "agent_tools": Panel("agents", ("scenario_type",), ("average_tool_selection", "average_tool_argument_score", "average_tool_efficiency", "average_citation_score"), ("scenario_type",)),
    "agent_compliance": Panel("agents", ("scenario_type",), ("scope_compliance_rate", "safety_compliance_rate", "human_review_compliance_rate"), ("scenario_type",)),
}


def panel(views: dict[str, MetricView], name: str) -> DataFrame:
    p = PANELS[name]
    return views[p.view].query(p.dims, p.measures, order=p.order)
