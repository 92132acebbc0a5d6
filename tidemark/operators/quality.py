"""Row rules: classify, split, expect, and measure.

A rule is a named predicate.  A row fails a rule unless the predicate is true, so null
fails.  Classification is one projection of built-in array functions; nothing is lost.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Rules = Mapping[str, Column]

# The closed domains of coded columns.
EVENT_TYPES = ("AUTHORIZATION", "DECLINE", "SETTLEMENT", "REVERSAL", "REFUND")
CHANNELS = ("POS", "ECOMMERCE", "MOBILE", "ATM")
METHODS = ("DEBIT_CARD", "CREDIT_CARD", "DIGITAL_WALLET", "BANK_TRANSFER")
STATUSES = ("AUTHORIZED", "DECLINED", "SETTLED", "REVERSED", "REFUNDED")
RATINGS = ("LOW", "MEDIUM", "HIGH")
KYC = ("PENDING", "VERIFIED", "REJECTED")
HOLDER = ("ACTIVE", "SUSPENDED", "CLOSED")
ACCOUNT_TYPES = ("CHECKING", "SAVINGS", "CREDIT_CARD")
ACCOUNT_STATES = ("ACTIVE", "BLOCKED", "CLOSED")
CASE_STATES = ("OPEN", "INVESTIGATING", "CLOSED")
OUTCOMES = ("CONFIRMED_FRAUD", "LEGITIMATE", "UNDETERMINED")


# The rules of an event, in the order in which a failed row names them.
EVENT_RULES = (
    "event_id_present", "transaction_id_present", "account_id_present", "merchant_id_present", "event_timestamp_present", "transaction_timestamp_present", "sequence_number_positive", "amount_positive",
    "currency_code_valid", "event_type_valid", "channel_valid", "payment_method_valid", "transaction_status_valid", "country_code_valid", "payload_parsed", "kafka_lineage_present",
)


def filled(name: str) -> Column:
    return F.col(name).isNotNull() & (F.trim(name) != "")


def there(*names: str) -> Column:
    out = F.col(names[0]).isNotNull()
    for n in names[1:]:
        out = out & F.col(n).isNotNull()
    return out


def matches(name: str, pattern: str) -> Column:
    return F.col(name).rlike(pattern)


def above(name: str, least: int) -> Column:
    return F.col(name) > least


def among(name: str, values: Sequence[str]) -> Column:
    return F.col(name).isin(list(values))


_MONEY, _LAND, _MCC = "^[A-Z]{3}$", "^[A-Z]{2}$", "^[0-9]{4}$"


def _ids(*names: str) -> dict[str, Column]:
    return {f"{n}_present": filled(n) for n in names}


def _versioned() -> dict[str, Column]:
    return {"record_version_valid": above("record_version", 0), "source_updated_at_present": there("source_updated_at")}


# The names of the rules below.
def transaction_rules() -> Rules:
    return {
        **_ids("transaction_id", "account_id", "merchant_id"), "event_timestamp_present": there("event_timestamp"), "amount_positive": above("amount", 0), "currency_code_valid": matches("currency", _MONEY),
        "channel_valid": among("channel", CHANNELS), "payment_method_valid": among("payment_method", METHODS), "transaction_status_valid": among("transaction_status", STATUSES), "country_code_valid": matches("country", _LAND),
    }


def event_rules() -> Rules:
    own = {
        **_ids("event_id"), "transaction_timestamp_present": there("transaction_event_timestamp"), "sequence_number_positive": above("sequence_number", 0), "event_type_valid": among("event_type", EVENT_TYPES),
        "payload_parsed": F.col("parse_status") == "PARSED", "kafka_lineage_present": there("kafka_topic", "kafka_partition", "kafka_offset"),
    }
    known = {**own, **transaction_rules()}
    return {name: known[name] for name in EVENT_RULES}


def customer_rules() -> Rules:
    return {**_ids("customer_id"), "country_code_valid": matches("country", _LAND), "risk_rating_valid": among("risk_rating", RATINGS), "kyc_status_valid": among("kyc_status", KYC), "customer_status_valid": among("customer_status", HOLDER), **_versioned()}


def account_rules() -> Rules:
    return {**_ids("account_id", "customer_id"), "account_type_valid": among("account_type", ACCOUNT_TYPES), "account_currency_valid": matches("account_currency", _MONEY), "account_status_valid": among("account_status", ACCOUNT_STATES), "opened_date_present": there("opened_date"), **_versioned()}


def merchant_rules() -> Rules:
    return {
        **_ids("merchant_id", "merchant_name"), "merchant_category_code_valid": matches("merchant_category_code", _MCC), "merchant_country_valid": matches("merchant_country", _LAND),
        "merchant_risk_rating_valid": among("merchant_risk_rating", RATINGS), "merchant_status_valid": among("merchant_status", HOLDER), **_versioned(),
    }


def fraud_case_rules() -> Rules:
    return {
        **_ids("case_id", "transaction_id"), "opened_at_present": there("opened_at"), "fraud_case_status_valid": among("fraud_case_status", CASE_STATES),
        "fraud_outcome_valid": F.col("fraud_outcome").isNull() | among("fraud_outcome", OUTCOMES), "closed_case_has_closed_at": (F.col("fraud_case_status") != "CLOSED") | there("closed_at"),
    }


def failures(rules: Rules) -> Column:
    """Names of the rules a row fails, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(name) for name, ok in rules.items()]))


def classify(df: DataFrame, rules: Rules, checked_at: Column | None = None) -> DataFrame:
    """Adds ``dq_failed_rules``, ``is_quarantined``, ``dq_status`` and, where given, ``dq_checked_at``."""
    bad = F.size("dq_failed_rules") > 0
    out = df.withColumn("dq_failed_rules", failures(rules)).withColumns({"is_quarantined": bad, "dq_status": F.when(bad, "QUARANTINED").otherwise("VALID")})
    return out if checked_at is None else out.withColumn("dq_checked_at", checked_at)


def split(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(validated, quarantine) over one classified parent, which the caller stores once."""
    return classified.filter(~F.col("is_quarantined")), classified.filter("is_quarantined")


def _counts(rules: Rules) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]]


def expect(df: DataFrame, rules: Rules, action: str = "warn", name: str = "expectations") -> tuple[DataFrame, Observation]:
    """``warn`` keeps all rows, ``drop`` drops failing ones, ``fail`` raises on the first.

    The observation holds the rows seen and the failures per rule, counted in the same pass.
    """
    watch = Observation(name)
    seen = df.observe(watch, *_counts(rules))
    if action == "warn":
        return seen, watch
    if action == "drop":
        return seen.filter(F.size(failures(rules)) == 0), watch
    if action == "fail":
        bad = failures(rules)
        held = F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("expectation failed: "), F.array_join(bad, ", "))).cast("boolean")).otherwise(F.lit(True))
        return seen.filter(held), watch
    raise ValueError(f"unknown action {action}")


def expectation_events(df: DataFrame, rules: Rules, dataset: str, flow: str, update: str, day: str) -> DataFrame:
    """Passed and failed rows per rule of one flow run: the rows of the event log."""
    one = df.agg(*_counts(rules))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("failed")) for n in rules])).alias("r")
    return one.select(F.lit(day).alias("event_date"), F.lit(update).alias("update_id"), F.lit(flow).alias("flow_name"), F.lit(dataset).alias("dataset"), F.col("rows"), pairs).select(
        "event_date", "update_id", "flow_name", "dataset", "r.rule", (F.col("rows") - F.col("r.failed")).alias("passed_records"), F.col("r.failed").alias("failed_records")
    )


def expectation_health(events: DataFrame) -> DataFrame:
    """Pass and failure rates; 1.0 and 0.0 where nothing was evaluated."""
    keys = ["event_date", "dataset", "flow_name", "rule"]
    out = events.groupBy(*keys).agg(F.sum("passed_records").alias("passed"), F.sum("failed_records").alias("failed"))
    seen = (F.col("passed") + F.col("failed")).cast("double")
    return out.withColumns({"pass_rate": F.when(seen > 0, F.col("passed") / seen).otherwise(F.lit(1.0)), "failure_rate": F.when(seen > 0, F.col("failed") / seen).otherwise(F.lit(0.0))})


def quarantine_daily(classified: DataFrame, day: str) -> DataFrame:
    bad = classified.filter("is_quarantined")
    return bad.groupBy(day).agg(F.count(F.lit(1)).alias("quarantined_rows"), F.sum(F.size("dq_failed_rules")).alias("failed_rules"))


def by_rule(classified: DataFrame) -> DataFrame:
    return classified.select(F.explode("dq_failed_rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("failed_rows"))


def current_health(datasets: Sequence[str], classified: DataFrame, name: str = "dataset") -> DataFrame:
    """One row per monitored dataset, zero-safe: a dataset without any row is healthy with zeros."""
    spark = classified.sparkSession
    listed = spark.createDataFrame([(d,) for d in datasets], "dataset string")
    seen = classified.groupBy(F.col(name).alias("dataset")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_quarantined").alias("quarantined"))
    out = listed.join(seen, "dataset", "left").fillna(0, ["rows", "quarantined"])
    return out.withColumn("health", F.when(F.col("quarantined") == 0, "HEALTHY").otherwise("DEGRADED"))
