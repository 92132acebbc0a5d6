"""Projections from raw to standard columns, and decoding of message payloads.

A shape maps each output column to a kind and a source column.  Kinds are small
expressions, so a shape is one projection: it is pruned and pushed to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import as_ts, code

Shape = Mapping[str, tuple[str, str]]

KINDS: dict[str, Callable[[Column], Column]] = {
    "as_is": lambda c: c,
    "code": lambda c: F.upper(F.trim(c)),
    "text": F.trim,
    "lower": lambda c: F.lower(F.trim(c)),
    "ts": as_ts,
    "date": lambda c: F.to_date(as_ts(c)),
    "hour": lambda c: F.date_trunc("hour", as_ts(c)),
    "money": lambda c: c.cast("decimal(18,2)"),
    "flag": lambda c: F.coalesce(c, F.lit(False)),
}


def shape(df: DataFrame, spec: Shape) -> DataFrame:
    return df.select(*[KINDS[kind](F.col(source)).alias(out) for out, (kind, source) in spec.items()])


def _same(kind: str, *names: str) -> dict[str, tuple[str, str]]:
    return {n: (kind, n) for n in names}


# The names that standard columns have.
EVENTS: Shape = {
    **_same("as_is", "event_id", "transaction_id", "account_id", "merchant_id"), **_same("code", "event_type", "currency", "channel", "payment_method", "transaction_status", "country", "delivery_scenario"),
    "sequence_number": ("as_is", "sequence_number"), "event_timestamp": ("ts", "event_timestamp"), "event_date": ("date", "event_timestamp"), "event_hour": ("hour", "event_timestamp"),
    "amount": ("money", "amount"), "card_present": ("as_is", "card_present"), "simulated_arrival_at": ("ts", "simulated_arrival_at"),
    "kafka_partition": ("as_is", "kafka_partition"), "kafka_offset": ("as_is", "kafka_offset"), "kafka_timestamp": ("ts", "kafka_timestamp"),
}

TRANSACTIONS: Shape = {
    **_same("as_is", "transaction_id", "account_id", "merchant_id"), "event_timestamp": ("ts", "event_timestamp"), "event_date": ("date", "event_timestamp"), "event_hour": ("hour", "event_timestamp"),
    "amount": ("money", "amount"), **_same("code", "currency", "channel", "payment_method"), "transaction_status": ("code", "status"), "card_present": ("as_is", "card_present"),
    **_same("as_is", "device_id", "ip_address"), "country": ("code", "country"),
}

CUSTOMERS: Shape = {
    "customer_id": ("as_is", "customer_id"), **_same("text", "first_name", "last_name", "city"), "date_of_birth": ("as_is", "date_of_birth"), "email": ("lower", "email"), "phone": ("text", "phone"),
    **_same("code", "state", "country", "risk_rating", "kyc_status"), "customer_status": ("code", "status"), "record_version": ("as_is", "record_version"), "source_updated_at": ("ts", "source_updated_at"), "is_deleted": ("flag", "is_deleted"),
}

ACCOUNTS: Shape = {
    **_same("as_is", "account_id", "customer_id"), "account_type": ("code", "account_type"), "account_currency": ("code", "currency"), "account_status": ("code", "status"),
    **_same("as_is", "opened_date", "current_balance", "record_version"), "source_updated_at": ("ts", "source_updated_at"), "is_deleted": ("flag", "is_deleted"),
}

MERCHANTS: Shape = {
    "merchant_id": ("as_is", "merchant_id"), "merchant_name": ("text", "merchant_name"), "merchant_category_code": ("text", "merchant_category_code"), "merchant_city": ("text", "city"), "merchant_country": ("code", "country"),
    "merchant_risk_rating": ("code", "risk_rating"), "merchant_status": ("code", "status"), "record_version": ("as_is", "record_version"), "source_updated_at": ("ts", "source_updated_at"), "is_deleted": ("flag", "is_deleted"),
}

FRAUD_CASES: Shape = {
    **_same("as_is", "case_id", "transaction_id"), "opened_at": ("ts", "opened_at"), "fraud_case_status": ("code", "status"), "suspected_reason": ("text", "suspected_reason"), "fraud_outcome": ("code", "outcome"), "closed_at": ("ts", "closed_at"),
}


def delay_seconds(arrival: Column | str, event: Column | str) -> Column:
    """Whole seconds from event to arrival; negative when it came early."""
    return F.unix_timestamp(as_ts(arrival)) - F.unix_timestamp(as_ts(event))


PAYLOAD = (
    "simulated_arrival_at string, scenario string, payload struct<event_id string, event_type string, event_timestamp string, sequence_number bigint,"
    " transaction struct<transaction_id string, account_id string, merchant_id string, event_timestamp string, amount string, currency string, channel string,"
    " payment_method string, status string, card_present boolean, device_id string, ip_address string, country string>>"
)


def decode_messages(records: DataFrame) -> DataFrame:
    """Kafka-shaped records to event columns.

    A payload that is no JSON, or null, gives ``parse_status`` INVALID_JSON and null
    fields, so it reaches quarantine instead of failing the flow; values of the wrong
    type become null by ``try_`` casts.
    """
    held = f"{PAYLOAD}, _bad string"
    raw = records.withColumn("raw", F.col("value").cast("string"))
    parsed = raw.withColumn("j", F.from_json("raw", held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    e, t = "j.payload", "j.payload.transaction"
    same = ["transaction_id", "account_id", "merchant_id", "currency", "channel", "payment_method", "card_present", "device_id", "ip_address", "country"]
    return parsed.select(
        F.col(f"{e}.event_id"), *[F.col(f"{t}.{c}") for c in same], code(F.col(f"{t}.status")).alias("transaction_status"), F.col(f"{e}.event_type"), F.col(f"{e}.sequence_number"),
        F.try_to_timestamp(F.col(f"{e}.event_timestamp")).alias("event_timestamp"), F.try_to_timestamp(F.col(f"{t}.event_timestamp")).alias("transaction_event_timestamp"),
        F.col(f"{t}.amount").try_cast("decimal(18,2)").alias("amount"), F.col("j.scenario").alias("delivery_scenario"), F.try_to_timestamp(F.col("j.simulated_arrival_at")).alias("simulated_arrival_at"),
        F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_timestamp"),
        F.when(F.col("j").isNull() | F.col("j._bad").isNotNull(), "INVALID_JSON").otherwise("PARSED").alias("parse_status"),
    )


def blank_to_null(c: Column | str, kind: str) -> Column:
    """``''`` is null; anything else is cast without throwing."""
    text = F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))
    return F.try_to_timestamp(text) if kind == "timestamp" else text.try_cast(kind)


def band(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first step at or below ``value``; steps from high to low."""
    out = None
    for least, name in steps:
        hit = value >= least
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)
