"""Layers that several queries share, built from the payments tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import as_ts, code, ident, table
from tidemark.operators import cdc, joins, standardize


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """One standardised row per transaction_id; of reloaded copies the first ingested stands."""
    raw = table(spark, sf, "payment_transactions_enriched")
    codes = {"currency": "currency", "channel": "channel", "payment_method": "payment_method", "transaction_status": "transaction_status", "transaction_country": "country", "customer_risk_rating": "stored_customer_rating", "merchant_risk_rating": "stored_merchant_rating"}
    body = F.struct(
        *[ident(c).alias(c) for c in ("account_id", "customer_id", "merchant_id")], as_ts("event_timestamp").alias("event_timestamp"), F.to_date(as_ts("event_timestamp")).alias("event_date"),
        F.date_trunc("hour", as_ts("event_timestamp")).alias("event_hour"), F.col("amount").cast("decimal(18,2)").alias("amount"), *[code(c).alias(n) for c, n in codes.items()], F.col("card_present"), F.col("source_file_name"),
    )
    order = F.struct(F.col("bronze_ingested_at").alias("a"), F.col("source_file_name").alias("b"), F.col("transaction_id").alias("c"))
    return raw.groupBy(ident("transaction_id").alias("transaction_id")).agg(F.min_by(body, order).alias("r")).select("transaction_id", "r.*")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised physical deliveries."""
    raw = table(spark, sf, "payment_events")
    clean = raw.withColumns({c: ident(c) for c in ("event_id", "transaction_id", "account_id", "merchant_id")})
    return standardize.shape(clean, standardize.EVENTS).withColumn("delay_seconds", standardize.delay_seconds(F.coalesce("simulated_arrival_at", "kafka_timestamp"), "event_timestamp"))


def account_changes(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "accounts")
    return standardize.shape(raw.withColumns({"account_id": ident("account_id"), "customer_id": ident("customer_id")}), standardize.ACCOUNTS)


def customer_changes(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "master_data_cdc")
    return standardize.shape(raw.withColumn("customer_id", ident("customer_id")), standardize.CUSTOMERS)


def accounts_log(spark: SparkSession, sf: str) -> DataFrame:
    narrow = account_changes(spark, sf).select("account_id", "customer_id", "account_type", "account_currency", "account_status", "record_version", "source_updated_at", "is_deleted")
    return cdc.change_log(narrow, "account_id", "record_version", "is_deleted", "source_updated_at")


def customers_log(spark: SparkSession, sf: str) -> DataFrame:
    narrow = customer_changes(spark, sf).select("customer_id", "country", "risk_rating", "kyc_status", "customer_status", "record_version", "source_updated_at", "is_deleted")
    return cdc.change_log(narrow, "customer_id", "record_version", "is_deleted", "source_updated_at")


def merchants(spark: SparkSession, sf: str) -> DataFrame:
    """Every merchant as its last snapshot row has it."""
    raw = table(spark, sf, "merchant_snapshots")
    body = F.struct(F.trim("merchant_name").alias("merchant_name"), F.trim("merchant_category_code").alias("merchant_category_code"), code("risk_rating").alias("merchant_risk_rating"), code("status").alias("merchant_status"))
    return raw.groupBy(ident("merchant_id").alias("merchant_id")).agg(F.max_by(body, F.struct("snapshot_at", "record_version")).alias("r")).filter("merchant_id is not null").select("merchant_id", "r.*")


def fraud_cases(tx: DataFrame) -> DataFrame:
    """A stand-in for the case system: a case for every twentieth transaction number."""
    n = F.regexp_extract("transaction_id", r"(\d+)$", 1).cast("long")
    rows = tx.select("transaction_id", n.alias("n")).filter("n % 20 = 0")
    status = F.element_at(F.array(F.lit("OPEN"), F.lit("INVESTIGATING"), F.lit("CLOSED")), (F.col("n") % 3 + 1).cast("int"))
    outcome = F.element_at(F.array(F.lit("CONFIRMED_FRAUD"), F.lit("LEGITIMATE"), F.lit("UNDETERMINED"), F.lit(None).cast("string")), (F.floor(F.col("n") / 20) % 4 + 1).cast("int"))
    return rows.select(F.concat(F.lit("case-"), F.lpad(F.col("n").cast("string"), 8, "0")).alias("fraud_case_id"), "transaction_id", status.alias("fraud_case_status"), outcome.alias("fraud_outcome"))


def enriched(spark: SparkSession, sf: str, tx: DataFrame | None = None) -> DataFrame:
    """Transactions with current account, its customer, the merchant and the fraud case; ``tx`` where they are stored already."""
    tx = transactions(spark, sf) if tx is None else tx
    accounts = cdc.scd1(accounts_log(spark, sf), "account_id", "record_version", "is_deleted").select("account_id", F.col("customer_id").alias("account_customer"), "account_type", "account_status")
    customers = cdc.scd1(customers_log(spark, sf), "customer_id", "record_version", "is_deleted").select("customer_id", F.col("risk_rating").alias("customer_risk_rating"), "kyc_status", "customer_status")
    facts = tx.drop("customer_id", "stored_customer_rating", "stored_merchant_rating")
    out = joins.star(facts, [
        ("account", accounts, "account_id", "account_id"), ("customer", customers, "account_customer", "customer_id"),
        ("merchant", merchants(spark, sf), "merchant_id", "merchant_id"), ("fraud", fraud_cases(tx), "transaction_id", "transaction_id"),
    ])
    return out.withColumnRenamed("account_customer", "customer_id").withColumnRenamed("fraud_dimension_match", "has_fraud_case")
