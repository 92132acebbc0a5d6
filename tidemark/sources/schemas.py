"""Declared schemas of the source files; every field may be null so that bad rows reach quality checks."""

from __future__ import annotations

CUSTOMERS = (
    "customer_id string, first_name string, last_name string, date_of_birth date, email string, phone string, address_line_1 string, city string, state string, postcode string,"
    " country string, risk_rating string, kyc_status string, status string, record_version int, source_updated_at timestamp, is_deleted boolean"
)
ACCOUNTS = ("account_id string, customer_id string, account_type string, currency string, status string, opened_date date, current_balance decimal(18,2), record_version int, source_updated_at timestamp, is_deleted boolean")
MERCHANTS = ("merchant_id string, merchant_name string, merchant_category_code string, city string, country string, risk_rating string, status string, record_version int, source_updated_at timestamp, is_deleted boolean")
#: ``closed_at`` comes as text: blank means null.
FRAUD_CASES = ("case_id string, transaction_id string, opened_at timestamp, status string, suspected_reason string, outcome string, analyst_notes string, closed_at string")
#: ``amount`` and ``event_timestamp`` come as text and are cast after reading.
TRANSACTIONS = (
    "transaction_id string, account_id string, merchant_id string, event_timestamp string, amount string, currency string, channel string, payment_method string,"
    " status string, card_present boolean, device_id string, ip_address string, country string"
)
#: Records as a Kafka reader gives them.
KAFKA = ("key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int")
