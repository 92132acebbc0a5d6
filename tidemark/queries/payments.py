"""The queries of problems 1 to 7 over the payments tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import code, ident, micros, table
from tidemark.operators import change_table, exactly_once, history, known_time, late, references, rolling
from tidemark.operators.history import OPEN
from tidemark.session import staged

POSITION = ["batch_id", "kafka_partition", "kafka_offset"]
STAMP = "yyyy-MM-dd HH:mm:ss"
#: The published feature days, as day numbers.
FIRST_DAY, LAST_DAY = 20636, 20666


def _arrival():
    return F.coalesce(micros("simulated_arrival_at"), micros("kafka_timestamp"))


# Problem 1


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "payment_events")
    return exactly_once.surplus(events, ident("event_id"), _arrival(), POSITION).withColumnRenamed("msg_id", "event_id")


def p1_exactly_once(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "payment_events")
    return exactly_once.keep_one(events, ident("event_id"), _arrival(), POSITION)


# Problem 2


def _merchant_history(spark: SparkSession, sf: str) -> DataFrame:
    payload = ["risk_rating", "status"]
    published = table(spark, sf, "merchant_history").select(
        ident("merchant_id").alias("entity"), micros("__start_at").alias("start_us"), micros("__end_at").alias("end_us"), F.col("record_version").alias("version"),
        code("merchant_risk_rating").alias("risk_rating"), code("merchant_status").alias("status"),
    )
    snapshots = table(spark, sf, "merchant_snapshots").select(
        ident("merchant_id").alias("entity"), micros("snapshot_at").alias("at_us"), F.col("record_version").alias("version"), micros("source_updated_at").alias("updated_us"),
        F.col("is_deleted").alias("gone"), code("risk_rating").alias("risk_rating"), code("status").alias("status"),
    )
    return history.full_history(published, snapshots, payload)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    runs = _merchant_history(spark, sf)
    return runs.select(F.col("entity").alias("merchant_id"), F.date_format("start_at", STAMP).alias("start_at"), F.coalesce(F.date_format("end_at", STAMP), F.lit("open")).alias("end_at"))


def p2_history(spark: SparkSession, sf: str) -> DataFrame:
    runs = _merchant_history(spark, sf)
    return runs.select(F.col("entity").alias("merchant_id"), F.col("risk_rating").alias("merchant_risk_rating"), F.col("status").alias("merchant_status"), F.date_format("start_at", STAMP).alias("__start_at"), F.date_format("end_at", STAMP).alias("__end_at"))


# Problem 3


def _customers_now(spark: SparkSession, sf: str, payload: list[str]) -> DataFrame:
    feed = table(spark, sf, "master_data_cdc")
    return change_table.current_state(feed, ident("customer_id"), F.col("record_version"), F.col("is_deleted"), F.col("feed_position"), payload)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    now = _customers_now(spark, sf, ["feed_position"])
    return now.select(F.col("__key").alias("customer_id"), F.col("__version").cast("int").alias("record_version"))


def p3_current(spark: SparkSession, sf: str) -> DataFrame:
    named = ["first_name", "last_name", "email", "city", "state", "country", "risk_rating", "kyc_status", "status"]
    now = _customers_now(spark, sf, named)
    coded = {"risk_rating", "kyc_status", "status"}
    return now.select(F.col("__key").alias("customer_id"), F.col("__version").cast("int").alias("record_version"), *[(code(c) if c in coded else F.col(c)).alias(c) for c in named])


# Problem 4


def _kept_events(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "payment_events")
    payload = {"group_id": ident("transaction_id"), "sequence": F.col("sequence_number").cast("long"), "event_us": micros("event_timestamp"), "arrival_us": _arrival(), "amount": F.col("amount")}
    return exactly_once.keep_one_narrow(events, ident("event_id"), _arrival(), POSITION, payload).filter("event_us is not null")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries without event_id take part, in the aggregates and as events that overtake, but are no cases: nothing names them."""
    kept = _kept_events(spark, sf)
    deltas = late.input_deltas(kept)
    corrects = late.corrections(deltas, late.versions(deltas)).select("msg_id", "event_us", "outcome")
    dropped = deltas.filter("outcome = 'DROPPED'").select("msg_id", "event_us", "outcome")
    disordered = late.out_of_order(kept, "group_id", "sequence", "arrival_us").filter("overtaken").select("msg_id", "event_us", F.lit("OUT_OF_ORDER").alias("outcome"))
    found = corrects.unionByName(dropped).unionByName(disordered).filter("msg_id is not null")
    return found.select(F.col("msg_id").alias("event_id"), F.date_format(F.timestamp_micros("event_us"), "yyyy-MM-dd HH").alias("event_hour"), "outcome")


def p4_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and amounts per hour as they stand after all corrections, and how often each hour was corrected."""
    state = late.versions(late.input_deltas(_kept_events(spark, sf)))
    now = late.settled(late.retractions(state))
    return now.select(F.date_format(F.timestamp_micros("period"), "yyyy-MM-dd HH").alias("event_hour"), F.col("n").alias("event_count"), F.col("amount").cast("double").alias("amount_sum"), F.col("version").cast("int").alias("corrections"))


def p4_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily totals kept up from the hourly change log alone."""
    hourly = late.retractions(late.versions(late.input_deltas(_kept_events(spark, sf))))
    now = late.settled(late.retractions(late.downstream(hourly, 24 * late.HOUR)))
    return now.select(F.date_format(F.timestamp_micros("period"), "yyyy-MM-dd").alias("event_date"), F.col("n").alias("event_count"), F.col("amount").cast("double").alias("amount_sum"))


# Problem 5

_COUNTS, _AMOUNTS = ["txn_count_7d", "txn_count_30d"], ["amount_sum_7d", "avg_amount_30d"]


def _features(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for kind in ("customer", "merchant"):
        rows = table(spark, sf, f"{kind}_behavior_features")
        parts.append(rows.select(F.lit(kind).alias("kind"), ident(f"{kind}_id").alias("entity_id"), F.expr("cast(floor(unix_micros(cast(feature_timestamp as timestamp)) / 86400000000) as int)").alias("day_no"), *[F.col(f"{kind}_{c}").alias(c) for c in (*_COUNTS, *_AMOUNTS)]))
    return parts[0].unionByName(parts[1])


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    payments = table(spark, sf, "payment_transactions_enriched").select(
        ident("transaction_id").alias("txn"), ident("customer_id").alias("customer"), ident("merchant_id").alias("merchant"), micros("event_timestamp").alias("at_us"), F.col("amount").alias("amount")
    )
    return rolling.daily_totals(payments, "txn", {"customer": "customer", "merchant": "merchant"}, "at_us", "amount")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    told = _features(spark, sf)
    expected = rolling.trailing(_daily(spark, sf), told, FIRST_DAY, LAST_DAY)
    wrong = rolling.deviating(expected, told, _COUNTS, _AMOUNTS)
    return wrong.select("entity_id", F.date_format(F.date_from_unix_date("day_no"), "yyyy-MM-dd").alias("feature_date"))


def p5_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """Trailing totals of every customer and merchant with a payment, for every day asked for."""
    daily = _daily(spark, sf)
    out = rolling.trailing(daily, daily, FIRST_DAY, LAST_DAY)
    return out.withColumn("feature_date", F.date_format(F.date_from_unix_date("day_no"), "yyyy-MM-dd")).drop("day_no")


# Problems 6 and 7

_TABLES = {"account_id": "accounts", "customer_id": "customers", "merchant_id": "merchants"}


def _customer_versions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "master_data_cdc").select(F.concat(F.lit("customer_id|"), ident("customer_id")).alias("entity"), micros("source_updated_at").alias("known_us"), F.col("record_version").cast("long").alias("key"), code("risk_rating").alias("value"), F.coalesce("is_deleted", F.lit(False)).alias("deleted"))


def _account_versions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "accounts").select(F.concat(F.lit("account_id|"), ident("account_id")).alias("entity"), micros("source_updated_at").alias("known_us"), F.col("record_version").cast("long").alias("key"), code("status").alias("value"), F.coalesce("is_deleted", F.lit(False)).alias("deleted"))


def _merchant_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Versions by valid time; an end is a deleted version, which a start at the same instant outranks."""
    entity = F.concat(F.lit("merchant_id|"), "entity").alias("entity")
    runs = _merchant_history(spark, sf)
    begin = F.struct(F.col("lo_us").alias("known_us"), (F.col("lo_us") * 2 + 1).alias("key"), F.col("risk_rating").alias("value"), F.lit(False).alias("deleted"))
    end = F.struct(F.col("hi_us").alias("known_us"), (F.col("hi_us") * 2).alias("key"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("deleted"))
    both = F.when(F.col("hi_us") < OPEN, F.array(begin, end)).otherwise(F.array(begin))
    return runs.select(entity, F.explode(both).alias("v")).select("entity", "v.*")


def _probe(merchant: Column, at_us: Column) -> Column:
    """Where to look on the valid-time axis: merchants by the time itself, the others at their highest version."""
    return F.when(merchant, at_us * 2 + 1).otherwise(F.lit(known_time.TOP))


def _refs(spark: SparkSession, sf: str, once: bool = False) -> DataFrame:
    """The references of all physical rows, or of each transaction once."""
    rows = table(spark, sf, "payment_transactions_enriched").select(ident("transaction_id").alias("txn"), micros("event_timestamp").alias("at_us"), F.col("event_date").cast("date").alias("period"), *[ident(c).alias(c) for c in _TABLES])
    if once:  # copies agree in keys and times up to spelling; stored, as groups and doubtful references both read it
        rows = staged(rows.groupBy("txn").agg(F.min(F.struct("at_us", "period", *_TABLES)).alias("r")).select("txn", "r.*"), "transactions-once")
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("table"), F.col(c).alias("key")) for c in _TABLES])).alias("ref")
    out = rows.select("txn", "at_us", "period", fields).select("txn", "at_us", "period", "ref.*")
    return out.withColumn("probe", _probe(F.col("table") == "merchant_id", F.col("at_us")))


def _parent_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All keys that have a row."""
    rows = []
    for name, field in (("accounts", "account_id"), ("master_data_cdc", "customer_id"), ("merchant_history", "merchant_id"), ("merchant_snapshots", "merchant_id")):
        rows.append(table(spark, sf, name).select(F.lit(field).alias("table"), ident(field).alias("key"), F.lit(None).cast("long").alias("first_us"), F.lit(None).cast("boolean").alias("ceases")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).filter("key is not null")


def _parents(spark: SparkSession, sf: str, versions: DataFrame) -> DataFrame:
    """All keys that have a row, and the life of those that have a version."""
    t = F.split_part("entity", F.lit("|"), F.lit(1))
    lived = versions.filter("entity is not null and key is not null and known_us is not null").select(t.alias("table"), F.expr("substring(entity, instr(entity, '|') + 1)").alias("key"), F.col("known_us").alias("first_us"), F.col("deleted").alias("ceases"))
    return _parent_rows(spark, sf).unionByName(lived)


def _all_versions(spark: SparkSession, sf: str) -> DataFrame:
    # The merchants' history, which four branches read, is derived once.
    merchants = staged(_merchant_versions(spark, sf), "merchant-versions")
    return _customer_versions(spark, sf).unionByName(_account_versions(spark, sf)).unionByName(merchants)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    versions = _all_versions(spark, sf)
    found = references.findings(_parents(spark, sf, versions), versions, _refs(spark, sf), ["txn"])
    return found.select(F.col("txn").alias("transaction_id"), F.col("table").alias("ref_field"), "reason")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Bad references per table, event date and reason."""
    versions = _all_versions(spark, sf)
    out = references.report(_parents(spark, sf, versions), versions, _refs(spark, sf, once=True))
    return out.select(F.col("table").alias("ref_field"), F.date_format("period", "yyyy-MM-dd").alias("event_date"), "reason", "refs")


def p6_missing_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Physical rows with a key that has no parent row, per table and event date, by grouping alone."""
    out = references.missing_by_period(_parent_rows(spark, sf), _refs(spark, sf))
    return out.select(F.col("table").alias("ref_field"), F.date_format("period", "yyyy-MM-dd").alias("event_date"), "orphans")


_RATED = {"customer_risk_rating": "customer_id", "merchant_risk_rating": "merchant_id"}


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    """``txn, rating_field, stored, state, value`` of every physical row and rating."""
    asked = F.explode(F.array(*[F.struct(F.lit(r).alias("rating_field"), F.concat(F.lit(f"{k}|"), ident(k)).alias("entity"), code(r).alias("stored")) for r, k in _RATED.items()])).alias("a")
    rows = table(spark, sf, "payment_transactions_enriched").filter("event_timestamp is not null").select(ident("transaction_id").alias("txn"), micros("event_timestamp").alias("known_us"), asked)
    events = rows.select("txn", "known_us", "a.*").withColumn("key", _probe(F.col("rating_field") == "merchant_risk_rating", F.col("known_us")))
    versions = _customer_versions(spark, sf).unionByName(_merchant_versions(spark, sf))
    return known_time.lookup(events, versions, ["txn", "rating_field", "stored"])


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    wrong = _ratings(spark, sf).filter(~F.col("stored").eqNullSafe(F.col("value")))
    return wrong.select(F.col("txn").alias("transaction_id"), "rating_field").distinct()


def p7_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """The right rating of every transaction."""
    return _ratings(spark, sf).groupBy(F.col("txn").alias("transaction_id"), "rating_field").agg(F.max("value").alias("rating"))


#: Room for record versions behind a time in microseconds; higher ones tie.
_TIES = 4096


def p7_bitemporal(spark: SparkSession, sf: str) -> DataFrame:
    """The customer's rating valid at the event's time, as it was known then and as it was known when the transaction was loaded.

    Known time is when the feed delivered a change, valid time when the change took effect;
    of versions with one time of effect the highest counts.
    """
    valid = lambda c: F.least(micros(c), F.lit((2**63 - 1) // _TIES - 1)) * _TIES
    version = F.least(F.greatest(F.col("record_version").cast("long"), F.lit(0)), F.lit(_TIES - 1))
    versions = table(spark, sf, "master_data_cdc").select(ident("customer_id").alias("entity"), micros("ingested_at").alias("known_us"), (valid("source_updated_at") + version).alias("key"), code("risk_rating").alias("value"), F.coalesce("is_deleted", F.lit(False)).alias("deleted"))
    loaded = micros("bronze_ingested_at")
    asks = F.explode(F.array(F.struct(F.lit("event").alias("known_at"), micros("event_timestamp").alias("known_us")), F.struct(F.lit("load").alias("known_at"), loaded.alias("known_us")))).alias("a")
    rows = table(spark, sf, "payment_transactions_enriched").filter("event_timestamp is not null").select(ident("transaction_id").alias("txn"), ident("customer_id").alias("entity"), (valid("event_timestamp") + (_TIES - 1)).alias("key"), F.coalesce(loaded, F.lit(2**62)).alias("loaded_us"), asks)
    found = known_time.lookup(rows.select("txn", "entity", "key", "loaded_us", "a.*"), versions, ["txn", "known_at", "loaded_us"])
    # Of reloaded copies, which have load times of their own, the first counts.
    one = found.groupBy("txn", "known_at").agg(F.min_by(F.struct("state", "value"), F.struct("loaded_us", "state", "value")).alias("m"))
    return one.select(F.col("txn").alias("transaction_id"), "known_at", "m.state", F.col("m.value").alias("rating"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_exactly_once, p2_found, p2_history, p3_found, p3_current, p4_found, p4_hourly, p4_daily, p5_found, p5_rolling, p6_found, p6_report, p6_missing_rows, p7_found, p7_ratings, p7_bitemporal)}
