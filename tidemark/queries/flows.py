"""Queries that run a flow: streams, ledgers, the dataset graph, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ident, micros, table
from tidemark.operators import exactly_once, features, forecast, metrics, quality, scoring
from tidemark.plans.graph import Graph
from tidemark.queries import base, payments
from tidemark.session import staged, work_dir
from tidemark.sources import files
from tidemark.streaming import flows


def payment_events_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Watermarked deduplication as a triggered stream; the set of trusted events."""
    root = work_dir(spark, "event-stream")
    rows = base.events(spark, sf).filter("event_id is not null and event_timestamp is not null").select("event_id", "event_timestamp", "delay_seconds")
    rows.write.parquet(f"{root}/in")
    stream = files.stream_table(spark, f"{root}/in", rows.schema)
    flows.run(flows.trusted(stream), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").select("event_id")


def cdc_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Account changes as a stream, one file a batch; the current state."""
    root = work_dir(spark, "cdc-stream")
    rows = base.account_changes(spark, sf).select("account_id", "customer_id", "account_type", "account_currency", "account_status", "record_version", "source_updated_at", "is_deleted")
    rows.repartition(3, "record_version").write.parquet(f"{root}/in")
    feed = flows.ChangeFeed(spark, f"{root}/log", "account_id")
    flows.run_batches(files.stream_table(spark, f"{root}/in", rows.schema, 1), feed.step, f"{root}/checkpoint")
    return feed.current().select("account_id", "customer_id", "account_type", "account_status", "record_version")


def late_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly aggregates kept by retraction over micro-batches in order of arrival."""
    root = work_dir(spark, "late-stream")
    raw = table(spark, sf, "payment_events")
    arrival = F.coalesce(micros("simulated_arrival_at"), micros("kafka_timestamp"))
    kept = exactly_once.keep_one_narrow(raw, ident("event_id"), arrival, payments.POSITION, {"event_us": micros("event_timestamp"), "arrival_us": arrival, "amount": F.col("amount")})
    kept.select("event_us", "arrival_us", "amount").repartitionByRange(4, "arrival_us").write.parquet(f"{root}/in")
    held = flows.LateAggregates(spark, f"{root}/agg")
    flows.run_batches(files.stream_table(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema, 1), held.step, f"{root}/checkpoint")
    net = held.log().groupBy("period").agg(F.sum(F.col("mult") * F.col("n")).alias("n"), F.sum(F.col("mult") * F.col("amount")).cast("double").alias("amount"))
    return net.select(F.date_format(F.timestamp_micros("period"), "yyyy-MM-dd HH").alias("event_hour"), F.col("n").alias("event_count"), F.col("amount").alias("amount_sum"))


def load_once(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON-lines export loaded twice through the ledger: the second time adds nothing."""
    root = work_dir(spark, "load-once")
    tx = base.transactions(spark, sf).filter("event_date is not null")
    out = tx.select("transaction_id", "account_id", "merchant_id", F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("event_timestamp"), F.col("amount").cast("string").alias("amount"), "currency", "channel", "payment_method", F.col("transaction_status").alias("status"), "card_present", "country", F.date_format("event_date", "yyyy-MM").alias("event_date"))
    files.export({"transactions": out}, root)
    ledger, rows = files.Ledger(spark, f"{root}/ledger"), files.transactions(spark, f"{root}/historical/transactions", "2026-08-01 00:00:00")
    first = ledger.load("transactions", rows, f"{root}/table")
    second = ledger.load("transactions", rows, f"{root}/table")
    loaded = spark.read.parquet(f"{root}/table")
    return loaded.groupBy("transaction_status" if "transaction_status" in loaded.columns else "status").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").cast("double").alias("amount_sum")).withColumns({"loaded_first": F.lit(first > 0), "loaded_again": F.lit(second)})


def medallion() -> Graph:
    """Standardise, classify, split and aggregate, as declared datasets."""
    graph = Graph()
    rules = quality.transaction_rules()

    @graph.dataset(inputs=["transactions"], kind="materialized_view", private=True, rules=rules)
    def classified(tx: DataFrame) -> DataFrame:
        return quality.classify(tx, rules)

    @graph.dataset(inputs=["classified"], keys=("transaction_id",))
    def validated(rows: DataFrame) -> DataFrame:
        return quality.split(rows)[0]

    @graph.dataset(inputs=["classified"])
    def quarantine(rows: DataFrame) -> DataFrame:
        return quality.split(rows)[1]

    @graph.dataset(inputs=["validated"], kind="view")
    def daily(rows: DataFrame) -> DataFrame:
        return rows.groupBy("event_date", "currency").agg(F.count(F.lit(1)).alias("payments"), metrics.total("amount").alias("amount_sum"))

    return graph


def dataset_graph(spark: SparkSession, sf: str) -> DataFrame:
    made, _ = medallion().run(spark, {"transactions": base.transactions(spark, sf)}, work_dir(spark, "graph"))
    return made["daily"].withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd"))


FEATURES = ["amount", "amount_log1p", "hour_of_day", "is_weekend", "is_cross_border", "is_card_not_present", "is_pos", "is_ecommerce"]


def _model_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every transaction with its features, its label, and its split; without a time it has none and is only scored."""
    at, label = "transaction_event_timestamp", F.coalesce(F.col("transaction_status") == "DECLINED", F.lit(False)).cast("int").alias("label")
    rows = features.transaction_features(base.transactions(spark, sf), keep=[label]).select("transaction_id", at, "label", *[F.col(n).cast("double").alias(n) for n in FEATURES])
    # Stored once: the cuts of the split and the iterative fits read it many times.
    kept = staged(features.finite(rows, FEATURES), "training")
    usable = F.col(at).isNotNull() & F.col("transaction_id").isNotNull()
    return features.temporal_split(kept, at, "transaction_id").withColumn("split", F.when(usable, F.col("split")))


def _best_model(rows: DataFrame) -> tuple:
    """Both candidates fitted on the earliest part, chosen with their threshold on the next; the better one is fitted again on both parts."""
    parts = {s: rows.filter(F.col("split") == s) for s in ("train", "validation")}
    fitted = scoring.fit_candidates(parts["train"], FEATURES, "label")
    best, best_key = None, None
    for name, model in fitted.items():
        scored = scoring.predict(model, parts["validation"], 0.5)
        ap = scoring.areas(scoring.curve(scored, "fraud_probability", "label")).first()["average_precision"] or 0.0
        cut = scoring.best_threshold(scoring.at_thresholds(scored, "fraud_probability", "label", scoring.THRESHOLDS)).first()
        if best_key is None or (ap, cut["f2"]) > best_key:
            best, best_key = (name, cut["threshold"], ap), (ap, cut["f2"])
    name, threshold, ap = best
    return name, scoring.fit_candidates(rows.filter("split in ('train', 'validation')"), FEATURES, "label", [name])[name], threshold, ap


def fraud_model(spark: SparkSession, sf: str) -> DataFrame:
    """Choose on unseen rows, fit again, and score the last part once."""
    rows = _model_rows(spark, sf)
    name, model, threshold, _ = _best_model(rows)
    return scoring.predict(model, rows.filter("split = 'test'"), threshold, model_name=name, model_version="1").select("transaction_id", "label", "fraud_probability", "predicted_fraud", "model_name", "model_version")


def model_gates(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen model on the last part against the gates of a promotion."""
    scored = fraud_model(spark, sf)
    threshold = 0.0  # decisions are made already
    at = scoring.at_thresholds(scored.withColumn("decided", F.col("predicted_fraud").cast("double") - 0.5), "decided", "label", [threshold]).select("recall", "f2")
    ap = scoring.areas(scoring.curve(scored, "fraud_probability", "label")).select("average_precision")
    rate = scored.agg(F.avg("label").alias("base_rate"), F.max("model_name").alias("path"))
    checked = scoring.gates(at.join(ap).join(rate), scoring.promotion_checks())  # one row each
    return checked.select("path", "average_precision", "base_rate", "recall", "f2", F.array_join("failed_gates", ",").alias("failed_gates"), "passed")


def forecast_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Daily payments ahead: a fitted line over lags and calendar, forecast day by day, against last week's value; the better one on unseen days tells the last ones."""
    from tidemark.queries import core

    series = [(r["d"], r["y"]) for r in core._series(spark, sf).orderBy("d").collect()]  # one row per day
    return spark.createDataFrame(forecast.selection(series, 7), "d date, y double, forecast double, method string, validation_mae double")


def transaction_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Batch scoring: the registered champion applied to every transaction."""
    rows = _model_rows(spark, sf)
    out = ["transaction_id", F.col("transaction_event_timestamp").alias("event_timestamp"), "fraud_probability", "predicted_fraud", "model_name", "model_version", "model_alias"]
    if rows.isEmpty():
        return rows.withColumns({"fraud_probability": F.lit(0.0), "predicted_fraud": F.lit(0), **{c: F.lit("") for c in out[4:]}}).select(*out)
    name, model, threshold, ap = _best_model(rows)
    path = f"{work_dir(spark, 'champion')}/model"
    model.write().save(path)
    registry = scoring.Registry(spark, work_dir(spark, "registry"))
    registry.promote(name, registry.register(name, path, {"average_precision": ap, "threshold": threshold}))
    model, threshold, columns = scoring.champion(registry, name)
    return scoring.predict(model, rows, threshold, **columns).select(*out)


def queries() -> dict:
    return {f.__name__: f for f in (payment_events_stream, cdc_stream, late_stream, load_once, dataset_graph, fraud_model, transaction_scores, model_gates, forecast_selection)}
