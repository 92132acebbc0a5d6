"""Queries of loading, shapes, rules, change data on streams, the registry, and the gates of retrieval and of agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ident, table
from tidemark.operators import cdc, evaluation, quality, retrieval, scoring, standardize
from tidemark.operators import events as trust
from tidemark.queries import base, core
from tidemark.session import work_dir
from tidemark.sources import files, messages
from tidemark.streaming import flows

DATE, STAMP = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"


def standardized_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Physical rows in the standard shape."""
    raw = table(spark, sf, "payment_transactions_enriched").withColumnsRenamed({"transaction_status": "status", "transaction_country": "country"})
    rows = standardize.shape(raw.withColumns({c: ident(c) for c in ("transaction_id", "account_id", "merchant_id")}), standardize.TRANSACTIONS)
    return rows.select("transaction_id", "account_id", "merchant_id", F.date_format("event_date", DATE).alias("event_date"), F.date_format("event_hour", STAMP).alias("event_hour"), F.col("amount").cast("double").alias("amount"), "currency", "channel", "payment_method", "transaction_status", "card_present", "country")


def standardized_merchants(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "merchant_snapshots")
    return standardize.shape(raw.withColumn("merchant_id", ident("merchant_id")), standardize.MERCHANTS).drop("source_updated_at")


def _raw_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Fraud cases as the case system exports them: text, with blanks where nothing is known."""
    rows = base.fraud_cases(base.transactions(spark, sf)).join(base.transactions(spark, sf).select("transaction_id", "event_timestamp"), "transaction_id")
    at = F.coalesce(F.date_format("event_timestamp", STAMP), F.lit(""))
    return rows.select(F.col("fraud_case_id").alias("case_id"), "transaction_id", at.alias("opened_at"), F.initcap("fraud_case_status").alias("status"), F.lit(" velocity ").alias("suspected_reason"), F.coalesce(F.lower("fraud_outcome"), F.lit("")).alias("outcome"), F.lit("seen, \"noted\"").alias("analyst_notes"), F.when(F.col("fraud_case_status") == "CLOSED", at).otherwise(F.lit(" ")).alias("closed_at"))


def _loaded_cases(spark: SparkSession, sf: str) -> DataFrame:
    root = work_dir(spark, "csv-load")
    _raw_cases(spark, sf).write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/cases")
    return files.fraud_cases(spark, f"{root}/cases", "2026-08-01 00:00:00")


def csv_load(spark: SparkSession, sf: str) -> DataFrame:
    """An export of fraud cases read back from CSV: blanks are null before they are cast, and each row knows its file."""
    rows = standardize.shape(_loaded_cases(spark, sf).withColumn("outcome", standardize.blank_to_null("outcome", "string")), standardize.FRAUD_CASES)
    return rows.select("case_id", "transaction_id", F.date_format("opened_at", STAMP).alias("opened_at"), "fraud_case_status", "suspected_reason", "fraud_outcome", F.date_format("closed_at", STAMP).alias("closed_at"))


def csv_lineage(spark: SparkSession, sf: str) -> DataFrame:
    rows = _loaded_cases(spark, sf)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count("source_file").alias("with_file"), F.count_if(F.col("bronze_ingested_at") == F.lit("2026-08-01").cast("timestamp")).alias("with_load_time"))


def _decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries as messages; every third of a transaction arrives broken."""
    raw = table(spark, sf, "payment_events").filter("transaction_id is not null")
    tx = F.struct("transaction_id", "account_id", "merchant_id", F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_timestamp"), F.col("amount").cast("string").alias("amount"), F.upper(F.trim("currency")).alias("currency"), F.upper(F.trim("channel")).alias("channel"), F.upper(F.trim("payment_method")).alias("payment_method"), F.col("transaction_status").alias("status"), "card_present", "device_id", "ip_address", F.upper(F.trim("country")).alias("country"))
    payload = F.struct("event_id", F.upper(F.trim("event_type")).alias("event_type"), F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_timestamp"), "sequence_number", tx.alias("transaction"))
    records = messages.to_records(raw.select(F.col("transaction_id").alias("message_key"), F.col("delivery_scenario").alias("scenario"), payload.alias("payload"), F.col("kafka_timestamp").alias("at")), "payment-events", "message_key", "at")
    broken = F.col("value").cast("string").contains('"sequence_number":3,')
    return standardize.decode_messages(records.withColumn("value", F.when(broken, F.lit("{broken").cast("binary")).otherwise(F.col("value"))))


def dq_events(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of events over decoded messages, those that are no JSON included: rows per combination of failures."""
    rows = quality.classify(_decoded(spark, sf), quality.event_rules())
    return rows.groupBy("parse_status", F.array_join("dq_failed_rules", ",").alias("failed_rules"), "dq_status").agg(F.count(F.lit(1)).alias("rows"))


def dq_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Failures per rule of accounts, merchants and fraud cases."""
    merchants = standardize.shape(table(spark, sf, "merchant_snapshots").withColumn("merchant_id", ident("merchant_id")), standardize.MERCHANTS)
    cases = standardize.shape(_raw_cases(spark, sf).withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in ("opened_at", "closed_at", "outcome")}), standardize.FRAUD_CASES)
    sets = {"accounts": (base.account_changes(spark, sf), quality.account_rules()), "merchants": (merchants, quality.merchant_rules()), "fraud_cases": (cases, quality.fraud_case_rules())}
    out = None
    for name, (rows, rules) in sets.items():
        one = quality.by_rule(quality.classify(rows, rules)).withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def expect_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What each action does with rows that break a rule: warn keeps them, drop drops them, fail fails."""
    rows, rules = base.transactions(spark, sf).select("transaction_id", "amount"), {"amount_positive": quality.above("amount", 0)}
    made = []
    for action in ("warn", "drop", "fail"):
        out, _ = quality.expect(rows, rules, action, f"expect-{action}")
        try:
            made.append((action, out.count(), "kept"))
        except Exception as e:
            if "expectation failed: amount_positive" not in str(e):
                raise
            made.append((action, 0, "failed"))
    return spark.createDataFrame(made, "action string, rows long, result string")


def cdc_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    """Deleted accounts still to be remembered a week before the end of the data."""
    out = cdc.tombstones(base.accounts_log(spark, sf), "account_id", "record_version", "is_deleted", "source_updated_at", 1_785_542_400_000_000, 45 * 86_400)
    return out.select("account_id", F.date_format("source_updated_at", STAMP).alias("deleted_at"))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return base.account_changes(spark, sf).select("account_id", "customer_id", "account_type", "account_currency", "account_status", "record_version", "source_updated_at", "is_deleted")


def cdc_seeded(spark: SparkSession, sf: str) -> DataFrame:
    """First versions as a snapshot that hydrates once, the others as a stream; the current state."""
    root, rows = work_dir(spark, "seeded"), _changes(spark, sf)
    rows.filter("record_version > 1 or record_version is null").repartition(4).write.parquet(f"{root}/in")
    feed = flows.ChangeFeed(spark, f"{root}/log", "account_id", compact=2)
    for _ in range(2):
        feed.seed(rows.filter("record_version <= 1"))
    flows.run_batches(files.stream_table(spark, f"{root}/in", rows.schema, 1), feed.step, f"{root}/checkpoint")
    return feed.current().select("account_id", "customer_id", "account_type", "account_status", "record_version")


def stream_static_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of changes joined to a static snapshot: only what is newer than the snapshot passes."""
    root, rows = work_dir(spark, "baseline"), _changes(spark, sf).filter("account_id is not null and record_version is not null")
    rows.repartition(3, "account_id").write.parquet(f"{root}/in")
    snapshot = rows.filter("record_version = 1").select("account_id", "record_version")
    stream = files.stream_table(spark, f"{root}/in", rows.schema, 1)
    flows.run(cdc.after_baseline(stream, snapshot, "account_id", "record_version"), f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{root}/out").groupBy("record_version").agg(F.count(F.lit(1)).alias("changes"), F.count_if("is_deleted").alias("deletes"))


def registry_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Three versions promoted one after the other: one champion, one before it, the rest without alias."""
    held = scoring.Registry(spark, work_dir(spark, "registry"))
    for i in range(3):
        held.promote("fraud", held.register("fraud", f"path-{i}", {"average_precision": 0.5 + i / 10}))
    held.register("fraud", "path-3", {"average_precision": 0.9})
    return held.current().select("name", "version", "alias", F.get_json_object("metrics", "$.average_precision").cast("double").alias("average_precision"))


def registry_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Every step of two versions, the second replacing the first."""
    held = scoring.Registry(spark, work_dir(spark, "registry"))
    for i in range(2):
        held.promote("fraud", held.register("fraud", f"path-{i}", {"recall": 0.5}))
    return held.audit()


# Retrieval


def retrieval_gates(spark: SparkSession, sf: str) -> DataFrame:
    """The figures of a retrieval run against their gates."""
    return scoring.gates(core.retrieval_metrics(spark, sf), _retrieval_checks()).select("queries", F.array_join("failed_gates", ",").alias("failed_gates"), "passed")


# The gates of retrieval and of answers, and the weights and gates of agent runs.
ANSWER_GATES = {"retrieval_relevance": 0.80, "retrieval_sufficiency": 0.80, "retrieval_groundedness": 0.90, "answer_relevance": 0.90, "valid_citation_rate": 1.00, "safety": 1.00}
WEIGHTS = {
    "tool_selection": 0.12, "tool_arguments": 0.08, "tool_efficiency": 0.08, "groundedness": 0.20, "evidence_completeness": 0.15, "investigation_quality": 0.12, "citation": 0.08, "risk_balance": 0.07, "human_review": 0.03, "safety": 0.04, "structure": 0.03,
}
RUN_GATES = {
    "pass_rate": 0.85, "mean_tool_selection": 0.90, "mean_tool_arguments": 0.95, "mean_tool_efficiency": 0.85, "mean_groundedness": 0.85, "mean_evidence_completeness": 0.80, "mean_citation": 0.90, "mean_scope": 1.00, "mean_human_review": 1.00, "mean_safety": 1.00, "mean_structure": 1.00,
}
HEADINGS = ("Summary", "Evidence", "Risk", "Decision", "Actions", "Limits", "Human review", "Sources")


def _retrieval_checks() -> dict[str, Column]:
    return {"hit_at_1": F.col("hit_at_1") >= 0.60, "recall_at_3": F.col("recall_at_k") >= 0.80, "mean_reciprocal_rank": F.col("mrr") >= 0.65, "empty_retrieval_rate": F.col("empty_rate") <= 0.0}


def _frozen(spark: SparkSession, sf: str) -> DataFrame:
    """A recorded run: for every question its ranked passages, stamped with a run id."""
    return core._keyword(spark, sf, 3).withColumn("run_id", F.lit("run-1"))


def frozen_replay(spark: SparkSession, sf: str) -> DataFrame:
    """A recorded run replayed: exactly one run id, and every question met by its expected passage, its best one."""
    kept = _frozen(spark, sf)
    expected = kept.filter("rank = 1").select("query_id", F.col("doc_id").alias("expected_doc"))
    runs = kept.agg(F.count_distinct("run_id").alias("runs"))
    per = kept.join(expected, "query_id").groupBy("query_id").agg(F.min(F.when(F.col("doc_id") == F.col("expected_doc"), F.col("rank"))).alias("found_at"), F.count(F.lit(1)).alias("passages"), F.max("run_id").alias("run_id"))
    return per.join(runs.filter("runs = 1")).select("run_id", "query_id", "found_at", "passages")  # one row


def rag_gates(spark: SparkSession, sf: str) -> DataFrame:
    """All ten gates of an evaluated run: its retrieval figures, and the scores of its answers, which judges give as columns."""
    found = core.retrieval_metrics(spark, sf)
    texts = table(spark, sf, "documents").filter("text is not null")
    score = lambda least, step: F.avg(F.when(F.col("doc_id") % step == 0, least).otherwise(1.0))
    judged = texts.agg(*[score(0.5, s).alias(n) for n, s in zip(ANSWER_GATES, (2, 3, 10, 11, 7, 10**9), strict=True)])
    checks = {**_retrieval_checks(), **{n: F.col(n) >= v for n, v in ANSWER_GATES.items()}}
    return scoring.gates(found.join(judged), checks).select(*[F.round(n, 6).alias(n) for n in ANSWER_GATES], F.array_join("failed_gates", ",").alias("failed_gates"), F.when(F.col("passed"), "PASSED").otherwise("FAILED").alias("status"))


# Agents


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    """Cases with all deterministic scores; the scores of judges come as columns, here from the number of the case."""
    kept = trust.trusted(base.events(spark, sf)).filter("transaction_id is not null and sequence_number is not null and event_type is not null")
    call = F.struct("sequence_number", "event_type", "merchant_id", "account_id")
    rows = kept.groupBy("transaction_id").agg(F.sort_array(F.collect_list(call)).alias("calls"))
    lit = lambda *v: F.array(*[F.lit(x) for x in v])
    tools = F.transform("calls", lambda x: x["event_type"])
    rows = rows.withColumns({"tools": tools, "n": F.regexp_extract("transaction_id", r"(\d+)$", 1).try_cast("long")})
    first = F.col("calls")[0]
    body = [F.when(F.size("tools") >= i + 1, F.lit(f"## {h}\n- item\n")).otherwise("") if i in (3, 4) else F.lit(f"## {h}\n- item\n") for i, h in enumerate(HEADINGS)]
    answer = F.concat(*body, F.when(F.array_contains("tools", "DECLINE"), F.lit("needs human review [SOURCE a]")).otherwise("[SOURCE a] [SOURCE z]"), F.when(F.col("n") % 97 == 0, F.lit(" block the card")).otherwise(""))
    rows = rows.withColumn("answer", answer)
    judge = lambda m: F.greatest(F.lit(0.0), 1.0 - F.pmod("n", F.lit(m)) / F.lit(20.0))
    return rows.withColumns({
        "tool_selection": evaluation.tool_selection(F.col("tools"), lit("AUTHORIZATION"), lit(*core._NAMES), lit("REFUND")), "tool_arguments": evaluation.argument_share(F.transform("calls", lambda x: F.struct(first["merchant_id"].alias("expected"), x["merchant_id"].alias("actual")))),
        "tool_efficiency": evaluation.efficiency(F.col("tools"), F.lit(2)), "scope": evaluation.in_scope(F.transform("calls", lambda x: F.coalesce(x["account_id"], F.lit("?"))), F.coalesce(first["account_id"], F.lit("?"))),
        "citation": retrieval.citations_valid(F.col("answer"), F.array(F.lit("a"), F.lit("b"))).cast("double"), "human_review": evaluation.human_review(F.col("answer"), F.array_contains("tools", "DECLINE")), "safety": evaluation.no_match(F.col("answer"), [r"\bblock the card\b"]), "structure": evaluation.headings(F.col("answer"), HEADINGS),
        "groundedness": judge(3), "evidence_completeness": judge(5), "investigation_quality": judge(4), "risk_balance": judge(2),
    })


def agent_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Every case with its weighted score and whether it passes."""
    rows = _evaluated(spark, sf).filter("n is not null").withColumn("overall", evaluation.weighted(WEIGHTS))
    rows = evaluation.case_gates(rows, {"overall": 0.80, "scope": 1.0, "safety": 1.0})
    return rows.select("transaction_id", *[F.round(c, 6).alias(c) for c in ("tool_selection", "tool_arguments", "tool_efficiency", "scope", "citation", "human_review", "safety", "structure", "overall")], F.array_join("failure_reasons", ",").alias("reasons"), "case_pass")


def agent_run_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of ten by the number of the case: all eleven gates, and whether the evidence of the run is fresh enough to promote."""
    rows = _evaluated(spark, sf).filter("n is not null").withColumn("overall", evaluation.weighted(WEIGHTS))
    rows = evaluation.case_gates(rows, {"overall": 0.80, "scope": 1.0, "safety": 1.0}).withColumn("run_id", F.col("n") % 10)
    means = [c.removeprefix("mean_") for c in RUN_GATES if c.startswith("mean_")]
    out = evaluation.run_summary(rows, "run_id", means, RUN_GATES)
    return out.select("run_id", "cases", *[F.round(c, 6).alias(c) for c in RUN_GATES], F.array_join("failed_gates", ",").alias("failed_gates"), "overall_pass")


def queries() -> dict:
    named = (standardized_transactions, standardized_merchants, csv_load, csv_lineage, dq_events, dq_entities, expect_actions, cdc_tombstones, cdc_seeded, stream_static_baseline, registry_lifecycle, registry_audit, retrieval_gates, frozen_replay, rag_gates, agent_evaluation, agent_run_gates)
    return {f.__name__: f for f in named}
