"""Operators of the relational core on exact small fixtures."""

import json
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import late, cdc, evaluation, features, forecast, governance, joins, merge, metrics, ops, quality, reconcile, retrieval, scoring, standardize
from tidemark.operators import events as trust
from tidemark.plans.graph import Graph
from tidemark.sources import files, messages, schemas
from tidemark.streaming import flows

T0 = datetime(2026, 6, 1)


# Change data


def versions(spark, rows):
    return spark.createDataFrame([(k, v, d, T0 + timedelta(days=v), n) for k, v, d, n in rows], "k string, v int, gone boolean, at timestamp, name string")


def test_cdc_out_of_order_delete(spark):
    log = cdc.change_log(versions(spark, [("c1", 1, False, "a"), ("c1", 3, True, None), ("c1", 2, False, "b"), ("c2", 1, False, "x"), ("c2", 2, False, "y"), ("c2", 2, False, "y")]), "k", "v", "gone", "at")
    assert {(r.k, r.v) for r in cdc.scd1(log, "k", "v", "gone").collect()} == {("c2", 2)}
    got = {(r.k, r["__START_AT"], r["__END_AT"]) for r in cdc.scd2(log, "k", "v", "gone").collect()}
    assert got == {("c1", 1, 2), ("c1", 2, 3), ("c2", 1, 2), ("c2", 2, None)}
    assert cdc.invariant(cdc.scd1(log, "k", "v", "gone"), cdc.scd2(log, "k", "v", "gone")).first()["status"] == "PASS"


@settings(max_examples=6, deadline=None)
@given(st.permutations([("c1", 1, False, "a"), ("c1", 2, False, "b"), ("c1", 3, True, None), ("c2", 1, False, "x"), ("c2", 2, False, "y")]), st.integers(1, 4))
def test_change_feed_any_permutation_and_split(spark, tmp_path_factory, rows, cut):
    feed = flows.ChangeFeed(spark, str(tmp_path_factory.mktemp("feed")), "k", "v", "gone", "at")
    for i, part in enumerate((rows[:cut], rows[cut:])):
        feed.step(versions(spark, part), i)
        feed.step(versions(spark, part), i)  # delivered again after a failure
    assert {(r.k, r.v, r.name) for r in feed.current().collect()} == {("c2", 2, "y")}
    assert feed.history().count() == 4


def test_change_feed_compacts(spark, tmp_path):
    whole, cut = (flows.ChangeFeed(spark, str(tmp_path / n), "k", "v", "gone", "at", compact=c) for n, c in (("whole", 100), ("cut", 2)))
    for i in range(7):
        rows = versions(spark, [(f"c{j}", i + 1, i == 5 and j == 0, f"{i}-{j}") for j in range(3)] + [("c0", 1, False, "0-0")])
        for feed in (whole, cut):
            feed.step(rows, i)
    cut.step(rows, 6)  # delivered again
    same = lambda df: sorted(map(str, df.collect()))
    assert same(cut.current()) == same(whole.current()) and same(cut.history()) == same(whole.history())
    assert {f.split("/")[-2] for f in cut.log().inputFiles()} == {"base=00000005", "batch=00000006"}


def test_late_aggregates_compact_and_expire(spark, tmp_path):
    h = late.HOUR
    whole, cut = flows.LateAggregates(spark, str(tmp_path / "w"), compact=100), flows.LateAggregates(spark, str(tmp_path / "c"), compact=2, slack_us=2 * h)
    batch = lambda rows: spark.createDataFrame(rows, "event_us long, arrival_us long, amount double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    for i in range(9):
        rows = batch([(i * 6 * h, i * 6 * h + 1, 1.0), (i * 6 * h - 3 * h, i * 6 * h + 2, 2.0), (i * 6 * h - 20 * h, i * 6 * h + 3, 50.0)])
        for held in (whole, cut):
            held.step(rows, i)
            held.step(rows, i)  # delivered again
    net = lambda held: sorted(map(tuple, held.log().groupBy("period").agg(F.sum(F.expr("mult * n")), F.sum(F.expr("mult * amount")).cast("double")).collect()))
    assert net(cut) == net(whole) and len(net(cut)) == 18
    assert cut.state().count() < whole.state().count() == 18
    with pytest.raises(Exception, match="expired"):
        cut.step(batch([(0, h, 1.0)]), 9)


def test_seed_once(spark, tmp_path):
    feed = flows.ChangeFeed(spark, str(tmp_path / "f"), "k", "v", "gone", "at")
    feed.seed(versions(spark, [("a", 1, False, "seed")]))
    feed.seed(versions(spark, [("a", 1, False, "other")]))
    assert [r.name for r in feed.current().collect()] == ["seed"]


def test_baseline_and_tombstones(spark):
    changes = versions(spark, [("a", 1, False, "x"), ("a", 2, False, "y"), ("new", 1, False, "z")])
    out = cdc.after_baseline(changes, versions(spark, [("a", 1, False, "x")]), "k", "v")
    assert {(r.k, r.v) for r in out.collect()} == {("a", 2), ("new", 1)}
    log = cdc.change_log(versions(spark, [("a", 1, True, None), ("b", 1, False, "x")]), "k", "v", "gone", "at")
    at = int((T0 + timedelta(days=1)).timestamp() * 1e6)
    day = 86_400_000_000
    assert [r.k for r in cdc.tombstones(log, "k", "v", "gone", "at", at + 2 * day).collect()] == ["a"]
    assert cdc.tombstones(log, "k", "v", "gone", "at", at + 9 * day).count() == 0


# Merge


def test_merge_variants(spark):
    target = spark.createDataFrame([(1, "a", "c0", "u0"), (2, None, "c0", "u0"), (3, "z", "c0", "u0")], "id int, v string, created string, updated string")
    source = spark.createDataFrame([(1, "a"), (2, "b"), (4, "n")], "id int, v string")
    out = merge.merge(target, source, ["id"], only_changed=True, delete_missing=True, keep=["created"], stamp={"updated": F.lit("u1"), "created": F.lit("c1")})
    assert {tuple(r) for r in out.collect()} == {(1, "a", "c0", "u0"), (2, "b", "c0", "u1"), (4, "n", "c1", "u1")}
    assert merge.merge(target, source, ["id"]).count() == 4
    with pytest.raises(merge.DuplicateKeys):
        merge.merge(target, source.union(source), ["id"])
    assert {(r.id, r.action) for r in merge.changes(target.select("id", "v"), source, ["id"]).collect()} == {(1, "SAME"), (2, "UPDATE"), (3, "DELETE"), (4, "INSERT")}


# Joins


@pytest.mark.parametrize("seed", range(3))
def test_asof_brute_force(spark, seed):
    rnd = random.Random(seed)
    at = lambda: T0 + timedelta(seconds=rnd.randrange(0, 40 * 3600))
    left = [(i, rnd.choice(["a", "b", "none"]), at()) for i in range(60)]
    right = sorted({(rnd.choice(["a", "b"]), at()) for _ in range(40)})
    right = [(k, t, f"v{i}") for i, (k, t) in enumerate(right)]
    out = joins.asof(spark.createDataFrame(left, "i int, k string, t timestamp"), spark.createDataFrame(right, "k string, rt timestamp, v string"), ["k"], "t", "rt", ["v"], bucket_seconds=7200)
    got = {r.i: r.v for r in out.collect()}
    for i, k, t in left:
        seen = [(rt, v) for rk, rt, v in right if rk == k and rt <= t]
        assert got[i] == (max(seen)[1] if seen else None)


def test_in_force_overlaps_and_open_ends(spark):
    use = spark.createDataFrame([(1, "s", T0), (2, "s", T0 + timedelta(days=400)), (3, "other", T0)], "i int, sku string, at timestamp")
    price = spark.createDataFrame([("s", T0 - timedelta(days=9), None, 1.0), ("s", T0 - timedelta(days=3), T0 + timedelta(days=3), 2.0)], "p string, s timestamp, e timestamp, price double")
    out = joins.in_force(use, price, {"sku": "p"}, "at", "s", "e", ["i"], F.col("s"), ["price"])
    assert {(r.i, r.price) for r in out.collect()} == {(1, 2.0), (2, 1.0), (3, None)}


def test_differences_keep_multiplicities(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted((r.x, r.only_in) for r in joins.differences(a, b).collect()) == [(1, "left"), (2, "left"), (3, "right")]


def test_star_fans_out_and_refuses_clashes(spark):
    f = spark.createDataFrame([(1,), (2,)], "t int")
    cases = spark.createDataFrame([(1, "x"), (1, "y")], "t2 int, c string")
    assert joins.star(f, [("case", cases, "t", "t2")]).count() == 3
    with pytest.raises(ValueError):
        joins.star(f.withColumn("c", F.lit(1)), [("case", cases, "t", "t2")])


# Quality


def test_null_fails_and_order_of_rules(spark):
    rows = spark.createDataFrame([("t", None), (" ", 1), ("u", 2)], "id string, n int")
    rules = {"id_present": quality.filled("id"), "n_positive": quality.above("n", 1)}
    got = [r.dq_failed_rules for r in quality.classify(rows, rules).collect()]
    assert got == [["n_positive"], ["id_present", "n_positive"], []]
    good, bad = quality.split(quality.classify(rows, rules))
    assert (good.count(), bad.count()) == (1, 2)


def test_rule_sets_have_their_sizes():
    pytest.importorskip("pyspark")
    assert [len(f()) for f in (quality.event_rules, quality.transaction_rules, quality.customer_rules, quality.account_rules, quality.merchant_rules, quality.fraud_case_rules)] == [16, 10, 7, 8, 8, 6]


def test_expectations(spark):
    rows = spark.createDataFrame([(1,), (None,), (-1,)], "n int")
    rules = {"positive": quality.above("n", 0)}
    kept, watch = quality.expect(rows, rules, "drop", "d")
    assert kept.count() == 1 and watch.get == {"rows": 3, "positive": 2}
    warned, watch = quality.expect(rows, rules, "warn", "w")
    assert warned.count() == 3 and watch.get["positive"] == 2
    with pytest.raises(Exception, match="expectation failed: positive"):
        quality.expect(rows, rules, "fail", "f")[0].collect()


# Events


def test_exception_fixture(spark):
    def d(event, txn, seq, at, delay, scenario, offset):
        t = T0 + timedelta(seconds=at)
        return (event, txn, seq, t, scenario, t + timedelta(seconds=delay), 0, offset, t + timedelta(seconds=delay), delay)

    rows = [d("e1", "t1", 1, 0, 5, "NORMAL", 0), d("e2", "t1", 2, 60, 5, "NORMAL", 1), d("e1", "t1", 1, 0, 15, "DUPLICATE", 2), d("e4", "t2", 2, 60, 0, "OUT_OF_ORDER", 3), d("e3", "t2", 1, 60, 30, "OUT_OF_ORDER", 4), d("e5", "t3", 1, 0, 4 * 3600, "LATE", 5)]
    ev = spark.createDataFrame(rows, "event_id string, transaction_id string, sequence_number long, event_timestamp timestamp, delivery_scenario string, simulated_arrival_at timestamp, kafka_partition int, kafka_offset long, kafka_timestamp timestamp, delay_seconds long")
    once = trust.trusted(ev)
    assert once.count() == 5 and once.filter("event_arrival_classification = 'LATE_ACCEPTED'").count() == 1
    got = sorted((r.event_id, r.delivery_scenario, tuple(r.exception_types)) for r in trust.exceptions(ev).collect())
    assert got == [("e1", "DUPLICATE", ("DUPLICATE",)), ("e1", "NORMAL", ("DUPLICATE",)), ("e3", "OUT_OF_ORDER", ("OUT_OF_ORDER",)), ("e5", "LATE", ("LATE",))]


def test_decode_bad_payloads(spark):
    good = json.dumps({"simulated_arrival_at": "2026-06-01T00:00:00Z", "scenario": "NORMAL", "payload": {"event_id": "e", "event_type": "X", "event_timestamp": "nonsense", "sequence_number": 1, "transaction": {"transaction_id": "t", "amount": "1.5", "status": "settled"}}})
    values = [good, "not json", None, good.replace("1.5", "much")]
    records = spark.createDataFrame([(b"k", None if v is None else v.encode(), "topic", 0, i, T0, 0) for i, v in enumerate(values)], schemas.KAFKA)
    got = {r.kafka_offset: r for r in standardize.decode_messages(records).collect()}
    assert [got[i].parse_status for i in range(4)] == ["PARSED", "INVALID_JSON", "INVALID_JSON", "PARSED"]
    assert float(got[0].amount) == 1.5 and got[0].transaction_status == "SETTLED" and got[0].event_timestamp is None and got[3].amount is None


def test_records_have_contiguous_offsets_and_refuse_bad_envelopes(spark):
    env = spark.createDataFrame([(f"t{i % 5}", (i,), T0 + timedelta(seconds=i)) for i in range(40)], "k string, payload struct<a:int>, at timestamp")
    out = messages.to_records(env, "topic", "k", "at").collect()
    by = {}
    for r in out:
        by.setdefault(r.partition, []).append(r.offset)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(out) == 40
    with pytest.raises(Exception, match="envelope without key or payload"):
        messages.to_records(spark.createDataFrame([(None, (1,), T0)], "k string, payload struct<a:int>, at timestamp"), "topic", "k", "at").collect()


# Features and scores


def test_behaviour_peers_and_strict_past(spark):
    s = lambda x: T0 + timedelta(seconds=x)
    rows = [("c", s(0), 10, "DECLINED", "NZ", True), ("c", s(0), 5, "SETTLED", "AU", None), ("c", s(86_400), 1, None, None, False), ("c", s(86_401), 2, "SETTLED", "AU", True), ("c", s(7 * 86_400 + 1), 3, "SETTLED", "AU", True), (None, s(1), 1, "X", "AU", True)]
    df = spark.createDataFrame(rows, "customer_id string, event_timestamp timestamp, amount int, transaction_status string, country string, card_present boolean").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = {r.feature_timestamp: r for r in features.behaviour(df, "customer_id", "p").collect()}
    assert [got[s(x)].p_txn_count_1d for x in (0, 86_400, 86_401, 604_801)] == [0, 2, 1, 0]
    assert [got[s(x)].p_txn_count_7d for x in (0, 86_400, 86_401, 604_801)] == [0, 2, 3, 2]
    assert got[s(86_401)].p_amount_sum_7d == 16.0 and got[s(86_401)].p_decline_rate_30d == pytest.approx(1 / 3) and got[s(86_401)].p_card_not_present_rate_30d == pytest.approx(2 / 3) and got[s(0)].p_avg_amount_30d == 0.0


def test_split_is_temporal(spark):
    rows = spark.createDataFrame([(i, T0 + timedelta(hours=5 * (i % 37))) for i in range(100)], "i int, t timestamp")
    out = features.temporal_split(rows, "t", "i").collect()
    assert {s: sum(r.split == s for r in out) for s in ("train", "validation", "test")} == {"train": 70, "validation": 15, "test": 15}
    last = {s: max((r.t, r.i) for r in out if r.split == s) for s in ("train", "validation")}
    assert all((r.t, r.i) > last["train"] for r in out if r.split != "train")


def test_areas_by_hand_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int")
    r = scoring.areas(scoring.curve(df, "s", "y")).first()
    assert r.roc_auc == pytest.approx(0.875) and r.average_precision == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert scoring.areas(scoring.curve(df.filter("y = 1"), "s", "y")).first().roc_auc is None


def test_threshold_ties_stay_at_the_start(spark):
    df = spark.createDataFrame([(0.95, 1), (0.01, 0)], "s double, y int")
    assert scoring.best_threshold(scoring.at_thresholds(df, "s", "y", scoring.THRESHOLDS)).first().threshold == 0.5
    assert len(scoring.THRESHOLDS) == 91 and scoring.THRESHOLDS[-1] == 0.95


def test_registry_aliases(spark, tmp_path):
    reg = scoring.Registry(spark, str(tmp_path / "registry"))
    for ap in (0.5, 0.6, 0.7):
        reg.promote("m", reg.register("m", "p", {"ap": ap}))
    assert {r.version: r.alias for r in reg.current().collect()} == {1: None, 2: "PreviousChampion", 3: "Champion"}


def test_finite_and_gates(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "x double")
    assert [r.x for r in features.finite(df, ["x"]).collect()] == [0.0, 0.0, 0.0, 2.0]
    out = scoring.gates(df.filter("x = 2"), {"big": F.col("x") > 5, "there": F.col("x") > 1, "null": F.lit(None).cast("boolean")}).first()
    assert out.failed_gates == ["big", "null"] and not out.passed


# Forecast


def test_dense_series_and_errors(spark):
    rows = spark.createDataFrame([(T0.date(), 2), ((T0 + timedelta(days=3)).date(), 5), (None, 9)], "d date, v int")
    assert [r.y for r in forecast.daily_series(rows, "d", "v").orderBy("d").collect()] == [2.0, 0.0, 0.0, 5.0]
    r = forecast.errors(spark.createDataFrame([(0.0, 0.0), (4.0, 2.0)], "y double, forecast double")).first()
    assert (r.mae, r.wape, r.bias) == (1.0, 0.5, -1.0) and r.smape == pytest.approx(1 / 3)


def test_recursion_and_horizons():
    assert forecast.recursive([1.0, 2.0], 3, lambda h: h[-1] - 2) == [0.0, 0.0, 0.0]
    assert forecast.horizons(60, 7) == 7 and forecast.horizons(21, 7) == 4
    with pytest.raises(ValueError):
        forecast.horizons(12, 7)
    assert forecast.choose({"naive": (1.0, 2.0), "model": (1.0, 3.0)}) == "naive"


# Metrics, operations, reconciliation


def test_metric_view_ratio_is_not_rolled_up(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 0), ("b", "x", 1), ("b", "y", 1)], "g string, c string, hit int")
    view = metrics.MetricView(df, {"g": "g", "c": "c"}, {"rate": metrics.ratio(F.sum("hit"), F.count(F.lit(1))), "cs": F.count_distinct("c")})
    assert view.query([], ["rate", "cs"]).first() == (0.75, 2)
    assert [tuple(r) for r in view.sql("SELECT g, MEASURE(rate) AS r FROM v WHERE c = 'x' GROUP BY ALL ORDER BY r DESC, g LIMIT 1").collect()] == [("b", 1.0)]
    with pytest.raises(KeyError):
        view.query(["nope"], ["rate"])


def test_slices_final_state_may_be_null(spark):
    rows = [("r", 0, 1, "SUCCEEDED"), ("r", 1, 2, None), ("s", 0, 1, "SUCCEEDED"), ("s", 1, 5, "FAILED")]
    df = spark.createDataFrame([(i, T0 + timedelta(hours=a), T0 + timedelta(hours=b), s) for i, a, b, s in rows], "id string, a timestamp, b timestamp, s string")
    got = {r.id: (r.final_state, r.status, r.active_us) for r in ops.collapse_slices(df, ["id"], "a", "b", "s").withColumn("status", ops.run_status()).collect()}
    assert got == {"r": (None, "IN_PROGRESS", 7_200_000_000), "s": ("FAILED", "FAILED", 18_000_000_000)}


def test_latest_definition_deleted_does_not_fall_back(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("b", 1, None)], "id string, changed int, gone int")
    assert [r.id for r in cdc.latest_definition(df, ["id"], "changed", "gone").collect()] == ["b"]


def test_signed_cost_drops_groups_that_cancel(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", -1.0, -2.0), ("b", 1.0, None)], "k string, quantity double, list_cost double")
    assert [r.k for r in ops.signed_cost(df, ["k"]).collect()] == ["b"]


def test_checks(spark):
    a, b = spark.range(3), spark.range(4)
    got = {r.check_name: r.status for r in reconcile.report([reconcile.check("n", a, b), reconcile.check("sum", a, a, F.sum("id"), F.sum("id")), reconcile.unique("u", a, ["id"])]).collect()}
    assert got == {"n": "FAIL", "sum": "PASS", "u": "PASS"}


# Governance


def test_masks_agree_with_sql_functions(spark):
    governance.register(spark)
    rows = spark.createDataFrame([("a@b.com",), ("@b",), ("x",), (None,)], "v string")
    got = rows.select(governance.mask("email", F.col("v")).alias("a"), F.expr("mask_email(v)").alias("b"), governance.mask("string", F.col("v")).alias("c"), F.expr("mask_string(v)").alias("d")).collect()
    assert [r.a for r in got] == ["***@b.com", "***MASKED***", "***MASKED***", None] and all(r.a == r.b and r.c == r.d for r in got)
    assert spark.sql("SELECT mask_date_of_birth(DATE'1990-05-06'), allow_country(' au ', 'AU')").first() == (datetime(1990, 1, 1).date(), True)


def test_policies_exempt_and_filter(spark):
    df = governance.tag_columns(spark.createDataFrame([("s", "AU"), ("t", "NZ")], "name string, land string"), {"name": {"pii": "name"}, "land": {"region": "land"}})
    masks, rows = [governance.Policy("pii", "name", "string", frozenset({"hr"}))], [governance.RowFilter("region", "au", "AU")]
    assert [tuple(r) for r in governance.secured(df, {"au"}, masks, rows).collect()] == [("***MASKED***", "AU")]
    assert governance.secured(df, {"hr"}, masks, rows).count() == 2 and governance.secured(df, {"hr"}, masks).first().name == "s"


@pytest.mark.parametrize("text", ["DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO b SELECT * FROM a", "CREATE VIEW v AS SELECT 1"])
def test_read_only_refuses(spark, text):
    with pytest.raises(PermissionError):
        governance.read_only(spark, text)


def test_read_only_accepts_words_in_strings(spark):
    assert governance.read_only(spark, "SELECT 'please delete; this' AS a").first().a == "please delete; this"
    with pytest.raises(ValueError):
        governance.transaction_id("txn-1' OR 1=1")
    with pytest.raises(ValueError):
        governance.forbid_columns(spark.range(1), {"id"})


# Retrieval and evaluation


def chunk_by_hand(text, limit):
    import re

    out, held = [], ""
    for p in (x.strip(" \t\r\n") for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if held and len(held) + 2 + len(p) <= limit:
            held += "\n\n" + p
        else:
            out += [held] if held else []
            held = p
    return out + ([held] if held else [])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=40), min_size=1, max_size=6))
def test_chunks_brute_force(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in retrieval.chunks(docs, "i", "t", 15).orderBy("doc_id", "chunk_ordinal").collect():
        got.setdefault(r.doc_id, []).append(r.chunk_text)
    assert got == {i: c for i, t in enumerate(texts) if (c := chunk_by_hand(t, 15))}


def test_chunk_ids_and_contract(spark):
    docs = spark.createDataFrame([("d", "a" * 30 + "\n\n" + "b" * 5), ("n", None)], "i string, t string")
    got = retrieval.chunks(docs, "i", "t", 20)
    assert sorted(r.chunk_id for r in got.collect()) == ["d_chunk_001", "d_chunk_002"]
    assert retrieval.source_contract(got, "chunk_id", ["chunk_text"]).first().is_valid
    assert not retrieval.source_contract(got.union(got), "chunk_id", ["chunk_text", "title"]).first().is_valid


def test_fusion_and_metrics(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, doc_id int, rank int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "query_id string, doc_id int, rank int")
    assert [r.doc_id for r in retrieval.fuse([a, b], 3).orderBy("rank").collect()] == [2, 1, 3]
    expected = spark.createDataFrame([("q", 2), ("lost", 9)], "query_id string, doc_id int")
    r = retrieval.retrieval_metrics(a, expected).first()
    assert (r.queries, r.hit_at_1, r.recall_at_k, r.mrr, r.empty_rate) == (2, 0.0, 0.5, 0.25, 0.5)
    with pytest.raises(ValueError):
        retrieval.cosine(spark.range(retrieval.MAX_QUERIES + 1).select("id", F.array(F.lit(1.0)).alias("vec")), spark.range(1).select("id", F.array(F.lit(1.0)).alias("vec")))


def test_scorers(spark):
    lit = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    one = spark.range(1)
    row = one.select(
        evaluation.tool_selection(lit("a"), lit("a", "b"), lit("a", "b"), lit("x")).alias("half"), evaluation.tool_selection(lit("x", "a"), lit("a"), lit("a", "x"), lit("x")).alias("banned"), evaluation.efficiency(lit("a", "b", "c"), F.lit(1)).alias("slow"),
        evaluation.efficiency(lit("a", "a"), F.lit(9)).alias("repeat"), evaluation.argument_share(F.array(F.struct(F.lit("1").alias("expected"), F.lit("1").alias("actual")), F.struct(F.lit("2").alias("expected"), F.lit(None).cast("string").alias("actual")))).alias("args"),
        evaluation.in_scope(lit("t1", "t2"), F.lit("t1")).alias("scope"), evaluation.headings(F.lit("## A\n text\n## B \n"), ["A", "B", "C", "D"]).alias("heads"), evaluation.no_match(F.lit("Guilty"), ["guilty"]).alias("safe"), retrieval.citations_valid(F.lit("[SOURCE a] [SOURCE a]"), lit("a", "b")).alias("cited"),
        evaluation.sections(F.lit("## A\n- x\n* y\ntext\n## B\n")).alias("s"),
    ).first()
    assert (row.half, row.banned, row.slow, row.repeat, row.args, row.scope, row.heads, row.safe, row.cited) == (0.5, 0.0, 0.5, 0.0, 0.5, 0.0, 0.5, 0.0, True)
    assert [(s.title, list(s["items"])) for s in row.s] == [("A", ["x", "y"]), ("B", [])]
    with pytest.raises(ValueError):
        evaluation.weighted({"a": 0.5})
    runs = spark.createDataFrame([("2026-07-01", False), ("2026-07-28", True)], "at string, overall_pass boolean")
    assert evaluation.fresh_enough(runs, "at", "2026-08-01").first().may_promote and not evaluation.fresh_enough(runs, "at", "2026-09-01").first().may_promote


# Sources, graph, streams


def test_csv_blank_is_null_and_lineage(spark, tmp_path):
    (tmp_path / "cases.csv").write_text("case_id,transaction_id,opened_at,status,suspected_reason,outcome,analyst_notes,closed_at\nc1,t1,2026-06-01T00:00:00Z,OPEN,r,,n,\nc2,t2,2026-06-01T00:00:00Z,CLOSED,r,LEGITIMATE,n,2026-06-02T00:00:00Z\n")
    got = {r.case_id: r for r in files.fraud_cases(spark, str(tmp_path)).collect()}
    assert got["c1"].closed_at is None and got["c2"].closed_at is not None and got["c1"].source_file_name == "cases.csv"


def test_properties_insert_replace_and_order(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_table(spark.range(3), path, "overwrite", properties={"quality": "silver"})
    assert files.properties(spark, path) == {"quality": "silver"}
    out = str(tmp_path / "u")
    files.insert(spark, out, "SELECT :a AS a, from_json(:b, 'ARRAY<STRING>') AS b", {"a": "x'y", "b": '["p", "q"]'})
    assert spark.read.parquet(out).first() == ("x'y", ["p", "q"])
    files.replace_rows(spark.read.parquet(out).withColumn("a", F.lit("z")), out)
    assert [r.a for r in spark.read.parquet(out).collect()] == ["z"]
    rows = spark.createDataFrame([(i, T0 + timedelta(minutes=(i * 7) % 50)) for i in range(50)], "i int, t timestamp")
    files.in_event_order(rows, "t", str(tmp_path / "o"), 3)
    names = spark.read.parquet(str(tmp_path / "o")).select(F.input_file_name().alias("f"), "t").groupBy("f").agg(F.min("t").alias("a"), F.max("t").alias("b")).collect()
    spans = sorted((r.a, r.b) for r in names)
    assert len(spans) == 3 and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_graph_runs_in_order_and_checks_keys(spark, tmp_path):
    g = Graph()
    g.dataset("b", inputs=["a"], keys=("id",))(lambda a: a)
    g.dataset("a", inputs=["src"], private=True, rules={"small": F.col("id") < 2})(lambda s: s)
    made, log = g.run(spark, {"src": spark.range(3)}, str(tmp_path))
    assert list(made) == ["b"] and made["b"].count() == 3
    assert [(r.rule, r.passed_records, r.failed_records) for r in log.collect()] == [("small", 2, 1)]
    with pytest.raises(ValueError, match="not unique"):
        g.run(spark, {"src": spark.range(2).union(spark.range(2))}, str(tmp_path / "x"))


def test_watermark_deduplication_across_restarts(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    put = lambda rows: spark.createDataFrame([(e, T0 + timedelta(hours=h), 0) for e, h in rows], "event_id string, event_timestamp timestamp, delay_seconds int").coalesce(1).write.mode("append").parquet(src)
    for rows in ([("a", 0), ("a", 0), ("b", 24)], [("b", 24), ("late", 19), ("gone", 1)]):
        put(rows)
        stream = files.stream_table(spark, src, "event_id string, event_timestamp timestamp, delay_seconds int")
        flows.run(flows.trusted(stream), out, ck)
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == ["a", "b", "late"]


# Session


def test_machine_local_roots_are_refused_on_clusters():
    from tidemark import session

    assert session._shared_warehouse("hdfs://host/warehouse/") == "hdfs://host/warehouse"
    for local in ("file:/home/x/spark-warehouse", "/home/x/spark-warehouse"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session._shared_warehouse(local)


def test_work_folders_are_there_and_new(spark):
    from tidemark.session import work_dir

    one, two = work_dir(spark, "t"), work_dir(spark, "t")
    path = spark._jvm.org.apache.hadoop.fs.Path(one)
    assert one != two and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


# Selection of models and forecasts


def test_forecast_selection_prefers_what_did_better():
    from datetime import date

    days = [date(2026, 1, 1) + timedelta(days=i) for i in range(60)]
    weekly = [(d, 100.0 + 10 * d.weekday()) for d in days]
    out = forecast.selection(weekly, 7)
    assert len(out) == 7 and [d for d, *_ in out] == days[-7:] and out[0][3] == "seasonal_naive" and all(abs(y - f) < 1e-9 for _, y, f, _, _ in out)
    growing = [(d, 50.0 + 5 * i) for i, d in enumerate(days)]
    out = forecast.selection(growing, 7)
    assert out[0][3] == "line" and all(abs(y - f) < 12 for _, y, f, _, _ in out)
    assert {r[3] for r in forecast.selection(growing[:24], 7)} == {"seasonal_naive"}  # too few days to fit
    with pytest.raises(ValueError):
        forecast.fit_line([1.0] * 20, [0] * 20)


def test_promotion_checks_name_what_fails(spark):
    rows = [("p", 0.5, 0.1, 0.6, 0.3), ("", 0.05, 0.1, 0.4, 0.0), ("p", float("nan"), 0.1, None, None)]
    df = spark.createDataFrame(rows, "path string, average_precision double, base_rate double, recall double, f2 double")
    got = [r.failed_gates for r in scoring.gates(df, scoring.promotion_checks()).collect()]
    assert got[0] == [] and got[1] == ["model_stored", "average_precision_beats_base_rate", "minimum_recall", "f2_positive"]
    assert got[2][0] == "average_precision_finite" and {"recall_finite", "minimum_recall", "f2_positive"} <= set(got[2])


def test_measures_are_parsed_by_spark(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "g string, hit int")
    view = metrics.MetricView(df, {"g": "g"}, {"rate": metrics.ratio(F.sum("hit"), F.count(F.lit(1))), "n": F.count_distinct("hit")})
    got = view.sql("WITH z AS (SELECT upper(g) AS named, MEASURE(rate) AS r, measure(n) + 1 AS n FROM v GROUP BY upper(g) HAVING MEASURE(rate) > 0) SELECT named, r, n FROM z ORDER BY named").collect()
    assert [tuple(r) for r in got] == [("A", 0.5, 3), ("B", 1.0, 2)]
    with pytest.raises(KeyError):
        view.sql("SELECT MEASURE(nope) FROM v")


def test_nearest_rows_in_blocks_equal_brute_force(spark):
    rnd = random.Random(11)
    vecs = {i: [float(rnd.randrange(-3, 4)) for _ in range(5)] for i in range(90)}
    vecs[7], vecs[8] = [0.0] * 5, vecs[9]
    df = spark.createDataFrame(list(vecs.items()) + [(100, None)], "id long, vec array<double>")
    got = sorted(map(tuple, retrieval.cosine_top_k(df.filter("id % 4 = 0 or id = 7"), df, 3, block=5, bucket=20).select("query_id", "doc_id", "rank").collect()))
    size = {i: sum(x * x for x in v) ** 0.5 for i, v in vecs.items()}
    live = [i for i in vecs if size[i]]
    want = []
    for q in [i for i in live if i % 4 == 0]:
        best = sorted((-round(sum(a * b for a, b in zip(vecs[q], vecs[d], strict=True)) / (size[q] * size[d]), 9), d) for d in live if d != q)[:3]
        want += [(q, d, n + 1) for n, (_, d) in enumerate(best)]
    assert got == sorted(want)


def test_offsets_of_one_busy_partition(spark):
    env = spark.range(5000).select(F.lit("k").alias("k"), F.struct("id").alias("payload"), F.timestamp_seconds(F.col("id") % 400).alias("at"))
    out = messages.to_records(env, "topic", "k", "at", partitions=3)
    rows = sorted((r.offset, r.timestamp) for r in out.collect())
    assert [o for o, _ in rows] == list(range(5000)) and [t for _, t in rows] == sorted(t for _, t in rows)
