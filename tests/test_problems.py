"""Problems 1 to 7 against brute force on small random tables with ties, nulls and repeats."""

import random
from collections import defaultdict
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import change_table, exactly_once, history, known_time, late, references, rolling
from tidemark.operators.history import OPEN


def test_keep_one_brute_force(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "B ", "b", None, "", "c"]), rnd.choice([None, 1, 2, 3]), b, 0, o, f"p{o}") for b in range(3) for o in range(40)]
    df = spark.createDataFrame(rows, "id string, at long, b int, p int, o long, pos string")
    ident = F.when(F.trim("id") != "", F.lower(F.trim("id")))
    got = {(r.b, r.o) for r in exactly_once.surplus(df, ident, F.col("at"), ["b", "p", "o"]).collect()}
    groups = defaultdict(list)
    for r in rows:
        if r[0] and r[0].strip():
            groups[r[0].strip().lower()].append((r[1] if r[1] is not None else 2**63, r[2], r[3], r[4]))
    want = {(x[1], x[3]) for g in groups.values() for x in sorted(g)[1:]}
    assert got == want
    kept = exactly_once.keep_one(df, ident, F.col("at"), ["b", "p", "o"])
    assert kept.columns == df.columns and kept.count() == len(rows) - len(want)


def test_keep_one_hot_identifier_aggregates_map_side(spark):
    df = spark.range(0, 30_000, numPartitions=4).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("e"), F.col("id").alias("o"))
    out = exactly_once.surplus(df, F.col("e"), F.col("o"), ["o"])
    assert out.count() == 9_999
    plan = exactly_once.winners(df, F.col("e"), F.col("o"), ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


def _runs(units):
    out = []
    for e, lo, hi, p in sorted(units, key=lambda u: (u[0], u[1])):
        if out and out[-1][0] == e and out[-1][2] == lo and out[-1][3] == p:
            out[-1][2] = hi
        else:
            out.append([e, lo, hi, p])
    return {tuple(x) for x in out}


@pytest.mark.parametrize("seed", range(4))
def test_coalesce_runs_brute_force(spark, seed):
    rnd, units = random.Random(seed), []
    for e in "abc":
        at = 0
        for _ in range(rnd.choice([0, 1, 2, 7, 16, 33])):
            at += rnd.choice([0, 0, 0, 3])
            units.append((e, at, at + 5, rnd.choice(["x", "y", None])))
            at += 5
    df = spark.createDataFrame(units, "entity string, lo_us long, hi_us long, p string")
    got = {(r.entity, r.lo_us, r.hi_us, r.p) for r in history.coalesce_runs(df, ["p"]).collect()}
    assert got == _runs(units)


def test_coalesce_rounds_do_not_shuffle(spark):
    df = spark.range(64).select(F.lit("a").alias("entity"), F.col("id").alias("lo_us"), (F.col("id") + 1).alias("hi_us"), F.lit("x").alias("p"))
    runs = history.coalesce_runs(df, ["p"])
    assert [(r.lo_us, r.hi_us) for r in runs.collect()] == [(0, 64)]
    assert runs._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2  # shown with and without statistics


def test_history_snapshot_rules(spark):
    snaps = [("m", 10, 1, "L"), ("m", 20, 1, "L"), ("m", 20, 2, "H"), ("m", 40, 3, "H"), ("z", 10, 1, None), ("z", 20, 1, None), ("z", 30, 1, "L"), ("z", 40, 1, "L")]
    snap = spark.createDataFrame([(e, t, v, None, False, p) for e, t, v, p in snaps], "entity string, at_us long, version int, updated_us long, gone boolean, p string")
    pub = spark.createDataFrame([("m", 1, None, 1, "L"), ("old", 1, 4, 1, "L"), ("old", 3, None, 2, "L"), ("old", 3, None, 2, "L"), (None, 1, None, 1, "L")], "entity string, start_us long, end_us long, version int, p string")
    got = {(r.entity, r.p, r.lo_us, r.hi_us) for r in history.full_history(pub, snap, ["p"]).collect()}
    assert got == {("m", "L", 1, 20), ("m", "H", 20, 30), ("m", "H", 40, OPEN), ("z", None, 10, 30), ("z", "L", 30, OPEN), ("old", "L", 1, 10)}


@pytest.mark.parametrize("seed", range(3))
def test_history_brute_force_over_many_times(spark, seed):
    rnd = random.Random(seed)
    times = sorted(rnd.sample(range(0, 40 * history.DAY, history.DAY // 8), 150))  # several rows of bits, several times a day
    snaps, units = [], []
    for e in "abc":
        for k, t in enumerate(times):
            version = k // 20 + 1
            rows = [(e, t, rnd.choice([version, version, None]), rnd.choice([5, 6, None]), rnd.choice([None, False, False, False, False, True]), rnd.choice(["x", "x", "y", None])) for _ in range(rnd.choice([0, 1, 1, 1, 2, 3]))]
            snaps += rows + rows[:1]
            if rows:
                null_first = [tuple((v is not None, v or 0) for v in (r[2], r[3])) + ((r[5] is not None, r[5] or ""), bool(r[4])) for r in rows]
                best = rows[null_first.index(max(null_first))]
                if not best[4]:
                    units.append((e, t, times[k + 1] if k + 1 < len(times) else OPEN, best[5]))
    published = [("a", -30, None, 1, "x"), ("a", -20, -10, 1, "x"), ("a", -20, -15, 2, None), ("b", -5, None, 1, "y"), ("d", -5, times[0], 1, "x")]
    units += [("a", -30, -20, "x"), ("a", -20, -15, None), ("b", -5, times[0], "y"), ("d", -5, times[0], "x")]
    snap = spark.createDataFrame([*snaps, *[("z", t, 1, 1, True, "x") for t in times], (None, times[3], 1, 1, False, "x"), ("a", None, 9, 9, False, "y")], "entity string, at_us long, version int, updated_us long, gone boolean, p string")
    pub = spark.createDataFrame(published, "entity string, start_us long, end_us long, version int, p string")
    got = [(r.entity, r.lo_us, r.hi_us, r.p) for r in history.full_history(pub, snap, ["p"]).collect()]
    assert len(got) == len(set(got)) and set(got) == _runs(units)


def test_history_reads_snapshots_twice_and_shuffles_versions(spark, tmp_path):
    rows = spark.range(200 * 50).select(F.format_string("m%03d", F.expr("id div 50")).alias("entity"), (F.col("id") % 50 * history.DAY).alias("at_us"), F.lit(1).alias("version"), F.lit(1).cast("long").alias("updated_us"), F.lit(False).alias("gone"), F.lit("x").alias("p"))
    rows.coalesce(1).write.parquet(str(tmp_path / "s"))
    pub = spark.createDataFrame([], "entity string, start_us long, end_us long, version int, p string")
    store = spark.sparkContext._jsc.sc().statusStore()
    seen = max([0, *(s.stageId() for s in _stages(store))])
    assert history.full_history(pub, spark.read.parquet(str(tmp_path / "s")), ["p"]).count() == 200
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran = [s for s in _stages(store) if s.stageId() > seen]
    assert sum(s.inputRecords() for s in ran) < 2.5 * 10_000
    assert sum(s.shuffleWriteRecords() for s in ran) < 1_000


def _stages(store):
    found = store.stageList(None, *[getattr(store, f"stageList$default${k}")() for k in (2, 3, 4, 5)])
    return [found.apply(i) for i in range(found.size())]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, 3, 4, None])), max_size=12), st.randoms(use_true_random=False))
def test_change_table_any_order(spark, keys, rnd):
    rows = [(k, v, (hash((k, v)) % 3 == 0) if v else None, i) for i, (k, v) in enumerate(keys)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v int, gone boolean, at long")
    got = {(r["__key"], r["__version"]) for r in change_table.current_state(df, F.col("k"), F.col("v"), F.col("gone"), F.col("at"), ["at"]).collect()}
    last = {}
    for k, v, gone, _ in rows:
        if k and v and (k not in last or v > last[k][0]):
            last[k] = (v, gone)
    assert got == {(k, v) for k, (v, gone) in last.items() if not gone}


def test_change_table_batches_and_delete_without_insert(spark, tmp_path):
    held = change_table.ChangeTable(spark, str(tmp_path / "t"))
    put = lambda rows: held.append(spark.createDataFrame(rows, "k string, v int, gone boolean, at long, name string"), F.col("k"), F.col("v"), F.col("gone"), F.col("at"), ["name"])
    put([("a", 3, False, 1, "late"), ("b", 2, True, 2, None)])
    put([("a", 1, False, 3, "old"), ("b", 1, False, 4, "gone"), ("a", 3, False, 5, "again")])
    assert [(r["__key"], r["__version"], r["name"]) for r in held.read().collect()] == [("a", 3, "again")]


def test_late_versions_and_retractions(spark):
    h, m = late.HOUR, 60 * late.SECOND
    rows = [("a", 0, 1 * m, 1.0), ("b", 5 * m, 3 * h, 2.0), ("c", 6 * m, 3 * h + m, None), ("d", 7 * m, 5 * h, 4.0), ("e", 8 * m, 9 * h, 8.0), ("f", h, h + 2 * h, 1.0), ("g", None, 5, 1.0), ("h", 3 * h, 3 * h + 6 * h, 5.0), ("i", 10 * m, None, 0.5)]
    ev = spark.createDataFrame(rows, "msg_id string, event_us long, arrival_us long, amount double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    deltas = late.input_deltas(ev)
    state = late.versions(deltas)
    got = {(r.period // h, r.version, r.old_count, r.new_count, float(r.new_amount)) for r in state.collect()}
    assert got == {(0, 0, 0, 2, 1.5), (0, 1, 2, 4, 3.5), (0, 2, 4, 5, 7.5), (1, 0, 0, 1, 1.0), (3, 1, 0, 1, 5.0)}
    log = late.retractions(state)
    now = {(r.period // h, r.n, float(r.amount), r.version) for r in late.settled(log).collect()}
    assert now == {(0, 5, 7.5, 2), (1, 1, 1.0, 0), (3, 1, 5.0, 1)}
    assert {r.msg_id for r in late.corrections(deltas, state).collect()} == {"b", "c", "d", "h"}
    assert {r.msg_id for r in deltas.filter("outcome = 'DROPPED'").collect()} == {"e"}
    day = late.settled(late.retractions(late.downstream(log, 24 * h))).collect()
    assert [(r.n, float(r.amount)) for r in day] == [(7, 13.5)]


@pytest.mark.parametrize("seed", range(3))
def test_out_of_order_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice([None, 1, 2, 3, 1023, 1024, 5000]), rnd.choice([None, *range(6)])) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, g string, s long, t long")
    got = {r.i for r in late.out_of_order(df, "g", "s", "t").filter("overtaken").collect()}
    ok = [r for r in rows if None not in r]
    assert got == {r[0] for r in ok if any(x[1] == r[1] and x[2] > r[2] and x[3] < r[3] for x in ok)}


def test_corrections_come_from_the_change_log(spark, monkeypatch):
    """Without its corrections in the log, p4_found has none."""
    from conftest import DATA

    from tidemark.queries import all_queries

    made = late.retractions
    monkeypatch.setattr(late, "retractions", lambda state: made(state).filter("version = 0 or mult = -1"))
    found = {r.outcome for r in all_queries()["p4_found"](spark, DATA).select("outcome").distinct().collect()}
    assert found == {"DROPPED", "OUT_OF_ORDER"}


def test_out_of_order_rows_that_repeat_a_number_do_not_meet_in_a_window(spark):
    """One transaction, three numbers, many rows: the window sees three."""
    df = spark.range(30_000, numPartitions=4).select(F.col("id").alias("i"), F.lit("t").alias("g"), (F.col("id") % 3).alias("s"), (F.col("id") + F.when(F.col("id") % 3 == 0, 10).otherwise(0)).alias("t"))
    out = late.out_of_order(df, "g", "s", "t")
    assert out.filter("overtaken").count() == sum(any(x % 3 > i % 3 and x + (0 if x % 3 else 10) < i + (0 if i % 3 else 10) for x in range(6)) for i in range(30_000))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("partial_min")  # printed from the result down: reduced before it is windowed


def test_rolling_brute_force(spark):
    rnd, day = random.Random(3), 86_400_000_000
    rows = [(f"t{i % 55}", rnd.choice(["a", "b"]) if i < 55 else None, rnd.randrange(0, 40) * day + rnd.randrange(day), rnd.choice([None, 1.25, -2.0, 3.0])) for i in range(55)]
    rows += [rows[3], rows[4]]
    df = spark.createDataFrame(rows, "t string, e string, at long, amount double")
    daily = rolling.daily_totals(df, "t", {"k": "e"}, "at", "amount")
    panel = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "nobody"), ("k", None)], "kind string, entity_id string")
    got = {(r.entity_id, r.day_no): (r.txn_count_7d, r.amount_sum_7d, r.txn_count_30d, r.avg_amount_30d, r.daily_amount_7d) for r in rolling.trailing(daily, panel, 20, 40).collect()}
    once = {r[0]: r for r in rows}.values()
    for e in ("a", "b", "nobody"):
        for d in range(20, 41):
            w = lambda n: [r[3] or 0.0 for r in once if r[1] == e and d - n <= r[2] // day < d]  # noqa: E731, B023
            seven, thirty = w(7), w(30)
            want = (len(seven), sum(seven), len(thirty), sum(thirty) / len(thirty) if thirty else 0.0, sum(seven) / 7)
            assert got[(e, d)] == pytest.approx(want)


def test_forest_brute_force():
    rnd = random.Random(5)
    import numpy as np

    for n in (0, 1, 5, 200):
        forest, kept = known_time.Forest(), {}
        for e in range(3):
            rows = sorted((rnd.randrange(50), rnd.randrange(30), i) for i in range(n))
            kept[e] = rows
            forest.add_entity(e, rows)
        forest.freeze()
        asks = [(rnd.randrange(-1, 3), rnd.randrange(-5, 60), rnd.randrange(-5, 40)) for _ in range(400)]
        got = forest.find(*(np.array(x, dtype=np.int64) for x in zip(*asks, strict=True)))
        for (e, known, probe), load in zip(asks, got, strict=True):
            seen = {}
            for t, k, i in kept.get(e, []):
                if t <= known:
                    seen[k] = i
            below = [k for k in seen if k <= probe]
            assert load == (seen[max(below)] if below else -1)


def test_forest_stays_shallow():
    forest = known_time.Forest()
    forest.add_entity(0, [(i, i, i) for i in range(5000)])
    forest.freeze()
    depth, level = 0, [forest.roots[-1][2]]
    while level:
        depth += 1
        level = [c for n in level for c in (forest.left[n], forest.right[n]) if c >= 0]
    assert depth < 60


def test_lookup_states_and_hot_entity(spark, monkeypatch):
    monkeypatch.setattr(known_time, "EVENTS_PER_SALT", 500)
    versions = spark.createDataFrame([("x", 10, 1, "L", False), ("x", 20, 3, "H", False), ("x", 30, 2, "M", False), ("x", 40, 4, None, True), ("hot", 0, 1, "A", False), ("hot", 50, 2, None, False), (None, 1, 1, "Z", False)], "entity string, known_us long, key long, value string, deleted boolean")
    asked = [("x", 5), ("x", 10), ("x", 35), ("x", 45), ("nobody", 5), (None, 5), ("x", None)] + [("hot", i % 100) for i in range(3000)]
    events = spark.createDataFrame([(i, e, t, known_time.TOP) for i, (e, t) in enumerate(asked)], "i int, entity string, known_us long, key long")
    got = {r.i: (r.state, r.value) for r in known_time.lookup(events, versions, ["i"]).collect()}
    assert len(got) == len(asked)
    assert [got[i] for i in range(7)] == [("EARLY", None), ("IN_FORCE", "L"), ("IN_FORCE", "H"), ("GONE", None), ("UNKNOWN", None), ("NO_KEY", None), ("NO_KEY", None)]
    assert all(got[i + 7] == (("IN_FORCE", "A") if i % 100 < 50 else ("IN_FORCE", None)) for i in range(3000))


def test_salts_follow_the_position_not_the_columns(spark, tmp_path, monkeypatch):
    """Half of all events share entity and every carried column; its versions alone are repeated."""
    monkeypatch.setattr(known_time, "EVENTS_PER_SALT", 1000)
    spark.range(40_000, numPartitions=4).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id"))).alias("entity"), (F.col("id") % 7).alias("known_us"), F.lit(known_time.TOP).alias("key"), F.lit("one").alias("txn")).write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    versions = spark.range(300).select(F.when(F.col("id") < 3, "hot").otherwise(F.concat(F.lit("e"), F.col("id"))).alias("entity"), F.col("id").alias("known_us"), F.col("id").alias("key"), F.lit("v").alias("value"), F.lit(False).alias("deleted"))
    assert known_time.heavy(events) == {"hot": 20}
    made = known_time.stream(events, versions, ["txn"])
    per = [r[2] for r in made.filter("is_event = 1").groupBy("entity", "salt").count().filter("entity = 'hot'").collect()]
    assert len(per) == 20 and sum(per) == 20_000 and max(per) < 1150
    copies = {r[0]: r[1] for r in made.filter("is_event = 0").groupBy(F.col("entity") == "hot").count().collect()}
    assert copies == {True: 3 * 20, False: 297}
    out = known_time.lookup(events, versions, ["txn"]).groupBy("state").count().collect()
    assert {r[0]: r[1] for r in out}["IN_FORCE"] >= 20_000 and sum(r[1] for r in out) == 40_000


@pytest.mark.parametrize("seed", range(2))
def test_bitemporal_lookup_brute_force(spark, seed, monkeypatch):
    """Known time and valid time differ: both must be searched.  Trees are dropped often."""
    monkeypatch.setattr(known_time, "NODES", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        rnd = random.Random(seed)
        versions = [(rnd.choice("abcdefg"), rnd.randrange(30), rnd.randrange(20), f"v{i}", rnd.random() < 0.2) for i in range(150)]
        versions = list({v[:3]: v for v in versions}.values())
        asks = [(i, rnd.choice("abcdefghx"), rnd.randrange(-2, 35), rnd.randrange(-2, 25)) for i in range(400)]
        got = {r.i: (r.state, r.value) for r in known_time.lookup(spark.createDataFrame(asks, "i int, entity string, known_us long, key long"), spark.createDataFrame(versions, "entity string, known_us long, key long, value string, deleted boolean"), ["i"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, e, known, probe in asks:
        own = [v for v in versions if v[0] == e]
        seen = sorted((v[2], v[1], v[3], v[4]) for v in own if v[1] <= known and v[2] <= probe)
        want = ("UNKNOWN", None) if not own else ("EARLY", None) if not seen else ("GONE", None) if seen[-1][3] else ("IN_FORCE", seen[-1][2])
        assert got[i] == want


def test_references_reasons(spark):
    parents = spark.createDataFrame([("t", "a", 10, False), ("t", "a", 30, True), ("t", "row_only", None, None)], "table string, key string, first_us long, ceases boolean")
    versions = spark.createDataFrame([("t|a", 10, 1, "v", False), ("t|a", 30, 2, None, True)], "entity string, known_us long, key long, value string, deleted boolean")
    kids = [("k1", "a", 5), ("k2", "a", 10), ("k3", "a", 35), ("k4", "none", 7), ("k4", "none", 7), ("k5", "none", None), ("k6", "row_only", 1), ("k7", None, 1), ("k8", "a", None)]
    children = spark.createDataFrame([("t", k, t, c, "2026-01-01") for c, k, t in kids], "table string, key string, at_us long, txn string, period string")
    got = {(r.txn, r.reason) for r in references.findings(parents, versions, children, ["txn"]).collect()}
    assert got == {("k1", "LATER"), ("k3", "DELETED"), ("k4", "MISSING"), ("k5", "MISSING")}
    assert [(r.table, r.orphans) for r in references.missing_by_period(parents, children).collect()] == [("t", 3)]


def test_report_sums_the_counters_of_the_groups(spark, monkeypatch):
    parents = spark.createDataFrame([("t", "a", 10, False), ("t", "a", 30, True), ("t", "late", 50, False)], "table string, key string, first_us long, ceases boolean")
    versions = spark.createDataFrame([("t|a", 10, 1, "v", False), ("t|a", 30, 2, None, True), ("t|late", 50, 1, "v", False)], "entity string, known_us long, key long, value string, deleted boolean")
    kids = [("a", 5, "d1"), ("a", 12, "d1"), ("a", 35, "d2"), ("a", 36, "d2"), ("none", 1, "d1"), ("none", None, "d1"), ("none", 3, None), ("late", 1, "d1"), ("late", None, "d1"), ("late", 60, "d2"), (None, 1, "d1")]
    children = spark.createDataFrame([("t", *k) for k in kids], "table string, key string, at_us long, period string")
    got = {(r.period, r.reason): r.refs for r in references.report(parents, versions, children).collect()}
    assert got == {("d1", "MISSING"): 2, (None, "MISSING"): 1, ("d1", "LATER"): 2, ("d2", "DELETED"): 2}
    monkeypatch.setattr(references, "groups_by_period", lambda p, c, made=references.groups_by_period: made(p, c).filter("false"))
    assert references.report(parents, versions, children).count() == 0


def test_findings_come_from_the_groups(spark, monkeypatch):
    parents = spark.createDataFrame([("t", "a", 10, False)], "table string, key string, first_us long, ceases boolean")
    versions = spark.createDataFrame([("t|a", 10, 1, "v", False)], "entity string, known_us long, key long, value string, deleted boolean")
    children = spark.createDataFrame([("t", "a", 5, "k1"), ("t", "b", 5, "k2")], "table string, key string, at_us long, txn string")
    assert {(r.txn, r.reason) for r in references.findings(parents, versions, children, ["txn"]).collect()} == {("k1", "LATER"), ("k2", "MISSING")}
    monkeypatch.setattr(references, "groups", lambda p, c, made=references.groups: made(p, c).filter("false"))
    assert references.findings(parents, versions, children, ["txn"]).count() == 0


def test_dates_are_utc(spark):
    assert datetime(2026, 7, 2).toordinal() - datetime(1970, 1, 1).toordinal() == 20636
