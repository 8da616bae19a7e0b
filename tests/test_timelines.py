"""As-of joins, joins of streams, timers and the merged profile, against plain Python and in arbitrary cuts."""

import random

import pytest
from pyspark.sql import functions as F

from tests.brute import HOUR, START, TX, busy_rows, sliding
from tests.test_streaming import events, put
from tidewatch.operators import bitmaps, history
from tidewatch.operators.cells import DAY_MS
from tidewatch.operators.features import ONLINE_FEATURES
from tidewatch.operators.timeline import as_of_join, known_totals
from tidewatch.plans.timelines import LONG_AFTER_MS, stateful
from tidewatch.sources.topics import as_messages, good_events, read_tx_stream
from tidewatch.streaming import guardrails, joins, sinks, timers


def as_of(facts, known, strict=False, tolerance=None):
    out = {}
    for name, user, at in facts:
        ok = [(t, tie, v) for u, t, tie, v in known if u == user and user is not None and t is not None and at is not None and (t < at or (t == at and not strict))]
        best = max(ok, default=None)
        out[name] = best[2] if best and (tolerance is None or at - best[0] <= tolerance) else None
    return out


def timeline_rows():
    rng = random.Random(11)
    users = ["hot"] * 6 + ["b", "c", "never", None]
    moment = lambda: rng.choice([None, *[START + rng.randrange(12) * DAY_MS // 3 for _ in range(9)]])
    facts = [(f"f{k}", rng.choice(users), moment()) for k in range(400)]
    known = [(rng.choice([u for u in users if u != "never"]), moment(), k, f"v{k}") for k in range(150)]
    return facts, known


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tolerance", [None, DAY_MS])
def test_as_of_join_with_ties_gaps_and_a_hot_key(spark, strict, tolerance):
    facts, known = timeline_rows()
    left = spark.createDataFrame(facts, "name string, user string, ts_ms long")
    right = spark.createDataFrame(known, "user string, at long, tie long, value string")
    for cell in (DAY_MS, 3 * HOUR):
        out = as_of_join(left, right, "user", {"got": "value"}, history_ts="at", tie="tie", strict=strict, tolerance_ms=tolerance, cell_ms=cell)
        rows = out.collect()
        assert len(rows) == len(facts) and out.columns == ["name", "user", "ts_ms", "got"]
        assert {r["name"]: r["got"] for r in rows} == as_of(facts, known, strict, tolerance)


def test_as_of_join_with_empty_sides(spark):
    facts, known = timeline_rows()
    left = spark.createDataFrame(facts, "name string, user string, ts_ms long")
    right = spark.createDataFrame(known, "user string, at long, tie long, value string")
    none = as_of_join(left, right.where("false"), "user", {"got": "value"}, history_ts="at")
    assert none.where("got IS NULL").count() == len(facts)
    assert as_of_join(left.where("false"), right, "user", {"got": "value"}, history_ts="at").count() == 0


def test_a_value_ends_with_its_validity(spark):
    left = spark.createDataFrame([("a", "u", 10), ("b", "u", 19), ("c", "u", 20)], "name string, user string, ts_ms long")
    right = spark.createDataFrame([("u", 5, 20, "x")], "user string, at long, end long, value string")
    out = as_of_join(left, right, "user", {"got": "value"}, history_ts="at", until="end").collect()
    assert {r["name"]: r["got"] for r in out} == {"a": "x", "b": "x", "c": None}


def test_a_hot_key_is_cut_into_cells(spark):
    """No task of the join sees more of a key than a cell."""
    left = spark.range(20_000).selectExpr("id AS name", "'hot' AS user", f"{START} + id * 60000 AS ts_ms")
    right = left.selectExpr("user", "ts_ms AS at", "name AS value")
    out = as_of_join(left, right, "user", {"got": "value"}, history_ts="at")
    assert out.where("got <> name").count() == 0
    assert "Window" in out._jdf.queryExecution().executedPlan().toString()


def test_snapshots_are_known_after_their_day(spark):
    rows = [("a", "u", START, 5), ("b", "u", START + 1, 9), ("c", "u", START + 3 * DAY_MS, 2), ("d", None, START, 7)]
    df = spark.createDataFrame(rows, "tx_id string, user string, ts_ms long, amount long")
    out = known_totals(df, "user", {"n": F.lit(1), "total": F.col("amount")}, {"top": F.col("amount")}).orderBy("known_ms").collect()
    midnight = (START // DAY_MS + 1) * DAY_MS
    assert [tuple(r) for r in out] == [("u", midnight, 2, 14, 9), ("u", midnight + 3 * DAY_MS, 3, 16, 9)]


# -- streams ---------------------------------------------------------------------------------------------------


def pieces(spark, rows, schema, topic, n, rng):
    """Rows as messages in ``n`` files, cut at will."""
    cuts = [0, *sorted(rng.sample(range(1, len(rows)), n - 1)), len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        as_messages(spark.createDataFrame(rows[a:b], schema)).coalesce(1).write.mode("append").parquet(topic)


def stream(spark, topic, schema):
    empty = spark.createDataFrame([], schema)
    return good_events(read_tx_stream(spark, "parquet", empty.schema, path=topic, maxFilesPerTrigger="1"))


def run(spark, df, folder, name):
    with stateful(spark):
        sinks.write_stream(df, f"{folder}/{name}", f"{folder}/{name}-state").awaitTermination()
    return spark.read.parquet(f"{folder}/{name}")


def test_outcomes_in_any_cut(spark, folder):
    rng = random.Random(4)
    made = [(f"t{k:03d}", START + k * 60_000, "", "APPROVE") for k in range(200)]
    came = [(f"t{rng.randrange(230):03d}", START + rng.randrange(400) * 60_000, "") for _ in range(150)]
    came = sorted({r[0]: r for r in came}.values(), key=lambda r: r[1])
    decided, outcome = "tx_id string, ts_ms long, user_id string, action string", "tx_id string, outcome_ms long, user_id string"
    late = [("end", LONG_AFTER_MS, "", "")], [("end too", LONG_AFTER_MS, "")]
    pieces(spark, made + late[0], decided, f"{folder}/made", 4, rng)
    pieces(spark, came + late[1], outcome, f"{folder}/came", 5, rng)
    labelled = joins.with_outcomes(stream(spark, f"{folder}/made", decided), stream(spark, f"{folder}/came", outcome), "1 hour", "1 minute")
    got = sorted((r["tx_id"], r["outcome_ms"]) for r in run(spark, labelled, folder, "out").fillna(-1).collect())
    when = {name: at for name, at, _ in came}
    want = sorted((name, when[name] if at <= when.get(name, -1) <= at + HOUR else -1) for name, at, *_ in made)
    assert got == want


def test_chains_in_any_cut(spark, folder):
    rng = random.Random(6)
    paid = [(f"p{k:03d}", rng.randrange(12), rng.randrange(12), START + k * 20_000, k, "") for k in range(250)]
    schema = "tx_id string, src long, dst long, ts_ms long, amount_minor long, user_id string"
    pieces(spark, paid, schema, f"{folder}/paid", 4, rng)
    got = run(spark, joins.payment_chains(stream(spark, f"{folder}/paid", schema)), folder, "out")
    got = sorted((r["tx_id"], r["chain_start_ms"]) for r in got.collect())
    real = [p for p in paid if p[1] != p[2]]
    want = [
        (c[0], a[3])
        for a in real for b in real if b[1] == a[2] and b[3] > a[3]
        for c in real if c[1] == b[2] and c[3] > b[3] and c[3] - a[3] <= 600_000
    ]
    assert got == sorted(want) and want


def told(spark, folder, rows, cuts, **how):
    rng = random.Random(2)
    pieces(spark, rows, TX, f"{folder}/topic", cuts, rng)
    as_messages(spark.createDataFrame([("end", "end", LONG_AFTER_MS, 0, "")], TX)).write.mode("append").parquet(f"{folder}/topic")
    return run(spark, timers.timed_features(events(spark, f"{folder}/topic"), **how), folder, "out").collect()


def test_timers_tell_shuffled_events_in_order(spark, folder):
    rng = random.Random(1)
    rows = sorted(busy_rows(500, seed=5), key=lambda r: r[2] + rng.randrange(HOUR))
    got = told(spark, folder, rows, 6, lateness_ms=2 * HOUR)
    assert {r["tx_id"]: tuple(r[c] for c in ONLINE_FEATURES) for r in got} == sliding(rows)
    assert not any(r["late"] for r in got) and len(got) == len(rows)


def test_late_expired_and_repeated_events(spark, folder):
    at = [START, START + 600_000, START + 30 * HOUR, START + 60 * HOUR]
    for name, user, ts, amount in [("a", "u", at[0], 1), ("b", "u", at[1], 2), ("c", "u", at[2], 4), ("z", "v", at[3], 0)]:
        put(spark, [(name, user, ts, amount, "m")], f"{folder}/topic")
    put(spark, [("late", "u", at[2] - 1, 9, "m"), ("d", "u", at[3] + 5, 8, "m"), ("d", "u", at[3] + 5, 8, "m")], f"{folder}/topic")
    put(spark, [("too late", "u", START, 9, "m")], f"{folder}/topic")
    put(spark, [("end", "end", LONG_AFTER_MS, 0, "m")], f"{folder}/topic")
    out = timers.timed_features(events(spark, f"{folder}/topic"), lateness_ms=HOUR, grace_ms=40 * HOUR)
    rows = {}
    for r in run(spark, out, folder, "out").collect():
        assert r["tx_id"] not in rows
        rows[r["tx_id"]] = r
    assert set(rows) == {"a", "b", "c", "z", "late", "d"}  # "too late" fell to the watermark
    assert rows["late"]["late"] and rows["late"]["tx_count_10m"] is None
    assert rows["b"]["amt_sum_1h"] == 3 and rows["b"]["seconds_since_last_tx"] == 600.0
    assert rows["c"]["amt_sum_1h"] == 4 and rows["c"]["seconds_since_last_tx"] == -1.0  # the state of a day ago is gone
    assert rows["d"]["seconds_since_last_tx"] == -1.0


def test_state_holds_an_hour_and_not_all_there_was(spark, folder):
    rows = [(f"t{k:04d}", f"u{k % 3}", START + k * 60_000, 1, "m") for k in range(1500)]  # 25 hours
    for k in range(0, 1500, 300):
        put(spark, rows[k : k + 300], f"{folder}/topic")
    out = timers.timed_features(events(spark, f"{folder}/topic"), lateness_ms=60_000, grace_ms=60_000)
    with stateful(spark):
        query = sinks.write_stream(out, f"{folder}/out", f"{folder}/state")
        query.awaitTermination()
    state = query.lastProgress["stateOperators"][0]
    # of each of three users: the events of an hour and of a batch that wait, a time, a timer and its index
    assert state["numRowsTotal"] < 3 * (60 + 60 + 40)
    assert spark.read.parquet(f"{folder}/out").count() > 1400


# -- profile, sketches, bitmaps ---------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_profile_in_any_cut_and_order(spark, folder, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["u", "u", "v", None]), f"t{k}", rng.choice([None, START + rng.randrange(40) * DAY_MS // 4]), rng.choice("ab"), rng.choice(["x", None])) for k in range(120)]
    schema = "user string, tx_id string, ts_ms long, place string, kind string"
    merge = sinks.merge_profile(folder, "user", ["place", "kind"], buckets=3)
    cuts = [0, *sorted(rng.sample(range(1, 120), 4)), 120]
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        merge(spark.createDataFrame(rows[a:b], schema), number)
    merge(spark.createDataFrame(rows[cuts[4] :], schema), 4)  # the last batch once more
    want = history.profile_versions(spark.createDataFrame(rows, schema), "user", ["place", "kind"])
    read = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert read(sinks.read_profile(spark, folder)) == read(want)


def test_only_touched_buckets_are_written_and_old_versions_go(spark, folder):
    import os

    merge = sinks.merge_profile(folder, "user", ["place"], buckets=4)
    schema = "user string, tx_id string, ts_ms long, place string"
    merge(spark.createDataFrame([(f"u{k}", "t", START, "a") for k in range(50)], schema), 0)
    for number in range(1, 6):
        merge(spark.createDataFrame([("u1", f"t{number}", START + number, f"p{number}")], schema), number)
    folders = {v: os.listdir(f"{folder}/history/{v}") for v in os.listdir(f"{folder}/history")}
    buckets = {v: [b for b in names if b.startswith("bucket=")] for v, names in folders.items()}
    assert all(len(b) <= 1 for v, b in buckets.items() if not v.endswith("0000000000"))
    assert sum(len(b) for b in buckets.values()) <= 3 + 3
    assert sinks.read_profile(spark, folder).where("user = 'u1'").count() == 6


def test_rank_error_of_merged_sketches(spark):
    made = spark.createDataFrame(
        [(START + k * 50, (k * 7919 % 40_009) ** 2 / 1e4, False, "DECLINE" if k % 5 == 0 else "APPROVE") for k in range(40_000)],
        "ts_ms long, latency_ms double, is_error boolean, action string",
    )
    out = guardrails.rolling(guardrails.step_sketches(made)).collect()
    rows = [(r["ts_ms"], r["latency_ms"]) for r in made.collect()]
    assert len(out) > 100
    for w in out[::10]:
        low, high = w["window_start"].timestamp() * 1000, w["window_end"].timestamp() * 1000
        inside = [v for t, v in rows if low <= t < high]
        assert w["n"] == len(inside)
        rank = sum(v <= w["latency"] for v in inside) / len(inside)
        assert abs(rank - 0.99) < 0.02
        assert abs(w["decline_rate"] - 0.2) < 0.02


def test_bitmaps_count_as_distinct_does(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(48), rng.choice("xy"), rng.choice([None, *range(70_000)])) for _ in range(4_000)]
    df = spark.createDataFrame(rows, "hour int, kind string, value int")
    ids = bitmaps.numbered(df, "value")
    assert ids.agg(F.min("id"), F.max("id"), F.count("*"), F.countDistinct("id")).first()[:] == (1, *[ids.count()] * 3)
    maps = bitmaps.bitmaps(df, {"hour": F.col("hour"), "kind": F.col("kind")}, "value", ids)
    read = lambda d: sorted(tuple(r) for r in d.collect())
    known = df.where("value IS NOT NULL")
    assert read(bitmaps.distinct_counts(maps, ["hour", "kind"])) == read(known.groupBy("hour", "kind").agg(F.countDistinct("value")))
    days = bitmaps.rolled_up(maps, {"day": F.floor(F.col("hour") / 24)})
    assert read(bitmaps.distinct_counts(days, ["day"])) == read(known.groupBy(F.floor(F.col("hour") / 24)).agg(F.countDistinct("value")))


def test_state_of_many_users_is_kept_in_buckets(spark, folder):
    users = 2_500
    rows = [(f"{part}{k}", f"u{k}", START + part * 60_000 + k, k, "m") for part in range(2) for k in range(users)]
    for part in (rows[:users], rows[users:]):
        put(spark, part, f"{folder}/topic")
    out = timers.timed_features(events(spark, f"{folder}/topic"), lateness_ms=HOUR)
    with stateful(spark):
        query = sinks.write_stream(out, f"{folder}/out", f"{folder}/state")
        query.awaitTermination()
    state = query.lastProgress["stateOperators"][0]
    assert 0 < state["numRowsTotal"] < users  # a row of state for each user would be more


def test_runs_of_state_hold_all_rows():
    rows = [(f"u{k}", k) for k in range(2 * timers._RUN + 1)]
    runs = timers._runs(rows)
    assert [len(r[0]) for r in runs] == [timers._RUN, timers._RUN, 1] and [e for r in runs for e in zip(*r)] == rows
