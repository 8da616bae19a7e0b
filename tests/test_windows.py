import random
import re

import pytest
from pyspark.sql import functions as F

from tests.brute import HOUR, START, TEN_MINUTES, TX, busy_rows, by_key, sliding
from tidewatch.operators import cells, detect, features, history


@pytest.fixture(scope="module")
def rows():
    return busy_rows()


@pytest.fixture(scope="module")
def tx(spark, rows):
    return spark.createDataFrame(rows, TX).cache()


def features_of(df):
    return {r[0]: tuple(r)[1:] for r in df.select("tx_id", *features.ONLINE_FEATURES).collect()}


@pytest.mark.parametrize("method", ["hours", "cells"])
def test_sliding_features_equal_one_event_at_a_time(tx, rows, method):
    assert features_of(features.sliding_features(tx, method)) == sliding(rows)


def test_a_user_with_a_third_of_all_rows_in_one_minute(spark, rows):
    busy = [(f"b{i:04d}", "busy", START + i * 40, i, f"m{i % 7}") for i in range(len(rows) // 2)]
    both = [*rows, *busy]
    assert run(spark, both) == sliding(both)


def test_building_the_plan_starts_no_job(spark, tx):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "no job may start")
    features.sliding_features(tx)
    assert not tracker.getJobIdsForGroup("plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def run(spark, rows, method="hours"):
    return features_of(features.sliding_features(spark.createDataFrame(rows, TX), method))


@pytest.mark.parametrize("method", ["hours", "cells"])
def test_known_cases(spark, method):
    one = run(spark, [("t1", "u", START, 10000, "5411")], method)
    assert one["t1"] == (1, 10000, 10000, 1, -1.0, START)

    five = [(f"t{i}", "u", START + i * 1000, i * 1000, f"m{i}") for i in range(1, 6)]
    assert run(spark, five, method)["t5"][:4] == (5, 15000, 5000, 5)

    gap = run(spark, [("t1", "u", START, 1, "a"), ("t2", "u", START + 10_000, 1, "a")], method)
    assert (gap["t1"][4], gap["t2"][4]) == (-1.0, 10.0)

    ten = run(spark, [("t1", "u", START, 9999, "a"), ("t2", "u", START + 900_000, 1000, "a")], method)
    assert ten["t2"][:2] == (1, 10999)

    hour = run(spark, [("t1", "u", START, 9999, "a"), ("t2", "u", START + 2 * HOUR, 1000, "a")], method)
    assert hour["t2"][1:3] == (1000, 1000)

    edge = run(spark, [("t1", "u", START, 5, "a"), ("t2", "u", START + TEN_MINUTES, 5, "a"), ("t3", "u", START + HOUR, 5, "a")], method)
    assert edge["t2"][0] == 1 and edge["t3"][1] == 10

    tie = run(spark, [("t1", "u", START, 5, "a"), ("t2", "u", START, 7, "b")], method)
    assert tie["t1"][:4] == (1, 5, 5, 1) and tie["t2"][:4] == (2, 12, 7, 2)

    far = run(spark, [("t1", "u", START, 5, "a"), ("t2", "u", START + 100 * HOUR, 7, "b")], method)
    assert far["t2"][4] == 360000.0


def test_rows_without_user_pass_untouched(spark):
    rows = [("t1", None, START, 5, "a"), ("t2", "", START, 5, "a"), ("t3", "u", START, None, None)]
    out = run(spark, rows)
    assert out["t1"] == out["t2"] == (None,) * 6
    assert out["t3"] == (1, 0, 0, 1, -1.0, START)


def test_missing_time_becomes_the_time_of_arrival(spark):
    df = spark.createDataFrame([("t1", "u", 0, 5, ""), ("t2", "u", None, 5, None)], TX)
    out = features.stream_defaults(df, F.lit(START)).collect()
    assert {r["ts_ms"] for r in out} == {START} and {r["mcc"] for r in out} == {"unknown"}


@pytest.mark.parametrize("cell_ms", [TEN_MINUTES, HOUR, 24 * HOUR])
def test_trailing_sums_do_not_depend_on_the_cells(tx, rows, cell_ms):
    sums = {"n": (HOUR, F.lit(1)), "total": (5 * HOUR, F.col("amount_minor"))}
    for include in (True, False):
        out = cells.trailing(tx, "user_id", sums, cell_ms=cell_ms, include_current=include)
        got = {r["tx_id"]: (r["n"], r["total"]) for r in out.collect()}
        for events in by_key(rows).values():
            for i, r in enumerate(events):
                seen = events[: i + 1 if include else i]
                want = (sum(x[2] > r[2] - HOUR for x in seen), sum(x[3] for x in seen if x[2] > r[2] - 5 * HOUR))
                assert got[r[0]] == want


def test_trailing_distinct_and_max(tx, rows):
    named = tx.withColumn("mcc", F.nullif("mcc", F.lit("")))
    distinct = cells.trailing_distinct(named, "user_id", "mcc", 2 * HOUR, "d", cell_ms=TEN_MINUTES)
    largest = cells.trailing_max(tx, "user_id", "amount_minor", 2 * HOUR, "m", cell_ms=TEN_MINUTES)
    d = {r["tx_id"]: r["d"] for r in distinct.collect()}
    m = {r["tx_id"]: r["m"] for r in largest.collect()}
    for events in by_key(rows).values():
        for i, r in enumerate(events):
            inside = [x for x in events[: i + 1] if x[2] > r[2] - 2 * HOUR]
            assert d[r[0]] == len({x[4] for x in inside if x[4]})
            assert m[r[0]] == max(x[3] for x in inside)


def test_max_refuses_cells_that_do_not_divide_the_horizon(tx):
    with pytest.raises(ValueError):
        cells.trailing_max(tx, "user_id", "amount_minor", HOUR, "m", cell_ms=7 * TEN_MINUTES)


def test_rows_without_key_keep_their_place(spark):
    df = spark.createDataFrame([("t1", None, START, 5, "a"), ("t2", "u", START, 5, "a")], TX)
    out = cells.trailing(df, "user_id", {"n": (HOUR, F.lit(1))})
    assert {r["tx_id"]: r["n"] for r in out.collect()} == {"t1": None, "t2": 1}
    out = cells.trailing_distinct(df, "user_id", "mcc", HOUR, "n")
    assert {r["tx_id"]: r["n"] for r in out.collect()} == {"t1": None, "t2": 1}


def test_neighbours_across_empty_cells(tx, rows):
    before = cells.previous_row(tx, ["user_id"], "ts_ms", "tx_id", ["amount_minor", "mcc"], TEN_MINUTES)
    near = cells.neighbour_times(tx, ["user_id"], "ts_ms", "tx_id", TEN_MINUTES)
    b = {r["tx_id"]: (r["prev_amount_minor"], r["prev_mcc"]) for r in before.collect()}
    n = {r["tx_id"]: (r["prev_ts"], r["next_ts"]) for r in near.collect()}
    for events in by_key(rows).values():
        for i, r in enumerate(events):
            assert b[r[0]] == ((events[i - 1][3], events[i - 1][4]) if i else (None, None))
            assert n[r[0]] == (events[i - 1][2] if i else None, events[i + 1][2] if i + 1 < len(events) else None)


@pytest.mark.parametrize("gap,cell_ms", [(60_000, TEN_MINUTES), (600_000, TEN_MINUTES), (3 * HOUR, TEN_MINUTES), (600_000, 24 * HOUR)])
def test_run_position(spark, gap, cell_ms):
    rng = random.Random(gap)
    rows, t = [], START
    for i in range(800):
        t += rng.choice([0, 1000, gap // 2, gap, gap + 1, gap * 3])
        rows.append((f"t{i:04d}", rng.choice("ab"), t, 0, ""))
    out = cells.run_position(spark.createDataFrame(rows, TX), "user_id", "ts_ms", "tx_id", gap, "p", cell_ms)
    got = {r["tx_id"]: r["p"] for r in out.collect()}
    for events in by_key(rows).values():
        position = 0
        for i, r in enumerate(events):
            position = position + 1 if i and r[2] - events[i - 1][2] <= gap else 1
            assert got[r[0]] == position


def test_running_totals_without_keys(tx, rows):
    cut = tx.withColumn("_cell", cells.cell_of(F.col("ts_ms"), HOUR))
    out = cells.running_totals(cut, [], "_cell", [F.col("ts_ms"), F.col("tx_id")], {"s": F.col("amount_minor")})
    total, want = 0, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        total += r[3]
        want[r[0]] = total
    assert {r["tx_id"]: r["s"] for r in out.collect()} == want


@pytest.mark.parametrize("method", ["hours"])
def test_windows_over_rows_never_cover_a_whole_user(tx, method):
    """They are partitioned by (user, cell); only the table with a row per cell goes by user alone."""
    plan = features.sliding_features(tx, method)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) >= 4
    for line in windows:
        partition = re.search(r", \[([^\[\]]*)\](, \[[^\[\]]*\])?$", line.rstrip()).group(1)
        assert "cell" in partition or "lag(_last" in line


def test_offline_features_on_edge_cases(spark):
    schema = TX + ", merchant_id string, country string, channel string, label int"
    rows = [
        ("t1", "one", START, 500, "a", "m", "US", "mobile", None),
        ("t2", "two", START, 100, "a", "m", None, "ecommerce", 1),
        ("t3", "two", START + 4000, 300, None, "n", "US", "ecommerce", 0),
        ("t4", "odd", START, 100, "a", "m", "US", "atm", -1),
    ]
    out = {r["user_id"]: r for r in features.offline_features(spark.createDataFrame(rows, schema)).collect()}
    one, two, odd = out["one"], out["two"], out["odd"]
    assert (one["amt_std_30d"], one["avg_seconds_between_tx"], one["fraud_rate_user"], one["has_fraud_label"]) == (0.0, 0.0, 0.0, None)
    assert (two["tx_count_30d"], two["amt_mean_30d"], two["amt_std_30d"], two["avg_seconds_between_tx"]) == (2, 200.0, 100.0, 4.0)
    assert (two["distinct_mcc_30d"], two["distinct_merchant_30d"], two["distinct_country_30d"], two["fraud_rate_user"]) == (1, 2, 1, 0.5)
    assert (odd["has_fraud_label"], odd["fraud_rate_user"], odd["pct_mobile"]) == (-1, 0.0, 0.0)


def test_velocity_bin(spark):
    df = spark.createDataFrame([(1,), (4,), (30,), (None,)], "n int")
    got = [r[0] for r in df.select(features.velocity_bin(F.col("n"), (4, 10), ("low", "medium", "high"))).collect()]
    assert got == ["low", "medium", "high", None]


def test_weekday_hour_map(spark):
    df = spark.createDataFrame([("t1", "u", START, 1, "a"), ("t2", "u", START + 60_000, 1, "a"), ("t3", "u", START + 25 * HOUR, 1, "a")], TX)
    row = features.weekday_hour_map(df).first()
    assert row["weekday_hour"] == {"2-0": 2, "3-1": 1}


ODD = [("t1", "u", START, 100, "a"), ("t2", None, START, 5, "a"), ("t3", "u", None, 7, "b"), ("t4", "u", START + 60_000, 2000, "a"), ("t5", "", START, 1, None)]


def test_rows_without_key_or_time_are_kept_and_seen_by_no_other(spark):
    df = spark.createDataFrame(ODD, TX)
    placed = df.filter("tx_id IN ('t1', 't4', 't5')")

    def both(apply, column):
        whole = {r["tx_id"]: r[column] for r in apply(df).collect()}
        alone = {r["tx_id"]: r[column] for r in apply(placed).collect()}
        assert sorted(whole) == ["t1", "t2", "t3", "t4", "t5"]
        assert {k: whole[k] for k in alone} == alone
        assert whole["t2"] in (None, False) and whole["t3"] in (None, False)

    both(lambda d: cells.previous_row(d, ["user_id"], "ts_ms", "tx_id", ["amount_minor"]), "prev_amount_minor")
    both(lambda d: cells.neighbour_times(d, ["user_id"], "ts_ms", "tx_id"), "next_ts")
    both(lambda d: cells.run_position(d, "user_id", "ts_ms", "tx_id", HOUR, "n"), "n")
    both(lambda d: cells.trailing(d, "user_id", {"n": (HOUR, F.lit(1))}), "n")
    both(lambda d: cells.trailing_max(d, "user_id", "amount_minor", HOUR, "n"), "n")
    both(lambda d: cells.trailing_distinct(d, "user_id", "mcc", HOUR, "n"), "n")
    both(lambda d: features.prior_outcomes(d, {"n": F.col("amount_minor") > 50}), "n")
    both(lambda d: features.travel(d.withColumns({"lat": F.lit(1.0), "lon": F.col("amount_minor").cast("double")})), "distance_from_last_km")
    both(detect.fat_finger, "fat_finger")


def test_a_missing_time_leaves_the_profile_of_the_user(spark):
    df = spark.createDataFrame([("t0", "u", None, 1, "a"), ("t1", "u", START, 1, "a"), ("t2", "u", START + 5, 1, "b")], TX)
    out = history.profile_versions(df, "user_id", ["mcc"]).orderBy("valid_from").collect()
    assert [(r["mcc"], r["valid_from"], r["is_current"]) for r in out] == [("a", START, False), ("b", START + 5, True)]


def test_spikes_look_at_the_busy_slots_before(spark):
    counts = {0: 4, 1: 2, 3: 12, 70: 5, 71: 20}
    rows = [(f"{slot}-{i}", "u", slot * 60_000 + i, 1, "a") for slot, n in counts.items() for i in range(n)]
    out = {r["slot_start_ms"] // 60_000: (r["tx_count"], r["usual"], r["spike"]) for r in history.spikes(spark.createDataFrame(rows, TX)).collect()}
    assert out == {0: (4, None, False), 1: (2, 4.0, False), 3: (12, 3.0, True), 70: (5, None, False), 71: (20, 5.0, True)}
