import os
import random
import time

from tests.brute import HOUR, START, TX, busy_rows, sliding
from tidewatch.operators.features import ONLINE_FEATURES, sliding_features
from tidewatch.sources.topics import as_messages, good_events, read_tx_stream
from tidewatch.streaming import features as S
from tidewatch.streaming import sinks


def put(spark, rows, topic):
    """One more file of messages; files are read in the order they were written."""
    frame = spark.createDataFrame(rows, TX)
    as_messages(frame).coalesce(1).write.mode("append").parquet(topic)
    time.sleep(0.05)


def events(spark, topic, per_batch=1):
    return good_events(read_tx_stream(spark, "parquet", path=topic, maxFilesPerTrigger=str(per_batch)))


def run(spark, stream, out, checkpoint):
    sinks.write_stream(stream, out, checkpoint).awaitTermination()
    return {r[0]: tuple(r)[1:] for r in spark.read.parquet(out).select("tx_id", *ONLINE_FEATURES).collect()}


def test_stream_equals_batch_in_any_cut(spark, folder):
    rows = sorted(busy_rows(600, seed=3), key=lambda r: (r[2], r[0]))
    rng = random.Random(1)
    cuts = [0, *sorted(rng.sample(range(1, 600), 3)), 600]
    for a, b in zip(cuts, cuts[1:]):
        part = rows[a:b]
        rng.shuffle(part)
        put(spark, part, f"{folder}/topic")
    got = run(spark, S.stream_features(events(spark, f"{folder}/topic")), f"{folder}/out", f"{folder}/state")
    assert got == sliding(rows)
    batch = sliding_features(spark.createDataFrame(rows, TX)).select("tx_id", *ONLINE_FEATURES).collect()
    assert got == {r[0]: tuple(r)[1:] for r in batch}


def test_a_restarted_stream_goes_on_where_it_stopped(spark, folder):
    first = [("t1", "u", START, 100, "a"), ("t2", "u", START + 1000, 50, "b")]
    later = [("t3", "u", START + 2000, 70, "a")]
    put(spark, first, f"{folder}/topic")
    run(spark, S.stream_features(events(spark, f"{folder}/topic")), f"{folder}/out", f"{folder}/state")
    put(spark, later, f"{folder}/topic")
    got = run(spark, S.stream_features(events(spark, f"{folder}/topic")), f"{folder}/out", f"{folder}/state")
    assert got == sliding(first + later)


def test_late_and_repeated_events(spark, folder):
    put(spark, [("t1", "u", START, 100, "a"), ("t9", "u", START + 600_000, 900, "b")], f"{folder}/topic")
    put(spark, [("t5", "u", START + 300_000, 500, "c"), ("t9", "u", START + 600_000, 900, "b")], f"{folder}/topic")
    stream = S.stream_features(events(spark, f"{folder}/topic"), lateness_ms=HOUR)
    sinks.write_stream(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").collect()
    late = [r for r in rows if r["tx_id"] == "t5"][0]
    # it sees what happened before it, and not t9
    assert (late["tx_count_10m"], late["amt_sum_1h"], late["max_amt_1h"], late["seconds_since_last_tx"]) == (2, 600, 500, 300.0)
    again = [r for r in rows if r["tx_id"] == "t9"]
    assert sorted(r["amt_sum_1h"] for r in again) == [1000, 1500]  # the repeat replaces, it does not add


def test_an_event_beyond_the_lateness_passes_with_null_features(spark, folder):
    put(spark, [("t1", "u", START, 100, "a"), ("t9", "u", START + 3_600_000, 900, "b")], f"{folder}/topic")
    put(spark, [("t5", "u", START + 300_000, 500, "c"), ("t6", "u", START + 3_500_000, 5, "c")], f"{folder}/topic")
    got = run(spark, S.stream_features(events(spark, f"{folder}/topic")), f"{folder}/out", f"{folder}/state")
    assert got["t5"] == (None,) * 6 and got["t6"][0] == 1 and got["t9"][:2] == (1, 900)


def test_keyless_rows_pass_without_state(spark, folder):
    put(spark, [("t1", None, START, 5, "a"), ("t2", "", START, 5, "a"), ("t3", "u", START, 5, "a")], f"{folder}/topic")
    source = events(spark, f"{folder}/topic")
    assert set(run(spark, S.stream_features(source), f"{folder}/out", f"{folder}/state")) == {"t3"}
    got = run(spark, S.keyless(source), f"{folder}/rest", f"{folder}/rest-state")
    assert got == {"t1": (None,) * 6, "t2": (None,) * 6}


def test_features_as_one_struct(spark):
    df = sliding_features(spark.createDataFrame([("t1", "u", START, 5, "a")], TX))
    assert S.with_feature_struct(df).first()["features"]["amt_sum_1h"] == 5


def test_upsert_keeps_the_newest_row_and_is_idempotent(spark, folder):
    path = f"{folder}/online"
    write = sinks.upsert_latest(path, buckets=4)
    schema = "user_id string, ts_ms long, tx_id string, n long"
    one = spark.createDataFrame([("u", 1, "a", 1), ("u", 5, "b", 2), ("v", 1, "c", 3), (None, 9, "x", 0)], schema)
    two = spark.createDataFrame([("u", 3, "d", 4), ("w", 1, "e", 5), ("v", 1, "cc", 6)], schema)
    assert sinks.read_latest(spark, path) is None
    write(one, 0)
    write(two, 1)
    want = {("u", 5, "b", 2), ("v", 1, "cc", 6), ("w", 1, "e", 5)}
    assert {tuple(r) for r in sinks.read_latest(spark, path).select("user_id", "ts_ms", "tx_id", "n").collect()} == want
    write(two, 1)
    assert {tuple(r) for r in sinks.read_latest(spark, path).select("user_id", "ts_ms", "tx_id", "n").collect()} == want


def test_only_touched_buckets_are_written(spark, folder):
    path = f"{folder}/online"
    write = sinks.upsert_latest(path, buckets=64)
    schema = "user_id string, ts_ms long, tx_id string"
    write(spark.createDataFrame([(f"u{i}", 1, "a") for i in range(100)], schema), 0)
    write(spark.createDataFrame([("u7", 2, "b")], schema), 1)
    assert len([d for d in os.listdir(f"{path}/v={1:010d}") if d.startswith("bucket=")]) == 1
    assert sinks.read_latest(spark, path).count() == 100


def test_repeats_are_dropped_within_the_watermark(spark, folder):
    put(spark, [("t1", "u", START, 5, "a"), ("t1", "u", START + 1000, 5, "a"), ("t2", "u", START, 5, "a")], f"{folder}/topic")
    put(spark, [("t2", "u", START + 2000, 5, "a"), ("t3", "u", START + 2000, 5, "a")], f"{folder}/topic")
    S.use_rocksdb(spark)
    stream = sinks.deduplicated(events(spark, f"{folder}/topic"), ["tx_id"])
    sinks.write_stream(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    assert sorted(r["tx_id"] for r in spark.read.parquet(f"{folder}/out").collect()) == ["t1", "t2", "t3"]


def test_newest_rows_over_batches(spark, folder):
    write = sinks.keep_recent(f"{folder}/recent", 3)
    schema = "tx_id string, ts_ms long"
    write(spark.createDataFrame([("a", 1), ("b", 9), ("c", 5), ("d", 7)], schema), 0)
    write(spark.createDataFrame([("e", 8), ("f", 2)], schema), 1)
    assert {r["tx_id"] for r in sinks.snapshot(spark, f"{folder}/recent", 1).collect()} == {"b", "e", "d"}


def test_progress_is_observed(spark, folder):
    put(spark, [("t1", "u", START, 5, "a"), ("t2", "u", START + 7, 5, "a")], f"{folder}/topic")
    listener = sinks.ProgressListener()
    spark.streams.addListener(listener)
    try:
        stream = sinks.observed(events(spark, f"{folder}/topic"))
        sinks.write_stream(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
        for _ in range(100):
            if listener.samples:
                break
            time.sleep(0.1)
        assert listener.samples[0] == {"rows": 2, "max_ts_ms": START + 7}
    finally:
        spark.streams.removeListener(listener)


def test_decisions_are_partitioned_by_date_and_hour(spark):
    df = spark.createDataFrame([("t1", START)], "tx_id string, ts_ms long")
    row = sinks.decision_log(df, "r1", "m1", "p1").first()
    assert (str(row["date"]), row["hour"], row["policy_id"]) == ("2023-11-15", 0, "p1")


def test_a_gap_to_a_later_event_is_zero():
    ((_, found),) = S.walk([(START, "t1", 5, "a", True)], START + 1000)
    assert found[4] == 0.0
