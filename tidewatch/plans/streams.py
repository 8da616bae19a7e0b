"""Streaming queries: the tables are replayed as messages, read back as a stream and run to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators.features import ONLINE_FEATURES, offline_features
from tidewatch.operators.history import running_kpis
from tidewatch.plans import query
from tidewatch.plans.features import SLIDING_COLUMNS
from tidewatch.plans.history import _DECIDED, _ONLINE, decided, shown_windows
from tidewatch.plans.views import EV, offline, sliding
from tidewatch.session import new_folder
from tidewatch.sources.tables import events_as_tx
from tidewatch.sources.topics import good_events, read_tx_stream, replay
from tidewatch.streaming import features, sinks


def event_stream(spark, folder):
    """The events, written as messages in order of time and read back as a stream."""
    topic = new_folder(spark, "topic")
    replay(events_as_tx(spark, folder).select("tx_id", "user_id", "amount_minor", "mcc", "ts_ms"), "parquet", path=topic)
    return good_events(read_tx_stream(spark, "parquet", path=topic))


def run_to_table(spark, stream, name):
    """Runs a stream over all there is into Parquet and reads the result."""
    out, checkpoint = new_folder(spark, name), new_folder(spark, f"{name}-state")
    sinks.write_stream(stream, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query(f"WITH {EV} SELECT {', '.join(SLIDING_COLUMNS)} FROM ({sliding('ev')})")
def stream_sliding_features(spark, folder):
    out = run_to_table(spark, features.stream_features(event_stream(spark, folder)), "features")
    return out.select(*SLIDING_COLUMNS)


@query(f"WITH {EV}, {_ONLINE} SELECT user_id, tx_id, ts_ms, {', '.join(ONLINE_FEATURES)} FROM o")
def stream_online_table(spark, folder):
    path, checkpoint = new_folder(spark, "online"), new_folder(spark, "online-state")
    stream = features.stream_features(event_stream(spark, folder))
    sinks.write_batches(stream, sinks.upsert_latest(path, buckets=8), checkpoint).awaitTermination()
    return sinks.read_latest(spark, path).select("user_id", "tx_id", "ts_ms", *ONLINE_FEATURES)


@query(f"WITH {EV}, {_ONLINE} SELECT user_id, tx_id, ts_ms FROM o WHERE ts_ms > (SELECT max(ts_ms) FROM ev) - 86400000")
def stream_online_unexpired(spark, folder):
    path, checkpoint = new_folder(spark, "online"), new_folder(spark, "online-state")
    events = event_stream(spark, folder)
    sinks.write_batches(events, sinks.upsert_latest(path), checkpoint).awaitTermination()
    newest = sinks.read_latest(spark, path).agg(F.max("ts_ms")).first()[0]
    return sinks.read_latest(spark, path, now_ms=newest).select("user_id", "tx_id", "ts_ms")


@query(f"WITH {EV} SELECT tx_id, amount_minor FROM ev")
def stream_without_repeats(spark, folder):
    features.use_rocksdb(spark)
    events = event_stream(spark, folder)
    twice = sinks.union_streams(events, events)
    return run_to_table(spark, sinks.deduplicated(twice, ["tx_id"]), "unique").select("tx_id", "amount_minor")


@query(
    f"WITH {EV}, w AS (SELECT ts_ms // 10000 AS s, amount_minor, user_id FROM ev WHERE ts_ms // 10000 * 10000 + 10000 <= (SELECT max(ts_ms) - 5000 FROM ev))"
    " SELECT make_timestamp(s * 10000000) AS window_start, make_timestamp((s + 1) * 10000000) AS window_end, count(*) AS tx_count,"
    " CAST(sum(amount_minor) AS BIGINT) AS amount_minor, count(DISTINCT user_id) AS users_approx FROM w GROUP BY s"
)
def stream_tumbling_windows(spark, folder):
    # windows that the watermark has passed are given out; this needs the empty batch after the last data
    features.use_rocksdb(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    windows = sinks.stream_windows(event_stream(spark, folder), "10 seconds")
    return shown_windows(run_to_table(spark, windows, "windows"))


@query(
    f"WITH {EV}, f AS ({offline('ev')}) SELECT tx_id, amount_minor, f.tx_count_30d, f.amt_max_30d FROM ev LEFT JOIN f USING (user_id)"
)
def stream_with_profile(spark, folder):
    profile = offline_features(events_as_tx(spark, folder)).select("user_id", "tx_count_30d", "amt_max_30d")
    out = run_to_table(spark, sinks.enriched(event_stream(spark, folder), profile), "enriched")
    return out.select("tx_id", "amount_minor", "tx_count_30d", "amt_max_30d")


@query(
    f"WITH {_DECIDED}, s AS (SELECT ts_ms // 1000 AS second, count(*) AS tps, avg(latency_ms) AS latency, count(*) FILTER (action <> 'APPROVE')"
    " AS bad FROM d WHERE ts_ms // 1000 * 1000 + 1000 <= (SELECT max(ts_ms) - 5000 FROM d) GROUP BY 1) SELECT second, tps,"
    " CAST(printf('%.2f', latency) AS DOUBLE) AS latency_ms, CAST(printf('%.2f', CAST(sum(bad) OVER w AS BIGINT) *"
    " CAST(100 AS DOUBLE) / CAST(sum(tps) OVER w AS BIGINT)) AS DOUBLE) AS fraud_rate_pct FROM s WINDOW w AS (ORDER BY second)"
)
def stream_live_kpis(spark, folder):
    features.use_rocksdb(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    topic = new_folder(spark, "decisions")
    decisions = decided(spark, folder).withColumn("user_id", F.lit(""))
    replay(decisions, "parquet", path=topic)
    events = good_events(read_tx_stream(spark, "parquet", decisions.schema, path=topic))
    return running_kpis(run_to_table(spark, sinks.stream_seconds(events), "seconds"))


@query(f"WITH {EV} SELECT tx_id, ts_ms FROM ev ORDER BY ts_ms DESC, tx_id DESC LIMIT 50")
def stream_newest(spark, folder):
    path, checkpoint = new_folder(spark, "newest"), new_folder(spark, "newest-state")
    events = event_stream(spark, folder).select("tx_id", "ts_ms")
    run = sinks.write_batches(events, sinks.keep_recent(path, 50), checkpoint)
    run.awaitTermination()
    last = max(p.batchId for p in run.recentProgress if p.numInputRows)
    return sinks.snapshot(spark, path, last).select(F.col("tx_id"), F.col("ts_ms"))
