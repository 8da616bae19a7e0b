"""Sliding features on a stream: the definitions of ``operators.features.sliding_features``, kept in keyed state."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.cells import HOUR_MS
from tidewatch.operators.features import ONLINE_FEATURES, TEN_MINUTES_MS, stream_defaults

EVENT = "tx_id string, user_id string, amount_minor long, mcc string, ts_ms long"
FEATURES = (
    "tx_count_10m long, amt_sum_1h long, max_amt_1h long, distinct_mcc_1h long, seconds_since_last_tx double,"
    " last_updated_ms long"
)
_HELD = ["ts_ms", "tx_id", "amount_minor", "mcc"]
_OUT = ["tx_id", "user_id", "amount_minor", "mcc", "ts_ms", *ONLINE_FEATURES]
_NOTHING = (None,) * len(ONLINE_FEATURES)


class SlidingFeatures(StatefulProcessor):
    """State per user: the events of the last hour (plus the allowed lateness) and the time of the last event.

    A late event within the allowed lateness sees the events up to its own time, not later ones. What it should see of
    an event that is later than that is gone, so such an event passes with null features; a filter on them makes the
    side table of what came too late. An event whose tx_id is still held replaces the held one. State of users who
    stay away is freed by its time to live.
    """

    def __init__(self, lateness_ms: int = TEN_MINUTES_MS, state_ttl_ms: int = 2 * HOUR_MS, last_ttl_ms: int = 24 * HOUR_MS):
        self.lateness_ms = lateness_ms
        self.state_ttl_ms = state_ttl_ms
        self.last_ttl_ms = last_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState(
            "held", "ts_ms long, tx_id string, amount_minor long, mcc string", ttlDurationMs=self.state_ttl_ms
        )
        self.last = handle.getValueState("last", "ts_ms long", ttlDurationMs=self.last_ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = {}
        for chunk in rows:
            for event in zip(*[chunk[c].tolist() for c in _HELD]):
                new[event[1]] = event
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        last = int(self.last.get()[0]) if self.last.exists() else None
        events = sorted([(*e, False) for e in held if e[1] not in new] + [(*e, True) for e in new.values()])

        newest = max(events[-1][0], last or 0)
        self.held.put([e[:4] for e in events if e[0] > newest - HOUR_MS - self.lateness_ms])
        self.last.update((newest,))
        floor = -1 if last is None else last - self.lateness_ms
        told = [(e[1], key[0], e[2], e[3], e[0], *(f if e[0] >= floor else _NOTHING)) for e, f in walk(events, last)]
        yield pd.DataFrame(told, columns=_OUT)

    def close(self) -> None:
        pass


def walk(events: list[tuple], last: int | None) -> Iterator[tuple]:
    """(event, features) of the fresh ones among a user's ordered events (ts_ms, tx_id, amount, mcc, fresh).

    Every event enters and leaves each window once. ``last`` is the time of the last event before all of these.
    """
    hour, minutes, largest, seen = deque(), deque(), deque(), Counter()
    total, previous = 0, last
    for event in events:
        ts, _, amount, mcc, fresh = event
        while hour and hour[0][0] <= ts - HOUR_MS:
            _, gone, code = hour.popleft()
            total -= gone
            seen[code] -= 1
            if not seen[code]:
                del seen[code]
        while minutes and minutes[0] <= ts - TEN_MINUTES_MS:
            minutes.popleft()
        while largest and largest[0][0] <= ts - HOUR_MS:
            largest.popleft()
        while largest and largest[-1][1] <= amount:
            largest.pop()
        hour.append((ts, amount, mcc))
        minutes.append(ts)
        largest.append((ts, amount))
        seen[mcc] += 1
        total += amount
        if fresh:
            gap = -1.0 if previous is None else round(max(0, ts - previous) / 1000, 2)
            yield event, (len(minutes), total, max(largest[0][1], 0), len(seen), gap, ts)
        previous = ts


def use_rocksdb(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB store; empty follow-up batches would keep a bounded run from ending."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def stream_features(events: DataFrame, lateness_ms: int = TEN_MINUTES_MS, state_ttl_ms: int = 2 * HOUR_MS) -> DataFrame:
    """Adds the online features to a stream of events. Rows without a user are not kept here: see ``keyless``.

    The state of a user is bounded by the last hour; the rows of a micro-batch by the rate limit of the source.
    """
    use_rocksdb(events.sparkSession)
    rows = stream_defaults(events).filter(F.col("user_id").isNotNull() & (F.col("user_id") != ""))
    rows = rows.withColumn("tx_id", F.coalesce("tx_id", F.lit("")))
    return (
        rows.select("tx_id", "user_id", "amount_minor", "mcc", "ts_ms")
        .groupBy("user_id")
        .transformWithStateInPandas(
            statefulProcessor=SlidingFeatures(lateness_ms, state_ttl_ms),
            outputStructType=f"{EVENT}, {FEATURES}",
            outputMode="append",
            timeMode="ProcessingTime",
        )
    )


def keyless(events: DataFrame) -> DataFrame:
    """Events without a user, passed on with null features and no state."""
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (f.strip().split(" ") for f in FEATURES.split(","))]
    out = events.filter(F.col("user_id").isNull() | (F.col("user_id") == ""))
    return out.select("tx_id", "user_id", "amount_minor", "mcc", "ts_ms", *nothing)


def with_feature_struct(featured: DataFrame) -> DataFrame:
    """The features as one struct column next to the event."""
    return featured.withColumn("features", F.struct(*ONLINE_FEATURES)).drop(*ONLINE_FEATURES)
