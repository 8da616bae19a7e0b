"""Sliding features on event-time timers: events wait until the watermark has passed them and are told in order.

``streaming.features`` tells an event at once and lets a late one see what is still held. Here nothing is told before its
time is complete, so the result does not depend on the order of arrival within the lateness; what comes after its time
was told is given out as late. Built-in windows can't say a feature per event, which is why this is state code.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.cells import DAY_MS, HOUR_MS
from tidewatch.operators.features import ONLINE_FEATURES, TEN_MINUTES_MS, stream_defaults
from tidewatch.streaming.features import EVENT, FEATURES, walk

_HELD = ["user_id", "ts_ms", "tx_id", "amount_minor", "mcc"]
_STATE = "user_id array<string>, ts_ms array<long>, tx_id array<string>, amount_minor array<long>, mcc array<string>"
_LAST = "user_id array<string>, ts_ms array<long>"
_OUT = ["tx_id", "user_id", "amount_minor", "mcc", "ts_ms", *ONLINE_FEATURES, "late"]
_NOTHING = (None,) * len(ONLINE_FEATURES)
#: Events in one row of state.
_RUN = 10_000


class TimedFeatures(StatefulProcessor):
    """State per bucket of users: events that wait for their time, told events of each user's last hour, and the time of
    each user's newest told one.

    The key is a bucket and not a user, and a row of state holds a run of events, because every call for a key and every
    row of state is a message between Python and the JVM: one per user and batch costs far more than the events do.

    ``frontier`` is the time up to which everything has come: the newest event time of the stream less the lateness.
    Spark's watermark is ``grace_ms`` behind it, so that events which are late by no more than that still get here and
    can be told as late. One timer per bucket stands at the next moment something is due: an event to be told, the end of
    an hour's window, or the end of a user's state.
    """

    def __init__(self, grace_ms: int, last_ttl_ms: int):
        self.grace_ms, self.last_ttl_ms = grace_ms, last_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _STATE)
        self.held = handle.getListState("held", _STATE)
        self.last = handle.getListState("last", _LAST)

    def _rows(self, state) -> list[tuple]:
        return [row for run in state.get() for row in zip(*run)] if state.exists() else []

    def _wake_at(self, due: int) -> None:
        """The bucket's one timer: when the frontier is beyond ``due``."""
        at = max(1, due - self.grace_ms + 1)
        set_already = list(self.handle.listTimers())
        if set_already == [at]:
            return
        for timer in set_already:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frontier = timerValues.getCurrentWatermarkInMs() + self.grace_ms
        waiting = self._rows(self.waiting)
        known = {(e[0], e[2]) for e in waiting} | {(e[0], e[2]) for e in self._rows(self.held)}
        late, new = [], []
        for chunk in rows:
            for event in zip(*[chunk[c].tolist() for c in _HELD]):
                if (event[0], event[2]) not in known:
                    known.add((event[0], event[2]))
                    (late if event[1] < frontier else new).append(event)
        if new:
            self.waiting.appendList(_runs(new))
            self._wake_at(min(min(e[1] for e in part) for part in (waiting, new) if part))
        if late:
            yield self._frame([(e, _NOTHING, True) for e in late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        frontier = timerValues.getCurrentWatermarkInMs() + self.grace_ms
        waiting, held, last = self._rows(self.waiting), self._rows(self.held), dict(self._rows(self.last))
        due, rest = sorted(e for e in waiting if e[1] < frontier), [e for e in waiting if e[1] >= frontier]
        seen = {user: list(events) for user, events in groupby(sorted(held), itemgetter(0))}
        told = []
        for user, events in groupby(due, itemgetter(0)):
            events = list(events)
            line = [*((*e[1:], False) for e in seen.get(user, [])), *((*e[1:], True) for e in events)]
            for event, found in walk(line, last.get(user)):
                gap = found[4] if found[4] * 1000 <= self.last_ttl_ms else -1.0
                told.append(((user, *event[:4]), (*found[:4], gap, found[5]), False))
            last[user] = events[-1][1]
            seen[user] = [e for e in [*seen.get(user, []), *events] if e[1] > last[user] - HOUR_MS]
        held = [e for events in seen.values() if frontier <= events[-1][1] + HOUR_MS for e in events]
        last = {user: at for user, at in last.items() if frontier <= at + self.last_ttl_ms}
        if due:
            self._keep(self.waiting, rest)
        self._keep(self.held, held)
        self._keep(self.last, list(last.items()))
        ends = [e[1] for e in rest] or [e[1] + HOUR_MS for e in held] or [at + self.last_ttl_ms for at in last.values()]
        if ends:
            self._wake_at(max(frontier, min(ends)))
        if told:
            yield self._frame(told)

    def _keep(self, state, rows: list[tuple]) -> None:
        if rows:
            state.put(_runs(rows))
        else:
            state.clear()

    def _frame(self, told: list[tuple]) -> pd.DataFrame:
        rows = [(e[2], e[0], e[3], e[4], e[1], *found, late) for e, found, late in told]
        frame = pd.DataFrame(rows, columns=_OUT)
        return frame.astype({c: "Int64" for c in ("amount_minor", "ts_ms", *ONLINE_FEATURES[:4], ONLINE_FEATURES[5])})

    def close(self) -> None:
        pass


def _runs(rows: list[tuple]) -> list[tuple]:
    """Rows as columns, ``_RUN`` of them to a row of state."""
    return [tuple(map(list, zip(*rows[k : k + _RUN]))) for k in range(0, len(rows), _RUN)]


def timed_features(
    events: DataFrame, lateness_ms: int = TEN_MINUTES_MS, grace_ms: int = HOUR_MS, last_ttl_ms: int = DAY_MS, buckets: int = 512
) -> DataFrame:
    """A stream of events with the online features and ``late``, each told once its time is complete.

    The features are those of the batch ``sliding_features``, but that ``seconds_since_last_tx`` is -1 after a pause of
    more than ``last_ttl_ms``, when the user's state is freed. An event that comes after the frontier (the newest event
    time of the stream less ``lateness_ms``) has passed it goes out at once with null features and ``late``; one that is
    late by ``grace_ms`` more is dropped by the watermark and counted there. A tx_id that waits or is held counts once.
    Rows without a user or a time are not kept here, see ``features.keyless``.

    State of a user is what waits (the lateness), the last hour, and one time for ``last_ttl_ms``. Users are kept in
    ``buckets`` by a hash; a task has the state of one bucket in memory at a time, so more users than some ten thousand
    a bucket want more of them. Their number belongs to the checkpoint. The stream needs the RocksDB state store, and
    empty batches after the last data to tell what is due.
    """
    rows = stream_defaults(events).where("user_id IS NOT NULL AND user_id <> '' AND ts_ms IS NOT NULL")
    rows = rows.withColumn("tx_id", F.coalesce("tx_id", F.lit("")))
    return (
        rows.select("tx_id", "user_id", "amount_minor", "mcc", "ts_ms", F.timestamp_millis("ts_ms").alias("ts"))
        .withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)))
        .withWatermark("ts", f"{lateness_ms + grace_ms} milliseconds")
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=TimedFeatures(grace_ms, last_ttl_ms),
            outputStructType=f"{EVENT}, {FEATURES}, late boolean",
            outputMode="append",
            timeMode="EventTime",
        )
    )
