"""Joins of streams within bounds of time. Both sides have watermarks, so state is freed once no partner can come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.history import event_time

#: Windows in a cell of time: more of them mean fewer copies of a chain and more payments that it is compared with.
CELL_WINDOWS = 4


def with_outcomes(
    decisions: DataFrame,
    outcomes: DataFrame,
    horizon: str = "120 days",
    lateness: str = "10 minutes",
    key: str = "tx_id",
    outcome_ts: str = "outcome_ms",
) -> DataFrame:
    """Decisions with what became of them: a stream of outcomes (``key``, ``outcome_ts`` and other columns, for example
    chargebacks) joined to a stream of decisions.

    An outcome belongs to the decision of its key if it comes at the time of the decision or up to ``horizon`` later.
    A decision goes out with each of its outcomes as that comes, and with nulls once the watermark has passed its horizon
    without any. Both streams may be out of order by ``lateness``; what comes later is dropped by its watermark. A
    decision waits for ``horizon`` and an outcome for ``lateness``, so state follows the traffic of that time. Rows
    without a key or a time have no partner: outcomes are dropped, decisions go out with nulls (those without a time not
    at all, as no watermark passes them).
    """
    renamed = {c: f"_{c}" if c in decisions.columns else c for c in outcomes.columns}
    right = outcomes.select(*[F.col(c).alias(n) for c, n in renamed.items()])
    right = right.where(F.col(renamed[key]).isNotNull())
    right = right.withColumn("_outcome_at", F.timestamp_millis(renamed[outcome_ts])).withWatermark("_outcome_at", lateness)
    left = event_time(decisions).withWatermark("ts", lateness)
    near = (F.col("_outcome_at") >= F.col("ts")) & (F.col("_outcome_at") <= F.col("ts") + F.expr(f"INTERVAL {horizon}"))
    joined = left.join(right, (F.col(key) == F.col(renamed[key])) & near, "left_outer")
    return joined.select(*decisions.columns, *[F.col(n).alias(n.removeprefix("_")) for c, n in renamed.items() if c not in decisions.columns])


def payment_chains(transfers: DataFrame, hops: int = 3, window_ms: int = 600_000, lateness: str = "10 minutes") -> DataFrame:
    """Chains of ``hops`` payments, each from the payee of the last and later than it, all within ``window_ms``.

    ``transfers`` is a stream with ``tx_id, src, dst, ts_ms, amount_minor``. A row comes out for every chain: its last
    transfer and ``chain_start_ms``. Payments to oneself do not count; an account may occur twice in a chain. Which
    transfers complete a chain, and since when at the latest, is the maximum of ``chain_start_ms`` per ``tx_id``; a
    keyed upsert on that order keeps it.

    Each hop is a join on the account in the middle; a chain or payment waits for ``window_ms`` plus the lateness. The
    join gives out pairs, so an account with p payers and q payees within the window gives p x q chains. It is also on a
    cell of ``CELL_WINDOWS`` windows of time, and a chain waits in each cell that its window reaches: else a payment would
    be compared with all that wait for the account, and with a long lateness that is much more than a window.
    """
    span, cell_ms = F.expr(f"INTERVAL {window_ms // 1000} SECONDS"), CELL_WINDOWS * window_ms

    def cell(ms):
        return F.floor(ms / cell_ms)

    def payments() -> DataFrame:
        step = event_time(transfers).withWatermark("ts", lateness)
        return step.where("src <> dst").select("tx_id", "src", "dst", "ts_ms", "amount_minor", "ts")

    chains = payments().withColumn("chain_start_ms", F.col("ts_ms"))
    for _ in range(1, hops):
        cells = F.explode(F.sequence(cell(F.col("ts_ms")), cell(F.col("ts_ms") + window_ms)))
        before = chains.select(F.col("dst").alias("_at"), F.col("ts").alias("_before"), "chain_start_ms", cells.alias("_in"))
        step = payments().withColumn("_cell", cell(F.col("ts_ms")))
        follows = (step["src"] == before["_at"]) & (step["_cell"] == before["_in"])
        follows &= (step["ts"] > before["_before"]) & (step["ts"] <= before["_before"] + span)
        inside = step["ts_ms"] - before["chain_start_ms"] <= window_ms
        chains = before.join(step, follows & inside).select(*[step[c] for c in step.columns if c != "_cell"], "chain_start_ms")
    return chains.drop("ts")
