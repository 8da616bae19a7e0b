"""Two tables on one time line: what was known about a key at the time of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.cells import DAY_MS, cell_of, placed_rows, running_maximum, running_totals


def as_of_join(
    facts: DataFrame,
    history: DataFrame,
    key: str,
    columns: dict[str, str],
    ts: str = "ts_ms",
    history_ts: str = "ts_ms",
    tie: str | None = None,
    strict: bool = False,
    tolerance_ms: int | None = None,
    until: str | None = None,
    cell_ms: int = DAY_MS,
) -> DataFrame:
    """``facts`` with ``columns`` (new name -> column of ``history``) of the newest row of ``history`` of the same key
    whose time is at or before the row's own (before it, if ``strict``).

    Of rows of ``history`` with one key and time the one with the largest ``tie`` counts (without ``tie``: with the
    largest ``columns``). A value older than ``tolerance_ms`` is not taken, nor one whose ``until`` (exclusive; null
    is open) has come; then, and where there is no earlier row, the new columns are null. Every row of ``facts`` comes
    out once; one without a key or a time gets nulls, and rows of ``history`` without them say nothing.

    Rows of both tables stand on one time line per key, cut into cells of ``cell_ms``. Inside a cell the last value is
    carried on by one running frame; what a cell begins with is the last value of the cells before, a row per (key,
    cell). So a key with a third of all rows is as many tasks as it has cells, and nothing is paired.
    """
    placed, others = placed_rows(facts, [key], ts)
    known, _ = placed_rows(history, [key], history_ts)
    order = [F.col(tie).alias("tie")] if tie else []
    extra = [F.col(until).alias("until")] if until else []
    image = F.struct(
        F.col(history_ts).cast("long").alias("at"), *order, *[F.col(old).alias(f"c{k}") for k, old in enumerate(columns.values())], *extra
    )
    told = known.select(F.col(key).alias("_key"), F.col(history_ts).cast("long").alias("_at"), image.alias("_told"))
    asked = placed.select(F.col(key).alias("_key"), F.col(ts).cast("long").alias("_at"), F.struct(*facts.columns).alias("_row"))
    line = told.unionByName(asked, allowMissingColumns=True).withColumn("_cell", cell_of(F.col("_at"), cell_ms))
    asks = F.col("_row").isNotNull()
    # at one time, history comes before the rows that may see it
    turn = F.when(asks, 0 if strict else 1).otherwise(1 if strict else 0)
    # the largest image so far is the newest, as images begin with their time
    line = line.withColumn("_turn", turn)
    best = running_maximum(line, ["_key"], "_cell", [F.col("_at"), F.col("_turn")], F.col("_told"), "_best")
    fresh = F.col("_best").isNotNull()
    if tolerance_ms is not None:
        fresh = fresh & (F.col("_at") - F.col("_best.at") <= tolerance_ms)
    if until:
        fresh = fresh & F.coalesce(F.col("_at") < F.col("_best.until"), F.lit(True))
    names = {new: F.when(fresh, F.col(f"_best.c{k}")) for k, new in enumerate(columns)}
    out = best.where(asks).select(*[F.col("_row")[c].alias(c) for c in facts.columns], *[v.alias(n) for n, v in names.items()])
    return out.unionByName(others, allowMissingColumns=True)


def known_totals(
    df: DataFrame, key: str, sums: dict[str, Column], largest: dict[str, Column] | None = None, ts: str = "ts_ms", step_ms: int = DAY_MS
) -> DataFrame:
    """Nightly snapshots: per key and step with rows, the totals over all its rows up to the end of that step.

    ``known_ms`` is when a snapshot is there for use: the end of its step. Columns are ``sums`` and ``largest`` (running
    sums of integers and running maxima) so far. Rows without a key or a time are left out.
    """
    placed, _ = placed_rows(df, [key], ts)
    largest = largest or {}
    steps = placed.groupBy(key, cell_of(F.col(ts), step_ms).alias("_step")).agg(
        *[F.sum(v).alias(f"_s_{n}") for n, v in sums.items()], *[F.max(v).alias(f"_m_{n}") for n, v in largest.items()]
    )
    steps = steps.withColumn("_cell", F.floor(F.col("_step") / 4096))
    out = running_totals(steps, [key], "_cell", [F.col("_step")], {n: F.col(f"_s_{n}") for n in sums})
    for name in largest:
        out = running_maximum(out, [key], "_cell", [F.col("_step")], F.col(f"_m_{name}"), name)
    return out.select(key, ((F.col("_step") + 1) * step_ms).alias("known_ms"), *sums, *largest)
