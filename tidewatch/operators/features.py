"""Per-user features: all-history aggregates and exact sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.scalars import blank_to_null, haversine_km, seconds_2
from tidewatch.operators.cells import (
    DAY_MS,
    HOUR_MS,
    cell_of,
    placed_rows,
    previous_row,
    running_totals,
    trailing,
    trailing_distinct,
    trailing_max,
)
from tidewatch.session import cut_lineage

MINUTE_MS = 60_000
TEN_MINUTES_MS = 10 * MINUTE_MS

#: Feature columns of the online table.
ONLINE_FEATURES = [
    "tx_count_10m",
    "amt_sum_1h",
    "max_amt_1h",
    "distinct_mcc_1h",
    "seconds_since_last_tx",
    "last_updated_ms",
]


def share(condition: Column) -> Column:
    """Mean of an indicator; null counts as no."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def offline_features(df: DataFrame) -> DataFrame:
    """One row per user over all history (the ``_30d`` names are part of the contract).

    Distinct counts are exact and stay ``count(distinct)``: Spark then groups by (user, value) before it groups by
    user, so a user with millions of merchants is never one in-memory set. The mean gap between consecutive
    transactions telescopes to (last - first) / (n - 1), which needs neither window nor sort.
    """
    n = F.count(F.lit(1))
    return df.groupBy("user_id").agg(
        n.alias("tx_count_30d"),
        F.avg("amount_minor").alias("amt_mean_30d"),
        F.coalesce(F.stddev_pop("amount_minor"), F.lit(0.0)).alias("amt_std_30d"),
        F.max("amount_minor").alias("amt_max_30d"),
        F.min("amount_minor").alias("amt_min_30d"),
        F.countDistinct("mcc").alias("distinct_mcc_30d"),
        F.countDistinct("merchant_id").alias("distinct_merchant_30d"),
        F.countDistinct("country").alias("distinct_country_30d"),
        share(F.col("label") == 1).alias("fraud_rate_user"),
        share(F.col("channel") == "ecommerce").alias("pct_ecommerce"),
        share(F.col("channel") == "card_present").alias("pct_card_present"),
        share(F.col("channel") == "mobile").alias("pct_mobile"),
        F.coalesce(
            (F.max("ts_ms") - F.min("ts_ms")) / F.lit(1000.0) / F.nullif(n - 1, F.lit(0)).cast("double"), F.lit(0.0)
        ).alias("avg_seconds_between_tx"),
        F.max("label").alias("has_fraud_label"),
    )


def offline_features_asof(df: DataFrame, as_of_ms: int, window_days: int = 30) -> DataFrame:
    """The same features over the ``window_days`` before ``as_of_ms`` only: a filter that the scan can push down."""
    return offline_features(df.filter((F.col("ts_ms") > as_of_ms - window_days * DAY_MS) & (F.col("ts_ms") <= as_of_ms)))


def table_profile(features: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample standard deviation of each column, one row per column, from one aggregation."""
    wide = features.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("stddev"))
        for i, c in enumerate(columns)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def stream_defaults(df: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """Defaults of an incoming event: amount 0, mcc ``unknown``, time of arrival if it carries none."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    return (
        df.withColumn("amount_minor", F.coalesce(F.col("amount_minor"), F.lit(0)).cast("long"))
        .withColumn("mcc", F.coalesce(blank_to_null(F.col("mcc")), F.lit("unknown")))
        .withColumn("ts_ms", F.coalesce(F.nullif(F.col("ts_ms"), F.lit(0)), now).cast("long"))
    )


def sliding_features(df: DataFrame, method: str = "hours", cell_ms: int = TEN_MINUTES_MS) -> DataFrame:
    """Adds the online features as they stood right after each event of the user, the event included.

    ``tx_count_10m`` counts over (t - 10 min, t]; sum, maximum and distinct mcc go over (t - 1 h, t]. Events count
    one at a time in order of (ts_ms, tx_id). Input has one row per tx_id. Rows without user pass with null features.

    Neither method puts a whole user into one task, and both are linear in the events of a window. ``hours``: running
    frames over (user, hour), one shuffle. ``cells``: as ``hours``, in cells of ``cell_ms``, in more shuffles; for
    users with more events in an hour than a task should sort.
    """
    df = stream_defaults(df)
    keyed = df.filter(F.col("user_id").isNotNull() & (F.col("user_id") != ""))
    featured = {"hours": _by_hour, "cells": lambda d: _by_small_cells(d, cell_ms)}[method](keyed)
    nothing = [F.lit(None).cast(featured.schema[c].dataType).alias(c) for c in ONLINE_FEATURES]
    # a plain condition, which the scan can check against the statistics of the files
    keyless = df.filter(F.col("user_id").isNull() | (F.col("user_id") == ""))
    return featured.unionByName(keyless.select("*", *nothing))


def _by_small_cells(keyed: DataFrame, cell_ms: int) -> DataFrame:
    sums = {"tx_count_10m": (TEN_MINUTES_MS, F.lit(1)), "amt_sum_1h": (HOUR_MS, F.col("amount_minor"))}
    # each step reads its input twice (cells and rows), so the steps are cut apart
    out = cut_lineage(trailing(keyed, "user_id", sums, cell_ms=cell_ms))
    out = cut_lineage(trailing_max(out, "user_id", "amount_minor", HOUR_MS, "max_amt_1h", cell_ms=cell_ms))
    out = cut_lineage(trailing_distinct(out, "user_id", "mcc", HOUR_MS, "distinct_mcc_1h", cell_ms=cell_ms))
    out = previous_row(out, ["user_id"], "ts_ms", "tx_id", ["ts_ms"], cell_ms)
    gap = F.coalesce(seconds_2(F.col("ts_ms") - F.col("prev_ts_ms")), F.lit(-1.0))
    return out.select(
        *keyed.columns,
        "tx_count_10m",
        "amt_sum_1h",
        F.greatest("max_amt_1h", F.lit(0)).alias("max_amt_1h"),
        "distinct_mcc_1h",
        gap.alias("seconds_since_last_tx"),
        F.col("ts_ms").alias("last_updated_ms"),
    )


def _by_hour(keyed: DataFrame) -> DataFrame:
    """An event is sent to its own hour, to the next hour (as an "old" row that drops out one hour after it happened)
    and to the hour in which it leaves the ten-minute window. One shuffle on (user, hour) brings these together; all
    features are then running frames over three sort orders, so cost does not grow with the events in the window.
    """
    own, old, left = F.lit(2), F.lit(1), F.lit(0)
    t = F.col("ts_ms")
    sightings = F.array(
        F.struct(own.alias("role"), t.alias("at")),
        F.struct(old.alias("role"), (t + HOUR_MS).alias("at")),
        F.struct(left.alias("role"), (t + TEN_MINUTES_MS).alias("at")),
    )
    is_own, is_old, is_left = F.col("role") == 2, F.col("role") == 1, F.col("role") == 0
    rows = (
        keyed.select(
            F.col("user_id").alias("_user"),
            F.col("mcc").alias("_mcc"),
            F.col("amount_minor").alias("_amount"),
            F.struct(*keyed.columns).alias("_row"),
            F.explode(sightings).alias("s"),
        )
        .select(
            "_user", "_mcc", "_amount", "s.role", "s.at", F.when(F.col("s.role") == 2, F.col("_row")).alias("_row")
        )
        .withColumn("_cell", cell_of(F.col("at"), HOUR_MS))
    )

    forward = [F.col("at"), F.col("role"), F.col("_row.tx_id")]
    cell = Window.partitionBy("_user", "_cell")
    upto = cell.orderBy(*forward).rowsBetween(Window.unboundedPreceding, 0)
    earlier = cell.orderBy(*forward).rowsBetween(Window.unboundedPreceding, -1)
    # from the end of the hour back to the event: the old rows met so far are those still inside the last hour
    back = cell.orderBy(F.desc("at"), F.desc("role"), F.desc("_row.tx_id")).rowsBetween(Window.unboundedPreceding, 0)
    same_mcc = Window.partitionBy("_user", "_cell", "_mcc").orderBy(*forward)
    mcc_upto = same_mcc.rowsBetween(Window.unboundedPreceding, 0)
    mcc_whole = Window.partitionBy("_user", "_cell", "_mcc")

    def n(condition: Column) -> Column:
        return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")

    rows = rows.withColumn("_old_max", F.max(F.when(is_old, F.col("_amount"))).over(back))
    rows = rows.select(
        "*",
        F.sum(n(is_own)).over(mcc_upto).alias("_mcc_own"),
        # what is left of the whole; a frame that ends at the last row would be summed anew for every row
        (F.sum(n(is_old)).over(mcc_whole) - F.sum(n(is_old)).over(mcc_upto)).alias("_mcc_old_later"),
    )
    first_own = is_own & (F.col("_mcc_own") == 1)
    last_old = is_old & (F.col("_mcc_old_later") == 0)
    # an mcc known from the hour before stops counting as old when its last old row drops out or it is seen again
    handed_over = (last_old & (F.col("_mcc_own") == 0)) | (first_own & (F.col("_mcc_old_later") > 0))
    entered_before = is_left & (F.col("at") - TEN_MINUTES_MS < F.col("_cell") * HOUR_MS)
    rows = rows.select(
        "*",
        F.sum(n(is_own) - n(is_left)).over(upto).alias("_count"),
        F.sum(F.when(is_own, F.col("_amount")).when(is_old, -F.col("_amount")).otherwise(F.lit(0))).over(upto).alias("_sum"),
        F.max(F.when(is_own, F.col("_amount"))).over(upto).alias("_own_max"),
        F.sum(n(first_own) - n(handed_over)).over(upto).alias("_distinct"),
        F.max(F.when(is_own, F.col("at")).when(is_old, F.col("at") - HOUR_MS)).over(earlier).alias("_seen"),
        F.sum(n(entered_before)).over(cell).alias("_count_in"),
        F.sum(F.when(is_old, F.col("_amount")).otherwise(F.lit(0))).over(cell).alias("_sum_in"),
        F.sum(n(last_old)).over(cell).alias("_distinct_in"),
        F.max(F.when(is_old, F.col("at") - HOUR_MS)).over(cell).alias("_seen_in"),
    ).filter(is_own)

    # the previous event may be hours away: last time per (user, hour), handed to the user's next busy hour
    hours = keyed.groupBy(F.col("user_id").alias("_user"), cell_of(t, HOUR_MS).alias("_cell")).agg(
        F.max("ts_ms").alias("_last")
    )
    hours = hours.select(
        "_user", "_cell", F.lag("_last").over(Window.partitionBy("_user").orderBy("_cell")).alias("_seen_before")
    )
    # an old row that has already dropped out still is a previous event, so the carried time completes it
    previous = F.greatest("_seen", "_seen_in", "_seen_before")
    return rows.join(hours, ["_user", "_cell"]).select(
        "_row.*",
        (F.col("_count") + F.col("_count_in")).alias("tx_count_10m"),
        (F.col("_sum") + F.col("_sum_in")).alias("amt_sum_1h"),
        F.greatest("_own_max", "_old_max", F.lit(0)).alias("max_amt_1h"),
        (F.col("_distinct") + F.col("_distinct_in")).alias("distinct_mcc_1h"),
        F.coalesce(seconds_2(F.col("at") - previous), F.lit(-1.0)).alias("seconds_since_last_tx"),
        F.col("at").alias("last_updated_ms"),
    )


def velocity(df: DataFrame, minutes: tuple[int, ...] = (5, 10, 60, 1440), cell_ms: int = HOUR_MS) -> DataFrame:
    """Count and amount over several horizons, all from one shuffle of arrivals and departures."""
    sums = {}
    for m in minutes:
        sums[f"tx_count_{m}m"] = (m * MINUTE_MS, F.lit(1))
        sums[f"amt_sum_{m}m"] = (m * MINUTE_MS, F.col("amount_minor"))
    return trailing(df, "user_id", sums, cell_ms=cell_ms)


def velocity_bin(count: Column, cuts: tuple[int, ...], names: tuple[str, ...]) -> Column:
    """Name of the bucket a count falls into; ``cuts`` are the lower bounds of the second bucket onwards."""
    out = F.lit(names[0])
    for cut, name in zip(cuts, names[1:]):
        out = F.when(count >= cut, F.lit(name)).otherwise(out)
    return F.when(count.isNotNull(), out)


def distinct_countries_24h(df: DataFrame) -> DataFrame:
    return trailing_distinct(df, "user_id", "country", DAY_MS, "distinct_country_24h")


def distinct_users_24h(df: DataFrame) -> DataFrame:
    return trailing_distinct(df, "device_fp", "user_id", DAY_MS, "distinct_users_24h", cell_ms=10 * MINUTE_MS)


def reject_ratio_24h(df: DataFrame, rejected: Column) -> DataFrame:
    """Share of rejected transactions of the card BIN over the last 24 h, the current one included."""
    out = trailing(
        df,
        "card_bin",
        {"_n": (DAY_MS, F.lit(1)), "_bad": (DAY_MS, rejected.cast("long"))},
        cell_ms=10 * MINUTE_MS,
    )
    return out.withColumn("reject_ratio_24h", F.col("_bad") / F.col("_n")).drop("_n", "_bad")


def past_rate(df: DataFrame, key: str, name: str, days: int = 30) -> DataFrame:
    """Share of label 1 among the key's earlier transactions of the last ``days``, the current one left out.

    Null when there is no earlier one. The current row must stay out, or its own label leaks into the feature.
    """
    horizon = days * DAY_MS
    out = trailing(
        df,
        key,
        {"_n": (horizon, F.lit(1)), "_bad": (horizon, F.coalesce(F.col("label") == 1, F.lit(False)).cast("long"))},
        include_current=False,
    )
    return out.withColumn(name, F.try_divide(F.col("_bad"), F.col("_n"))).drop("_n", "_bad")


def travel(df: DataFrame) -> DataFrame:
    """Distance and speed since the user's previous transaction."""
    hours = (F.col("ts_ms") - F.col("prev_ts_ms")) / F.lit(float(HOUR_MS))
    out = previous_row(df, ["user_id"], "ts_ms", "tx_id", ["lat", "lon", "ts_ms"])
    out = out.withColumn(
        "distance_from_last_km", haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    )
    # no time between the two: any distance at all is infinitely fast
    speed = F.when(hours > 0, F.col("distance_from_last_km") / hours).when(
        F.col("distance_from_last_km") > 0, F.lit(float("inf"))
    )
    return out.withColumn("speed_kmh", speed).drop("prev_lat", "prev_lon", "prev_ts_ms")


def device_history(df: DataFrame) -> DataFrame:
    """Whether the user has used the device before, and for how many days.

    The first use per (user, device) is a grouped minimum (combined before the shuffle) joined back, rather than a
    window, because one pair may hold a large part of the table.
    """
    first = df.groupBy("user_id", "device_fp").agg(F.min(F.struct("ts_ms", "tx_id")).alias("_first"))
    pair = ["user_id", "device_fp"]
    known = df.filter(F.col("user_id").isNotNull() & F.col("device_fp").isNotNull()).join(first, pair)
    seen = known.select(
        *df.columns,
        (F.struct("ts_ms", "tx_id") > F.col("_first")).alias("device_fp_seen_before"),
        ((F.col("ts_ms") - F.col("_first.ts_ms")) / F.lit(float(DAY_MS))).alias("device_age_days"),
    )
    unknown = df.filter(F.col("user_id").isNull() | F.col("device_fp").isNull())
    return seen.unionByName(unknown, allowMissingColumns=True)


def behaviour_30d(df: DataFrame, days: int = 30) -> DataFrame:
    """Average amount and weekend share over the true trailing window, the current transaction included."""
    horizon = days * DAY_MS
    weekend = F.weekday(F.timestamp_millis("ts_ms")) >= 5
    out = trailing(
        df,
        "user_id",
        {
            "_n": (horizon, F.lit(1)),
            "_amount": (horizon, F.col("amount_minor")),
            "_weekend": (horizon, weekend.cast("long")),
        },
        cell_ms=DAY_MS,
    )
    return (
        out.withColumn("avg_amount_30d", F.col("_amount") / F.col("_n"))
        .withColumn("pct_weekend_30d", F.col("_weekend") / F.col("_n"))
        .drop("_n", "_amount", "_weekend")
    )


def weekday_hour_histogram(df: DataFrame) -> DataFrame:
    """Transactions per user, weekday (0 = Monday) and hour: at most 168 rows for a user."""
    ts = F.timestamp_millis("ts_ms")
    return df.groupBy("user_id", F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour")).agg(
        F.count(F.lit(1)).alias("tx_count")
    )


def weekday_hour_map(df: DataFrame) -> DataFrame:
    """The histogram as one map per user, keyed ``weekday-hour``; bounded by 168 entries."""
    slot = F.concat_ws("-", F.col("weekday").cast("string"), F.col("hour").cast("string"))
    return (
        weekday_hour_histogram(df)
        .groupBy("user_id")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(slot, "tx_count")))).alias("weekday_hour"))
    )


def prior_outcomes(df: DataFrame, outcomes: dict[str, Column], cell_ms: int = DAY_MS) -> DataFrame:
    """Number of earlier transactions of the user with each outcome (chargebacks, challenges), the current one left out.

    Rows without user or time get nulls."""
    placed, others = placed_rows(df, ["user_id"], "ts_ms")
    cut = placed.withColumn("_cell", cell_of(F.col("ts_ms"), cell_ms))
    flags = {name: F.coalesce(c, F.lit(False)).cast("long") for name, c in outcomes.items()}
    out = running_totals(cut, ["user_id"], "_cell", [F.col("ts_ms"), F.col("tx_id")], flags)
    counted = out.select(*df.columns, *[(F.col(name) - flag).alias(name) for name, flag in flags.items()])
    return counted.unionByName(others, allowMissingColumns=True)


def distinct_sketch(df: DataFrame, key: str, value: str) -> DataFrame:
    """HyperLogLog sketch of a value per key; sketches of parts merge without rereading the rows."""
    return df.groupBy(key).agg(F.hll_sketch_agg(F.col(value)).alias("sketch"))


def merge_sketches(sketches: DataFrame, key: str) -> DataFrame:
    return sketches.groupBy(key).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"))
