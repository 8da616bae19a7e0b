"""Detectors of known attack patterns. Each adds a flag or returns the offending keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.cells import HOUR_MS, previous_row, trailing
from tidewatch.operators.features import travel

MINUTE_MS = 60_000


def velocity_attack(df: DataFrame, key: str = "user_id", count: int = 30, window_ms: int = MINUTE_MS) -> DataFrame:
    """Flags a transaction that is at least the ``count``-th of its key within the window."""
    out = trailing(df, key, {"_n": (window_ms, F.lit(1))}, cell_ms=HOUR_MS)
    return out.withColumn("velocity_attack", F.coalesce(F.col("_n") >= count, F.lit(False))).drop("_n")


def impossible_travel(df: DataFrame, max_kmh: float = 900.0, min_km: float = 100.0) -> DataFrame:
    """Flags a transaction that no traveller could have reached from the one before."""
    fast = (F.col("speed_kmh") > max_kmh) & (F.col("distance_from_last_km") >= min_km)
    return travel(df).withColumn("impossible_travel", F.coalesce(fast, F.lit(False)))


def device_spray(df: DataFrame, users: int = 50) -> DataFrame:
    """Devices used by at least ``users`` different users. Pairs are made distinct before they are counted."""
    return (
        df.filter(F.col("device_fp").isNotNull())
        .groupBy("device_fp")
        .agg(F.countDistinct("user_id").alias("users"))
        .filter(F.col("users") >= users)
    )


def fat_finger(df: DataFrame, factor: float = 10.0) -> DataFrame:
    """Flags an amount of at least ``factor`` times the user's previous one."""
    out = previous_row(df, ["user_id"], "ts_ms", "tx_id", ["amount_minor"])
    large = (F.col("prev_amount_minor") > 0) & (F.col("amount_minor") >= factor * F.col("prev_amount_minor"))
    return out.withColumn("fat_finger", F.coalesce(large, F.lit(False))).drop("prev_amount_minor")
