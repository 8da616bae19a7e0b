"""Stream transformations and sinks: de-duplication, windows, keyed upserts, decision log, newest rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewatch.operators.history import event_time, latest_per_key, merged_versions, per_second, recent, window_totals
from tidewatch.sources.files import gathered


def deduplicated(events: DataFrame, keys: list[str], lateness: str = "5 seconds") -> DataFrame:
    """Drops repeats of a key; state is kept as long as a repeat may still arrive."""
    return event_time(events).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def stream_windows(events: DataFrame, size: str, slide: str | None = None, lateness: str = "5 seconds") -> DataFrame:
    """Totals per event-time window; a window is given out once the watermark has passed its end."""
    return window_totals(event_time(events).withWatermark("ts", lateness), size, slide)


def stream_seconds(decisions: DataFrame, lateness: str = "5 seconds") -> DataFrame:
    """Traffic, latency and non-approved decisions per second; ``history.running_kpis`` makes live figures of them."""
    windows = per_second(event_time(decisions).withWatermark("ts", lateness), F.window("ts", "1 second"))
    return windows.withColumn("second", F.unix_seconds("second.start"))


def enriched(events: DataFrame, profile: DataFrame) -> DataFrame:
    """Stream-static left join with one profile row per user."""
    return events.join(profile, "user_id", "left")


def snapshot(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    """A version of a keyed table; None before the first. Any other version that can't be read is an error."""
    return spark.read.parquet(f"{path}/v={version}") if version >= 0 else None


def upsert_latest(path: str, key: str = "user_id", order: tuple[str, ...] = ("ts_ms", "tx_id"), buckets: int = 64, keep: int = 3):
    """A ``foreachBatch`` sink that keeps the newest row per key in Parquet, split into hash buckets.

    Batch n writes ``v=n/bucket=b`` for the buckets it touches only: the newest rows of (that bucket before, batch).
    Where a bucket stands is read from the folder names. A batch that is run again writes the same files again, so
    the sink is idempotent; untouched buckets cost nothing. Of each bucket the newest ``keep`` versions stay (two at
    least: a batch that is run again needs the one before), so folders don't pile up; a reader has that many batches
    of time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter(F.col(key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
        rows = latest_per_key(rows, key, order).persist()
        try:
            touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most ``buckets``
            before = _newest_buckets(spark, path, batch_id, touched)
            merged = rows
            if before is not None:
                merged = latest_per_key(rows.unionByName(before.select(*rows.columns)), key, order)
            target = f"{path}/v={batch_id:010d}"
            gathered(merged, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
            drop_old_versions(spark, path, keep)
        finally:
            rows.unpersist()

    return write


def merge_profile(
    path: str, key: str, tracked: list[str], ts: str = "ts_ms", tie: str = "tx_id", buckets: int = 64, day_ms: int = 86_400_000, keep: int = 3
):
    """A ``foreachBatch`` sink (or a function of any batch and its number) that keeps a slowly changing profile.

    ``path/log/bucket=b/day=d`` holds what was observed, ``path/history/v=n/bucket=b`` the versions that follow from it.
    Batch n adds its rows to the log and writes anew the buckets it touches, from their versions before it and the
    observations since the earliest new row of each key; of the log, only days from the bucket's earliest new row on are
    read. Rows may come in any order and batches in any cut: the result is that of ``history.profile_versions`` over
    all rows. A row observed twice changes nothing, so a batch may be run again. Rows without a key or a time are left
    out. ``keep`` is as in ``upsert_latest``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, ts, tie, *tracked)
        placed = {"bucket": F.pmod(F.xxhash64(key), F.lit(buckets)), "day": F.floor(F.col(ts) / day_ms)}
        rows = rows.withColumns(placed).persist()
        try:
            spans = rows.groupBy("bucket").agg(F.min("day").alias("day")).collect()  # at most ``buckets`` rows
            if not spans:
                return
            gathered(rows, "bucket", "day").write.mode("append").partitionBy("bucket", "day").parquet(f"{path}/log")
            folders = [f"{path}/log/bucket={r['bucket']}" for r in spans]
            log = spark.read.option("basePath", f"{path}/log").schema(rows.schema).parquet(*folders)
            log = log.where(reduce(lambda a, b: a | b, [(F.col("bucket") == r["bucket"]) & (F.col("day") >= r["day"]) for r in spans]))
            first = rows.groupBy(key).agg(F.min(F.struct(ts, tie)).alias("_from"))
            before = _newest_buckets(spark, f"{path}/history", batch_id, [r["bucket"] for r in spans])
            before = None if before is None else before.drop("bucket")
            merged = merged_versions(before, log, first, key, tracked, ts, tie)
            merged = merged.withColumn("bucket", placed["bucket"])
            target = f"{path}/history/v={batch_id:010d}"
            gathered(merged, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
            drop_old_versions(spark, f"{path}/history", keep)
        finally:
            rows.unpersist()

    return write


def read_profile(spark: SparkSession, path: str) -> DataFrame | None:
    """The history that ``merge_profile`` keeps, as ``history.profile_versions`` gives it; None before the first batch."""
    out = _newest_buckets(spark, f"{path}/history")
    return None if out is None else out.drop("bucket", "valid_tie").withColumn("is_current", F.col("valid_to").isNull())


def drop_old_versions(spark: SparkSession, path: str, keep: int) -> None:
    """Deletes all but the newest ``keep`` versions of each bucket."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for versions in _bucket_folders(spark, path).values():
        for version in sorted(versions)[: -max(2, keep)]:
            folder = jvm.org.apache.hadoop.fs.Path(versions[version])
            folder.getFileSystem(conf).delete(folder, True)


def _bucket_folders(spark: SparkSession, path: str) -> dict[int, dict[int, str]]:
    """bucket -> version -> folder, from the file system the path lies on."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/bucket=*")
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(root) or []
    out: dict[int, dict[int, str]] = {}
    for status in found:
        folder = status.getPath()
        version, bucket = int(folder.getParent().getName()[2:]), int(folder.getName()[7:])
        out.setdefault(bucket, {})[version] = folder.toString()
    return out


def _newest_buckets(
    spark: SparkSession, path: str, before_version: int | None = None, only: list[int] | None = None
) -> DataFrame | None:
    folders = []
    for bucket, versions in _bucket_folders(spark, path).items():
        usable = [v for v in versions if before_version is None or v < before_version]
        if usable and (only is None or bucket in only):
            folders.append(versions[max(usable)])
    if not folders:
        return None
    return spark.read.option("basePath", path).parquet(*folders).drop("v")


# Fixed value: how long the online store keeps a user's features after the last event.
ONLINE_TTL_MS = 24 * 3_600_000


def read_latest(
    spark: SparkSession, path: str, now_ms: int | None = None, ttl_ms: int = ONLINE_TTL_MS
) -> DataFrame | None:
    """The keyed table as the sink left it: the newest version of every bucket.

    With ``now_ms``, only keys whose newest row (``ts_ms``) is less than ``ttl_ms`` old: the others have expired.
    """
    out = _newest_buckets(spark, path)
    if out is None:
        return None
    alive = out if now_ms is None else out.filter(F.col("ts_ms") > now_ms - ttl_ms)
    return alive.drop("bucket")


def keep_recent(path: str, n: int):
    """A ``foreachBatch`` sink that keeps the newest n rows: version = newest n of (version before, batch)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = snapshot(spark, path, batch_id - 1)
        rows = recent(batch, n) if before is None else recent(recent(batch, n).unionByName(before), n)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return write


def decision_log(decisions: DataFrame, ruleset_version: str, model_version: str, policy_id: str | None = None) -> DataFrame:
    """Decision events with versions, and the date and hour they are partitioned by."""
    ts = F.timestamp_millis("ts_ms")
    return (
        decisions.withColumn("ruleset_version", F.lit(ruleset_version))
        .withColumn("model_version", F.lit(model_version))
        .withColumn("policy_id", F.lit(policy_id).cast("string"))
        .withColumn("date", F.to_date(ts))
        .withColumn("hour", F.hour(ts))
    )


def write_stream(
    df: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = (), available_now: bool = True
) -> StreamingQuery:
    """Parquet sink; file commits and offsets go through the checkpoint."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if by:
        writer = writer.partitionBy(*by)
    return (writer.trigger(availableNow=True) if available_now else writer).outputMode("append").start()


def write_batches(df: DataFrame, sink, checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def observed(df: DataFrame, name: str = "progress") -> DataFrame:
    """Counts rows on the way through; read the figures with ``ProgressListener``."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.max("ts_ms").alias("max_ts_ms"))


class ProgressListener(StreamingQueryListener):
    """Collects the observed figures of each batch, newest last, up to ``keep`` of them."""

    def __init__(self, name: str = "progress", keep: int = 100):
        self.name, self.keep, self.samples = name, keep, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = (event.progress.observedMetrics or {}).get(self.name)
        if row is not None:
            self.samples = [*self.samples, row.asDict()][-self.keep :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def union_streams(*streams: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)
