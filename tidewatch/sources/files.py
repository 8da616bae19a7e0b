"""File sources and sinks: raw CSV, the canonical lake, feature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewatch.operators.cells import DAY_MS
from tidewatch.schema import RAW


def read_raw(
    spark: SparkSession, dataset: str, path: str, first_only: bool = False, row_index: bool = False
) -> DataFrame:
    """Header CSV of a raw dataset with its declared types; other columns of the file come along as text.

    A text that is not of its column's type becomes null. A folder is read whole; ``first_only`` keeps the file whose path sorts first. ``row_index`` numbers the rows in
    file order, from 0.
    """
    # the header is read to match columns by name; the rows are not scanned for types
    reader = spark.read.option("header", True).option("pathGlobFilter", "*.csv")
    header = reader.csv(path)
    if first_only:
        header = reader.csv(min(header.inputFiles()))
    declared = {f.name: f.dataType for f in RAW[dataset].fields}
    missing = [c for c in declared if c not in header.columns]
    if missing:
        raise ValueError(f"{dataset}: missing columns {missing}")
    out = with_row_index(header) if row_index else header
    typed = [F.col(c).try_cast(declared[c]).alias(c) if c in declared else F.col(c) for c in out.columns]
    return out.select(*typed)


def with_row_index(scan: DataFrame, name: str = "row_index") -> DataFrame:
    """Contiguous row numbers in file order, for a frame that comes straight from a file scan.

    Rows are numbered inside each file block as the scan meets them; the sizes of the blocks, one row each, give
    the offsets. No row moves but for the join with the block table.
    """
    tagged = scan.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    blocks = tagged.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return tagged.join(blocks, ["_path", "_block"]).select(
        *scan.columns, (F.col("_offset") + F.col("_id") - F.col("_first")).alias(name)
    )


def first_rows(df: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """The first n rows, by ``order`` (Spark promises no file order of its own)."""
    return (df.orderBy(*order) if order else df).limit(n)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """One lake out of several sources; a column that a source lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_lake_partitions(df: DataFrame, country: bool = False) -> DataFrame:
    out = df.withColumn("date", F.to_date(F.timestamp_millis("ts_ms"))).withColumn("source", F.col("dataset_source"))
    return out.withColumn("country_part", F.coalesce("country", F.lit("none"))) if country else out


def gathered(df: DataFrame, *by: str) -> DataFrame:
    """Rows of one partition value together, so files stay few. Sizes decide at run time: a value with very many rows
    is split over tasks, and small ones share a task."""
    return df.hint("rebalance", *by)


def write_lake(df: DataFrame, path: str, by: tuple[str, ...] = ("date", "source")) -> None:
    """Partitioned Parquet, whatever the share of a single day or source."""
    out = with_lake_partitions(df, country="country_part" in by)
    gathered(out, *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_lake(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", merge_schema).parquet(path)


def retained(df: DataFrame, as_of_ms: int, days: int) -> DataFrame:
    """Rows that retention keeps: a filter on the partition column alone, so dropped days are not read."""
    oldest = F.to_date(F.timestamp_millis(F.lit(as_of_ms - days * DAY_MS)))
    return df.filter(F.col("date") >= oldest)


def publish_offline(features: DataFrame, path: str | None = None, drop_label_rate: bool = False) -> DataFrame:
    """The feature columns that go to the online store, one row per user.

    The label itself never goes; the user's fraud rate also derives from the label and can be left out too.
    """
    out = features.drop("has_fraud_label", *(["fraud_rate_user"] if drop_label_rate else []))
    if path:
        write_table(out, path)
    return out


def as_store_text(features: DataFrame) -> DataFrame:
    """Features as a key-value store would hold them: one map of strings per user, nulls as 0."""
    cells: list[Column] = []
    for c in features.columns:
        if c != "user_id":
            cells += [F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("0"))]
    return features.select("user_id", F.create_map(*cells).alias("features"))


def schema_changes(spark: SparkSession, old: T.StructType, new: T.StructType) -> DataFrame:
    """What changed between two schemas and whether readers survive it (additions do; the rest is a major change)."""
    before = {f.name: f for f in old.fields}
    after = {f.name: f for f in new.fields}
    rows = []
    for name in [*before, *[n for n in after if n not in before]]:
        a, b = before.get(name), after.get(name)
        if a is None:
            rows.append((name, "added", None, b.dataType.simpleString(), b.nullable))
        elif b is None:
            rows.append((name, "removed", a.dataType.simpleString(), None, False))
        elif a.dataType != b.dataType:
            rows.append((name, "retyped", a.dataType.simpleString(), b.dataType.simpleString(), False))
    return spark.createDataFrame(rows, "column string, change string, old_type string, new_type string, compatible boolean")
