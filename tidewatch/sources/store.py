"""Feature tables that are joined by key without a shuffle: bucketed and sorted by the key when they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bucketed(df: DataFrame, name: str, path: str, key: str = "user_id", buckets: int = 64) -> None:
    """Writes the table ``name`` below ``path``, in ``buckets`` files sorted by ``key``.

    A join on the key reads a bucket where it needs it, so the table is neither shuffled nor sorted again; the other
    side is shuffled into the table's buckets. Take as many buckets as a join should have tasks. Rows are dealt to
    buckets before the write, so there is one file of each.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def with_stored(tx: DataFrame, store: DataFrame, columns: list[str], key: str = "user_id") -> DataFrame:
    """Transactions with columns of their key's row in a bucketed table: a sort-merge join, only ``tx`` is shuffled.

    ``store`` has at most one row per key. A transaction without a key or a row gets nulls.
    """
    kept = store.select(F.col(key).alias("_key"), *columns).hint("merge")
    return tx.join(kept, F.col(key) == F.col("_key"), "left").drop("_key")
