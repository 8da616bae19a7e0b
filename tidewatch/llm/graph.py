"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.session import new_folder


#: Whether a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the cluster's shared folder and read back: cut lineage that survives lost executors.

    Nothing reads the shuffles of the plan again, so their files go at once.
    """
    spark = df.sparkSession
    path, before = new_folder(spark, name), spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def apart(table: DataFrame, key: str) -> DataFrame:
    """The grouped table with its key as the struct ``key``: joined on that, both sides are dealt out for the join, and
    the adaptive skew join may split a key with very many rows. A join on the grouping key itself would keep the
    grouping's partitions, in which such a key is one task's."""
    return table.withColumn("key", F.struct(F.col(key).alias("k"))).drop(key)


def _larger_neighbours(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on the smallest of itself and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.where("v > u").join(apart(least, "u"), F.struct(F.col("u").alias("k")) == F.col("key"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _smaller_neighbours(edges: DataFrame) -> DataFrame:
    """Each node hangs its smaller neighbours and itself on the smallest of them. ``u`` is larger than ``v``."""
    least = edges.select("*", F.min("v").over(Window.partitionBy("u")).alias("m"))
    moved = least.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether the links are stars: every node hangs on one other, and nothing hangs on it."""
    ends = [F.struct(F.col(end).alias("node"), F.lit(hangs).alias("hangs")) for end, hangs in (("u", 1), ("v", 0))]
    by_node = (
        edges.select(F.explode(F.array(*ends)).alias("end"))
        .groupBy("end.node")
        .agg(F.sum("end.hangs").alias("hangs"), F.min("end.hangs").alias("least"))
    )
    return by_node.where("hangs > 1 OR (hangs = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with a link; ``root`` is the smallest node of its component.

    ``edges`` has two columns of one orderable type. Links never leave the executors. A node with very many larger
    neighbours (the middle of a star) is combined before the shuffle and split by the adaptive skew join. Rounds grow
    with the logarithm of the longest chain; stars need none. Rows with a null end and loops are no links.
    """
    a, b = edges.columns
    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "links",
    )
    while not _is_done(now):
        now = stored(_smaller_neighbours(_larger_neighbours(now)), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
