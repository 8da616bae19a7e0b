"""Heavy hitters of a column with very many values: counters of fixed size name the candidates, a recount settles them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of counters and counters in each. A value's estimate is too high by more than 2.72 / WIDTH of all rows in one of
#: e ** DEPTH cases.
DEPTH, WIDTH = 4, 16_384


def _buckets(column: str) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(WIDTH)).cast("int") for seed in range(DEPTH)])


def counters(df: DataFrame, column: str) -> DataFrame:
    """Count-min sketch as a table: ``line, bucket, n``, at most ``DEPTH`` x ``WIDTH`` rows. Tables of parts add up."""
    places = df.where(F.col(column).isNotNull()).select(F.posexplode(_buckets(column)).alias("line", "bucket"))
    return places.groupBy("line", "bucket").agg(F.count(F.lit(1)).alias("n"))


def heavy_hitters(df: DataFrame, column: str, share: float = 0.001) -> DataFrame:
    """``value, n, estimate``: every value that at least ``share`` of the non-null rows have, with its exact count and the
    sketch's estimate, which is never below it.

    Rows are combined to at most ``DEPTH`` x ``WIDTH`` counters before the shuffle. A heavy value's counters are all heavy,
    and at most ``DEPTH / share`` counters are; they go to the driver and back as a filter. Only the few values that
    pass are counted by value, so the number of distinct values does not matter. Nulls are no value; an empty table
    gives an empty one.
    """
    sketch = counters(df, column)
    total = df.agg(F.count(column)).first()[0]  # one number
    bound = max(1, share * total)
    heavy = sketch.where(F.col("n") >= bound).collect()  # at most DEPTH / share rows
    buckets, passes = _buckets(column), F.col(column).isNotNull()
    for line in range(DEPTH):
        passes = passes & buckets[line].isin([r["bucket"] for r in heavy if r["line"] == line])
    counted = df.where(passes).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= bound)
    own = df.sparkSession.createDataFrame(heavy, sketch.schema).withColumnRenamed("n", "estimate")
    places = counted.select("value", "n", F.posexplode(_buckets("value")).alias("line", "bucket"))
    return places.join(F.broadcast(own), ["line", "bucket"]).groupBy("value", "n").agg(F.min("estimate").alias("estimate"))
