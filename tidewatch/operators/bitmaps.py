"""Exact distinct counts that roll up and exact set sizes: bitmaps over numbered values, OR-ed from hours to days to months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.cells import running_totals


def numbered(df: DataFrame, column: str) -> DataFrame:
    """(value, id): the distinct non-null values of a column with the numbers 1 to n, in order of a hash.

    The order is cut into 65,536 cells of the hash, so no task sorts all values.
    """
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    placed = values.withColumn("_hash", F.xxhash64("value")).withColumn("_cell", F.shiftright("_hash", 48))
    return running_totals(placed, [], "_cell", [F.col("_hash"), F.col("value")], {"id": F.lit(1)}).select("value", F.col("id").cast("long").alias("id"))


def bitmaps(df: DataFrame, keys: dict[str, Column], column: str, ids: DataFrame) -> DataFrame:
    """Per value of ``keys`` and block of 32,768 numbers (``block``) the ``bitmap`` of the values of ``column`` seen.

    ``ids`` is ``numbered`` of this column, or of a larger table; values that it lacks, and nulls, are left out. A
    bitmap has 4 KB however few of its bits are set: keys should be coarse, such as hours, countries or merchants.
    """
    seen = df.select(*[c.alias(name) for name, c in keys.items()], F.col(column).alias("value")).distinct()
    numbers = seen.join(ids, "value")
    block, bit = F.bitmap_bucket_number("id").alias("block"), F.bitmap_bit_position("id")
    return numbers.groupBy(*keys, block).agg(F.bitmap_construct_agg(bit).alias("bitmap"))


def part_bitmaps(df: DataFrame, keys: dict[str, Column], column: str, ids: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """As ``bitmaps``, with one bitmap for each of ``parts`` (name -> condition): the values of rows that fulfil it."""
    held = [F.bool_or(condition).alias(name) for name, condition in parts.items()]
    seen = df.groupBy(*[c.alias(name) for name, c in keys.items()], F.col(column).alias("value")).agg(*held)
    block, bit = F.bitmap_bucket_number("id").alias("block"), F.bitmap_bit_position("id")
    made = [F.bitmap_construct_agg(F.when(F.col(name), bit)).alias(name) for name in parts]
    return seen.join(ids, "value").groupBy(*keys, block).agg(*made)


def audience(maps: DataFrame, keys: list[str], a: str, b: str, either: str) -> DataFrame:
    """Per key the sizes of ``either`` (the values of ``a`` or ``b``) as ``either``, of both as ``shared`` and of what only
    one of them has as ``only_a`` and ``only_b``, from bitmaps alone."""
    sizes = maps.groupBy(*keys).agg(*[F.sum(F.bitmap_count(c)).alias(n) for n, c in (("a", a), ("b", b), ("either", either))])
    shared = (F.col("a") + F.col("b") - F.col("either")).alias("shared")
    return sizes.select(*keys, "either", shared, (F.col("either") - F.col("b")).alias("only_a"), (F.col("either") - F.col("a")).alias("only_b"))


def rolled_up(maps: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Bitmaps of coarser keys, made of finer bitmaps without a look at the rows."""
    return maps.groupBy(*[c.alias(name) for name, c in keys.items()], "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def distinct_counts(maps: DataFrame, keys: list[str], name: str = "n_distinct") -> DataFrame:
    return maps.groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).alias(name))
