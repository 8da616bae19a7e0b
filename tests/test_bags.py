"""Attributes as texts, made one by one or in one loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators.canonical import attribute_bag


def test_a_loop_makes_the_same_bag(spark):
    df = spark.createDataFrame([(1.5, None, 1e9, -0.0), (1e-7, 12345678.9, None, 3.0)], "a double, b double, c double, d double")
    columns = {c: F.col(c) for c in df.columns}
    rows = df.select(attribute_bag(columns).alias("one_by_one"), attribute_bag(columns, "double").alias("looped")).collect()
    assert all(r["one_by_one"] == r["looped"] and list(r["looped"]) == ["a", "b", "c", "d"] for r in rows)
