"""What the trees of the model queries are fitted on, and in how many pieces."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch import plans
from tidewatch.operators import model as ops, rules
from tidewatch.plans import learning
from tidewatch.schema import MODEL_FEATURES

DATA = "/root/testdata/sf0.001"


class Booster:
    """Stands for GBTClassifier: keeps what it is told to fit."""

    seen = None

    def __init__(self, **how):
        pass


class Stages:
    def __init__(self, stages):
        pass

    def fit(self, df):
        Booster.seen = df
        return "model"


@pytest.fixture()
def unfitted(monkeypatch):
    monkeypatch.setattr(ops, "GBTClassifier", Booster)
    monkeypatch.setattr(ops, "Pipeline", Stages)


def test_rows_are_fitted_in_as_many_pieces_as_they_need(spark, unfitted):
    rows = spark.range(0, 3_000, 1, 60).select(*[F.col("id").cast("double").alias(c) for c in MODEL_FEATURES], (F.col("id") % 2).cast("int").alias("target"))
    assert ops.train_boosted_trees(rows) == "model"
    assert Booster.seen.rdd.getNumPartitions() == 1 and Booster.seen.count() == 3_000


def test_all_rows_of_the_training_fold_are_fitted(spark, unfitted, monkeypatch):
    assert not hasattr(learning, "FITTING_ROWS")
    monkeypatch.setattr(ops, "score_with", lambda model, df: df)
    model, test, split = learning.trained(spark, DATA, {})
    assert Booster.seen.count() == split.where("NOT is_test").count() and test.count() + Booster.seen.count() == split.count()


def test_metrics_of_a_later_target_have_sql():
    plans.load_all()
    assert {"model_metrics_next_year", "model_metrics_quality"} <= set(plans.ORACLES) and "model_metrics" in plans.QUERIES


def test_orders_are_scored_from_the_features_that_were_stored(spark, unfitted, monkeypatch):
    made, given = [], {}
    features, decide = learning.offline_features, rules.score_batch
    monkeypatch.setattr(learning, "offline_features", lambda tx: made.append(1) or features(tx))
    monkeypatch.setattr(ops, "score_with", lambda model, df: df)
    monkeypatch.setattr(learning.rules, "score_batch", lambda tx, model, **how: given.update(how) or decide(tx, score=F.lit(0.5), **how))
    kept, fit = {}, learning.trained
    monkeypatch.setattr(learning, "trained", lambda spark, folder: fit(spark, folder, kept))
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    assert learning.score_with_model(spark, DATA).count() == orders.count()
    assert len(made) == 1 and given["offline"].inputFiles()  # once, and read from where they were written
    assert given["offline"].count() == orders.select("o_custkey").distinct().count()


def test_metrics_are_told_of_both_targets(spark, unfitted, folder, monkeypatch):
    middle = learning.ORDERS_MIDDLE_MS // 1000
    day = 86_400
    orders = []
    for user in range(1, 41):
        orders += [(user, middle - day * user, "O"), (user, middle + day * user, "F" if user % 4 == 0 else "O")]
    orders += [(50, middle + day, "F"), (1, middle + 400 * day, "F")]  # no order before the middle; a label after the year
    rows = [(k, user, at, 100_000.0 + 9_000.0 * user, status, "1-URGENT") for k, (user, at, status) in enumerate(orders)]
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, at long, o_totalprice double, o_orderstatus string, o_orderpriority string")
    df.withColumn("o_orderdate", F.timestamp_seconds("at").cast("timestamp_ntz")).drop("at").write.parquet(f"{folder}/orders.parquet")
    customers = spark.range(1, 51).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit("A").alias("c_mktsegment"))
    customers.write.parquet(f"{folder}/customer.parquet")
    monkeypatch.setattr(ops, "score_with", lambda model, df: df.withColumn("score", F.lit(0.5)))
    got = {r["target"]: r for r in learning.model_metrics(spark, folder).collect()}
    later = got["label of the next year"]
    assert (later["train_size"], later["test_size"], later["fraud_rate"], later["scale_pos_weight"]) == (32, 8, 0.25, 3.0)
    assert got["mean payment"]["train_size"] + got["mean payment"]["test_size"] == 41
    assert all(r["auc"] == 0.5 and r["n_features"] == len(r["feature_columns"]) == len(MODEL_FEATURES) for r in got.values())
