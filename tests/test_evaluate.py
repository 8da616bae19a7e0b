import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import evaluate as E
from tidewatch.operators import model as M


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        label = int(rng.random() < 0.2)
        score = min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * label, 0.2)))
        # a third of all rows share one score
        rows.append((f"u{i}", 0.5 if i % 3 == 0 else round(score, 3), rng.choice([label, label, None]) if not label else 1))
    return rows, spark.createDataFrame(rows, "user_id string, score double, label int").cache()


def test_auc_counts_pairs(scored):
    rows, df = scored
    pos = np.array([s for _, s, l in rows if l == 1])
    neg = np.array([s for _, s, l in rows if l != 1])
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    for cells in (2, 256):
        got = E.auc(df, cells=cells).first()
        assert got["auc"] == pytest.approx(want, abs=1e-12) and (got["positives"], got["negatives"]) == (len(pos), len(neg))


def test_recall_stays_within_the_false_positive_rate(scored):
    rows, df = scored
    pos = [s for _, s, l in rows if l == 1]
    neg = [s for _, s, l in rows if l != 1]
    got = {r["max_fpr"]: r["recall"] for r in E.recall_at_fpr(df, [0.0, 0.01, 0.1, 1.0]).collect()}
    for limit, recall in got.items():
        best = 0.0
        for t in set(pos + neg):
            if sum(s >= t for s in neg) / len(neg) <= limit:
                best = max(best, sum(s >= t for s in pos) / len(pos))
        assert recall == pytest.approx(best)
    assert got[1.0] == 1.0


def test_curve_of_a_perfect_and_an_empty_table(spark):
    perfect = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.1, 0)], "score double, label int")
    assert E.auc(perfect).first()["auc"] == 1.0 and E.auc_pr(perfect).first()["auc_pr"] == 1.0
    none = perfect.filter("false")
    assert E.auc(none).first()["auc"] is None and E.quantiles(none, "score", [0.5]).first()["value"] is None


@pytest.mark.parametrize("cells", [2, 16])
def test_quantiles_equal_linear_interpolation(spark, cells):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=701), np.full(350, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    probabilities = [0.0, 0.1, 0.5, 0.9, 0.99, 0.999, 1.0]
    got = {r["q"]: r["value"] for r in E.quantiles(df, "v", probabilities, cells).collect()}
    for p in probabilities:
        assert got[p] == pytest.approx(float(np.quantile(values, p)), abs=1e-12)


def test_drift_is_zero_without_change_and_large_with_it(spark):
    base = spark.range(1000).select((F.col("id") / 1000).alias("x"))
    same = {r["column"]: r for r in E.drift(base, base, {"x": (0.0, 1.0)}).collect()}["x"]
    moved = E.drift(base, base.withColumn("x", F.col("x") * F.col("x")), {"x": (0.0, 1.0)}).first()
    assert same["psi"] == 0.0 and same["kl"] == 0.0 and moved["psi"] > 0.1 and moved["kl"] > 0.1


def test_calibration_of_a_calibrated_score(spark):
    df = spark.range(10_000).select((F.pmod("id", F.lit(10)) / 10 + 0.05).alias("score"), (F.xxhash64("id") % 1000).alias("h"))
    df = df.withColumn("label", (F.pmod("h", F.lit(1000)) < F.col("score") * 1000).cast("int"))
    table = E.calibration(df)
    assert table.count() == 10 and E.expected_calibration_error(table).first()["ece"] < 0.03


def test_stratified_split_is_exact_and_repeatable(scored):
    _, df = scored
    df = M.clean_target(df, "label")
    split = M.stratified_split(df, "target", 0.2)
    for r in split.groupBy("target").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r["t"] == int(r["n"] * 0.2 + 0.5)
    again = M.stratified_split(df.repartition(13), "target", 0.2)
    assert split.filter("is_test").select("user_id").exceptAll(again.filter("is_test").select("user_id")).count() == 0
    other = M.stratified_split(df, "target", 0.2, seed=1)
    assert split.filter("is_test").select("user_id").exceptAll(other.filter("is_test").select("user_id")).count() > 0


def test_group_split_shares_and_leaks(spark):
    df = spark.range(30_000).select((F.col("id") % 10_000).cast("string").alias("user_id"))
    split = M.group_split(df, {"train": 0.7, "valid": 0.15, "test": 0.15})
    shares = {r["split"]: r["n"] / 30_000 for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(shares["train"] - 0.7) < 0.02 and abs(shares["test"] - 0.15) < 0.02 and M.leaked_keys(split).count() == 0


def test_labels_are_cleaned(spark):
    df = spark.createDataFrame([(1,), (0,), (-1,), (None,)], "has_fraud_label int")
    assert [r["target"] for r in M.clean_target(df).collect()] == [1, 0, 0, 0]


def test_encodings_know_only_the_training_fold(spark):
    train = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), (None, 0)], "c string, target int")
    encoding = M.target_encoding(train, "c", smoothing=2.0)
    out = M.encode(spark.createDataFrame([("a",), ("z",), (None,)], "c string"), "c", encoding, "encoded", "e", -1.0)
    assert [r["e"] for r in out.orderBy(F.desc_nulls_last("c")).collect()] == [-1.0, 0.75, pytest.approx(1 / 3)]


def test_training_ranks_above_chance_and_scores_are_probabilities(spark):
    df = spark.range(600).select(
        F.col("id").cast("string").alias("user_id"),
        *[F.shiftrightunsigned(F.xxhash64("id", F.lit(i)), 40).cast("double").alias(c) for i, c in enumerate(M.MODEL_FEATURES)],
    )
    df = df.withColumn("target", (F.col("amt_mean_30d") > 2**23).cast("int"))
    split = M.stratified_split(df, "target")
    model = M.train_boosted_trees(split.filter("NOT is_test"), trees=5, depth=3)
    test = M.score_with(model, split.filter("is_test"))
    record = M.metrics_record(test, split).first()
    assert record["auc"] >= 0.9 and record["test_size"] == test.count() and record["n_features"] == 12
    assert record["train_size"] + record["test_size"] == 600 and abs(record["fraud_rate"] - split.agg(F.avg("target")).first()[0]) < 1e-6
    assert test.filter("score < 0 OR score > 1").count() == 0
    top = M.feature_importance(spark, model).orderBy(F.desc("importance")).first()
    assert top["feature"] == "amt_mean_30d"


def test_nulls_are_in_no_bin_and_are_not_capped(spark):
    from tidewatch.operators.quality import cap_at_quantile

    df = spark.createDataFrame([(None,), (1.0,), (2.0,), (100.0,)], "x double")
    bins = [r[0] for r in df.select(E.width_bin(F.col("x"), 0.0, 10.0, 10)).collect()]
    assert bins == [None, 1, 2, 9]
    capped = [r["x_capped"] for r in cap_at_quantile(df, "x", 0.5).collect()]
    assert capped == [None, 1.0, 2.0, 2.0]


def test_a_null_label_is_a_class_of_the_split(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("user_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("y"))
    out = M.stratified_split(df, "y")
    assert out.count() == 50 and {r["y"]: r["n"] for r in out.filter("is_test").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()} == {None: 2, 0: 4, 1: 4}


def test_infinite_and_nan_scores_rank_and_scores_outside_fall_into_outer_bins(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(-inf, 0), (-3.0, 0), (0.2, 1), (0.2, 0), (0.7, 1), (inf, 1), (nan, 1), (None, 1)]
    df = spark.createDataFrame(rows, "score double, label int")
    # of the 4 x 3 pairs one is a tie and none is lost
    assert E.auc(df, cells=4).first()["auc"] == (11 + 0.5) / 12
    finite = df.filter("score > -10 AND score < 10")
    assert {r["bin"]: r["n"] for r in E.calibration(finite).collect()} == {0: 1, 2: 2, 7: 1}
