"""Splits, encodings, training and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import evaluate, model as ops, rules
from tidewatch.operators.features import offline_features
from tidewatch.plans import query
from tidewatch.plans.decisions import MIDDLE_MS
from tidewatch.plans.views import EV, ORD, offline
from tidewatch.schema import MODEL_FEATURES
from tidewatch.session import cut_lineage, new_folder
from tidewatch.sources.tables import events_as_tx, orders_as_tx

TIED_SQL = "least((amount_minor // 500) / CAST(40 AS DOUBLE), 1.0)"


def tied_score():
    """A score that many rows share."""
    return F.least(F.floor(F.col("amount_minor") / 500) / F.lit(40.0), F.lit(1.0))


def scored(spark, folder):
    return events_as_tx(spark, folder).withColumn("score", tied_score())


_SCORED = f"{EV}, x AS (SELECT *, {TIED_SQL} AS score FROM ev)"
_CURVE = (
    _SCORED
    + ", g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM x GROUP BY score),"
    " c AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,"
    " CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n FROM g WINDOW w AS (ORDER BY score DESC))"
)


@query(
    f"WITH {_SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM x),"
    " t AS (SELECT sum(rk) FILTER (label = 1) AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM r)"
    " SELECT round((s - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n), 9) AS auc, p AS positives, n AS negatives FROM t"
)
def area_under_curve(spark, folder):
    return evaluate.auc(scored(spark, folder)).withColumn("auc", F.round("auc", 9))


@query(
    f"WITH {EV}, x AS (SELECT label, amount_minor + k / 1000.0 AS score FROM (SELECT *, CAST(merchant_id AS INTEGER) AS k FROM ev)),"
    " r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM x),"
    " t AS (SELECT sum(rk) FILTER (label = 1) AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM r)"
    " SELECT round((s - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n), 9) AS auc, p AS positives, n AS negatives FROM t"
)
def area_under_curve_fine(spark, folder):
    fine = F.col("amount_minor") + F.col("merchant_id").cast("int") / F.lit(1000.0)
    out = evaluate.auc(events_as_tx(spark, folder).withColumn("score", fine))
    return out.withColumn("auc", F.round("auc", 9))


@query(
    f"WITH {_CURVE} SELECT score AS threshold, tp, fp, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(p AS DOUBLE) AS recall,"
    " fp / CAST(n AS DOUBLE) AS fpr FROM c"
)
def precision_recall(spark, folder):
    return evaluate.pr_curve(scored(spark, folder))


@query(
    f"WITH {_CURVE}, l AS (SELECT unnest([0.005, 0.01, 0.02, 0.2, 0.5]) AS x)"
    " SELECT CAST(x AS DOUBLE) AS max_fpr, coalesce(max(CASE WHEN fp / CAST(n AS DOUBLE) <= x THEN tp / CAST(p AS DOUBLE) END), 0) AS recall"
    " FROM c, l GROUP BY x"
)
def recall_at_false_positive_rates(spark, folder):
    return evaluate.recall_at_fpr(scored(spark, folder), [0.005, 0.01, 0.02, 0.2, 0.5])


@query(f"WITH {_CURVE} SELECT round(sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / max(p), 9) AS auc_pr FROM c")
def average_precision(spark, folder):
    return evaluate.auc_pr(scored(spark, folder)).withColumn("auc_pr", F.round("auc_pr", 9))


@query(
    f"WITH {_SCORED} SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label <> 1) AS fp,"
    " count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label <> 1) AS tn FROM x"
)
def confusion_matrix(spark, folder):
    return evaluate.confusion(scored(spark, folder))


_BINS = (
    _SCORED
    + ", b AS (SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(score) AS mean_score,"
    " avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS observed_rate FROM x GROUP BY 1)"
)


@query(f"WITH {_BINS} SELECT bin, n, round(mean_score, 9) AS mean_score, round(observed_rate, 9) AS observed_rate FROM b")
def calibration_table(spark, folder):
    out = evaluate.calibration(scored(spark, folder))
    return out.withColumn("mean_score", F.round("mean_score", 9)).withColumn("observed_rate", F.round("observed_rate", 9))


@query(f"WITH {_BINS} SELECT round(sum(abs(mean_score - observed_rate) * n) / sum(n), 9) AS ece FROM b")
def calibration_error(spark, folder):
    out = evaluate.expected_calibration_error(evaluate.calibration(scored(spark, folder)))
    return out.withColumn("ece", F.round("ece", 9))


_DRIFT = " UNION ALL ".join(
    f"SELECT '{c}' AS col, ts_ms < {MIDDLE_MS} AS old, CAST(greatest(least(floor(({c} - {low}) / {(high - low) / 10}), 9), 0) AS INTEGER) AS bin FROM x"
    for c, low, high in (("amount_minor", 0.0, 20000.0), ("lat", -60.0, 60.0), ("score", 0.0, 1.0))
)


@query(
    f"WITH {_SCORED}, v AS ({_DRIFT}), s AS (SELECT col, bin, count(*) FILTER (old) AS b, count(*) FILTER (NOT old) AS c FROM v GROUP BY ALL),"
    " p AS (SELECT col, greatest(c / CAST(sum(c) OVER (PARTITION BY col) AS DOUBLE), 1e-6) AS p,"
    " greatest(b / CAST(sum(b) OVER (PARTITION BY col) AS DOUBLE), 1e-6) AS q FROM s)"
    " SELECT col AS \"column\", round(sum((p - q) * ln(p / q)), 9) AS psi, round(sum(p * ln(p / q)), 9) AS kl FROM p GROUP BY col"
)
def feature_drift(spark, folder):
    tx = scored(spark, folder)
    ranges = {"amount_minor": (0.0, 20000.0), "lat": (-60.0, 60.0), "score": (0.0, 1.0)}
    out = evaluate.drift(tx.filter(F.col("ts_ms") < MIDDLE_MS), tx.filter(F.col("ts_ms") >= MIDDLE_MS), ranges)
    return out.withColumn("psi", F.round("psi", 9)).withColumn("kl", F.round("kl", 9))


@query(f"WITH {ORD} SELECT label, count(*) AS n, CAST(round(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS n_test FROM od GROUP BY label")
def stratified_split_sizes(spark, folder):
    split = ops.stratified_split(orders_as_tx(spark, folder), "label", 0.2, key="tx_id")
    return split.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"))


@query(f"WITH {ORD} SELECT user_id, count(*) AS n, 1 AS splits FROM od GROUP BY user_id")
def group_split_by_user(spark, folder):
    split = ops.group_split(orders_as_tx(spark, folder), {"train": 0.7, "valid": 0.15, "test": 0.15})
    return split.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").cast("int").alias("splits"))


_TIME = f"CASE WHEN ts_ms < {MIDDLE_MS} THEN 'train' WHEN ts_ms < {MIDDLE_MS + 604_800_000} THEN 'valid' ELSE 'test' END"


def split_by_time(spark, folder):
    bounds = [("train", MIDDLE_MS), ("valid", MIDDLE_MS + 604_800_000)]
    return ops.time_split(events_as_tx(spark, folder), bounds, "test")


@query(f"WITH {EV} SELECT {_TIME} AS split, count(*) AS n, min(ts_ms) AS first_ts_ms FROM ev GROUP BY 1")
def time_split_sizes(spark, folder):
    return split_by_time(spark, folder).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ts_ms"))


@query(
    f"WITH {EV}, s AS (SELECT user_id, {_TIME} AS split FROM ev)"
    " SELECT user_id, min(split) AS first_split, max(split) AS last_split FROM s GROUP BY user_id HAVING min(split) <> max(split)"
)
def users_leaking_over_time(spark, folder):
    return ops.leaked_keys(split_by_time(spark, folder))


@query(f"WITH {EV} SELECT count(*) FILTER (label = 1) AS positives, true AS share_is_near FROM ev")
def undersampled(spark, folder):
    tx = events_as_tx(spark, folder)
    kept = ops.undersample(tx, "label", 0.25).agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") != 1).alias("_kept"))
    total = tx.filter("label <> 1").count()
    return kept.select("positives", (F.abs(F.col("_kept") / F.lit(float(total)) - 0.25) < 0.03).alias("share_is_near"))


@query(f"WITH {EV} SELECT count(*) AS n, 0 AS users_on_both_sides, true AS stays_when_share_grows FROM ev")
def traffic_between_models(spark, folder):
    tx = ops.traffic_split(events_as_tx(spark, folder), 25, "m2").withColumnRenamed("uses_challenger", "quarter")
    tx = ops.traffic_split(tx, 5, "m2").withColumnRenamed("uses_challenger", "few")
    per_user = tx.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.min("quarter") != F.max("quarter")).cast("int").alias("both"),
        F.bool_and(~F.col("few") | F.col("quarter")).alias("stays"),
    )
    return per_user.agg(
        F.sum("n").alias("n"), F.sum("both").cast("int").alias("users_on_both_sides"), F.bool_and("stays").alias("stays_when_share_grows")
    )


@query(
    f"WITH {ORD}, t AS (SELECT CASE WHEN label = 1 THEN 1 ELSE 0 END AS target FROM od)"
    " SELECT count(*) FILTER (target = 1) AS n_pos, count(*) FILTER (target = 0) AS n_neg,"
    " count(*) FILTER (target = 0) / CAST(greatest(count(*) FILTER (target = 1), 1) AS DOUBLE) AS scale_pos_weight FROM t"
)
def class_balance(spark, folder):
    return ops.class_balance(ops.clean_target(orders_as_tx(spark, folder), "label"))


@query(
    f"WITH {EV}, a AS (SELECT avg(CAST(label AS DOUBLE)) AS a FROM ev WHERE ts_ms < {MIDDLE_MS}),"
    f" e AS (SELECT merchant_id, (sum(label) + 20 * max(a)) / (count(*) + 20) AS encoded FROM ev, a WHERE ts_ms < {MIDDLE_MS} GROUP BY merchant_id)"
    f" SELECT tx_id, round(coalesce(encoded, 0), 9) AS merchant_rate FROM ev LEFT JOIN e USING (merchant_id) WHERE ts_ms >= {MIDDLE_MS}"
)
def target_encoded_merchants(spark, folder):
    tx = events_as_tx(spark, folder).withColumn("target", F.col("label"))
    encoding = ops.target_encoding(tx.filter(F.col("ts_ms") < MIDDLE_MS), "merchant_id")
    out = ops.encode(tx.filter(F.col("ts_ms") >= MIDDLE_MS), "merchant_id", encoding, "encoded", "merchant_rate")
    return out.select("tx_id", F.round("merchant_rate", 9).alias("merchant_rate"))


@query(
    f"WITH {ORD}, t AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM od)"
    " SELECT mcc AS value, round(ln(((count(*) FILTER (label = 1) + 0.5) / CAST(max(p) + 0.5 AS DOUBLE)) /"
    " ((count(*) FILTER (label <> 1) + 0.5) / CAST(max(n) + 0.5 AS DOUBLE))), 9) AS woe FROM od, t GROUP BY mcc"
)
def weight_of_evidence(spark, folder):
    out = ops.weight_of_evidence(orders_as_tx(spark, folder).withColumn("target", F.col("label")), "mcc")
    return out.withColumn("woe", F.round("woe", 9))


MODEL_INPUTS = ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in MODEL_FEATURES)


@query(f"WITH {ORD}, f AS ({offline('od')}) SELECT user_id, {MODEL_INPUTS.replace('amt_std_30d AS F', 'round(amt_std_30d, 3) AS F')} FROM f")
def model_inputs(spark, folder):
    from pyspark.ml.functions import vector_to_array

    features = offline_features(orders_as_tx(spark, folder))
    out = ops.model_input(features.withColumn("amt_std_30d", F.round("amt_std_30d", 3)))
    v = vector_to_array("features")
    return out.select("user_id", *[v.getItem(k).alias(c) for k, c in enumerate(MODEL_FEATURES)])


#: The target of the model queries: users who pay much on average, with one in twenty told wrongly. Given tables have
#: no label that follows from features, so this one is made of them.
TARGET = "(amt_mean_30d > 25500000) <> (user_id::BIGINT % 20 = 7)"


def folds(spark, folder):
    """Features of all orders per user with target and fold, written once per query: fitting, scores and figures read the
    same small table. The features are written before the split, which reads them three times."""
    features = cut_lineage(offline_features(orders_as_tx(spark, folder)))
    told = features.withColumn("has_fraud_label", F.expr(TARGET.replace("user_id::BIGINT", "CAST(user_id AS BIGINT)")).cast("int"))
    return cut_lineage(ops.stratified_split(ops.clean_target(told), "target"))


def trained(spark, folder, _kept={}):
    """Trees of full size over all rows of the training fold, the test fold's scores, and all rows with their fold.

    The trees are fitted once per session and folder.
    """
    split, key = folds(spark, folder), (spark.sparkContext.applicationId, folder)
    if key not in _kept:
        _kept[key] = ops.train_boosted_trees(split.filter(~F.col("is_test")))
    return _kept[key], ops.score_with(_kept[key], split.filter("is_test")), split


_FOLDS = f"""{ORD}, f AS ({offline('od')}), t AS (SELECT user_id, ({TARGET})::INTEGER AS target FROM f),
c AS (SELECT target, count(*) AS n, round(count(*) * 0.2)::BIGINT AS n_test FROM t GROUP BY target)"""


@query()
def boosted_tree_scores(spark, folder):
    """Every user of the test fold with the probability that 200 trees of depth 6 give; SQL can't grow trees, so
    ``boosted_tree_quality`` says what they must reach."""
    return trained(spark, folder)[1].select("user_id", "target", "score")


@query(
    f"WITH {_FOLDS} SELECT target, n_test AS n, n_test AS users, true AS are_probabilities, true AS auc_over_075, true AS mean_on_its_side, 200 AS trees,"
    " 6 AS depth FROM c"
)
def boosted_tree_quality(spark, folder):
    """What the SQL can say of the scores: the rows of the fold, and floors that a constant score misses."""
    model, test, _ = trained(spark, folder)
    booster = model.stages[-1]
    own = test.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("user_id").alias("users"),
        F.bool_and(F.col("score").between(0, 1)).alias("are_probabilities"),
        F.avg("score").alias("mean"),
    )
    ranking = evaluate.auc(test, "score", "target").select((F.col("auc") > 0.75).alias("auc_over_075"))
    side = F.when(F.col("target") == 1, F.col("mean") > 0.55).otherwise(F.col("mean") < 0.45).alias("mean_on_its_side")
    sizes = [F.lit(booster.getNumTrees).alias("trees"), F.lit(booster.getMaxDepth()).alias("depth")]
    return own.crossJoin(ranking).select("target", "n", "users", "are_probabilities", "auc_over_075", side, *sizes)


#: Features are taken before the middle of the orders' years, the target in the year after it.
ORDERS_MIDDLE_MS = 803_347_200_000
TARGET_END_MS = ORDERS_MIDDLE_MS + 366 * 86_400_000

_LATER_FOLDS = f"""{ORD}, f AS (SELECT DISTINCT user_id FROM od WHERE ts_ms < {ORDERS_MIDDLE_MS}),
t AS (SELECT f.user_id, coalesce(max(label) = 1, false)::INTEGER AS target
  FROM f LEFT JOIN od ON od.user_id = f.user_id AND ts_ms >= {ORDERS_MIDDLE_MS} AND ts_ms < {TARGET_END_MS} GROUP BY ALL),
c AS (SELECT target, count(*) AS n, round(count(*) * 0.2)::BIGINT AS n_test FROM t GROUP BY target)"""


@query(
    f"WITH {_LATER_FOLDS} SELECT true AS auc_in_range, true AS recall_in_range, sum(n - n_test)::BIGINT AS train_size, sum(n_test)::BIGINT AS test_size,"
    " round(sum(n) FILTER (target = 1) / sum(n)::DOUBLE, 6) AS fraud_rate, round(coalesce(sum(n - n_test) FILTER (target = 0), 0)"
    " / greatest(coalesce(sum(n - n_test) FILTER (target = 1), 0), 1)::DOUBLE, 2) AS scale_pos_weight, 12 AS n_features FROM c"
)
def model_metrics_next_year(spark, folder):
    """The record of trees that tell a label of the next year from earlier orders. The given labels don't follow from
    features, so the ranking is only held to its range; ``model_metrics_quality`` has a floor for a target that does."""
    record = _next_year(spark, folder).drop("feature_columns")
    ranges = {"auc_in_range": F.col("auc").between(0, 1), "recall_in_range": F.col("recall_at_1pct_fpr").between(0, 1)}
    return record.withColumns(ranges).drop("auc", "recall_at_1pct_fpr")


def _next_year(spark, folder):
    tx = orders_as_tx(spark, folder)
    features = offline_features(tx.filter(F.col("ts_ms") < ORDERS_MIDDLE_MS)).drop("has_fraud_label")
    later = tx.filter((F.col("ts_ms") >= ORDERS_MIDDLE_MS) & (F.col("ts_ms") < TARGET_END_MS)).groupBy("user_id").agg(F.max("label").alias("has_fraud_label"))
    split = cut_lineage(ops.stratified_split(ops.clean_target(features.join(later, "user_id", "left")), "target"))
    model = ops.train_boosted_trees(split.filter(~F.col("is_test")))
    return ops.metrics_record(ops.score_with(model, split.filter("is_test")), split)


@query()
def model_metrics(spark, folder):
    """The whole metrics records of both targets: the label of the next year, told from earlier orders, and the target
    that is made of the features of all orders. ``model_metrics_next_year`` and ``model_metrics_quality`` compare them
    with SQL."""
    _, test, split = trained(spark, folder)
    made, later = ops.metrics_record(test, split), _next_year(spark, folder)
    return made.withColumn("target", F.lit("mean payment")).unionByName(later.withColumn("target", F.lit("label of the next year")))


@query(
    f"WITH {_FOLDS} SELECT true AS auc_over_075, true AS recall_in_range, sum(n - n_test)::BIGINT AS train_size, sum(n_test)::BIGINT AS test_size,"
    " round(sum(n) FILTER (target = 1) / sum(n)::DOUBLE, 6) AS fraud_rate, round(coalesce(sum(n - n_test) FILTER (target = 0), 0)"
    " / greatest(coalesce(sum(n - n_test) FILTER (target = 1), 0), 1)::DOUBLE, 2) AS scale_pos_weight, 12 AS n_features,"
    f" '{','.join(MODEL_FEATURES)}' AS feature_columns FROM c"
)
def model_metrics_quality(spark, folder):
    """The record written and read back as JSON, its AUC over a floor."""
    _, test, split = trained(spark, folder)
    path = new_folder(spark, "metrics")
    ops.write_metrics(ops.metrics_record(test, split), path)
    read = spark.read.json(path)
    floors = {"auc_over_075": F.col("auc") > 0.75, "recall_in_range": F.col("recall_at_1pct_fpr").between(0, 1), "feature_columns": F.array_join("feature_columns", ",")}
    return read.withColumns(floors).drop("auc", "recall_at_1pct_fpr").withColumn("n_features", F.col("n_features").cast("int"))


@query()
def model_feature_importance(spark, folder):
    """The twelve importances; ``model_uses_its_signal`` says which must lead."""
    return ops.feature_importance(spark, trained(spark, folder)[0])


@query(
    f"WITH {_FOLDS} SELECT count(*) AS users, '{','.join(sorted(MODEL_FEATURES))}' AS features, 'amt_mean_30d' AS leading, 1.0::DOUBLE AS total FROM t"
)
def model_uses_its_signal(spark, folder):
    """The feature that makes the target leads the importances, which add up to one."""
    model, _, split = trained(spark, folder)
    told = ops.feature_importance(spark, model)
    lead = told.orderBy(F.desc("importance")).limit(1).agg(F.array_join(F.sort_array(F.collect_list("feature")), ",").alias("leading"))
    names = told.agg(F.array_join(F.sort_array(F.collect_list("feature")), ",").alias("features"), F.round(F.sum("importance"), 6).alias("total"))
    return split.agg(F.count(F.lit(1)).alias("users")).crossJoin(names).crossJoin(lead)


@query(
    f"WITH {ORD}, f AS ({offline('od')}) SELECT tx_id, user_id, amount_minor, true AS is_probability, true AS declined_when_sure,"
    " true AS reviewed_at_least FROM od JOIN f USING (user_id)"
)
def score_with_model(spark, folder):
    """All orders decided with the model in the scoring path, from the users' features as they were stored for the fit."""
    model, _, stored = trained(spark, folder)
    # what the rules look at, written since calls are counted in two readings
    tx = cut_lineage(orders_as_tx(spark, folder).select("tx_id", "user_id", "ts_ms", "amount_minor", "country"))
    out = rules.score_batch(tx, offline=stored, model=model)
    sure, likely = F.col("score") > 0.9, F.col("score") > 0.7
    return out.select(
        "tx_id",
        "user_id",
        "amount_minor",
        F.col("score").between(0, 1).alias("is_probability"),
        (~sure | ((F.col("action") == "DECLINE") & F.array_contains("rules_triggered", "High fraud probability"))).alias("declined_when_sure"),
        (~likely | F.col("action").isin("DECLINE", "REVIEW")).alias("reviewed_at_least"),
    )


@query()
def blended_by_regression(spark, folder):
    """Each transaction with the blended probability; ``blend_quality`` compares it with what it is made of."""
    return _blended(spark, folder).select("tx_id", "target", "p_fraud")


def _blended(spark, folder):
    """A logistic blend of two scores of which each knows half of the target."""
    k = F.col("merchant_id").cast("int")
    a, b = (F.col("amount_minor") % 1000) / 1000.0, F.pmod(k * 37, F.lit(101)) / 101.0
    tx = events_as_tx(spark, folder).select("tx_id", (a + b > 1).cast("int").alias("target"), a.alias("a"), b.alias("b"))
    model = ops.blend_model(tx, ["a", "b"])
    from pyspark.ml.functions import vector_to_array

    return model.transform(tx).withColumn("p_fraud", vector_to_array("probability").getItem(1))


@query(
    f"WITH {EV}, t AS (SELECT (amount_minor % 1000) / 1000.0 + ((merchant_id::INTEGER * 37) % 101) / 101.0 > 1 AS y FROM ev)"
    " SELECT count(*) AS n, count(*) FILTER (y) AS positives, true AS auc_over_099, true AS better_than_each FROM t"
)
def blend_quality(spark, folder):
    out = _blended(spark, folder)
    figures = [evaluate.auc(out, c, "target").first()["auc"] for c in ("p_fraud", "a", "b")]  # three numbers
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("positives")).select(
        "n", "positives", F.lit(figures[0] > 0.99).alias("auc_over_099"), F.lit(figures[0] > max(figures[1:]) + 0.05).alias("better_than_each")
    )


@query(
    f"WITH {ORD}, w AS (SELECT tx_id, mcc, count(*) OVER w AS n, count(*) FILTER (label = 1) OVER w AS pos FROM od"
    " WINDOW w AS (PARTITION BY mcc ORDER BY ts_ms, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    " SELECT tx_id, mcc, round((pos + 10.0) / (n + 20.0), 9) AS encoded FROM w"
)
def ordered_encoding(spark, folder):
    """Each order's priority as the share of positives among earlier orders of that priority."""
    tx = orders_as_tx(spark, folder).withColumn("target", F.col("label"))
    out = ops.ordered_target_encoding(tx, "mcc", order="ts_ms")
    return out.select("tx_id", "mcc", F.round("encoded", 9).alias("encoded"))


@query(
    f"WITH {EV}, k AS (SELECT tx_id, ts_ms, user_id, amount_minor FROM ev WHERE label <> 1 OR label IS NULL), s AS (SELECT count(*) AS n, sum(amount_minor) AS amount FROM k)"
    f", p AS (SELECT count(*) AS positives FROM ev WHERE label = 1) SELECT positives, n AS others, true AS near_a_quarter, true AS same_each_time FROM s, p"
)
def undersampled_share(spark, folder):
    """All positives stay; of the others a quarter, within four standard deviations, and the same rows each time."""
    tx = events_as_tx(spark, folder)
    kept = ops.undersample(tx, "label", 0.25)
    again = ops.undersample(tx.repartition(3), "label", 0.25)
    others = F.count_if(F.col("label") != 1)
    a = kept.agg(F.count_if(F.col("label") == 1).alias("positives"), others.alias("taken"), F.bit_xor(F.xxhash64("tx_id")).alias("rows"))
    b = again.agg(F.bit_xor(F.xxhash64("tx_id")).alias("rows_again"))
    n = tx.agg(others.alias("others"))
    spread = 4 * F.sqrt(F.col("others") * 0.25 * 0.75)
    return a.crossJoin(b).crossJoin(n).select(
        "positives",
        "others",
        (F.abs(F.col("taken") - F.col("others") * 0.25) <= spread).alias("near_a_quarter"),
        (F.col("rows") == F.col("rows_again")).alias("same_each_time"),
    )


@query(
    f"WITH {EV} SELECT tx_id, amount_minor::DOUBLE AS champion, ts_ms::DOUBLE AS challenger, true AS one_of_them, true AS by_side FROM ev"
)
def served_scores(spark, folder):
    """Both models' scores stay beside the one that is served, which is the challenger's on its side of the traffic."""
    tx = events_as_tx(spark, folder).select("tx_id", "user_id", F.col("amount_minor").cast("double").alias("champion"), F.col("ts_ms").cast("double").alias("challenger"))
    out = ops.served_score(ops.traffic_split(tx, 25, "m2"), "champion", "challenger")
    side = F.when(F.col("uses_challenger"), F.col("score") == F.col("challenger")).otherwise(F.col("score") == F.col("champion"))
    return out.select("tx_id", "champion", "challenger", F.col("score").isin(F.col("champion"), F.col("challenger")).alias("one_of_them"), side.alias("by_side"))
