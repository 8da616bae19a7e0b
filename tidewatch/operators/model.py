"""Model operations: splits, encoding, training, scoring, the metrics record."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import hash_unit
from tidewatch.operators.cells import DAY_MS, cell_of, running_totals
from tidewatch.operators.evaluate import auc, recall_at_fpr
from tidewatch.schema import MODEL_FEATURES


#: Rows that a task of a fit takes at least: fewer cost more in reports to the driver than they save.
ROWS_PER_TASK = 25_000


def clean_target(df: DataFrame, label: str = "has_fraud_label", name: str = "target") -> DataFrame:
    """Missing and unknown (-1) labels count as 0."""
    return df.withColumn(name, F.when(F.col(label) == 1, 1).otherwise(0).cast("int"))


def model_input(df: DataFrame, features: list[str] = MODEL_FEATURES) -> DataFrame:
    """The feature columns as doubles of single precision, missing ones 0, and all of them as one vector."""
    # by way of double: the optimizer takes a long to float to double for a widening and would leave the float out
    single = {c: F.col(c).cast("double").cast("float") for c in features}
    filled = df.withColumns({c: F.coalesce(v, F.lit(0.0)).cast("double") for c, v in single.items()})
    return VectorAssembler(inputCols=features, outputCol="features").transform(filled)


def stratified_split(df: DataFrame, label: str, test_size: float = 0.2, seed: int = 42, key: str = "user_id") -> DataFrame:
    """Adds ``is_test``: of each class exactly round(n * test_size) rows, chosen by a hash of the key.

    A null label is a class of its own. Rows are ranked per class along their hash, cut into 65,536 hash cells, so no
    class is sorted in one task.
    """
    hashed = df.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(key))).withColumn("_cell", F.shiftright("_hash", 48))
    hashed = hashed.withColumn("_class", F.struct(F.col(label).alias("label")))  # a struct of null equals itself
    ranked = running_totals(hashed, ["_class"], "_cell", [F.col("_hash"), F.col(key)], {"_rank": F.lit(1)})
    sizes = hashed.groupBy("_class").agg(F.round(F.count(F.lit(1)) * test_size).alias("_cut"))
    return ranked.join(sizes, "_class").select(*df.columns, (F.col("_rank") <= F.col("_cut")).alias("is_test"))


def group_split(df: DataFrame, shares: dict[str, float], key: str = "user_id", seed: int = 42) -> DataFrame:
    """Adds ``split``: all rows of a key fall into one part. A hash decides, so nothing is shuffled."""
    draw = hash_unit(F.lit(seed), F.col(key))
    out: Column = F.lit(None).cast("string")
    bound = 1.0
    for name, share in reversed(list(shares.items())):
        out = F.when(draw < bound, name).otherwise(out)
        bound -= share
    return df.withColumn("split", out)


def time_split(df: DataFrame, bounds_ms: list[tuple[str, int]], last: str) -> DataFrame:
    """Adds ``split`` by time: the first name whose (exclusive) upper bound lies after the row, else ``last``."""
    out = F.lit(last)
    for name, bound in reversed(bounds_ms):
        out = F.when(F.col("ts_ms") < bound, name).otherwise(out)
    return df.withColumn("split", out)


def leaked_keys(df: DataFrame, key: str = "user_id") -> DataFrame:
    """Keys that occur in more than one split; empty when there is no leak."""
    return (
        df.groupBy(key)
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .filter(F.col("first_split") != F.col("last_split"))
    )


def undersample(df: DataFrame, label: str, keep_share: float, key: str = "tx_id", seed: int = 42) -> DataFrame:
    """All positives and about ``keep_share`` of the others, chosen by a hash of the key: a filter, no shuffle."""
    return df.filter((F.col(label) == 1) | (hash_unit(F.lit(seed), F.col(key)) < keep_share))


def class_balance(df: DataFrame, target: str = "target") -> DataFrame:
    """Sizes of the classes and the weight of a positive, n_neg / max(n_pos, 1)."""
    positives, negatives = F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)
    return df.agg(
        positives.alias("n_pos"),
        negatives.alias("n_neg"),
        (negatives / F.greatest(positives, F.lit(1))).alias("scale_pos_weight"),
    )


def train_boosted_trees(
    train: DataFrame, features: list[str] = MODEL_FEATURES, target: str = "target", trees: int = 200, depth: int = 6, rate: float = 0.1, seed: int = 42
) -> Model:
    """Gradient-boosted trees with balanced classes, as a pipeline model over the assembled vector.

    Every level of every tree is a job over all rows, and each task of it reports to the driver. So rows come in pieces of
    ``ROWS_PER_TASK``, at most one per core, whatever the number of files or shuffle partitions.
    """
    weight = class_balance(train, target).first()["scale_pos_weight"]
    tasks = max(1, min(train.sparkSession.sparkContext.defaultParallelism, -(-train.count() // ROWS_PER_TASK)))
    weighted = train.withColumn("_weight", F.when(F.col(target) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))
    booster = GBTClassifier(
        labelCol=target, weightCol="_weight", maxDepth=depth, stepSize=rate, maxIter=trees, seed=seed, maxMemoryInMB=512, cacheNodeIds=False
    )
    return Pipeline(stages=[booster]).fit(model_input(weighted.select(*features, target, "_weight").repartition(tasks), features))


def score_with(model: Model, df: DataFrame, features: list[str] = MODEL_FEATURES, name: str = "score") -> DataFrame:
    """Adds the probability of class 1."""
    scored = model.transform(model_input(df, features))
    added = [F.col(c) for c in df.columns]
    return scored.select(*added, vector_to_array("probability").getItem(1).alias(name))


def feature_importance(spark, model: Model, features: list[str] = MODEL_FEATURES) -> DataFrame:
    importances = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, importances)], "feature string, importance double")


def metrics_record(
    scored: DataFrame, split: DataFrame, score: str = "score", target: str = "target", features: list[str] = MODEL_FEATURES
) -> DataFrame:
    """One row about a test: AUC, recall at 1 % false positives, sizes, share of positives, weight.

    ``scored`` is the test fold, ``split`` all rows with ``is_test``. The share of positives is taken over all rows, the
    weight over the training fold.
    """
    ranking = auc(scored, score, target).select(F.round("auc", 4).alias("auc"), F.lit(1).alias("_one"))
    recall = recall_at_fpr(scored, [0.01], score, target).select(F.round("recall", 4).alias("recall_at_1pct_fpr"), F.lit(1).alias("_one"))
    positive, train = F.col(target) == 1, ~F.col("is_test")
    balance = split.agg(
        F.count_if(train).alias("train_size"),
        F.count_if("is_test").alias("test_size"),
        F.round(F.try_divide(F.count_if(positive), F.count(F.lit(1))), 6).alias("fraud_rate"),
        F.round(F.count_if(train & ~positive) / F.greatest(F.count_if(train & positive), F.lit(1)), 2).alias("scale_pos_weight"),
        F.lit(1).alias("_one"),
    )
    out = reduce(lambda a, b: a.join(b, "_one"), [ranking, recall, balance])  # one row each
    return out.drop("_one").withColumn("n_features", F.lit(len(features))).withColumn("feature_columns", F.array(*[F.lit(f) for f in features]))


def write_metrics(record: DataFrame, path: str) -> None:
    record.write.mode("overwrite").json(path)


def blend_model(train: DataFrame, scores: list[str], target: str = "target") -> Model:
    """Logistic regression over the scores of several models."""
    stages = [VectorAssembler(inputCols=scores, outputCol="features"), LogisticRegression(labelCol=target, maxIter=50)]
    return Pipeline(stages=stages).fit(train)


# -- encoding --------------------------------------------------------------------------------------------------


def target_encoding(train: DataFrame, column: str, target: str = "target", smoothing: float = 20.0) -> DataFrame:
    """(value, encoded): the share of positives per value, drawn towards the overall share where there are few rows.

    To be computed on the training fold only and joined to the others.
    """
    counts = train.groupBy(F.col(column).alias("value")).agg(
        F.sum(F.col(target).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    overall = train.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0  # one number
    return counts.select("value", ((F.col("pos") + smoothing * overall) / (F.col("n") + smoothing)).alias("encoded"))


def weight_of_evidence(train: DataFrame, column: str, target: str = "target", prior: float = 0.5) -> DataFrame:
    """(value, woe): ln of the share of positives over the share of negatives that fall on the value."""
    counts = train.groupBy(F.col(column).alias("value")).agg(
        F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) != 1).alias("neg")
    )
    totals = train.agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) != 1).alias("n")).first()
    pos_share = (F.col("pos") + prior) / F.lit(float(totals["p"]) + prior)
    neg_share = (F.col("neg") + prior) / F.lit(float(totals["n"]) + prior)
    return counts.select("value", F.ln(pos_share / neg_share).alias("woe"))


def ordered_target_encoding(
    df: DataFrame,
    column: str,
    target: str = "target",
    name: str = "encoded",
    order: str | None = None,
    tie: str = "tx_id",
    smoothing: float = 20.0,
    prior: float = 0.5,
    seed: int = 42,
    cell_ms: int = DAY_MS,
) -> DataFrame:
    """Adds ``name``: the share of positives among the rows of the same value that come before, drawn towards ``prior``.

    Rows come by ``order`` (a time in milliseconds) and ``tie``, or in a seeded order of a hash of ``tie``. A row's own
    label and later ones stay out, so the whole table may be encoded and trained on. A null value is a value of its own;
    a null target is neither before nor counted; rows without a time see nothing and are not seen.

    Running totals over cells of the order (days, or 65,536 stretches of the hash), so a value with a third of all rows
    is not one task's.
    """
    lost = F.lit(False) if order is None else F.col(order).isNull()
    by = [F.xxhash64(F.lit(seed), F.col(tie)) if order is None else F.col(order), F.col(tie)]
    cell = F.shiftright(by[0], 48) if order is None else cell_of(by[0], cell_ms)
    known = F.col(target).isNotNull()
    own, one = F.when(F.col(target) == 1, 1).otherwise(0), known.cast("int")
    # a struct of null equals itself
    placed = df.withColumns({"_value": F.struct(F.col(column).alias("v")), "_order": by[0], "_cell": F.coalesce(cell, F.lit(0)), "_lost": lost})
    ranked = running_totals(placed.where("NOT _lost"), ["_value"], "_cell", [F.col("_order"), F.col(tie)], {"_pos": own, "_n": one})
    before = (F.col("_pos") - own + smoothing * prior) / (F.col("_n") - one + smoothing)
    out = ranked.select(*df.columns, before.alias(name))
    return out.unionByName(placed.where("_lost").select(*df.columns, F.lit(float(prior)).alias(name)))


def encode(df: DataFrame, column: str, encoding: DataFrame, value: str, name: str, default: float = 0.0) -> DataFrame:
    """Joins an encoding back; values the training fold did not have get the default."""
    side = encoding.select(F.col("value").alias("_value"), F.col(value).alias(name))
    return (
        df.join(side, F.col(column).eqNullSafe(F.col("_value")), "left")
        .drop("_value")
        .withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    )


# -- serving ---------------------------------------------------------------------------------------------------


def traffic_split(df: DataFrame, percent: int, salt: str, key: str = "user_id") -> DataFrame:
    """Adds ``uses_challenger`` for that percentage of users; a user stays on one side as the percentage grows."""
    return df.withColumn("uses_challenger", F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(100)) < percent)


def served_score(df: DataFrame, champion: str, challenger: str) -> DataFrame:
    """Both scores are kept (shadow); the one the user is served is ``score``."""
    return df.withColumn("score", F.when(F.col("uses_challenger"), F.col(challenger)).otherwise(F.col(champion)))
