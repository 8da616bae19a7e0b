"""Measures of a scored table: ranking, precision and recall, calibration, drift, quantiles.

Orderings over the whole table are cut into cells of values (see ``cells``), so none of them is sorted in one task.
Rows with the same score are first counted together, which also takes care of a score that most rows share.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators.cells import running_totals


def value_bounds(df: DataFrame, column: str, cells: int) -> list[float]:
    """Increasing bounds that split the rows into about equal parts; at most ``cells`` numbers come to the driver."""
    number = F.col(column).cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    found = df.agg(F.percentile_approx(finite, [i / cells for i in range(1, cells)]).alias("b")).first()
    return sorted({b for b in found["b"] or []})


def with_value_cell(df: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """Adds ``_cell``: infinite values fall into the outer cells, NaN into one after the last, as Spark sorts it."""
    splits = [float("-inf"), *(bounds or [0.0]), float("inf")]
    double = df.withColumn("_number", F.col(column).cast("double"))
    out = Bucketizer(splits=splits, inputCol="_number", outputCol="_cell", handleInvalid="keep").transform(double)
    # whole numbers hash alike in windows and joins, so they share a shuffle
    return out.withColumn("_cell", F.col("_cell").cast("int")).drop("_number")


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    positive = F.coalesce(F.col(label) == 1, F.lit(False))
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    )


def cumulative_counts(df: DataFrame, score: str, label: str, cells: int = 256) -> DataFrame:
    """Per distinct score, the positives (tp) and negatives (fp) at or above it."""
    bounds = value_bounds(df.filter(F.col(score).isNotNull()), score, cells)
    counts = with_value_cell(score_counts(df, score, label), "score", bounds).withColumn("_cell", -F.col("_cell"))
    return running_totals(counts, [], "_cell", [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}).drop("_cell")


def auc(df: DataFrame, score: str = "score", label: str = "label", cells: int = 256) -> DataFrame:
    """Area under the ROC curve; equal scores count half."""
    curve = cumulative_counts(df, score, label, cells)
    # each negative is beaten by the positives strictly above it and by half of those beside it
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return curve.agg(F.try_divide(won, pairs).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def pr_curve(df: DataFrame, score: str = "score", label: str = "label", cells: int = 256) -> DataFrame:
    """One row per distinct score: what happens if everything at or above it is called positive."""
    curve = cumulative_counts(df, score, label, cells)
    total = df.filter(F.col(score).isNotNull()).agg(
        F.count_if(F.coalesce(F.col(label) == 1, F.lit(False))).alias("_p"), F.count(F.lit(1)).alias("_n")
    )
    # two numbers for the whole table, so a literal rather than a join
    row = total.first()
    positives, negatives = row["_p"], row["_n"] - row["_p"]
    return curve.select(
        F.col("score").alias("threshold"),
        "tp",
        "fp",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide(F.col("tp"), F.lit(positives)).alias("recall"),
        F.try_divide(F.col("fp"), F.lit(negatives)).alias("fpr"),
    )


def auc_pr(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Average precision: precision at each threshold, weighted by the recall it adds."""
    curve = cumulative_counts(df, score, label)
    gained = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return curve.agg(F.try_divide(gained, F.sum("pos")).alias("auc_pr"))


def recall_at_fpr(
    df: DataFrame, limits: list[float], score: str = "score", label: str = "label", cells: int = 256
) -> DataFrame:
    """The highest recall among thresholds whose false-positive rate stays within each limit."""
    curve = pr_curve(df, score, label, cells)
    best = curve.agg(
        *[F.coalesce(F.max(F.when(F.col("fpr") <= x, F.col("recall"))), F.lit(0.0)).alias(f"r{i}") for i, x in enumerate(limits)]
    )
    rows = [F.struct(F.lit(x).alias("max_fpr"), F.col(f"r{i}").alias("recall")) for i, x in enumerate(limits)]
    return best.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def confusion(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    predicted = F.coalesce(F.col(score), F.lit(0.0)) >= threshold
    actual = F.coalesce(F.col(label) == 1, F.lit(False))
    return df.agg(
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count_if(~predicted & ~actual).alias("tn"),
    )


def calibration(df: DataFrame, score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """Reliability table over bins of equal width in [0, 1]; scores outside fall into the first or the last bin."""
    number = F.greatest(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(number.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(score).alias("mean_score"),
            F.avg(F.coalesce(F.col(label) == 1, F.lit(False)).cast("double")).alias("observed_rate"),
        )
    )


def expected_calibration_error(table: DataFrame) -> DataFrame:
    gap = F.abs(F.col("mean_score") - F.col("observed_rate"))
    return table.agg(F.try_divide(F.sum(gap * F.col("n")), F.sum("n")).alias("ece"))


def quantiles(df: DataFrame, column: str, probabilities: list[float], cells: int = 256) -> DataFrame:
    """Exact quantiles with linear interpolation, one row each.

    Equal values are counted together and the counts run up over cells of values; only the few values at the wanted
    ranks go on. ``percentile`` would hold every distinct value in one task.
    """
    present = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("value"))
    total = present.count()
    wanted = sorted({k for p in probabilities for k in _ranks(p, total)})
    counts = present.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    counts = with_value_cell(counts, "value", value_bounds(present, "value", cells))
    ranked = running_totals(counts, [], "_cell", [F.col("value")], {"upto": F.col("n")})
    at = {k: F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k), F.col("value"))) for k in wanted}
    wide = ranked.agg(*[c.alias(f"v{k}") for k, c in at.items()], F.count(F.lit(1)).alias("_distinct"))
    rows = []
    for p in probabilities:
        between = F.lit(None).cast("double")
        if total:
            low, high = _ranks(p, total)
            between = F.col(f"v{low}") + (F.col(f"v{high}") - F.col(f"v{low}")) * F.lit(p * (total - 1) - low)
        rows.append(F.struct(F.lit(float(p)).alias("q"), between.alias("value")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _ranks(p: float, total: int) -> tuple[int, ...]:
    if not total:
        return ()
    low = int(p * (total - 1))
    return low, min(low + 1, total - 1)


def quick_quantiles(df: DataFrame, column: str, probabilities: list[float], accuracy: int = 10_000) -> DataFrame:
    """Approximate quantiles in one pass with a fixed-size state; the rank error is at most rows / accuracy."""
    return df.agg(F.percentile_approx(column, list(probabilities), accuracy).alias("v")).select(
        F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in probabilities]).alias("q"), F.col("v").alias("value"))).alias("r")
    ).select("r.*")


# -- drift -----------------------------------------------------------------------------------------------------


def width_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin number from 0 of equal-width bins; values outside go to the first or the last one, null to none."""
    position = F.floor((value - F.lit(low)) / F.lit((high - low) / bins))
    return F.when(value.isNotNull(), F.greatest(F.least(position, F.lit(bins - 1)), F.lit(0))).cast("int")


def drift(
    base: DataFrame, current: DataFrame, columns: dict[str, tuple[float, float]], bins: int = 10, epsilon: float = 1e-6
) -> DataFrame:
    """PSI and KL(current, base) per column over equal-width bins of the given range.

    Both tables collapse to columns x bins counts before anything is compared.
    """

    def shares(df: DataFrame, name: str) -> DataFrame:
        pairs = [
            F.struct(F.lit(c).alias("column"), width_bin(F.col(c), low, high, bins).alias("bin"))
            for c, (low, high) in columns.items()
        ]
        return (
            df.select(F.explode(F.array(*pairs)).alias("p"))
            .select("p.*")
            .filter("bin IS NOT NULL")
            .groupBy("column", "bin")
            .agg(F.count(F.lit(1)).alias(name))
        )

    both = shares(base, "b").join(shares(current, "c"), ["column", "bin"], "full")
    both = both.fillna(0, ["b", "c"])
    totals = both.groupBy("column").agg(F.sum("b").alias("tb"), F.sum("c").alias("tc"))
    p = F.greatest(F.try_divide(F.col("c"), F.col("tc")), F.lit(epsilon))
    q = F.greatest(F.try_divide(F.col("b"), F.col("tb")), F.lit(epsilon))
    return (
        both.join(totals, "column")
        .groupBy("column")
        .agg(F.sum((p - q) * F.ln(p / q)).alias("psi"), F.sum(p * F.ln(p / q)).alias("kl"))
    )


def decision_mix(base: DataFrame, current: DataFrame, action: str = "DECLINE", factor: float = 1.5) -> DataFrame:
    """Share of an action in both tables and whether it grew beyond the factor."""

    hit = (F.col("action") == action).cast("double")
    both = base.select("action", F.lit(True).alias("old")).unionByName(current.select("action", F.lit(False).alias("old")))
    return (
        both.agg(
            F.avg(F.when(F.col("old"), hit)).alias("base_share"), F.avg(F.when(~F.col("old"), hit)).alias("current_share")
        )
        .withColumn("ratio", F.try_divide("current_share", "base_share"))
        .withColumn("alert", F.coalesce(F.col("current_share") > factor * F.col("base_share"), F.lit(False)))
    )


def action_rates(decisions: DataFrame) -> DataFrame:
    """Counts of each action and its share in percent."""
    counts = decisions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))  # one row per action
    return counts.withColumn("pct", F.col("n") * F.lit(100.0) / F.sum("n").over(everything))


def compare_decisions(champion: DataFrame, challenger: DataFrame) -> DataFrame:
    """Agreement matrix of two decision tables (tx_id, action) over the transactions that both decided."""
    both = champion.select("tx_id", F.col("action").alias("a")).join(challenger.select("tx_id", F.col("action").alias("b")), "tx_id")
    return back_test(both, "a", "b")


def back_test(decisions: DataFrame, champion: str, challenger: str) -> DataFrame:
    """Agreement matrix of two decisions on the same transactions."""
    return decisions.groupBy(F.col(champion).alias("champion"), F.col(challenger).alias("challenger")).agg(
        F.count(F.lit(1)).alias("n")
    )
