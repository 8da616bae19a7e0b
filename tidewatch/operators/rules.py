"""Decision rules as columns: every rule is one expression inside the same projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import number_or_zero
from tidewatch.operators.cells import run_position
from tidewatch.operators.model import score_with
from tidewatch.schema import MODEL_FEATURES
from tidewatch.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """``when`` is a Spark SQL condition over the row; a null outcome counts as not met."""

    name: str
    when: str
    tier: str = "hard"


# Names and limits of the decision rules.
HARD_RULES = [
    Rule("Amount exceeds maximum", "amount_minor > 1000000"),
    Rule("High fraud probability", "score > 0.90D"),
    Rule("Velocity spike (Card Testing)", "tx_count_10m > 5"),
    Rule("New Account High Velocity", "tx_count_30d <= 5 and tx_count_10m >= 3"),
]
SOFT_RULES = [
    Rule("Suspiciously high score", "score > 0.70D", "soft"),
    Rule("International high amount", "country != 'US' and amount_minor > 50000", "soft"),
    Rule("Smurfing detected", "amt_sum_1h > 4000000", "soft"),
    Rule("New Account Early Activity", "tx_count_30d <= 5 and tx_count_10m >= 2", "soft"),
]
DEFAULT_RULES = [*HARD_RULES, *SOFT_RULES]

#: Gap after which the store forgets the counts a scoring call added.
CALL_MEMORY_MS = 600_000


def met(condition: str) -> Column:
    return F.coalesce(F.expr(condition), F.lit(False))


def names_of(rules: list[Rule]) -> Column:
    """Names of the rules that are met, in rule order."""
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(met(r.when), F.lit(r.name)) for r in rules]))


def evaluate_rules(df: DataFrame, rules: list[Rule] = DEFAULT_RULES) -> DataFrame:
    """Adds ``rules_triggered`` and ``action``. All hard rules are looked at; soft ones only if no hard one is met."""
    hard = names_of([r for r in rules if r.tier == "hard"])
    soft = names_of([r for r in rules if r.tier == "soft"])
    out = df.withColumn("_hard", hard).withColumn("_soft", soft)
    declined = F.size("_hard") > 0
    return (
        out.withColumn("rules_triggered", F.when(declined, F.col("_hard")).otherwise(F.col("_soft")))
        .withColumn(
            "action", F.when(declined, "DECLINE").when(F.size("_soft") > 0, "REVIEW").otherwise(F.lit("APPROVE"))
        )
        .drop("_hard", "_soft")
    )


def rule_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Dry run: how many rows meet each rule on its own, without deciding anything."""
    wide = df.agg(*[F.count_if(met(r.when)).alias(f"n{i}") for i, r in enumerate(rules)])
    rows = [
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.tier).alias("tier"), F.col(f"n{i}").alias("fired"))
        for i, r in enumerate(rules)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def merged_features(
    tx: DataFrame, online: DataFrame | None, offline: DataFrame | None, names: list[str]
) -> DataFrame:
    """Features of the user next to each transaction; the online value wins where there is one.

    Both tables have one row per user, so the joins keep the number of transactions. They are left to the optimizer:
    small tables are broadcast after their size is known, otherwise the join shuffles and splits skewed users.
    """
    out = tx
    for side, table in (("on", online), ("off", offline)):
        if table is not None:
            kept = [c for c in names if c in table.columns]
            out = out.join(table.select("user_id", *[F.col(c).alias(f"_{side}_{c}") for c in kept]), "user_id", "left")
    for c in names:
        found = [F.col(f"_{side}_{c}") for side in ("on", "off") if f"_{side}_{c}" in out.columns]
        if c in tx.columns:
            found.insert(0, F.col(c))
        # stored values may be text; the first one present counts even if it is not a number
        value = number_or_zero(F.coalesce(*[x.cast("string") for x in found])) if found else F.lit(0.0)
        out = out.withColumn(c, value)
    return out.drop(*[c for c in out.columns if c.startswith(("_on_", "_off_"))])


RULE_FEATURES = ["tx_count_10m", "tx_count_30d", "amt_sum_1h"]


def score_batch(
    tx: DataFrame,
    offline: DataFrame | None = None,
    online: DataFrame | None = None,
    score: Column | None = None,
    rules: list[Rule] = DEFAULT_RULES,
    count_mode: str = "additive",
    include_current_amount: bool = False,
    model: Model | None = None,
    model_features: list[str] = MODEL_FEATURES,
) -> DataFrame:
    """Decides every transaction: (tx_id, user_id, action, score, rules_triggered).

    The score is the column ``score``, or the probability that ``model`` (see ``model.train_boosted_trees``) gives the
    merged features of the user, the counts with their calls included; features that are not there count as 0. If the
    transactions bring none of the features, a user's calls of the same count have the same ones: the model then sees
    each user and count once, and the transactions, written once with their counts, are joined to that.

    Each call counts its own transaction first. The count goes on through the user's calls until 600 s pass without
    one. ``additive`` adds it to the stored counts; ``reference`` lets it hide the stored 30-day count, as a store
    would where online values win. Stored sums may hold the amount being scored (if the transactions bring their
    sliding features along); it is taken out unless ``include_current_amount``. A transaction without a user (null or
    blank) or without a time has no calls; it is decided by its own values and what is stored for its user.
    """
    if count_mode not in ("additive", "reference"):
        raise ValueError(count_mode)
    blank = F.trim(F.coalesce(F.col("user_id"), F.lit(""))) == ""
    named = tx.withColumn("_user", F.when(~blank, F.col("user_id")))
    calls = run_position(named, "_user", "ts_ms", "tx_id", CALL_MEMORY_MS, "_calls").drop("_user")
    calls = calls.withColumn("_calls", F.coalesce("_calls", F.lit(0)))
    carries_sliding = "amt_sum_1h" in tx.columns
    if model is not None and score is not None:
        raise ValueError("a score is given or a model makes it")
    names = RULE_FEATURES if model is None else list(dict.fromkeys([*RULE_FEATURES, *model_features]))
    shared = model is not None and not set(names) & set(tx.columns)
    if shared:
        calls = cut_lineage(calls)
    out = merged_features(calls.select("user_id", "_calls").distinct() if shared else calls, online, offline, names)
    if carries_sliding:
        # the transaction's own sliding count already holds this call and the ones before it
        ten_minutes = F.greatest(F.col("tx_count_10m"), F.lit(1.0))
    else:
        ten_minutes = F.col("tx_count_10m") + F.col("_calls")
    thirty_days = F.col("_calls").cast("double")
    if count_mode == "additive":
        thirty_days = F.col("tx_count_30d") + thirty_days
    amount = F.col("amt_sum_1h")
    if carries_sliding and not include_current_amount:
        amount = amount - F.col("amount_minor")
    out = (
        out.withColumn("tx_count_10m", ten_minutes)
        .withColumn("tx_count_30d", thirty_days)
        .withColumn("amt_sum_1h", amount)
    )
    if model is not None:
        out = score_with(model, out, model_features)
        if shared:
            each = out.withColumnsRenamed({"user_id": "_of", "_calls": "_count"})
            out = calls.join(each, F.col("user_id").eqNullSafe(F.col("_of")) & (F.col("_calls") == F.col("_count")))
    else:
        out = out.withColumn("score", F.lit(0.0) if score is None else F.coalesce(score.cast("double"), F.lit(0.0)))
    return evaluate_rules(out, rules).select("tx_id", "user_id", "ts_ms", "amount_minor", "action", "score", "rules_triggered")


def alerts(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("action") != "APPROVE")


# -- bands, policies, boosts, block lists ----------------------------------------------------------------------

# Upper bounds of the default score bands.
DEFAULT_BANDS = [(0.60, "APPROVE", None), (0.80, "CHALLENGE", "otp"), (0.92, "CHALLENGE", "biometric")]


def band_score(
    df: DataFrame, bands: list[tuple[float, str, str | None]] = DEFAULT_BANDS, beyond: str = "DECLINE"
) -> DataFrame:
    """Score to action by bands. A hard denial or a demanded step-up (if the columns exist) goes first."""
    pick, kind = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    if "hard_denied" in df.columns:
        pick = pick.when(F.col("hard_denied"), "DECLINE")
        kind = kind.when(F.col("hard_denied"), F.lit(None))
    if "step_up_required" in df.columns:
        pick = pick.when(F.col("step_up_required"), "CHALLENGE")
        kind = kind.when(F.col("step_up_required"), "3ds")
    for bound, action, challenge in bands:
        pick = pick.when(F.col("score") < bound, action)
        kind = kind.when(F.col("score") < bound, F.lit(challenge))
    return df.withColumn("action", pick.otherwise(beyond)).withColumn("challenge", kind)


def band_by_policy(df: DataFrame, policies: DataFrame) -> DataFrame:
    """Per-policy thresholds: ``policies`` has (policy_id, approve_below, otp_below, biometric_below)."""
    score = F.col("score")
    action = (
        F.when(score < F.col("approve_below"), "APPROVE")
        .when(score < F.col("biometric_below"), "CHALLENGE")
        .when(F.col("approve_below").isNotNull(), "DECLINE")
    )
    challenge = F.when(F.col("action") == "CHALLENGE", F.when(score < F.col("otp_below"), "otp").otherwise(F.lit("biometric")))
    return (
        df.join(policies, "policy_id", "left")
        .withColumn("action", action)
        .withColumn("challenge", challenge)
        .drop("approve_below", "otp_below", "biometric_below")
    )


@dataclass(frozen=True)
class PriorityRule:
    """BOOST adds to the score; CHALLENGE and DECLINE end the search. Higher priority is looked at first."""

    name: str
    when: str
    then: str
    priority: int = 0
    boost: float = 0.0
    challenge: str | None = None


def apply_rule_set(df: DataFrame, rules: list[PriorityRule], version: int = 1) -> DataFrame:
    """All boosts are added first (score capped at 1), then the first met rule by priority decides, else APPROVE."""
    ranked = sorted(rules, key=lambda r: -r.priority)
    boosts = [r for r in ranked if r.then == "BOOST"]
    deciding = [r for r in ranked if r.then != "BOOST"]
    added = sum((F.when(met(r.when), r.boost).otherwise(0.0) for r in boosts), F.lit(0.0))
    out = df.withColumn("_added", added).withColumn("_boosts", names_of([Rule(r.name, r.when) for r in boosts]))
    score = F.coalesce(F.col("score"), F.lit(0.0))
    out = out.withColumn("score", F.least(score + F.col("_added"), F.lit(1.0)))
    action, challenge, name = (F.when(F.lit(False), F.lit("")) for _ in range(3))
    for r in deciding:
        condition = met(r.when)
        action = action.when(condition, r.then)
        challenge = challenge.when(condition, F.lit(r.challenge))
        name = name.when(condition, r.name)
    return (
        out.withColumn("rule", name)
        .withColumn("challenge", challenge)
        .withColumn("action", action.otherwise("APPROVE"))
        .withColumn("boosts", F.col("_boosts"))
        .withColumn("ruleset_version", F.lit(version))
        .drop("_added", "_boosts")
    )


def on_blacklist(df: DataFrame, entries: DataFrame, kinds: dict[str, str], blocked: bool = True) -> DataFrame:
    """Rows with (``blocked``) or without a block-list entry that is valid at the time of the transaction.

    ``entries`` has (kind, value, expires_at_ms); null never expires. ``kinds`` maps a kind to a column. Entries are
    reduced to the latest expiry per value first, so each kind is one equi-join that cannot multiply rows.
    """
    forever = F.lit(2**62)
    latest = entries.groupBy("kind", "value").agg(
        F.max(F.coalesce("expires_at_ms", forever)).alias("_until")
    )
    out = df
    flags = []
    for kind, column in kinds.items():
        side = latest.filter(F.col("kind") == kind).select(F.col("value").alias(f"_v_{kind}"), F.col("_until").alias(f"_u_{kind}"))
        out = out.join(side, F.col(column) == F.col(f"_v_{kind}"), "left")
        flags.append(F.coalesce(F.col(f"_u_{kind}") > F.col("ts_ms"), F.lit(False)))
    hit = F.lit(False)
    for flag in flags:
        hit = hit | flag
    return out.filter(hit if blocked else ~hit).select(*df.columns)


def override_decisions(decisions: DataFrame, overrides: DataFrame) -> DataFrame:
    """The last manual override of a transaction replaces its action. ``overrides``: (tx_id, action, decided_at_ms)."""
    last = overrides.groupBy("tx_id").agg(F.max(F.struct("decided_at_ms", "action"))["action"].alias("_override"))
    return (
        decisions.join(last, "tx_id", "left")
        .withColumn("overridden", F.col("_override").isNotNull())
        .withColumn("action", F.coalesce("_override", "action"))
        .drop("_override")
    )


def pseudo_labels(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Label 1 where any rule is met, else 0."""
    return df.withColumn("pseudo_label", (F.size(names_of(rules)) > 0).cast("int"))


def blend_scores(df: DataFrame, weights: dict[str, float], name: str = "p_fraud") -> DataFrame:
    """Weighted mean of several models' scores; a missing score drops out of the mean."""
    total = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c), F.lit(0.0)) * F.lit(w) for c, w in weights.items()), F.lit(0.0))
    return df.withColumn(name, F.try_divide(value, total))


# -- image quality ---------------------------------------------------------------------------------------------

# Thresholds, codes and texts of the image rules.
BLUR_MIN, SKEW_MAX, CONTRAST_MIN = 80.4, 25.1, 41.3
BLUR_RULE, BLUR_REASON = "IT001/IT002", "Blur score %s < threshold 80.4 (Image too blurry)"
SKEW_RULE, SKEW_REASON = "IL001/IL002", "Skew angle %s° > threshold 25.1° (Risk of line grouping failure)"
QR_RULE, QR_REASON = "IQ008", "QR Code detected but could not be decoded (Damage or Blur)."
LOW_CONTRAST = "Low contrast: %s. Requires Image Enhancement (CLAHE)."
QR_MISSING = "IQ007: QR Code not detected in footer."


def image_quality_rules(metrics: DataFrame) -> DataFrame:
    """Adds is_valid, violations (rule, reason) and warnings to a table of image metrics."""

    def text(template: str, number: Column) -> Column:
        return F.format_string(template, F.call_function("format_number", number, F.lit("0.0")))

    def violation(condition: Column, rule: str, reason: Column) -> Column:
        return F.when(condition, F.struct(F.lit(rule).alias("rule"), reason.alias("reason")))

    blur, skew, contrast = F.col("blur"), F.col("skew_angle"), F.col("contrast")
    violations = F.array(
        violation(blur < BLUR_MIN, BLUR_RULE, text(BLUR_REASON, blur)),
        violation(skew > SKEW_MAX, SKEW_RULE, text(SKEW_REASON, skew)),
        violation(F.col("qr_detected") & ~F.col("qr_decoded"), QR_RULE, F.lit(QR_REASON)),
    )
    warnings = F.array(
        F.when(contrast < CONTRAST_MIN, text(LOW_CONTRAST, contrast)),
        F.when(~F.col("qr_detected"), F.lit(QR_MISSING)),
    )
    out = metrics.withColumn("violations", F.array_compact(violations)).withColumn("warnings", F.array_compact(warnings))
    return out.withColumn("is_valid", F.size("violations") == 0)


# -- risk of addresses -----------------------------------------------------------------------------------------


def with_ip_risk(tx: DataFrame, risk: DataFrame, default: float = 0.0, key: str = "ip_hash") -> DataFrame:
    """Adds ``ip_risk``: the risk that a table (``ip_hash``, ``risk``) states for the address, else ``default``.

    Of several statements about an address the highest counts. A transaction without an address gets the default.
    The table has a row per address after grouping, so the join can be split by the address on the other side.
    """
    known = risk.filter(F.col("ip_hash").isNotNull()).groupBy(F.col("ip_hash").alias("_ip")).agg(F.max("risk").alias("_risk"))
    joined = tx.join(known, F.col(key) == F.col("_ip"), "left")
    return joined.withColumn("ip_risk", F.coalesce(F.col("_risk"), F.lit(default))).drop("_ip", "_risk")
