"""Rules, scoring and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import rules as ops
from tidewatch.operators.detect import fat_finger
from tidewatch.operators.evaluate import action_rates, back_test, compare_decisions, decision_mix
from tidewatch.operators.features import ONLINE_FEATURES, offline_features, prior_outcomes, sliding_features
from tidewatch.operators.history import latest_per_key, recent_alerts
from tidewatch.plans import query
from tidewatch.plans.views import EV, ORD, offline, sliding
from tidewatch.sources.tables import events_as_tx, orders_as_tx, table

MIDDLE_MS = 1_705_363_200_000  # about half of the events lie before

SCORE_SQL = "least(amount_minor / 20000.0, 1.0)"


def amount_score(top: float = 20000.0):
    """A stand-in for a model: a score that follows the amount."""
    return F.least(F.col("amount_minor") / F.lit(top), F.lit(1.0))


def sql_calls(view: str) -> str:
    """Position of each transaction in its run of calls less than 600 s apart."""
    return f"""
  SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts_ms, tx_id) AS calls FROM (
    SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts_ms, tx_id ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, tx_id) <= 600000 THEN 0 ELSE 1 END AS b
      FROM {view}))"""


def sql_rules(view: str) -> str:
    """The default rules over a view with score, counts, sum, country and amount."""
    return f"""
  SELECT *, CASE WHEN hard <> '' THEN 'DECLINE' WHEN soft <> '' THEN 'REVIEW' ELSE 'APPROVE' END AS action,
         CASE WHEN hard <> '' THEN hard ELSE soft END AS rules FROM (
    SELECT *, concat_ws(', ', CASE WHEN amount_minor > 1000000 THEN 'Amount exceeds maximum' END,
        CASE WHEN score > 0.90 THEN 'High fraud probability' END,
        CASE WHEN tx_count_10m > 5 THEN 'Velocity spike (Card Testing)' END,
        CASE WHEN tx_count_30d <= 5 AND tx_count_10m >= 3 THEN 'New Account High Velocity' END) AS hard,
      concat_ws(', ', CASE WHEN score > 0.70 THEN 'Suspiciously high score' END,
        CASE WHEN country <> 'US' AND amount_minor > 50000 THEN 'International high amount' END,
        CASE WHEN amt_sum_1h > 4000000 THEN 'Smurfing detected' END,
        CASE WHEN tx_count_30d <= 5 AND tx_count_10m >= 2 THEN 'New Account Early Activity' END) AS soft
    FROM {view})"""


def shown(decisions):
    return decisions.select("tx_id", "action", "score", F.array_join("rules_triggered", ", ").alias("rules"))


_SLIDING_SCORED = f"""{EV}, s AS ({sliding('ev')}), f AS ({offline('ev')}), c AS ({sql_calls('s')}),
x AS (SELECT c.tx_id, c.ts_ms, c.country, c.amount_minor, c.amt_sum_1h - c.amount_minor AS amt_sum_1h, c.tx_count_10m,
             f.tx_count_30d + c.calls AS tx_count_30d, least(c.amount_minor / 20000.0, 1.0) AS score
      FROM c LEFT JOIN f USING (user_id)), d AS ({sql_rules('x')})"""


def scored_events(spark, folder):
    tx = events_as_tx(spark, folder)
    return ops.score_batch(sliding_features(tx), offline=offline_features(tx), score=amount_score())


@query(f"WITH {_SLIDING_SCORED} SELECT tx_id, action, score, rules FROM d")
def score_with_stream_features(spark, folder):
    return shown(scored_events(spark, folder))


@query(
    f"WITH {ORD}, c AS ({sql_calls('od')}), x AS (SELECT *, 0 AS amt_sum_1h, calls AS tx_count_10m, calls AS tx_count_30d,"
    f" least(amount_minor / 90000000.0, 1.0) AS score FROM c), d AS ({sql_rules('x')})"
    " SELECT tx_id, action, score, rules FROM d"
)
def score_without_store(spark, folder):
    return shown(ops.score_batch(orders_as_tx(spark, folder), score=amount_score(90000000.0)))


_STORED = f"""{EV}, s AS ({sliding('ev')}), f AS ({offline('ev')}), c AS ({sql_calls('ev')}),
o AS (SELECT DISTINCT ON (user_id) user_id, tx_count_10m, amt_sum_1h FROM s ORDER BY user_id, ts_ms DESC, tx_id DESC),
x AS (SELECT c.tx_id, c.country, c.amount_minor, coalesce(o.amt_sum_1h, 0) AS amt_sum_1h, coalesce(o.tx_count_10m, 0) + calls AS tx_count_10m,
             COUNT_30D AS tx_count_30d, least(c.amount_minor / 20000.0, 1.0) AS score
      FROM c LEFT JOIN o USING (user_id) LEFT JOIN f USING (user_id)), d AS ({sql_rules('x')})"""


def scored_from_store(spark, folder, mode):
    tx = events_as_tx(spark, folder)
    online = latest_per_key(sliding_features(tx), "user_id").select("user_id", *ONLINE_FEATURES)
    return shown(ops.score_batch(tx, offline=offline_features(tx), online=online, score=amount_score(), count_mode=mode))


@query(f"WITH {_STORED.replace('COUNT_30D', 'coalesce(f.tx_count_30d, 0) + calls')} SELECT tx_id, action, score, rules FROM d")
def score_additive_counts(spark, folder):
    return scored_from_store(spark, folder, "additive")


@query(f"WITH {_STORED.replace('COUNT_30D', 'calls')} SELECT tx_id, action, score, rules FROM d")
def score_reference_counts(spark, folder):
    return scored_from_store(spark, folder, "reference")


@query(
    f"WITH {EV}, s AS ({sliding('ev')}), f AS ({offline('ev')}),"
    " o AS (SELECT DISTINCT ON (user_id) * FROM s ORDER BY user_id, ts_ms DESC, tx_id DESC)"
    " SELECT ev.tx_id, CAST(o.tx_count_10m AS DOUBLE) AS tx_count_10m, CAST(f.tx_count_30d AS DOUBLE) AS tx_count_30d,"
    " CAST(o.amt_sum_1h AS DOUBLE) AS amt_sum_1h, CAST(0 AS DOUBLE) AS unknown_feature"
    " FROM ev LEFT JOIN o USING (user_id) LEFT JOIN f USING (user_id)"
)
def merged_user_features(spark, folder):
    tx = events_as_tx(spark, folder)
    online = latest_per_key(sliding_features(tx), "user_id").select("user_id", *ONLINE_FEATURES)
    names = [*ops.RULE_FEATURES, "unknown_feature"]
    return ops.merged_features(tx, online, offline_features(tx), names).select("tx_id", *names)


@query(
    f"WITH {_SLIDING_SCORED} SELECT tx_id, '$' || format('{{:,.2f}}', amount_minor / 100.0) AS amount, rules AS rule, lower(action) AS type,"
    " strftime(make_timestamp(ts_ms * 1000), '%H:%M:%S') AS time FROM d WHERE action <> 'APPROVE'"
    " ORDER BY ts_ms DESC, tx_id DESC LIMIT 50"
)
def newest_alerts(spark, folder):
    return recent_alerts(scored_events(spark, folder))


@query(
    f"WITH {_SLIDING_SCORED}, n AS (SELECT action, count(*) AS n FROM d GROUP BY action)"
    " SELECT action, n, n * CAST(100.0 AS DOUBLE) / sum(n) OVER () AS pct FROM n"
)
def action_shares(spark, folder):
    return action_rates(scored_events(spark, folder))


_DRY_RUN = [
    ("Amount exceeds maximum", "hard", "amount_minor > 1000000"),
    ("High fraud probability", "hard", "score > 0.9"),
    ("Velocity spike (Card Testing)", "hard", "tx_count_10m > 5"),
    ("New Account High Velocity", "hard", "tx_count_30d <= 5 AND tx_count_10m >= 3"),
    ("Suspiciously high score", "soft", "score > 0.7"),
    ("International high amount", "soft", "country <> 'US' AND amount_minor > 50000"),
    ("Smurfing detected", "soft", "amt_sum_1h > 4000000"),
    ("New Account Early Activity", "soft", "tx_count_30d <= 5 AND tx_count_10m >= 2"),
]


@query(
    f"WITH {EV}, s AS ({sliding('ev')}), f AS ({offline('ev')}), x AS (SELECT s.*, f.tx_count_30d, {SCORE_SQL} AS score FROM s JOIN f USING (user_id))"
    + " UNION ALL".join(f" SELECT '{rule}' AS rule, '{tier}' AS tier, count(*) FILTER ({when}) AS fired FROM x" for rule, tier, when in _DRY_RUN)
)
def rule_dry_run(spark, folder):
    tx = events_as_tx(spark, folder)
    known = offline_features(tx).select("user_id", "tx_count_30d")
    return ops.rule_counts(sliding_features(tx).join(known, "user_id").withColumn("score", amount_score()), ops.DEFAULT_RULES)


@query(
    f"WITH {_SLIDING_SCORED}, c2 AS ({sql_calls('ev')}), x2 AS (SELECT *, 0 AS amt_sum_1h, calls AS tx_count_10m, calls AS tx_count_30d, {SCORE_SQL} AS score FROM c2),"
    f" d2 AS ({sql_rules('x2')}) SELECT d.action AS champion, d2.action AS challenger, count(*) AS n FROM d JOIN d2 USING (tx_id) GROUP BY ALL"
)
def back_test_of_two_tables(spark, folder):
    plain = ops.score_batch(events_as_tx(spark, folder), score=amount_score())
    return compare_decisions(scored_events(spark, folder), plain)


#: Some events without a user, with a blank one, or without a time.
_GAPS = """
gaps AS (SELECT * REPLACE (CASE WHEN tx_id::BIGINT % 7 = 0 THEN NULL WHEN tx_id::BIGINT % 11 = 0 THEN ' ' ELSE user_id END AS user_id,
  CASE WHEN tx_id::BIGINT % 13 = 0 THEN NULL ELSE ts_ms END AS ts_ms) FROM ev),
placed AS (SELECT * FROM gaps WHERE trim(user_id) <> '' AND ts_ms IS NOT NULL),
others AS (SELECT * FROM gaps WHERE coalesce(trim(user_id), '') = '' OR ts_ms IS NULL)"""


def events_with_gaps(spark, folder):
    n = F.col("tx_id").cast("long")
    return events_as_tx(spark, folder).withColumns(
        {
            "user_id": F.when(n % 7 == 0, F.lit(None)).when(n % 11 == 0, F.lit(" ")).otherwise(F.col("user_id")),
            "ts_ms": F.when(n % 13 != 0, F.col("ts_ms")),
        }
    )


@query(
    f"WITH {EV}, {_GAPS}, c AS (SELECT tx_id, amount_minor, country, calls FROM ({sql_calls('placed')}) UNION ALL SELECT tx_id, amount_minor, country, 0 FROM others),"
    f" x AS (SELECT *, 0 AS amt_sum_1h, calls AS tx_count_10m, calls AS tx_count_30d, {SCORE_SQL} AS score FROM c), d AS ({sql_rules('x')})"
    " SELECT tx_id, action, score, rules FROM d"
)
def score_with_gaps(spark, folder):
    return shown(ops.score_batch(events_with_gaps(spark, folder), score=amount_score()))


@query(
    f"WITH {EV}, {_GAPS}, g AS (SELECT * FROM gaps WHERE user_id IS NOT NULL AND ts_ms IS NOT NULL),"
    " p AS (SELECT tx_id, lag(amount_minor) OVER w AS before, coalesce(sum(label) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS errors"
    " FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, tx_id))"
    " SELECT tx_id, coalesce(before > 0 AND amount_minor >= 3 * before, false) AS fat_finger, errors FROM gaps LEFT JOIN p USING (tx_id)"
)
def detectors_with_gaps(spark, folder):
    out = fat_finger(events_with_gaps(spark, folder), factor=3.0)
    return prior_outcomes(out, {"errors": F.col("label") == 1}).select("tx_id", "fat_finger", "errors")


_FLAGS = "amount_minor > 30000 AS hard_denied, country = 'NG' AS step_up_required"


@query(
    f"WITH {EV}, x AS (SELECT *, {SCORE_SQL} AS score, {_FLAGS} FROM ev) SELECT tx_id,"
    " CASE WHEN hard_denied THEN 'DECLINE' WHEN step_up_required THEN 'CHALLENGE' WHEN score < 0.60 THEN 'APPROVE'"
    " WHEN score < 0.92 THEN 'CHALLENGE' ELSE 'DECLINE' END AS action,"
    " CASE WHEN hard_denied THEN NULL WHEN step_up_required THEN '3ds' WHEN score < 0.60 THEN NULL WHEN score < 0.80 THEN 'otp'"
    " WHEN score < 0.92 THEN 'biometric' END AS challenge FROM x"
)
def score_bands(spark, folder):
    tx = events_as_tx(spark, folder).withColumn("score", amount_score())
    flagged = tx.withColumn("hard_denied", F.col("amount_minor") > 30000).withColumn("step_up_required", F.col("country") == "NG")
    return ops.band_score(flagged).select("tx_id", "action", "challenge")


@query(
    f"WITH {EV}, p AS (SELECT CAST(r_regionkey AS VARCHAR) AS policy_id, 0.2 + r_regionkey / 10.0 AS a, 0.3 + r_regionkey / 10.0 AS o,"
    " 0.4 + r_regionkey / 10.0 AS b FROM region), x AS (SELECT *, substr(card_bin, 4) AS policy_id, " + SCORE_SQL + " AS score FROM ev)"
    " SELECT tx_id, CASE WHEN score < a THEN 'APPROVE' WHEN score < b THEN 'CHALLENGE' WHEN a IS NOT NULL THEN 'DECLINE' END AS action,"
    " CASE WHEN score >= a AND score < b THEN CASE WHEN score < o THEN 'otp' ELSE 'biometric' END END AS challenge"
    " FROM x LEFT JOIN p USING (policy_id)"
)
def policy_bands(spark, folder):
    tenth = F.col("r_regionkey") / F.lit(10.0)
    policies = table(spark, folder, "region").select(
        F.col("r_regionkey").cast("string").alias("policy_id"),
        (F.lit(0.2) + tenth).alias("approve_below"),
        (F.lit(0.3) + tenth).alias("otp_below"),
        (F.lit(0.4) + tenth).alias("biometric_below"),
    )
    tx = events_as_tx(spark, folder).withColumn("score", amount_score()).withColumn("policy_id", F.substring("card_bin", 4, 10))
    return ops.band_by_policy(tx, policies).select("tx_id", "action", "challenge")


RULE_SET = [
    ops.PriorityRule("high_amount_overnight", "amount_minor > 9000 AND hour BETWEEN 0 AND 5 AND channel = 'card_present'", "BOOST", 100, 0.15),
    ops.PriorityRule("rare_country", "country = 'NG'", "BOOST", 80, 0.10),
    ops.PriorityRule("novel_high_amount", "score >= 0.55D AND amount_minor > 5000", "CHALLENGE", 100, challenge="otp"),
    ops.PriorityRule("very_high_score", "score >= 0.95D", "DECLINE", 110),
]


@query(
    f"WITH {EV}, x AS (SELECT *, {SCORE_SQL} AS s, amount_minor > 9000 AND hour(make_timestamp(ts_ms * 1000)) BETWEEN 0 AND 5"
    " AND channel = 'card_present' AS b1, country = 'NG' AS b2 FROM ev), y AS (SELECT *, least(s + ((CASE WHEN b1 THEN CAST(0.15 AS DOUBLE) ELSE 0 END)"
    " + (CASE WHEN b2 THEN CAST(0.1 AS DOUBLE) ELSE 0 END)), 1.0) AS score FROM x)"
    " SELECT tx_id, round(score, 9) AS score, CASE WHEN score >= 0.95 THEN 'DECLINE' WHEN score >= 0.55 AND amount_minor > 5000 THEN 'CHALLENGE'"
    " ELSE 'APPROVE' END AS action, CASE WHEN score >= 0.95 THEN 'very_high_score' WHEN score >= 0.55 AND amount_minor > 5000 THEN"
    " 'novel_high_amount' END AS rule, concat_ws(',', CASE WHEN b1 THEN 'high_amount_overnight' END, CASE WHEN b2 THEN 'rare_country' END)"
    " AS boosts, 3 AS ruleset_version FROM y"
)
def priority_rule_set(spark, folder):
    tx = events_as_tx(spark, folder).withColumn("score", amount_score()).withColumn("hour", F.hour(F.timestamp_millis("ts_ms")))
    out = ops.apply_rule_set(tx, RULE_SET, 3)
    return out.select("tx_id", F.round("score", 9).alias("score"), "action", "rule", F.array_join("boosts", ",").alias("boosts"), "ruleset_version")


def block_list(spark, folder):
    """Customers in debt (until some day each) and the merchants numbered like a nation of region 0 (for ever)."""
    users = table(spark, folder, "customer").filter("c_acctbal < 0").select(
        F.lit("user").alias("kind"),
        F.col("c_custkey").cast("string").alias("value"),
        (F.lit(1_704_500_000_000) + F.col("c_custkey") * 20_000_000).alias("expires_at_ms"),
    )
    merchants = table(spark, folder, "nation").filter("n_regionkey = 0").select(
        F.lit("merchant").alias("kind"), F.col("n_nationkey").cast("string").alias("value"), F.lit(None).cast("long").alias("expires_at_ms")
    )
    return users.unionByName(merchants)


_BLOCKED = """EXISTS (SELECT 1 FROM customer WHERE c_acctbal < 0 AND CAST(c_custkey AS VARCHAR) = user_id
    AND 1704500000000 + c_custkey * 20000000 > ts_ms)
  OR EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 0 AND CAST(n_nationkey AS VARCHAR) = merchant_id)"""


@query(f"WITH {EV} SELECT tx_id, ts_ms FROM ev WHERE {_BLOCKED}")
def blacklisted(spark, folder):
    kinds = {"user": "user_id", "merchant": "merchant_id"}
    return ops.on_blacklist(events_as_tx(spark, folder), block_list(spark, folder), kinds).select("tx_id", "ts_ms")


@query(f"WITH {EV} SELECT tx_id, ts_ms FROM ev WHERE NOT ({_BLOCKED})")
def not_blacklisted(spark, folder):
    kinds = {"user": "user_id", "merchant": "merchant_id"}
    return ops.on_blacklist(events_as_tx(spark, folder), block_list(spark, folder), kinds, blocked=False).select("tx_id", "ts_ms")


@query(
    f"WITH {ORD}, d AS (SELECT tx_id, CASE WHEN amount_minor > 30000000 THEN 'DECLINE' ELSE 'APPROVE' END AS action FROM od),"
    " o AS (SELECT DISTINCT ON (l_orderkey) CAST(l_orderkey AS VARCHAR) AS tx_id, CASE l_returnflag WHEN 'A' THEN 'APPROVE' WHEN 'R' THEN 'DECLINE'"
    " ELSE 'REVIEW' END AS new_action FROM lineitem ORDER BY l_orderkey, l_shipdate DESC, new_action DESC)"
    " SELECT tx_id, coalesce(new_action, action) AS action, new_action IS NOT NULL AS overridden FROM d LEFT JOIN o USING (tx_id)"
)
def manual_overrides(spark, folder):
    decisions = orders_as_tx(spark, folder).select(
        "tx_id", F.when(F.col("amount_minor") > 30000000, "DECLINE").otherwise(F.lit("APPROVE")).alias("action")
    )
    overrides = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("tx_id"),
        F.when(F.col("l_returnflag") == "A", "APPROVE").when(F.col("l_returnflag") == "R", "DECLINE").otherwise(F.lit("REVIEW")).alias("action"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("decided_at_ms"),
    )
    return ops.override_decisions(decisions, overrides).select("tx_id", "action", "overridden")


@query(
    f"WITH {EV} SELECT tx_id, CASE WHEN amount_minor > 15000 OR (country = 'NG' AND channel = 'atm') THEN 1 ELSE 0 END AS pseudo_label FROM ev"
)
def rule_labels(spark, folder):
    rules = [ops.Rule("large", "amount_minor > 15000"), ops.Rule("far cash", "country = 'NG' and channel = 'atm'")]
    return ops.pseudo_labels(events_as_tx(spark, folder), rules).select("tx_id", "pseudo_label")


@query(
    f"WITH {EV}, x AS (SELECT tx_id, {SCORE_SQL} AS a, CASE WHEN country <> 'GB' THEN abs(lat) / 60 END AS b FROM ev)"
    " SELECT tx_id, round((a * 0.7 + coalesce(b, 0) * 0.3) / (0.7 + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END), 9) AS p_fraud FROM x"
)
def blended_scores(spark, folder):
    tx = events_as_tx(spark, folder).withColumn("a", amount_score()).withColumn("b", F.when(F.col("country") != "GB", F.abs("lat") / 60))
    return ops.blend_scores(tx, {"a": 0.7, "b": 0.3}).select("tx_id", F.round("p_fraud", 9).alias("p_fraud"))


@query(
    "WITH m AS (SELECT event_id AS image_id, value * 3 AS blur, k * CAST(1.1 AS DOUBLE) AS contrast, k / CAST(3 AS DOUBLE) AS skew_angle,"
    " event_type <> 'view' AS qr_detected, event_type = 'click' AS qr_decoded"
    " FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)),"
    " v AS (SELECT image_id, concat_ws(' / ', CASE WHEN blur < 80.4 THEN 'IT001/IT002: Blur score ' || printf('%.1f', blur) || ' < threshold 80.4 (Image too blurry)' END,"
    " CASE WHEN skew_angle > 25.1 THEN 'IL001/IL002: Skew angle ' || printf('%.1f', skew_angle) || '° > threshold 25.1° (Risk of line grouping failure)' END,"
    " CASE WHEN qr_detected AND NOT qr_decoded THEN 'IQ008: QR Code detected but could not be decoded (Damage or Blur).' END) AS violations,"
    " concat_ws(' / ', CASE WHEN contrast < 41.3 THEN 'Low contrast: ' || printf('%.1f', contrast) || '. Requires Image Enhancement (CLAHE).' END,"
    " CASE WHEN NOT qr_detected THEN 'IQ007: QR Code not detected in footer.' END) AS warnings FROM m)"
    " SELECT *, violations = '' AS is_valid FROM v"
)
def image_quality(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int")
    metrics = table(spark, folder, "events").select(
        F.col("event_id").alias("image_id"),
        (F.col("value") * 3).alias("blur"),
        (k * F.lit(1.1)).alias("contrast"),
        (k / F.lit(3.0)).alias("skew_angle"),
        (F.col("event_type") != "view").alias("qr_detected"),
        (F.col("event_type") == "click").alias("qr_decoded"),
    )
    text = F.transform("violations", lambda v: F.concat(v["rule"], F.lit(": "), v["reason"]))
    return ops.image_quality_rules(metrics).select(
        "image_id", F.array_join(text, " / ").alias("violations"), F.array_join("warnings", " / ").alias("warnings"), "is_valid"
    )


@query(
    f"WITH {_SLIDING_SCORED}, h AS (SELECT ts_ms < {MIDDLE_MS} AS old, CASE WHEN action = 'DECLINE' THEN 1.0 ELSE 0.0 END AS hit FROM d),"
    " m AS (SELECT avg(hit) FILTER (old) AS base_share, avg(hit) FILTER (NOT old) AS current_share FROM h)"
    " SELECT *, current_share / base_share AS ratio, current_share > 1.5 * base_share AS alert FROM m"
)
def decision_mix_shift(spark, folder):
    decisions = scored_events(spark, folder)
    return decision_mix(decisions.filter(F.col("ts_ms") < MIDDLE_MS), decisions.filter(F.col("ts_ms") >= MIDDLE_MS))


@query(
    f"WITH {EV}, x AS (SELECT {SCORE_SQL} AS a, abs(lat) / 60 AS b FROM ev)"
    " SELECT CASE WHEN a < 0.6 THEN 'APPROVE' ELSE 'DECLINE' END AS champion, CASE WHEN b < 0.7 THEN 'APPROVE' ELSE 'DECLINE' END AS challenger,"
    " count(*) AS n FROM x GROUP BY ALL"
)
def champion_and_challenger(spark, folder):
    tx = events_as_tx(spark, folder)
    both = tx.select(
        F.when(amount_score() < 0.6, "APPROVE").otherwise(F.lit("DECLINE")).alias("champion"),
        F.when(F.abs("lat") / 60 < 0.7, "APPROVE").otherwise(F.lit("DECLINE")).alias("challenger"),
    )
    return back_test(both, "champion", "challenger")


@query(
    f"WITH {EV}, r AS (SELECT device_fp AS ip, round(avg(label), 9) AS risk FROM ev GROUP BY device_fp HAVING avg(label) > 0.19)"
    " SELECT tx_id, coalesce(risk, 0.05) AS ip_risk FROM ev LEFT JOIN r ON ev.device_fp = r.ip"
)
def ip_risk_lookup(spark, folder):
    tx = events_as_tx(spark, folder)
    risk = tx.groupBy(F.col("device_fp").alias("ip_hash")).agg(F.round(F.avg("label"), 9).alias("risk")).filter(F.col("risk") > 0.19)
    return ops.with_ip_risk(tx, risk, 0.05, key="device_fp").select("tx_id", "ip_risk")
