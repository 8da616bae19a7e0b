import pytest

from tests.brute import START
from tidewatch.operators import rules as R
from tidewatch.operators.features import sliding_features

TX = "tx_id string, user_id string, amount_minor long, country string, ts_ms long, mcc string"


def decide(df):
    return {r["tx_id"]: (r["action"], r["rules_triggered"]) for r in df.collect()}


def calls(spark, *rows):
    return spark.createDataFrame([(f"t{i}", *r, START + i * 1000, "a") for i, r in enumerate(rows)], TX)


def context(spark, **values):
    row = {"tx_id": "t", "amount_minor": 100, "country": "US", "score": 0.0, "tx_count_10m": 0.0, "tx_count_30d": 50.0, "amt_sum_1h": 0.0}
    row |= values
    schema = "tx_id string, amount_minor long, country string, score double, tx_count_10m double, tx_count_30d double, amt_sum_1h double"
    return spark.createDataFrame([tuple(row.values())], schema)


@pytest.mark.parametrize(
    "values,action,names",
    [
        ({}, "APPROVE", []),
        ({"amount_minor": 10_000_000}, "DECLINE", ["Amount exceeds maximum"]),
        ({"amount_minor": 1_000_000}, "APPROVE", []),
        ({"score": 0.9}, "REVIEW", ["Suspiciously high score"]),
        ({"score": 0.91}, "DECLINE", ["High fraud probability"]),
        ({"tx_count_10m": 5.0}, "APPROVE", []),
        ({"tx_count_10m": 6.0}, "DECLINE", ["Velocity spike (Card Testing)"]),
        ({"tx_count_10m": 3.0, "tx_count_30d": 5.0}, "DECLINE", ["New Account High Velocity"]),
        ({"tx_count_10m": 2.0, "tx_count_30d": 5.0}, "REVIEW", ["New Account Early Activity"]),
        ({"country": "RU", "amount_minor": 600_00}, "REVIEW", ["International high amount"]),
        ({"country": None, "amount_minor": 600_00}, "APPROVE", []),
        ({"amt_sum_1h": 4_000_001.0}, "REVIEW", ["Smurfing detected"]),
        ({"amount_minor": 2_000_000, "score": 0.95, "amt_sum_1h": 5e6}, "DECLINE", ["Amount exceeds maximum", "High fraud probability"]),
        ({"score": 0.8, "amt_sum_1h": 5e6}, "REVIEW", ["Suspiciously high score", "Smurfing detected"]),
    ],
)
def test_rules(spark, values, action, names):
    assert decide(R.evaluate_rules(context(spark, **values)))["t"] == (action, names)


def test_unknown_user_is_approved_reviewed_declined(spark):
    out = decide(R.score_batch(calls(spark, *[("new", 500, "US")] * 3)))
    assert [out[f"t{i}"][0] for i in range(3)] == ["APPROVE", "REVIEW", "DECLINE"]
    assert out["t2"][1] == ["New Account High Velocity"]


def test_calls_are_forgotten_after_ten_minutes(spark):
    rows = [("t0", "u", 1, "US", START, "a"), ("t1", "u", 1, "US", START + 600_000, "a"), ("t2", "u", 1, "US", START + 1_200_001, "a")]
    out = decide(R.score_batch(spark.createDataFrame(rows, TX)))
    assert [out[f"t{i}"][0] for i in range(3)] == ["APPROVE", "REVIEW", "APPROVE"]


def test_stored_counts_are_added_or_hidden(spark):
    offline = spark.createDataFrame([("old", 40)], "user_id string, tx_count_30d long")
    tx = calls(spark, *[("old", 500, "US")] * 3)
    added = decide(R.score_batch(tx, offline=offline))
    hidden = decide(R.score_batch(tx, offline=offline, count_mode="reference"))
    assert [added[f"t{i}"][0] for i in range(3)] == ["APPROVE"] * 3
    assert [hidden[f"t{i}"][0] for i in range(3)] == ["APPROVE", "REVIEW", "DECLINE"]
    with pytest.raises(ValueError):
        R.score_batch(tx, count_mode="other")


def test_card_testing_and_cash_out(spark):
    offline = spark.createDataFrame([("u", 500)], "user_id string, tx_count_30d long")
    tx = calls(spark, *[("u", 100, "US")] * 10, ("u", 90_000, "US"))
    out = decide(R.score_batch(tx, offline=offline))
    assert out["t10"] == ("DECLINE", ["Velocity spike (Card Testing)"])


def test_small_sums_below_the_limit_add_up(spark):
    offline = spark.createDataFrame([("u", 500)], "user_id string, tx_count_30d long")
    tx = sliding_features(calls(spark, *[("u", 950_000, "US")] * 5))
    without = decide(R.score_batch(tx, offline=offline))
    with_current = decide(R.score_batch(tx, offline=offline, include_current_amount=True))
    assert without["t4"] == ("APPROVE", [])  # 3,800,000 before the call
    assert with_current["t4"] == ("REVIEW", ["Smurfing detected"])  # 4,750,000 with it


def test_the_online_value_wins_and_text_is_read_as_numbers(spark):
    tx = calls(spark, ("u", 1, "US"), ("v", 1, "US"))
    online = spark.createDataFrame([("u", "7", "x")], "user_id string, tx_count_10m string, amt_sum_1h string")
    offline = spark.createDataFrame([("u", 3, 4.0), ("v", 5, 6.0)], "user_id string, tx_count_10m long, amt_sum_1h double")
    out = R.merged_features(tx, online, offline, R.RULE_FEATURES).orderBy("user_id").collect()
    assert [(r["tx_count_10m"], r["amt_sum_1h"], r["tx_count_30d"]) for r in out] == [(7.0, 0.0, 0.0), (5.0, 6.0, 0.0)]


def test_bands_and_what_comes_before_them(spark):
    rows = [(0.59, False, False), (0.6, False, False), (0.8, False, False), (0.92, False, False), (0.1, True, True), (0.1, False, True)]
    out = R.band_score(spark.createDataFrame(rows, "score double, hard_denied boolean, step_up_required boolean")).collect()
    assert [(r["action"], r["challenge"]) for r in out] == [
        ("APPROVE", None),
        ("CHALLENGE", "otp"),
        ("CHALLENGE", "biometric"),
        ("DECLINE", None),
        ("DECLINE", None),
        ("CHALLENGE", "3ds"),
    ]


def test_blacklist_entries_expire(spark):
    tx = calls(spark, ("u", 1, "US"), ("v", 1, "US"), ("w", 1, "US"))
    entries = spark.createDataFrame(
        [("user", "u", None), ("user", "u", START), ("user", "v", START + 1000), ("user", "w", START + 2001), ("card_bin", "u", None)],
        "kind string, value string, expires_at_ms long",
    )
    hit = R.on_blacklist(tx, entries, {"user": "user_id"})
    miss = R.on_blacklist(tx, entries, {"user": "user_id"}, blocked=False)
    assert {r["user_id"] for r in hit.collect()} == {"u", "w"} and {r["user_id"] for r in miss.collect()} == {"v"}


def test_a_missing_score_drops_out_of_the_blend(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.5, None), (None, None)], "a double, b double")
    assert [r["p_fraud"] for r in R.blend_scores(df, {"a": 1.0, "b": 3.0}).collect()] == [0.875, 0.5, None]


def test_image_rules(spark):
    rows = [("ok", 100.0, 50.0, 5.0, True, True), ("bad", 80.35, 41.0, 30.0, True, False), ("bare", 90.0, 60.0, 25.1, False, False)]
    df = spark.createDataFrame(rows, "image_id string, blur double, contrast double, skew_angle double, qr_detected boolean, qr_decoded boolean")
    out = {r["image_id"]: r for r in R.image_quality_rules(df).collect()}
    assert out["ok"]["is_valid"] and out["ok"]["violations"] == [] and out["ok"]["warnings"] == []
    assert [v["rule"] for v in out["bad"]["violations"]] == ["IT001/IT002", "IL001/IL002", "IQ008"] and len(out["bad"]["warnings"]) == 1
    assert out["bad"]["violations"][0]["reason"].startswith(f"Blur score {80.35:.1f} ")
    assert out["bare"]["is_valid"] and out["bare"]["warnings"] == [R.QR_MISSING]


def test_no_boost_beyond_one(spark):
    rules = [R.PriorityRule("b", "true", "BOOST", boost=0.7), R.PriorityRule("d", "score >= 1.0D", "DECLINE")]
    row = R.apply_rule_set(spark.createDataFrame([(0.5,)], "score double"), rules).first()
    assert (row["score"], row["action"], row["rule"], row["boosts"]) == (1.0, "DECLINE", "d", ["b"])


def test_alerts(spark):
    df = spark.createDataFrame([("a", "APPROVE"), ("b", "REVIEW")], "tx_id string, action string")
    assert [r["tx_id"] for r in R.alerts(df).collect()] == ["b"]
