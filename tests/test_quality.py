import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import quality as Q
from tidewatch.schema import CANONICAL
from tidewatch.sources import files

GOOD = {
    "tx_id": "01J7F2A4QX9D2PE5K7HBN3M2RX",
    "user_id": "a" * 64,
    "dataset_source": "synthetic",
    "schema_version": 1,
    "ts_ms": 1720515262123,
    "amount_minor": 12999,
    "currency": "USD",
    "channel": "ecommerce",
}
NULLABLE = T.StructType([T.StructField(f.name, f.dataType, True) for f in CANONICAL.fields])


def frame(spark, *changes):
    rows = []
    for i, change in enumerate(changes):
        row = {f.name: None for f in CANONICAL.fields} | GOOD | {"tx_id": GOOD["tx_id"][:-1] + "0123456789"[i]} | change
        rows.append(tuple(row[f.name] for f in NULLABLE.fields))
    return spark.createDataFrame(rows, NULLABLE)


def failures(report):
    return {(r["column"], r["check"]): r["failures"] for r in report.collect()}


def test_a_valid_row_passes(spark):
    valid, report = Q.validate_canonical(frame(spark, {}), raise_on_error=True)
    assert valid.count() == 1 and failures(report) == {} and valid.columns == [f.name for f in CANONICAL.fields]


@pytest.mark.parametrize(
    "change,finding",
    [
        ({"currency": "USDD"}, ("currency", "length")),
        ({"user_id": "xyz"}, ("user_id", "pattern")),
        ({"user_id": "A" * 64}, ("user_id", "pattern")),
        ({"dataset_source": "elsewhere"}, ("dataset_source", "allowed")),
        ({"label": 2}, ("label", "allowed")),
        ({"schema_version": 2}, ("schema_version", "allowed")),
        ({"lat": 999.0}, ("lat", "range")),
        ({"lon": -181.0}, ("lon", "range")),
        ({"amount_minor": -1}, ("amount_minor", "range")),
        ({"amount_minor": None}, ("amount_minor", "not_null")),
        ({"ts_ms": -1}, ("ts_ms", "range")),
        ({"channel": "pigeon"}, ("channel", "allowed")),
        ({"country": "USA"}, ("country", "length")),
        ({"device_fp": "short"}, ("device_fp", "pattern")),
        ({"tx_id": "01J7F2A4QX9D2PE5K7HBN3M2RU"}, ("tx_id", "pattern")),
    ],
)
def test_each_broken_field_is_one_finding(spark, change, finding):
    valid, report = Q.validate_canonical(frame(spark, {}, change))
    assert failures(report) == {finding: 1} and valid.count() == 1
    with pytest.raises(Q.SchemaViolation) as error:
        Q.validate_canonical(frame(spark, {}, change), raise_on_error=True)
    assert finding[0] in str(error.value)


def test_all_findings_are_collected(spark):
    _, report = Q.validate_canonical(frame(spark, {"lat": 999.0, "currency": "X"}, {"label": 7}, {"label": 8}))
    assert failures(report) == {("lat", "range"): 1, ("currency", "length"): 1, ("label", "allowed"): 2}


def test_columns_missing_unknown_and_of_the_wrong_type(spark):
    df = frame(spark, {}).drop("amount_minor", "country").withColumn("unknown_extra", F.lit(1))
    valid, report = Q.validate_canonical(df.withColumn("ts_ms", F.col("ts_ms").cast("string")))
    assert failures(report) == {("amount_minor", "column_present"): 1, ("ts_ms", "type"): 1}
    assert "unknown_extra" not in valid.columns and "country" in valid.columns


def test_repeated_ids_are_reported(spark):
    same = {"tx_id": GOOD["tx_id"]}
    _, report = Q.validate_canonical(frame(spark, same, same, {}))
    assert failures(report) == {("tx_id", "unique"): 2}


def test_summary_adds_labels_up(spark):
    row = Q.quick_summary(frame(spark, {"label": 1}, {"label": -1}, {"label": 1}, {})).first()
    assert (row["rows"], row["users"], row["fraud_rows"], row["fraud_count"]) == (4, 1, 1, 2)


def test_expectations(spark):
    users = spark.createDataFrame([("a" * 64, "t1", 5), ("a" * 64, "t2", -50), ("B" * 64, None, 5), ("zz", "t3", 5)], "user_id string, tx_id string, amount_minor long")
    found = {r["name"]: (r["observed"], r["passed"]) for r in Q.expectations(users, Q.canonical_suite()).collect()}
    assert found == {
        "tx_id not null": (1.0, False),
        "user_id pattern": (1.0, False),
        "amount_minor range": (1.0, False),
        "user_id distinct ratio": (0.75, True),
        "row count": (4.0, False),
    }


def test_reconciliation_names_users_without_features(spark):
    expected = spark.createDataFrame([("u", 2, 100, 60), ("v", 1, 5, 5)], "user_id string, tx_count_10m long, amt_sum_1h long, max_amt_1h long")
    actual = spark.createDataFrame([("u", 3, 100, 61)], expected.schema)
    got = {(r["user_id"], r["feature"]): r["passed"] for r in Q.reconcile(expected, actual).collect()}
    assert got[("u", "tx_count_10m")] and got[("u", "amt_sum_1h")] and not got[("u", "max_amt_1h")]
    assert not any(got[("v", f)] for f in ("tx_count_10m", "amt_sum_1h", "max_amt_1h"))


def test_ip_prefix(spark):
    assert spark.range(1).select(Q.ip_prefix(F.lit("10.20.30.40"))).first()[0] == "10.0.0.0"


def test_schema_changes(spark):
    old = T.StructType().add("a", "long").add("b", "string").add("c", "integer")
    new = T.StructType().add("a", "double").add("c", "integer").add("d", "string")
    got = {r["column"]: (r["change"], r["compatible"]) for r in files.schema_changes(spark, old, new).collect()}
    assert got == {"a": ("retyped", False), "b": ("removed", False), "d": ("added", True)}


def test_lake_layout_and_evolution(spark, folder):
    df = frame(spark, {}, {"dataset_source": "ulb", "country": "VN"})
    files.write_lake(df, f"{folder}/lake", ("source", "country_part"))
    back = files.read_lake(spark, f"{folder}/lake")
    assert {(r["source"], r["country_part"]) for r in back.collect()} == {("synthetic", "none"), ("ulb", "VN")}
    df.write.parquet(f"{folder}/grown/x=1")
    df.withColumn("added", F.lit(1)).write.parquet(f"{folder}/grown/x=2")
    assert "added" in files.read_lake(spark, f"{folder}/grown", merge_schema=True).columns
