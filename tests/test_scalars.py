import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.schema import ULID


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("key", ["ab" * 32, "some text", ""])
@pytest.mark.parametrize("value", ["card1=17", "", "größe"])
def test_hmac_equals_the_standard_library(spark, key, value):
    raw = bytes.fromhex(key) if len(key) == 64 else hashlib.sha256(key.encode()).digest()
    expected = hmac.new(raw, value.encode(), hashlib.sha256).hexdigest()
    assert one(spark, S.hmac_sha256(F.lit(value), key)) == expected


def test_hmac_of_null_is_that_of_the_empty_text(spark):
    null = one(spark, S.hmac_sha256(F.lit(None).cast("string"), "k"))
    assert null == one(spark, S.hmac_sha256(F.lit(""), "k")) and len(null) == 64
    assert null != one(spark, S.hmac_sha256(F.lit(""), "other"))


def test_ulid_is_well_formed_ordered_and_repeatable(spark):
    df = spark.range(5000).select("id", S.ulid(F.lit(1_700_000_000_000) + F.col("id"), F.col("id")).alias("u"))
    rows = [r["u"] for r in df.orderBy("id").collect()]
    assert rows == sorted(rows) and len(set(rows)) == 5000
    assert df.filter(F.col("u").rlike(ULID)).count() == 5000
    assert rows == [r["u"] for r in df.repartition(7).orderBy("id").collect()]
    number = 0
    for c in rows[17][:10]:
        number = number * 32 + S.ULID_DIGITS.index(c)
    assert number == 1_700_000_000_017


@pytest.mark.parametrize("amount,cents", [(0.005, 0), (0.015, 2), (0.025, 2), (1.005, 100), (2.5, 250), (-1.0, -100)])
def test_cents_are_rounded_half_to_even(spark, amount, cents):
    assert one(spark, S.to_cents(F.lit(amount))) == cents


@pytest.mark.parametrize("ms", [47705, 72695, 50735, 5, 15, 10000, 123456785, 0])
def test_seconds_round_like_the_binary_value(spark, ms):
    assert one(spark, S.seconds_2(F.lit(ms).cast("long"))) == round(ms / 1000, 2)


def test_lenient_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(S.number_or_null(F.col("t"))).collect()] == [1.5, None, None, None]
    assert [r[0] for r in df.select(S.number_or_zero(F.col("t"))).collect()] == [1.5, 0.0, 0.0, 0.0]


def test_enum_map_has_a_default(spark):
    mapping = {"a": "x"}
    df = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    assert [r[0] for r in df.select(S.enum_map(F.col("t"), mapping, "other")).collect()] == ["x", "other", "other"]


def test_text_forms(spark):
    assert one(spark, S.money_text(F.lit(123450))) == "$1,234.50"
    assert one(spark, S.clock_text(F.lit(1_720_515_262_123))) == "08:54:22"
    assert one(spark, S.device_text(F.lit(None).cast("string"), F.lit(None).cast("string"))) == "|"


def test_blank_and_nan(spark):
    assert one(spark, S.blank_to_null(F.lit(""))) is None
    assert one(spark, S.nan_to_null(F.lit(float("nan")))) is None
    assert one(spark, S.clamp(F.lit(99.0), -90.0, 90.0)) == 90.0


def test_distance_between_cities(spark):
    km = one(spark, S.haversine_km(F.lit(40.7128), F.lit(-74.0060), F.lit(35.6762), F.lit(139.6503)))
    assert 10_800 < km < 10_900


def test_hashed_draws_look_uniform_and_normal(spark):
    df = spark.range(20_000).select(S.hash_unit(F.col("id")).alias("u"), S.hash_normal(F.col("id")).alias("z"))
    row = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.avg("z"), F.stddev("z")).first()
    assert 0 <= row[0] < 0.001 and 0.999 < row[1] < 1 and abs(row[2] - 0.5) < 0.01
    assert abs(row[3]) < 0.03 and abs(row[4] - 1) < 0.03


def test_distance_from_nowhere_is_unknown(spark):
    null = F.lit(None).cast("double")
    assert one(spark, S.haversine_km(null, null, F.lit(1.0), F.lit(1.0))) is None
