"""Data quality: schema validation, expectations, summaries, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.operators.evaluate import quantiles


class SchemaViolation(ValueError):
    """The table breaks the canonical schema; carries the report rows."""

    def __init__(self, failures: list):
        super().__init__("; ".join(f"{r['column']}.{r['check']}: {r['failures']}" for r in failures))
        self.failures = failures


def _row_checks() -> list[tuple[str, str, Column]]:
    """(column, check, condition under which a value fails). Null fails only where null is not allowed."""
    col = F.col
    checks = [(f.name, "not_null", col(f.name).isNull()) for f in S.CANONICAL.fields if not f.nullable]
    checks += [
        ("tx_id", "pattern", ~col("tx_id").rlike(S.ULID)),
        ("user_id", "pattern", ~col("user_id").rlike(S.HEX64)),
        ("dataset_source", "allowed", ~col("dataset_source").isin(S.DATASET_SOURCES)),
        ("schema_version", "allowed", col("schema_version") != S.SCHEMA_VERSION),
        ("ts_ms", "range", col("ts_ms") < 0),
        ("amount_minor", "range", col("amount_minor") < 0),
        ("currency", "length", F.length("currency") != 3),
        ("channel", "allowed", ~col("channel").isin(S.CHANNELS)),
    ]
    checks += [(c, "pattern", ~col(c).rlike(S.HEX64)) for c in ("device_fp", "ip_hash", "email_domain_hash")]
    checks += [(c, "length", F.length(c) != 2) for c in ("country", "ip_country")]
    checks += [
        ("lat", "range", ~col("lat").between(-90, 90)),
        ("lon", "range", ~col("lon").between(-180, 180)),
        ("label", "allowed", ~col("label").isin(S.LABELS)),
    ]
    return [(c, check, F.coalesce(bad, F.lit(False))) for c, check, bad in checks]


def filter_to_schema(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Known columns only; missing nullable ones are added as null. Also names the required ones that are missing."""
    present = set(df.columns)
    missing = [f.name for f in S.CANONICAL.fields if f.name not in present and not f.nullable]
    columns = [
        F.col(f.name) if f.name in present else F.lit(None).cast(f.dataType).alias(f.name) for f in S.CANONICAL.fields
    ]
    return df.select(*columns), missing


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once. Counting combines before the shuffle, so a hot key does no harm."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def validate_canonical(df: DataFrame, raise_on_error: bool = False) -> tuple[DataFrame, DataFrame]:
    """Checks every rule on every row and returns (rows that pass all row checks, report).

    The report has a row (column, check, failures) per failed check, all found in one pass plus one grouped count
    for the uniqueness of tx_id.
    """
    out, missing = filter_to_schema(df)
    checks = _row_checks()
    wrong_type = [
        f.name for f in S.CANONICAL.fields if f.name not in missing and out.schema[f.name].dataType != f.dataType
    ]
    # a column that is absent or of the wrong type is one finding, not one per row
    checks = [c for c in checks if c[0] not in missing and c[0] not in wrong_type]
    structural = [
        F.struct(F.lit(c).alias("column"), F.lit(why).alias("check"), F.lit(1).cast("long").alias("failures"))
        for why, columns in (("column_present", missing), ("type", wrong_type))
        for c in columns
    ]
    counts = out.agg(*[F.count_if(bad).alias(f"n{i}") for i, (_, _, bad) in enumerate(checks)])
    found = [
        F.struct(F.lit(c).alias("column"), F.lit(check).alias("check"), F.col(f"n{i}").alias("failures"))
        for i, (c, check, _) in enumerate(checks)
    ]
    report = counts.select(F.explode(F.array(*structural, *found)).alias("r")).select("r.*")
    if "tx_id" not in missing:
        # rows of a repeated id, all but none excepted
        repeated = duplicates(out.filter(F.col("tx_id").isNotNull()), "tx_id").agg(
            F.lit("tx_id").alias("column"),
            F.lit("unique").alias("check"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("failures"),
        )
        report = report.unionByName(repeated)
    report = report.filter("failures > 0")
    any_bad = reduce(lambda a, b: a | b, [bad for _, _, bad in checks], F.lit(False))
    if raise_on_error:
        failures = report.orderBy("column", "check").collect()  # at most one row per check
        if failures:
            raise SchemaViolation(failures)
    return out.filter(~any_bad), report


def quick_summary(df: DataFrame) -> DataFrame:
    """Rows, users, labels and time span in one row. ``fraud_rows`` adds the labels up, so -1 subtracts."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("user_id").alias("users"),
        F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias("fraud_rows"),
        F.count_if(F.col("label") == 1).alias("fraud_count"),
        F.min("ts_ms").alias("min_ts_ms"),
        F.max("ts_ms").alias("max_ts_ms"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


# -- expectations ---------------------------------------------------------------------------------------------


def not_null(column: str) -> tuple:
    """No nulls in the column."""
    return (f"{column} not null", F.count_if(F.col(column).isNull()), 0.0, 0.0)


def matches(column: str, pattern: str) -> tuple:
    """No value outside the pattern."""
    return (f"{column} pattern", F.count_if(~F.coalesce(F.col(column).rlike(pattern), F.lit(False))), 0.0, 0.0)


def within(column: str, low: float, high: float) -> tuple:
    """No value outside [low, high]; null passes."""
    return (f"{column} range", F.count_if(~F.col(column).between(low, high)), 0.0, 0.0)


def distinct_ratio(column: str, low: float, high: float) -> tuple:
    """Distinct values per row."""
    ratio = F.try_divide(F.countDistinct(column), F.count(F.lit(1)))
    return (f"{column} distinct ratio", ratio, low, high)


def row_count(low: int, high: int) -> tuple:
    return ("row count", F.count(F.lit(1)), low, high)


def null_ratio(column: str, high: float = 0.05) -> tuple:
    """Share of nulls, at most ``high``."""
    return (f"{column} null ratio", F.avg(F.col(column).isNull().cast("double")), 0.0, high)


def row_loss(expected_rows: int, high: float = 0.001) -> tuple:
    """Share of the expected rows that did not arrive."""
    lost = F.lit(1.0) - F.count(F.lit(1)) / F.lit(float(expected_rows))
    return ("row loss", F.greatest(lost, F.lit(0.0)), 0.0, high)


def canonical_suite() -> list[tuple]:
    """The standard suite for a canonical table."""
    return [
        not_null("tx_id"),
        matches("user_id", S.HEX64_ANY_CASE),
        within("amount_minor", 0, 1_000_000_000),
        distinct_ratio("user_id", 0.05, 0.95),
        row_count(200_000, 1_000_000),
    ]


def expectations(df: DataFrame, suite: list[tuple]) -> DataFrame:
    """(name, observed, lower, upper, passed) for each expectation, from one aggregation over the table."""
    wide = df.agg(*[observed.cast("double").alias(f"o{i}") for i, (_, observed, _, _) in enumerate(suite)])
    rows = [
        F.struct(
            F.lit(name).alias("name"),
            F.col(f"o{i}").alias("observed"),
            F.lit(float(low)).alias("lower"),
            F.lit(float(high)).alias("upper"),
            F.coalesce(F.col(f"o{i}").between(low, high), F.lit(False)).alias("passed"),
        )
        for i, (name, _, low, high) in enumerate(suite)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per user: does the feature table hold at least the expected count and sum, and exactly the expected maximum?

    Both have user_id, tx_count_10m, amt_sum_1h, max_amt_1h. A user without features fails all three.
    """
    a, e = actual.alias("a"), expected.alias("e")
    checks = {
        "tx_count_10m": F.col("a.tx_count_10m") >= F.col("e.tx_count_10m"),
        "amt_sum_1h": F.col("a.amt_sum_1h") >= F.col("e.amt_sum_1h"),
        "max_amt_1h": F.col("a.max_amt_1h") == F.col("e.max_amt_1h"),
    }
    findings = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"e.{c}").cast("long").alias("expected"),
            F.col(f"a.{c}").cast("long").alias("actual"),
            F.coalesce(ok, F.lit(False)).alias("passed"),
        )
        for c, ok in checks.items()
    ]
    return (
        e.join(a, F.col("e.user_id") == F.col("a.user_id"), "left")
        .select(F.col("e.user_id").alias("user_id"), F.explode(F.array(*findings)).alias("f"))
        .select("user_id", "f.*")
    )


# -- release of data ------------------------------------------------------------------------------------------


def mask_places(df: DataFrame, digits: int = 3) -> DataFrame:
    """Coordinates at about 110 m."""
    return df.withColumn("lat", F.round("lat", digits)).withColumn("lon", F.round("lon", digits))


def ip_prefix(ip: Column) -> Column:
    """The first octet of an IPv4 address, the rest blanked."""
    return F.regexp_replace(ip, r"^(\d{1,3})\.\d{1,3}\.\d{1,3}\.\d{1,3}$", "$1.0.0.0")


def k_anonymous(df: DataFrame, quasi_ids: list[str], k: int = 50) -> DataFrame:
    """Groups of at least k people (distinct users), with their sizes: what may be released as an aggregate."""
    return (
        df.groupBy(*quasi_ids)
        .agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("tx_count"))
        .filter(F.col("users") >= k)
    )


def cap_at_quantile(df: DataFrame, column: str, quantile: float = 0.999) -> DataFrame:
    """Caps a column at its exact quantile. The quantile is one number, handed to every row as a literal."""
    bound = quantiles(df, column, [quantile]).first()["value"]
    value = F.col(column).cast("double")
    return df.withColumn(f"{column}_capped", value if bound is None else F.when(value > bound, bound).otherwise(value))
