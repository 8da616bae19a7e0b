"""Data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.scalars import ulid
from tidewatch.operators import heavy, history, quality as ops
from tidewatch.operators.evaluate import quantiles, quick_quantiles
from tidewatch.operators.features import sliding_features
from tidewatch.operators.history import latest_per_key
from tidewatch.plans import query
from tidewatch.plans.canonical import KEY, paysim_input
from tidewatch.plans.views import EV, ORD, sliding
from tidewatch.operators.canonical import canonicalize_paysim
from tidewatch.sources.tables import events_as_tx, orders_as_tx, table


def flawed_canonical(spark, folder):
    """Events as canonical rows that break several checks, in known numbers: two events of each ten share an id, and
    ids of errors have a character too many."""
    number = F.col("tx_id").cast("long")
    twin = (number % 10).isin(3, 4)
    own = ulid(F.when(twin, F.lit(0)).otherwise(F.col("ts_ms")), F.when(twin, F.floor(number / 10)).otherwise(number), twin)
    return events_as_tx(spark, folder).select(
        F.concat(own, F.when(F.col("mcc") == "error", "!").otherwise(F.lit(""))).alias("tx_id"),
        F.sha2("user_id", 256).alias("user_id"),
        F.when(F.col("mcc") == "view", "elsewhere").otherwise(F.lit("synthetic")).alias("dataset_source"),
        F.when(F.col("mcc") == "click", 2).otherwise(1).alias("schema_version"),
        F.col("ts_ms"),
        (F.col("amount_minor") - 100).alias("amount_minor"),
        F.when(F.col("country") == "NG", "USDD").otherwise(F.lit("USD")).alias("currency"),
        F.nullif("channel", F.lit("atm")).alias("channel"),
        F.when(F.col("country") == "GB", "GBR").otherwise(F.col("country")).alias("country"),
        (F.col("lat") * 2).alias("lat"),
        F.col("lon"),
        F.when(F.col("mcc") == "signup", 2).otherwise(F.col("label")).cast("byte").alias("label"),
        F.lit("x").alias("unknown_extra"),
    )


@query(
    f"WITH {EV}, f AS (SELECT *, CASE WHEN tx_id::BIGINT % 10 IN (3, 4) THEN 'twin' || tx_id::BIGINT // 10 ELSE tx_id END || (mcc = 'error') AS t FROM ev),"
    " d AS (SELECT t, count(*) AS n FROM f GROUP BY t HAVING count(*) > 1)"
    " SELECT * FROM (SELECT 'tx_id' AS \"column\", 'pattern' AS \"check\", count(*) AS failures FROM f WHERE mcc = 'error'"
    " UNION ALL SELECT 'tx_id', 'unique', CAST(sum(n) AS BIGINT) FROM d"
    " UNION ALL SELECT 'dataset_source', 'allowed', count(*) FROM f WHERE mcc = 'view'"
    " UNION ALL SELECT 'schema_version', 'allowed', count(*) FROM f WHERE mcc = 'click'"
    " UNION ALL SELECT 'amount_minor', 'range', count(*) FROM f WHERE amount_minor < 100"
    " UNION ALL SELECT 'currency', 'length', count(*) FROM f WHERE country = 'NG'"
    " UNION ALL SELECT 'channel', 'not_null', count(*) FROM f WHERE channel = 'atm'"
    " UNION ALL SELECT 'country', 'length', count(*) FROM f WHERE country = 'GB'"
    " UNION ALL SELECT 'lat', 'range', count(*) FROM f WHERE abs(lat * 2) > 90"
    " UNION ALL SELECT 'lon', 'range', count(*) FROM f WHERE abs(lon) > 180"
    " UNION ALL SELECT 'label', 'allowed', count(*) FROM f WHERE mcc = 'signup') WHERE failures > 0"
)
def validation_report(spark, folder):
    return ops.validate_canonical(flawed_canonical(spark, folder))[1]


@query(
    f"WITH {EV} SELECT sha256(user_id) AS user_id, ts_ms, amount_minor - 100 AS amount_minor, channel, country, lat * 2 AS lat, lon, label FROM ev"
    " WHERE mcc NOT IN ('error', 'view', 'click', 'signup') AND amount_minor >= 100 AND country NOT IN ('NG', 'GB') AND channel <> 'atm'"
    " AND abs(lat * 2) <= 90 AND abs(lon) <= 180"
)
def valid_rows(spark, folder):
    """Of rows that break all kinds of checks, those that break none (but uniqueness, which is not a row's)."""
    valid, _ = ops.validate_canonical(flawed_canonical(spark, folder))
    return valid.select("user_id", "ts_ms", "amount_minor", "channel", "country", "lat", "lon", "label")


@query("SELECT count(*) AS valid_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def valid_transfers(spark, folder):
    """All rows of a mapped source pass."""
    valid, _ = ops.validate_canonical(canonicalize_paysim(paysim_input(spark, folder), KEY))
    return valid.agg(F.count(F.lit(1)).alias("valid_rows"))


@query(f"WITH {EV} SELECT tx_id, user_id, ts_ms, mcc, CAST(NULL AS VARCHAR) AS ip_hash, CAST(NULL AS DOUBLE) AS lon, 'dataset_source,schema_version' AS missing FROM ev")
def filtered_to_schema(spark, folder):
    """Unknown columns go, missing ones come as nulls, and required ones that are missing are named."""
    tx = events_as_tx(spark, folder).drop("lon").withColumn("unknown_extra", F.lit("x"))
    out, missing = ops.filter_to_schema(tx)
    return out.select("tx_id", "user_id", "ts_ms", "mcc", "ip_hash", "lon", F.lit(",".join(sorted(missing))).alias("missing"))


@query(
    f"WITH {EV} SELECT tx_id, CASE WHEN merchant_id::INTEGER < 90 THEN (merchant_id::INTEGER + 1) || '.0.0.0' ELSE 'fe80::' || merchant_id END AS ip FROM ev"
)
def masked_addresses(spark, folder):
    k = F.col("merchant_id").cast("int")
    ip = F.when(k < 90, F.concat_ws(".", k + 1, k, F.lit("7"), F.lit("255"))).otherwise(F.concat(F.lit("fe80::"), "merchant_id"))
    return events_as_tx(spark, folder).select("tx_id", ops.ip_prefix(ip).alias("ip"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, folder):
    return ops.duplicates(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER"
    " (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1"
)
def deduplicated_lines(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    return history.deduplicate(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


@query(
    f"WITH {EV} SELECT count(*) AS rows, count(DISTINCT user_id) AS users, CAST(sum(label) AS BIGINT) AS fraud_rows,"
    " count(*) FILTER (label = 1) AS fraud_count, min(ts_ms) AS min_ts_ms, max(ts_ms) AS max_ts_ms FROM ev"
)
def quick_summary(spark, folder):
    return ops.quick_summary(events_as_tx(spark, folder))


@query(f"WITH {EV} SELECT mcc, count(*) AS n FROM ev GROUP BY mcc")
def value_counts(spark, folder):
    return ops.value_counts(events_as_tx(spark, folder), "mcc")


@query(f"WITH {EV} SELECT mcc, count(*) AS n FROM ev GROUP BY mcc ORDER BY n DESC, mcc LIMIT 3")
def top_mcc(spark, folder):
    return ops.value_counts(events_as_tx(spark, folder), "mcc").orderBy(F.desc("n"), "mcc").limit(3)


@query(
    f"WITH {EV}, s AS (SELECT *, sha256(user_id) AS u FROM ev WHERE mcc <> 'signup'), o AS (SELECT 'tx_id not null' AS name,"
    " CAST(count(*) FILTER (tx_id IS NULL) AS DOUBLE) AS observed, CAST(0 AS DOUBLE) AS lower, CAST(0 AS DOUBLE) AS upper FROM s"
    " UNION ALL SELECT 'user_id pattern', count(*) FILTER (NOT regexp_matches(u, '^[a-fA-F0-9]{64}$')), 0, 0 FROM s"
    " UNION ALL SELECT 'amount_minor range', count(*) FILTER (amount_minor NOT BETWEEN 0 AND 1000000000), 0, 0 FROM s"
    " UNION ALL SELECT 'user_id distinct ratio', round(count(DISTINCT u) / CAST(count(*) AS DOUBLE), 9), 0.05, 0.95 FROM s"
    " UNION ALL SELECT 'row count', count(*), 200000, 1000000 FROM s"
    " UNION ALL SELECT 'device_fp null ratio', avg(CASE WHEN device_fp IS NULL THEN 1.0 ELSE 0.0 END), 0, 0.05 FROM s"
    " UNION ALL SELECT 'row loss', round(1.0 - count(*) / (SELECT count(*) FROM ev)::DOUBLE, 9), 0, 0.001 FROM s)"
    " SELECT *, observed BETWEEN lower AND upper AS passed FROM o"
)
def expectation_suite(spark, folder):
    """The suite over a table that lost its signups on the way."""
    arrived = events_as_tx(spark, folder).where("mcc <> 'signup'")
    hashed = arrived.withColumn("user_id", F.sha2("user_id", 256))
    suite = [*ops.canonical_suite(), ops.null_ratio("device_fp"), ops.row_loss(table(spark, folder, "events").count())]
    return ops.expectations(hashed, suite).withColumn("observed", F.round("observed", 9))


_EXPECTED_AND_ACTUAL = (
    "a AS (SELECT DISTINCT ON (user_id) * FROM s ORDER BY user_id, ts_ms DESC, tx_id DESC),"
    " e AS (SELECT user_id, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS total, max(amount_minor) AS top FROM ev GROUP BY user_id)"
)


@query(
    f"WITH {EV}, s AS ({sliding('ev')}), {_EXPECTED_AND_ACTUAL}"
    " SELECT user_id, 'tx_count_10m' AS feature, n AS expected, tx_count_10m AS actual, tx_count_10m >= n AS passed FROM e JOIN a USING (user_id)"
    " UNION ALL SELECT user_id, 'amt_sum_1h', total, amt_sum_1h, amt_sum_1h >= total FROM e JOIN a USING (user_id)"
    " UNION ALL SELECT user_id, 'max_amt_1h', top, max_amt_1h, max_amt_1h = top FROM e JOIN a USING (user_id)"
)
def reconciled_features(spark, folder):
    tx = events_as_tx(spark, folder)
    expected = tx.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("tx_count_10m"), F.sum("amount_minor").alias("amt_sum_1h"), F.max("amount_minor").alias("max_amt_1h")
    )
    return ops.reconcile(expected, latest_per_key(sliding_features(tx), "user_id"))


@query(f"WITH {EV} SELECT tx_id, round(lat / 7, 3) AS lat, round(lon / 7, 3) AS lon FROM ev")
def masked_places(spark, folder):
    places = events_as_tx(spark, folder).select("tx_id", (F.col("lat") / 7).alias("lat"), (F.col("lon") / 7).alias("lon"))
    return ops.mask_places(places)


@query(
    f"WITH {EV} SELECT country, channel, count(DISTINCT user_id) AS users, count(*) AS tx_count FROM ev GROUP BY ALL HAVING count(DISTINCT user_id) >= 50"
)
def k_anonymous_groups(spark, folder):
    return ops.k_anonymous(events_as_tx(spark, folder), ["country", "channel"], 50)


@query(
    f"WITH {ORD}, q AS (SELECT quantile_cont(CAST(amount_minor AS DOUBLE), 0.999) AS q FROM od)"
    " SELECT tx_id, round(least(CAST(amount_minor AS DOUBLE), q), 4) AS amount_minor_capped FROM od, q"
)
def capped_amounts(spark, folder):
    out = ops.cap_at_quantile(orders_as_tx(spark, folder), "amount_minor", 0.999)
    return out.select("tx_id", F.round("amount_minor_capped", 4).alias("amount_minor_capped"))


_QS = [0.5, 0.9, 0.95, 0.99, 1.0]


@query(
    "SELECT CAST(q AS DOUBLE) AS q, round(v, 6) AS value FROM (SELECT unnest([0.5, 0.9, 0.95, 0.99, 1.0]) AS q,"
    " unnest(quantile_cont(l_extendedprice, [0.5, 0.9, 0.95, 0.99, 1.0])) AS v FROM lineitem)"
)
def price_quantiles(spark, folder):
    return quantiles(table(spark, folder, "lineitem"), "l_extendedprice", _QS).withColumn("value", F.round("value", 6))


@query(
    "SELECT CAST(q AS DOUBLE) AS q, true AS near FROM (SELECT unnest([0.5, 0.9, 0.95, 0.99, 1.0]) AS q)"
)
def quick_price_quantiles(spark, folder):
    lines = table(spark, folder, "lineitem")
    exact = quantiles(lines, "l_extendedprice", _QS)
    quick = quick_quantiles(lines, "l_extendedprice", _QS).withColumnRenamed("value", "quick")
    return exact.join(quick, "q").select("q", (F.abs(F.col("value") - F.col("quick")) <= 0.01 * F.col("value")).alias("near"))


@query(
    "SELECT l_partkey AS value, count(*) AS n, true AS not_too_low FROM lineitem GROUP BY l_partkey HAVING count(*) >= (SELECT count(*) FROM lineitem) * 0.0007"
)
def heavy_parts(spark, folder):
    """Parts of at least seven in ten thousand order lines, out of a count-min sketch, counted again."""
    out = heavy.heavy_hitters(table(spark, folder, "lineitem"), "l_partkey", 0.0007)
    return out.select("value", "n", (F.col("estimate") >= F.col("n")).alias("not_too_low"))
