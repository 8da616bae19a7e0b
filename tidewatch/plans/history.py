"""Latest rows, profiles, live figures, lake and store tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import history as ops
from tidewatch.operators.cells import DAY_MS
from tidewatch.operators.features import offline_features, sliding_features
from tidewatch.plans import query
from tidewatch.plans.views import EV, ORD, offline, sliding
from tidewatch.schema import MODEL_FEATURES
from tidewatch.session import new_folder
from tidewatch.sources import files
from tidewatch.sources.tables import events_as_tx, orders_as_tx, table
from tidewatch.sources.topics import as_messages, parse_events
from tidewatch.streaming.sinks import decision_log

AS_OF_MS = 1_706_659_200_000
PUBLISHED = [*MODEL_FEATURES, "fraud_rate_user"]


@query(f"WITH {EV} SELECT DISTINCT ON (user_id) user_id, tx_id, ts_ms, amount_minor FROM ev ORDER BY user_id, ts_ms DESC, tx_id DESC")
def latest_per_user(spark, folder):
    return ops.latest_per_key(events_as_tx(spark, folder).select("user_id", "tx_id", "ts_ms", "amount_minor"), "user_id")


@query(
    f"WITH {EV}, p AS (SELECT *, lag(country) OVER w AS pc, lag(channel) OVER w AS pch, lag(tx_id) OVER w AS seen FROM ev"
    " WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, tx_id)), c AS (SELECT * FROM p WHERE seen IS NULL OR country IS DISTINCT FROM pc"
    " OR channel IS DISTINCT FROM pch) SELECT user_id, country, channel, ts_ms AS valid_from, lead(ts_ms) OVER w AS valid_to,"
    " lead(ts_ms) OVER w IS NULL AS is_current FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, tx_id)"
)
def profile_versions(spark, folder):
    return ops.profile_versions(events_as_tx(spark, folder), "user_id", ["country", "channel"])


@query(
    f"WITH {EV} SELECT tx_id, user_id, '$' || format('{{:,.2f}}', amount_minor / 100.0) AS amount, merchant_id,"
    " strftime(make_timestamp(ts_ms * 1000), '%H:%M:%S') AS time FROM ev ORDER BY ts_ms DESC, tx_id DESC LIMIT 10"
)
def newest_transactions(spark, folder):
    return ops.recent_transactions(events_as_tx(spark, folder))


@query(f"WITH {EV} SELECT tx_id, ts_ms FROM ev ORDER BY ts_ms, tx_id LIMIT 25")
def first_transactions(spark, folder):
    return ops.first_by_time(events_as_tx(spark, folder).select("tx_id", "ts_ms"), 25)


@query(f"WITH {EV} SELECT tx_id, ts_ms FROM ev")
def all_by_time(spark, folder):
    return ops.time_ordered(events_as_tx(spark, folder).select("tx_id", "ts_ms"))


_ONLINE = f"s AS ({sliding('ev')}), o AS (SELECT DISTINCT ON (user_id) * FROM s ORDER BY user_id, ts_ms DESC, tx_id DESC)"


@query(
    f"WITH {EV}, {_ONLINE} SELECT CAST(sum(tx_count_10m) AS BIGINT) AS tx_count_10m, CAST(sum(amt_sum_1h) AS DOUBLE) / 100 AS amount_1h,"
    " count(*) AS users FROM o"
)
def online_totals(spark, folder):
    return ops.totals_over_users(ops.latest_per_key(sliding_features(events_as_tx(spark, folder)), "user_id"))


@query(
    f"WITH {EV}, {_ONLINE} SELECT CAST(sum(tx_count_10m) AS BIGINT) AS tx_count_10m, CAST(sum(amt_sum_1h) AS DOUBLE) / 100 AS amount_1h,"
    " count(*) AS users FROM (SELECT * FROM o ORDER BY user_id LIMIT 100)"
)
def online_totals_of_100_users(spark, folder):
    return ops.totals_over_users(ops.latest_per_key(sliding_features(events_as_tx(spark, folder)), "user_id"), 100)


def decided(spark, folder):
    """Events as decisions with a latency (a binary fraction, so that means are exact): large ones are reviewed."""
    return events_as_tx(spark, folder).select(
        "tx_id",
        "ts_ms",
        F.when(F.col("amount_minor") > 15000, "DECLINE").when(F.col("amount_minor") > 10000, "REVIEW").otherwise(F.lit("APPROVE")).alias("action"),
        (F.col("amount_minor") / 512.0).alias("latency_ms"),
        (F.col("label") == 1).alias("is_error"),
    )


_DECIDED = (
    f"{EV}, d AS (SELECT tx_id, ts_ms, CASE WHEN amount_minor > 15000 THEN 'DECLINE' WHEN amount_minor > 10000 THEN 'REVIEW'"
    " ELSE 'APPROVE' END AS action, amount_minor / CAST(512 AS DOUBLE) AS latency_ms, label = 1 AS is_error FROM ev)"
)


@query(
    f"WITH {_DECIDED}, s AS (SELECT ts_ms // 1000 AS second, count(*) AS tps, avg(latency_ms) AS latency, count(*) FILTER (action <> 'APPROVE')"
    " AS bad FROM d GROUP BY 1) SELECT second, tps, CAST(printf('%.2f', latency) AS DOUBLE) AS latency_ms, CAST(printf('%.2f', CAST(sum(bad) OVER w AS BIGINT) *"
    " CAST(100 AS DOUBLE) / CAST(sum(tps) OVER w AS BIGINT)) AS DOUBLE) AS fraud_rate_pct FROM s WINDOW w AS (ORDER BY second)"
)
def live_kpis(spark, folder):
    return ops.live_kpis(decided(spark, folder))


def _window_sql(size_ms: int, slide_ms: int) -> str:
    copies = size_ms // slide_ms
    return (
        f"WITH {EV}, w AS (SELECT (ts_ms // {slide_ms} - i) * {slide_ms} AS start_ms, amount_minor, user_id FROM ev, range({copies}) r(i))"
        f" SELECT make_timestamp(start_ms * 1000) AS window_start, make_timestamp((start_ms + {size_ms}) * 1000) AS window_end,"
        " count(*) AS tx_count, CAST(sum(amount_minor) AS BIGINT) AS amount_minor, count(DISTINCT user_id) AS users_approx FROM w GROUP BY start_ms"
    )


def shown_windows(windows):
    plain = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")]
    return windows.select(*plain, "tx_count", "amount_minor", "users_approx")


@query(_window_sql(10_000, 10_000))
def tumbling_windows(spark, folder):
    return shown_windows(ops.window_totals(ops.event_time(events_as_tx(spark, folder)), "10 seconds"))


@query(_window_sql(60_000, 10_000))
def hopping_windows(spark, folder):
    return shown_windows(ops.window_totals(ops.event_time(events_as_tx(spark, folder)), "1 minute", "10 seconds"))


@query(
    f"WITH {_DECIDED}, l AS (SELECT ts_ms // 300000 AS w, quantile_disc(latency_ms, 0.99) AS observed FROM d GROUP BY 1),"
    " e AS (SELECT ts_ms // 180000 AS w, avg(CASE WHEN is_error THEN 1.0 ELSE 0.0 END) AS observed FROM d GROUP BY 1)"
    " SELECT make_timestamp(w * 300000000) AS window_start, 'latency p99' AS alert, observed, CAST(25 AS DOUBLE) AS bound FROM l WHERE observed > 25"
    " UNION ALL SELECT make_timestamp(w * 180000000), 'error rate', observed, CAST(0.5 AS DOUBLE) FROM e WHERE observed > 0.5"
)
def guardrail_alerts(spark, folder):
    out = ops.guardrails(decided(spark, folder).withColumn("ts", F.timestamp_millis("ts_ms")), 25.0, 0.5)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    f"WITH {_DECIDED} SELECT CAST(make_timestamp(ts_ms * 1000) AS DATE) AS date, CAST(hour(make_timestamp(ts_ms * 1000)) AS INTEGER) AS hour,"
    " action, 'r7' AS ruleset_version, count(*) AS n FROM d GROUP BY ALL"
)
def decision_log_by_hour(spark, folder):
    path = new_folder(spark, "decisions")
    log = decision_log(decided(spark, folder), "r7", "m1")
    files.gathered(log, "date", "hour").write.partitionBy("date", "hour").parquet(path)
    return spark.read.parquet(path).groupBy("date", "hour", "action", "ruleset_version").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {EV} SELECT CAST(make_timestamp(ts_ms * 1000) AS DATE) AS date, count(*) AS n FROM ev"
    f" WHERE CAST(make_timestamp(ts_ms * 1000) AS DATE) >= CAST(make_timestamp({AS_OF_MS - 10 * DAY_MS} * 1000) AS DATE) GROUP BY 1"
)
def retained_days(spark, folder):
    path = new_folder(spark, "lake")
    files.write_lake(events_as_tx(spark, folder).withColumn("dataset_source", F.lit("synthetic")), path)
    return files.retained(files.read_lake(spark, path), AS_OF_MS, 10).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {ORD}, f AS ({offline('od')}) SELECT user_id, {', '.join(f'round({c}::DOUBLE, 3) AS {c}' for c in PUBLISHED)},"
    " 13 AS features, false AS has_label FROM f"
)
def published_offline_features(spark, folder):
    path = new_folder(spark, "offline")
    files.publish_offline(offline_features(orders_as_tx(spark, folder)), path)
    store = files.as_store_text(spark.read.parquet(path))
    bag = F.col("features")
    return store.select(
        "user_id",
        *[F.round(bag[c].cast("double"), 3).alias(c) for c in PUBLISHED],
        F.size(bag).alias("features"),
        F.map_contains_key(bag, "has_fraud_label").alias("has_label"),
    )


@query(
    f"WITH {EV} SELECT user_id AS key, '{{\"tx_id\":\"' || tx_id || '\",\"user_id\":\"' || user_id || '\",\"amount_minor\":' || amount_minor"
    " || ',\"mcc\":' || CASE WHEN mcc = 'view' THEN 'null' ELSE '\"' || mcc || '\"' END || ',\"ts_ms\":' || ts_ms || '}' AS value FROM ev"
)
def replay_messages(spark, folder):
    tx = events_as_tx(spark, folder).withColumn("mcc", F.nullif("mcc", F.lit("view")))
    return as_messages(tx.select("tx_id", "user_id", "amount_minor", "mcc", "ts_ms"))


@query(f"WITH {EV} SELECT tx_id, user_id, amount_minor, mcc, ts_ms, tx_id IS NULL AS bad FROM ev UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, true FROM ev")
def parsed_messages(spark, folder):
    tx = events_as_tx(spark, folder).select("tx_id", "user_id", "amount_minor", "mcc", "ts_ms")
    good = as_messages(tx).select(F.col("value").alias("raw"))
    cut_off = good.select(F.regexp_replace("raw", r"\}$", "").alias("raw"))  # the last brace is lost
    return parse_events(good.unionByName(cut_off)).select("tx_id", "user_id", "amount_minor", "mcc", "ts_ms", "bad")


_LOG = (
    f"WITH {_DECIDED} SELECT tx_id, ts_ms, action, latency_ms, is_error, 'r7' AS ruleset_version, 'm1' AS model_version, 'p2' AS policy_id,"
    " CAST(make_timestamp(ts_ms * 1000) AS DATE) AS date, CAST(hour(make_timestamp(ts_ms * 1000)) AS INTEGER) AS hour FROM d"
)


@query(_LOG)
def decision_log_rows(spark, folder):
    """Every column of the decision log, from its partitioned table."""
    path = new_folder(spark, "decisions")
    log = decision_log(decided(spark, folder), "r7", "m1", "p2")
    files.gathered(log, "date", "hour").write.partitionBy("date", "hour").parquet(path)
    return spark.read.parquet(path)


@query(f"WITH {EV} SELECT tx_id, user_id, amount_minor, mcc, ts_ms FROM ev UNION ALL SELECT tx_id, user_id, amount_minor, NULL, ts_ms FROM ev WHERE mcc = 'view'")
def lake_of_two_schemas(spark, folder):
    """Older files of a lake lack a column that newer ones have."""
    path = new_folder(spark, "two-schemas")
    tx = events_as_tx(spark, folder).select("tx_id", "user_id", "amount_minor", "mcc", "ts_ms")
    tx.write.parquet(f"{path}/part=new")
    tx.where("mcc = 'view'").drop("mcc").write.parquet(f"{path}/part=old")
    return files.read_lake(spark, path, merge_schema=True).drop("part")


@query(
    f"WITH {EV} SELECT * FROM (VALUES ('mcc', 'retyped', 'string', 'int', false), ('lat', 'removed', 'double', NULL, false),"
    " ('asn', 'added', NULL, 'bigint', true)) t(\"column\", change, old_type, new_type, compatible) WHERE (SELECT count(*) FROM ev) > 0"
)
def schema_evolution(spark, folder):
    old = events_as_tx(spark, folder)
    new = old.drop("lat").withColumns({"mcc": F.length("mcc"), "asn": F.col("ts_ms")})
    return files.schema_changes(spark, old.schema, new.schema)


@query("SELECT l_partkey AS step, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_extendedprice END AS amount, 'C' || l_suppkey AS \"nameOrig\", l_comment FROM (SELECT *, l_returnflag AS l_comment FROM lineitem)")
def raw_csv_folder(spark, folder):
    """Order lines as a folder of CSV files of a raw source, read back with its types; an unreadable amount is null."""
    path = new_folder(spark, "raw")
    lines = table(spark, folder, "lineitem")
    amount = F.when(F.col("l_linenumber") == 1, "n/a").otherwise(F.col("l_extendedprice").cast("string"))
    shaped = lines.select(
        F.col("l_partkey").alias("step"),
        F.lit("PAYMENT").alias("type"),
        amount.alias("amount"),
        F.concat(F.lit("C"), "l_suppkey").alias("nameOrig"),
        F.lit("M1").alias("nameDest"),
        *[F.lit("0").alias(c) for c in ("oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud")],
        F.col("l_returnflag").alias("l_comment"),
    )
    shaped.write.option("header", True).csv(path)
    return files.read_raw(spark, "paysim", path).select("step", "amount", "nameOrig", "l_comment")
