"""Canonical mapping, hashing and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.scalars import (
    clock_text,
    hmac_pads,
    hmac_sha256,
    money_text,
    number_or_zero,
    to_cents,
    ulid,
)
from tidewatch.operators import canonical as ops
from tidewatch.plans import query
from tidewatch.plans.views import EV, ORD, TR
from tidewatch.schema import CANONICAL
from tidewatch.sources.files import union_sources
from tidewatch.sources.tables import events_as_tx, orders_as_tx, table, transfers

#: The key of the registered queries; a user brings their own.
KEY = "development key"
_INNER, _OUTER = (pad.hex() for pad in hmac_pads(KEY))


def sql_hmac(text: str) -> str:
    return f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode({text}))))"


DIGITS_SQL = "'0123456789ABCDEFGHJKMNPQRSTVWXYZ'"


def sql_ulid(ms: str, *key: str) -> str:
    """A whole id: ten digits of time and sixteen of the row key's hash."""
    text = " || '|' || ".join(f"coalesce(CAST({part} AS VARCHAR), '\\N')" for part in key)
    halves = [f"CAST('0x' || substr(md5({text}), {at}, 10) AS BIGINT)" for at in (1, 11)]
    numbers = [(ms, 45), *[(half, 35) for half in halves]]
    return " || ".join(f"substr({DIGITS_SQL}, CAST((({n}) >> {shift}) & 31 AS INTEGER) + 1, 1)" for n, top in numbers for shift in range(top, -1, -5))


@query(f"WITH {EV} SELECT tx_id, {sql_hmac('user_id')} AS user_id, {sql_hmac('coalesce(NULL, device_fp)')} AS device_fp FROM ev")
def hashed_users(spark, folder):
    tx = events_as_tx(spark, folder)
    return tx.select("tx_id", hmac_sha256(F.col("user_id"), KEY).alias("user_id"), hmac_sha256(F.col("device_fp"), KEY).alias("device_fp"))


@query(f"WITH {EV} SELECT tx_id, {sql_ulid('ts_ms', 'tx_id')} AS id, {sql_ulid('ts_ms', 'tx_id', 'NULL')} AS id_of_two FROM ev")
def ulid_ids(spark, folder):
    tx = events_as_tx(spark, folder)
    none = F.lit(None).cast("string")
    return tx.select("tx_id", ulid(F.col("ts_ms"), F.col("tx_id")).alias("id"), ulid(F.col("ts_ms"), F.col("tx_id"), none).alias("id_of_two"))


@query(f"WITH {EV} SELECT count(*) AS ids, count(*) AS distinct_ids FROM ev")
def ulid_uniqueness(spark, folder):
    ids = events_as_tx(spark, folder).select(ulid(F.col("ts_ms"), F.col("tx_id")).alias("id"))
    return ids.agg(F.count("id").alias("ids"), F.countDistinct("id").alias("distinct_ids"))


#: Every column but the bag of attributes, whose values the queries show one by one.
COMMON = [name for name in CANONICAL.names if name != "attributes"]


def shown(canonical, texts: dict[str, str], numbers: dict[str, str]):
    """All columns, the sorted names of the attributes, and each attribute as text or (to six decimals) as a number."""
    bag = F.col("attributes")
    # the numbers by one loop over their names: an expression for each would be more code than the JVM compiles
    rounded = F.transform(F.array(*[F.lit(key) for key in numbers.values()]), lambda key: F.round(F.try_element_at(bag, key).cast("double"), 6))
    told = canonical.withColumn("_rounded", rounded) if numbers else canonical
    return told.select(
        *COMMON,
        F.array_join(F.sort_array(F.map_keys(bag)), ",").alias("attribute_names"),
        *[bag[key].alias(name) for name, key in texts.items()],
        *[F.col("_rounded")[at].alias(name) for at, name in enumerate(numbers)],
    )


def names_sql(*names: str) -> str:
    return f"'{','.join(sorted(names))}' AS attribute_names"


NOTHING = "CAST(NULL AS VARCHAR)"


def ieee_cis_inputs(spark, folder):
    """Orders in the shape of card transactions, and an identity row for the orders that have lines."""
    orders = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    tx = orders.select(
        F.col("o_orderkey").alias("TransactionID"),
        F.floor(F.unix_millis(F.col("o_orderdate").cast("timestamp")) / 1000).alias("TransactionDT"),
        F.col("o_totalprice").alias("TransactionAmt"),
        F.col("o_orderpriority").alias("ProductCD"),
        F.col("o_custkey").alias("card1"),
        F.col("c_acctbal").alias("card2"),
        F.col("c_nationkey").cast("double").alias("addr1"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("P_emaildomain"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).cast("int").alias("isFraud"),
    )
    identity = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("TransactionID")).agg(
        F.max("l_returnflag").alias("DeviceInfo"), F.nullif(F.min("l_linestatus"), F.lit("F")).alias("id_31")
    )
    return tx, identity


@query(
    "WITH i AS (SELECT l_orderkey, max(l_returnflag) AS d, nullif(min(l_linestatus), 'F') AS b FROM lineitem GROUP BY 1),"
    " j AS (SELECT o.*, c.*, i.d, i.b FROM orders o LEFT JOIN customer c ON o_custkey = c_custkey LEFT JOIN i ON l_orderkey = o_orderkey)"
    f" SELECT {sql_ulid('(epoch_us(o_orderdate) // 1000000 + 1512086400) * 1000', chr(39) + 'ieee_cis' + chr(39), 'o_orderkey')} AS tx_id,"
    f" {NOTHING} AS ip_hash, {NOTHING} AS ip_country, {names_sql('addr1_zip_prefix')},"
    f" {sql_hmac(chr(39) + 'card1=' + chr(39) + ' || CAST(o_custkey AS VARCHAR)')} AS user_id, 'ieee_cis' AS dataset_source,"
    " 1 AS schema_version, (epoch_us(o_orderdate) // 1000000 + 1512086400) * 1000 AS ts_ms,"
    " CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS amount_minor, 'USD' AS currency, 'ecommerce' AS channel,"
    f" {sql_hmac('coalesce(d, ' + chr(39) * 2 + ') || ' + chr(39) + '|' + chr(39) + ' || coalesce(b, ' + chr(39) * 2 + ')')} AS device_fp,"
    f" CASE WHEN c_mktsegment <> 'BUILDING' THEN {sql_hmac('c_mktsegment')} END AS email_domain_hash,"
    " CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR) AS card_bin, 'vesta' AS merchant_id, o_orderpriority AS mcc,"
    " CAST(NULL AS VARCHAR) AS country, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon,"
    " CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS TINYINT) AS label,"
    " CAST(c_nationkey AS VARCHAR) AS addr1_zip_prefix FROM j"
)
def canonical_ieee_cis(spark, folder):
    tx, identity = ieee_cis_inputs(spark, folder)
    out = ops.canonicalize_ieee_cis(tx, identity, KEY)
    return shown(out, {"addr1_zip_prefix": "addr1_zip_prefix"}, {})


def ulb_input(spark, folder):
    """Events in the shape of anonymous card rows, numbered by event_id."""
    number = F.col("event_id").cast("double")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("row_index"),
        number.alias("Time"),
        *[(F.col("value") + n).alias(f"V{n}") for n in range(1, 29)],
        F.col("value").alias("Amount"),
        F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 0).cast("int").alias("Class"),
    )


ULB_NAMES = ["Time", "Amount", *[f"V{n}" for n in range(1, 29)]]


@query(
    f"SELECT {sql_ulid('(event_id + 1700000000) * 1000', chr(39) + 'ulb' + chr(39), 'event_id')} AS tx_id,"
    f" {NOTHING} AS ip_hash, {NOTHING} AS ip_country, {names_sql(*ULB_NAMES)},"
    f" {sql_hmac(chr(39) + 'ulb-row-' + chr(39) + ' || CAST(event_id AS VARCHAR)')} AS user_id, 'ulb' AS dataset_source,"
    " 1 AS schema_version, (event_id + 1700000000) * 1000 AS ts_ms, CAST(round_even(value * 100, 0) AS BIGINT) AS amount_minor,"
    " 'EUR' AS currency, 'card_present' AS channel, CAST(NULL AS VARCHAR) AS device_fp, CAST(NULL AS VARCHAR) AS email_domain_hash,"
    " CAST((event_id % 9 + 1) * 100000 + (event_id * 37) % 99999 AS VARCHAR) AS card_bin, CAST(NULL AS VARCHAR) AS merchant_id,"
    " CAST(NULL AS VARCHAR) AS mcc, CAST(NULL AS VARCHAR) AS country, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon,"
    " CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS TINYINT) AS label, event_id::DOUBLE AS seconds, round(value, 6) AS money,"
    + ", ".join(f" round(value + {n}, 6) AS v_{n}" for n in range(1, 29)) + " FROM events"
)
def canonical_ulb(spark, folder):
    out = ops.canonicalize_ulb(ulb_input(spark, folder), KEY, 1_700_000_000)
    return shown(out, {}, {"seconds": "Time", "money": "Amount", **{f"v_{n}": f"V{n}" for n in range(1, 29)}})


def sparkov_input(spark, folder):
    """Orders in the shape of simulated card rows; some places are not numbers."""
    orders = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    return orders.select(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("trans_date_trans_time"),
        (F.lit(4_000_000_000_000_000) + F.col("o_custkey") * 7_919_000_003).cast("string").alias("cc_num"),
        F.col("c_mktsegment").alias("merchant"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("category"),
        F.col("o_totalprice").alias("amt"),
        F.col("c_name").alias("first"),
        F.when(F.col("c_nationkey") == 3, "n/a").otherwise((F.col("c_nationkey") * 1.5).cast("string")).alias("lat"),
        (F.col("c_nationkey") * -2).cast("string").alias("long"),
        F.col("o_orderkey").cast("string").alias("trans_num"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("is_fraud"),
    )


_CC = "CAST(4000000000000000 + o_custkey * 7919000003 AS VARCHAR)"


@query(
    "WITH j AS (SELECT *, " + _CC + " AS cc FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"
    f" SELECT {sql_ulid('epoch_us(o_orderdate) // 1000000 * 1000', chr(39) + 'sparkov' + chr(39), 'o_orderkey')} AS tx_id,"
    f" {NOTHING} AS ip_hash, 'US' AS ip_country, {names_sql('trans_date_trans_time', 'merchant', 'category', 'amt', 'lat', 'long', 'trans_num')},"
    " strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, c_mktsegment AS shop, nullif(o_orderpriority, '5-LOW') AS kind, round(o_totalprice, 6) AS money,"
    " CASE WHEN c_nationkey = 3 THEN 'n/a' ELSE CAST(c_nationkey * CAST(1.5 AS DOUBLE) AS VARCHAR) END AS north, CAST(c_nationkey * -2 AS VARCHAR) AS east,"
    f" {sql_hmac(chr(39) + 'cc=' + chr(39) + ' || cc')} AS user_id, 'sparkov' AS dataset_source, 1 AS schema_version,"
    " epoch_us(o_orderdate) // 1000000 * 1000 AS ts_ms, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS amount_minor,"
    f" 'USD' AS currency, 'card_present' AS channel, {sql_hmac('cc || ' + chr(39) + '|' + chr(39) + ' || c_name')} AS device_fp,"
    " CAST(NULL AS VARCHAR) AS email_domain_hash, substr(cc, 1, 6) AS card_bin,"
    f" {sql_hmac(chr(39) + 'merch=' + chr(39) + ' || c_mktsegment')} AS merchant_id,"
    " CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS mcc, 'US' AS country,"
    " CASE WHEN c_nationkey <> 3 THEN c_nationkey * CAST(1.5 AS DOUBLE) END AS lat, CAST(c_nationkey * -2 AS DOUBLE) AS lon,"
    " CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS TINYINT) AS label, CAST(o_orderkey AS VARCHAR) AS number"
    " FROM j"
)
def canonical_sparkov(spark, folder):
    out = ops.canonicalize_sparkov(sparkov_input(spark, folder), KEY, ["trans_num"])
    texts = {"at": "trans_date_trans_time", "shop": "merchant", "kind": "category", "north": "lat", "east": "long", "number": "trans_num"}
    return shown(out, texts, {"money": "amt"})


_TYPES = ["PAYMENT", "TRANSFER", "CASH_OUT", "DEBIT", "CASH_IN", "PAY_SALARY", "GIFT"]


def paysim_input(spark, folder):
    """Order lines in the shape of mobile-money transfers, with some negative amounts and unreadable balances."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.col("l_partkey").alias("step"),
        F.element_at(F.array(*[F.lit(t) for t in _TYPES]), F.col("l_linenumber")).alias("type"),
        (F.col("l_extendedprice") - 5000).alias("amount"),
        F.concat(F.lit("C"), F.col("o_custkey")).alias("nameOrig"),
        F.when(F.col("l_returnflag") == "N", "?").otherwise(F.col("l_quantity").cast("string")).alias("oldbalanceOrg"),
        (F.col("l_quantity") + F.col("l_linenumber")).cast("string").alias("newbalanceOrig"),
        F.concat(F.lit("M"), F.col("l_suppkey")).alias("nameDest"),
        F.lit("0.0").alias("oldbalanceDest"),
        F.lit("").alias("newbalanceDest"),
        F.when(F.col("l_linestatus") == "F", 1).cast("int").alias("isFraud"),
        F.lit(None).cast("int").alias("isFlaggedFraud"),
    )


_PAYER = sql_hmac("'orig=C' || CAST(o_custkey AS VARCHAR)")
_PAYEE = sql_hmac("'dest=M' || CAST(l_suppkey AS VARCHAR)")
_PAYSIM_ID = sql_ulid("(l_partkey * 3600 + 1514764800) * 1000", "'paysim'", "l_partkey", "'C' || o_custkey", "'M' || l_suppkey")
_PAYSIM_NAMES = ["orig_hash", "dest_hash", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "balance_delta", "isFlaggedFraud"]


@query(
    f"SELECT {_PAYSIM_ID} AS tx_id, {NOTHING} AS ip_hash, {NOTHING} AS ip_country, {names_sql(*_PAYSIM_NAMES)}, {_PAYER} AS payer, {_PAYEE} AS payee,"
    " CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS payer_before, l_quantity + l_linenumber AS payer_after, 0.0::DOUBLE AS payee_before,"
    " CAST(NULL AS DOUBLE) AS payee_after,"
    f" {_PAYER} AS user_id, 'paysim' AS dataset_source, 1 AS schema_version,"
    " (l_partkey * 3600 + 1514764800) * 1000 AS ts_ms, greatest(CAST(round_even((l_extendedprice - 5000) * 100, 0) AS BIGINT), 0) AS amount_minor,"
    " 'USD' AS currency, CASE l_linenumber WHEN 1 THEN 'transfer' WHEN 2 THEN 'transfer' WHEN 3 THEN 'atm' WHEN 4 THEN 'card_present'"
    " WHEN 5 THEN 'atm' WHEN 6 THEN 'transfer' ELSE 'other' END AS channel, CAST(NULL AS VARCHAR) AS device_fp,"
    " CAST(NULL AS VARCHAR) AS email_domain_hash, CAST(NULL AS VARCHAR) AS card_bin,"
    f" {_PAYEE} AS merchant_id,"
    " CASE l_linenumber WHEN 1 THEN 'PAYMENT' WHEN 2 THEN 'TRANSFER' WHEN 3 THEN 'CASH_OUT' WHEN 4 THEN 'DEBIT' WHEN 5 THEN 'CASH_IN'"
    " WHEN 6 THEN 'PAY_SALARY' ELSE 'GIFT' END AS mcc, CAST(NULL AS VARCHAR) AS country, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon,"
    " CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS TINYINT) AS label,"
    " CASE WHEN l_returnflag <> 'N' THEN CAST(l_linenumber AS DOUBLE) END AS balance_delta, '0' AS flagged"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
)
def canonical_paysim(spark, folder):
    out = ops.canonicalize_paysim(paysim_input(spark, folder), KEY, ["step", "nameOrig", "nameDest"])
    texts = {"payer": "orig_hash", "payee": "dest_hash", "flagged": "isFlaggedFraud"}
    balances = {"payer_before": "oldbalanceOrg", "payer_after": "newbalanceOrig", "payee_before": "oldbalanceDest", "payee_after": "newbalanceDest"}
    return shown(out, texts, {**balances, "balance_delta": "balance_delta"})


@query(
    f"WITH {EV}, {ORD} SELECT source, count(*) AS n, count(device_fp) AS with_device, CAST(sum(amount_minor) AS BIGINT) AS amount_minor FROM ("
    " SELECT 'events' AS source, device_fp, amount_minor FROM ev UNION ALL SELECT 'orders', NULL, amount_minor FROM od) GROUP BY source"
)
def union_of_sources(spark, folder):
    frames = [
        events_as_tx(spark, folder).withColumn("source", F.lit("events")),
        orders_as_tx(spark, folder).withColumn("source", F.lit("orders")),
    ]
    return (
        union_sources(frames)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), F.count("device_fp").alias("with_device"), F.sum("amount_minor").alias("amount_minor"))
    )


@query(
    f"WITH {TR} SELECT ts_ms, amount_minor, strftime(make_timestamp(ts_ms * 1000), '%H:%M:%S') AS clock,"
    " '$' || format('{:,.2f}', amount_minor / 100.0) AS money FROM tr"
)
def money_and_clock(spark, folder):
    return transfers(spark, folder).select(
        "ts_ms", "amount_minor", clock_text(F.col("ts_ms")).alias("clock"), money_text(F.col("amount_minor")).alias("money")
    )


@query(
    "SELECT l_orderkey, l_linenumber, CAST(round_even(l_discount * l_extendedprice * 100, 0) AS BIGINT) AS cents,"
    " coalesce(TRY_CAST(l_returnflag AS DOUBLE), 0) + l_tax AS parsed FROM lineitem"
)
def cents_and_parsing(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        to_cents(F.col("l_discount") * F.col("l_extendedprice")).alias("cents"),
        (number_or_zero(F.col("l_returnflag")) + F.col("l_tax")).alias("parsed"),
    )
