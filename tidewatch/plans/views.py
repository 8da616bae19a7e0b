"""SQL text of the adapters in ``sources.tables``, as common table expressions."""

EV = """
ev AS (
  SELECT CAST(event_id AS VARCHAR) AS tx_id, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS ts_ms,
         CAST(round_even(value * 100, 0) AS BIGINT) AS amount_minor, 'USD' AS currency,
         CASE event_type WHEN 'purchase' THEN 'ecommerce' WHEN 'view' THEN 'card_present' WHEN 'click' THEN 'mobile'
              WHEN 'signup' THEN 'transfer' ELSE 'atm' END AS channel,
         'dev' || CAST(k % 20 AS VARCHAR) AS device_fp, 'bin' || CAST(user_id % 10 AS VARCHAR) AS card_bin,
         CAST(k AS VARCHAR) AS merchant_id, event_type AS mcc,
         CASE WHEN k < 60 THEN 'US' WHEN k < 80 THEN 'GB' WHEN k < 95 THEN 'DE' ELSE 'NG' END AS country,
         CAST((k * 7) % 120 - 60 AS DOUBLE) AS lat, CAST((k * 13) % 300 - 150 AS DOUBLE) AS lon,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
)"""

ORD = """
od AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS tx_id, CAST(o_custkey AS VARCHAR) AS user_id, epoch_us(o_orderdate) // 1000 AS ts_ms,
         CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS amount_minor,
         CASE WHEN o_orderpriority LIKE '1%' THEN 'ecommerce' WHEN o_orderpriority LIKE '2%' THEN 'card_present'
              WHEN o_orderpriority LIKE '3%' THEN 'mobile' ELSE 'transfer' END AS channel,
         c_mktsegment AS merchant_id, o_orderpriority AS mcc, CAST(c_nationkey AS VARCHAR) AS country,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
)"""

TR = """
tr AS (
  SELECT o_custkey AS src, l_suppkey AS dst, epoch_us(o_orderdate) // 1000 AS ts_ms,
         CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS amount_minor
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def offline(view: str) -> str:
    """Per-user aggregates over a view, from their definitions: shares are counts over counts, and the mean gap is the
    whole span over the number of gaps."""

    def part(condition: str, name: str) -> str:
        return f"(count(*) FILTER (WHERE {condition})) / count(*)::DOUBLE AS {name}"

    moments = "avg(amount_minor) AS amt_mean_30d, coalesce(stddev_pop(amount_minor), 0) AS amt_std_30d"
    range_ = "max(amount_minor) AS amt_max_30d, min(amount_minor) AS amt_min_30d"
    distinct = [f"len(list(DISTINCT {c})) AS distinct_{n}_30d" for c, n in (("mcc", "mcc"), ("merchant_id", "merchant"), ("country", "country"))]
    channels = [part(f"channel = '{c}'", f"pct_{c}") for c in ("ecommerce", "card_present", "mobile")]
    gap = "coalesce((max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE / nullif(count(*) - 1, 0), 0) AS avg_seconds_between_tx"
    columns = ["user_id", "count(*) AS tx_count_30d", moments, range_, *distinct, part("label = 1", "fraud_rate_user"), *channels, gap]
    return f"SELECT {', '.join(columns)}, max(label) AS has_fraud_label FROM {view} GROUP BY user_id"


#: Decimals to which results are compared where the two engines add in a different order.
DIGITS = {"amt_std_30d": 3}

OFFLINE_COLUMNS = ", ".join(
    f"round({c}, {DIGITS[c]}) AS {c}" if c in DIGITS else c
    for c in (
        "user_id",
        "tx_count_30d",
        "amt_mean_30d",
        "amt_std_30d",
        "amt_max_30d",
        "amt_min_30d",
        "distinct_mcc_30d",
        "distinct_merchant_30d",
        "distinct_country_30d",
        "fraud_rate_user",
        "pct_ecommerce",
        "pct_card_present",
        "pct_mobile",
        "avg_seconds_between_tx",
    )
) + ", CAST(has_fraud_label AS TINYINT) AS has_fraud_label"


def ordered(view: str) -> str:
    """A unique, time-ordered key per row, so that a RANGE frame takes ties one at a time."""
    return f"""
  SELECT *, ts_ms * 1048576 + row_number() OVER (PARTITION BY user_id, ts_ms ORDER BY tx_id) - 1 AS k FROM {view}"""


def frame(horizon_ms: int, partition: str = "user_id") -> str:
    """Trailing frame over the key of ``ordered``: (t - horizon, t], earlier ties included."""
    return f"(PARTITION BY {partition} ORDER BY k RANGE BETWEEN {(horizon_ms - 1) * 1048576 + 524288} PRECEDING AND CURRENT ROW)"


def sliding(view: str) -> str:
    """The online features of each row of a view."""
    return f"""
  SELECT *, count(*) OVER {frame(600_000)} AS tx_count_10m,
         CAST(sum(amount_minor) OVER {frame(3_600_000)} AS BIGINT) AS amt_sum_1h,
         greatest(max(amount_minor) OVER {frame(3_600_000)}, 0) AS max_amt_1h,
         count(DISTINCT mcc) OVER {frame(3_600_000)} AS distinct_mcc_1h,
         coalesce(CAST(printf('%.2f', (ts_ms - lag(ts_ms) OVER (PARTITION BY user_id ORDER BY k)) / 1000.0) AS DOUBLE), -1.0)
           AS seconds_since_last_tx,
         ts_ms AS last_updated_ms
  FROM ({ordered(view)})"""
