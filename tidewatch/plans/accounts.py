"""The account graph and the attack detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import detect, graph
from tidewatch.operators.cells import DAY_MS, HOUR_MS
from tidewatch.operators.history import spikes
from tidewatch.plans import query
from tidewatch.plans.features import TRAVEL_SQL
from tidewatch.plans.views import EV, ORD, TR, frame, ordered
from tidewatch.sources.tables import events_as_tx, orders_as_tx, table, transfers

_LINKS = f"{TR}, l AS (SELECT DISTINCT src, dst FROM tr)"
_NODES = (
    _LINKS
    + ", a AS (SELECT src AS account, 1 AS o, 0 AS i FROM l UNION ALL SELECT dst, 0, 1 FROM l),"
    " n AS (SELECT account, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM a GROUP BY account)"
)


@query(f"WITH {_NODES} SELECT * FROM n")
def account_degrees(spark, folder):
    return graph.degrees(graph.edges(transfers(spark, folder)))


@query(f"WITH {TR} SELECT src, dst, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS amount_minor FROM tr GROUP BY ALL")
def payment_edges(spark, folder):
    return graph.edges(transfers(spark, folder))


ROUNDS = 20


def _pagerank_sql() -> str:
    steps = ["r0 AS (SELECT account, out_degree, 1.0 / count(*) OVER () AS r FROM n)"]
    for i in range(1, ROUNDS + 1):
        steps.append(
            f"s{i} AS (SELECT dst AS account, sum(r / out_degree) AS got FROM l JOIN r{i - 1} ON src = account GROUP BY dst),"
            f" r{i} AS (SELECT n.account, n.out_degree, (0.15 + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE out_degree = 0))"
            f" / (SELECT count(*) FROM n) + 0.85 * coalesce(got, 0) AS r FROM n LEFT JOIN s{i} USING (account))"
        )
    return f"WITH {_NODES}, {', '.join(steps)} SELECT account, round(CAST(r AS DOUBLE), 9) AS pagerank FROM r{ROUNDS}"


@query(_pagerank_sql().replace("1.0 / count(*)", "CAST(1 AS DOUBLE) / count(*)"))
def account_pagerank(spark, folder):
    out = graph.pagerank(graph.edges(transfers(spark, folder)), ROUNDS)
    return out.withColumn("pagerank", F.round("pagerank", 9))


@query(
    f"WITH {_LINKS}, k AS (SELECT s_suppkey AS account, round_even(abs(s_acctbal) * 100, 0) AS risk FROM supplier),"
    " w AS (SELECT x.src AS account, risk FROM l x JOIN l y ON x.dst = y.src JOIN k ON y.dst = k.account)"
    " SELECT account, avg(risk) AS avg_risk_2hop, max(risk) AS max_risk_2hop, count(*) AS walks FROM w GROUP BY account"
)
def two_hop_risk(spark, folder):
    # whole numbers, so that sums do not depend on their order
    risk = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("account"), F.rint(F.abs("s_acctbal") * F.lit(100.0)).alias("risk")
    )
    return graph.neighbour_risk(graph.edges(transfers(spark, folder)), risk)


CHAIN_MS = 5 * DAY_MS


@query(
    f"WITH {TR}, e AS (SELECT *, row_number() OVER () AS id FROM tr WHERE src <> dst)"
    " SELECT c.src, c.dst, c.ts_ms, c.amount_minor, max(a.ts_ms) AS chain_start_ms FROM e a JOIN e b ON a.dst = b.src AND b.ts_ms > a.ts_ms"
    f" JOIN e c ON b.dst = c.src AND c.ts_ms > b.ts_ms WHERE c.ts_ms - a.ts_ms <= {CHAIN_MS} GROUP BY c.id, c.src, c.dst, c.ts_ms, c.amount_minor"
)
def payment_chains(spark, folder):
    # orders have day-grained times, so the window is five days instead of ten minutes
    return graph.payment_chains(transfers(spark, folder), 3, CHAIN_MS)


@query(f"WITH {EV} SELECT tx_id, count(*) OVER {frame(2 * HOUR_MS)} >= 3 AS velocity_attack FROM ({ordered('ev')})")
def velocity_attacks(spark, folder):
    return detect.velocity_attack(events_as_tx(spark, folder), "user_id", 3, 2 * HOUR_MS).select("tx_id", "velocity_attack")


@query(f"WITH {EV} SELECT tx_id, coalesce(kmh > 900 AND km >= 100, false) AS impossible_travel FROM ({TRAVEL_SQL})")
def impossible_travel(spark, folder):
    return detect.impossible_travel(events_as_tx(spark, folder)).select("tx_id", "impossible_travel")


@query(f"WITH {EV} SELECT device_fp, count(DISTINCT user_id) AS users FROM ev GROUP BY device_fp HAVING count(DISTINCT user_id) >= 50")
def device_spray(spark, folder):
    return detect.device_spray(events_as_tx(spark, folder), 50)


@query(
    f"WITH {ORD}, p AS (SELECT tx_id, amount_minor, lag(amount_minor) OVER (PARTITION BY user_id ORDER BY ts_ms, tx_id) AS prev FROM od)"
    " SELECT tx_id, coalesce(prev > 0 AND amount_minor >= 10 * prev, false) AS fat_finger FROM p"
)
def fat_finger(spark, folder):
    return detect.fat_finger(orders_as_tx(spark, folder)).select("tx_id", "fat_finger")


@query(
    f"WITH {EV}, s AS (SELECT ts_ms // 600000 AS slot, count(*) AS tx_count FROM ev GROUP BY 1),"
    " u AS (SELECT *, avg(tx_count) OVER (ORDER BY slot RANGE BETWEEN 36 PRECEDING AND 1 PRECEDING) AS usual FROM s)"
    " SELECT slot * 600000 AS slot_start_ms, tx_count, round(usual, 9) AS usual, coalesce(tx_count >= 3 * usual, false) AS spike FROM u"
)
def traffic_spikes(spark, folder):
    return spikes(events_as_tx(spark, folder), 600_000, 36, 3.0).withColumn("usual", F.round("usual", 9))
