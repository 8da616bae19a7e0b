"""The account graph: who pays whom. Everything is messages along edges, never pairs of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.cells import DAY_MS, cell_of, running_maximum
from tidewatch.session import cut_lineage


def edges(transfers: DataFrame) -> DataFrame:
    """One row per (src, dst) with the number and the sum of transfers."""
    return transfers.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("amount_minor")
    )


def degrees(edge: DataFrame) -> DataFrame:
    """Distinct payees and payers of each account, from one pass over the edges."""
    ends = edge.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("account"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("account"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    ).select("e.*")
    return ends.groupBy("account").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def pagerank(edge: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """PageRank over distinct edges; ranks add up to 1, accounts that pay nobody spread theirs evenly.

    Per round: ranks meet the edges on the payer (one rank per payer, so a payer with very many edges can be split
    by the skew join), shares are summed per payee with a combine before the shuffle. The ranks, one row per account,
    are checkpointed every round, so that no round is computed twice.
    """
    links = cut_lineage(edge.select("src", "dst").distinct())
    nodes = cut_lineage(degrees(links).select("account", "out_degree"))
    n = nodes.count()
    if n == 0:
        return nodes.select("account", F.lit(0.0).alias("pagerank"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for step in range(1, iterations + 1):
        idle = ranks.filter("out_degree = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]  # one number
        shares = (
            links.join(
                ranks.filter("out_degree > 0").select("account", (F.col("rank") / F.col("out_degree")).alias("share")),
                F.col("src") == F.col("account"),
            )
            .groupBy(F.col("dst").alias("account"))
            .agg(F.sum("share").alias("received"))
        )
        base = (1.0 - damping) / n + damping * idle / n
        ranks = nodes.join(shares, "account", "left").select(
            "account", "out_degree", (F.lit(base) + damping * F.coalesce("received", F.lit(0.0))).alias("rank")
        )
        if step < iterations:
            ranks = cut_lineage(ranks)
    return ranks.select("account", F.col("rank").alias("pagerank"))


def neighbour_risk(edge: DataFrame, risk: DataFrame) -> DataFrame:
    """Average and maximum risk two payments away: over all walks account -> x -> y along distinct edges.

    ``risk`` has (account, risk). Each account first sums up its payees (sum, count, maximum), then these three
    numbers travel one edge further. So the work is two passes over the edges, however many walks there are.
    """
    links = edge.select("src", "dst").distinct()
    one = (
        links.join(risk, F.col("dst") == F.col("account"))
        .groupBy("src")
        .agg(F.sum("risk").alias("s"), F.count("risk").alias("c"), F.max("risk").alias("m"))
    )
    near = one.select(F.col("src").alias("mid"), "s", "c", "m")
    return (
        links.join(near, F.col("dst") == F.col("mid"))
        .groupBy(F.col("src").alias("account"))
        .agg(
            F.try_divide(F.sum("s"), F.sum("c").cast("double")).alias("avg_risk_2hop"),
            F.max("m").alias("max_risk_2hop"),
            F.sum("c").alias("walks"),
        )
    )


def payment_chains(transfers: DataFrame, hops: int = 3, window_ms: int = 600_000, cell_ms: int = DAY_MS) -> DataFrame:
    """Transfers that complete a chain of ``hops`` payments, each later than the last, all within the window.

    Columns src, dst, ts_ms, amount_minor plus ``chain_start_ms``: the latest start of such a chain. For every
    transfer, the best chain of one payment more is the latest start among the chains that reached the payer before.
    That is a running maximum along the payer's time line, so a busy account costs its transfers and not the pairs
    of them. Transfers to oneself do not count; an account may occur twice in a chain.
    """
    step = transfers.filter(F.col("src") != F.col("dst")).select("src", "dst", "ts_ms", "amount_minor")
    step = step.withColumn("start", F.col("ts_ms"))
    for hop in range(1, hops):
        both = step.select(
            F.struct("src", "dst", "ts_ms", "amount_minor").alias("row"),
            F.explode(
                F.array(
                    # kind 0 before kind 1: a chain that arrives at the same moment is too late
                    F.struct(F.col("src").alias("account"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("reached")),
                    F.struct(F.col("dst").alias("account"), F.lit(1).alias("kind"), F.col("start").alias("reached")),
                )
            ).alias("e"),
        ).select("e.*", F.col("row.ts_ms").alias("at"), F.when(F.col("e.kind") == 0, F.col("row")).alias("row"))
        both = both.filter("kind = 0 OR reached IS NOT NULL").withColumn("_cell", cell_of(F.col("at"), cell_ms))
        best = running_maximum(both, ["account"], "_cell", [F.col("at"), F.col("kind")], F.col("reached"), "best")
        inside = F.col("row.ts_ms") - F.col("best") <= window_ms
        step = best.filter("kind = 0").select("row.*", F.when(inside, F.col("best")).alias("start"))
        if hop < hops - 1:
            step = cut_lineage(step)
    return step.filter("start IS NOT NULL").withColumnRenamed("start", "chain_start_ms")


# -- rings of accounts -----------------------------------------------------------------------------------------


def hubs(links: DataFrame, value: str = "value", most: int = 1_000) -> DataFrame:
    """``value, degree``: shared values of more than ``most`` accounts, such as a public proxy or a shop's device.

    What they connect says nothing about a ring, so ``rings`` leaves them out; they are listed here instead.
    """
    return links.groupBy(value).agg(F.countDistinct("account").alias("degree")).where(F.col("degree") > most)


def rings(links: DataFrame, most: int = 1_000) -> DataFrame:
    """``account, ring``: accounts that share devices, cards or the like, directly or through others.

    ``links`` has ``account`` and ``value`` (one namespace for all kinds of values; rows with a null are no link). Values
    of more than ``most`` accounts are hubs and link nothing. ``ring`` is the smallest account of the connected set;
    an account that shares nothing is a ring of itself, so that every account of ``links`` has a row.

    Every account points at a smaller or equal one. In a round, each value tells its accounts the smallest grandparent
    among them, and the account, its parent's pointer and its grandparent's are drawn down to that; nothing is paired.
    Chains halve in each round, stars need two. The pointers, a row per account, are checkpointed every round.
    """
    pairs = links.select("account", "value").where("account IS NOT NULL AND value IS NOT NULL").distinct()
    degree = pairs.groupBy("value").agg(F.count(F.lit(1)).alias("degree")).where(f"degree BETWEEN 2 AND {most}")
    linked = cut_lineage(pairs.join(degree.select("value"), "value"))
    accounts = links.where("account IS NOT NULL").select("account").distinct()
    to = cut_lineage(linked.select("account").distinct().withColumn("parent", F.col("account")))
    while True:
        grand = to.join(to.select(F.col("account").alias("parent"), F.col("parent").alias("grand")), "parent").select("account", "parent", "grand")
        heard = linked.join(grand.select("account", "grand"), "account")
        least = heard.groupBy("value").agg(F.min("grand").alias("least"))
        told = linked.join(least, "value").groupBy("account").agg(F.min("least").alias("least"))
        drawn = grand.join(told, "account")
        moves = F.explode(F.array(*[F.struct(F.col(c).alias("account"), F.least("least", "grand").alias("parent")) for c in ("account", "parent", "grand")]))
        new = cut_lineage(drawn.select(moves.alias("m")).select("m.*").groupBy("account").agg(F.min("parent").alias("parent")))
        same = new.join(to.withColumnRenamed("parent", "before"), "account").where("parent <> before").isEmpty()
        to = new
        if same:
            break
    return accounts.join(to, "account", "left").select("account", F.coalesce("parent", "account").alias("ring"))
