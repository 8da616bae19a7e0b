"""Mixing of sources to target weights: budgets down a tree of domains, languages and sources, then seeded epochs.

The token budget goes down the tree. At each node it is shared among the children by their weights; a child that can't
use its share (its documents, each taken ``epochs`` times at most, have fewer tokens) gets what it can use, and the
rest goes to its siblings by their weights. Only when all children of a node are full does the node itself fall short
and leave tokens to its own siblings: shortages stay as deep in the tree as they can. With the children of a node in
the order of capacity over weight the full ones come first, so running sums over siblings say who is full.

A leaf takes whole epochs, then a token prefix of one more: its documents in the order of a hash of seed, epoch and
doc_id, up to and with the document that reaches the budget. That order is cut into ``CELLS`` ranges of the hash;
whole ranges are in or out by their sums, and only the range that holds the end of the prefix is ordered.

All amounts are whole numbers of 64 bits; weights are whole and at most 1,000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.graph import stored

LEVELS = ["domain", "lang", "source"]
#: Hex digits of the hash that name a range, so 65,536 ranges.
DIGITS = 4
OTHER_WEIGHT = 1


def weight_of(column: str, weights: dict[str, int]) -> Column:
    """The weight that a name has in the dictionary, else ``OTHER_WEIGHT``."""
    found = F.lit(OTHER_WEIGHT)
    for name, weight in weights.items():
        found = F.when(F.col(column) == name, weight).otherwise(found)
    return found.cast("long")


def shared_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (``budget`` of the parent, ``weight``, ``most``) with each child's own ``budget`` instead."""
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = siblings.orderBy(F.col("most") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = children.where("weight > 0").select(
        "*",
        F.coalesce(F.sum("most").over(before), F.lit(0)).alias("_m"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("_w"),
        F.sum("weight").over(siblings).alias("_all"),
    )
    full = ranked.withColumn("_full", F.expr("most * (_all - _w) <= (budget - _m) * weight"))
    told = full.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("_full"), F.col("most"))).over(siblings), F.lit(0)).alias("_used"),
        F.coalesce(F.sum(F.when(F.col("_full"), F.col("weight"))).over(siblings), F.lit(0)).alias("_served"),
    )
    return told.withColumn(
        "budget", F.expr("CASE WHEN _full THEN most ELSE (budget - _used) * weight DIV (_all - _served) END")
    ).drop("_m", "_w", "_all", "_full", "_used", "_served")


def leaf_budgets(leaves: DataFrame, share: float, epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """``leaves`` (``LEVELS``, ``tokens``) with ``budget``: ``share`` of all tokens, handed down the tree."""
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(share)).cast("long").alias("budget"))
    nodes = total.where("budget IS NOT NULL")
    for depth, name in enumerate(LEVELS):
        parent, own = LEVELS[:depth], LEVELS[: depth + 1]
        children = leaves.groupBy(*own).agg((F.sum("tokens") * epochs).alias("most"))
        children = children.withColumn("weight", weight_of(name, weights.get(name, {})))
        children = children.join(nodes, parent) if parent else children.join(F.broadcast(nodes))  # one row
        nodes = shared_out(children, parent, name).select(*own, "budget")
    return leaves.join(nodes, LEVELS, "left").withColumn("budget", F.coalesce("budget", F.lit(0)))


def mixed(
    docs: DataFrame, domain: Column, share: float, epochs: int, weights: dict[str, dict[str, int]], seed: int = 7
) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``, ``lang``, ``source``): ``doc_id, domain, lang, source, n_tokens, copies``.

    ``copies`` is how often the mixture takes the document: once per whole epoch of its leaf, and once more in the
    prefix of the last. ``domain`` is an expression over the columns of ``docs``; tokens are words of the text. The
    budget is ``share`` of all tokens, ``epochs`` the most often that a document is taken.

    Null domains, languages and sources are ''. A null text has no tokens: it is taken with whole epochs, or when the
    prefix goes on past it. Rows of one doc_id stand beside each other in an epoch, shorter texts first. A budget
    beyond all capacity takes everything ``epochs`` times. An empty table gives an empty one. A document that ends a
    prefix may go over its leaf's budget by less than its own tokens.
    """
    words = F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    named = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(LEVELS, (domain, F.col("lang"), F.col("source")))]
    rows = stored(docs.select("doc_id", *named, F.size(words).cast("long").alias("n_tokens")), "sized")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, share, epochs, weights).select(
        *LEVELS,
        F.when(F.col("tokens") > 0, F.expr("budget DIV tokens")).otherwise(F.lit(0)).cast("long").alias("epoch"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(F.lit(0)).alias("rest"),
    )
    plan = stored(plan, "budgets")
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # joined on the leaf as one struct: the join may split a leaf with very many rows, since what follows is dealt out anew
    leaf = F.struct(*LEVELS).alias("leaf")
    leafed = rows.select("*", leaf)
    placed = leafed.join(plan.select(leaf, "epoch", "rest"), "leaf").withColumn("place", place).withColumn("cell", F.substring("place", 1, DIGITS))
    cells = placed.groupBy(*LEVELS, "rest", "cell").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*LEVELS).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        cells.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        .where("before < rest")
        .groupBy(*LEVELS)
        .agg(F.max(F.struct("cell", "before")).alias("end"))
    )
    cut = stored(plan.join(ends, LEVELS, "left").select(*LEVELS, "epoch", "rest", F.col("end.cell").alias("end"), F.col("end.before").alias("before")), "cuts")
    dealt = leafed.join(cut.select(leaf, "epoch", "rest", "end", "before"), "leaf").withColumn("place", place).withColumn("cell", F.substring("place", 1, DIGITS))
    out = ["doc_id", *LEVELS, "n_tokens"]
    inner = Window.partitionBy(*LEVELS).orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))
    last = dealt.where("cell = end").select(*out, (F.col("epoch") + (reached < F.col("rest")).cast("long")).alias("copies"))
    others = dealt.where("cell <> end OR end IS NULL").select(
        *out, (F.col("epoch") + F.coalesce((F.col("cell") < F.col("end")).cast("long"), F.lit(0))).alias("copies")
    )
    return last.union(others)


def taken(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a mixture takes, as often as it takes them; all rows of a doc_id alike.

    For tables with one row per doc_id, which is what a pipeline keeps after its dedup; a null doc_id is one, too.
    """
    chosen = copies.where("copies > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").cast("int").alias("_copies"))
    return docs.join(chosen, docs["doc_id"].eqNullSafe(F.col("_id"))).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")
    ).drop("_copy")
