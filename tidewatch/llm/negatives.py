"""Hard-negative mining by a vertical scan (BOND): columns in the anchor's order, rows dropped by their bounds.

Vectors are whole numbers (floor of 256 times each component) and scores are integer inner products, so results are
exact. A task meets a block of anchors with a strip of rows and reads the rows of a label column by column. For each
anchor the columns come by descending magnitude of its own components. What the columns not yet read may add to any
row of the label lies between two sums, from the least and largest value of each column; so every row has bounds, and a
row whose bounds fit none of the anchor's windows, or not its best rows so far, leaves the bitmap of candidates. The
scores of those left at the end are whole, and fill the windows.

The scan runs twice: over rows of the anchor's label for its positives (one window without ends), and over rows of
other labels for the negatives of each positive (a window of scores relative to the positive's).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.graph import stored

#: Anchors in a block, rows in a strip.
ANCHORS, STRIP = 512, 8_192
#: Columns that are read before bounds are taken first; then twice as many each time.
STEP = 8
#: Most tasks that pairs of block and strip are dealt to.
TASKS = 50_000
#: Whole numbers up to here are exact in double precision.
EXACT = 2.0**53


def scan(anchor: np.ndarray, columns: np.ndarray, least: np.ndarray, most: np.ndarray, windows: list[tuple], best: list[list], names, keep: int):
    """Fills ``best`` (per window, the ``keep`` best (-score, name) so far, in order) from some rows.

    ``columns``: a row per component, with the least and largest value of each; ``windows``: (lowest, highest) score.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = anchor[order] * least[order], anchor[order] * most[order]
    low, high = np.minimum(*ends), np.maximum(*ends)
    rest_low, rest_high = ([*np.cumsum(c[::-1])[::-1], 0] for c in (low, high))
    # a row that is to come into any window needs this score, and must not need more than that one
    floor = min(max(low, -some[-1][0]) if len(some) == keep else low for (low, _), some in zip(windows, best))
    roof = max(high for _, high in windows)
    inner = max(low for low, _ in windows), min(high for _, high in windows)  # what is in here is in every window
    alive = np.arange(columns.shape[1])  # the bitmap of candidates, as the places of its ones
    score, at, step = np.zeros(len(alive), columns.dtype), 0, STEP
    while at < len(order):
        now = order[at : at + step]
        at, step = at + step, 2 * step
        rows = columns[now] if len(alive) == columns.shape[1] else columns[now][:, alive]
        score = score + anchor[now] @ rows
        left = min(at, len(order))
        lower, upper = score + rest_low[left], score + rest_high[left]
        if len(alive) > keep:
            sure = lower[(lower >= inner[0]) & (upper <= inner[1])]
            if len(sure) >= keep:
                floor = max(floor, np.partition(sure, len(sure) - keep)[len(sure) - keep])
        fits = (upper >= floor) & (lower <= roof)
        alive, score = alive[fits], score[fits]
        if not len(alive):
            return
    for k, (lowest, highest) in enumerate(windows):
        inside = np.flatnonzero((score >= lowest) & (score <= highest))
        if len(inside) > keep:
            inside = inside[score[inside] >= np.sort(score[inside])[-keep]]
        new = [(-int(score[i]), int(names[alive[i]])) for i in inside]
        if new:
            best[k] = sorted([*best[k], *new])[:keep]


class Strip:
    """A block of anchors that takes the rows of a strip, label by label."""

    def __init__(self, keep: int, own: bool):
        self.keep, self.own, self.anchors = keep, own, []

    def add_anchors(self, batch: pa.RecordBatch) -> None:
        names, versions, labels, scores = (batch.column(c).to_pylist() for c in ("vec_id", "version", "label", "scores"))
        for *who, scores, vector in zip(names, versions, labels, scores, vectors_of(batch)):
            # whole scores s with 30 p <= 100 s <= 90 p; any score where there is no positive yet
            windows = [(-np.inf, np.inf)] if self.own else [(-(-3 * p // 10), 9 * p // 10) for p in scores]
            self.anchors.append((*who, vector, windows, [[] for _ in windows]))

    def add_rows(self, batch: pa.RecordBatch) -> None:
        names, versions, labels = (batch.column(c).to_numpy() for c in ("vec_id", "version", "label"))
        vectors = vectors_of(batch)
        for label in np.unique(labels):  # rows come by label, and those of a label are near each other
            mine = np.flatnonzero(labels == label)
            self.scan_label(label, names[mine], versions[mine], np.ascontiguousarray(vectors[mine].T))

    def scan_label(self, label: int, names: np.ndarray, versions: np.ndarray, columns: np.ndarray) -> None:
        anchors = [a for a in self.anchors if (a[2] == label) == self.own]
        if not anchors:
            return
        size = [np.abs(m.astype(np.float64)).max(initial=1) for m in (columns, np.array([a[3] for a in anchors]))]
        kind = np.float64 if size[0] * size[1] * max(1, len(columns)) < EXACT else object  # else Python's integers
        columns = columns.astype(kind)
        least, most = columns.min(axis=1), columns.max(axis=1)
        for name, version, _, vector, windows, best in anchors:
            others = slice(None)
            if self.own and ((names == name) & (versions == version)).any():
                others = np.flatnonzero((names != name) | (versions != version))
            scan(vector.astype(kind), columns[:, others], least, most, windows, best, names[others], self.keep)

    def batch(self) -> pa.RecordBatch:
        out = [
            (name, version, slot, found, -minus)
            for name, version, *_, best in self.anchors
            for slot, some in enumerate(best)
            for minus, found in some
        ]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        columns = zip(*out) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=_FOUND)


_FOUND = ["anchor_id", "version", "slot", "found", "score"]
_PLACE = ["dim", "part", "block", "strip"]


def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of rows of one length, a row each, from the batch's buffer."""
    return batch.column("codes").flatten().to_numpy().reshape(batch.num_rows, -1)


def _met(keep: int, own: bool):
    """Reads rows sorted by pair of block and strip, anchors first; one pair is held at a time."""

    def run(batches):
        now, strip = None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in [*_PLACE, "side"]]).T
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if a == b:
                    continue
                *place, side = keys[a].tolist()
                if place != now:
                    if strip:
                        yield strip.batch()
                    now, strip = place, Strip(keep, own)
                (strip.add_rows if side else strip.add_anchors)(batch.slice(a, b - a))
        if strip:
            yield strip.batch()

    return run


def found_rows(anchors: DataFrame, rows: DataFrame, keep: int, own: bool) -> DataFrame:
    """``anchor_id, version, slot, found, score, rank``: per window of each anchor its ``keep`` best rows, from rank 1.

    ``anchors`` (with ``scores``) meet all ``rows`` of their length and, if ``own``, of their label; otherwise all
    rows of other labels. Anchors are dealt to blocks and rows to strips by hash, so a label with very many rows is
    many strips. A pair of block and strip is one unit of work, and gives at most ``keep`` rows a window.
    """
    part = F.col("label").cast("long") if own else F.lit(0).cast("long")
    anchors, rows = anchors.withColumn("part", part), rows.withColumn("part", part)

    def count(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("dim", "part").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias(name))

    sizes = stored(count(anchors, ANCHORS, "blocks").join(count(rows, STRIP, "strips"), ["dim", "part"]), "sizes")
    pairs = sizes.agg(F.sum(F.col("blocks").cast("long") * F.col("strips"))).first()[0] or 1
    sizes = sizes.select(F.struct("dim", "part").alias("key"), "blocks", "strips")

    def dealt(df: DataFrame, side: int, own_place: str, own_count: str, other_place: str, other_count: str) -> DataFrame:
        placed = df.join(sizes, F.struct("dim", "part") == F.col("key"))
        placed = placed.withColumn(own_place, F.pmod(F.xxhash64("vec_id", "version"), own_count).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col(other_count) - 1))
        return placed.withColumn(other_place, every).select(*_PLACE, F.lit(side).alias("side"), "vec_id", "version", "label", "codes", "scores")

    both = dealt(anchors, 0, "block", "blocks", "strip", "strips").union(
        dealt(rows.withColumn("scores", F.lit(None).cast("array<long>")), 1, "strip", "strips", "block", "blocks")
    )
    met = both.repartition(min(pairs, TASKS), *_PLACE).sortWithinPartitions(*_PLACE, "side", "label")
    found = met.mapInArrow(_met(keep, own), "anchor_id long, version long, slot int, found long, score long")
    best = Window.partitionBy("anchor_id", "version", "slot").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)


def hard_negatives(vectors: DataFrame, anchor: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from rows of ``vectors``
    (``vec_id``, ``embedding``, ``label``; other columns are ignored).

    Components become ``floor(256 * x)``, a score is the integer inner product with the anchor, and higher scores come
    first, ties by smaller vec_id. Anchors are the rows of the condition ``anchor``; an anchor's positives are its first
    ``positives`` other rows of its label, and for each of them the first ``negatives`` rows of other labels whose score
    is between 30 and 90 percent of the positive's are returned (all, if fewer; a negative score has none between).

    Rows with a null vec_id or label, a null vector, or a null or non-finite component take no part. Only vectors of
    equal length have a score. Rows that repeat vec_id, label and vector are one; rows that share a vec_id alone are
    each other's rows like any. A score must fit in a long. An empty table gives an empty one.
    """
    whole = F.coalesce(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("long"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").where(whole)
    codes = F.transform("embedding", lambda x: F.floor(x * 256))
    rows = rows.select("vec_id", "label", codes.alias("codes")).dropDuplicates()
    rows = stored(rows.select("*", F.xxhash64("label", "codes").alias("version"), F.size("codes").alias("dim")), "vectors")
    anchors = rows.where(anchor)

    chosen = found_rows(anchors.withColumn("scores", F.lit(None).cast("array<long>")), rows, positives, own=True)
    chosen = stored(
        chosen.select("anchor_id", "version", (F.col("rank") - 1).alias("slot"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")),
        "positives",
    )
    by_anchor = chosen.groupBy("anchor_id", "version").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score")))["positive_score"].alias("scores"))
    asking = anchors.join(by_anchor.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "version"])
    found = found_rows(asking, rows, negatives, own=False)
    return found.join(chosen, ["anchor_id", "version", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
