"""Embedding near-dedup: int8 tile products with rigorous error bounds, full precision only where they leave doubt.

Vectors of one label are dealt into strips, and each pair of strips is a task. A unit vector x is held as
``scale * codes`` with int8 codes, and r = |x - scale * codes| is known. For two vectors the product of the codes
misses the cosine by at most ``|a||s| + |r||b| + |r||s|`` (a, b: the coded vectors, r, s: what the codes leave out).
A pair is linked if even the least possible cosine is high enough, dropped if even the largest is not, and computed
in double precision from the given components otherwise. Codes are small integers, so their products are exact in
single precision up to 1,040 dimensions, and in double precision beyond.

Equal vectors of a label are one class before any product. A task returns counts and a spanning forest, never pairs,
so a group that holds a third of all rows costs no more than its tiles. The number of products grows with the square
of the distinct vectors of a label: every pair is looked at, as the method asks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.graph import apart, components, stored

#: Distinct vectors of a label in one strip; a task holds two strips.
STRIP = 4_096
ROWS = 512
EXACT_IN_SINGLE = 1_040
#: Far above the rounding of sums in double precision, far below the error of the codes.
SLACK = 1e-9


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of the rows: int8 codes, scale, length of the coded vector, length of what the codes leave out."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    held = codes * scale[:, None]
    return codes, scale, np.linalg.norm(held, axis=1), np.linalg.norm(unit - held, axis=1)


def links_between(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each row of ``x`` and each row of ``y`` have a cosine of ``threshold`` or more."""
    (cx, sx, hx, rx), (cy, sy, hy, ry) = coded(x), coded(y)
    kind = np.float32 if x.shape[1] <= EXACT_IN_SINGLE else np.float64
    right = cy.astype(kind).T
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    found = np.zeros((len(x), len(y)), bool)
    for a in range(0, len(x), ROWS):
        b = min(a + ROWS, len(x))
        near = (cx[a:b].astype(kind) @ right) * sx[a:b, None] * sy
        error = hx[a:b, None] * ry + rx[a:b, None] * hy + rx[a:b, None] * ry + SLACK
        found[a:b] = near - error >= threshold
        p, q = np.nonzero(~found[a:b] & (near + error >= threshold))
        for k in range(0, len(p), 16_384):
            i, j = p[k : k + 16_384] + a, q[k : k + 16_384]
            found[i, j] = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j]) >= threshold
    return found


def forest(links: np.ndarray, same: bool) -> np.ndarray:
    """For each row, then each column, the first member of its component (itself without a link)."""
    n, m = links.shape
    if same:
        root, todo = np.arange(n), set(np.flatnonzero(links.any(axis=1)).tolist())
    else:
        root, todo = np.arange(n + m), set(np.flatnonzero(links.any(axis=1)).tolist())
    new = np.ones(m, bool)  # columns that no walk has reached yet
    while todo:
        start = min(todo)
        walk = [start]
        todo.discard(start)
        while walk:
            k = walk.pop()
            root[k] = start
            for c in np.flatnonzero(links[k] & new).tolist():
                new[c] = False
                if same:
                    root[c] = start
                    if c in todo:
                        todo.discard(c)
                        walk.append(c)
                else:
                    root[n + c] = start
                    more = [r for r in np.flatnonzero(links[:, c]).tolist() if r in todo]
                    todo.difference_update(more)
                    walk.extend(more)
    return root


def _strips(threshold: float):
    """Reads rows sorted by pair of strips; one pair is held at a time."""

    def solve(rows):
        names, side = np.array([r[0] for r in rows], object), np.array([r[1] for r in rows])
        many, x = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.float64)
        if side.min() < 0:
            links = links_between(x, x, threshold)
            np.fill_diagonal(links, False)
            count, root = links @ many, forest(links, True)
        elif side.min() == side.max():
            return None
        else:
            a, b = side == 0, side == 1
            links = links_between(x[a], x[b], threshold)
            names = np.concatenate([names[a], names[b]])
            count, root = np.concatenate([links @ many[b], links.T @ many[a]]), forest(links, False)
        hit = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays(
            [pa.array(names[hit], pa.string()), pa.array(count[hit], pa.int64()), pa.array(names[root[hit]], pa.string())],
            names=["class", "n", "root"],
        )

    def run(batches):
        now, rows = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for block, *row in zip(zip(*columns[:4]), *columns[4:]):
                if block != now:
                    if rows and (out := solve(rows)) is not None:
                        yield out
                    now, rows = block, []
                rows.append(row)
        if rows and (out := solve(rows)) is not None:
            yield out

    return run


def embedding_components(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Per row of ``vectors`` (``vec_id``, ``embedding``, ``label``; other columns are ignored): ``vec_id, n_links,
    component_id, kept``.

    Vectors of equal, non-null labels and equal length link when their cosine is ``threshold`` or more.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest vec_id that links reach, and
    ``kept`` says whether that is the row's own.

    A vector that is null, empty or zero, or holds a null, NaN or infinite component, links with nothing; so does a
    null label. Repeated rows are copies that link with each other. A null vec_id is never the smallest while there
    is another; ``kept`` is true for it only if it is alone. An empty table gives an empty one.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    fit = (
        F.col("label").isNotNull()
        & F.coalesce(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda c: c != 0), F.lit(False))
    )
    name = F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(seed), "label", "embedding")) for seed in (1, 2)])
    rows = rows.withColumn("class", F.when(fit, name))
    classes = stored(
        rows.where(fit)
        .groupBy("class")
        .agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("many"), F.min("vec_id").alias("first_vec"))
        .withColumn("dim", F.size("embedding")),
        "vectors",
    )
    strips = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(STRIP)).cast("int").alias("strips"))
    placed = classes.join(strips, ["label", "dim"]).withColumn("strip", F.pmod(F.xxhash64("class"), "strips").cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1))).select(
        "label",
        "dim",
        F.least("strip", "other").alias("i"),
        F.greatest("strip", "other").alias("j"),
        "class",
        F.expr("CASE WHEN strip = other THEN -1 WHEN strip < other THEN 0 ELSE 1 END").alias("side"),
        "many",
        "embedding",
    )
    block = ["label", "dim", "i", "j"]
    found = stored(
        spread.repartition(*block).sortWithinPartitions(*block).mapInArrow(_strips(threshold), "class string, n long, root string"),
        "tiles",
    )
    roots = components(found.select("class", "root"))
    counts = found.groupBy("class").agg(F.sum("n").alias("n"))
    known = (
        classes.select("class", "many", "first_vec")
        .join(counts, "class", "left")
        .join(roots.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    least = known.groupBy("root").agg(F.min("first_vec").alias("component_id"))
    told = known.join(apart(least, "root"), F.struct(F.col("root").alias("k")) == F.col("key")).select("class", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "class").where("class IS NOT NULL").join(told, "class").select("vec_id", "n_links", "component_id")
    alone = rows.where("class IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
