import math
import random

import numpy as np
import pytest

from tidewatch.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, keep=10, every=100):
    seen = set()
    for name, vector, label in rows:
        if name is None or label is None or vector is None or any(c is None or not math.isfinite(c) for c in vector):
            continue
        seen.add((name, label, tuple(math.floor(256 * c) for c in vector)))
    out = []
    for anchor in seen:
        if anchor[0] % every:
            continue
        scored = [
            (-sum(a * b for a, b in zip(anchor[2], r[2])), r[0], r[1]) for r in seen if r != anchor and len(r[2]) == len(anchor[2])
        ]
        own = sorted(s for s in scored if s[2] == anchor[1])[:positives]
        for minus, positive, _ in own:
            p = -minus
            fit = sorted((m, name) for m, name, label in scored if label != anchor[1] and 30 * p <= -100 * m <= 90 * p)
            out += [(anchor[0], positive, k + 1, name, p, -m) for k, (m, name) in enumerate(fit[:keep])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def small(monkeypatch):
    for name, value in (("ANCHORS", 3), ("STRIP", 40), ("STEP", 2)):
        monkeypatch.setattr(negatives, name, value)


def clustered(n, seed, dim=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = []
    for k in range(n):
        label = int(rng.integers(5)) if rng.random() > 0.4 else 0  # one label has two fifths of the rows
        vector = centres[label if rng.random() < 0.7 else int(rng.integers(5))] + rng.normal(size=dim) * 0.4
        rows.append((k, (vector / np.linalg.norm(vector)).round(2).tolist(), label))  # rounded: ties are common
    return rows


def test_against_brute_force_in_many_blocks(spark, small):
    rows = clustered(420, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(negatives.hard_negatives(df, "vec_id % 20 = 0")) == brute(rows, every=20)
    assert got(negatives.hard_negatives(df, "vec_id % 50 = 0", 2, 3)) == brute(rows, 2, 3, every=50)


def test_odd_rows(spark, small):
    rng = random.Random(2)
    rows = clustered(130, 3, dim=4)
    rows += rows[:7]  # repeated in full, an anchor among them
    rows += [(100, [0.5, -0.5, 0.5, 0.1], 1), (3, [1.0, 1.0, 1.0, 1.0], 2)]  # other rows of known ids
    rows += [(None, [1.0, 0.0, 0.0, 0.0], 1), (200, None, 1), (300, [1.0, None, 0.0, 0.0], 1), (400, [float("nan")] * 4, 1)]
    rows += [(500, [float("inf"), 0.0, 0.0, 0.0], 1), (600, [0.1] * 4, None), (700, [], 1), (701, [], 2), (800, [0.0] * 4, 3)]
    rows += [(900, [1.0, 2.0], 1), (901, [1.0, 1.5], 1), (902, [0.5, 0.5], 2)] + [(k, [1.0, 1.0], 4) for k in range(1000, 1030)]
    rows += [(2000, [3.0e6, -1.0e6, 2.0e6, 1.0e6, 1.0], 1), (2001, [3.0e6, -2.0e6, 2.0e6, 1.0e6, 2.0], 1), (2002, [1.0e6, 1.0e6, 1.0e6, 1.0e6, 3.0], 2)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS codes", "2 AS version", "3 AS block", "4 AS `a.b`")
    assert got(negatives.hard_negatives(df)) == brute(rows)


def test_no_rows(spark):
    assert got(negatives.hard_negatives(spark.createDataFrame([], SCHEMA))) == []
    assert got(negatives.hard_negatives(spark.createDataFrame([(100, [1.0], 1)], SCHEMA))) == []


def test_bounds_drop_rows_before_all_columns_are_read():
    rng = np.random.default_rng(5)
    columns = np.floor(rng.normal(size=(64, 2000)) * 20)
    columns[:, :20] += 60  # a few rows are near the anchor
    anchor, best = np.full(64, 50.0), [[]]
    anchor[:8] = 500  # these columns come first and settle most
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            value = super().__getitem__(key)
            if isinstance(key, tuple):
                read.append(value.size)
            return value

    negatives.scan(anchor, columns.view(Counted), columns.min(axis=1), columns.max(axis=1), [(-np.inf, np.inf)], best, np.arange(2000), 5)
    scores = anchor @ columns
    assert [n for _, n in best[0]] == np.lexsort((np.arange(2000), -scores))[:5].tolist()
    assert sum(read) < columns.size / 2
