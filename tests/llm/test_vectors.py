import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import vectors


def brute(rows, threshold):
    def fit(r):
        return r[2] is not None and r[1] and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1])

    links = {k: set() for k in range(len(rows))}
    for a, x in enumerate(rows):
        for b, y in enumerate(rows):
            if a != b and fit(x) and fit(y) and x[2] == y[2] and len(x[1]) == len(y[1]):
                u, v = np.float64(x[1]), np.float64(y[1])
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                    links[a].add(b)
    out = []
    for a in links:
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        names = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(names) if names else None
        out.append((rows[a][0], len(links[a]), least, rows[a][0] == least))
    return sorted(out, key=repr)


def test_links_are_those_of_full_precision():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 24))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.1, 0.38, 0.4, 0.42, 1)]).astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = unit @ unit.T
    near = np.abs(exact - 0.93) < 1e-12
    assert (((exact >= 0.93) == vectors.links_between(x, x, 0.93)) | near).all()
    codes, scale, held, rest = vectors.coded(x)
    bound = held[:, None] * rest + rest[:, None] * held + rest[:, None] * rest + 1e-12
    assert (np.abs((codes.astype(float) @ codes.T) * scale[:, None] * scale - exact) <= bound).all()


def test_forest_joins_what_links_join():
    rng = np.random.default_rng(2)
    for _ in range(30):
        links = rng.random((14, 14)) < 0.06
        links |= links.T
        np.fill_diagonal(links, False)
        root, reach = vectors.forest(links, True), np.linalg.matrix_power(links.astype(int) + np.eye(14, dtype=int), 14) > 0
        assert ((root[:, None] == root) == reach).all()
        two = rng.random((6, 8)) < 0.15
        root = vectors.forest(two, False)
        whole = np.block([[np.eye(6, dtype=int), two], [two.T, np.eye(8, dtype=int)]])
        assert ((root[:, None] == root) == (np.linalg.matrix_power(whole, 14) > 0)).all()


def test_rows_agree_with_brute_force_in_any_strips(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = []
    for k in range(90):
        v = base[k % 12] + rng.normal(size=8) * (0 if k % 5 == 0 else 0.25)
        rows.append((k, np.float32(v).tolist(), int(k % 2) if k % 11 else None))
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 8, 1), (203, [1.0, None] + [1.0] * 6, 1), (204, [float("nan")] * 8, 1)]
    rows += [(205, [float("inf")] * 8, 1), (206, [1.0, 2.0], 1), (207, [2.0, 4.0], 1), (5, rows[5][1], rows[5][2]), (None, rows[7][1], rows[7][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("root", F.lit(1)).withColumn("class", F.lit("x"))
    want = brute(rows, 0.93)
    for strip in (4_096, 7):
        monkeypatch.setattr(vectors, "STRIP", strip)
        assert sorted((tuple(r) for r in vectors.embedding_components(df).collect()), key=repr) == want
    assert vectors.embedding_components(df.where("false")).count() == 0
