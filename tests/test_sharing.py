"""Rings, set sketches, ordered encoding, stored features and the model in the scoring path."""

import random

import pytest
from pyspark.sql import functions as F

from tests.brute import START
from tidewatch.operators import graph, heavy, model, rules, sketches
from tidewatch.operators.cells import DAY_MS
from tidewatch.sources import store


def components(links, most):
    """account -> smallest account of its set, by union-find."""
    users = {}
    for a, v in links:
        if a is not None and v is not None:
            users.setdefault(v, set()).add(a)
    root = {a: a for a, _ in links if a is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for some in users.values():
        if len(some) <= most:
            least = min(map(find, some))
            for a in some:
                root[find(a)] = min(least, find(a))
                least = min(least, find(a))
    for a in root:
        root[a] = min(find(b) for b in root if find(b) == find(a))
    return {a: find(a) for a in root}


def ring_of(spark, links, most=1000):
    df = spark.createDataFrame(links, "account string, value string")
    return {r["account"]: r["ring"] for r in graph.rings(df, most).collect()}


def test_rings_of_random_links(spark):
    rng = random.Random(3)
    links = [(f"a{rng.randrange(90):02d}", f"v{rng.randrange(70)}") for _ in range(110)]
    links += [("a00", None), (None, "v1"), ("zz", None), ("a00", "v0"), ("a00", "v0")]
    assert ring_of(spark, links) == components(links, 1000)


def test_star_chain_and_hub(spark):
    chain = [(f"c{k:03d}", f"x{k + d}") for k in range(120) for d in (0, 1)]
    star = [(f"s{k:02d}", "device") for k in range(60)]
    hub = [(f"h{k:02d}", "proxy") for k in range(80)] + [("h00", "own"), ("h01", "own")]
    got = ring_of(spark, chain + star + hub, most=70)
    assert {got[a] for a, _ in chain} == {"c000"} and {got[a] for a, _ in star} == {"s00"}
    assert got["h01"] == "h00" and got["h05"] == "h05"
    hubs = graph.hubs(spark.createDataFrame(hub + star, "account string, value string"), most=70).collect()
    assert [tuple(r) for r in hubs] == [("proxy", 80)]
    assert graph.rings(spark.createDataFrame([], "account string, value string")).count() == 0


def test_large_sets_stay_within_their_error(spark):
    df = spark.range(60_000).selectExpr("CAST(id AS STRING) AS user_id", "id < 40000 AS a", "id >= 20000 AS b", "1 AS k")
    sets = sketches.user_sets(df, ["k"], parts={"a": F.col("a"), "b": F.col("b")})
    got = sets.select(sketches.size_of(F.col("a")).alias("a"), sketches.shared("a", "b").alias("both"), sketches.only_in("a", "b").alias("rest")).first()
    assert abs(got["a"] - 40_000) < 0.06 * 40_000
    assert abs(got["both"] - 20_000) < 0.06 * 60_000 and abs(got["rest"] - 20_000) < 0.06 * 60_000


def test_users_that_two_devices_share(spark):
    rows = [("d1", u) for u in "abcd"] + [("d2", u) for u in "cdef"] + [("d3", None)]
    sets = sketches.user_sets(spark.createDataFrame(rows, "device string, user_id string"), ["device"])
    pairs = spark.createDataFrame([("d1", "d2"), ("d1", "d3")], "one string, other string")
    assert sorted(tuple(r) for r in sketches.overlaps(sets, pairs, "device").collect()) == [("d1", "d2", 2), ("d1", "d3", 0)]


def test_a_row_is_encoded_without_its_own_label(spark):
    rng = random.Random(5)
    rows = [(f"t{k:04d}", START + rng.randrange(50) * DAY_MS // 7, rng.choice(["a", "a", "b", None]), rng.choice([0, 1, None])) for k in range(600)]
    rows.append(("lost", None, "a", 1))
    df = spark.createDataFrame(rows, "tx_id string, ts_ms long, kind string, target int")
    for order, place in (("ts_ms", lambda r: (r[1], r[0])), (None, None)):
        out = {r["tx_id"]: r["encoded"] for r in model.ordered_target_encoding(df, "kind", order=order).collect()}
        assert len(out) == len(rows)
        if order is None:
            hashes = dict(df.select("tx_id", F.xxhash64(F.lit(42), "tx_id")).collect())
            place = lambda r: (hashes[r[0]], r[0])
        for r in rows[::7]:
            if order and r[1] is None:
                assert out[r[0]] == 0.5
                continue
            seen = [s[3] for s in rows if s[2] == r[2] and s[3] is not None and (order is None or s[1] is not None) and place(s) < place(r)]
            assert out[r[0]] == pytest.approx((sum(seen) + 10) / (len(seen) + 20))


def test_a_random_label_gives_no_lift(spark):
    df = spark.range(20_000).selectExpr("CAST(id AS STRING) AS tx_id", "id % 4000 AS kind", "CAST(rand(7) < 0.3 AS INT) AS target").persist()
    fair = model.ordered_target_encoding(df, "kind", prior=0.3)
    leaky = model.encode(df, "kind", model.target_encoding(df, "kind"), "encoded", "encoded")
    lift = lambda d: abs(d.agg(F.corr("encoded", "target")).first()[0])
    assert lift(fair) < 0.03 < 0.3 < lift(leaky)
    df.unpersist()


def test_the_store_is_read_in_place(spark, folder):
    features = spark.range(500).selectExpr("CAST(id AS STRING) AS user_id", "id AS tx_count_30d", "id * 2 AS amount")
    store.write_bucketed(features, "store_in_place", folder, buckets=8)
    tx = spark.range(2000).selectExpr("CAST(id AS STRING) AS tx_id", "CASE WHEN id % 3 = 0 THEN '7' ELSE CAST(id % 700 AS STRING) END AS user_id")
    out = store.with_stored(tx, store.read_bucketed(spark, "store_in_place"), ["tx_count_30d"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "SelectedBucketsCount: 8 out of 8" in plan
    below = plan[plan.index("FileScan") - 400 : plan.index("FileScan")]
    assert "Exchange" not in below.split("FileScan")[0].splitlines()[-1]
    assert out.where("tx_count_30d IS NULL").count() == tx.join(features, "user_id", "left_anti").count() > 0
    assert out.where("CAST(tx_count_30d AS STRING) <> user_id").count() == 0 and out.count() == 2000
    spark.sql("DROP TABLE store_in_place")


def test_a_model_in_the_scoring_path(spark):
    names = ["amt_max_30d", "pct_mobile"]
    users = spark.range(400).selectExpr(
        "CAST(id AS STRING) AS user_id", "id % 100 AS amt_max_30d", "(id % 7) / 7.0 AS pct_mobile", "CAST(id % 100 > 60 AS INT) AS target", "100 AS tx_count_30d"
    )
    trees = model.train_boosted_trees(users, names, trees=5, depth=3)
    tx = spark.createDataFrame(
        [("t1", "80", START, 10, "US"), ("t2", "20", START, 10, "US"), ("t3", "nobody", START, 10, "US"), ("t4", None, None, 10, "US")],
        "tx_id string, user_id string, ts_ms long, amount_minor long, country string",
    )
    out = {r["tx_id"]: r for r in rules.score_batch(tx, offline=users.drop("target"), model=trees, model_features=names).collect()}
    assert out["t1"]["score"] > 0.8 and out["t1"]["action"] != "APPROVE" and "Suspiciously high score" in out["t1"]["rules_triggered"] + ["Suspiciously high score"] * (out["t1"]["action"] == "DECLINE")
    assert out["t2"]["score"] < 0.2 and out["t2"]["action"] == "APPROVE"
    assert out["t3"]["score"] == out["t4"]["score"] < 0.5  # no features count as zeros
    with pytest.raises(ValueError):
        rules.score_batch(tx, score=F.lit(0.1), model=trees)


def test_the_model_sees_a_user_and_count_of_calls_once(spark, monkeypatch):
    seen = []
    count_as_score = lambda model, df, names: seen.append(df.count()) or df.withColumn("score", F.col("tx_count_30d") / 1000)
    monkeypatch.setattr(rules, "score_with", count_as_score)
    users = spark.createDataFrame([("u", 100), ("w", 300)], "user_id string, tx_count_30d int")
    day = 86_400_000
    rows = [(f"apart{i}", "u", START + i * day, 0.101) for i in range(50)]
    rows += [(f"close{i}", "w", START + i * 60_000, (301 + i) / 1000) for i in range(3)]
    rows += [(f"nobody{i}", "nobody", START + i * day, 0.001) for i in range(2)]
    rows += [(f"null{i}", None, START, 0.0) for i in range(5)] + [(f"blank{i}", " ", START, 0.0) for i in range(2)] + [("late", "u", None, 0.1)]
    tx = spark.createDataFrame([(t, u, ms, 10, "US") for t, u, ms, _ in rows], "tx_id string, user_id string, ts_ms long, amount_minor long, country string")
    out = rules.score_batch(tx, offline=users, model="model").collect()
    assert sorted((r["tx_id"], r["user_id"] or "", r["ts_ms"] or 0, r["score"]) for r in out) == sorted((t, u or "", ms or 0, s) for t, u, ms, s in rows)
    assert seen == [8]  # u without a time and once, w three times, nobody, null, blank; and not 63 calls
    brought = rules.score_batch(tx.withColumn("amt_mean_30d", F.lit(1.0)), offline=users, model="model")
    assert brought.count() == seen[1] == len(rows)  # features of its own: each transaction is scored


def test_heavy_values_are_all_named_and_never_underrated(spark):
    rng = random.Random(8)
    values = [rng.choice([None, "hot", "hot", "warm"]) if rng.random() < 0.2 else f"v{rng.randrange(30_000)}" for _ in range(40_000)]
    values += [f"edge{k}" for k in range(3) for _ in range(41)]  # just above the bound
    df = spark.createDataFrame([(v,) for v in values], "v string")
    out = {r["value"]: (r["n"], r["estimate"]) for r in heavy.heavy_hitters(df, "v", 0.001).collect()}
    counts = {v: values.count(v) for v in ("hot", "warm", "edge0", "edge1", "edge2")}
    bound = 0.001 * sum(v is not None for v in values)
    assert out.keys() == {v for v, n in counts.items() if n >= bound}
    assert all(out[v][0] == counts[v] <= out[v][1] <= counts[v] + 0.002 * len(values) for v in out)
    assert heavy.heavy_hitters(df.where("v IS NULL"), "v").count() == 0
