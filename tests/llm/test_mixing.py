import random

import duckdb
from pyspark.sql import functions as F

from check_oracle import rows_of
from tidewatch.llm import mixing, queries


def budgets(tree, weights, budget, path=()):
    """Water-filling by rounds: full children drop out and the rest share again."""
    if isinstance(tree, int):
        return {path: budget}
    cap = lambda t: t if isinstance(t, int) else sum(map(cap, t.values()))
    left, open_, share = budget, dict(tree), {}
    while open_:
        total = sum(weights[name] for name in open_)
        full = [n for n in open_ if cap(tree[n]) * total <= left * weights[n]]
        if not full:
            share |= {n: left * weights[n] // total for n in open_}
            break
        first = min(full, key=lambda n: (cap(tree[n]) / weights[n], n))
        share[first] = cap(tree[first])
        left -= share[first]
        del open_[first]
    return {k: v for n in tree for k, v in budgets(tree[n], weights, share[n], (*path, n)).items()}


def test_budgets_go_down_the_tree(spark):
    rng = random.Random(6)
    for _ in range(4):
        tree = {d: {l: {s: rng.choice([5, 40, 900]) for s in rng.sample("stuvw", 3)} for l in ("en", "de")} for d in ("x", "y", "z")}
        weights = {n: rng.randrange(1, 9) for n in ("x", "y", "z", "en", "de", *"stuvw")}
        rows = [(d, l, s, n) for d, ls in tree.items() for l, ss in ls.items() for s, n in ss.items()]
        leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
        twice = {d: {l: {s: 2 * n for s, n in ss.items()} for l, ss in ls.items()} for d, ls in tree.items()}
        share = rng.choice([0.3, 0.9, 1.6, 2.5])
        given = {level: weights for level in mixing.LEVELS}
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(leaves, share, 2, given).collect()}
        assert got == budgets(twice, weights, int(sum(r[3] for r in rows) * share))


def test_prefixes_hold_their_budgets_and_agree_with_sql(spark, folder, odd, none):
    rng = random.Random(7)
    rows = [
        (k, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["en", "en", "de", None]), rng.choice(["src0", "src0", "src4", "src9", None]))
        for k in range(600)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    result = con.execute(queries.mixing_sql())
    columns = [d[0] for d in result.description]
    got = queries.op8_mixing(spark, folder)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, result.fetchall())
    copies = mixing.mixed(df, F.expr(queries.DOMAIN), 0.8, 2, queries.WEIGHTS)
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    used = sum(r.n_tokens * r.copies for r in copies.collect())
    assert abs(used - 0.8 * total) < 40 * 12 + 12 and max(r.copies for r in copies.collect()) <= 2
    out = mixing.taken(df, copies)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in copies.collect())
    strange = mixing.mixed(odd, F.expr(queries.DOMAIN), 0.5, 2, queries.WEIGHTS)
    assert strange.count() == odd.count() and mixing.taken(odd, strange).columns == odd.columns
    assert mixing.mixed(none, F.expr(queries.DOMAIN), 0.5, 2, queries.WEIGHTS).count() == 0
    all_in = mixing.mixed(df, F.expr(queries.DOMAIN), 5.0, 2, queries.WEIGHTS)
    assert {r.copies for r in all_in.where("n_tokens > 0").collect()} == {2}
