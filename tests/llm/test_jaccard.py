import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import graph, jaccard, sieve


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) >= size:
        return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
    return {tuple(words)} if words else set()


def brute(rows, size, per_cent):
    sets = [shingles(t, size) for _, t in rows]
    links = {k: set() for k in range(len(rows))}
    for a, b in combinations(links, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
            links[a].add(b)
            links[b].add(a)
    out = []
    for a in links:
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        names = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[a][0], len(sets[a]), min(names) if names else None))
    return sorted(out, key=repr)


def near_copies(rng, n=160):
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.7:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                if words:
                    words[rng.randrange(len(words))] = "%x" % rng.randrange(40)
            if rng.random() < 0.3:
                words = words[rng.randrange(3) :]
        else:
            words = ["%x" % rng.randrange(4000) for _ in range(rng.choice([1, 2, 4, 9, 12, 30, 200]))]
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("per_cent", [80, 90])
def test_linked_sets_share_a_key(per_cent):
    rng = np.random.default_rng(per_cent)
    for n in [*range(1, 40), 60, 100, 257, 1000]:
        for _ in range(30):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            largest = int(n * 100 / per_cent) - n
            drop, add = int(rng.integers(0, max(1, n * (100 - per_cent) // 100 + 1))), int(rng.integers(0, largest + 1))
            y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
            if len(y) and jaccard.linked(x, y, per_cent) and len(np.setxor1d(x, y)):
                for share in (0, 0.3, 0.9):
                    often = rng.random(jaccard.SLOTS) < share
                    keys = [jaccard.candidate_keys(s, per_cent, often) for s in (x, y)]
                    assert np.intersect1d(*keys).size


@pytest.mark.parametrize("per_cent", [80, 90])
def test_what_linked_sets_agree_on_is_enough(per_cent):
    rng = np.random.default_rng(per_cent + 1)
    for n in [*range(1, 60, 3), 100, 150, 257, 600, 1500]:
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, max(1, n * (100 - per_cent) // 100 + 1)))
            add = int(rng.integers(0, max(1, (n - drop) * 100 // per_cent - n + 1)))
            y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
            if len(y) and jaccard.linked(x, y, per_cent) and len(np.setxor1d(x, y)):
                for share in (0, 0.3, 0.9):
                    often = rng.random(jaccard.SLOTS) < share
                    (a, wa), (b, _) = (jaccard.weighted_keys(s, per_cent, often) for s in (x, y))
                    assert int(wa[np.isin(a, b)].sum()) >= jaccard.ENOUGH


def test_agreements_of_pairs_are_counted():
    key = np.array([1, 1, 2, 2, 2, 3, 4, 4, 4, 5, 5], np.uint64)
    node = np.array([7, 9, 9, 7, 8, 7, 9, 7, 9, 6, 7], np.uint64)
    weight = np.array([2, 2, 2, 2, 2, 2, 2, 2, 2, 6, 6], np.uint64)
    got = jaccard.added_up(*jaccard.met(key, jaccard.weighted(node, weight)))
    assert list(zip(*(x.tolist() for x in got))) == [(6, 7, 6), (7, 8, 2), (7, 9, 6), (8, 9, 2)]
    many = np.arange(jaccard.FEW + 1, dtype=np.uint64)
    a, b, w = jaccard.met(np.zeros(len(many), np.uint64), jaccard.weighted(many, np.full(len(many), 2, np.uint64)))
    assert set(a.tolist()) == {0} and sorted(b.tolist()) == many[1:].tolist() and set(w.tolist()) == {jaccard.ENOUGH}


def test_texts_that_share_a_passage_make_no_block(spark):
    """Twelve passages, each in some 50 of 600 texts, and one text with a near copy."""
    rng = random.Random(11)
    words = lambda n: ["%x" % rng.randrange(1 << 40) for _ in range(n)]
    passages = [words(60) for _ in range(12)]
    texts = [words(200) + rng.choice(passages) + words(200) for _ in range(600)]
    texts.append([*texts[0][:-1], "other"])
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = jaccard.shingle_sets([" ".join(t).encode() for t in texts], 5)
    none = np.zeros(jaccard.SLOTS, bool)
    keys = [set(jaccard.candidate_keys(s, 80, none).tolist()) for s in sets]
    assert sum(bool(a & b) for a, b in combinations(keys, 2)) > 2000  # agreement on one segment would tie so many
    blocks = graph.components(jaccard.candidate_pairs(df, 5, 80, none)).groupBy("root").count().collect()
    assert max(r["count"] for r in blocks) < 10
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    assert got[600] == 0 and all(got[k] == k for k in range(600))


def test_shuffles_of_a_stored_table_go(spark, folder):
    before = spark.conf.get(graph.CLEAN_UP)
    rows = spark.range(5000).withColumn("k", F.col("id") % 97).groupBy("k").count()
    shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    known = shuffles.size()
    assert graph.stored(rows, "rows").count() == 97 and spark.conf.get(graph.CLEAN_UP) == before
    for _ in range(50):
        if shuffles.size() <= known + 1:  # one by the count
            break
        time.sleep(0.1)
    assert shuffles.size() <= known + 1


def test_trees_lose_no_link():
    rng = random.Random(8)
    rows = [r for r in near_copies(rng, 120) if r[1]]
    sets = jaccard.shingle_sets([t.encode() for _, t in rows], 3)
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if jaccard.linked(sets[a], sets[b], 80)}
    tree = jaccard.Tree(sets, np.arange(len(sets)))
    met = {tuple(sorted(p)) for p in jaccard.pairs_above(tree, tree, 80, True)}
    assert want <= met and len(met) < len(sets) ** 2 / 8
    left, right = np.arange(0, 50), np.arange(50, len(sets))
    a, b = jaccard.Tree(sets, left), jaccard.Tree(sets, right)
    across = {(int(a.order[i]), int(b.order[j])) for i, j in jaccard.pairs_above(a, b, 80, False)}
    assert {p for p in want if p[0] < 50 <= p[1]} <= across


def test_components_agree_with_brute_force_whole_and_in_parts(spark, monkeypatch):
    rows = near_copies(random.Random(9))
    rows += [(500, None), (501, " \n"), (3, rows[3][1]), (3, "another text of the same doc"), (None, rows[5][1]), (None, "alone with no name")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("node", F.lit(1)).withColumn("class", F.lit(2))
    for sets, size, per_cent, often in ((2_000, 3, 90, 64), (6, 5, 80, 2)):
        monkeypatch.setattr(jaccard, "BLOCK_SETS", sets)
        monkeypatch.setattr(jaccard, "OFTEN_LEAST", often)
        got = sorted((tuple(r) for r in jaccard.jaccard_components(df, size, per_cent).collect()), key=repr)
        assert got == brute(rows, size, per_cent)


def test_a_part_against_an_empty_one_has_no_links():
    words = [b"%d" % k for k in range(50)]
    texts = [b" ".join(words + [b"x%d" % k]) for k in range(2)]
    names = [jaccard.digest(s) for s in jaccard.shingle_sets(texts, 3)]
    for side, found in ((0, 0), (1, 0), (-1, 1)):
        columns = [[7, 7], [0, 0], [0 if side < 0 else 1] * 2, names, [side] * 2, texts]
        batch = jaccard.pa.RecordBatch.from_arrays([jaccard.pa.array(c) for c in columns], names=list("bijcst"))
        assert sum(b.num_rows for b in jaccard._blocks(3, 90)([batch])) == found


def test_odd_and_empty_tables(odd, none):
    rows = jaccard.jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: r.component_id for r in rows if r.doc_id} == {k: 5 if k == 6 else k for k in range(1, 10)}
    assert jaccard.jaccard_components(none).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(50)] + [(200, 200), (None, 5), (300, 301), (301, 300)]
    edges += [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(35)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}
    for a, b in edges:
        if a is not None and a != b:
            top.setdefault(a, {a}), top.setdefault(b, {b})
            whole = top[a] | top[b]
            for k in whole:
                top[k] = whole
    assert got == {k: min(v) for k, v in top.items()}
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_sieve_lets_every_wanted_row_through(spark):
    bitmap = sieve.sieve(spark.range(0, 5000, 7))
    through = {r.id for r in spark.range(5000).where(sieve.possible(bitmap, F.col("id"))).collect()}
    assert set(range(0, 5000, 7)) <= through and len(through) < 800
    assert spark.range(50).where(sieve.possible(sieve.sieve(spark.range(0)), F.col("id"))).count() == 0
