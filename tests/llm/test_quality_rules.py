from math import comb

import duckdb
import pytest
from pyspark.sql import functions as F

from check_oracle import rows_of
from tidewatch.llm import quality_rules, queries


def test_tail_is_the_exact_binomial(spark):
    cases = [(k, n, r) for n in (1, 7, 60, 400) for k in (0, 1, 3, 19) for r in (0.005, 0.05, 0.3) if k <= n]
    for risk in (0.005, 0.05, 0.3):
        df = spark.createDataFrame([(k, n) for k, n, r in cases if r == risk], "k long, n long")
        for row in df.select("k", "n", quality_rules.tail(F.col("k"), F.col("n"), risk).alias("p")).collect():
            if row.k < row.n * risk:
                want = sum(comb(row.n, i) * risk**i * (1 - risk) ** (row.n - i) for i in range(row.k + 1))
                assert row.p == pytest.approx(want, rel=1e-9)
            else:
                assert row.p == 1
    large = spark.createDataFrame([(900, 1_000_000)], "k long, n long")
    assert 0 <= large.select(quality_rules.tail(F.col("k"), F.col("n"), 0.01)).first()[0] < 1e-300


def judged_by_sql(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    result = con.execute(queries.quality_sql())
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    got = queries.op4_quality_rules(spark, folder)
    rows = got.collect()
    assert rows_of(got.columns, rows) == want
    return rows


def test_cutoffs_reject_the_bad_and_spare_the_good(spark, folder):
    word = F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit("-"), F.col("k").cast("string"))), 1, 5)
    docs = (
        spark.range(4000)
        .select("id", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("k"))
        .groupBy("id")
        .agg(F.array_join(F.collect_list(word), " ").alias("good"), F.array_join(F.collect_list(F.concat(word, F.lit("###$$"))), " ").alias("bad"))
        .selectExpr(
            "id AS doc_id", "CASE WHEN id % 8 = 0 THEN bad ELSE good END AS text", "CASE WHEN id % 40 = 1 THEN 'de' ELSE 'en' END AS lang"
        )
    )
    labels = docs.selectExpr("doc_id", "CASE WHEN doc_id % 8 = 0 THEN 0 ELSE 1 END AS quality", "0 AS toxic")
    rows = judged_by_sql(spark, folder, docs, labels)
    english = [r for r in rows if r.doc_id % 40 != 1]
    assert all(r.kept == (r.doc_id % 8 != 0) for r in english)
    assert {r.symbol_share_cut for r in english} == {50}
    few = [r for r in rows if r.doc_id % 40 == 1]  # 100 labels can't certify anything
    assert {r.symbol_share_cut for r in few} == {None} and all(r.kept for r in few)


def test_odd_rows_agree_with_sql(spark, folder, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 0), (7, 0, 0), (None, 1, 0), (99, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    plain = odd.where("doc_id IS NOT NULL AND doc_id <> 7").select("doc_id", "text", "lang", "source")
    rows = {r.doc_id: r for r in judged_by_sql(spark, folder, plain, labels)}
    assert all(rows[k].base_failed and not rows[k].kept and rows[k].n_words == 0 for k in (1, 2, 3))
    assert rows[8].n_repeat_words == 200 and rows[8].base_failed and rows[5].n_words == 30_000
    every = quality_rules.judged(odd, labels)
    assert every.count() == odd.count()
    assert quality_rules.judged(none, labels).count() == 0 and quality_rules.judged(odd, labels.where("false")).count() == odd.count()
