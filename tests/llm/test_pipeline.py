import random

import corpus_pipeline
import duckdb
import public_tokenizers
import sentencepiece

from tests.llm.test_chunks import repeated
from tests.llm.test_jaccard import brute
from tidewatch.llm import chunks, queries

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_takes_effect_and_agrees_with_brute_force(spark, docs, folder):
    df, seen = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, FOLDER).write.parquet(f"{folder}/{k}.parquet")
        df = spark.read.parquet(f"{folder}/{k}.parquet")
        seen.append(df)
        if k < 4:
            assert sorted(df.columns) == sorted(docs.columns), name
    language, joined, cut, mixed, ids = seen
    assert language.count() >= 0.99 * docs.count()
    rows = [(r.doc_id, r.text) for r in language.collect()]
    stays = {i for i, _, c in brute(rows, 5, 80) if i == c}
    assert {r.doc_id for r in joined.collect()} == stays and joined.count() == len(stays) < len(rows)
    rows = sorted((r.doc_id, r.text) for r in joined.collect())
    long, short = repeated(rows)
    texts = {r.doc_id: r for r in cut.collect()}
    for name, text in rows:
        if name not in short:
            assert texts[name].text == text
        elif sum(long[name]) > 60:
            assert texts[name].n_chars == len(texts[name].text) < len(text)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/2.parquet/*.parquet')")
    want = {r[0]: r[-1] for r in con.execute(f"SELECT doc_id, copies FROM ({queries.mixing_sql()}) WHERE copies > 0").fetchall()}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r.text == texts[r.doc_id].text
    assert got == want
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in ids.collect():
        assert r.ids == library.encode(texts[r.doc_id].text) and r.round_trip
    assert ids.count() == mixed.count()


def test_stages_take_odd_and_empty_tables(spark, odd, none, folder):
    for name, df in (("odd", odd.select("doc_id", "text", "lang", "source", "n_chars")), ("none", none)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, df, FOLDER).write.parquet(f"{folder}/{name}{k}.parquet")
            df = spark.read.parquet(f"{folder}/{name}{k}.parquet")
        assert df.count() == 0 or name == "odd"


def test_run_is_all_stages(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "ids_crc32", "round_trip"] and out.count() > 0
    assert chunks.MIN_WORDS <= 50


def test_different_texts_of_one_doc_id_are_judged_each_by_its_own_group(spark):
    rng = random.Random(3)
    a, b, c, d = (" ".join("%x" % rng.randrange(1 << 40) for _ in range(60)) for _ in range(4))
    rows = [(1, a), (5, f"{a} tail"), (5, b), (5, c), (5, c), (6, f"{c} tail"), (None, d), (None, f"{b} tail"), (None, d), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, df, FOLDER).collect()), key=repr)
    assert out == sorted([(1, a), (5, b), (5, c), (8, ""), (None, d)], key=repr)
