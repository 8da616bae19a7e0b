import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import langid


@pytest.fixture(scope="module")
def model(docs):
    return langid.text_model(docs.where("doc_id % 3 <> 0"))


def test_held_out_texts_alone_and_fused(spark, docs, model):
    held = docs.where("doc_id % 3 = 0")
    blind = langid.document_evidence(held).withColumn("declared", F.lit(None).cast("string"))
    rows = langid.fused(blind, model, ["doc_id", "lang"]).collect()
    assert sum(r.text_language == r.lang for r in rows) >= 0.97 * len(rows)
    assert sum(r.language == r.lang and r.kept for r in rows) >= 0.97 * len(rows)


def test_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = langid.fused(langid.page_evidence(pages), model, ["page_id"]).collect()
    want = {r[0]: r[1] for r in pages.select("page_id", F.regexp_extract("html", 'lang="(..)"', 1)).collect()}
    assert len(rows) == len(want) and sum(r.language == want[r.page_id] for r in rows) >= 0.97 * len(rows)


def test_posterior_is_the_product_of_the_evidence(spark, model):
    rows = [(k, f"de en {k}" * (k % 3), "de-AT" if k % 4 else None, ["com", "fr", None][k % 3], ["a.x.org", "b.x.org", "c5"][k % 3]) for k in range(24)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string")
    got = {r.id: r for r in langid.fused(df, model, ["id"]).collect()}
    names, known = langid.LANGUAGES, len(langid.LANGUAGES)
    logs, best = {}, {}
    for i, text, *_ in rows:
        slots, _ = langid.trigrams([text.encode()])
        logs[i] = model[:, slots].astype(float).sum(axis=1) * langid.TEMPER
        best[i] = int(np.argmax(logs[i][:known])) if len(slots) else -1
    parent = lambda h: h.partition(".")[2] if "." in h else h.rstrip("0123456789")
    tag = lambda d: known + 1 if d is None else (names.index(d[:2]) if d[:2] in names else known)
    count = lambda f, k, skip=None: sum(best[r[0]] == k and f(r) for r in rows if r[0] != skip)
    lent = langid.LENT
    whole = np.array([langid.PSEUDO + count(lambda r: True, k) for k in range(known)])
    share = whole / whole.sum()
    for i, _, declared, suffix, host in rows:
        post = []
        for k in range(known):
            p = [count(lambda r: parent(r[4]) == parent(host), j) for j in range(known)]
            h = [count(lambda r: r[4] == host, j, i) for j in range(known)]
            s = [count(lambda r: r[3] == suffix, j) for j in range(known)]
            above = (p[k] + lent * share[k]) / (sum(p) + lent)
            t = [langid.PSEUDO + lent / (known + 2) + count(lambda r: tag(r[2]) == j, k) for j in range(known + 2)]
            post.append(
                np.log((h[k] + lent * above) / (sum(h) + lent))
                + np.log(t[tag(declared)] / sum(t))
                + np.log((s[k] + lent * share[k]) / ((sum(s) + lent) * share[k]))
                + logs[i][k]
            )
        post.append(np.log(1e-6) + logs[i][known])
        top = int(np.argmax(post))
        assert got[i].language == (*names, langid.UNKNOWN)[top]
        assert got[i].confidence == pytest.approx(1 / np.exp(np.array(post) - max(post)).sum(), rel=1e-6)


def test_odd_rows(odd, none, model):
    rows = langid.fused(langid.document_evidence(odd), model, ["doc_id", "n"]).collect()
    assert len(rows) == odd.count() and all(r.n == 4 for r in rows)
    assert not any(r.kept for r in rows if r.doc_id in (1, 2))
    assert langid.fused(langid.document_evidence(none), model, ["doc_id"]).count() == 0
    assert langid.text_model(none).shape == (len(langid.LANGUAGES) + 1, langid.SLOTS)
