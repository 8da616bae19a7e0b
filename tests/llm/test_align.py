import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import align
from tidewatch.llm.queries import op12_cross_tokenizer_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tools():
    return align.pair(A, B)


def spans(sizes):
    ends = np.cumsum(sizes).tolist()
    return list(zip([0, *ends[:-1]], ends))


def brute(rows, tools):
    """The contract, link by link."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    links, firsts = [], []
    for name, text in rows:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        xs, ys = [tools.bytes_a[i] for i in a], [tools.bytes_b[i] for i in b]
        if not text or b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
            links.append([])
            firsts.append((name, 0, 0, 0, 0, ""))
            continue
        sa, sb = spans(list(map(len, xs))), spans(list(map(len, ys)))
        both = {e for _, e in sa} & {e for _, e in sb}
        sides = []
        for ids, at in ((a, sa), (b, sb)):
            groups = [[]]
            for i, (_, e) in zip(ids, at):
                groups[-1].append(str(i))
                if e in both:
                    groups.append([])
            sides.append(groups[:-1])
        told = [",".join(x) + "|" + ",".join(y) for x, y in zip(*sides, strict=True)]
        mine, k = [], 0
        for i, (s, e) in zip(a, sa):
            while k and sb[k][0] > s:
                k -= 1
            while sb[k][1] <= s:
                k += 1
            q = k
            while q < len(sb) and sb[q][0] < e:
                mine.append((i, b[q]))
                q += 1
        links.append(mine)
        firsts.append((name, len(a), len(b), len(told), len(mine), hashlib.sha256(";".join(told).encode()).hexdigest()))
    counts = Counter(p for mine in links for p in set(mine))
    most = defaultdict(int)
    for (i, _), c in counts.items():
        most[i] = max(most[i], c)
    return sorted(
        ((*f[:5], sum(counts[p] == most[p[0]] for p in mine), sum(counts[p] for p in mine), f[5]) for f, mine in zip(firsts, links)),
        key=repr,
    )


def read(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_query_against_brute_force(spark, docs, tools):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert read(op12_cross_tokenizer_alignment(spark, FOLDER)) == brute(rows, tools)


def test_odd_rows(odd, tools):
    got = read(align.alignment(odd, A, B))
    assert got == brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], tools)
    assert (1, 0, 0, 0, 0, 0, 0, "") in got and (2, 0, 0, 0, 0, 0, 0, "") in got


def test_no_rows(none):
    assert read(align.alignment(none, A, B)) == []


def test_special_tokens_and_marks_are_plain_text(spark, tools):
    rows = [(1, "a <|endoftext|> b"), (2, "</s><s><unk> <0x41> x"), (3, "one▁two"), (4, "  two  blanks \n\n"), (5, "日本 é́ \x00\x1f")]
    got = read(align.alignment(spark.createDataFrame(rows, "doc_id long, text string"), A, B))
    assert got == brute(rows, tools)
    assert got[2][1:4] == (0, 0, 0)  # B gives a blank for the mark


def test_runs_are_the_groups_between_common_ends():
    rng = random.Random(4)
    for _ in range(2000):
        size = rng.randrange(1, 400)
        dense = rng.random()
        x, y = (sorted({size, *[k for k in range(1, size) if rng.random() < rng.choice([dense, 0.95])]}) for _ in "ab")
        if rng.random() < 0.5:  # long stretches of the same ends
            y = sorted({k for k in x if rng.random() < 0.97} | {k for k in y if rng.random() < 0.03} | {size})
        told = []
        for i, j, m, n in align.runs(np.array(x, np.int64), np.array(y, np.int64)):
            told += [(x[i + k], 1, 1) for k in range(m)] if not n else [(x[i + m - 1], m, n)]
        both = sorted(set(x) & set(y))
        assert told == [
            (high, sum(low < e <= high for e in x), sum(low < e <= high for e in y)) for low, high in zip([0, *both[:-1]], both)
        ]


def test_units_and_parts_give_the_ids_of_the_whole(tools, monkeypatch):
    rng = random.Random(8)
    words = ["a", "the", "it's", "x1", "  ", "don't", "\n", "ü", "日本", "Mc", "end.", "</s>", "1 2", "o' er", "-", " ", "", "▁x", "y▁", "\u00a0", "\x1c", "\u3000z"]
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    monkeypatch.setattr(align, "REMEMBERED", 40)

    def whole_of(text):
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        bytes_of = [b"".join(x[i] for i in ids) for x, ids in ((tools.bytes_a, a), (tools.bytes_b, b))]
        return align.Aligned(np.array(a), np.array(b), tools).cut(None)[0] if bytes_of == [(" " + text).encode()] * 2 else None

    want = [whole_of(text) for text in texts]
    got = [None if x is None else (*x[:4], x[4].tobytes()) for k in range(0, 3000, 7) for x in tools.aligned(texts[k : k + 7])]
    assert got == want
    monkeypatch.setattr(align, "PART_CHARS", 5)
    assert all(" ".join(align._units(text)) == text == " ".join(align._parts(text)) for text in texts)


def test_documents_in_parts_are_aligned_as_a_whole(spark, docs, monkeypatch, tools):
    texts = [r.text for r in docs.limit(30).collect()] + ["", "one▁two " * 9]
    whole = [tuple(map(str, d)) for d in align._documents(texts, tools, True)]
    named = [d[-1] for d in align._documents(texts, tools, False)]
    monkeypatch.setattr(align, "PART_CHARS", 50)
    assert [tuple(map(str, d)) for d in align._documents(texts, tools, True)] == whole
    assert [d[-1] for d in align._documents(texts, tools, False)] == named


def test_a_long_text_and_a_hot_pair(spark, tools):
    long = " ".join(f"w{k % 977} and then some more" for k in range(60_000))
    rows = [(k, "the same words in many documents") for k in range(500)] + [(1000, long)]
    got = read(align.alignment(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), A, B))
    assert got == brute(rows, tools)


def test_groups_as_text(spark):
    df = spark.createDataFrame([(1, "hello there"), (2, None)], "doc_id long, text string").withColumn("groups", F.lit(1))
    text = {r[0]: r[1] for r in align.groups(df, A, B).collect()}
    assert text[2] == "" and text[1].count("|") == text[1].count(";") + 1
