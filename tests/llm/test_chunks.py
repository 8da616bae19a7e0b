import random

import numpy as np

from tidewatch.llm import chunks

PASSAGE = 51


def repeated(rows):
    """Documents with a passage of ``PASSAGE`` words that an earlier place has, and those without a run of 20."""
    seen, seen_short, long, short = {}, {}, {}, set()
    for name, text in rows:
        words = text.encode().split()
        marked = [False] * len(words)
        for size, first in ((PASSAGE, seen), (20, seen_short)):
            for k in range(len(words) - size + 1):
                if first.setdefault(tuple(words[k : k + size]), (name, k)) != (name, k):
                    if size == PASSAGE:
                        marked[k : k + size] = [True] * size
                    else:
                        short.add(name)
        long[name] = marked
    return long, short


def test_repeated_passages_are_found_and_clean_documents_left_alone(docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    long, short = repeated(rows)
    covered = {name: [False] * len(marks) for name, marks in long.items()}
    for r in chunks.repeated_spans(docs).collect():
        assert r.first_doc_id <= r.doc_id and r.n_words >= chunks.MIN_WORDS and r.doc_id in short
        covered[r.doc_id][r.start_word : r.start_word + r.n_words] = [True] * r.n_words
    wanted = sum(map(sum, long.values()))
    assert wanted > 1000
    for name, marks in long.items():
        start = None
        for k, marked in enumerate([*marks, False]):
            if marked and start is None:
                start = k
            elif not marked and start is not None:
                assert any(covered[name][start:k]), (name, start, k)
                start = None
    assert sum(a and b for n in long for a, b in zip(long[n], covered[n])) > 0.85 * wanted


def test_an_insertion_changes_only_the_chunks_around_it():
    rng = random.Random(1)
    words = [b"%x" % rng.randrange(1 << 30) for _ in range(4000)]
    other = words[:1000] + [b"new"] + words[1000:]
    _, one, _, _ = chunks.double_chunks([b" ".join(words)])
    _, two, _, _ = chunks.double_chunks([b" ".join(other)])
    assert len(set(one.tolist()) - set(two.tolist())) <= 6


def test_chunks_cover_texts_and_stay_within_them():
    text, digest, first, n = chunks.double_chunks([b"", b"a", b"x y z " * 100, b"", b"same " * 300])
    assert set(text.tolist()) <= {2, 4} and (n <= 2 * chunks.LONGEST).all() and (first >= 0).all()
    assert (first + n <= np.array([0, 1, 300, 0, 300])[text]).all()
    assert chunks.double_chunks([])[0].size == 0


def test_cutting_leaves_the_rest_as_it_was(spark, odd, none):
    rng = random.Random(2)

    def text(n):
        return " ".join("%x" % rng.randrange(1 << 40) for _ in range(n))

    shared, a, b = text(80), text(60), text(70)
    rows = [(1, f"{a}\n{shared}", 5), (2, f"{b}  {shared} tail", 6), (3, shared, 7), (2, "other text of 2", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, c0 int")
    out = {(r.doc_id, r.c0): r.text for r in chunks.without_spans(df, chunks.repeated_spans(df)).collect()}
    assert out[1, 5] == rows[0][1] and out[2, 8] == "other text of 2"
    assert out[2, 6].startswith(b + "  ") and out[2, 6].endswith(" tail") and len(out[2, 6]) < len(rows[1][1]) - 600
    assert len(out[3, 7]) < 200
    spans = chunks.repeated_spans(odd)
    names = {r.doc_id for r in spans.collect()}
    assert {6, 8} <= names and not names & {1, 2, 3, 4, 7, 9, None}
    cut = chunks.without_spans(odd, spans)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert chunks.repeated_spans(none).count() == 0
    assert chunks.without_spans(none, chunks.repeated_spans(none)).count() == 0


def test_many_texts_of_one_doc_id_or_none_are_told_apart(spark):
    rng = random.Random(6)

    def text(n):
        return " ".join("%x" % rng.randrange(1 << 40) for _ in range(n))

    shared = text(90)
    for name in (7, None):
        # 1,000 texts make some 15 pairs with equal 15 bits; half of the texts hold the passage at their ends
        texts = [f"{text(60)} {shared}" if k % 2 else text(40) for k in range(1000)]
        df = spark.createDataFrame([(name, t, k) for k, t in enumerate(texts)], "doc_id long, text string, k int")
        out = {r.k: r.text for r in chunks.without_spans(df, chunks.repeated_spans(df)).collect()}
        assert all(out[k] == t for k, t in enumerate(texts) if k % 2 == 0)
        cut = [k for k, t in enumerate(texts) if out[k] != t]
        assert len(cut) == 499 and all(out[k].startswith(" ".join(texts[k].split()[:55])) for k in cut)
