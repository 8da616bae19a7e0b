import random

from tidewatch.llm import licenses


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_common_subsequence_and_whole_where_words_are_unique():
    rng = random.Random(2)
    for _ in range(300):
        words = [b"%d" % k for k in range(30)]
        rng.shuffle(words)
        other = [w for w in words if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            other.insert(rng.randrange(len(other) + 1), b"new%d" % rng.randrange(9))
        pairs = licenses.aligned(words, other)
        assert all(words[i] == other[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == longest_common(words, other)


def test_longest_rising_run():
    rng = random.Random(4)
    for _ in range(200):
        values = rng.sample(range(50), rng.randrange(1, 9))
        found = licenses.rising(list(enumerate(values)))
        longest = max(
            bin(mask).count("1")
            for mask in range(1, 1 << len(values))
            if (run := [v for k, v in enumerate(values) if mask >> k & 1]) == sorted(run)
        )
        assert len(found) == longest and [b for _, b in found] == sorted(b for _, b in found)


def test_notices_are_found_changed_moved_and_twice(spark, odd, none):
    mit, apache = licenses.TEMPLATES["MIT-permission"], licenses.TEMPLATES["Apache-2.0"]
    words = mit.split()
    changed = " ".join(w for k, w in enumerate(words) if k % 9).upper()
    rows = [
        (1, f"some words before\n# {apache}\nand after"),
        (2, f"{apache} {apache} text {apache}"),
        (3, f"lead in {changed} lead out"),
        (4, " ".join(w for k, w in enumerate(words) if k % 3)),  # two thirds only
        (5, "the license is under version 2.0 of nothing, apache"),
        (6, "permission " * 50),
    ]
    found = licenses.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    count = {k: [(r.license, r.start_word) for r in found if r.doc_id == k] for k in range(1, 7)}
    assert count[1] == [("Apache-2.0", 4)] and len(count[2]) == 3 and count[3] == [("MIT-permission", 2)]
    assert not count[4] and not count[5] and not count[6]
    assert all(r.coverage == r.matched / r.template_words >= licenses.LEAST_COVERAGE for r in found)
    assert licenses.license_spans(odd).count() == 0 and licenses.license_spans(none).count() == 0


def test_every_line_with_a_notice_in_the_documents_is_found(docs):
    given = {r.doc_id for r in docs.collect() if any(t in r.text for t in licenses.TEMPLATES.values())}
    assert given <= {r.doc_id for r in licenses.license_spans(docs).collect()}


def test_real_headers_and_full_texts_are_found_commented_and_changed(spark):
    rng = random.Random(7)
    texts = {k: v for k, v in licenses.all_templates().items() if k.endswith(("-notice", "-text")) or k == "CC-BY-SA-4.0"}
    assert len(texts) > 20
    rows, want = [], []
    for k, (name, text) in enumerate(texts.items()):
        commented = "int x;\n" + "\n".join(f" * {line}" for line in text.splitlines()) + "\nint main() {}"
        changed = " ".join(w for w in text.split() if rng.random() > 0.07)
        rows += [(2 * k, commented), (2 * k + 1, f"lead in {changed if len(text) > 300 else text} lead out")]
        want += [name, name]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in licenses.license_spans(df).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    for k, name in enumerate(want):
        rivals = {n for n in found.get(k, ()) if licenses.rivals(n) == licenses.rivals(name)}
        assert rivals == {name}, (k, name, found.get(k))


def test_common_is_the_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(100):
        a, b = ([b"%d" % rng.randrange(9) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        assert licenses.Template("t", b" ".join(a).decode(), 0.8).common(b) == longest_common(a, b)
