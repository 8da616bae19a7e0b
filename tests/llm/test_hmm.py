import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tidewatch.llm import hmm, scoring


def small_model(states=3, classes=5, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def by_paths(model, seq):
    """Probability of the sequence and expected emissions and moves, by every path of states."""
    states, total = len(model.start), 0.0
    emitted, moved, started = np.zeros_like(model.emit), np.zeros_like(model.move), np.zeros(states)
    for path in product(range(states), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for k in range(1, len(seq)):
            p *= model.move[path[k - 1], path[k]] * model.emit[seq[k], path[k]]
        total += p
        started[path[0]] += p
        for k, s in enumerate(path):
            emitted[seq[k], s] += p
            if k:
                moved[path[k - 1], s] += p
    return total, emitted / total, moved / total, started / total


def test_forward_and_expected_counts_agree_with_all_paths():
    model, rng = small_model(), np.random.default_rng(2)
    texts = [rng.integers(0, 5, n) for n in (4, 1, 6, 3, 6)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    tokens = np.concatenate(texts)
    emitted, moved, started, logs = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3), np.zeros(5)
    for some in hmm.runs(starts):
        lattice = hmm.Lattice(tokens, starts, some)
        logs[some] = lattice.log_likelihoods(model)
        lattice.expect(model, emitted, moved, started)
    want = [by_paths(model, t) for t in texts]
    assert logs == pytest.approx([np.log10(w[0]) for w in want])
    for got, k in ((emitted, 1), (moved, 2), (started, 3)):
        assert got == pytest.approx(sum(w[k] for w in want), rel=1e-4)


def test_rounds_raise_the_likelihood(monkeypatch):
    monkeypatch.setattr(hmm, "PRIOR", 20.0)
    rng = np.random.default_rng(5)
    tokens = np.concatenate([rng.choice(4, 50) + 4 * (k % 2) for k in range(40)])
    starts, freq = np.arange(41) * 50, np.full(8, 1 / 8)
    model, seen = hmm.Model.first(freq, 2), []
    for _ in range(8):
        emitted, moved, started = np.zeros((8, 2)), np.zeros((2, 2)), np.zeros(2)
        seen.append(sum(hmm.Lattice(tokens, starts, s).expect(model, emitted, moved, started) for s in hmm.runs(starts)))
        model = hmm.maximise(emitted, moved, started, freq)
    assert seen[-1] > seen[0] + 500


def test_scores_beat_the_counts_and_counts_are_right(docs):
    rows = scoring.hmm_scores(docs).collect()
    texts = {r.doc_id: r.text.encode().lower().split() + [b""] for r in docs.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    counts = Counter(w for k, words in texts.items() if not held[k] for w in words)
    total, distinct = sum(counts.values()), len(counts)
    for r in rows:
        words = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words), total)
        assert r.n_known == sum(counts[w] > 0 for w in words)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in words))
    assert len(rows) == len(texts)
    assert sum(r.score - r.base_score for r in rows if r.held_out) > 0


def test_odd_rows_blocks_and_empty_tables(odd, none, monkeypatch):
    whole = sorted((tuple(r) for r in scoring.hmm_scores(odd, states=2, rounds=1).collect()), key=repr)
    assert len(whole) == odd.count() and all(r[2] == 1 for r in whole if r[0] in (1, 2, 3))
    assert scoring.hmm_scores(none, states=2, rounds=1).count() == 0
    untrained = scoring.hmm_scores(odd.where("doc_id = 1 AND crc32('1') % 7 <> 2 OR doc_id IN (2, 4)"), states=2, rounds=1)
    assert untrained.count() >= 2
