"""Hidden Markov language model over words: Baum-Welch training and exact forward scores.

States emit classes of words, and a class emits its words: ``p(word | state) = p(class | state) * p(word | class)``.
Classes are hashes of words, ``CLASSES`` of them, so the trained model has a fixed size however many words the corpus
has. ``p(word | class)`` comes from the counts of all training words, ``(c + 1) / (C + V + 1)`` with the tokens C and
distinct words V of the class; a word that training lacks has c = 0. The end of a text is a class of its own.
"""

from __future__ import annotations

import numpy as np

STATES = 8
CLASSES = 1 << 14
ROUNDS = 4
#: What each state's emissions get of the corpus's own class frequencies, in tokens.
PRIOR = 8_000.0
#: Tokens that one recursion runs over at a time; a longer text is one recursion by itself.
RUN_TOKENS = 300_000


class Model:
    """``start`` (K), ``move`` (K x K) and ``emit`` (classes x K) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(frequencies: np.ndarray, states: int, seed: int = 1) -> Model:
        """States that last, with seeded departures from the class frequencies."""
        rng = np.random.default_rng(seed)
        emit = frequencies[:, None] * np.exp(rng.normal(0, 1, (len(frequencies), states)))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def runs(starts: np.ndarray):
    """Ranges of texts, longest first within each, of at most ``RUN_TOKENS`` tokens together."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    upto, total = 0, np.cumsum(sizes[order])
    while upto < len(order):
        before = total[upto - 1] if upto else 0
        end = max(upto + 1, int(np.searchsorted(total, before + RUN_TOKENS, "right")))
        yield order[upto:end]
        upto = end


class Lattice:
    """Texts side by side: their first tokens, then their second tokens and so on, the longest texts in front."""

    def __init__(self, classes: np.ndarray, starts: np.ndarray, texts: np.ndarray):
        sizes = starts[texts + 1] - starts[texts]
        steps = int(sizes[0])
        self.width = len(texts) - np.searchsorted(sizes[::-1], np.arange(steps), "right")  # texts with a token at each step
        self.at = np.concatenate([[0], np.cumsum(self.width)])
        step = np.repeat(np.arange(steps), self.width)
        text = np.arange(len(step)) - self.at[step]
        self.classes = classes[starts[texts][text] + step]

    def forward(self, model: Model, kind=np.float64):
        """Scaled forward variables and the scale of every token; the logarithms of the scales add up to the likelihood."""
        emit = model.emit.astype(kind)[self.classes]
        move, alpha = model.move.astype(kind), np.empty_like(emit)
        scale = np.empty(len(emit), kind)
        now = model.start.astype(kind)[None, :]
        for t, n in enumerate(self.width.tolist()):
            a = int(self.at[t])
            now = (now if t == 0 else now[:n] @ move) * emit[a : a + n]
            scale[a : a + n] = now.sum(axis=1)
            now /= scale[a : a + n, None]
            alpha[a : a + n] = now
        return emit, alpha, scale

    def log_likelihoods(self, model: Model) -> np.ndarray:
        """log10 likelihood of each text."""
        _, _, scale = self.forward(model)
        text = np.arange(len(scale)) - np.repeat(self.at[:-1], self.width)
        return np.bincount(text, np.log10(scale), minlength=int(self.width[0]))

    def expect(self, model: Model, emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> float:
        """Adds the expected counts of Baum-Welch; returns the log likelihood."""
        emit, alpha, scale = self.forward(model, np.float32)
        move = model.move.astype(np.float32)
        states = alpha.shape[1]
        beta = np.ones((0, states), np.float32)
        for t in range(len(self.width) - 1, -1, -1):
            a, n = int(self.at[t]), int(self.width[t])
            here = alpha[a : a + n]
            back = np.ones((n, states), np.float32)
            if len(beta):  # texts that go on
                moved += (here[: len(beta)].T @ beta).astype(np.float64) * move
                back[: len(beta)] = beta @ move.T
            here *= back
            beta = emit[a : a + n] * back / scale[a : a + n, None]
        started += alpha[: int(self.width[0])].sum(axis=0)
        for k in range(states):
            emitted[:, k] += np.bincount(self.classes, alpha[:, k], minlength=len(emitted))
        return float(np.log(scale.astype(np.float64)).sum())


def maximise(emitted: np.ndarray, moved: np.ndarray, started: np.ndarray, frequencies: np.ndarray) -> Model:
    """The model that expected counts ask for, with ``PRIOR`` tokens of the corpus's frequencies for each state."""
    emit = emitted + PRIOR * frequencies[:, None]
    move = moved + 1 / len(moved)
    start = started + 1 / len(started)
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
