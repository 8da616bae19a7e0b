"""Scores of whole documents by a hidden Markov model that is learned from a part of them.

The texts are cut into words once, into blocks of a bounded number of tokens: a block holds its distinct words, and its
texts as indices of them. Word counts are grouped over the blocks, each round of training sums the expected counts of
all blocks, and each block gets the counts of its words back by a join. So what is shuffled are the distinct words of
blocks, not the tokens, and only tables of fixed size (classes x states) reach the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.graph import stored
from tidewatch.llm.hmm import CLASSES, ROUNDS, STATES, Lattice, Model, maximise, runs
from tidewatch.llm.words import pieces, texts_of

BLOCK_TOKENS = 1 << 20
FOLDS, HELD_OUT = 7, 2
#: Stands for the end of a text; no word is empty.
END = b""

SCHEMA = pa.schema(
    [
        ("block", pa.int64()),
        ("words", pa.list_(pa.binary())),
        ("trained", pa.list_(pa.int64())),
        ("classes", pa.binary()),
        ("tokens", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())),
        ("held", pa.list_(pa.bool_())),
    ]
)
SPARK_SCHEMA = (
    "block long, words array<binary>, trained array<long>, classes binary, tokens binary, doc_ids array<long>,"
    " sizes array<int>, held array<boolean>"
)


class Index(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def class_of(word: bytes) -> int:
    return zlib.crc32(word) % (CLASSES - 1) + 1 if word != END else 0


def _blocks(batches):
    part = TaskContext.get().partitionId() << 32

    def block(n, index, tokens, names, sizes, held):
        tokens, trained = np.concatenate(tokens), np.repeat(~np.array(held), sizes)
        counts = np.bincount(tokens[trained], minlength=len(index))
        classes = np.array([class_of(w) for w in index], "<u2")
        row = [part + n, list(index), counts, classes.tobytes(), tokens.astype("<i4").tobytes(), names, sizes, held]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SCHEMA)], schema=SCHEMA)

    n, size = 0, 0
    index, tokens, names, sizes, held = Index({END: 0}), [], [], [], []
    for batch in pieces(batches, 1):
        words, counts = [], []
        for text in texts_of(batch.column(1)):
            before = len(words)
            words += text.lower().split()
            words.append(END)
            counts.append(len(words) - before)
        tokens.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
        names += batch.column(0).to_pylist()
        held += batch.column(2).to_pylist()
        sizes += counts
        size += len(words)
        if size >= BLOCK_TOKENS:
            yield block(n, index, tokens, names, sizes, held)
            n, size = n + 1, 0
            index, tokens, names, sizes, held = Index({END: 0}), [], [], [], []
    if names:
        yield block(n, index, tokens, names, sizes, held)


def _expected(model: Model):
    def run(batches):
        classes, states = model.emit.shape
        emitted, moved, started = np.zeros((classes, states)), np.zeros((states, states)), np.zeros(states)
        for batch in batches:
            for row in range(batch.num_rows):
                own, tokens, sizes, held = (batch.column(k)[row] for k in range(4))
                own, tokens = np.frombuffer(own.as_py(), "<u2"), np.frombuffer(tokens.as_py(), "<i4")
                starts = np.concatenate([[0], np.cumsum(sizes.as_py())])
                held, tokens = np.array(held.as_py()), own[tokens]
                for some in runs(starts):
                    if len(some := some[~held[some]]):
                        Lattice(tokens, starts, some).expect(model, emitted, moved, started)
        used = np.flatnonzero(emitted.any(axis=1))
        keys = np.concatenate([used, -1 - np.arange(states), [-1 - states]])
        values = np.concatenate([emitted[used], moved, started[None, :]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), states).cast(pa.list_(pa.float64()))],
            names=["key", "values"],
        )

    return run


def train(blocks: DataFrame, frequencies: np.ndarray, states: int, rounds: int) -> Model:
    """Baum-Welch: each round sums the expected counts of all training texts. The driver gets classes x states numbers."""
    model = Model.first(frequencies, states)
    seen = blocks.select("classes", "tokens", "sizes", "held")
    for _ in range(rounds):
        sums = (
            seen.mapInArrow(_expected(model), "key long, values array<double>")
            .groupBy("key")
            .agg(*[F.sum(F.col("values")[k]).alias(f"v{k}") for k in range(states)])
            .toPandas()
        )
        emitted, moved, started = np.zeros((len(frequencies), states)), np.zeros((states, states)), np.zeros(states)
        keys, values = sums["key"].to_numpy(), sums.drop(columns="key").to_numpy(dtype=np.float64)
        emitted[keys[keys >= 0]] = values[keys >= 0]
        for key, row in zip(keys, values):
            if -1 - states < key < 0:
                moved[-1 - key] = row
            elif key == -1 - states:
                started += row
        model = maximise(emitted, moved, started, frequencies)
    return model


def _scored(model: Model, tokens_of: np.ndarray, words_of: np.ndarray):
    total, distinct = int(tokens_of.sum()), int(words_of.sum())

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                own, tokens, names, sizes, held, known = (batch.column(k)[row] for k in range(6))
                own, tokens = np.frombuffer(own.as_py(), "<u2"), np.frombuffer(tokens.as_py(), "<i4")
                counts = np.zeros(len(own), np.int64)
                if known.is_valid and len(known.values):
                    counts[known.values.field(0).to_numpy(zero_copy_only=False)] = known.values.field(1).to_numpy(zero_copy_only=False)
                sizes = np.array(sizes.as_py(), np.int64)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                base = np.log10((counts + 1) / (total + distinct + 1))
                inside = np.log10((counts + 1) / (tokens_of[own] + words_of[own] + 1))
                at = starts[:-1]
                score = np.add.reduceat(inside[tokens], at)
                classes = own[tokens]
                for some in runs(starts):
                    score[some] += Lattice(classes, starts, some).log_likelihoods(model)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names.as_py(), pa.int64()),
                        pa.array(held.as_py(), pa.bool_()),
                        pa.array(sizes),
                        pa.array(np.add.reduceat((counts > 0)[tokens].astype(np.int64), at)),
                        pa.array(np.full(len(sizes), total)),
                        pa.array(np.add.reduceat(base[tokens], at)),
                        pa.array(score),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def hmm_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``; other columns are ignored): ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score``.

    Tokens are the words of the text with A-Z lower-cased, then one end. Documents with
    ``crc32(doc_id as text) % 7 = 2`` are held out, all others train. ``n_known`` counts tokens that training has,
    ``train_tokens`` is the number N of training tokens, ``base_score`` sums ``log10((c + 1) / (N + V + 1))`` and
    ``score`` is the log10 probability of the text under the trained model, by the forward recursion.

    A null or empty text is one end. A null doc_id trains. Repeated rows count as often as they come. Without any
    training text every count is 0 and the model is its prior. An empty table gives an empty one. A very long text is
    one recursion over its whole length.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"))
    blocks = stored(rows.mapInArrow(_blocks, SPARK_SCHEMA), "blocks")
    word = F.col("w.words")
    name = F.when(word == F.lit(b""), 0).otherwise((F.crc32(word) % (CLASSES - 1) + 1)).cast("int")
    counts = stored(
        blocks.select(F.explode(F.arrays_zip("words", "trained")).alias("w"))
        .where("w.trained > 0")
        .groupBy(word.alias("word"), name.alias("class"))
        .agg(F.sum("w.trained").alias("n")),
        "counts",
    )
    tokens_of, words_of = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for row in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        tokens_of[row["class"]], words_of[row["class"]] = row["n"], row["words"]
    frequencies = (tokens_of + words_of + 1) / (tokens_of.sum() + words_of.sum() + CLASSES)
    model = train(blocks, frequencies, states, rounds)
    known = (
        blocks.select("block", F.posexplode("words").alias("at", "word"))
        .join(counts.select("word", "n").hint("merge"), "word")
        .groupBy("block")
        .agg(F.collect_list(F.struct("at", "n")).alias("known"))
    )
    return (
        blocks.select("block", "classes", "tokens", "doc_ids", "sizes", "held")
        .join(known, "block", "left")
        .select("classes", "tokens", "doc_ids", "sizes", "held", "known")
        .mapInArrow(
            _scored(model, tokens_of, words_of),
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
