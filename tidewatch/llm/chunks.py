"""Substring dedup by content-defined chunks of a gear rolling hash.

The words of a text run through a gear hash, ``h = (h << SHIFT) + gear[word]``, which forgets a word after
``64 / SHIFT`` steps. A chunk begins where the hash is a local maximum among its neighbours, so where a chunk begins
depends on a few words around it and on nothing before: after an insertion the next chunks are the same again.
Two chunks in a row, some ten words, are told apart by a 64-bit digest; a digest's first occurrence in the corpus (the
smallest doc_id, then the position) stays, later ones are repeats. Repeats that touch or overlap are one span, and
spans of ``min_words`` words or more are reported.

A passage that repeats loses at its ends the words up to its first chunk and after its last, a few words each, so
``min_words`` is set to half of the passages to be found: passages of 50 words give spans of some 40.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.graph import stored
from tidewatch.llm.sieve import possible, sieve
from tidewatch.llm.words import hashed_words, mix, pieces, text_digest, texts_of

SHIFT = 21
REACH = 2
#: In a run that has no local maximum, such as one word again and again, a chunk ends after so many words.
LONGEST = 16
MIN_WORDS = 25
WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def chunk_starts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a chunk begins at each word, for the words of many texts on end; ``starts`` are where texts begin."""
    n = len(hashes)
    gear = mix(hashes + np.uint64(0x9E3779B97F4A7C15))
    rolling = gear.copy()
    for k in range(1, -(-64 // SHIFT)):
        rolling[k:] += gear[:-k] << np.uint64(k * SHIFT)
    begins = np.ones(n, bool)
    for k in range(1, REACH + 1):
        begins[k:] &= rolling[k:] > rolling[:-k]
        begins[:-k] &= rolling[:-k] > rolling[k:]
    begins[starts[:-1][starts[:-1] < n]] = True
    at = np.arange(n)
    since = at - np.maximum.accumulate(np.where(begins, at, 0))
    return begins | (since % LONGEST == 0)


def double_chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every two chunks in a row: text, digest, first word and number of words."""
    hashes, starts = hashed_words(texts)
    if not len(hashes):
        return (np.empty(0, np.int64),) * 4
    first = np.flatnonzero(chunk_starts(hashes, starts))
    ends = np.append(first[1:], len(hashes))
    text = np.searchsorted(starts, first, "right") - 1
    ordinal = np.arange(len(hashes)) - np.repeat(first, ends - first)
    single = mix(np.add.reduceat(mix(hashes + mix(ordinal.astype(np.uint64))), first) + (ends - first).astype(np.uint64))
    pair = text[1:] == text[:-1]
    digest = mix(single[:-1] * np.uint64(0x9E3779B97F4A7C15) + single[1:])[pair]
    head = first[:-1][pair]
    return text[:-1][pair], digest.view(np.int64), head - starts[text[:-1][pair]], ends[1:][pair] - head


def _told(batches):
    for batch in pieces(batches, 1):
        text, digest, word, n = double_chunks(texts_of(batch.column(1)))
        of, at = pa.array(text), (word << 8) | np.minimum(n, 255)
        yield pa.RecordBatch.from_arrays(
            [pa.array(digest), batch.column(0).take(of), batch.column(2).take(of), pa.array(at)],
            names=["digest", "doc_id", "version", "at"],
        )


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Spans of ``docs`` (``doc_id``, ``text``; other columns are ignored) that occurred before in the corpus.

    ``doc_id, version, start_word, n_words, first_doc_id``: words (runs of bytes other than 0x20 and 0x09-0x0D) of the
    text from ``start_word`` on; ``first_doc_id`` is the smallest document that a part of the span was first seen in,
    which is the document itself where it repeats its own words. ``version`` is a 64-bit digest of the text that
    tells texts of one doc_id apart.

    Null, empty and short texts give no span. Rows that repeat doc_id and text are one document. Documents without a
    doc_id come last, and texts of one doc_id (or of none) by their digests. Equal texts keep the smallest doc_id's. An empty table gives
    an empty one.

    A digest's first occurrence is a grouped minimum, combined before the shuffle; the join back is on digests that
    occur twice, and the adaptive skew join splits a digest with very many occurrences. Only occurrences that a bitmap of
    those digests lets through are dealt out for it. A document's repeats meet in one task.
    """
    told = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_digest().alias("version")
    ).mapInArrow(_told, "digest long, doc_id long, version long, at long")
    word = F.shiftright("at", 8)
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "version", word.alias("word"))
    first = stored(
        told.groupBy("digest")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "version", "word")]),
        "first",
    )
    itself = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("version") == F.col("first_version")) & (word == F.col("first_word"))
    again = told.where(possible(sieve(first.select("digest")), F.col("digest")))
    repeats = (
        again.join(first.hint("merge"), "digest")
        .where(~itself)
        .select("doc_id", "version", word.alias("word"), F.col("at").bitwiseAND(F.lit(255)).alias("n"), "first_doc_id")
        .groupBy("doc_id", "version", "word")
        .agg(F.max("n").alias("n"), F.min("first_doc_id").alias("first_doc_id"))
    )
    within = Window.partitionBy("doc_id", "version").orderBy("word")
    reached = F.max(F.col("word") + F.col("n")).over(within.rowsBetween(Window.unboundedPreceding, -1))
    marked = repeats.withColumn("new", (F.coalesce(reached, F.lit(-1)) < F.col("word")).cast("int"))
    return (
        marked.withColumn("span", F.sum("new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "version", "span")
        .agg(
            F.min("word").alias("start_word"),
            (F.max(F.col("word") + F.col("n")) - F.min("word")).alias("n_words"),
            F.min("first_doc_id").alias("first_doc_id"),
        )
        .where(F.col("n_words") >= min_words)
        .select("doc_id", "version", "start_word", "n_words", "first_doc_id")
    )


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the words of the spans cut out of ``text``, all its other columns as they were.

    A cut takes the white space behind each word with it; the rest of the text keeps every byte. A text that is cut
    whole becomes empty. ``n_chars`` follows the text where there is such a column. Only texts that a bitmap of the cut
    ones lets through are dealt out for the join.
    """

    def run(batches):
        for batch in pieces(batches, 0):
            out = []
            for text, starts, sizes in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if text is not None and starts:
                    edges = [m.start() for m in WORD.finditer(text)] + [len(text)]
                    kept, upto = [], 0
                    for a, n in sorted(zip(starts, sizes)):
                        kept.append(text[upto : edges[a]])
                        upto = edges[a + n]
                    text = b"".join(kept) + text[upto:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *batch.columns[3:]], names=["text", *names])

    names = [f"c{k}" for k in range(len(docs.columns))]
    others = [(n, f) for n, f in zip(names, docs.schema.fields)]
    cuts = stored(
        spans.groupBy("doc_id", "version")
        .agg(F.collect_list("start_word").alias("starts"), F.collect_list("n_words").alias("sizes"))
        .withColumnRenamed("doc_id", "_id"),
        "cuts",
    )
    named = docs.select(
        F.col("text").cast("binary").alias("_text"), text_digest().alias("_v"), *[F.col(f"`{f.name}`").alias(n) for n, f in others]
    )
    doc = dict(zip(docs.columns, names))["doc_id"]
    names = [n for n, f in others if f.name != "text"]
    named = named.withColumn("_cut", possible(sieve(cuts.select(F.xxhash64("_id", "version"))), F.xxhash64(F.col(doc).cast("long"), "_v")))
    clear, rest = named.where("NOT _cut"), named.where("_cut")
    rest = rest.join(cuts.hint("merge"), rest[doc].eqNullSafe(cuts["_id"]) & (rest["_v"] == cuts["version"]), "left")
    uncut = [F.lit(None).cast(cuts.schema[c].dataType).alias(c) for c in ("starts", "sizes")]
    kept = clear.select("_text", *uncut, *names).unionByName(rest.select("_text", "starts", "sizes", *names))
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in others if f.name != "text")
    cut = kept.mapInArrow(run, f"text binary, {fields}")
    size = F.length(F.col("text").cast("string")).cast("long")
    return cut.select(
        *[
            F.col("text").cast("string").alias("text")
            if f.name == "text"
            else (size if f.name == "n_chars" else F.col(n)).alias(f.name)
            for n, f in others
        ]
    )
