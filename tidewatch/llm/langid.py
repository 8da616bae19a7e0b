"""Language identification by Bayesian fusion of evidence.

The posterior of a language is the product of

* the likelihood of the text: byte trigrams (A-Z lower-cased) in ``SLOTS`` slots, one table per language, learned from
  a sample of about ``TRAIN_DOCS`` labelled documents per language; ``und`` is the language of evenly spread trigrams;
* the likelihoods of the declared markup language and of the address suffix, from how often each goes with each
  language in the whole table;
* the prior of the host, smoothed up its tree: the host's own languages, drawn to those of its parent domain, drawn
  to those of the whole table. A row's own text does not count in its prior.

The languages that are counted for likelihoods and priors are those that the texts alone are most likely in. Counts are
grouped aggregations over all rows; what each row gets back it gets by a join on its host and its suffix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.graph import stored
from tidewatch.llm.words import pieces, texts_of

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
#: Bound on what the text model is fitted on, in documents per language (in the mean of a seeded hash).
TRAIN_DOCS = 500
#: Trigrams overlap, so each counts for a third.
TEMPER = 1 / 3
#: Rows that each level of the host tree lends to the one below, and rows lent to each declared language and suffix.
LENT = 20.0
LEAST_CONFIDENCE = 0.8
#: Added to each language's count of a slot, and to each count of the whole table.
PSEUDO = 0.05


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the byte trigrams of each text between its first and last byte, on end, and where each text begins."""
    data = np.frombuffer(b"".join(t.lower() for t in texts), np.uint8).astype(np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    slots = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
    own = np.ones(len(slots), bool)
    for back in (1, 2):  # trigrams that run over the end of a text
        at = ends[:-1] - back
        own[at[(at >= 0) & (at < len(slots))]] = False
    counts = np.maximum(sizes - 2, 0)
    return slots[own], np.concatenate([[0], np.cumsum(counts)])


def _counted(batches):
    known = {name: k for k, name in enumerate(LANGUAGES)}
    counts = np.zeros((len(LANGUAGES), SLOTS), np.int64)
    for batch in pieces(batches, 0):
        slots, starts = trigrams(texts_of(batch.column(0)))
        for k, name in enumerate(batch.column(1).to_pylist()):
            counts[known[name]] += np.bincount(slots[starts[k] : starts[k + 1]], minlength=SLOTS)
    lang, slot = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.int32()), pa.array(slot, pa.int32()), pa.array(counts[lang, slot])], names=["lang", "slot", "n"]
    )


def text_model(docs: DataFrame, lang: str = "lang") -> np.ndarray:
    """Log probabilities (languages and ``und``, slots), learned from labelled ``docs`` (``doc_id``, ``text``, ``lang``)."""
    labelled = docs.where(F.col(lang).isin(*LANGUAGES) & F.col("text").isNotNull())
    sizes = {row[0]: row[1] for row in labelled.groupBy(lang).count().collect()}
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == name, min(1.0, TRAIN_DOCS / n)).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000
    sample = labelled.where(drawn).select(F.col("text").cast("string").alias("text"), F.col(lang).alias("lang"))
    counts = np.full((len(LANGUAGES) + 1, SLOTS), PSEUDO)
    for row in sample.mapInArrow(_counted, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n")).collect():
        counts[row[0], row[1]] += row[2]
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _likelihoods(model: np.ndarray, kept: int):
    def run(batches):
        for batch in pieces(batches, kept):
            slots, starts = trigrams(texts_of(batch.column(kept)))
            sums = np.zeros((batch.num_rows, len(model)))
            text = np.flatnonzero(np.diff(starts) > 0)
            if len(text):
                for k, table in enumerate(model):
                    sums[text, k] = np.add.reduceat(table[slots], starts[:-1][text], dtype=np.float64) * TEMPER
            values = pa.array(sums.ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:kept],
                    pa.FixedSizeListArray.from_arrays(values, len(model)).cast(pa.list_(pa.float64())),
                    pa.array(np.diff(starts)),
                ],
                names=[*batch.schema.names[:kept], "text_log", "n_trigrams"],
            )

    return run


def _counts(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    return rows.groupBy(key).agg(*[F.sum((F.col("text_best") == k).cast("double")).alias(f"{prefix}{k}") for k in range(len(LANGUAGES))])


def fused(rows: DataFrame, model: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep``, then ``language``, ``confidence`` (its posterior), ``text_language`` (the text's alone), ``kept``.

    ``rows`` has ``text``, ``declared`` (a language tag), ``suffix`` (of the address) and ``host``; each may be null, and
    other columns than those and ``keep`` are ignored. The parent of a host is what follows its first dot, or its
    letters before a number. A text of fewer than three bytes says nothing; without any evidence the language is the
    most frequent. Ties go to the first language in order. ``kept`` asks for a text that says something, a language
    other than ``und`` and a confidence of ``LEAST_CONFIDENCE``.

    Repeated rows are rows of their own. An empty table gives an empty one.
    """
    host = F.coalesce(F.lower(F.col("host").cast("string")), F.lit(""))
    parent = F.when(host.contains("."), F.regexp_extract(host, r"^[^.]*\.(.*)$", 1)).otherwise(F.regexp_extract(host, r"^(.*?)[0-9]*$", 1))
    declared = F.lower(F.regexp_extract(F.coalesce(F.col("declared").cast("string"), F.lit("")), r"^\s*([A-Za-z]+)", 1))
    known = len(LANGUAGES)
    tag = F.lit(known)  # languages by their number, then other tags, then none
    for k, name in enumerate(LANGUAGES):
        tag = F.when(declared == name, k).otherwise(tag)
    named = rows.select(
        *[F.col(c).alias(f"k{n}") for n, c in enumerate(keep)],
        host.alias("host"),
        parent.alias("parent"),
        F.coalesce(F.lower(F.col("suffix").cast("string")), F.lit("")).alias("suffix"),
        F.when(declared == "", known + 1).otherwise(tag).cast("int").alias("tag"),
        F.col("text").cast("string").alias("text"),
    )
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields[:-1])
    said = named.mapInArrow(_likelihoods(model, len(named.columns) - 1), f"{fields}, text_log array<double>, n_trigrams long")
    some = F.slice("text_log", 1, known)
    best = F.when(F.col("n_trigrams") > 0, F.array_position(some, F.array_max(some)) - 1).otherwise(F.lit(-1)).cast("int")
    said = stored(said.withColumn("text_best", best), "likelihoods")

    # counts of the whole table, and of the tags: known + 2 rows of numbers
    whole, tags = np.full(known, PSEUDO), np.full((known + 2, known), PSEUDO)
    for row in said.where("text_best >= 0").groupBy("tag", "text_best").count().collect():
        whole[row[1]] += row[2]
        tags[row[0], row[1]] += row[2]
    share = whole / whole.sum()
    lent = np.full((known + 2, 1), LENT / (known + 2))
    tag_given = np.log((tags + lent) / (tags + lent).sum(axis=0))  # log P(tag | language)

    parents = _counts(said, "parent", "p")
    hosts = said.groupBy("host", "parent").agg(
        *[F.sum((F.col("text_best") == k).cast("double")).alias(f"h{k}") for k in range(known)]
    )
    hosts = hosts.join(parents, "parent")
    total_p = sum((F.col(f"p{k}") for k in range(known)), F.lit(0.0))
    hosts = hosts.select(
        "host", *[f"h{k}" for k in range(known)], *[((F.col(f"p{k}") + LENT * float(share[k])) / (total_p + LENT)).alias(f"q{k}") for k in range(known)]
    )
    # log P(suffix | language) over P(suffix), drawn to 1 by the rows that are lent to each suffix
    total_s = sum((F.col(f"s{k}") for k in range(known)), F.lit(0.0))
    suffixes = _counts(said, "suffix", "s").select(
        "suffix",
        *[F.log((F.col(f"s{k}") + LENT * float(share[k])) / ((total_s + LENT) * float(share[k]))).alias(f"s{k}") for k in range(known)],
    )
    joined = said.join(hosts, "host").join(suffixes, "suffix")
    own = [(F.col("text_best") == k).cast("double") for k in range(known)]  # the row's text doesn't speak twice
    others = sum((F.col(f"h{k}") - own[k] for k in range(known)), F.lit(0.0))
    prior = [F.log((F.col(f"h{k}") - own[k] + LENT * F.col(f"q{k}")) / (others + LENT)) for k in range(known)]
    tagged = [F.get(F.array(*[F.lit(float(v)) for v in tag_given[:, k]]), F.col("tag")) for k in range(known)]
    posts = [prior[k] + tagged[k] + F.col(f"s{k}") + F.col("text_log")[k] for k in range(known)]
    # und: unlikely beforehand, and tags and suffixes say nothing about it
    posts.append(F.lit(float(np.log(1e-6))) + F.col("text_log")[known])
    names = F.array(*[F.lit(n) for n in (*LANGUAGES, UNKNOWN)])
    scored = joined.select(*[f"k{n}" for n in range(len(keep))], "n_trigrams", "text_best", F.array(*posts).alias("post"))
    top = scored.withColumn("top", F.array_max("post"))
    told = top.select(
        *[F.col(f"k{n}").alias(c) for n, c in enumerate(keep)],
        F.get(names, (F.array_position("post", F.col("top")) - 1).cast("int")).alias("language"),
        (1 / F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("confidence"),
        F.when(F.col("text_best") >= 0, F.get(names, F.col("text_best"))).alias("text_language"),
        F.col("n_trigrams"),
    )
    accepted = (F.col("n_trigrams") > 0) & (F.col("language") != UNKNOWN) & (F.col("confidence") >= LEAST_CONFIDENCE)
    return told.withColumn("kept", accepted).drop("n_trigrams")


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents as evidence: their language column is what they declare, their source is the host; they have no address."""
    return docs.withColumns({"declared": F.col("lang"), "host": F.col("source"), "suffix": F.lit(None).cast("string")})


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages as evidence: text without markup, the language of the html element, host and suffix of the address."""
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)
    return pages.withColumns(
        {
            "text": F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " "),
            "declared": F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1),
            "host": host,
            "suffix": F.regexp_extract(host, r"\.([^.]+)$", 1),
        }
    )

