"""A training-data pipeline over ``documents``: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import chunks, jaccard, langid, mixing, pieces
from tidewatch.llm.graph import apart, stored
from tidewatch.llm.queries import DOMAIN, EPOCHS, SHARE, WEIGHTS
from tidewatch.llm.sieve import possible, sieve
from tidewatch.llm.words import text_digest
from tidewatch.session import new_folder


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages, with ``lang`` as the evidence has it; the rest go.

    Rows go and stay by their doc_id; a null doc_id is one.
    """
    found = langid.fused(langid.document_evidence(docs), langid.text_model(docs), ["doc_id"])
    known = found.where("kept").groupBy(F.col("doc_id").alias("_id")).agg(F.min("language").alias("_lang"))
    kept = docs.join(known, docs["doc_id"].eqNullSafe(F.col("_id")))
    return kept.select(*[F.col("_lang").alias("lang") if c == "lang" else docs[c] for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near-duplicates (five words, 0.8): the one with the smallest doc_id, and of that the
    smallest digest.

    Rows go and stay by doc_id and digest of the text, so different texts of one doc_id are judged each by its own
    group. Texts without a doc_id come after all others. Texts without words are in no group and stay. Of rows that
    repeat doc_id and text one stays.

    Only rows that may be one that goes, or may be repeated, are dealt out for the exact join.
    """
    groups = jaccard.jaccard_groups(docs, size=5, per_cent=80)
    told = stored(groups.groupBy("doc_id", "version").agg(F.max("root").alias("root"), F.count("*").alias("rows")), "linked")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "version")
    first = apart(told.where("root IS NOT NULL").groupBy("root").agg(F.min(place).alias("first")), "root")
    judged = told.join(first, F.struct(F.col("root").alias("k")) == F.col("key"), "left").select(
        F.col("doc_id").alias("_id"), F.col("version").alias("_of"), F.coalesce(place == F.col("first"), F.lit(True)).alias("stays"), "rows"
    )
    doubtful = stored(judged.where("NOT stays OR rows > 1"), "doubtful")
    seen = sieve(doubtful.select(F.xxhash64("_id", "_of")))
    named = docs.withColumn("_version", text_digest())
    named = named.withColumn("_doubt", possible(seen, F.xxhash64("doc_id", "_version")))
    clear, rest = (named.where(c).drop("_doubt") for c in ("NOT _doubt", "_doubt"))
    gone = doubtful.where("NOT stays").hint("merge")
    rest = rest.join(gone, rest["doc_id"].eqNullSafe(gone["_id"]) & (rest["_version"] == gone["_of"]), "left_anti")
    return clear.unionByName(rest.dropDuplicates(["doc_id", "_version"])).drop("_version")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has; a document that was nothing else goes."""
    cut = chunks.without_spans(docs, chunks.repeated_spans(docs))
    had = F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.where(had)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, as often as it takes them."""
    return mixing.taken(docs, mixing.mixed(docs, F.expr(DOMAIN), SHARE, EPOCHS, WEIGHTS))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the ids of its pieces, and whether they give its text back."""
    coded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "lang", "source"])
    return coded.drop("decoded")


STAGES = [
    ("language_id", in_a_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("mixing", mixed_sources),
    ("sentencepiece", piece_ids),
]

#: SQL can't run the text model, the rolling hash and the merges of the pieces; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
