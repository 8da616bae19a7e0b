"""Token ids of whole documents, written to binary shards in ascending doc_id order and read back."""

from __future__ import annotations

import string
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.grammar import Shard, pack
from tidewatch.llm.words import Remembered, pieces

#: A shard ends with the document that reaches so many tokens.
SHARD_TOKENS = 1 << 20
#: ASCII characters that are neither white space, letters nor digits: a run of them is one word to the tokenizer's pattern.
MARKS = string.punctuation.encode()
#: Words remembered per worker.
REMEMBERED = 1_200_000


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    unseen = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(unseen)}


class WordIds:
    """Ids of the words of a tokenizer that drops white space, each word encoded by the tokenizers library once.

    Words are cut at ASCII white space, which the tokenizer's own pattern also does. To that pattern a word of letters
    with ASCII marks behind it is two words, and a digit is a word. Letters up to U+017F have one code point each, so
    that only lower case and the mapping of bytes are left to do before the library's merges; all else goes through the
    whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.terminals = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        self.byte_letters = _byte_letters()
        self.marks = Remembered(self._any, 10_000)
        self.words = Remembered(self._word, REMEMBERED)

    def _any(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def _merged(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        body = word.rstrip(MARKS)
        if len(body) < len(word):
            if body.isdigit() or _plain_letters(body):
                return self.words[body] + self.marks[word[len(body) :]]
            return self._any(word) if body else self.marks[word]
        if body.isalpha():
            lower = body.lower()
            return self._merged(lower.decode()) if lower == body else self.words[lower]
        if body.isdigit():
            return b"".join([self.marks[body[k : k + 1]] for k in range(len(body))])
        if _plain_letters(body):
            return self._merged(body.decode().lower().encode().decode("latin-1").translate(self.byte_letters))
        return self._any(word)

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an Arrow column; of each word that occurs among them, the memory is asked once."""
        found = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = found.flatten().dictionary_encode()
        known = [self.words[w] for w in coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(known), "<u4")
        at = coded.indices.to_numpy()
        ends = np.cumsum(sizes[at])
        places = np.repeat(starts[at] - ends + sizes[at], sizes[at])
        places += np.arange(len(places))
        cuts = np.concatenate([[0], ends])[found.offsets.to_numpy() - found.offsets[0].as_py()]
        return np.split(ids[places], cuts[1:-1])

    def encode(self, text: bytes) -> bytes:
        return self.encode_all(pa.array([text], pa.binary()).view(pa.string()))[0].tobytes()


def _plain_letters(word: bytes) -> bool:
    """Whether a word is letters up to U+017F whose lower case is one letter each (that of U+0130 is two)."""
    text = word.decode("utf-8", "replace")
    return text.isalpha() and max(text) <= "\u017f" and "\u0130" not in text


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end: int) -> None:
    """Writes the ids of every whole text, ``end`` after each document, in ascending doc_id order below ``folder``.

    The folder holds one Parquet row per shard: ``part`` and ``shard`` (their order is the order of documents),
    ``start`` (ids of the part before the shard), ``n_tokens``, ``doc_ids`` and ``ids`` (the packed shard, see
    ``grammar``). Spark's writer commits whole tasks, so a lost executor leaves no half shard behind.

    A null text is empty and has only its end id. Equal doc_ids stand beside each other, by their texts; a null doc_id
    comes first. ``tokenizer`` must drop white space and is a path on every machine.
    """

    def run(batches):
        words = word_ids(tokenizer)
        mark = np.array([end], "<u4")
        part = TaskContext.get().partitionId()
        state = {"shard": 0, "start": 0}

        def shard(names, coded):
            ids = np.concatenate(coded)
            packed = pack([len(x) for x in coded], ids, words.terminals)
            row = [part, state["shard"], state["start"], len(ids), names, packed]
            state["shard"] += 1
            state["start"] += len(ids)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        names, coded, size = [], [], 0
        for batch in pieces(batches, 1):
            for name, ids in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1))):
                names.append(name)
                coded.append(np.concatenate([ids, mark]))
                size += len(coded[-1])
                if size >= SHARD_TOKENS:
                    yield shard(names, coded)
                    names, coded, size = [], [], 0
        if names:
            yield shard(names, coded)

    schema = pa.schema(
        [
            ("part", pa.int32()),
            ("shard", pa.int32()),
            ("start", pa.int64()),
            ("n_tokens", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())),
            ("ids", pa.binary()),
        ]
    )
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, "part int, shard int, start long, n_tokens long, doc_ids array<long>, ids binary"
    ).write.parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in a folder of ``write_ids``, read from its shards.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is the unsigned CRC-32 of the document's ids as
    little-endian unsigned 32-bit integers. Only the totals of the parts, a row for each task that wrote, are summed up
    in one task.
    """

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                begin, names, data = (batch.column(k)[row].as_py() for k in range(1, 4))
                shard = Shard(data)
                ids = shard.ids().astype("<u4", copy=False)
                ends = np.cumsum(shard.sizes, dtype=np.int64)
                starts = ends - shard.sizes
                whole = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(names), batch.column(0)[row].as_py(), np.int32)),
                        pa.array(names, pa.int64()),
                        pa.array(starts + begin),
                        pa.array(shard.sizes.astype(np.int64)),
                        pa.array([zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                    ],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    shards = spark.read.schema(
        "part int, shard int, start long, n_tokens long, doc_ids array<long>, ids binary"
    ).parquet(folder)
    docs = shards.select("part", "start", "doc_ids", "ids").mapInArrow(
        run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return docs.join(bases, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def read_range(spark: SparkSession, folder: str, doc_id: int, start: int, n: int) -> DataFrame:
    """Up to ``n`` ids of one document from its ``start``-th on, as ``doc_id, ids``, from the index of its shard."""

    def run(batches):
        for batch in batches:
            for names, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(data)
                for k in [k for k, name in enumerate(names) if name == doc_id]:
                    first = int(shard.sizes[:k].sum())
                    take = max(0, min(n, int(shard.sizes[k]) - start))
                    yield pa.RecordBatch.from_pydict({"doc_id": [doc_id], "ids": [shard.read(first + start, take).tolist()]})

    shards = spark.read.schema("doc_ids array<long>, ids binary").parquet(folder)
    return shards.where(F.array_contains("doc_ids", F.lit(doc_id))).mapInArrow(run, "doc_id long, ids array<long>")
