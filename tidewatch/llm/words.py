"""Words, their 64-bit hashes and runs of them, for whole Arrow batches of texts.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which is how ``bytes.split()`` cuts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words remembered per worker between batches; beyond it, rarer words are hashed anew.
REMEMBERED = 200_000


class Remembered(dict):
    """``make(word)`` for each word, remembered for the first ``limit`` words that are no longer than ``longest`` (0: of any kind)."""

    def __init__(self, make, limit: int = REMEMBERED, longest: int = 100):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, word):
        value = self.make(word)
        if len(self) < self.limit and (not self.longest or len(word) <= self.longest):
            self[word] = value
        return value


word_hashes = Remembered(xxhash.xxh3_64_intdigest)


#: Bytes of texts that are cut into words at a time.
PIECE_BYTES = 2 << 20


def pieces(batches, column: int):
    """The batches in slices of at most ``PIECE_BYTES`` of that column's texts (or one row), to bound memory."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, upto = np.cumsum(sizes, dtype=np.int64), 0
        while upto < len(sizes):
            before = int(ends[upto - 1]) if upto else 0
            end = max(upto + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right")))
            yield batch.slice(upto, end - upto)
            upto = end


def texts_of(column) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def text_digest(column: str = "text") -> Column:
    """64 bits of a text, by which rows of one doc_id (or of none) with different texts are told apart."""
    return F.xxhash64(F.col(column).cast("string"))


def hashed_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts on end, and where each text begins (with the total last)."""
    starts, words = [0], []
    for text in texts:
        words += (text.lower() if lower else text).split()
        starts.append(len(words))
    hashes = np.fromiter(map(word_hashes.__getitem__, words), np.uint64, len(words))
    return hashes, np.array(starts, np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; order matters."""
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n] + np.uint64(k + 1))
    return total


def shingle_sets(texts: list[bytes], size: int, lower: bool = True) -> list[np.ndarray]:
    """Each text's distinct ``size``-word shingles as sorted hashes.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    hashes, starts = hashed_words(texts, lower)
    every = windows(hashes, size)
    found = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= size:
            found.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            found.append(mix(windows(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            found.append(np.empty(0, np.uint64))
    return found
