"""SentencePiece encoding and decoding as a weighted transducer.

A machine is compiled from a model: a normaliser (spaces to U+2581, the dummy prefix, runs of spaces if the model drops
them), the pieces as arcs over their characters, and byte arcs for characters that no piece has. Composed with a text
it gives a lattice whose shortest path under (min, +) is the encoding.

* Unigram models: an arc weighs minus the piece's score.
* BPE models: the weight of an arc depends on the arc before it, 0 if the two pieces stay apart when the merges of
  the model run over both, and infinity otherwise. A sequence is what the merges give for a text exactly if each
  neighbouring pair stays apart, so one path of finite weight reaches each position, and keeping one state per
  position is exact.

A character without a piece has only its byte arcs, so it parts the lattice. No piece has U+2581 after another character, so a text falls into words whose lattices are independent: the shortest
path of a word is found once and remembered, up to ``REMEMBERED`` words per worker.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.words import REMEMBERED, Remembered, pieces

SPACE = "▁"
#: Segments longer than this are not remembered.
LONG = 64
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class Machine:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.kind = model.trainer_spec.model_type
        spec = model.normalizer_spec
        if self.kind not in (UNIGRAM, BPE) or spec.precompiled_charsmap or any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError(f"{path}: only BPE and unigram models with identity normalisation and no own symbols")
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = [p.score for p in model.pieces]
        self.names = [p.piece for p in model.pieces]
        self.sizes = list(map(len, self.names))
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.own = {p for p in self.ids if len(p) == 1}
        if not self.own.issuperset("".join(self.ids)):
            raise ValueError(f"{path}: a piece has a character that is no piece")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError(f"{path}: a piece spans words")
        spelled = {v: bytes([k]) for k, v in self.bytes.items()}
        self.spelled = [
            spelled[k] if k in spelled else (p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else b"")
            for k, p in enumerate(model.pieces)
        ]
        self.spelled[self.unknown] = model.trainer_spec.unk_surface.encode()
        every = [self.scores[k] for k in self.ids.values()]
        self.tied = max((x for x, n in Counter(every).items() if n > 1), default=-float("inf"))
        self.spines = Remembered(self._spines, len(self.ids))
        self.apart = Remembered(self._apart, 2 * REMEMBERED, 0)
        self.words = Remembered(self.path_of, REMEMBERED, LONG)
        apart = "" if "\n" in self.own else "\n"  # without a piece a line end parts the lattice, too
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+|\n")
        self.arcs = ahocorasick.Automaton()
        for name, k in self.ids.items():
            self.arcs.add_word(name, k)
        self.arcs.make_automaton()

    # normaliser

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    # arcs

    def merged(self, text: str) -> list[str]:
        """What the model's merges make of a short text: best score first, then leftmost."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                piece = self.ids.get(parts[k] + parts[k + 1])
                if piece is not None and (best is None or self.scores[piece] > best[0]):
                    best = (self.scores[piece], k)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]

    def _spines(self, piece: str):
        """How the merges build a piece, seen from its ends: parts at its left end, and at its right end, each with
        the score of the merge that takes it up. None if the merges don't give the piece, or tie."""
        parts, left, right = list(piece), [], []
        while len(parts) > 1:
            scores = [self.scores[self.ids[a + b]] if a + b in self.ids else -float("inf") for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == -float("inf") or best <= self.tied:
                return None
            k = scores.index(best)
            if k == 0:
                left.append((parts[0], best))
            if k == len(parts) - 2:
                right.append((parts[-1], best))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [*left, (piece, -float("inf"))], [*right, (piece, -float("inf"))]

    def _apart(self, pair: int) -> bool:
        first, second = (self.names[k] for k in divmod(pair, len(self.names)))
        a, b = self.spines[first], self.spines[second]
        if a is None or b is None:
            return self.merged(first + second) == [first, second]
        i = j = 0
        while True:
            (inner_a, score_a), (inner_b, score_b) = a[1][i], b[0][j]
            across = self.ids.get(inner_a + inner_b)
            if across is not None and self.scores[across] > score_a and self.scores[across] >= score_b:
                return False
            if score_a == score_b == -float("inf"):
                return True
            if score_a >= score_b:
                i += 1
            else:
                j += 1

    def fallback(self, characters: str) -> list[int]:
        """Byte arcs of characters without pieces, or one unknown piece."""
        return [self.bytes[b] for b in characters.encode()] if self.bytes else [self.unknown]

    # shortest path

    def shortest(self, text: str) -> list[int]:
        """Pieces of the shortest path over characters that all have pieces; the lattice comes ordered by ends."""
        sizes, apart, scores, size = self.sizes, self.apart, self.scores, len(self.names)
        last: list = [None] * len(text)
        if self.kind == BPE:
            for end, piece in self.arcs.iter(text):
                if last[end] is None:
                    start = end - sizes[piece]
                    if start < 0 or apart[last[start] * size + piece]:
                        last[end] = piece
        else:
            weight = [float("inf")] * len(text)
            for end, piece in self.arcs.iter(text):
                start = end - sizes[piece]
                cost = (weight[start] if start >= 0 else 0.0) - scores[piece]
                if cost < weight[end]:
                    weight[end], last[end] = cost, piece
        found, at = [], len(text) - 1
        while at >= 0:
            found.append(last[at])
            at -= sizes[last[at]]
        return found[::-1]

    def path_of(self, text: str) -> bytes:
        """The ids of the shortest path over one word, as little-endian 32-bit integers."""
        if self.own.issuperset(text):
            found = self.shortest(text)
        else:  # a character without a piece stands alone on every path
            found = []
            for own, part in groupby(text, self.own.__contains__):
                found += self.shortest("".join(part)) if own else self.fallback("".join(part))
        return struct.pack(f"<{len(found)}I", *found)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.cut.findall(self.normalised(text))))

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def machine(path: str) -> Machine:
    return Machine(path)


def encode(docs: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, then ``ids`` (array of int) of ``text``, ``n_tokens``, ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit integers), ``decoded`` (the text that the ids give back) and ``round_trip`` (whether
    that is the text).

    ``model`` is the path of a SentencePiece model on every machine. A null text counts as empty: no ids, decoded empty.
    Bytes that are no UTF-8 are read as U+FFFD. A text with U+2581 itself does not come back as it was. Nothing is
    shuffled; texts of any length are whole; repeated rows are encoded one by one; an empty table gives an empty one.
    """

    def run(batches):
        fst = machine(model)
        for batch in pieces(batches, batch_text):
            texts = [
                "" if x is None else x.decode("utf-8", "replace")
                for x in batch.column(batch_text).cast(pa.large_binary()).to_pylist()
            ]
            coded = [fst.encode(x) for x in texts]
            back = [fst.decode(x) for x in coded]
            offsets = np.cumsum([0] + [len(x) // 4 for x in coded]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:batch_text],
                    ids,
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([zlib.crc32(x) for x in coded], pa.int64()),
                    pa.array(back, pa.string()),
                    pa.array([a == b for a, b in zip(texts, back)], pa.bool_()),
                ],
                names=[*batch.schema.names[:batch_text], "ids", "n_tokens", "ids_crc32", "decoded", "round_trip"],
            )

    batch_text = len(keep)
    kept = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:batch_text])
    return kept.mapInArrow(
        run, f"{schema}, ids array<int>, n_tokens long, ids_crc32 long, decoded string, round_trip boolean"
    )
