"""Alignment of two tokenizers over the same bytes, by skipping along diagonals of their end offsets.

Each tokenizer gives a text as a row of tokens, of which only the byte offsets of their ends matter. ``runs`` walks both
arrays of ends at once. The difference of the two positions is the shift; as long as tokens agree one to one, ends at
the same shift are equal, and a stretch of any length is passed by comparing slices that double while they agree; the lowest
bit in which two slices differ says where the stretch ends. Where ends differ, the smaller end steps on until both meet again: that is one irregular group,
and the shift behind it is the new one.

Units of text between single spaces come back all the time, so their alignment is remembered: the units that a worker
has not seen lately are joined to one text, encoded and walked, and cut apart again at the spaces, where tokens of both
sides end wherever the unit stands. A document is its units on end.

A pair of ids is counted once for each document that holds it linked. Texts are taken in blocks; a block carries its
distinct pairs, so that counts are summed over blocks and come back to blocks, not to documents.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.graph import stored
from tidewatch.llm.words import pieces, texts_of

#: A block ends with the document that reaches so many links.
BLOCK_LINKS = 1 << 19
#: Tokens that are compared first on a diagonal.
FIRST_STEP = 8
#: Characters of a text that are aligned at once.
PART_CHARS = 1 << 20
#: Units remembered per worker (as many again until that many new ones have come), and how long they may be.
REMEMBERED, LONGEST = 150_000, 100
BLANKS = {c for c in map(chr, range(0x3001)) if c.isspace()} | {"\u2581"}


def _units(text: str) -> list[str]:
    """The text cut at every space between two other characters, and nowhere else.

    At such a space both kinds of tokenizers begin a new token, whatever stands around it: a byte-level pattern takes a
    space only in front of what follows, and no piece has one behind other characters. So a unit with a space in front
    has the same tokens anywhere.
    """
    cut = text.split(" ")
    odd = [k for k, unit in enumerate(cut) if not unit or unit[0] in BLANKS or unit[-1] in BLANKS]
    if not odd:
        return cut
    out, at = [], 0
    for k in odd:  # a space next to a blank, or at an end, is no cut
        out += cut[at:k]
        unit = cut[k]
        if out and k and (not unit or unit[0] in BLANKS or not out[-1] or out[-1][-1] in BLANKS):
            out[-1] += " " + unit
        else:
            out.append(unit)
        at = k + 1
        if at < len(cut) and (not out[-1] or out[-1][-1] in BLANKS):
            out[-1] += " " + cut[at]
            cut[at] = out.pop()
    return out + cut[at:]


def _parts(text: str) -> list[str]:
    """A long text in parts of about ``PART_CHARS``, cut as ``_units`` does."""
    out, at = [], 0
    while len(text) - at > PART_CHARS:
        cut = text.find(" ", at + PART_CHARS, len(text) - 1)
        while cut > 0 and (text[cut - 1] in BLANKS or text[cut + 1] in BLANKS):
            cut = text.find(" ", cut + 1, len(text) - 1)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut + 1
    return [*out, text[at:]]


class Pair:
    """Two tokenizers: A by the tokenizers library (byte level), B by SentencePiece (with a space put in front)."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte_of = {chr(x): x for x in printable}
        byte_of |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(printable))}
        names = sorted((i, token) for token, i in self.a.get_vocab().items())
        self.bytes_a = [b""] * (names[-1][0] + 1)
        for i, token in names:
            known = all(c in byte_of for c in token)
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.sizes_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.known: dict[str, tuple | None] = {}
        self.before = self.known  # what was known until it was too much
        self.names_a = [str(i) for i in range(len(self.bytes_a))]
        self.names_b = [str(i) for i in range(len(self.bytes_b))]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B for a text with a space in front; None if either does not give its bytes back."""
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        whole = b" " + text.encode("utf-8", "replace")
        if b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b)):
            return np.array(a, np.int64), np.array(b, np.int64)
        return None

    def _learn(self, units: list[str]) -> dict[str, tuple | None]:
        """Units aligned, many of them as one text that is cut again where they end."""
        found = {}
        alone = [u for u in units if not u or u[0] in BLANKS or u[-1] in BLANKS]  # they begin or end a text
        units = list(set(units).difference(alone))
        for at in range(0, len(units), 256):
            some = units[at : at + 256]
            ids = self.encode(" ".join(some))
            if ids is None:  # one of them at least doesn't come back
                alone += some
                continue
            bounds = np.cumsum([1 + len(u.encode("utf-8", "replace")) for u in some])
            found.update(zip(some, Aligned(*ids, self).cut(bounds), strict=True))
        for unit in alone:
            own = self.encode(unit)
            found[unit] = None if own is None else Aligned(*own, self).cut(None)[0]
        return found

    def aligned(self, texts: list[str]) -> list[tuple | None]:
        """``(n_a, n_b, n_groups, groups, codes)`` of each text, ``codes`` being the id pair of every link; None where a
        tokenizer doesn't give the bytes back. Units that were seen lately are remembered."""
        cut = [_units(text) for text in texts]
        every = set(chain.from_iterable(cut))
        found = {u: self.before[u] for u in every - self.known.keys() if u in self.before}
        found |= self._learn(list(every - self.known.keys() - found.keys()))
        if len(self.known) + len(found) > REMEMBERED:
            found |= {u: self.known[u] for u in every if u in self.known}
            self.before, self.known = self.known, {}
        self.known |= found
        out = []
        for units in cut:
            coded = list(map(self.known.__getitem__, units))
            if None in coded:
                out.append(None)
                continue
            n_a, n_b, n_groups, told, codes = zip(*coded)
            out.append((sum(n_a), sum(n_b), sum(n_groups), ";".join(told), np.frombuffer(b"".join(codes), np.int64)))
        for unit in [u for u in found if len(u) > LONGEST]:
            del self.known[unit]
        return out


@lru_cache(maxsize=2)
def pair(a: str, b: str) -> Pair:
    return Pair(a, b)


def runs(x: np.ndarray, y: np.ndarray):
    """The groups between two arrays of ends (rising, with an equal last end): ``(i, j, n, 0)`` for ``n`` groups of one
    token each from positions ``i`` and ``j`` on, and ``(i, j, m, n)`` for a group of ``m`` and ``n`` tokens."""
    px, py = x.tobytes(), y.tobytes()
    ends_x, ends_y = x.tolist(), y.tolist()
    i = j = 0
    n, m = len(ends_x), len(ends_y)
    while i < n:
        if ends_x[i] == ends_y[j]:
            left, k, step = min(n - i, m - j), 1, FIRST_STEP
            while k < left:  # doubling while the diagonal goes on
                there, here = px[8 * (i + k) : 8 * (i + k + step)], py[8 * (j + k) : 8 * (j + k + step)]
                if there == here and len(there) == 8 * step:
                    k, step = k + step, 2 * step
                    continue
                differ = int.from_bytes(there, "little") ^ int.from_bytes(here, "little")
                k += ((differ & -differ).bit_length() - 1) // 64 if differ else left - k
                break
            k = min(k, left)
            yield i, j, k, 0
            i, j = i + k, j + k
        else:
            p, q = i, j
            while (a := ends_x[p]) != (b := ends_y[q]):
                if a < b:
                    p += 1
                else:
                    q += 1
            yield i, j, p + 1 - i, q + 1 - j
            i, j = p + 1, q + 1


class Aligned:
    """The groups of one text, and its links as positions in A and in B."""

    def __init__(self, a: np.ndarray, b: np.ndarray, tools: Pair):
        self.a, self.b = a, b
        self.x, self.y = np.cumsum(tools.sizes_a[a]), np.cumsum(tools.sizes_b[b])
        names_a, names_b = list(map(tools.names_a.__getitem__, a.tolist())), list(map(tools.names_b.__getitem__, b.tolist()))
        ends_x, ends_y = self.x.tolist(), self.y.tolist()
        self.groups, self.last = [], []  # each group as text, and its last token in A
        links = []  # a position in A and in B, and how many one-to-one links follow each other from there
        for i, j, m, n in runs(self.x, self.y):
            if not n:
                self.groups += map("|".join, zip(names_a[i : i + m], names_b[j : j + m]))
                self.last += range(i, i + m)
                links += i, j, m
                continue
            self.groups.append(",".join(names_a[i : i + m]) + "|" + ",".join(names_b[j : j + n]))
            self.last.append(i + m - 1)
            for _ in range(m + n - 1):  # tokens overlap from each end to the next of either side
                links += i, j, 1
                if ends_x[i] < ends_y[j]:
                    i += 1
                else:
                    j += 1
        left, right, many = np.array(links, np.int64).reshape(-1, 3).T
        ahead = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.left, self.right = np.repeat(left, many) + ahead, np.repeat(right, many) + ahead

    def cut(self, bounds: np.ndarray | None) -> list[tuple[int, int, int, str, bytes]]:
        """``n_a, n_b, n_groups, groups, codes`` of each stretch of bytes that ends at ``bounds``, where both sides have
        an end; of the whole without ``bounds``."""
        bounds = self.x[-1:] if bounds is None else bounds
        to_a, to_b = np.searchsorted(self.x, bounds) + 1, np.searchsorted(self.y, bounds) + 1
        if not ((self.x[to_a - 1] == bounds).all() and (self.y[to_b - 1] == bounds).all()):
            raise AssertionError("a unit does not end where tokens end")
        to_group = np.searchsorted(np.array(self.last), to_a - 1) + 1
        to_link = np.searchsorted(self.left, to_a - 1, "right")
        codes = ((self.a[self.left] << 32) | self.b[self.right]).tobytes()
        steps = [[0, *s.tolist()] for s in (to_a, to_b, to_group, to_link)]
        out = []
        for k in range(len(bounds)):
            (a, a2), (b, b2), (g, g2), (c, c2) = (s[k : k + 2] for s in steps)
            out.append((a2 - a, b2 - b, g2 - g, ";".join(self.groups[g:g2]), codes[8 * c : 8 * c2]))
        return out


_DOCS = [
    ("doc_ids", pa.list_(pa.int64())),
    ("n_a", pa.list_(pa.int64())),
    ("n_b", pa.list_(pa.int64())),
    ("n_groups", pa.list_(pa.int64())),
    ("n_links", pa.list_(pa.int64())),
    ("groups", pa.list_(pa.string())),
    ("held", pa.list_(pa.int32())),  # distinct pairs of each document
    ("places", pa.binary()),  # their places in ``pairs``
    ("times", pa.binary()),  # how often the document has them linked
    ("pairs", pa.list_(pa.int64())),  # distinct pairs of the block: A << 32 | B
    ("documents", pa.list_(pa.int64())),  # documents of the block that hold each
]
BLOCKS = (
    "doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>,"
    " groups array<string>, held array<int>, places binary, times binary, pairs array<long>, documents array<long>"
)


def _block(rows: list[tuple], codes: list[np.ndarray]) -> pa.RecordBatch:
    """``rows``: (doc_id, n_a, n_b, n_groups, n_links, groups); ``codes``: the id pair of every link of each."""
    found = [np.unique(c, return_counts=True) for c in codes]
    every = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
    pairs, places, documents = np.unique(every, return_inverse=True, return_counts=True)
    times = np.concatenate([f[1] for f in found]).astype(np.uint32)
    values = [
        *map(list, zip(*rows)),
        [len(f[0]) for f in found],
        places.astype(np.uint32).tobytes(),
        times.tobytes(),
        pairs.tolist(),
        documents.tolist(),
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array([v], kind) for v, (_, kind) in zip(values, _DOCS)], schema=pa.schema(_DOCS)
    )


def _documents(texts: list[str], tools: Pair, hashed: bool):
    """``n_a, n_b, n_groups``, the id pairs of all links, and the groups of each text; a long text in parts."""
    if all(len(text) <= PART_CHARS for text in texts):
        every = zip(texts, ([part] for part in tools.aligned(texts)))
    else:
        every = ((text, (tools.aligned([part])[0] for part in _parts(text))) for text in texts)
    for text, parts in every:
        counts, codes, told, digest = np.zeros(3, np.int64), [], [], hashlib.sha256()
        for part in parts if text else ():
            if part is None:
                codes = []
                break
            counts += part[:3]
            if hashed:
                digest.update((";" * bool(codes) + part[3]).encode())
            else:
                told.append(part[3])
            codes.append(part[4])
        if codes:
            yield *counts.tolist(), np.concatenate(codes), digest.hexdigest() if hashed else ";".join(told)
        else:
            yield 0, 0, 0, np.empty(0, np.int64), ""


def aligned_blocks(docs: DataFrame, a: str, b: str, hashed: bool = True) -> DataFrame:
    """Blocks of documents with their alignment, see ``_DOCS``; ``groups`` as text or as its SHA-256."""

    def run(batches):
        tools = pair(a, b)
        rows, codes, links = [], [], 0
        for batch in pieces(batches, 1):
            names = batch.column(0).to_pylist()
            texts = [text.decode("utf-8", "replace") for text in texts_of(batch.column(1))]
            for name, found in zip(names, _documents(texts, tools, hashed)):
                *numbers, code, text = found
                rows.append((name, *numbers, len(code), text))
                codes.append(code)
                links += len(code)
                if links >= BLOCK_LINKS or len(rows) >= BLOCK_LINKS // 16:
                    yield _block(rows, codes)
                    rows, codes, links = [], [], 0
        if rows:
            yield _block(rows, codes)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, BLOCKS)


def groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``doc_id, groups``: each document's groups as ``a1,a2|b1;a3|b2,b3``, ids of A and of B in order."""
    blocks = aligned_blocks(docs, a, b, hashed=False)
    return blocks.select(F.explode(F.arrays_zip("doc_ids", "groups")).alias("d")).select(
        F.col("d.doc_ids").alias("doc_id"), "d.groups"
    )


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``a_id, b_id, documents, best``: linked id pairs, in how many documents, and whether no pair of that A has more."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "documents")).alias("p")).select("p.*")
    counts = pairs.groupBy(F.col("pairs").alias("pair")).agg(F.sum("documents").alias("documents"))
    counts = counts.select(
        F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"), "documents"
    )
    most = counts.groupBy("a_id").agg(F.max("documents").alias("most"))
    return counts.join(most, "a_id").select("a_id", "b_id", "documents", (F.col("documents") == F.col("most")).alias("best"))


def _summed(batches):
    """Adds up, for each document of a block, the counts of its links and those that are their A's best."""
    for batch in batches:
        for row in range(batch.num_rows):
            value = {name: batch.column(name)[row] for name in batch.schema.names}
            held = np.array(value["held"].as_py(), np.int64)
            places = np.frombuffer(value["places"].as_py(), np.uint32)
            times = np.frombuffer(value["times"].as_py(), np.uint32).astype(np.int64)
            known = value["known"].values  # (place, count, best) of every pair of the block
            size = len(known) if known is not None else 0
            count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
            if size:
                at = known.field("place").to_numpy()
                count[at] = known.field("documents").to_numpy()
                best[at] = known.field("best").cast(pa.int64()).to_numpy()
            ends = np.concatenate([[0], np.cumsum(held)])
            sums = [np.concatenate([[0], np.cumsum(times * of[places])]) for of in (best, count)]
            columns = [value[n].values for n in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
            columns += [pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums]
            yield pa.RecordBatch.from_arrays([*columns, value["groups"].values], names=_RESULT)


_RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def alignment(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``; other columns are ignored): ``doc_id, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256``.

    A is a byte-level tokenizer of the tokenizers library that reads a space and the text, B a SentencePiece model that
    puts a space before the text; both are paths on every machine. Groups are cut where tokens of both end; links are
    all pairs of tokens whose bytes overlap, one more or fewer than tokens in a group (m + n - 1). ``n_best`` are links
    whose pair of ids is in as many documents as any pair of that A id (ties count), ``count_sum`` adds up over all
    links how many documents hold the pair.

    A null or empty text, and one that either tokenizer does not give back byte for byte, has no tokens: zeros and an
    empty string. Repeated rows are documents of their own, so are rows without a doc_id. A very long text is encoded in
    parts that are cut where both tokenizers cut anyway. An empty table gives an empty one.
    """
    blocks = stored(aligned_blocks(docs, a, b).withColumn("block", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(blocks), "pair-counts").withColumn("pair", F.shiftleft(F.col("a_id").cast("long"), 32) + F.col("b_id"))
    placed = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    known = (
        placed.join(counts, "pair")
        .groupBy("block")
        .agg(F.collect_list(F.struct("place", "documents", "best")).alias("known"))
    )
    told = blocks.drop("pairs", "documents").join(known, "block", "left")
    return told.mapInArrow(
        _summed,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )
