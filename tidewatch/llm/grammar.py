"""Token ids in binary shards, compressed by a grammar of repeated pairs (Re-Pair).

A shard is one binary value:

    magic "RPG1", then five little-endian unsigned 32-bit integers: documents, rules, symbols, terminals, index step
    documents x u32     tokens of each document
    rules x 2 x u32     the pair that each nonterminal stands for; rule k is the symbol ``terminals + k``
    rules x u32         how many tokens each nonterminal expands to
    (symbols / step rounded up) x u32   tokens before every ``step``-th symbol, for random access
    symbols x u32       the compressed sequence

Compression goes in rounds. A round counts all neighbouring pairs of the shard, and replaces each occurrence whose
pair is more frequent than the pairs that overlap it, as long as at least ``FEWEST`` occurrences of the pair go. Rounds
end when one shortens the sequence by less than a fiftieth. Rules only name earlier symbols.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"RPG1"
STEP = 256
FEWEST = 3
#: A round that replaces less than this part of the sequence is the last.
LEAST_GAIN = 0.02
SLOT_BITS = 20
#: Pairs more frequent than this in a shard rank alike.
MOST_RANKED = 4_095


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = (left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77) + (left >> np.uint32(7)))
    return (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - SLOT_BITS)


def compress(ids: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rules, lengths, symbols)`` of a sequence of ids below ``terminals``."""
    symbols, rules = ids.astype(np.uint32), []
    spans = np.ones(terminals, np.uint32)
    slots = 1 << SLOT_BITS
    shown, name, numbers = np.zeros(slots, np.uint64), np.zeros(slots, np.uint32), np.arange(slots, dtype=np.uint32)
    while len(symbols) > 2:
        slot = _slots(symbols[:-1], symbols[1:]).astype(np.int64)
        pair = symbols[:-1].astype(np.uint64)
        pair <<= np.uint64(32)
        pair |= symbols[1:]
        rank = np.bincount(slot, minlength=slots).astype(np.uint32)
        rank[rank < FEWEST] = 0
        np.minimum(rank, MOST_RANKED, out=rank)
        few = rank == 0
        rank <<= SLOT_BITS
        rank |= numbers
        rank[few] = 0
        shown[slot] = pair  # one pair per slot; others of the slot wait for a later round
        order = rank[slot]
        order[shown[slot] != pair] = 0
        # among overlapping occurrences the most frequent goes; of equal ones the leftmost, and slots settle other ties
        taken = order > 0
        taken[1:] &= order[1:] > order[:-1]
        taken[:-1] &= order[:-1] >= order[1:]
        at = np.flatnonzero(taken)
        where = slot[at]
        used = np.bincount(where, minlength=slots)
        enough = used[where] >= FEWEST
        at, where = at[enough], where[enough]
        if len(at) < max(1, LEAST_GAIN * len(symbols)):
            break
        kinds = np.flatnonzero(used >= FEWEST)
        pairs = np.stack([shown[kinds] >> np.uint64(32), shown[kinds] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        name[kinds] = np.arange(len(spans), len(spans) + len(kinds))
        rules.append(pairs)
        spans = np.concatenate([spans, spans[pairs[:, 0]] + spans[pairs[:, 1]]])
        symbols[at] = name[where]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    return table, spans[terminals:], symbols


def pack(sizes: list[int], ids: np.ndarray, terminals: int) -> bytes:
    rules, lengths, symbols = compress(ids, terminals)
    spans = np.concatenate([np.ones(terminals, np.uint32), lengths])[symbols] if len(symbols) else symbols
    index = np.concatenate([[0], np.cumsum(spans, dtype=np.int64)])[:-1][::STEP]
    head = struct.pack("<4s5I", MAGIC, len(sizes), len(rules), len(symbols), terminals, STEP)
    return head + b"".join(x.astype("<u4").tobytes() for x in (np.array(sizes, np.uint32), rules, lengths, index, symbols))


class Shard:
    """A packed shard, read without copying."""

    def __init__(self, data: bytes):
        magic, n_docs, n_rules, n_symbols, self.terminals, self.step = struct.unpack_from("<4s5I", data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize("<4s5I")
        parts = []
        for n in (n_docs, 2 * n_rules, n_rules, -(-n_symbols // self.step), n_symbols):
            parts.append(np.frombuffer(data, "<u4", n, at))
            at += 4 * n
        self.sizes, rules, self.lengths, self.index, self.symbols = parts
        self.rules = rules.reshape(-1, 2)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that a run of symbols stands for; each pass opens the outermost rules of all symbols."""
        while len(symbols) and int(symbols.max()) >= self.terminals:
            high = symbols >= self.terminals
            ends = np.cumsum(high) + np.arange(1, len(symbols) + 1)
            wide = np.empty(int(ends[-1]), np.uint32)
            pair = self.rules[symbols[high] - self.terminals]
            wide[ends[~high] - 1] = symbols[~high]
            wide[ends[high] - 2], wide[ends[high] - 1] = pair[:, 0], pair[:, 1]
            symbols = wide
        return symbols

    def ids(self) -> np.ndarray:
        """All ids: each rule is expanded once and copied to where its symbol stands."""
        alone = np.arange(self.terminals, dtype=np.uint32)
        every = np.concatenate([alone, self.expand(np.arange(self.terminals, self.terminals + len(self.rules), dtype=np.uint32))])
        sizes = np.concatenate([np.ones_like(alone), self.lengths]).astype(np.int64)
        starts = (np.cumsum(sizes) - sizes)[self.symbols]
        sizes = sizes[self.symbols]
        ends = np.cumsum(sizes)
        places = np.repeat(starts - ends + sizes, sizes)
        places += np.arange(len(places))
        return every[places]

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` without expanding the rest of the shard."""
        total = int(self.sizes.sum())
        start, stop = max(0, start), min(total, start + n)
        if stop <= start:
            return np.empty(0, np.uint32)
        low = int(np.searchsorted(self.index, start, "right")) - 1
        high = int(np.searchsorted(self.index, stop, "left"))
        symbols = self.symbols[low * self.step : high * self.step]
        skip = start - int(self.index[low])
        return self.expand(symbols)[skip : skip + stop - start]
