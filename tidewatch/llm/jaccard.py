"""N-gram Jaccard join: all links between shingle sets, found with signature trees.

1. Each text becomes the set of its shingle hashes; equal sets are one class, known by a 128-bit digest.
2. Classes that may link meet in blocks. The shingle universe is cut into more segments than two linked sets can
   differ in, so linked sets agree in at least one whole segment; shingles that very many texts have are left out of
   the segments of texts that have enough others. Linked sets agree in more than one segment from some 50 shingles on
   (``shared_at_least``), so two classes are candidates only when they agree in so many: texts that share a passage
   and little else don't meet, and their blocks don't grow together with the corpus. The connected candidates of the
   corpus are a block. Agreements are counted for the pairs of segments that at most ``FEW`` classes agree on; a segment
   of more makes candidates of all of them, as a star around the smallest class. Of more than ``FEW`` classes of a task
   only the first is told to the rest of the corpus, with the others tied to it once, so a segment that a third of all
   rows agree on has a row per task.
3. In each block a signature tree is built: its nodes hold OR-combined bitmaps of shingles (with the most shingles of
   one set on a bit) and size ranges. Traversing two trees at once, a pair of nodes whose largest possible overlap is
   below the need is dropped with all its pairs. Sets that meet in leaves are compared exactly.
4. A block above ``BLOCK_SETS`` sets or ``BLOCK_SHINGLES`` shingles is cut into parts, and every pair of parts is a
   task of its own, so a group that holds a third of all rows is spread out and no task holds more than two parts.
5. Components join what the tasks found. Within a task, two sets already known to be in one component aren't
   compared again: components need no second link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.graph import apart, components, stored
from tidewatch.llm.sieve import possible, sieve
from tidewatch.llm.words import mix, pieces, shingle_sets, text_digest, texts_of

BLOCK_SETS = 16_000
BLOCK_SHINGLES = 12_000_000
#: Shingles are counted in so many slots; a slot is frequent when its count exceeds the mean by ``OFTEN`` times the
#: mean's root and ``OFTEN_LEAST``. This decides only which way candidates meet, not which are found.
SLOTS = 1 << 19
OFTEN, OFTEN_LEAST = 6, 8
#: Keys that a task gathers before it tells them; rows and pairs that it gathers before it pairs and adds them up.
TOLD_KEYS = 4_000_000
MET_ROWS = 1_000_000
#: Agreements weigh so much that what two linked sets agree on comes to ``ENOUGH``: 6, 3, 2 or 1 each.
ENOUGH = 6
#: A segment is paired out if at most so many classes agree on it.
FEW = 32
#: Beside the six bytes of its number a told class has the weight of its agreement.
NODE_BITS = 48
#: Levels of segment counts rise by a half.
STEP = 1.5
FANOUT = 8
BITS = 128


def most_apart(elements: int, per_cent: int) -> int:
    """The largest symmetric difference of two linked sets that have ``elements`` together."""
    return (100 - per_cent) * elements // (100 + per_cent)


def levels(most: int) -> list[int]:
    """Upper ends of the levels of ``most_apart``, up to the one that holds ``most``."""
    ends = [1]
    while ends[-1] < most:
        ends.append(int(np.ceil(ends[-1] * STEP)))
    return ends


def slots_of(shingles: np.ndarray) -> np.ndarray:
    return ((shingles >> np.uint64(8)) & np.uint64(SLOTS - 1)).astype(np.int64)


def segments_of(shingles: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each segment that holds ``least`` of the sorted shingles or more, and those segments."""
    if not len(shingles):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    at = (shingles >> np.uint64(32)) * np.uint64(segment_count(most)) >> np.uint64(32)  # rises with the shingles
    first = np.flatnonzero(np.diff(at, prepend=np.uint64(segment_count(most))))
    sums = np.add.reduceat(mix(shingles + np.uint64(1)), first)
    full = np.diff(first, append=len(shingles)) >= least
    first = first[full]
    return mix(sums[full] + mix(at[first] + np.uint64((8 * most + least) << 32))), at[first]


def segment_count(most: int) -> int:
    return most + 2 + most // 4


def shared_at_least(most: int) -> int:
    """In how many segments that count two linked sets agree, for their keys of the level ``most``. Small sets have too
    few segments to spare any."""
    return 1 if most < 12 else 2 if most < 27 else 3 if most < 62 else 6


def full_segment(per_cent: int) -> int:
    """How many shingles a segment should hold to count, from how many the segments of a set hold in the mean."""
    return max(1, (100 + per_cent) * 2 // (9 * (100 - per_cent)))


def segment_keys(shingles: np.ndarray, rare: np.ndarray, most: int, least: int) -> np.ndarray:
    """Keys for partners that differ in at most ``most`` elements.

    Segments are filled with rare shingles only, and those with fewer than ``least`` don't count, so that texts don't
    meet for a passage that very many have or for five words in common. An element that differs spoils one segment, so
    a set with ``most`` segments that count and ``shared_at_least`` more agrees with each partner in so many. Any other
    set also gives keys for all segments with rare shingles, and if those are too few for all segments of all its
    shingles, at last the empty ones included; two such sets meet there.
    """
    enough = most + shared_at_least(most)
    keys, filled = segments_of(rare, most, least)
    if len(filled) < enough and least > 1:
        more, filled = segments_of(rare, most, 1)
        keys = np.concatenate([keys, more])
    if len(filled) >= enough:
        return keys
    whole, filled = segments_of(shingles, most, 1)
    whole = mix(whole)
    if len(filled) >= enough:
        return np.concatenate([keys, whole])
    empty = np.setdiff1d(np.arange(segment_count(most), dtype=np.uint64), filled)
    return np.concatenate([keys, whole, mix(mix(empty + np.uint64(most << 32)) ^ np.uint64(0x5EED))])


def weighted_keys(shingles: np.ndarray, per_cent: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their weights, such that the keys two different linked sets share weigh ``ENOUGH`` or more; none for sets
    too small to link with a different one.

    Two sets meet on the level that holds what they may differ in; a set gives keys for the levels of all its partners.
    ``frequent`` says which slots of shingles are frequent; any choice that is the same for all sets is right.
    """
    n = len(shingles)
    largest = most_apart(n + n * 100 // per_cent, per_cent)
    if largest < 1:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    smallest = max(1, most_apart(n + -(-n * per_cent // 100), per_cent))
    ends = levels(largest)
    ends = ends[int(np.searchsorted(ends, smallest)) :]
    rare = shingles if frequent is None else shingles[~frequent[slots_of(shingles)]]
    least = full_segment(per_cent)
    keys = [segment_keys(shingles, rare, e, least) for e in ends]
    weights = np.repeat(np.array([ENOUGH // shared_at_least(e) for e in ends], np.uint64), [len(k) for k in keys])
    return np.concatenate(keys), weights


def candidate_keys(shingles: np.ndarray, per_cent: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """Keys such that two different linked sets share one."""
    return weighted_keys(shingles, per_cent, frequent)[0]


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def node_of(name: bytes) -> int:
    """The number of a class among candidates, of six bytes to keep the shuffle small. Two classes with one number only
    share a block; classes themselves are compared by their digests."""
    return int.from_bytes(name[:6], "little")


ROWS = "doc_id long, version long, n_shingles long, class binary, node long, counts binary"


def _classes(size: int):
    def batch_of(ids, versions, sets, names, counts):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
        columns = (ids, versions, [len(s) if s is not None else None for s in sets], names, [n and node_of(n) for n in names], counts)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in ROWS.split(", ")])

    def run(batches):
        seen, counts = set(), np.zeros(SLOTS, np.int64)
        for batch in pieces(batches, 1):
            sets = shingle_sets(texts_of(batch.column(1)), size)
            names = [digest(s) for s in sets]
            new = [s for n, s in dict(zip(names, sets)).items() if n not in seen]
            seen.update(names)
            counts += np.bincount(slots_of(np.concatenate([*new, np.empty(0, np.uint64)])), minlength=SLOTS)
            yield batch_of(*(batch.column(k).to_pylist() for k in (0, 2)), sets, names, [None] * len(sets))
        if seen:  # one more row: how many sets of this task have a shingle in each slot
            yield batch_of([None], [None], [None], [None], [counts.tobytes()])

    return run


def _slot_counts(batches):
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for row in batch.column(0).to_pylist():
            counts += np.frombuffer(row, np.int64)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])


def frequent_slots(counts: DataFrame) -> np.ndarray:
    """Which slots have clearly more shingles than the mean of all, from the counts of all tasks.

    A passage that very many texts have stands out however large the corpus is. At most ``SLOTS`` numbers reach the
    driver, and only those of frequent slots.
    """
    sums = counts.mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    sums = stored(sums, "slots")
    mean = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / SLOTS
    frequent = np.zeros(SLOTS, bool)
    for row in sums.where(F.col("n") > mean + OFTEN * mean**0.5 + OFTEN_LEAST).select("slot").collect():
        frequent[row[0]] = True
    return frequent


def weighted(nodes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return nodes | (weights << np.uint64(NODE_BITS))


def parted(told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and weights of told classes."""
    return told & np.uint64((1 << NODE_BITS) - 1), told >> np.uint64(NODE_BITS)


def combined(keys: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same agreements in fewer rows: of a key with more than ``FEW`` nodes, or of which one agreement is enough, only
    the first node, and each other node tied to that once."""
    order = np.argsort(keys, kind="stable")
    keys, told = keys[order], told[order]
    first = np.append(True, keys[1:] != keys[:-1])
    group = np.cumsum(first) - 1
    sizes = np.bincount(group)
    nodes, weights = parted(told)
    heavy = ((sizes > FEW) | ((sizes > 1) & (weights[first] >= ENOUGH)))[group]
    lead = nodes[first][group]
    tied = np.unique(np.stack([lead, nodes])[:, heavy & (lead != nodes)], axis=1)
    names, whole = mix(tied[0] ^ np.uint64(0x71ED)), np.uint64(ENOUGH)
    kept = [told[~heavy], *(weighted(n, whole) for n in (nodes[first & heavy], tied[0], tied[1]))]
    return np.concatenate([keys[~heavy], keys[first & heavy], names, names]), np.concatenate(kept)


def _told(size: int, per_cent: int, frequent: np.ndarray):
    def out(keys, nodes):
        told = combined(np.concatenate(keys), np.concatenate(nodes))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in told], names=["key", "node"])

    def run(batches):
        seen, keys, nodes, n = set(), [], [], 0  # a class of this task tells its keys once
        for batch in pieces(batches, 0):
            for s in shingle_sets(texts_of(batch.column(0)), size):
                name = digest(s)
                if name not in seen:
                    seen.add(name)
                    own, weights = weighted_keys(s, per_cent, frequent)
                    keys.append(own)
                    nodes.append(weighted(np.uint64(node_of(name)), weights))
                    n += len(own)
            if n >= TOLD_KEYS:
                yield out(keys, nodes)
                keys, nodes, n = [], [], 0
        if n:
            yield out(keys, nodes)

    return run


def met(keys: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of nodes that agree on one of the keys, the smaller one first, and what their agreements weigh.

    All pairs of a key with few nodes; for any other and where one agreement is enough a star around the smallest node.
    """
    nodes, weights = parted(told)
    order = np.lexsort((nodes, keys))
    keys, nodes, weights = keys[order], nodes[order], weights[order]
    first = np.append(True, keys[1:] != keys[:-1])
    heaviest = np.maximum.reduceat(weights, np.flatnonzero(first))
    own = first | np.append(True, nodes[1:] != nodes[:-1])  # a node that several tasks told counts once
    group, nodes = (np.cumsum(first) - 1)[own], nodes[own]
    sizes = np.bincount(group)
    starts = np.cumsum(sizes) - sizes
    heavy = (sizes > FEW) | (heaviest >= ENOUGH)
    around = heavy[group] & (nodes != nodes[starts][group])
    out = [(nodes[starts][group][around], nodes[around], np.full(int(around.sum()), ENOUGH, np.uint64))]
    for n in range(2, FEW + 1):
        at = np.flatnonzero((sizes == n) & ~heavy)
        if len(at):
            i, j = np.triu_indices(n, 1)
            rows = nodes[starts[at][:, None] + np.arange(n)]
            out.append((rows[:, i].ravel(), rows[:, j].ravel(), np.repeat(heaviest[at], len(i))))
    return tuple(np.concatenate(x) for x in zip(*out))


def added_up(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, with the sum of its weights up to ``ENOUGH``."""
    order = np.lexsort((b, a))
    a, b, weights = a[order], b[order], weights[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, np.int64)
    sums = np.minimum(np.add.reduceat(weights, first), np.uint64(ENOUGH)) if len(a) else weights
    return a[first], b[first], sums


def _met(batches):
    """Reads told rows sorted by key. What is held: ``MET_ROWS`` rows and pairs, and the rows of one key, which are at most
    ``FEW`` for each time that a task tells."""

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in added_up(*map(np.concatenate, zip(*found)))], names=["a", "b", "w"])

    rows, n, found, pairs = [], 0, [], 0
    for batch in batches:
        keys, told = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns[:2])
        rows.append((keys, told))
        n += len(keys)
        if n >= MET_ROWS:
            keys, told = map(np.concatenate, zip(*rows))
            cut = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1]))  # the last key may go on
            rows, n = [(keys[cut:], told[cut:])], len(keys) - cut
            if cut:
                found.append(met(keys[:cut], told[:cut]))
                pairs += len(found[-1][0])
        if pairs >= MET_ROWS:
            yield out(found)
            found, pairs = [], 0
    if n:
        found.append(met(*map(np.concatenate, zip(*rows))))
    if found:
        yield out(found)


class Tree:
    """A signature tree over sets in the given order: levels of (bitmap, smallest, largest), leaves first."""

    def __init__(self, sets: list[np.ndarray], order: np.ndarray):
        self.order = order
        counts = np.zeros((len(order), BITS), np.int32)
        for row, k in enumerate(order):
            counts[row] = np.bincount((sets[k] & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS)
        sizes = np.array([len(sets[k]) for k in order])
        self.levels = [(counts, sizes, sizes)]
        while len(self.levels[-1][0]) > 1:
            below, low, high = self.levels[-1]
            cut = np.arange(0, len(below), FANOUT)
            self.levels.append((np.maximum.reduceat(below, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def below(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0])))


def pairs_above(a: Tree, b: Tree, per_cent: int, same: bool):
    """Pairs of sets (positions in the trees) that no bound excludes, by traversing both trees at once."""
    todo = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while todo:
        la, i, lb, j = todo.pop()
        if la == 0 and lb == 0:
            yield i, j
            continue
        down_a, down_b = la >= lb, lb >= la
        xs = a.below(la, i) if down_a else np.array([i])
        ys = b.below(lb, j) if down_b else np.array([j])
        ka, kb = la - down_a, lb - down_b
        (bits_a, low_a, high_a), (bits_b, low_b, high_b) = a.levels[ka], b.levels[kb]
        overlap = np.minimum(bits_a[xs][:, None, :], bits_b[ys][None, :, :]).sum(-1)
        small, large = np.maximum(low_a[xs][:, None], 0), np.maximum(low_b[ys][None, :], 0)
        can = overlap * (100 + per_cent) >= per_cent * (small + large)
        can &= (high_a[xs][:, None] * 100 >= per_cent * large) & (high_b[ys][None, :] * 100 >= per_cent * small)
        for p, q in zip(*np.nonzero(can)):
            x, y = int(xs[p]), int(ys[q])
            if not same or ka != kb or x < y or (x == y and ka > 0):
                todo.append((ka, x, kb, y))


def linked(x: np.ndarray, y: np.ndarray, per_cent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= per_cent * (len(x) + len(y) - both)


def joined(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, per_cent: int) -> np.ndarray:
    """For each set the smallest position of its component, by links inside ``left`` or between ``left`` and ``right``."""
    top = np.arange(len(sets))

    def find(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = int(top[k])
        return k

    def by_size(part: np.ndarray) -> np.ndarray:
        return part[np.lexsort(([int(sets[k][0]) for k in part], [len(sets[k]) for k in part]))]

    a = Tree(sets, by_size(left))
    b = a if right is None else Tree(sets, by_size(right))
    for i, j in pairs_above(a, b, per_cent, right is None):
        x, y = int(a.order[i]), int(b.order[j])
        rx, ry = find(x), find(y)
        if rx != ry and linked(sets[x], sets[y], per_cent):
            top[max(rx, ry)] = min(rx, ry)
    return np.array([find(k) for k in range(len(sets))])


def _blocks(size: int, per_cent: int):
    """Reads rows sorted by block; the sets of one block are held at a time."""

    def solve(rows):
        names = [r[0] for r in rows]
        sets, sides = [r[1] for r in rows], np.array([r[2] for r in rows])
        if sides.min() < 0:  # a whole block, or one part with itself
            roots = joined(sets, np.arange(len(sets)), None, per_cent)
        elif sides.min() == sides.max():  # the other part has no sets
            return []
        else:
            roots = joined(sets, np.flatnonzero(sides == 0), np.flatnonzero(sides == 1), per_cent)
        return [(names[k], names[r]) for k, r in enumerate(roots.tolist()) if k != r]

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        now, rows, names = None, [], set()
        for batch in pieces(batches, 5):
            columns = [c.to_pylist() for c in batch.columns[:5]]
            for block, name, side, sets in zip(zip(*columns[:3]), columns[3], columns[4], shingle_sets(texts_of(batch.column(5)), size)):
                if block != now:
                    if len(rows) > 1:
                        yield out(solve(rows))
                    now, rows, names = block, [], set()
                if name not in names and digest(sets) == name:  # a repeated doc_id may stand for several texts
                    names.add(name)
                    rows.append((name, sets, side))
        if len(rows) > 1:
            yield out(solve(rows))

    return run


def candidate_pairs(docs: DataFrame, size: int, per_cent: int, frequent: np.ndarray) -> DataFrame:
    """Numbers of classes whose agreements are enough for a link; connected, they are the blocks."""
    told = docs.select("text").mapInArrow(_told(size, per_cent, frequent), "key long, node long")
    pairs = told.repartition("key").sortWithinPartitions("key").mapInArrow(_met, "a long, b long, w long")
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("w")).where(F.col("w") >= ENOUGH).select("a", "b")


def _rooted(docs: DataFrame, size: int, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their classes, and the classes with the roots of their components."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = stored(docs.withColumn("version", text_digest()).mapInArrow(_classes(size), ROWS), "sets")
    frequent = frequent_slots(found.where("counts IS NOT NULL").select("counts"))
    rows = found.where("class IS NOT NULL").drop("counts")
    blocks = components(candidate_pairs(docs, size, per_cent, frequent))
    classes = (
        rows.where("n_shingles > 0")
        .groupBy("class")
        .agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n"), F.first("node").alias("node"))
    )
    members = stored(blocks.join(classes, "node").select("class", F.col("root").alias("block"), "first_doc", "n"), "members")
    parts = members.groupBy("block").agg(
        F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_SETS)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("parts")
    ).where("parts >= 1")
    placed = members.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("class", "block"), "parts").cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "block",
        F.least("part", "other").alias("i"),
        F.greatest("part", "other").alias("j"),
        "class",
        F.expr("CASE WHEN part = other THEN -1 WHEN part < other THEN 0 ELSE 1 END").alias("side"),
        "first_doc",
    )
    wanted = members.select("first_doc", "class").hint("merge")
    candidates = docs.where(possible(sieve(members.select("first_doc")), F.col("doc_id")))
    texts = candidates.join(wanted, candidates["doc_id"].eqNullSafe(F.col("first_doc"))).select("class", "text")
    work = spread.join(texts, "class").select("block", "i", "j", "class", "side", "text")
    links = (
        work.repartition("block", "i", "j")
        .sortWithinPartitions("block", "i", "j")
        .mapInArrow(_blocks(size, per_cent), "a binary, b binary")
    )
    roots = components(links)
    known = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    return rows, known


def jaccard_components(docs: DataFrame, size: int = 5, per_cent: int = 80) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``; other columns are ignored): ``doc_id, n_shingles, component_id``.

    Two documents link when ``100 * |both| >= per_cent * |either|`` for their distinct ``size``-word shingles of the
    text with A-Z lower-cased. ``component_id`` is the smallest doc_id that links reach.

    A null or empty text, or one without words, has no shingles and is linked with nothing: its component is its own
    doc_id. Fewer than ``size`` words are one shingle. Repeated rows come back as often as they came; rows of one
    doc_id with different texts are documents of their own. A null doc_id is the component of its row only where no
    other doc_id is reached. An empty table gives an empty one.

    The join of texts with candidates is a sort-merge join at every size: the candidates grow with the copies in the
    corpus. Memory: a task holds two parts of a block at most. Shuffled: the keys (16 bytes; about a fifth of the
    shingles at 90 per cent, three fifths at 80), and the texts of
    candidates (with a bitmap of fixed size that says which rows are none). Nothing but whether
    links are left reaches the driver.
    """
    rows, known = _rooted(docs, size, per_cent)
    least = known.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = known.join(apart(least, "root"), F.struct(F.col("root").alias("k")) == F.col("key")).select("class", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("n_shingles > 0").join(named, "class").select("doc_id", "n_shingles", "component_id").union(alone)


def jaccard_groups(docs: DataFrame, size: int = 5, per_cent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc_id, version, root``, by the links of ``jaccard_components``.

    ``version`` is the digest of the row's text, so that texts of one doc_id (or of none) are told apart; ``root`` is the
    same for the texts of one component, and null for a text without shingles.
    """
    rows, known = _rooted(docs, size, per_cent)
    of = apart(known.select("class", "root"), "class")
    named = rows.where("n_shingles > 0").join(of, F.struct(F.col("class").alias("k")) == F.col("key"))
    alone = rows.where("n_shingles = 0").select("doc_id", "version", F.lit(None).cast("binary").alias("root"))
    return named.select("doc_id", "version", "root").union(alone)
