"""License scans by patience alignment of texts with license notices.

Where a notice may begin, a window of the text is aligned with its template: equal words at both ends are matched, then
the words that occur once in the window and once in the template are anchors; the longest increasing run of anchors is
kept, and the gaps between them are aligned the same way. The coverage is the share of the template's words matched.

Nothing is skipped that could reach the least coverage: a match has to hold one of the template's ``keys`` (words that
make up more than the share that may be missing), and to begin with one of the words at its front.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.words import pieces, texts_of

LEAST_COVERAGE = 0.8
#: A window is so many times as long as the template: words that were put in don't end a match.
ROOM = 1.5
EDGES = b".,;:!?()[]{}\"'*#/<>-_|$%&"

# Short sentences that refer to a license.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Proprietary": "All rights reserved.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software."
    ),
}
#: The licenses' own notices and full texts, a file each; those named -notice or -text of one place are rivals.
TEXTS = Path(__file__).with_name("license_texts")


def all_templates() -> dict[str, str]:
    return TEMPLATES | {f.stem: f.read_text(encoding="utf-8") for f in sorted(TEXTS.glob("*.txt"))}


def rivals(name: str) -> str:
    """Templates of one group share most of their words, so of their matches that overlap the best one counts."""
    if name in ("CC-BY-4.0", "CC-BY-SA-4.0"):
        return "cc"
    end = name.rsplit("-", 1)[-1]
    return end if end in ("notice", "text") else name


def best(found: list[tuple]) -> list[tuple]:
    """Of matches ``(license, start, words, matched, ...)`` of rivals that overlap, the one with most matched words,
    then the shortest template."""
    kept: list[tuple] = []
    for m in sorted(found, key=lambda m: (-m[3], m[4], m[0], m[1])):
        if all(rivals(m[0]) != rivals(k[0]) or m[0] == k[0] or m[1] + m[2] <= k[1] or k[1] + k[2] <= m[1] for k in kept):
            kept.append(m)
    return [m for m in found if m in kept]


def normal(words: list[bytes]) -> list[bytes]:
    """Lower case without punctuation at the ends; a word of punctuation only is empty."""
    return [w.lower().strip(EDGES) for w in words]


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by rising first numbers, whose second numbers rise, too."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[pile], piles[pile] = b, k
        before.append(piles[pile - 1] if pile else -1)
    found, k = [], piles[-1] if piles else -1
    while k >= 0:
        found.append(pairs[k])
        k = before[k]
    return found[::-1]


def aligned(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched positions of two word lists, by patience."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            found.append((m, n))
        if i == m or j == n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        place = {w: k for k, w in enumerate(b[j:n], j) if in_b[w] == 1 and in_a[w] == 1}
        anchors = rising([(k, place[w]) for k, w in enumerate(a[i:m], i) if w in place])
        if anchors:
            found += anchors
            edges = [(i - 1, j - 1), *anchors, (m, n)]
            todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:])]
    return sorted(found)


class Template:
    def __init__(self, name: str, text: str, least: float):
        self.name, self.words = name, [w for w in normal(text.encode().split()) if w]
        size = len(self.words)
        self.need = -(-int(least * 1000) * size // 1000)
        self.spare = size - self.need
        self.front = set(self.words[: self.spare + 1])
        self.counts, self.room = Counter(self.words), int(ROOM * size) + 1
        self.keys: list[bytes] = []
        covered = 0
        for word in sorted(self.counts, key=len, reverse=True):
            if covered > self.spare:
                break
            self.keys.append(word)
            covered += self.counts[word]

        self.least_bytes = sum(sorted(map(len, self.words))[: self.need]) + self.need - 1
        self.bits: dict[bytes, int] = {}

    def common(self, words: list[bytes]) -> int:
        """The length of the longest common subsequence of the words and the template, by bit-parallel rows."""
        if not self.bits:
            for k, w in enumerate(self.words):
                self.bits[w] = self.bits.get(w, 0) | 1 << k
        full = row = (1 << len(self.words)) - 1
        for w in words:
            if hit := row & self.bits.get(w, 0):
                row = (row + hit | row - hit) & full
        return len(self.words) - row.bit_count()

    def matches(self, words: list[bytes]):
        """``(first word, words, matched)`` of each part of the text that covers the template, from left to right.

        A window that fails with a longest common subsequence of so many words can't reach the need before as many
        steps as are missing, so those starts are passed over.
        """
        at = upto = both = 0
        held = dict.fromkeys(self.counts, 0)
        while len(words) - at >= self.need:
            end, step = min(len(words), at + self.room), 1
            for w in words[upto:end]:
                if w in held:
                    held[w] += 1
                    both += held[w] <= self.counts[w]
            upto = end
            if both >= self.need and words[at] in self.front:
                window = words[at:end]
                pairs = aligned(window, self.words)
                if len(pairs) >= self.need:
                    first, last = pairs[0][0], pairs[-1][0]
                    yield at + first, last - first + 1, len(pairs)
                    step = last + 1
                else:
                    step = max(1, self.need - self.common(window))
            for w in words[at : at + step]:
                if w in held:
                    both -= held[w] <= self.counts[w]
                    held[w] -= 1
            at += step


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """A row per notice found in ``docs`` (``doc_id``, ``text``; other columns are ignored):

    ``doc_id, license, start_word, n_words, matched, template_words, coverage``. Words are runs of bytes other than
    0x20 and 0x09-0x0D, compared in lower case without punctuation at their ends. A notice counts as found when
    ``least`` of its template's words are matched in order within a window of ``ROOM`` times its length; matches of
    one template don't overlap, and those of different templates may; of overlapping matches of rival notices or rival
    full texts (versions of the GPL, clauses of the BSD license) the best is told.

    Null and empty texts have no notice. Repeated rows give their notices each. An empty table gives an empty one.
    """
    known = [Template(name, text, least) for name, text in (templates or all_templates()).items()]
    keys = {k for t in known for k in t.keys}
    schema = "license string, start_word long, n_words long, matched long, template_words long, coverage double"

    def run(batches):
        for batch in pieces(batches, 1):
            rows, found = [], []
            for row, text in enumerate(texts_of(batch.column(1))):
                words = normal(text.lower().split())
                present = keys.intersection(words)
                likely = [t for t in known if len(text) >= t.least_bytes and not present.isdisjoint(t.keys)] if present else []
                matches = [(t.name, a, n, m, len(t.words), m / len(t.words)) for t in likely for a, n, m in t.matches(words)]
                told = best(matches)
                rows += [row] * len(told)
                found += told
            columns = list(zip(*found)) if found else [[]] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]],
                names=["doc_id", *[part.split()[0] for part in schema.split(", ")]],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {schema}")
