"""Periodic runs of words by a suffix automaton with ordered end-position sets.

A run is a stretch of consecutive words of smallest period q, at least max(24, 3 q) words long, that no neighbouring word
extends with that period. The suffix automaton of the words is built, and its states are visited from the longest to the
shortest, so that each hands its ordered set of end positions to its suffix link, the smaller set going into the larger.
Two ends that become neighbours in a state whose length is at least their distance stand for a square; it is extended both
ways as far as its period holds. Of stretches with equal bounds the smallest period counts.

Only stretches that can hold a run are given to the automaton: every 8 consecutive words of a run occur again q words
away, within the run, so the others are left out by a vectorised comparison of hashes. Equal hashes of different words only
let more stretches through; the automaton compares the words themselves.

Defined results: null and empty texts have no words and no run; a row without doc_id is not edited; repeated rows are rows of
their own; a text of any length is one row and so one task's; empty tables give empty results; other columns are not looked
at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .tokens import text_slices

LEAST_LENGTH, LEAST_EXPONENT = 24, 3
#: Words of a gram of which each occurs twice in a run: a run of period q has at least 2 q + 8 words.
GRAM = 8
Run = tuple[int, int, int]  # start, length, period

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def automaton(words: Sequence) -> tuple[list[int], list[int]]:
    """Lengths and suffix links of the states; state 0 is the root."""
    steps: list[dict] = [{}]
    length, link, last = [0], [-1], 0
    for word in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        steps.append({})
        at = last
        while at >= 0 and word not in steps[at]:
            steps[at][word] = new
            at = link[at]
        if at >= 0:
            to = steps[at][word]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                clone = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                steps.append(dict(steps[to]))
                while at >= 0 and steps[at].get(word) == to:
                    steps[at][word] = clone
                    at = link[at]
                link[to] = link[new] = clone
        last = new
    return length, link


class Stretches:
    """Maximal stretches with a given period, found so far, by period."""

    def __init__(self, words: Sequence):
        self.words, self.found = words, {}

    def seed(self, low: int, high: int, period: int) -> None:
        """Words low to high, bounds included, have the period: extend them, unless a known stretch holds them."""
        starts, stops = self.found.setdefault(period, ([], []))
        at = bisect_right(starts, low)
        if at and stops[at - 1] >= high:
            return
        words, n = self.words, len(self.words)
        while low and words[low - 1] == words[low - 1 + period]:
            low -= 1
        while high + 1 < n and words[high + 1] == words[high + 1 - period]:
            high += 1
        at = bisect_left(starts, low)
        starts.insert(at, low)
        stops.insert(at, high)

    def runs(self) -> list[Run]:
        smallest: dict[tuple[int, int], int] = {}
        for period, (starts, stops) in self.found.items():
            for a, b in zip(starts, stops, strict=True):
                if b - a + 1 >= max(LEAST_LENGTH, LEAST_EXPONENT * period):
                    smallest[a, b] = min(period, smallest.get((a, b), period))
        return sorted((a, b - a + 1, q) for (a, b), q in smallest.items())


def automaton_runs(words: Sequence) -> list[Run]:
    """All runs of a sequence, by start and period."""
    length, link = automaton(words)
    # Ends are kept negated: states come from the longest to the shortest, so most ends go to the back of a list.
    ends: list[list[int] | None] = [None] * len(length)
    at = 0
    for i in range(len(words)):
        at += 1
        while length[at] != i + 1:  # states of prefixes come in order, with clones between them
            at += 1
        ends[at] = [-i]
    stretches, most = Stretches(words), len(words) // LEAST_EXPONENT
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        above, mine = link[state], ends[state]
        if not above:
            ends[state] = None
            continue
        theirs, ends[state] = ends[above], None
        if theirs is None:
            ends[above] = mine
            continue
        if len(theirs) < len(mine):
            theirs, mine = mine, theirs
        reach = min(length[above], most)
        for end in mine:
            i = bisect_left(theirs, end)
            for other in theirs[max(i - 1, 0) : i + 1]:
                distance = abs(end - other)
                if distance <= reach:
                    first = -max(end, other)
                    stretches.seed(first - length[above] + 1, first + distance, distance)
            theirs.insert(i, end)
        ends[above] = theirs
    return stretches.runs()


def spread(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the stretches of marked places."""
    edges = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def candidates(hashes: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, stop) of the stretches of words that can hold a run; hashes of the words of all texts, one after the
    other, and the number of words of each text."""
    n = len(hashes) - GRAM + 1
    if n < LEAST_LENGTH - GRAM + 1:
        return []
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    gram, width = hashes.view(np.uint64), 1
    while width < GRAM:
        gram, width = (gram[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width)) ^ (gram[width:] + (gram[width:] >> np.uint64(31))), 2 * width
    gram = gram + owner[:n].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    inside = owner[:n] == owner[GRAM - 1 :]
    order = np.argsort(gram, kind="stable")
    gap = np.diff(order)
    gap[(np.diff(gram[order]) != 0) | (owner[order][1:] != owner[order][:-1])] = len(hashes)
    near = np.full(n, len(hashes), np.int64)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    least = LEAST_LENGTH - GRAM + 1
    marked = inside & (near <= sizes[owner[:n]] // LEAST_EXPONENT)
    for _ in range(2):  # once more with the length of the stretch as the bound of the period
        starts, stops = spread(marked & np.concatenate([[True], owner[1:n] == owner[: n - 1]]))
        # A stretch that a text's end cuts in two starts one place late; put that place back.
        starts = np.where((starts > 0) & marked[starts - 1] & (owner[starts - 1] == owner[starts]), starts - 1, starts)
        reach = np.zeros(n, np.int64)
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            reach[a:b] = (b - a + GRAM - 1) // LEAST_EXPONENT if b - a >= least else 0
        marked = marked & (near <= reach)
    starts, stops = spread(marked)
    found = []
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        for t in range(int(owner[a]), int(owner[b - 1]) + 1):
            low, high = max(a, int(first[t])), min(b, int(first[t] + sizes[t]) - GRAM + 1)
            if high - low >= least:
                found.append((t, low - int(first[t]), high - int(first[t]) + GRAM - 1))
    return found


def edited(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the query takes them: a tenth of the documents go on with a period from some word on."""
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    cycle = words[start : start + period]
    return words[:start] + (cycle * (-(-(n - start) // len(cycle))))[: n - start]


def digest(words: list[bytes], runs: list[Run]) -> tuple:
    """What a result row holds after doc_id."""
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None, None, None, None)
    kept = words
    if runs:
        dropped = np.zeros(len(words), bool)
        for start, length, period in runs:
            dropped[start + period : start + length] = True
        kept = [w for w, gone in zip(words, dropped.tolist(), strict=True) if not gone]
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def batch_runs(texts: list[list]) -> list[list[Run]]:
    """The runs of each of several lists of words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    hashes = np.fromiter((hash(w) for t in texts for w in t), np.int64, int(sizes.sum()))
    found: list[set[Run]] = [set() for _ in texts]
    for t, a, b in candidates(hashes, sizes):
        found[t].update((a + start, length, period) for start, length, period in automaton_runs(texts[t][a:b]))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def periodic_runs(docs: DataFrame, edit=edited) -> DataFrame:
    """One row per document; `edit` is applied to its words first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                ids = batch.column(0).slice(at, len(texts)).to_pylist()
                words = [edit((t or b"").split(), i) for i, t in zip(ids, texts.cast(pa.binary()).to_pylist(), strict=True)]
                rows = [(i, *digest(w, r)) for i, w, r in zip(ids, words, batch_runs(words), strict=True)]
                columns = zip(*rows, strict=True)
                kinds = [pa.int64()] * 6 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), scan, SCHEMA)
