"""Removal of repeated byte strings by distributed suffix sorting with difference covers.

Every byte that a 200-byte string covers goes if that string starts anywhere else too. To sort the suffixes of all texts as
rows would take some nine shuffles of a row a byte, so the suffixes are first dealt such that equal 200-byte strings always
meet: a string's class is the least hash of its 64-byte grams, and the string itself decides it. Classes of one occurrence
hold no repeat and end there. The strings of a class that follow one another in a text (those with the same gram as their
least) travel as one context, and equal contexts as one row with its number.

Tasks get whole classes and sort the suffixes of their contexts: triples at places 1 and 2 of every 3 are sorted and named,
the sequence of names is sorted the same way (3, 9, 27, 81, 243 bytes, or until all names differ), the other places are
merged by their letter and the rank behind it, and the 200-byte prefixes of neighbours are compared byte for byte. A class
above CLASS_BYTES is cut by where in a string its least gram stands, half and half, each half keyed anew by the bytes that
all of its strings share; equal contexts are counted again each time, so that it ends at the latest with one row a string.

Facts of a text (its contexts, its repeated ranges) are files by scan partition that the task of those texts reads, so texts
are never shuffled. Contexts are told apart by 128 bits of hash.

Defined results: null texts count as empty; texts below 200 bytes lose nothing, except that nothing can be repeated in them;
matches never cross documents; of a copied document both lose their bytes; repeated rows are documents of their own; empty
tables give empty results; other columns are not looked at. A text is read in windows of STEP bytes, so only its own bytes
bound the memory.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, map_arrow, materialize, row_keyed, scratch, stable, stored
from .side_files import part_of, written_by

#: Bytes of a repeated string, of the grams whose least hash gives its class, and of a text looked at at a time.
REPEAT, GRAM, STEP = 200, 64, 1 << 20
#: Bytes of contexts sorted together, and of a class above which it is cut; both together stay below 2^21 names.
SORT_BYTES, CLASS_BYTES = 1 << 20, 1 << 19
ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` (a power of two) bytes from each place."""
    h, n = raw.astype(np.uint64) + np.uint64(1), 1
    while n < width:
        h, n = (h[:-n] * (ODD + np.uint64(2 * n))) ^ (h[n:] + (h[n:] >> np.uint64(29))), 2 * n
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` neighbours from each place."""
    n = 1
    while 2 * n <= width:
        values, n = np.minimum(values[:-n], values[n:]), 2 * n
    return np.minimum(values[: len(values) - (width - n)], values[width - n :]) if width > n else values


def anchors(raw: np.ndarray, repeat: int = REPEAT, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, first, n, off): each run of `n` strings from place `first` on with the same least gram, which begins `off`
    bytes behind `first`. Of equal grams in a string the leftmost counts."""
    wide, low = repeat - gram + 1, np.uint64(1023)
    if wide > 512:
        raise ValueError("the strings are longer than the places can be told apart")
    found: list[list[np.ndarray]] = [[], [], [], []]
    for at in range(0, max(0, len(raw) - repeat + 1), STEP):
        part = raw[at : at + STEP + repeat - 1]
        h = gram_hashes(part, gram) & ~low
        place, here = np.arange(len(h), dtype=np.uint64), np.arange(len(part) - repeat + 1)
        # Ten bits of the place decide ties; two numberings, as one of them runs over within a string.
        both = [least_in(h | ((place + np.uint64(shift)) & low), wide) for shift in (0, 512)]
        early = (here & 1023) < 512
        least = np.where(early, both[0], both[1])
        anchor = here + (((least & low).astype(np.int64) - here - np.where(early, 0, 512)) & 1023)
        cut = np.flatnonzero(np.diff(anchor, prepend=-1))
        found[0].append((least[cut] >> np.uint64(10)).astype(np.int64))
        found[1].append(at + cut)
        found[2].append(np.diff(cut, append=len(here)))
        found[3].append(anchor[cut] - cut)
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)


def suffix_ranks(letters: np.ndarray, width: int = 1, depth: int = REPEAT) -> np.ndarray:
    """Rank (from 1) of the suffix at each place by its first `depth` bytes at least; letters are 1 to 2^21 - 1, or 0 where
    no string goes on, and each stands for `width` bytes. Suffixes alike in so many bytes have neighbouring ranks."""
    n = len(letters)
    text = np.concatenate([letters, np.zeros(4, np.int64)])
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    places = np.concatenate([ones, twos])
    triples = (text[places] << 42) | (text[places + 1] << 21) | text[places + 2]
    order = np.argsort(triples, kind="stable")
    names = np.empty(len(places), np.int64)
    names[order] = np.cumsum(np.diff(triples[order], prepend=-1) != 0)
    if len(places) and names[order[-1]] < len(places) and 3 * width < depth:
        names = suffix_ranks(names, 3 * width, depth)
        order = np.argsort(names)
    rank = np.zeros(n + 4, np.int64)
    rank[places] = names
    zeros = np.arange(0, n, 3)
    by_one = (text[zeros] << 21) | rank[zeros + 1]
    zeros = zeros[np.argsort(by_one, kind="stable")]
    by_one, by_two = (text[zeros] << 21) | rank[zeros + 1], (text[zeros] << 42) | (text[zeros + 1] << 21) | rank[zeros + 2]
    ordered = places[order]
    first, second = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    below = np.searchsorted(np.maximum.accumulate((text[first] << 21) | rank[first + 1]), by_one)
    below += np.searchsorted(np.maximum.accumulate((text[second] << 42) | (text[second + 1] << 21) | rank[second + 2]), by_two)
    spot = np.arange(len(zeros)) + np.maximum.accumulate(below)
    merged = np.empty(len(zeros) + len(ordered), np.int64)
    free = np.ones(len(merged), bool)
    free[spot] = False
    merged[spot], merged[free] = zeros, ordered
    out = np.empty(n, np.int64)
    merged = merged[merged < n]  # without the place behind the end
    out[merged] = np.arange(1, n + 1)
    return out


def repeats(contexts: list[bytes], copies: np.ndarray, repeat: int = REPEAT) -> list[tuple[list[int], list[int]]]:
    """For each context the runs [start, stop) of its strings that occur twice or more in all contexts."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    raw = np.frombuffer(b"\0".join(contexts) + bytes(8), np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    letters = raw[:-8].astype(np.int64) + 1
    letters[begins[1:] - 1] = 0
    counts = np.maximum(sizes - repeat + 1, 0)
    owner = np.repeat(np.arange(len(contexts)), counts)
    places = np.arange(int(counts.sum())) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    order = places[np.argsort(suffix_ranks(letters, depth=repeat)[places])]
    x, y = order[:-1], order[1:]
    words = np.ndarray((len(raw) - 7,), "<u8", raw.data, 0, (1,))
    steps = [*range(0, repeat - 7, 8), repeat - 8]
    for step in steps[::-1]:  # most neighbours that differ do so late
        same = words[x + step] == words[y + step]
        x, y = x[same], y[same]
    hit = np.zeros(len(letters), bool)
    hit[x] = hit[y] = True
    hit[places[copies[owner] > 1]] = True
    edges = np.diff(hit.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    whose = np.searchsorted(begins, starts, "right") - 1
    cuts = np.searchsorted(whose, np.arange(len(contexts) + 1))
    return [((starts[a:b] - o).tolist(), (stops[a:b] - o).tolist()) for a, b, o in zip(cuts, cuts[1:], begins.tolist(), strict=False)]


class PartFacts:
    """Facts of the texts of a scan partition, in order of text and place."""

    def __init__(self, folder: str, columns: list[str]):
        self.folder, self.columns, self.part = folder, columns, None

    def of(self, rids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Where the facts of each text start and stop, and the columns."""
        part = int(rids[0]) >> 33
        if part != self.part:
            self.part, found = part, part_of(self.folder, "part", part)
            if found is None:
                self.rids, self.data = np.zeros(0, np.int64), [np.zeros(0, np.int64) for _ in self.columns]
            else:
                found = found.sort_by([("rid", "ascending"), ("first", "ascending")])
                self.rids, self.data = found["rid"].to_numpy(), [found[c].to_numpy() for c in self.columns]
        return np.searchsorted(self.rids, rids), np.searchsorted(self.rids, rids, "right"), self.data


def text_anchors(rows: DataFrame, repeat: int, gram: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(text.as_buffer() or b"", np.uint8)
                if len(raw) >= repeat:
                    least, first, n, off = anchors(raw, repeat, gram)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (least, np.full(len(least), rid), first, n.astype(np.int32), off.astype(np.int32))], ["class", "rid", "first", "n", "off"])

    return map_arrow(rows, find, "class long, rid long, first long, n int, off int")


CONTEXTS = "class long, rid long, first long, n int, off int, context binary"


def text_contexts(rows: DataFrame, folder: str, repeat: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = PartFacts(folder, ["class", "rid", "first", "n", "off"])
        for batch in batches:
            if not batch.num_rows:
                continue
            lows, highs, data = facts.of(batch.column(0).to_numpy())
            out, size, at = [], 0, int(lows[0])
            for i, (low, high) in enumerate(zip(lows.tolist(), highs.tolist(), strict=True)):
                if high == low:
                    continue
                text = memoryview(batch.column(1)[i].as_buffer())
                for first, n in zip(data[2][low:high].tolist(), data[3][low:high].tolist(), strict=True):
                    out.append(bytes(text[first : first + n + repeat - 1]))
                    size += len(out[-1])
                    if size >= STEP:
                        yield pa.RecordBatch.from_arrays([*(pa.array(c[at : at + len(out)]) for c in data), pa.array(out, pa.binary())], [c.split()[0] for c in CONTEXTS.split(", ")])
                        out, size, at = [], 0, at + len(out)
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(c[at : at + len(out)]) for c in data), pa.array(out, pa.binary())], [c.split()[0] for c in CONTEXTS.split(", ")])

    return map_arrow(rows, cut, CONTEXTS)


def hashed(contexts: DataFrame) -> DataFrame:
    """With two hashes of class, place of the gram, and context."""
    return contexts.withColumns({"c1": F.xxhash64("class", "off", "context"), "c2": F.xxhash64(F.lit(1), "context", "off", "class")})


def distinct_contexts(contexts: DataFrame, copies) -> DataFrame:
    return contexts.groupBy("class", "c1", "c2").agg(F.first("n").alias("n"), F.first("off").alias("off"), F.first("context").alias("context"), F.sum(copies).alias("copies"))


def repeated_runs(contexts: DataFrame, repeat: int) -> DataFrame:
    """(c1, c2, starts, stops) of the contexts with repeated strings; a class is in one task. The strings of one context
    differ, as their least gram stands elsewhere in each; so in a class of one context its copies alone decide."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found, several, size = [], [], 0
        for _, group in itertools.chain(itertools.groupby(rows, itemgetter(0)), [(None, None)]):
            if group is None or size >= SORT_BYTES or len(found) >= 10_000:
                if several:
                    runs = repeats([r[3] for r in several], np.array([r[4] for r in several]), repeat)
                    found += [(*row[1:3], *run) for row, run in zip(several, runs, strict=True) if run[0]]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], ["c1", "c2", "starts", "stops"])
                found, several, size = [], [], 0
            if group is not None:
                own = list(group)
                if len(own) > 1:
                    several += own
                    size += sum(len(r[3]) + 1 for r in own)
                elif own[0][4] > 1:
                    found.append((*own[0][1:3], [0], [len(own[0][3]) - repeat + 1]))

    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    dealt = contexts.select("class", "c1", "c2", "context", "copies").repartition("class").sortWithinPartitions("class")
    return map_arrow(dealt, sort, "c1 long, c2 long, starts array<int>, stops array<int>")


def crowded(contexts: DataFrame, most: int) -> DataFrame:
    return contexts.groupBy("class").agg(F.sum(F.col("n") + REPEAT).alias("size")).where(F.col("size") > most).select("class")


def cut_classes(contexts: DataFrame, repeat: int, wide: int, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Distinct contexts in classes of bounded size, and for each round the links (c1, c2, child1, child2, shift) of the
    contexts that were cut. Contexts of a large class are those whose strings have the least gram at places low to high."""
    ready, links = [], []
    left = contexts.withColumns({"low": F.lit(0), "high": F.lit(wide)})
    while True:
        large = materialize(crowded(left.where("high - low > 1"), most))
        if large.isEmpty():
            return [*ready, left.drop("low", "high")], links
        ready.append(left.join(large, "class", "left_anti").drop("low", "high"))
        middle = F.expr("(low + high) div 2")
        halves = left.join(large, "class", "left_semi").withColumn("half", F.explode(F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))))
        halves = halves.withColumns({"from": F.least("off", F.col("half.high") - 1), "to": F.greatest(F.col("off") - F.col("n") + 1, F.col("half.low"))}).where("`from` >= `to`")
        core = F.expr(f"substring(context, off - half.low + 1, {repeat} + 1 - half.high + half.low)")
        cut = halves.select(
            F.col("c1").alias("p1"), F.col("c2").alias("p2"), F.xxhash64("class", "half.low", core).alias("class"), F.expr("`from` - `to` + 1").alias("n"), F.col("from").alias("off"),
            F.expr(f"substring(context, off - `from` + 1, `from` - `to` + {repeat})").alias("context"), "copies", F.col("half.low").alias("low"), F.col("half.high").alias("high"), (F.col("off") - F.col("from")).alias("shift"),
        )
        cut = stored(hashed(cut), "halves")
        links.append(cut.select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), F.col("c1").alias("child1"), F.col("c2").alias("child2"), "shift"))
        bounds = cut.groupBy("class").agg(F.first("low").alias("low"), F.first("high").alias("high"))
        left = stored(distinct_contexts(cut, F.col("copies")).join(bounds, "class"), "contexts")


def repeated_ranges(docs: DataFrame, repeat: int = REPEAT, gram: int = GRAM, most: int = CLASS_BYTES) -> DataFrame:
    """rid, first, stop: byte ranges covered by repeated strings, of a table with rid (see `row_keyed`) and text as bytes."""
    found = text_anchors(docs, repeat, gram)
    path = scratch(docs.sparkSession, "anchors")
    found.write.option("compression", "zstd").parquet(path)
    found = docs.sparkSession.read.schema(found.schema).parquet(path)
    again = materialize(found.groupBy("class").agg(F.count("*").alias("n")).where("n > 1"))
    kept = join_spread(found, again, "class", found.count()).withColumn("part", F.shiftright("rid", 33))
    contexts = hashed(text_contexts(docs, written_by(kept, "part", "repeated"), repeat))
    path = scratch(docs.sparkSession, "contexts")
    contexts.write.option("compression", "zstd").parquet(path)
    contexts = docs.sparkSession.read.schema(contexts.schema).parquet(path)
    distinct = distinct_contexts(contexts, F.lit(1))
    if crowded(contexts, most).isEmpty():
        runs = repeated_runs(distinct, repeat)
    else:
        ready, links = cut_classes(stored(distinct, "contexts"), repeat, repeat - gram + 1, most)
        runs = None
        for i, table in reversed(list(enumerate(ready))):  # from the last round back: what was found goes to the parents
            own = repeated_runs(table, repeat)
            if runs is not None:
                moved = runs.select(F.col("c1").alias("child1"), F.col("c2").alias("child2"), "starts", "stops").join(links[i], ["child1", "child2"])
                own = own.unionByName(moved.select("c1", "c2", *(F.transform(c, lambda x: x + F.col("shift")).alias(c) for c in ("starts", "stops"))))
            runs = own
    met = contexts.select("c1", "c2", "rid", "first").join(runs, ["c1", "c2"]).select("rid", "first", F.explode(F.arrays_zip("starts", "stops")).alias("run"))
    return met.select("rid", (F.col("first") + F.col("run.starts")).alias("first"), (F.col("first") + F.col("run.stops") + (repeat - 1)).alias("stop"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without(text: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, int]:
    """The bytes that no range covers, and the number of maximal runs of those that go; ranges are in order of start."""
    if not len(starts):
        return text, 0
    reach = np.maximum.accumulate(stops)
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    last = np.append(new[1:] - 1, len(starts) - 1)
    kept, at = [], 0
    for a, b in zip(starts[new].tolist(), reach[last].tolist(), strict=True):
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), len(new)


def remove_repeats(docs: DataFrame, repeat: int = REPEAT, gram: int = GRAM, most: int = CLASS_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    keyed = row_keyed(stable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))), "rid")
    ranges = repeated_ranges(keyed.select("rid", "text"), repeat, gram, most)
    folder = written_by(ranges.withColumn("part", F.shiftright("rid", 33)), "part", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = PartFacts(folder, ["first", "stop"])
        for batch in batches:
            if not batch.num_rows:
                continue
            lows, highs, (starts, stops) = facts.of(batch.column(0).to_numpy())
            rows = []
            for text, low, high in zip(batch.column(2).to_pylist(), lows.tolist(), highs.tolist(), strict=True):
                kept, spans = without(text, starts[low:high], stops[low:high])
                rows.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, zip(*rows, strict=True))], [c.split()[0] for c in RESULT.split(", ")])

    return map_arrow(keyed.select("rid", "doc_id", "text"), cut, RESULT)
