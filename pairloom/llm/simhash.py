"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set where over half of a text's word shingles have it set in their XXH64. Fingerprints within
`radius` bits link. Each fingerprint is cut into segments; two within the radius agree within `radius // segments` bits
in one of them, so small Hamming balls around each segment value are enumerated and looked up in the segment's table,
and complete distances are verified. Both of a pair would find each other: it is enough that the one with the extra
bit clears it, so only the half of the ball that clears bits is enumerated.

Distinct fingerprints alone take part: copies cost nothing. What meets under one table key is linked by a search that
drops each reached fingerprint at once and hands on a spanning tree, never all pairs; under a crowded key a second level of
tables, exact as the first, splits the search. Classes come from rounds of star
contraction, in tables. Joins by a key that many rows share are between stored tables, so Spark splits it between tasks.

Defined results: null texts count as empty; texts without words have fingerprint zero, which links like any other; texts
with fewer words than a shingle are one shingle; repeated rows are rows of one class; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, fitted, fresh, map_arrow, materialize, named, row_keyed, stable

SHINGLE, SEED, RADIUS, SEGMENTS = 3, 42, 3, 2
#: Fingerprints that meet under one key as they are, and the least share of all entries that a split key has.
CROWD, CROWD_SHARE = 4096, 1e-6
#: Bytes of a text whose words are held at once.
PART = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `words` words of the lower-cased text, joined by single spaces; long texts part by part, each
    with the last words of the one before."""
    out: list[np.ndarray] = []
    carried: list[bytes] = []
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + PART)
        stop = cut.start() if cut else len(text)
        found = carried + text[at:stop].translate(LOWER_BYTES).split()
        if len(found) >= words:
            out.append(runs_hashed(found, words, seed))
        carried, at = found[max(0, len(found) - words + 1) :], stop
    if out:
        return np.concatenate(out)
    return runs_hashed(carried, len(carried), seed) if carried else np.zeros(0, np.uint64)


def runs_hashed(found: list[bytes], words: int, seed: int) -> np.ndarray:
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1])
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """row, doc_id and fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2).cast(pa.binary())
            fps = np.array([fingerprint(shingle_hashes(t.as_py() or b"", words, seed)) for t in text], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["row", "doc_id", "fp"])

    keyed = row_keyed(docs.select("doc_id", "text"), "row").select("row", F.col("doc_id").cast("long"), "text")
    return map_arrow(keyed, run, "row long, doc_id long, fp long")


def probes(fp: Column, segments: int = SEGMENTS, radius: int = RADIUS) -> Column:
    """(segment, key, own) entries: the table key of each segment and the keys that clear up to radius // segments bits."""
    width = 64 // segments
    assert width * segments == 64 and radius // segments <= 1, "balls of radius 0 or 1 are enumerated"
    out = []
    for s in range(segments):
        key = F.shiftrightunsigned(fp, s * width).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        entry = lambda k, own: F.struct(F.lit(s).alias("segment"), k.alias("key"), F.lit(own).alias("own"))  # noqa: B023, E731
        ball = [F.when(key.bitwiseAND(F.lit(1 << b)) != 0, entry(key.bitwiseXOR(F.lit(1 << b)), False)) for b in range(width)] if radius // segments else []
        out += [entry(key, True), *ball]
    return F.array_compact(F.array(*out))


def tree_links(fps: np.ndarray, own: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among fingerprints that met under one key. Those that did not come by their own
    key (own false) link to those that did, or through them."""
    a, b = [], []
    order = np.argsort(~own, kind="stable")
    fps, own = fps[order], own[order]
    if len(fps) == 2:
        if int(fps[0] ^ fps[1]).bit_count() <= radius:
            return [int(fps[0])], [int(fps[1])]
        return a, b
    rest = fps
    while len(rest) > 1:
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(rest ^ np.uint64(at)) <= radius
            reached = rest[near].tolist()
            a += [at] * len(reached)
            b += reached
            frontier += reached
            rest = rest[~near]
    return a, b


def cells(fp: Column, segment: Column, segments: int, radius: int) -> Column:
    """For what meets under a crowded key: the bits outside the segment are cut into radius + 1 parts, of which two
    fingerprints within the radius have one in common, so each part's value is a smaller table of its own."""
    width, parts = 64 // segments, radius + 1
    rest = 64 - width
    turned = reduce(lambda other, s: F.when(segment == s, F.shiftrightunsigned(fp, (s + 1) * width % 64).bitwiseOR(F.shiftleft(fp, 64 - (s + 1) * width) if (s + 1) * width < 64 else F.lit(0))).otherwise(other), range(segments), fp)
    size = -(-rest // parts)
    each = [F.shiftrightunsigned(turned, i * size).bitwiseAND(F.lit((1 << min(size, rest - i * size)) - 1)) for i in range(parts) if i * size < rest]
    return F.array(*(F.lit((i + 1) << 33).bitwiseOR(e) for i, e in enumerate(each)))


def links(distinct: DataFrame, segments: int = SEGMENTS, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """a, b: verified links that connect all fingerprints (fp) connected by links within the radius.

    Keys with over `crowd` fingerprints are split into cells, so no key is one task's work; their number is below that of
    all entries over `crowd`, and their table below the inverse of CROWD_SHARE, so it is broadcast."""
    all_keys = distinct.select("fp", F.explode(probes(F.col("fp"), segments, radius)).alias("p")).select("fp", "p.segment", "p.key", "p.own")
    tables = all_keys.where("own").select("segment", "key").distinct()
    met = materialize(all_keys.join(tables, ["segment", "key"], "left_semi"))
    least = max(crowd, int(met.count() * CROWD_SHARE))
    crowded = materialize(met.groupBy("segment", "key").agg(F.count("*").alias("n")).where(F.col("n") > least).select("segment", "key"))
    if crowded.isEmpty():
        met = met.withColumn("cell", F.lit(0).cast("long"))
    else:
        split = met.join(F.broadcast(crowded), ["segment", "key"]).withColumn("cell", F.explode(cells(F.col("fp"), F.col("segment"), segments, radius)))
        met = met.join(F.broadcast(crowded), ["segment", "key"], "left_anti").withColumn("cell", F.lit(0).cast("long")).unionByName(split)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and cell; runs of one can go over batches."""
        kept: pa.Table | None = None

        def solve(t: pa.Table) -> pa.RecordBatch:
            fps, own = t["fp"].to_numpy().view(np.uint64), t["own"].to_numpy(zero_copy_only=False)
            change = np.flatnonzero(np.diff(t["segment"].to_numpy()) | np.diff(t["key"].to_numpy()) | np.diff(t["cell"].to_numpy())) + 1
            a: list[int] = []
            b: list[int] = []
            starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(fps)]])
            several = ends - starts > 1
            pair = np.flatnonzero(ends - starts == 2)
            ok = np.bitwise_count(fps[starts[pair]] ^ fps[starts[pair] + 1]) <= radius
            a += fps[starts[pair[ok]]].tolist()
            b += fps[starts[pair[ok]] + 1].tolist()
            for i, j in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
                if j - i > 2:
                    x, y = tree_links(fps[i:j], own[i:j], radius)
                    a += x
                    b += y
            as_long = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays([as_long(a), as_long(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            kept = pa.concat_tables([kept, now]) if kept is not None else now
            last = reduce(pc.and_, (pc.equal(kept[c], kept[c][-1]) for c in ("segment", "key", "cell")))
            head = kept.filter(pc.invert(last))
            if head.num_rows:
                yield solve(head.combine_chunks())
                kept = kept.filter(last)
        if kept is not None and kept.num_rows:
            yield solve(kept.combine_chunks())

    ordered = met.repartition("segment", "key", "cell").sortWithinPartitions("segment", "key", "cell")
    return map_arrow(ordered.select("segment", "key", "cell", "own", "fp"), meet, "a long, b long").distinct()


def stars(edges: DataFrame, n: int) -> DataFrame:
    """u, v with u > v, of n edges: one round that hangs every node's neighbours on the least of them.

    First the greater neighbours of each node, then the lesser ones and the node itself, are linked to the least node
    beside it. Least nodes are counted ahead and stored, so both joins are between stored tables and a node with many
    neighbours, on one side only, can be split between tasks."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(fitted(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), n))
    large = fitted(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), n)
    large = materialize(fitted(large.distinct(), n))
    least = materialize(fitted(large.groupBy("u").agg(F.min("v").alias("m")), n))
    small = fitted(large.join(least, "u"), n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return materialize(fitted(small.select("e.u", "e.v").where("u <> v").distinct(), n))


def are_stars(edges: DataFrame, n: int) -> bool:
    """Does every u have one v, which is no u itself?"""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    deep = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least")).where("ups > 1 or ups = 1 and least = 0")
    return fitted(deep, n).isEmpty()


def classes(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for all nodes of a, b edges between different nodes; a stored table.

    Rounds of star contraction: edges never grow in number, distances halve, and at the end each component is one star.
    All in tables: no node's neighbours meet in one row."""
    n = edges.count()
    now = materialize(fitted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), n))
    while not are_stars(now, n):
        now = stars(now, n)
    roots = fitted(now.select("v").distinct(), n)
    return materialize(now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("label"))))


def near_groups(docs: DataFrame, words: int = SHINGLE, segments: int = SEGMENTS, radius: int = RADIUS) -> DataFrame:
    """row, doc_id, fp, component_id (smallest doc_id reachable) and first (the row that stands for the component)."""
    rows = materialize(fingerprints(docs, words))
    distinct = materialize(rows.groupBy("fp").agg(F.min(F.struct("doc_id", "row")).alias("least")))
    edges = materialize(links(distinct.select("fp"), segments, radius))
    label = classes(edges)
    linked = materialize(distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    heads = materialize(linked.groupBy("label").agg(F.min("least").alias("head")))
    of_fp = materialize(linked.join(heads, "label").select("fp", F.col("head.doc_id").alias("component_id"), F.col("head.row").alias("first_row")))
    return rows.join(of_fp, "fp").select("row", "doc_id", "fp", "component_id", (F.col("row") == F.col("first_row")).alias("first"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group, with all columns."""
    docs = stable(docs)
    key = fresh(docs, "row")
    kept = near_groups(docs).where("first").select(F.col("row").alias(key))
    return row_keyed(docs, key).join(kept, key, "left_semi").select(*map(named, docs.columns))
