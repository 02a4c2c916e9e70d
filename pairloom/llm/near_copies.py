"""SimHash near copies at a similarity: multi-index hashing of wide fingerprints.

Two texts link if their sets of five-word shingles have a Jaccard similarity of at least 4/5. A fingerprint of 64 bits
cannot tell such pairs (they differ in some 10 bits), so fingerprints here are wide: SEGMENTS segments of WIDTH bits, a
bit set where over half of the shingles have it set in their hash. Within each segment a small Hamming ball around the
value is enumerated: flips of up to FLIPS of the UNCERTAIN bits whose counts are nearest to a half, as those are the bits in
which similar texts differ. Fingerprints that meet under a key of a segment's table are candidates; their first 64 bits, then
their complete distances are verified; a parity sketch of the sets bounds their difference from below; and the
similarity of what is left is counted on the whole sets.

Two texts of similarity 4/5 meet in a segment with the probability MEET[width], so with all segments they are missed in
at most 3 of 1000 cases, more similar ones far more seldom; the tests measure it against all pairs. The width follows the
number of distinct sets, so that a key holds less than one stranger on average, and the number of segments the width.

Texts that meet under one key in great number are first paired with the next in row order. What that links needs no other
link inside: a second pass compares, in pieces, only those that are not in the key's main class with the others, by their
sketches, so that hardly a pair is written that is not similar.

Defined results: null texts count as empty; texts without words have the one set {0} and link among each other; texts
with fewer words than a shingle are one shingle; repeated rows are rows of one class, as are texts with equal sets; of a
class the row with the smallest doc_id stays, null doc_ids count as the smallest, ties go to the first row; empty tables
give empty results; other columns are kept as they are and not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fitted, fresh, map_arrow, materialize, named, row_keyed, stable
from .simhash import SEED, classes, shingle_hashes

#: Words of a shingle; the similarity is TOP / BELOW at least; bits of a ball, and how many of them are flipped at once.
WORDS, TOP, BELOW, UNCERTAIN, FLIPS = 5, 4, 5, 3, 2
BALL = sum(math.comb(UNCERTAIN, k) for k in range(FLIPS + 1))
#: Width of a segment in bits: the share of pairs of similarity 4/5 that meet in one segment (of normally distributed counts).
MEET = {24: 0.23, 28: 0.139, 32: 0.082, 36: 0.05, 40: 0.03}
MISSED = 0.0032
#: Most bits of the first 64, and most of 512, in which similar sets differ: five standard deviations above what the
#: smallest sets of similarity 4/5 have; others differ in half of all bits.
NEAR_64, NEAR_512 = 24, 130
#: Texts that pair fully under one key; neighbours of each beyond that; least rows, and share of all, of a key in pieces.
SMALL, BESIDE, PIECE, PIECE_SHARE = 8, 1, 4096, 1e-6
#: Bits of a sketch; shingles from which on it is made of a half, a quarter, ... of them; standard deviations that a sample
#: may be off. Sketches of whole sets never exclude a similar pair, those of samples in 1 of 30,000 cases.
SKETCH, SAMPLED, SLACK = 1024, 800, 4
AT_ONCE = 1 << 20


def plan(sets: int) -> tuple[int, int]:
    """Width and number of segments for so many distinct sets."""
    width = next((w for w in MEET if sets * BALL <= 1 << w - 1), max(MEET))
    return width, math.ceil(math.log(MISSED) / math.log(1 - MEET[width]))


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles, sorted."""
    found = shingle_hashes(text or b"", words, SEED)
    return np.unique(found) if len(found) else np.zeros(1, np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """|a & b| / |a | b| >= TOP / BELOW, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return (TOP + BELOW) * both >= TOP * (len(a) + len(b))


def counts(found: np.ndarray, longs: int) -> np.ndarray:
    """For each of 64 * longs bits: shingles that have it set, less those that have not."""
    total = np.zeros(64 * longs, np.int64)
    turn = np.arange(1, longs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(found), 1 << 13):
        z = found[at : at + (1 << 13), None] + turn  # one stream of mixed hashes for each long
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = (z ^ (z >> np.uint64(31))).astype("<u8")
        bits = np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").view("<u8")
        for part in range(0, len(bits), 255):  # eight counters of a byte in each long
            total += bits[part : part + 255].sum(0).view(np.uint8)
    return 2 * total - len(found)


def sketches(found: np.ndarray) -> np.ndarray:
    """The parities of the numbers of shingles in each of SKETCH bins: they differ in no more bits than sets in shingles.
    The first sketch is of the set's own level of sampling, the second of the next, as sizes of similar sets may straddle one."""
    mixed = (found ^ (found >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    level, out = level_of(len(found)), []
    for s in (level, level + 1):
        part = mixed[(mixed >> np.uint64(20)) & np.uint64((1 << s) - 1) == 0]
        out.append(np.packbits(np.bincount((part >> np.uint64(54)).astype(np.int64), minlength=SKETCH) & 1, bitorder="little"))
    return np.concatenate(out).view("<i8")


def level_of(size):
    """0 below SAMPLED shingles, then one more with each doubling."""
    return np.ceil(np.log2(np.maximum(size, SAMPLED - 1) / (SAMPLED - 1))).astype(np.int64) if isinstance(size, np.ndarray) else int(level_of(np.array([size]))[0])


def may_be_similar(size_a: np.ndarray, a: np.ndarray, size_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By rows: do sizes and sketches allow the similarity?"""
    level_a, level_b = level_of(size_a), level_of(size_b)
    at = np.maximum(level_a, level_b)
    half = SKETCH // 64
    chosen = lambda v, up: np.where(up[:, None], v[:, half:], v[:, :half])
    differ = np.bitwise_count((chosen(a, at > level_a) ^ chosen(b, at > level_b)).view(np.uint64)).sum(1, dtype=np.int64)
    most = (size_a + size_b) * (BELOW - TOP) / (BELOW + TOP) / np.exp2(at)
    most = np.where(at > 0, most + SLACK * np.sqrt(most), most + 1e-9)
    return (np.abs(level_a - level_b) < 2) & (TOP * np.maximum(size_a, size_b) <= BELOW * np.minimum(size_a, size_b)) & (differ <= most)


def probed(balance: np.ndarray, width: int, segments: int) -> np.ndarray:
    """Of rows of counts: each segment's value, and above it the places of its least certain bits, 6 bits each."""
    cut = balance[:, : width * segments].reshape(len(balance), segments, width)
    value = (cut > 0) @ (np.int64(1) << np.arange(width, dtype=np.int64))
    # Ties go to the lower place, so that similar texts choose alike.
    least = np.argsort(np.abs(cut) * width + np.arange(width), axis=2)[:, :, :UNCERTAIN]
    return value | (least << (width + 6 * np.arange(UNCERTAIN))).sum(2)


def fingerprints(texts: DataFrame, width: int, segments: int) -> DataFrame:
    """row, digest (of the set), size, sketch, wide (the fingerprint's bits), probes (value and ball of each segment)."""
    longs = -(-width * segments // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                size, digest, balance, drawn = [], [], [], []
                for t in part.column(1).cast(pa.binary()):
                    found = shingle_set(t.as_py())
                    size.append(len(found))
                    digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                    balance.append(counts(found, longs))
                    drawn.append(sketches(found))
                stacked = np.stack(balance)
                wide = np.packbits(stacked > 0, axis=1, bitorder="little").view("<i8")
                lists = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), lists(np.stack(drawn)), lists(wide), lists(probed(stacked, width, segments))],
                    ["row", "digest", "size", "sketch", "wide", "probes"],
                )

    return map_arrow(texts.select("row", "text"), run, "row long, digest binary, size long, sketch array<long>, wide array<long>, probes array<long>")


def entries(signed: DataFrame, width: int) -> DataFrame:
    """key (segment and value), flips (those made to reach it), row, code: the whole ball of each segment."""
    each = signed.select("row", F.col("wide")[0].alias("code"), F.posexplode("probes").alias("segment", "probe"))
    place = lambda i: F.shiftright("probe", width + 6 * i).bitwiseAND(F.lit(63)).cast("int")
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), place(i)) for i in range(UNCERTAIN)]
    none = F.lit(0).cast("long")
    masks = [reduce(Column.bitwiseXOR, chosen, none) for k in range(FLIPS + 1) for chosen in combinations(bit, k)]
    value = F.shiftleft(F.col("segment").cast("long"), width).bitwiseOR(F.col("probe").bitwiseAND(F.lit((1 << width) - 1)))
    return each.select("row", "code", value.alias("value"), F.explode(F.array(*masks)).alias("flips")).select(F.col("value").bitwiseXOR(F.col("flips")).alias("key"), "flips", "row", "code")


def pieces(keyed: DataFrame, total: int) -> DataFrame:
    """The entries with `piece`: 0, but for keys with very many rows, which are cut into pieces (from 1) of about PIECE rows.

    Buckets of keys are counted first, so only keys of crowded buckets are counted one by one; keys above the share of all
    are fewer than its inverse, so their table is bounded and broadcast."""
    least = max(PIECE, int(total * PIECE_SHARE))
    buckets = 1 << 16
    if total < 2 * least:
        return keyed.withColumn("piece", F.lit(0))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets))
    crowded = keyed.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") > least)
    crowded = [r.bucket for r in crowded.collect()]  # at most 65536 numbers
    if not crowded:
        return keyed.withColumn("piece", F.lit(0))
    chosen = keyed.sparkSession.createDataFrame([(b,) for b in crowded], "bucket long")
    hot = materialize(keyed.select("key", bucket.alias("bucket")).join(F.broadcast(chosen), "bucket", "left_semi").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > least))
    if hot.isEmpty():
        return keyed.withColumn("piece", F.lit(0))
    number = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / least)).cast("int") + 1
    return keyed.join(F.broadcast(hot), "key", "left").withColumn("piece", F.coalesce(number, F.lit(0))).drop("n")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows that come sorted by key and piece, with the starts and ends of their runs; a run can go over batches."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, piece = batch["key"].to_numpy(), batch["piece"].to_numpy()
        end = (int(key[-1]), int(piece[-1]))
        same = (key == end[0]) & (piece == end[1])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut or last is not None and last != end:
            yield bounded(pa.Table.from_batches([*kept, batch.slice(0, cut)]))
            kept = []
        kept.append(batch.slice(cut))
        last = end
    if kept:
        yield bounded(pa.Table.from_batches(kept))


def bounded(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    change = np.flatnonzero(np.diff(t["key"].to_numpy()) | np.diff(t["piece"].to_numpy())) + 1
    return t, np.concatenate([[0], change]), np.concatenate([change, [t.num_rows]])


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= NEAR_64  # of signed numbers it would count the absolute value's


def paired(keyed: DataFrame) -> DataFrame:
    """a, b, key: pairs that meet under a key (key is null), and the rows (a) of keys with over SMALL rows or several pieces.

    A pair meets under as many keys as both can flip a bit in common; it counts under the one where they flip none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])
        for t, starts, ends in runs(batches):
            row, code, flips, key = (t[c].to_numpy() for c in ("row", "code", "flips", "key"))
            n = ends - starts
            end, many = np.repeat(ends, n), np.repeat(n > SMALL, n) | (t["piece"].to_numpy() > 0)
            few = np.flatnonzero(~many & (end - np.arange(len(row)) > 1))
            for step in range(1, SMALL):
                few = few[few + step < end[few]]
                if not len(few):
                    break
                i = few[(flips[few] & flips[few + step]) == 0]
                i = i[near(code[i], code[i + step])]
                if len(i):
                    yield pair(row[i], row[i + step])
            if many.any():
                own = np.flatnonzero(many & (flips == 0))
                for step in range(1, BESIDE + 1):
                    i, j = own[:-step], own[step:]
                    ok = (j < end[i]) & near(code[i], code[j])
                    yield pair(row[i[ok]], row[j[ok]])
                yield pa.RecordBatch.from_arrays([pa.array(row[many]), pa.nulls(int(many.sum()), pa.int64()), pa.array(key[many])], ["a", "b", "key"])

    return map_arrow(sorted_runs(keyed, "row").select("key", "piece", "flips", "row", "code"), run, "a long, b long, key long")


def sorted_runs(rows: DataFrame, *after: str) -> DataFrame:
    return rows.repartition("key", "piece").sortWithinPartitions("key", "piece", *after)


def apart(crowded: DataFrame) -> DataFrame:
    """a, b: pairs of different classes under a crowded key that may be similar; crowded has key, row, code, label, size, sketch.

    The rows outside of a key's largest class go to every piece of it and meet all its rows there; where a key is of one
    class, as groups of near copies are after the first pass, nothing is compared."""
    given = ("key", "row", "code", "label", "size", "sketch")
    of_label = materialize(crowded.groupBy("key", "label").agg(F.count("*").alias("k")))
    facts = materialize(of_label.groupBy("key").agg(F.sum("k").alias("n"), F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1"))
    rows = crowded.join(facts, "key").select(*given, (F.col("label") != F.col("main")).alias("asks"), F.ceil(F.col("n") / PIECE).cast("int").alias("n"))
    whole = rows.select(*given, F.pmod(F.xxhash64("row"), F.col("n")).cast("int").alias("piece"), F.lit(False).alias("asks"))
    asking = rows.where("asks").select(*given, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("piece"), "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, ends in runs(batches):
            row, code, label, size = (t[c].to_numpy() for c in ("row", "code", "label", "size"))
            asks = t["asks"].to_numpy(zero_copy_only=False)
            for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
                drawn = np.stack(t["sketch"][start:end].to_numpy())
                those = start + np.flatnonzero(~asks[start:end])
                a, b, held = [], [], 0
                for i in (start + np.flatnonzero(asks[start:end])).tolist():
                    other = those[(label[those] != label[i]) & near(code[those], code[i])]
                    other = other[may_be_similar(np.full(len(other), size[i]), np.broadcast_to(drawn[i - start], (len(other), drawn.shape[1])), size[other], drawn[other - start])]
                    a.append(np.full(len(other), row[i]))
                    b.append(row[other])
                    held += len(other)
                    if held >= AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                        a, b, held = [], [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return map_arrow(sorted_runs(whole.unionByName(asking)).select("piece", *given, "asks"), run, "a long, b long")


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints, scaled to 512."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return differ * 8 / F.size(a)


def verified(pairs: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: the pairs (a, b) that are similar: by the complete distance first, then by their whole sets."""
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n = pairs.count()
    columns = ("size", "sketch", "wide")
    of = lambda end: signed.select(F.col("row").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns))
    both = fitted(fitted(pairs.join(of("a"), "a"), n).join(of("b"), "b"), n).where(distance(F.col("wide_a"), F.col("wide_b")) <= NEAR_512)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sketch_a, sketch_b = (np.stack(batch[c].to_numpy(zero_copy_only=False)) for c in ("sketch_a", "sketch_b"))
                yield batch.select(["a", "b"]).filter(pa.array(may_be_similar(batch["size_a"].to_numpy(), sketch_a, batch["size_b"].to_numpy(), sketch_b)))

    pairs = materialize(map_arrow(both.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b"), draw, "a long, b long"))
    if pairs.isEmpty():
        return pairs
    rows = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t.as_py()).tobytes() for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["row", "whole"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) for a, b in zip(batch["whole_a"], batch["whole_b"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sets = materialize(map_arrow(texts.join(rows, "row", "left_semi").select("row", "text"), whole, "row long, whole binary"))
    both = pairs.join(sets.withColumnsRenamed({"row": "a", "whole": "whole_a"}), "a").join(sets.withColumnsRenamed({"row": "b", "whole": "whole_b"}), "b")
    return materialize(map_arrow(both.select("a", "b", "whole_a", "whole_b"), count, "a long, b long"))


def near_links(texts: DataFrame, width: int | None = None, segments: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(row, first: the first row with the same set) and (a, b: similar pairs of first rows that connect all rows of
    (row, text) connected by similar pairs)."""
    found = plan(texts.count())
    width, segments = width or found[0], segments or found[1]
    signed = materialize(fingerprints(texts, width, segments))
    groups = materialize(signed.groupBy("digest").agg(F.min("row").alias("first")))
    same = materialize(signed.select("row", "digest").join(groups, "digest").select("row", "first"))
    signed = materialize(signed.join(groups.select(F.col("first").alias("row")), "row", "left_semi").drop("digest"))
    total = signed.count() * segments * BALL
    met = materialize(paired(pieces(entries(signed, width), total)))
    links = verified(met.where("b IS NOT NULL"), signed, texts)
    crowded = met.where("b IS NULL").select("key", F.col("a").alias("row"))
    if crowded.isEmpty():
        return same, links
    label = classes(links).withColumnRenamed("node", "row")
    crowded = materialize(crowded.join(label, "row", "left").withColumn("label", F.coalesce("label", "row")).join(signed.select("row", F.col("wide")[0].alias("code"), "size", "sketch"), "row"))
    return same, links.unionByName(verified(apart(crowded), signed, texts))


def near_groups(docs: DataFrame) -> DataFrame:
    """row, doc_id, component_id (smallest doc_id of the class) and first (the row that stands for the class), of a `stable` table."""
    texts = row_keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "row")
    same, links = near_links(texts.select("row", "text"))
    label = classes(links)
    of_first = same.join(label.withColumnRenamed("node", "first"), "first", "left").select("row", F.coalesce("label", "first").alias("label"))
    members = materialize(texts.select("row", "doc_id").join(of_first, "row"))
    heads = materialize(members.groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("head")))
    return members.join(heads, "label").select("row", "doc_id", F.col("head.doc_id").alias("component_id"), (F.col("row") == F.col("head.row")).alias("first"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id, with all columns."""
    docs = stable(docs)
    key = fresh(docs, "row")
    dropped = near_groups(docs).where("not first").select(F.col("row").alias(key))
    return row_keyed(docs, key).join(dropped, key, "left_anti").select(*map(named, docs.columns))
