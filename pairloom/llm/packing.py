"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens. Pieces are dealt by hash into blocks of about BLOCK pieces, so a
source, copies or one long document spread evenly and no group grows with the input. Every block evolves on several
islands: crossover injects whole well-filled bins of another packing, drops the bins that repeat their pieces and puts
the displaced pieces back, by exchange for shorter ones where that fills a bin better, then best-fit. After each epoch
the best packing of an island replaces the worst of the next one in the ring; the best of a block's islands counts. An
island rests as soon as no packing can have fewer bins.

Blocks are not alone: the bins of all blocks that are not full, and some with many pieces, are opened after a round and
their pieces are dealt to fewer blocks, which evolve again, until one block is left (or opening frees as many pieces as
before). So what the split in blocks costs is won back, whatever the number of blocks.

Defined results: null texts count as empty and are one piece of the single end id; repeated rows are pieces of their
own; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_pandas, materialize, row_keyed, stable
from .tokens import text_slices, word_bpe

CAPACITY, END_ID = 2048, 0
#: Pieces of a block, the most of its bins that are opened after a round for not being full and for having many pieces, and
#: how far a block is searched (TRIED: bins that displaced pieces are offered to in one step).
BLOCK, OPENED, FINEST, ISLANDS, EPOCHS, GENERATIONS, POPULATION, TRIED = 4096, 1 / 4, 1 / 32, 2, 2, 20, 6, 128
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, and their ids if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                ids, n = bpe.encode(texts)
                ends = np.cumsum(n + 1)
                full = np.full(len(ids) + len(n), end_id, "<u4")
                inside = np.ones(len(full), bool)
                inside[ends - 1] = False
                full[inside] = ids
                pieces = -(-(n + 1) // capacity)
                owner = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, (n + 1)[owner] - start)
                first = (ends - n - 1)[owner] + start
                view = memoryview(full.view(np.uint8))
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                rows = pa.array(owner + at)
                out = [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.LargeListArray.from_arrays(pa.array(np.append(first, len(full))), pa.array(full)).cast(pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    keyed = row_keyed(stable(docs.select("doc_id", "text")), "row").select(F.col("doc_id").cast("long"), "text", "row")
    return map_arrow(keyed, cut, PIECES + (", ids array<long>" if with_ids else ""))


def best_fit(order: list[int], length: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put pieces, in this order, each into the bin with the least room that holds it, or a new one."""
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for j, r in enumerate(room):
        at[r].append(j)
        rooms |= 1 << r
    for i in order:
        size = length[i]
        fits = rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            j = at[r].pop()
            if not at[r]:
                rooms ^= 1 << r
            bins[j].append(i)
            room[j] = r = r - size
        else:
            j, r = len(bins), capacity - size
            bins.append([i])
            room.append(r)
        at[r].append(j)
        rooms |= 1 << r


class Packing:
    """A chromosome: bins are its genes."""

    def __init__(self, bins: list[list[int]], room: list[int]):
        self.bins, self.room = bins, room

    def worth(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then fuller ones (mean squared fill)."""
        return -len(self.bins), sum((capacity - r) ** 2 for r in self.room)

    def coded(self, n: int) -> bytes:
        out = np.zeros(n, np.int32)
        for j, b in enumerate(self.bins):
            out[b] = j
        return out.tobytes()

    @classmethod
    def decoded(cls, code: bytes, length: list[int], capacity: int) -> Packing:
        owner = np.frombuffer(code, np.int32)
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        bins = [b.tolist() for b in np.split(order, cuts)] if len(owner) else []
        return cls(bins, [capacity - sum(length[i] for i in b) for b in bins])


def exchanged(displaced: list[int], length: list[int], bins: list[list[int]], room: list[int], capacity: int, rng: random.Random) -> list[int]:
    """Fill bins better by taking one displaced piece in place of one or two shorter pieces of a bin; what is displaced then.

    Each exchange leaves less room in a bin, and what goes out is shorter than what comes in, so it packs more easily."""
    out = sorted(displaced, key=length.__getitem__, reverse=True)
    for j in rng.sample(range(len(bins)), min(len(bins), TRIED)):
        if not room[j] or not out:
            continue
        items, best = bins[j], (0, None, ())
        if len(items) > 12:
            continue  # bins of many short pieces are full enough; best-fit fills them
        pairs = [(i,) for i in items] + [(i, k) for n, i in enumerate(items) for k in items[:n]]
        for gone in pairs:
            free = room[j] + sum(length[i] for i in gone)
            # The longest displaced piece that fits and is longer than what goes.
            low, high = 0, len(out)
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if length[out[mid]] <= free else (mid + 1, high)
            if low < len(out) and (gain := length[out[low]] - (free - room[j])) > best[0]:
                best = (gain, low, gone)
        gain, at, gone = best
        if gain:
            come = out.pop(at)
            bins[j] = [i for i in items if i not in gone] + [come]
            room[j] -= gain
            out = sorted([*out, *gone], key=length.__getitem__, reverse=True)
    return out


def crossed(a: Packing, b: Packing, length: list[int], capacity: int, rng: random.Random) -> Packing:
    """Inject well-filled bins of b whole into a, remove a's bins that repeat their pieces, best-fit the displaced."""
    good = sorted(range(len(b.bins)), key=b.room.__getitem__)[: max(1, len(b.bins) // 2)]
    chosen = rng.sample(good, max(1, len(good) // 2))
    new = {i for j in chosen for i in b.bins[j]}
    bins, room, displaced = [b.bins[j][:] for j in chosen], [b.room[j] for j in chosen], []
    for items, r in zip(a.bins, a.room, strict=True):
        if new.isdisjoint(items):
            bins.append(items[:])
            room.append(r)
        else:
            displaced += [i for i in items if i not in new]
    best_fit(exchanged(displaced, length, bins, room, capacity, rng), length, bins, room, capacity)
    return Packing(bins, room)


def mutated(a: Packing, length: list[int], capacity: int, rng: random.Random) -> Packing:
    """Empty the least filled bins and a few others, and best-fit their pieces."""
    worst = sorted(range(len(a.bins)), key=a.room.__getitem__, reverse=True)[: 2 + len(a.bins) // 50]
    gone = {*worst, *rng.sample(range(len(a.bins)), min(len(a.bins), 2 + len(a.bins) // 50))}
    out = Packing([b[:] for j, b in enumerate(a.bins) if j not in gone], [r for j, r in enumerate(a.room) if j not in gone])
    left = exchanged([i for j in gone for i in a.bins[j]], length, out.bins, out.room, capacity, rng)
    best_fit(left, length, out.bins, out.room, capacity)
    return out


def evolved(length: list[int], codes: list[bytes], capacity: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> list[bytes]:
    """One epoch of an island; the best packing comes first."""
    rng = random.Random(seed)
    everyone = [Packing.decoded(c, length, capacity) for c in codes]
    while len(everyone) < population:  # best-fit decreasing first, then with shaken orders
        shake = 0.0 if not everyone else 0.2
        bins: list[list[int]] = []
        room: list[int] = []
        best_fit(sorted(range(len(length)), key=lambda i: length[i] * (1 - shake * rng.random()), reverse=True), length, bins, room, capacity)
        everyone.append(Packing(bins, room))
    rank = lambda p: p.worth(capacity)
    everyone.sort(key=rank, reverse=True)
    least = least_bins(length, capacity)
    for _ in range(generations):
        if len(everyone[0].bins) <= least:
            break
        a, b = rng.sample(everyone, 2)
        for child in (crossed(a, b, length, capacity, rng), mutated(everyone[0], length, capacity, rng)):
            if rank(child) > rank(everyone[-1]):
                everyone[-1] = child
                everyone.sort(key=rank, reverse=True)
    return [p.coded(len(length)) for p in everyone]


def least_bins(length: list[int], capacity: int) -> int:
    """No packing has fewer bins: pieces over half the capacity need one each, and all need room for their sum."""
    return max(-(-sum(length) // capacity), sum(2 * n > capacity for n in length))


def evolved_blocks(todo: DataFrame, blocks: int, capacity: int, seed: int) -> DataFrame:
    """block, items (row, piece, length) and code (the best packing) of pieces dealt to so many blocks."""
    dealt = todo.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "row", "piece"), F.lit(blocks)))
    table = materialize(dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", "piece", "length"))).alias("items")))

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                codes = [evolved([int(x) for x in r.lengths], list(r.codes), capacity, hash((seed, r.block, r.island, number))) for r in batch.itertuples()]
                bins = [int(np.frombuffer(c[0], np.int32).max(initial=-1)) + 1 for c in codes]
                yield pd.DataFrame({"block": batch.block, "island": batch.island, "lengths": batch.lengths, "codes": codes, "bins": bins})

        return run

    state = table.select("block", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), F.transform("items", lambda x: x["length"]).alias("lengths"), F.array().cast("array<binary>").alias("codes"))
    tasks = int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for number in range(EPOCHS):
        if number:  # elites migrate along the ring
            elite = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("codes")[0].alias("elite"))
            state = state.join(elite, ["block", "island"]).select("block", "island", "lengths", F.concat(F.array("elite"), F.slice("codes", 1, POPULATION - 1)).alias("codes"))
        state = materialize(map_pandas(state.repartition(tasks, "block", "island"), epoch(number), "block long, island int, lengths array<long>, codes array<binary>, bins int"))
    best = state.groupBy("block").agg(F.min_by(F.col("codes")[0], F.struct("bins", "island")).alias("code"))
    return table.join(best, "block")


def placed(blocks: DataFrame, capacity: int, number: int) -> DataFrame:
    """row, piece, length, sequence_id, offset and opened (the bin is one of its block's least filled, or of those with the
    most pieces, as short pieces are what fills the others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, items, code in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                owner, length = np.frombuffer(code, np.int32), np.array([x["length"] for x in items], np.int64)
                order = np.argsort(owner, kind="stable")
                before = np.cumsum(length[order]) - length[order]
                head = np.concatenate([[True], np.diff(owner[order]) != 0])
                offset = np.zeros(len(order), np.int64)
                offset[order] = before - np.maximum.accumulate(np.where(head, before, 0))
                filled = np.bincount(owner, length).astype(np.int64)
                worst = np.argsort(filled, kind="stable")[: 2 + int(len(filled) * OPENED)]
                finest = np.argsort(-np.bincount(owner), kind="stable")[: 1 + int(len(filled) * FINEST)]
                opened = np.isin(owner, np.union1d(worst[filled[worst] < capacity], finest) if (filled < capacity).any() else worst[:0])
                columns = [pa.array([x["row"] for x in items], pa.int64()), pa.array([x["piece"] for x in items], pa.int32()), pa.array(length), pa.array(owner.astype(np.int64) + (b << 24) + (number << 58)), pa.array(offset), pa.array(opened)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "piece", "length", "sequence_id", "offset", "opened"])

    return map_arrow(blocks, run, "row long, piece int, length long, sequence_id long, offset long, opened boolean")


def packed(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, seed: int = 6) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32, sequence_id, offset of stored pieces."""
    todo, n, number, done = pieces.select("row", "piece", "length"), pieces.count(), 0, []
    while True:
        blocks = max(1, -(-n // block))
        now = materialize(placed(evolved_blocks(todo, blocks, capacity, seed + number), capacity, number))
        n = now.where("opened").count() if blocks > 1 else 0
        if blocks == 1 or -(-n // block) >= blocks:
            done.append(now)
            break
        done.append(now.where("not opened"))
        todo, number = now.where("opened").select("row", "piece", "length"), number + 1
    places = reduce(DataFrame.unionByName, done).select("row", "piece", "sequence_id", "offset")
    return pieces.join(places, ["row", "piece"])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack; one row per piece."""
    return packed(materialize(tokenised(docs, tokenizer, capacity, end_id)), capacity)


def packed_ids(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and the doc_ids in them. A sequence is at most `capacity` ids."""
    docs = stable(docs.select("doc_id", "text"))
    places = pack_documents(docs, tokenizer, capacity, end_id).select("row", "piece", "sequence_id", "offset")
    parts = tokenised(docs, tokenizer, capacity, end_id, with_ids=True).join(places, ["row", "piece"])
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return parts.groupBy("sequence_id").agg(inside.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
