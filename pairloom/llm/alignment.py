"""Alignment of two tokenizers by an event sweep over the byte offsets where their tokens end.

Each text is encoded by both; slices of each side's tokens are rows with the offset where they begin, A's and B's together.
They are dealt by document and sorted by offset, and a state machine reads them in that order: it holds no more than the
tokens after the last offset where both sides end. Each such offset closes a group, and each end of either side closes a
link, the overlap of one A token with one B token. Links are counted corpus-wide in two steps: the distinct pairs of a block
of documents are counted where they arise, and only those counts are shuffled. The totals then go back by block, and each
block's documents read them beside their links.

Texts are encoded word by word, each distinct word once, where neither tokenizer can join what a space divides; texts with
runs of white space and the like are encoded whole. Tests hold both against the libraries.

Defined results: null and empty texts, and texts whose joined token bytes differ from space + text, have no tokens: zeros and
an empty digest; repeated rows are documents of their own and all count; rows without doc_id keep it null; empty tables give
empty results; other columns are not looked at; a text of any length streams through in slices.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, row_keyed, scratch, stable
from .side_files import part_of, written_by
from .tokens import byte_symbols, text_slices

#: Tokens of an event slice, tokens swept at a time, links of a block, bytes of the table of words.
SLICE_TOKENS, SWEEP_TOKENS, BLOCK_LINKS, WORD_TABLE_BYTES = 1 << 14, 1 << 19, 1 << 22, 96 << 20
#: The published splitting pattern of the byte-level vocabulary (fixed value).
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_MARK = "▁"


class Ragged:
    """Rows of ids of any length, appended and gathered in bulk."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.sizes, self.rows = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while self.rows + len(sizes) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        to = slice(self.rows, self.rows + len(sizes))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[to], self.sizes[to] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.rows = self.used + len(flat), to.stop

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))], sizes


class TwoTokenizers:
    """A: a byte-level vocabulary (its JSON file); B: a piece vocabulary with byte fallback (its model file)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {s: b for b, s in byte_symbols().items()}
        vocab = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = {t["id"] for t in spec["added_tokens"]}
        # Ids of this vocabulary are in order of their merges, so they serve as ranks.
        self.a = tiktoken.Encoding("a", pat_str=SPLITS, mergeable_ranks={t: i for t, i in vocab.items() if i not in special}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        hexes = [re.fullmatch(r"<0x([0-9A-F]{2})>", p) for p in pieces]
        self.bytes_b = [bytes([int(h[1], 16)]) if h else p.replace(SPACE_MARK, " ").encode() for p, h in zip(pieces, hexes, strict=True)]
        self.size_a = np.zeros(max(vocab.values()) + 1, np.int64)
        self.size_a[list(vocab.values())] = [len(t) for t in vocab]
        self.bytes_a = [b""] * len(self.size_a)
        for t, i in vocab.items():
            self.bytes_a[i] = t
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int64)
        if max(len(self.size_a), len(self.size_b)) > 1 << 16:
            raise ValueError("ids of these vocabularies do not fit 16 bits")
        # A piece with the mark after something else could join words.
        self.by_word = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.reset()

    def reset(self) -> None:
        self.slots: dict[str, int] = {}
        self.rows_a, self.rows_b, self.text_bytes, self.sure = Ragged(), Ragged(), 0, np.zeros(0, bool)

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one text by the libraries; none if either side's bytes differ from space + text."""
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text)
        wanted = b" " + text.encode()
        same = b"".join(map(self.bytes_a.__getitem__, a)) == wanted == b"".join(map(self.bytes_b.__getitem__, b))
        return (np.array(a, np.int32), np.array(b, np.int32)) if same and text else (np.zeros(0, np.int32), np.zeros(0, np.int32))

    def learn(self, words: list[str]) -> None:
        """New words go through the libraries as one text; tokens never cross the spaces between them. Words that are not
        sure to be told apart there, or whose bytes do not come back, are marked, and their texts encoded whole."""
        sure = [self.by_word and w != "" and not w[0].isspace() and SPACE_MARK not in w for w in words]
        known = [w for w, s in zip(words, sure, strict=True) if s]
        sizes = np.array([len(w.encode()) + 1 for w in known], np.int64)
        text = " ".join(known)
        fine = np.ones(len(known), bool)
        for rows, ids, size, table in (
            (self.rows_a, self.a.encode_ordinary(" " + text) if known else [], self.size_a, self.bytes_a),
            (self.rows_b, self.b.encode(text) if known else [], self.size_b, self.bytes_b),
        ):
            flat = np.array(ids, np.int32)
            ends, stops = np.cumsum(size[flat]), np.cumsum(sizes)
            last = np.searchsorted(ends, stops)
            if b"".join(map(table.__getitem__, ids)) != (b" " + text.encode() if known else b"") or (known and (ends[np.minimum(last, len(ends) - 1)] != stops).any()):
                fine[:] = False  # some word is odd: find out which, one by one
                counts = np.zeros(len(known), np.int64)
                flat = np.zeros(0, np.int32)
            else:
                counts = np.diff(np.concatenate([[0], last + 1]))
            rows.append(flat, counts)
        if not fine.all():
            self.relearn(known, fine)
        first = len(self.sure)
        self.slots.update(zip(known, range(first, first + len(known)), strict=True))
        odd = [w for w, s in zip(words, sure, strict=True) if not s]
        self.slots.update(zip(odd, range(first + len(known), first + len(words)), strict=True))
        for rows in (self.rows_a, self.rows_b):
            rows.append(np.zeros(0, np.int32), np.zeros(len(odd), np.int64))
        self.sure = np.concatenate([self.sure, fine, np.zeros(len(odd), bool)])
        self.text_bytes += int(sizes.sum())

    def relearn(self, known: list[str], fine: np.ndarray) -> None:
        """The last rows, word by word."""
        both = [self.whole(w) for w in known]
        for rows, side in ((self.rows_a, 0), (self.rows_b, 1)):
            rows.rows -= len(known)
            rows.used = int(rows.starts[rows.rows - 1] + rows.sizes[rows.rows - 1]) if rows.rows else 0
            rows.append(np.concatenate([x[side] for x in both]), np.array([len(x[side]) for x in both], np.int64))
        fine[:] = [len(a) > 0 for a, _ in both]

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of A, ids of B) of each text."""
        if 140 * len(self.slots) + self.text_bytes + 4 * (len(self.rows_a.flat) + len(self.rows_b.flat)) > WORD_TABLE_BYTES:
            self.reset()
        lists = pc.split_pattern(texts.fill_null("").cast(pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.slots]
        if new:
            self.learn(new)
        slots = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        unsure = np.concatenate([[0], np.cumsum(~self.sure[slots])])
        by_word = unsure[offsets[1:]] == unsure[offsets[:-1]]
        sides = []
        for rows in (self.rows_a, self.rows_b):
            flat, sizes = rows.gather(slots)
            bounds = np.concatenate([[0], np.cumsum(sizes)])[offsets]
            sides.append([flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        return [ab if ok else self.whole(texts[i].as_py() or "") for i, (ab, ok) in enumerate(zip(zip(*sides, strict=True), by_word.tolist(), strict=True))]


@lru_cache(maxsize=2)
def two_tokenizers(path_a: str, path_b: str) -> TwoTokenizers:
    return TwoTokenizers(path_a, path_b)


EVENTS = "rid long, doc_id long, start long, side int, n int, ids binary"


def token_events(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Slices of both sides' tokens of a table with rid, doc_id and text, with the byte offset where each begins: one row at
    least a document and side."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, pack = two_tokenizers(path_a, path_b), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at, texts in text_slices(batch.column(2)):
                keys = zip(batch.column(0).slice(at, len(texts)).to_pylist(), batch.column(1).slice(at, len(texts)).to_pylist(), strict=True)
                rows = []
                for (rid, doc_id), sides in zip(keys, two.encode(texts), strict=True):
                    for side, (ids, size) in enumerate(zip(sides, (two.size_a, two.size_b), strict=True)):
                        start = 0
                        for i in range(0, max(len(ids), 1), SLICE_TOKENS):
                            part = ids[i : i + SLICE_TOKENS]
                            rows.append((rid, doc_id, start, side, len(part), pack.compress(part.astype("<u4").tobytes())))
                            start += int(size[part].sum())
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["rid", "doc_id", "start", "side", "n", "ids"])

    return map_arrow(docs.select("rid", F.col("doc_id").cast("long"), "text"), encode, EVENTS)


class Sweep:
    """The state machine: slices go in by document and offset, finished documents come out."""

    def __init__(self, size_a: np.ndarray, size_b: np.ndarray):
        self.size = (size_a, size_b)
        wide = max(len(size_a), len(size_b))
        digits = [str(i).encode() for i in range(wide)]
        self.wide, self.text = wide, [sep + d for sep in (b"", b",", b"|", b";") for d in digits]
        self.held: tuple[list, list] = ([], [])  # arrays of ids after the last common end
        self.docs: list[list] = []  # [rid, doc_id, tokens of A given, of B, tokens of A swept, of B, groups, digest, links]
        self.waiting, self.enough = 0, SWEEP_TOKENS

    def give(self, rid: int, doc_id: int | None, side: int, ids: np.ndarray) -> None:
        if not self.docs or self.docs[-1][0] != rid:
            self.docs.append([rid, doc_id, 0, 0, 0, 0, 0, hashlib.sha256(), []])
        self.docs[-1][2 + side] += len(ids)
        self.held[side].append(ids)
        self.waiting += len(ids)

    def step(self, ended: bool) -> list[tuple]:
        """Close all groups that end within what was given; the documents that are complete. The last one is only if no
        more slices of it can come."""
        a, b = (np.concatenate(h) if h else np.zeros(0, np.int32) for h in self.held)
        ends_a, ends_b = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last = common[-1] if len(common) else 0
        n_a, n_b = np.searchsorted(ends_a, last, "right"), np.searchsorted(ends_b, last, "right")
        self.held = ([a[n_a:]], [b[n_b:]])
        self.waiting = len(a) - n_a + len(b) - n_b
        self.enough = SWEEP_TOKENS + 2 * self.waiting  # linear time even if a group is longer than that
        a, b, ends_a, ends_b = a[:n_a], b[:n_b], ends_a[:n_a], ends_b[:n_b]
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        every = np.union1d(ends_a, ends_b)
        links = (a[np.searchsorted(ends_a, every)].astype(np.uint32) << np.uint32(16)) | b[np.searchsorted(ends_b, every)].astype(np.uint32)
        codes = np.zeros(n_a + n_b, np.int64)
        kind = np.where(np.diff(group_a, prepend=-1) != 0, 3, 1)
        codes[np.arange(n_a) + np.searchsorted(group_b, group_a)] = kind * self.wide + a
        codes[np.arange(n_b) + np.searchsorted(group_a, group_b, "right")] = np.where(np.diff(group_b, prepend=-1) != 0, 2, 1) * self.wide + b
        done, at_a, at_b, at_link = [], 0, 0, 0
        for k, doc in enumerate(self.docs):
            stop_a, stop_b = min(n_a, at_a + doc[2] - doc[4]), min(n_b, at_b + doc[3] - doc[5])
            if stop_a > at_a:
                stop_link = int(np.searchsorted(every, ends_a[stop_a - 1], "right"))
                text = codes[at_a + at_b : stop_a + stop_b].tolist()
                if not doc[4]:
                    text[0] -= 3 * self.wide  # nothing stands before a document's first group
                doc[7].update(b"".join(map(self.text.__getitem__, text)))
                doc[8].append(links[at_link:stop_link])
                doc[6] += int(group_a[stop_a - 1] - group_a[at_a]) + 1
                doc[4], doc[5], at_link = doc[4] + stop_a - at_a, doc[5] + stop_b - at_b, stop_link
            at_a, at_b = stop_a, stop_b
            if k + 1 < len(self.docs) or ended:
                if doc[2] != doc[4] or doc[3] != doc[5]:
                    raise RuntimeError("the two sides of a document end at different bytes")
                joined = np.concatenate(doc[8]) if doc[8] else np.zeros(0, np.uint32)
                done.append((doc[0], doc[1], doc[2], doc[3], doc[6], doc[7].hexdigest() if doc[2] else "", joined))
        self.docs = self.docs[len(done) :]
        return done


SWEPT = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pairs array<long>, counts array<long>"


def swept(events: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Documents with their groups and links, in blocks, and one row more a block with its distinct pairs and their counts."""

    def block_rows(block: int, docs: list[tuple]) -> pa.RecordBatch:
        pairs, counts = np.unique(np.concatenate([d[6] for d in docs]), return_counts=True)
        none = [None]
        columns = [
            pa.array([block] * (len(docs) + 1), pa.int64()), pa.array([d[1] for d in docs] + none, pa.int64()),
            *(pa.array([d[i] for d in docs] + none, pa.int64()) for i in (2, 3, 4)), pa.array([d[5] for d in docs] + none, pa.string()),
            pa.array([d[6].astype("<u4").tobytes() for d in docs] + none, pa.binary()),
            pa.array([None] * len(docs) + [pairs.astype(np.int64)], pa.list_(pa.int64())), pa.array([None] * len(docs) + [counts], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SWEPT.split(", ")])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, unpack = two_tokenizers(path_a, path_b), zstandard.ZstdDecompressor()
        machine, docs, links, block = Sweep(two.size_a, two.size_b), [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for rid, doc_id, side, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 5)), strict=True):
                machine.give(rid, doc_id, side, np.frombuffer(unpack.decompress(ids), "<u4").astype(np.int32))
                if machine.waiting >= machine.enough:
                    done = machine.step(False)
                    docs, links = docs + done, links + sum(len(d[6]) for d in done)
                    if links >= BLOCK_LINKS:
                        yield block_rows(block, docs)
                        docs, links, block = [], 0, block + 1
        docs += machine.step(True)
        if docs:
            yield block_rows(block, docs)

    dealt = events.repartition("rid").sortWithinPartitions("rid", "start", "side")
    return map_arrow(dealt, sweep, SWEPT)


def pair_totals(found: DataFrame) -> DataFrame:
    """block, pair, total, best: the corpus-wide count of each pair of a block, and if it is the highest of its B id."""
    counted = found.where("pairs IS NOT NULL").select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    totals = materialize(counted.groupBy("pair").agg(F.sum("n").alias("total")))
    b = F.col("pair").bitwiseAND(65535)
    most = totals.groupBy(b.alias("b")).agg(F.max("total").alias("most"))  # a row for each id of B at most
    marked = totals.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    return counted.select("block", "pair").join(marked, "pair")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def with_totals(found: DataFrame, folder: str) -> DataFrame:
    """The documents' rows, with the totals of their links' pairs."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pairs, total, best = None, np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        for batch in batches:
            links = [np.frombuffer(x, "<u4") for x in batch.column(6).to_pylist()]
            sizes = np.array([len(x) for x in links], np.int64)
            n_best, sums = np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
            blocks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if not sizes[low:high].sum():
                    continue
                if blocks[low] != block:
                    block = blocks[low]
                    table = part_of(folder, "block", int(block)).sort_by("pair")
                    pairs, total, best = (table[c].to_numpy() for c in ("pair", "total", "best"))
                at = np.searchsorted(pairs, np.concatenate(links[low:high]))
                edges = np.concatenate([[0], np.cumsum(sizes[low:high])])
                for values, out in ((best, n_best), (total, sums)):
                    out[low:high] = np.diff(np.concatenate([[0], np.cumsum(values[at], dtype=np.int64)])[edges])
            columns = [*(batch.column(i) for i in (1, 2, 3, 4)), pa.array(sizes), pa.array(n_best), pa.array(sums), batch.column(5)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return map_arrow(found.where("links IS NOT NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"), look_up, RESULT)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "swept")
    rows = row_keyed(stable(docs.select("doc_id", "text")), "rid")
    swept(token_events(rows, path_a, path_b), path_a, path_b).write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(SWEPT).parquet(path)
    return with_totals(found, written_by(pair_totals(found), "block", "totals"))
