"""Flat token files and the separator scan.

Documents are written as files of nothing but unsigned 16-bit ids, each document followed by the separator; there is no
index. The scan reads fixed blocks of those files in parallel, finds the separators of a block with one vectorised
comparison, and keeps for each block the lengths between its separators and what stands open at its ends. A prefix scan
over the blocks of a file (a few numbers a block) then joins the documents that cross blocks and numbers all documents.

Defined results: null texts count as empty (0 tokens); tokens after a file's last separator are a document of their own,
not closed; empty files have no documents; a file of odd length is an error; repeated rows are documents of their own; ids
that are the separator or do not fit 16 bits (another vocabulary) are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, map_pandas, materialize, scratch
from .tokens import text_slices, word_bpe

#: The separator is no id of the vocabulary.
SEPARATOR, BLOCK_IDS, FILE_IDS = 65535, 1 << 20, 1 << 25


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file that all executors share (file:, hdfs:, s3: ...)."""
    return fs.FileSystem.from_uri(quote(unquote(uri), safe=":/"))


def fitting(ids: np.ndarray, separator: int) -> np.ndarray:
    """The ids, if each can be told from the separator in 16 bits."""
    if len(ids) and (int(ids.max()) > 65535 or (ids == separator).any()):
        raise ValueError("an id of this vocabulary is the separator or does not fit 16 bits")
    return ids


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, separator: int = SEPARATOR, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files; the manifest that comes back has for each document its file and its number in it.

    Files have names of the task attempt; one that a lost attempt left is in no manifest, so it is never read."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = word_bpe(tokenizer), TaskContext.get()
        store, path = opened(folder)
        store.create_dir(path)
        out, name, files, written, number = None, "", 0, 0, 0
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                ids, n = bpe.encode(texts)
                flat = np.full(len(ids) + len(n), separator, "<u2")
                inside = np.ones(len(flat), bool)
                inside[np.cumsum(n + 1) - 1] = False
                flat[inside] = fitting(ids, separator)
                if out is None or written >= file_ids:
                    if out is not None:
                        out.close()
                    name, files, written, number = f"{task.partitionId():06d}-{task.taskAttemptId()}-{files:06d}.u16", files + 1, 0, 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                out.write(flat.tobytes())
                written += len(flat)
                rows = len(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array([name] * rows), pa.array(np.arange(number, number + rows, dtype=np.int64))], ["doc_id", "file", "number"])
                number += rows
        if out is not None:
            out.close()

    return materialize(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), write, "doc_id long, file string, number long"))


def scan_blocks(spark: SparkSession, folder: str, files: DataFrame, separator: int = SEPARATOR, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row a block: file, block, head (ids before its first separator), inner (lengths between separators), tail (ids
    after its last), n (separators). A block without separators has its length as head and nothing else."""

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = opened(folder)
        for batch in batches:
            size = [store.get_file_info(f"{path}/{f}").size for f in batch.file]
            if any(s % 2 for s in size):
                raise ValueError("a token file ends within an id")
            yield pd.DataFrame([(f, b, max(1, s // 2)) for f, s in zip(batch.file, size, strict=True) for b in range(-(-s // (2 * block_ids)))], columns=["file", "block", "ids"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = opened(folder)
        for batch in batches:
            for f, b in zip(batch.file, batch.block, strict=True):
                with store.open_input_file(f"{path}/{f}") as source:
                    source.seek(2 * block_ids * b)
                    ids = np.frombuffer(source.read(2 * block_ids), "<u2")
                at = np.flatnonzero(ids == separator)
                head = int(at[0]) if len(at) else len(ids)
                tail = len(ids) - int(at[-1]) - 1 if len(at) else 0
                yield pd.DataFrame({"file": [f], "block": [b], "head": [head], "inner": [np.diff(at) - 1], "tail": [tail], "n": [len(at)]})

    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = map_pandas(files, sizes, "file string, block long, ids long").repartition(n, "file", "block")
    return materialize(map_pandas(listed, scan, "file string, block long, head long, inner array<long>, tail long, n long"))


def document_lengths(blocks: DataFrame) -> DataFrame:
    """file, number, n_tokens, closed: stitch documents across blocks with a prefix scan over each file's blocks.

    A file is at most FILE_IDS ids and one batch, so it has a bounded number of blocks."""
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Ids open before a block: those of all blocks since the last separator, as a difference of running sums.
    ran = F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("head")).otherwise(0)).over(past), F.lit(0))
    marked = blocks.withColumns({"before": F.coalesce(F.sum("n").over(past), F.lit(0)), "ran": ran})
    since = F.when(F.col("n") > 0, F.col("ran") - F.col("tail"))
    marked = marked.withColumn("open", F.col("ran") - F.coalesce(F.last(since, ignorenulls=True).over(past), F.lit(0)))
    closed = marked.where("n > 0").select("file", F.posexplode(F.concat(F.array(F.col("open") + F.col("head")), F.col("inner"))).alias("i", "n_tokens"), "before")
    closed = closed.select("file", (F.col("before") + F.col("i")).alias("number"), "n_tokens", F.lit(True).alias("closed"))
    ends = marked.groupBy("file").agg(F.max_by(F.struct((F.col("before") + F.col("n")).alias("number"), F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("open") + F.col("head")).alias("left")), "block").alias("e"))
    return closed.unionByName(ends.where("e.left > 0").select("file", "e.number", F.col("e.left").alias("n_tokens"), F.lit(False).alias("closed")))


def token_counts(docs: DataFrame, tokenizer: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """doc_id, file, number, n_tokens: documents written to flat files and counted by the separator scan alone."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    manifest = write_token_files(docs, folder, tokenizer)
    blocks = scan_blocks(spark, folder, manifest.select("file").distinct(), block_ids=block_ids)
    counted = materialize(manifest.join(document_lengths(blocks), ["file", "number"]).select("doc_id", "file", "number", "n_tokens"))
    if counted.count() != manifest.count():
        raise RuntimeError("the token files do not hold the documents of the manifest")
    return counted
