"""The corpus pipeline: quality, exact copies, near copies, source weights, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Each stage works on what
the one before kept, written as Parquet and read again. All but the last return the columns of `documents`; the last
returns the packed pieces.

Defined results of every stage: null texts count as empty; repeated rows and rows without doc_id are rows of their own
(exact_dedup and near-dedup keep one of them); ties go to the first row; an empty table gives an empty table; other
columns, whatever their names, are kept as they are. The quality stage reads labels of the input folder and never those
of the held-out fold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import exact_dedup, near_copies, packing, quality, source_mix
from pairloom.llm.common import stored, table
from pairloom.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (operator 10)."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays (operator 5)."""
    return exact_dedup.drop_exact_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays (operator 3, with fingerprints wide enough
    for texts whose five-word shingles have a similarity of 0.8, and an exact check)."""
    return near_copies.drop_near_copies(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mix takes them (operator 8)."""
    return source_mix.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences (operator 6)."""
    return packing.pack_documents(docs, tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_quality),
    ("exact_dedup", no_exact_copies),
    ("simhash_near_dedup", no_near_copies),
    ("source_mix", mixed_sources),
    ("best_fit_packing", packed_sequences),
]

#: Hinge-loss fitting, token ids and evolved packings are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
