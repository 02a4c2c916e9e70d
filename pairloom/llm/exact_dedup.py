"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own content says so, each distinct chunk gets an identifier that is verified byte by byte,
and texts are equal when their ordered lists of identifiers (recipes) are. A chunk's bytes are moved once, after
combining equal chunks within each map task; whole documents are never shuffled.

Defined results: null texts count as empty, and all empty texts are equal (their recipe is the empty list); of rows that
repeat a doc_id and its text, one stays; null doc_ids count as the smallest; empty tables give empty results; other columns
are kept as they are and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_spread, lower_az, materialize, named, row_keyed, stable

MIN_CHUNK, MAX_CHUNK = 512, 4096


def every(first: int, last: int, step: int, share: int) -> str:
    """A class of characters: of each `step` code points the first step / share."""
    return "".join(rf"\x{{{c:X}}}-\x{{{min(c + step // share - 1, last):X}}}" for c in range(first, last, step))


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    """A chunk ends at the first place after `least` characters where the local content triggers a cut: after a line or
    sentence end, a space that follows certain letter pairs, a mark that ends a statement or tag in code, or two
    characters of certain code points where a script has no spaces. None longer than `most`: only content without any of
    these is cut by length."""
    wide = every(0x3040, 0x30FF, 16, 4) + every(0x4E00, 0x9FFF, 512, 4) + every(0xAC00, 0xD7A3, 512, 4)
    trigger = rf"(?:(?<=\n)|(?<=[.!?] )|(?<=[。！？;}}>])|(?<=[aeiou][lmnr] )|(?<=[{wide}]{{2}})|\z)"
    return rf"(?s).{{{least},{most}}}?{trigger}|.{{1,{most}}}"


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The ordered chunks of a text; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))


def clashing_identifiers(pieces: DataFrame) -> DataFrame:
    """Verify identifiers: those of `pieces` (h, chunk) that stand for more than one distinct chunk."""
    return pieces.groupBy("h").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).where("lo != hi").select("h")


def recipes(docs: DataFrame, hash_of=F.xxhash64) -> DataFrame:
    """doc_id, rid, text_sha256 and recipe (ordered verified identifiers: hashes, then ranks of the chunks whose hash is not theirs alone)."""
    keyed = row_keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "rid")
    cut = keyed.withColumn("text", lower_az(F.col("text"))).withColumn("chunks", chunks(F.col("text")))
    listed = materialize(
        cut.select("rid", "doc_id", F.sha2("text", 256).alias("text_sha256"), F.transform("chunks", lambda c: hash_of(c)).alias("hashes"))
    )
    # Outer, as the plain form puts a filter on the array's size below it and so cuts every text twice.
    pieces = cut.select("rid", F.posexplode_outer("chunks").alias("at", "chunk")).where("chunk is not null").withColumn("h", hash_of(F.col("chunk")))
    clashes = materialize(clashing_identifiers(pieces.select("h", "chunk")))
    if clashes.isEmpty():  # every hash stands for one chunk: hashes are verified identifiers
        return listed.withColumnRenamed("hashes", "recipe")
    # Exact way for the rest: chunks of a clashing hash are told apart by their bytes. Recipes without such a chunk stay as
    # they are; to the others, ranks of those chunks among the ones of their hash are appended in text order. A clashing
    # hash stands for few chunks, so one window partition is small.
    touched = pieces.join(clashes, "h", "left_semi")
    rank = F.dense_rank().over(Window.partitionBy("h").orderBy("chunk")).cast("long")
    ranks = materialize(touched.select("h", "chunk").distinct().withColumn("rank", rank))
    marks = touched.join(ranks, ["h", "chunk"]).groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "rank"))), lambda m: m["rank"]).alias("ranks"))
    return listed.join(marks, "rid", "left").select("rid", "doc_id", "text_sha256", F.concat("hashes", F.coalesce("ranks", F.array().cast("array<bigint>"))).alias("recipe"))


def exact_groups(docs: DataFrame, hash_of=F.xxhash64) -> DataFrame:
    """One row per document of a `stable` table: rid, doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the largest doc_id stays.

    A large group's facts are broadcast, so its documents, however many, are never dealt by recipe."""
    listed = recipes(docs, hash_of)
    groups = materialize(listed.groupBy("recipe").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("n")))
    met = join_spread(listed, groups.withColumn("group_size", F.col("n")), "recipe", listed.count())
    return met.select("rid", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    docs = stable(docs)
    key = fresh(docs, "rid")
    kept = exact_groups(docs).where("kept").select(F.col("rid").alias(key))
    return row_keyed(docs, key).join(kept, key, "left_semi").select(*map(named, docs.columns))
