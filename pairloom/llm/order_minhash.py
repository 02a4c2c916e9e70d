"""Order MinHash fingerprints.

Words are the letters of the sequence and runs of k words its k-mers, each numbered by its occurrence in the text, so
that repeats count. All numbered k-mers lie on RINGS rings, each in the order of a hash of its own. For each of `m` orders
(a ring read from one of m / RINGS evenly turned starting points is a min-wise order) the `l` first k-mers are the minimal
ones; they are put back in text order and their tuple is hashed to one signature value. Two texts agree on a value only
if they share the minimal k-mers and their order, so the likeness falls with edit distance, not only with shared content.

Orders of different rings are independent, turns of one ring are not: a text with n k-mers has at most n different tuples
a ring. Several rings keep the spread of the likeness at about that of m independent orders from some 60 words on; at 20
words it is up to a third wider (a test measures both). All 64 orders independent would sort every text 64 times.

Everything is array functions of the JVM. Defined results: null texts count as empty; texts without words have the
fingerprint of the empty tuple, alike to each other (1.0) and unlike any other; texts with fewer than k words are one
k-mer; a character of a script without spaces is a word, and words are never cut; k-mers are told apart by 34 bits of
their hash, so of some 100,000 in one text a few share their numbering, in all texts alike; of rows that repeat a doc_id, or
have none, the order is that of the text's hash; equal texts have equal fingerprints; empty tables give empty results;
other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K, L, M, RINGS = 3, 2, 64, 4
#: Characters that are words of their own (kana, Han, Hangul); all other words stand between white space.
ALONE = r"\u3040-\u30FF\u4E00-\u9FFF\uAC00-\uD7A3"
TOKEN = rf"[{ALONE}]|[^\x20\x09-\x0D{ALONE}]+"
#: Low bits of a packed number hold a position; arrays of Spark have fewer elements than that.
AT_BITS = 30
AT_MASK = (1 << AT_BITS) - 1


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times in `body`; lambda variables are bound to finished arrays."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _packed(h: Column, at: Column) -> Column:
    return h.bitwiseAND(F.lit(~AT_MASK)).bitwiseOR(at.cast("long"))


def _high(x: Column) -> Column:
    return F.shiftright(x, AT_BITS)


def _powers(n: Column) -> Column:
    """Powers of two up to n, falling, for a binary search in an array of n elements."""
    return F.transform(F.sequence(F.ceil(F.log2(n + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1), b))


def lower_bound(s: Column, powers: Column, value: Column) -> Column:
    """How many elements of the sorted array s are below value."""
    step = lambda acc, p: F.when((acc + p <= F.size(s)) & (F.get(s, acc + p - 1) < value), acc + p).otherwise(acc)
    return F.aggregate(powers, F.lit(0), step)


def kmer_hashes(w: Column, k: int) -> Column:
    """Hash and place of each run of k words, packed."""
    n = F.size(w)
    many = F.transform(F.slice(w, 1, F.greatest(n - (k - 1), F.lit(0))), lambda x, i: _packed(F.xxhash64(x, *(F.get(w, i + j) for j in range(1, k))), i))
    whole = F.array(F.xxhash64(F.concat_ws(" ", w)).bitwiseAND(F.lit(~AT_MASK)))
    return F.when(n >= k, many).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))


def numbered(words: Column, k: int) -> Column:
    """Longs: the high bits are the hash of (k-mer, occurrence number), the low bits its place in the text."""

    def number(s: Column, powers: Column) -> Column:
        same = lambda x, i, p: (i >= p) & (_high(F.get(s, F.greatest(i - p, F.lit(0)))) == _high(x))
        # Equal k-mers are neighbours in s, in text order: search how many stand before this one.
        before = lambda x, i: F.aggregate(powers, F.lit(0), lambda acc, p: F.when(same(x, i, acc + p), acc + p).otherwise(acc))
        return F.transform(s, lambda x, i: _packed(F.xxhash64(_high(x), F.when(same(x, i, F.lit(1)), before(x, i)).otherwise(F.lit(0))), x.bitwiseAND(F.lit(AT_MASK))))

    by_kmer = F.sort_array(let(words, lambda w: kmer_hashes(w, k)))
    return let(by_kmer, lambda s: let(_powers(F.size(s)), lambda p: number(s, p)))


def ring(kmers: Column, number: int) -> Column:
    """The numbered k-mers in the order of one hash."""
    if number:
        kmers = F.transform(kmers, lambda x: _packed(F.xxhash64(_high(x), F.lit(number)), x.bitwiseAND(F.lit(AT_MASK))))
    return F.sort_array(kmers)


def signature(text: Column, k: int = K, l: int = L, m: int = M, rings: int = RINGS) -> Column:  # noqa: E741
    """m values: for each order the hash of the l minimal numbered k-mers in text order."""
    turns = F.array(*(F.lit(-(1 << 63) + j * ((1 << 64) // (m // rings))) for j in range(m // rings)))
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def value(s: Column, at: Column) -> Column:
        n = F.size(s)
        chosen = F.transform(F.slice(F.array(*map(F.lit, range(l))), 1, F.least(n, F.lit(l))), lambda j: F.get(s, (at + j) % n))
        # Places to the high bits, to sort by them; then the hashes alone are kept.
        turned = F.transform(chosen, lambda x: F.shiftleft(x, 64 - AT_BITS).bitwiseOR(F.shiftrightunsigned(x, AT_BITS)))
        return F.xxhash64(F.transform(F.sort_array(turned), lambda x: x.bitwiseAND(F.lit((1 << (64 - AT_BITS)) - 1)))).bitwiseAND(F.lit(0xFFFFFFFF))

    each = lambda s, p: F.transform(turns, lambda t: value(s, lower_bound(s, p, t)))
    of_rings = lambda n: F.flatten(F.transform(F.array(*(ring(n, r) for r in range(rings))), lambda s: let(_powers(F.size(s)), lambda p: each(s, p))))
    return let(numbered(words, k), of_rings)


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda v: F.lpad(F.hex(v), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal signature values."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x) / F.size(a)


def bucketed(docs: DataFrame) -> DataFrame:
    """doc_id, text, tie and bucket: ranges of doc_id with about as many rows each; their number is bounded by the
    session's shuffle partitions and 2048, so the bounds and one row a bucket are small whatever the input."""
    spark = docs.sparkSession
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("b")).first()
    bounds = F.array(*map(F.lit, sorted(set((found and found["b"]) or [0]))))
    powers = F.array(*(F.lit(1 << i) for i in range(n.bit_length(), -1, -1)))
    # Rows without a number come first; they spread over buckets of their own by their hash.
    unnumbered = F.shiftright("tie", 53).cast("int") - 4096
    return docs.withColumn("tie", F.xxhash64("text")).withColumn("bucket", F.coalesce(lower_bound(bounds, powers, F.col("doc_id")), unnumbered))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sig, next_text, next_sig: the next document in ascending doc_id; after the last, the first.

    One shuffle of the texts, by range of doc_id; the last row of a range takes the first of the next from a table
    of one row a range."""
    rows = bucketed(docs)
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "tie")
    firsts = materialize(rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("f")))
    every = Window.orderBy("bucket")
    turn = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = firsts.select("bucket", F.coalesce(F.lead("bucket").over(every), F.first("bucket").over(turn)).alias("after"))
    is_first = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("tie") == F.col("f.tie"))
    heads = rows.join(F.broadcast(firsts), "bucket").where(is_first).groupBy("bucket").agg(F.first("text").alias("head_text"))
    heads = heads.withColumn("head_sig", signature(F.col("head_text"))).withColumnRenamed("bucket", "after")
    heads = F.broadcast(links).join(heads, "after").drop("after")
    signed = rows.withColumn("sig", signature(F.col("text")))
    signed = signed.withColumns({"next_text": F.lead("text").over(order), "next_sig": F.lead("sig").over(order)})
    heads = heads.withColumnRenamed("bucket", "b")
    joined = signed.join(heads, (F.col("bucket") == F.col("b")) & F.col("next_text").isNull(), "left")
    return joined.select("doc_id", "text", "sig", F.coalesce("next_text", "head_text").alias("next_text"), F.coalesce("next_sig", "head_sig").alias("next_sig"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms (second half replaced by the start of the next document)."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    both = with_next(docs).withColumn("n_chars", n.cast("long")).withColumn("edited", edited).drop("next_text", "text")
    both = both.withColumn("edited_sig", signature(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
