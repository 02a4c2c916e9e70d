"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, html_text, license_scan, order_minhash, packing, periodic_runs, quality, simhash, source_mix, suffix_dedup, token_files, warc
from .common import LOWER, UPPER, stable, table


def tokenizer_path() -> str:
    """Where the public vocabulary file lies; every operator takes it as a parameter."""
    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages")).drop("file", "start", "stop")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_counts(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "n_tokens")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(stable(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(stable(table(spark, sf_dir, "documents"))).drop("rid")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_likeness(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(stable(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_token_counts": op2_token_counts,
    "op3_simhash": op3_simhash,
    "op4_license_scan": op4_license_scan,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_order_minhash": op7_order_minhash,
    "op8_source_mix": op8_source_mix,
    "op9_html_text": op9_html_text,
    "op10_quality": op10_quality,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

_NORMAL = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

_TEMPLATES = ", ".join(f"({i}, '{label}', {base}, {k}, '{' '.join(words)}')" for i, label, base, k, words in license_scan.templates())

# Five hex digits of a SHA-1 are 20 bits, which are four characters of base32.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(sha1(h), 5 * (i // 4) + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31) + 1 AS INTEGER), 1)), '')"""

ORACLE_SQL = {
    "op1_warc": f"""
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = k THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> k THEN k END AS refers_to
        FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS k FROM pages)""",
    "op4_license_scan": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_NORMAL}, '{license_scan.WORD}') AS w FROM documents),
        g AS (SELECT r, p, w[p + 1 : p + 2] AS g2, w[p + 1 : p + 5] AS g5 FROM (SELECT r, w, unnest(range(len(w))) AS p FROM d)),
        t AS (SELECT tpl, label, base, k, string_split(txt, ' ') AS tw FROM (VALUES {_TEMPLATES}) v(tpl, label, base, k, txt)),
        tg AS (SELECT tpl, label, base, k, len(tw) - k + 1 AS grams, len(tw) AS size, a, tw[a + 1 : a + k] AS gram
               FROM (SELECT *, unnest(range(len(tw) - k + 1)) AS a FROM t)),
        v AS (SELECT r, tpl, label, base, grams, size, p - a AS diagonal, p FROM g JOIN tg ON tg.k = 2 AND gram = g2
              UNION ALL SELECT r, tpl, label, base, grams, size, p - a, p FROM g JOIN tg ON tg.k = 5 AND gram = g5),
        s AS (SELECT r, tpl, label, base, grams, size, diagonal, count(*) AS n, min(p) AS lo, max(p) AS hi FROM v GROUP BY ALL),
        q AS (SELECT *, sum(apart) OVER (PARTITION BY r, tpl ORDER BY diagonal) AS run
              FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, tpl ORDER BY diagonal) <= {license_scan.GAP} THEN 0 ELSE 1 END AS apart
                    FROM s WHERE NOT base)),
        m AS (SELECT r, label, least(1.0, sum(n) / any_value(grams)) AS coverage, min(lo) AS lo, max(hi) AS hi, any_value(size) AS size FROM q GROUP BY r, tpl, label, run),
        f AS (SELECT r, label, true AS base, diagonal AS start, 1.0 AS coverage FROM s WHERE base AND n = grams
              UNION ALL SELECT r, label, false, lo, coverage FROM m WHERE coverage >= {license_scan.COVERAGE} AND hi + 5 - lo <= size * {license_scan.STRETCH})
        SELECT any_value(doc_id) AS doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base,
               CAST(min(start) FILTER (base) AS BIGINT) AS first_word, CAST(max(start) FILTER (base) AS BIGINT) AS last_word,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, CAST(coalesce(max(coverage), 0) AS DOUBLE) AS score
        FROM d LEFT JOIN f USING (r) GROUP BY d.r""",
    "op5_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_NORMAL} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op11_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x FROM documents),
        g AS (SELECT r, p, md5(x[p + 1 : p + 200]) AS h FROM (SELECT r, x, unnest(range(octet_length(x) - 199)) AS p FROM d WHERE octet_length(x) >= 200)),
        m AS (SELECT r, p FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
        i AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k
              FROM (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM m)),
        s AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY r, k),
        c AS (SELECT r, coalesce(lag(b) OVER w, 0) AS low, a AS high, a - b AS gone, 1 AS n FROM s WINDOW w AS (PARTITION BY r ORDER BY a)
              UNION ALL SELECT r, max(b), NULL, 0, 0 FROM s GROUP BY r UNION ALL SELECT r, 0, NULL, 0, 0 FROM d ANTI JOIN s USING (r)),
        k AS (SELECT r, sum(n) AS n, -sum(gone) AS gone, string_agg(hex(x[low + 1 : coalesce(high, octet_length(x))]), '' ORDER BY low) AS kept FROM c JOIN d USING (r) GROUP BY r)
        SELECT doc_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(n AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d JOIN k USING (r)""",
}
