"""The pipeline's stages, each against brute force on what its predecessor kept."""

import collections
import zlib

import corpus_pipeline
import pytest

from pairloom.llm import quality, source_mix
from pairloom.llm.common import stored

from .test_documents import AZ, PATH
from .test_near_copies import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        out.append((name, docs))
    return [(n, d.columns, d.collect()) for n, d in out]


def test_order_and_columns(steps):
    assert [n for n, _, _ in steps[1:]] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "source_mix", "best_fit_packing"]
    assert all(c == steps[0][1] for _, c, _ in steps[:-1])


def test_quality(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = sorted((r.doc_id, labels[r.doc_id], r.text or "") for r in steps[0][2] if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5)
    model = quality.trained([t for _, _, t in rows], [q for _, q, _ in rows])
    assert {r.doc_id for r in steps[1][2]} == {r.doc_id for r in steps[0][2] if model.score(r.text) >= 0.3}
    held = [r for r in steps[0][2] if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((model.score(r.text) >= 0.3) == labels[r.doc_id] for r in held) >= 0.8 * len(held)


def test_exact(steps):
    last = {}
    for r in sorted(steps[1][2]):
        last[r.text.translate(AZ)] = r.doc_id
    assert sorted(r.doc_id for r in steps[2][2]) == sorted(last.values())


def test_near(steps):
    """The rule of stages on word shingles: five words, similarity 0.8."""
    rows = sorted(steps[2][2])
    roots = brute([r.text for r in rows])
    first = {}
    for r, root in zip(rows, roots, strict=True):
        first.setdefault(root, r.doc_id)
    assert sorted(r.doc_id for r in steps[3][2]) == sorted(first.values())


def test_mix(spark, steps):
    before, after = collections.Counter(r.doc_id for r in steps[3][2]), collections.Counter(r.doc_id for r in steps[4][2])
    assert set(after) <= set(before) and max(after.values()) <= 3
    plan = source_mix.mix(spark.createDataFrame(steps[3][2], "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert after == collections.Counter({r.doc_id: r.copies for r in plan if r.copies})


def test_packing(steps):
    from tokenizers import Tokenizer

    tokenizer, want, bins = Tokenizer.from_file(PATH), collections.Counter(), collections.Counter()
    for r in steps[4][2]:
        n = len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
        want.update((r.doc_id, k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048)))
    assert collections.Counter((r.doc_id, r.piece, r.length) for r in steps[5][2]) == want
    for r in steps[5][2]:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 2


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "a.b", "__size", "row", "rid"]
SCHEMA = ", ".join(f"`{c}` {'string' if c in ('text', 'lang', 'source') else 'long'}" for c in COLUMNS)


@pytest.mark.parametrize("rows", [[], [(None,) * 9], [(None, None, "en", "s", None, 1, 2, 3, 4), (3, "a b", "en", None, 3, 5, 6, 7, 8), (3, "a b", "en", None, 3, 5, 6, 7, 8), (4, "", None, "s", 0, 1, 1, 1, 1)]], ids=["empty", "nulls", "repeated"])
def test_stages_of_hard_tables(spark, rows):
    """Nulls in every column, repeated rows, empty tables, and columns that clash with those of the operators."""
    docs = spark.createDataFrame(rows, SCHEMA)
    given = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER), name)
        assert docs.columns == COLUMNS and {tuple(r) for r in docs.collect()} <= given
    assert docs.count() == 0 if not rows else True
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.count() == docs.count() and packed.columns[:2] == ["doc_id", "piece"]


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == steps[-1][1]
    assert collections.Counter((r.doc_id, r.piece, r.length) for r in got.collect()) == collections.Counter((r.doc_id, r.piece, r.length) for r in steps[-1][2])
