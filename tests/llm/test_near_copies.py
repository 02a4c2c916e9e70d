"""The pipeline's near copies against brute force over all pairs."""

import itertools
import random

import corpus_pipeline
import numpy as np
import pytest

from pairloom.llm import near_copies
from pairloom.llm.common import LOWER_BYTES

from .conftest import hard_texts, prose


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().translate(LOWER_BYTES).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def edited(text, n, seed):
    """n words replaced."""
    rng, words = random.Random(seed), text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{seed}"
    return " ".join(words)


def generated():
    """Pairs about the least similarity, a family whose members mostly do not link, and texts that share a long line."""
    out = [t for k in range(12) for t in (prose(100 + k, 200), edited(prose(100 + k, 200), 2 + k % 6, k))]
    out += [edited(prose(7, 150), 1 + k % 6, 50 + k) for k in range(90)]
    return out + [prose(8, 60) + " " + prose(300 + k, 15 + k) for k in range(40)]


@pytest.mark.parametrize("texts", [[t for _, t, _ in hard_texts()], generated()], ids=["hard", "generated"])
def test_near_copies_of_the_stage(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    first = {}
    for i, r in enumerate(brute(texts)):
        first.setdefault(r, i)
    kept = corpus_pipeline.no_near_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


@pytest.mark.parametrize("width", [24, 32])
def test_share_of_pairs_that_meet(width):
    """Of pairs of similarity 4/5 no more than about MISSED are missed, at any width."""
    rng, segments = np.random.default_rng(5), near_copies.plan(1 << (width - 5))[1]
    assert near_copies.plan(1 << (width - 5))[0] == width
    longs, missed, most = -(-width * segments // 64), 0, 0
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = np.unique(both[:180]), np.unique(both[20:])  # 160 of 200
        assert near_copies.similar(a, b)
        balance = np.stack([near_copies.counts(x, longs) for x in (a, b)])
        most = max(most, ((balance[0] > 0) != (balance[1] > 0)).mean() * 512)
        balls = []
        for probes in near_copies.probed(balance, width, segments).tolist():
            keys = set()
            for s, p in enumerate(probes):
                places = [p >> width + 6 * i & 63 for i in range(near_copies.UNCERTAIN)]
                for flips in itertools.chain.from_iterable(itertools.combinations(places, k) for k in range(near_copies.FLIPS + 1)):
                    keys.add((s, (p & (1 << width) - 1) ^ sum(1 << b for b in flips)))
            balls.append(keys)
        missed += balls[0].isdisjoint(balls[1])
    assert missed <= 5 and most <= near_copies.NEAR_512


@pytest.mark.parametrize("n", [1, 5, 60, 700, 3000])
def test_sketches_exclude_no_similar_pair(n):
    rng, kept = np.random.default_rng(8), {4: 0, 5: 0}
    for _ in range(60):
        for share in kept:  # of similarity 4/5 (or the next above), and of about 2/3
            both = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = len(both) // 10 if share == 4 else len(both) // 6
            a, b = both[gone:], both[: len(both) - gone]
            found = near_copies.may_be_similar(*(np.array([v]) for v in (len(a), near_copies.sketches(a), len(b), near_copies.sketches(b))))
            assert found[0] or not near_copies.similar(a, b)
            kept[share] += int(found[0])
    assert kept[4] == 60 and (n < 60 or kept[5] <= 12)


def test_counts_of_bits():
    found = np.random.default_rng(6).integers(0, 1 << 63, 9000, dtype=np.uint64)
    whole = near_copies.counts(found, 9)
    assert len(whole) == 576 and (whole == near_copies.counts(found[:5000], 9) + near_copies.counts(found[5000:], 9)).all() and abs(whole).max() < 600


@pytest.mark.parametrize(("small", "piece"), [(2, 8), (32, 4096)])
def test_crowds_in_pieces(spark, monkeypatch, small, piece):
    """Families whose keys are crowded: pieces and the second pass link what pairs under one key would."""
    monkeypatch.setattr(near_copies, "SMALL", small)
    monkeypatch.setattr(near_copies, "PIECE", piece)
    texts = [edited(prose(7 + k % 2, 150), 1 + k % 6, 50 + k) for k in range(90)] + [prose(7, 150)] * 20 + ["", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {}
    for i, r in enumerate(brute(texts)):
        first.setdefault(r, i)
    got = near_copies.near_groups(docs).collect()
    assert sorted(r.doc_id for r in got if r.first) == sorted(first.values())
    assert all(r.component_id == first[b] for r, b in zip(sorted(got, key=lambda r: r.doc_id), brute(texts), strict=True))
