"""Operator 11 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from pairloom.llm import suffix_dedup as S


def brute(rows, repeat):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + repeat] for t in texts for i in range(len(t) - repeat + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - repeat + 1):
            if count[t[i : i + repeat]] > 1:
                gone[i : i + repeat] = [True] * repeat
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def shared_texts(rng, n, alphabet="abcdefgh é日 "):
    """Texts of random parts, of which many are shared, some periodic and some nearly shared."""
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    pool = [word(rng.randint(20, 400)) for _ in range(6)] + ["a" * 300, "ab" * 150, word(45) * 8]
    texts = []
    for _ in range(n):
        parts = [rng.choice([word(rng.randint(0, 150)), rng.choice(pool), rng.choice(pool)[rng.randint(0, 30) :]]) for _ in range(rng.randint(0, 5))]
        texts.append("".join(parts))
    return [*texts, *rng.sample(texts, n // 10)]


def test_suffix_ranks_equal_sorting():
    rng = random.Random(1)
    for _ in range(300):
        letters = [rng.randint(1, 3) for _ in range(rng.randint(1, 70))]
        order = np.argsort(S.suffix_ranks(np.array(letters, np.int64), depth=10**6)).tolist()
        assert order == sorted(range(len(letters)), key=lambda i: letters[i:])  # noqa: B023


def test_bounded_ranks_keep_equal_prefixes_together():
    rng = random.Random(2)
    for _ in range(100):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 400))) * rng.randint(1, 3)
        depth = rng.choice([4, 9, 20])
        order = np.argsort(S.suffix_ranks(np.frombuffer(text, np.uint8).astype(np.int64) + 1, depth=depth))
        prefixes = [text[i : i + depth] for i in order.tolist()]
        assert prefixes == sorted(prefixes)


def test_anchors_are_the_least_grams():
    rng = random.Random(4)
    for unit in ("".join(rng.choice("abc") for _ in range(3000)), "a" * 2500, "abcde" * 600):
        raw, found = np.frombuffer(unit.encode(), np.uint8), []
        for of, first, n, off in zip(*S.anchors(raw), strict=True):
            found += [(int(of), int(first + off) - p) for p in range(first, first + n)]
        hashes = [int(h) >> 10 for h in S.gram_hashes(raw, 64)]
        for p, (of, place) in enumerate(found):
            window = hashes[p : p + 137]
            assert of == min(window) and place == window.index(of)
        assert len(found) == len(raw) - 199


def test_pieces_of_a_long_text_give_the_same_strings(monkeypatch):
    raw = np.frombuffer("".join(random.Random(5).choice("abc") for _ in range(5000)).encode(), np.uint8)
    whole = {(int(c), int(f + o) - p, p) for c, f, n, o in zip(*S.anchors(raw), strict=True) for p in range(f, f + n)}
    monkeypatch.setattr(S, "STEP", 777)
    assert whole == {(int(c), int(f + o) - p, p) for c, f, n, o in zip(*S.anchors(raw), strict=True) for p in range(f, f + n)}


def test_rows_equal_brute_force(spark):
    rng = random.Random(6)
    for repeat, gram, most in ((200, 64, S.CLASS_BYTES), (40, 16, S.CLASS_BYTES), (40, 16, 300)):
        rows = [*enumerate(shared_texts(rng, 60)), (None, None), (7, ""), (7, "x" * 500)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted(map(tuple, S.remove_repeats(docs, repeat, gram, most).collect()), key=repr)
        assert got == brute(rows, repeat), (repeat, most)


def test_a_passage_in_every_text_is_cut_into_small_classes(spark):
    """One passage between different words in many texts: its classes are cut until each is small, and nothing is lost."""
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    passage = word(230)
    rows = [(i, word(150) + passage[rng.randint(0, 3) :] + word(150)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, S.remove_repeats(docs, most=20_000).collect()), key=repr)
    assert got == brute(rows, 200) and all(g[2] >= 226 for g in got)
    contexts = S.hashed(S.text_contexts(*contexts_of(spark, docs), 200))
    ready, links = S.cut_classes(S.distinct_contexts(contexts, S.F.lit(1)), 200, 137, 20_000)
    assert links
    for table in ready:
        for r in table.groupBy("class").agg(S.F.sum(S.F.length("context")).alias("size"), S.F.count("*").alias("n")).collect():
            assert r["size"] <= 20_000 or r["n"] == 1


def contexts_of(spark, docs):
    keyed = S.row_keyed(S.stable(docs.select("doc_id", S.F.col("text").cast("binary").alias("text"))), "rid").select("rid", "text")
    return keyed, S.written_by(S.materialize(S.text_anchors(keyed, 200, 64)).withColumn("part", S.F.shiftright("rid", 33)), "part", "all")


def test_hard_and_empty_tables(hard, none):
    got = sorted(map(tuple, S.remove_repeats(hard).collect()), key=repr)
    assert got == brute([tuple(r) for r in hard.select("doc_id", "text").collect()], 200)
    assert S.remove_repeats(none).collect() == []
