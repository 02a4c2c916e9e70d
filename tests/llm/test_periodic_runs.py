"""Operator 13 against brute force."""

import hashlib
import random
from fractions import Fraction
from zlib import crc32

from pairloom.llm import periodic_runs as P
from pairloom.llm.queries import op13_periodic_runs


def brute_runs(words):
    n, found = len(words), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            a, b = i, j + q
            if b - a >= max(24, 3 * q) and all(any(words[k] != words[k + p] for k in range(a, b - p)) for p in range(1, q)):
                found.add((a, b - a, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def pieces(rng):
    words = []
    for _ in range(rng.randint(0, 5)):
        unit = [rng.choice("ab") for _ in range(rng.randint(1, 12))]
        words += rng.choice([[rng.choice("abc") for _ in range(rng.randint(0, 20))], unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))], ["z"] * rng.randint(1, 40)])
    return words


def test_runs_equal_brute_force():
    rng, found = random.Random(7), 0
    for _ in range(600):
        texts = [pieces(rng) for _ in range(rng.randint(1, 4))]
        runs = [brute_runs(t) for t in texts]
        assert P.batch_runs(texts) == runs
        found += sum(map(len, runs))
    assert found > 500


def test_automaton_alone_equals_brute_force_on_nested_runs():
    a, b = ["a"], ["a", "b"]
    while len(b) < 500:
        a, b = b, b + a
    assert P.automaton_runs(b) == brute_runs(b) and len(brute_runs(b)) > 30


def test_long_periodic_texts_take_linear_time():
    rng = random.Random(1)
    unit = [str(rng.random()) for _ in range(40_000)]
    assert P.batch_runs([(unit * 5)[:190_000], ["a", "b"] * 60_000]) == [[(0, 190_000, 40_000)], [(0, 120_000, 2)]]


def test_equal_hashes_of_different_words_do_no_harm():
    class Same(str):
        __hash__ = lambda self: 7
        __eq__ = str.__eq__

    words = [Same(w) for w in ["a", "b", "c"] * 10 + ["d"] * 30 + ["e", "f"]]
    assert P.batch_runs([words]) == [brute_runs(words)] != [[]]


def test_rows_equal_brute_force(spark, hard):
    found = P.periodic_runs(hard)
    short = [r for r in map(tuple, hard.select("doc_id", "text").collect()) if len(r[1] or "") < 20_000]
    edited = [i for i in range(3000) if crc32(str(i).encode()) % 10 == 0][:40]
    rng = random.Random(3)
    more = [(i, " \t".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 150)))) for i in edited] + [(None, "x " * 90), (3, "x y " * 30)]
    for df, rows in ((found.where("n_runs >= 0"), short), (P.periodic_runs(spark.createDataFrame(more, "doc_id long, text string")), more)):
        got = sorted(map(tuple, df.collect()), key=repr)
        wanted = [brute_row(*r) for r in rows]
        assert all(w in got for w in wanted) and (rows is not more or len(got) == len(wanted))
    assert found.count() == hard.count()


def test_empty_table(none):
    assert P.periodic_runs(none).collect() == []


def test_query_on_documents(spark):
    rows = {r.doc_id: tuple(r) for r in op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        if len(d.text or "") < 6000:
            assert rows[d.doc_id] == brute_row(d.doc_id, d.text)
