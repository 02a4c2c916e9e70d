"""Operator 12 against the libraries and brute force."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
import public_tokenizers

from pairloom.llm import alignment
from pairloom.llm.queries import op12_token_alignment
from pairloom.llm.tokens import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a", " ", "  two  spaces ", "tab\tand \nnew\r\nlines\n\n x", "foo\n bar\t \nbaz", "É é ß 😀 日本語 \u0000 \x1c y", "x" * 3000, "▁ mark ▁▁ a▁b", "<|endoftext|> <s> </s> <unk> <0x41>",
    "don't it's WE'LL 123 4567, 12.5%!! ...", " nb sp 　wide  line", "é Å ﬁ ①", "日本語" * 400, " lead", "trail ", "﻿bom", "ǅ ᾳ ͅ", "\u0085 next", "a\x0bb \x0cc",
]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def brute_tokens(libraries, text):
    a, b = libraries
    if not text:
        return [], []
    byte_of = {s: n for n, s in byte_symbols().items()}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    found_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in ids_a]
    found_b = []
    for i in ids_b:
        piece = b.id_to_piece(i)
        h = re.fullmatch("<0x(..)>", piece)
        found_b.append((i, bytes([int(h[1], 16)]) if h else piece.replace("▁", " ").encode()))
    wanted = (" " + text).encode()
    return (found_a, found_b) if b"".join(t for _, t in found_a) == wanted == b"".join(t for _, t in found_b) else ([], [])


def spans(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(libraries, rows):
    both = [tuple(map(spans, brute_tokens(libraries, t))) for _, t in rows]
    links = []
    for a, b in both:
        j, mine = 0, []
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][1] < e:
                if b[j][2] > s:
                    mine.append((i, b[j][0]))
                j += 1
        links.append(mine)
    count = Counter(p for mine in links for p in mine)
    most = {}
    for (_, j), n in count.items():
        most[j] = max(n, most.get(j, 0))
    out = []
    for (doc_id, _), (a, b), mine in zip(rows, both, links, strict=True):
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for high in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low < e <= high) for side in (a, b)))
            low = high
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(ends), len(mine), sum(count[p] == most[p[1]] for p in mine), sum(count[p] for p in mine), sha))
    return out


def texts_of(rng, n):
    words = "the of Über naïve 12 3.5 don't x-y (a) foo, bar. zażółć 東京 <s> 😀 é internationalization \t \n".split(" ") + ["", "\n\n", "▁"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_words_and_whole_texts_equal_the_libraries(libraries):
    two = alignment.TwoTokenizers(A, B)
    texts = ODD + texts_of(random.Random(1), 200)
    for _ in range(2):  # the second time from the table
        for text, (a, b) in zip(texts, two.encode(pa.array(texts)), strict=True):
            wanted = brute_tokens(libraries, text)
            assert [i for i, _ in wanted[0]] == a.tolist() and [i for i, _ in wanted[1]] == b.tolist(), text


def test_documents_encode_as_the_libraries_do(libraries):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].combine_chunks()
    for text, (a, b) in zip(texts.to_pylist(), alignment.TwoTokenizers(A, B).encode(texts), strict=True):
        wanted = brute_tokens(libraries, text)
        assert [i for i, _ in wanted[0]] == a.tolist() and [i for i, _ in wanted[1]] == b.tolist()


def test_rows_equal_brute_force(spark, libraries, monkeypatch):
    rows = [(i, t) for i, t in enumerate([None, "", *ODD, *texts_of(random.Random(2), 60)])] + [(3, ODD[3]), (None, "the end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", docs_key()).repartition(3)
    got = sorted(map(tuple, alignment.align(docs, A, B).collect()), key=repr)
    assert got == sorted(brute(libraries, rows), key=repr)


def docs_key():
    from pyspark.sql import functions as F

    return F.lit(7)


def test_sweep_in_small_steps(libraries, monkeypatch):
    """The state machine gives the same rows however little it is given at a time."""
    import numpy as np

    monkeypatch.setattr(alignment, "SWEEP_TOKENS", 5)
    rows = [(i, t) for i, t in enumerate([*ODD[:8], "", *texts_of(random.Random(3), 20)])]
    machine, two, got = alignment.Sweep(*(lambda t: (t.size_a, t.size_b))(alignment.TwoTokenizers(A, B))), alignment.TwoTokenizers(A, B), []
    for (doc_id, _), sides in zip(rows, two.encode(pa.array([t for _, t in rows])), strict=True):
        slices = sorted((int(size[ids[:k]].sum()), side, ids[k : k + 3]) for side, (ids, size) in enumerate(zip(sides, (two.size_a, two.size_b), strict=True)) for k in range(0, max(1, len(ids)), 3))
        for _, side, ids in slices:
            machine.give(doc_id, doc_id, side, ids)
            if machine.waiting >= machine.enough:
                got += machine.step(False)
    got += machine.step(True)
    wanted = brute(libraries, rows)
    assert [(g[1], g[2], g[3], g[4], len(g[6]), g[5]) for g in got] == [(*w[:5], w[7]) for w in wanted]
    assert np.concatenate([g[6] for g in got]).dtype == np.uint32


def test_hard_and_empty_tables(spark, hard, none, libraries):
    rows = [tuple(r) for r in hard.select("doc_id", "text").collect()]
    got = sorted(map(tuple, alignment.align(hard, A, B).collect()), key=repr)
    small = [r for r in rows if len(r[1] or "") < 5000]
    wanted = {(w[0], w[1], w[2], w[3], w[4], w[7]) for w in brute(libraries, small)}
    assert len(got) == len(rows) and wanted <= {(g[0], g[1], g[2], g[3], g[4], g[7]) for g in got}
    assert alignment.align(none, A, B).collect() == []


def test_query_on_documents(spark, libraries):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, op12_token_alignment(spark, "/root/testdata/sf0.001").collect()))
    assert [g[:5] + g[7:] for g in got] == [w[:5] + w[7:] for w in sorted(brute_shapes(libraries, docs))]
    assert sum(g[5] for g in got) > 0 and all(g[6] >= g[4] for g in got)


def brute_shapes(libraries, docs):
    """`brute` is quadratic in the groups of a text: here by sets of ends only."""
    for doc_id, text in docs:
        a, b = map(spans, brute_tokens(libraries, text))
        ends = {e for _, _, e in a} & {e for _, _, e in b}
        groups, sides = [], ([], [])
        events = sorted([(e, 1, i) for i, _, e in b] + [(e, 0, i) for i, _, e in a])
        for n, (e, side, i) in enumerate(events):
            sides[side].append(str(i))
            if e in ends and (n + 1 == len(events) or events[n + 1][0] > e):
                groups.append("|".join(map(",".join, sides)))
                sides = ([], [])
        yield doc_id, len(a), len(b), len(ends), len(a) + len(b) - len(ends), 0, 0, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
