"""Operators on documents against brute force, on small tables full of hard cases and on generated ones."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm import exact_dedup, license_scan, near_copies, order_minhash, packing, quality, simhash, source_mix, token_files, tokens

from .conftest import hard_texts, prose

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [(i, t or "", s) for i, t, s in hard_texts()]


def few(spark, rows, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema)


# --- exact copies


@pytest.mark.parametrize("hash_of", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))], ids=["hash", "clashing hash"])
def test_exact_groups(spark, hard, hash_of):
    got = exact_dedup.exact_groups(hard, hash_of).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in TEXTS:
        groups[t.translate(AZ)].append(i)
    want = sorted((str(i), str(max((x for x in groups[t.translate(AZ)] if x is not None), default=None)), len(groups[t.translate(AZ)]), hashlib.sha256(t.translate(AZ).encode()).hexdigest()) for i, t, _ in TEXTS)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_copies_go(spark, hard, none):
    kept = exact_dedup.drop_exact_copies(hard)
    assert kept.columns == hard.columns and kept.count() == len({t.translate(AZ) for _, t, _ in TEXTS})
    assert exact_dedup.drop_exact_copies(none).count() == 0


def test_chunks_join_to_the_text(spark, hard):
    whole = hard.select(F.coalesce("text", F.lit("")).alias("t")).select("t", exact_dedup.chunks(F.col("t")).alias("c"))
    assert whole.where(F.array_join("c", "") != F.col("t")).count() == 0
    assert whole.select(F.max(F.array_max(F.transform("c", F.char_length)))).first()[0] <= exact_dedup.MAX_CHUNK


# --- SimHash


def brute_fingerprint(text: str, words: int = 3) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(AZ))
    sh = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_shingles_of_long_texts_in_parts(monkeypatch):
    texts = [prose(1, 400), "", "  ", "one", "one two", "a b c", "É é " * 90, "x" * 500 + " y z", " lead " + prose(2, 9) + "\n"]
    want = {(t, k): [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for w in [re.findall(r"[^\x20\x09-\x0D]+", t.translate(AZ))] for i in range(max(1, len(w) - k + 1)) if w] for t in texts for k in (1, 3, 5)}
    for part in (1 << 20, 7):
        monkeypatch.setattr(simhash, "PART", part)
        assert {(t, k): simhash.shingle_hashes(t.encode(), k).tolist() for t in texts for k in (1, 3, 5)} == want


def brute_components(fps: list[int], radius: int = 3) -> list[int]:
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_groups(spark, hard):
    got = simhash.near_groups(hard).collect()
    fps = [brute_fingerprint(t) for _, t, _ in TEXTS]
    roots = brute_components(fps)
    least = collections.defaultdict(list)
    for (i, _, _), r in zip(TEXTS, roots, strict=True):
        least[r].append(i)
    want = sorted((str(i), f, str(min((x for x in least[r]), key=lambda x: (x is not None, x or 0)))) for (i, _, _), f, r in zip(TEXTS, fps, roots, strict=True))
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in got) == want
    assert sum(r.first for r in got) == len(set(roots))


@pytest.mark.parametrize("crowd", [4096, 5])
def test_dense_and_chained_fingerprints(spark, crowd):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    near = [int(centre) ^ sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 6), replace=False)) for _ in range(400)]
    chain = [int(rng.integers(0, 1 << 63))]
    for k in range(60):
        chain.append(chain[-1] ^ (1 << k % 64) ^ (1 << (k * 7 + 3) % 64) ^ (1 << (k * 5 + 1) % 64))
    fps = sorted({*near, *chain, *(int(x) for x in rng.integers(0, 1 << 63, 300)), 0, 7})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    edges = simhash.links(df, crowd=crowd)
    assert edges.count() < (8 if crowd > 5 else 32) * len(fps)
    label = {r.node & (1 << 64) - 1: r.label for r in simhash.classes(edges).collect()}
    roots = brute_components(fps)
    pairs = {(r, label.get(f, ("alone", f))) for f, r in zip(fps, roots, strict=True)}
    assert len(pairs) == len(set(roots)) == len({b for _, b in pairs})


def test_near_copies_go(spark, hard, none):
    kept = simhash.drop_near_copies(hard)
    assert kept.columns == hard.columns and kept.count() == len(set(brute_components([brute_fingerprint(t) for _, t, _ in TEXTS])))
    assert simhash.drop_near_copies(none).count() == 0


# --- token files of equal batches


def test_files_of_equal_batches_keep_apart(spark, tmp_path):
    docs = few(spark, [(i, "alpha beta gamma", "a") for i in range(20)]).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        folder = f"file://{tmp_path}/t"
        manifest = token_files.write_token_files(docs, folder, PATH, file_ids=1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({(r.file, r.number) for r in manifest.collect()}) == 20
    blocks = token_files.scan_blocks(spark, folder, manifest.select("file").distinct())
    assert manifest.join(token_files.document_lengths(blocks), ["file", "number"]).count() == 20


# --- license scan


def test_license_base(spark, hard, none):
    many = few(spark, [(100, " ".join(["mit license"] * 3000), None), (101, "General Public LICENSE general public license", None), (102, "mit　license MIT-License apachelicense apache license", None)])
    rows = hard.select("doc_id", "text").union(many.select("doc_id", "text"))
    got = {r.doc_id: r for r in license_scan.scan(rows).collect()}
    for r in rows.collect():
        w = re.findall(license_scan.WORD, (r.text or "").translate(AZ))
        at = [(i, label) for label, p in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert 0 <= g.score <= 1 and set(g.base_labels.split(",")) - {""} <= set(g.labels.split(","))
    assert license_scan.scan(none).count() == 0


def test_license_notices_with_edits(spark):
    label, text = license_scan.NOTICES[4]
    w = text.split()
    rows = [(1, " ".join(["intro", *w, "outro"])), (2, " ".join([*w[:8], "and", "also", *w[8:]]).upper()), (3, " ".join(w[:9])), (4, " ".join(reversed(w)))]
    got = {r.doc_id: r.labels for r in license_scan.scan(few(spark, rows, "doc_id long, text string")).collect()}
    assert got == {1: label, 2: label, 3: "", 4: ""}


def test_every_notice_is_found_whole_and_in_part(spark):
    """Each notice earns its label, also if some of its words are changed and it stands within other text."""
    rows = []
    for k, (_, text) in enumerate(license_scan.NOTICES):
        w = text.split()
        changed = list(w)
        for i in range(10, len(w), 20):
            changed[i] = "other"
        rows += [(2 * k, f"{prose(k, 20)} {text.title()} {prose(k, 9)}"), (2 * k + 1, " ".join(changed))]
    got = {r.doc_id: r.labels.split(",") for r in license_scan.scan(few(spark, rows, "doc_id long, text string")).collect()}
    for k, (label, text) in enumerate(license_scan.NOTICES):
        assert label in got[2 * k] and (label in got[2 * k + 1] or len(text.split()) < 18), label


# --- tokens, files and packing


@functools.cache
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", ["", "Hello, it's DON'T! 123 <|endoftext|> x", "ΑΣ Σ x", "日本語 テキスト don’t", "áé á É ÀÇ ²½", "x" * 200 + " " + "ab1" * 40, "\x00 \x1c\x1d a\u0085b　 c​d", "İstanbul ß ẞ ŉ ǆ", "́abc", "😀😀 👍🏽!!", " lead\n"])
def test_ids_are_the_librarys(text):
    ids, n = tokens.word_bpe(PATH).encode(pa.array([text, None, text]))
    want = library().encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want + want and n.tolist() == [len(want), 0, len(want)]


MARKED = st.lists(st.sampled_from(["Word", "été", "Σας", "ß", "don't", "A1", "e\u0301", "a\u00a0b", "İ", "K", "...", "\"", "!?", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", ")", "`", "\u0301", "$$$", " ", "\n", "\u3000"]), max_size=12).map("".join)


@given(st.lists(MARKED, min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_ids_of_marks_and_case_are_the_librarys(texts):
    """One table for all examples, so that parts and chunks of earlier ones are looked up again."""
    ids, n = tokens.word_bpe(PATH).encode(pa.array(texts))
    want = [library().encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_ids_of_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 64)
    monkeypatch.setattr(tokens, "TABLE_BYTES", 2000)
    text = " ".join([prose(9, 300), "日本語 <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "z" * 300, prose(10, 50)])
    slices = list(tokens.text_slices(pa.array([text, None, "a b", text])))
    got = [tokens.WordBpe(PATH).encode(x) for _, x in slices]
    want = [library().encode(t, add_special_tokens=False).ids for t in (text, "", "a b", text)]
    assert sum((g.tolist() for g, _ in got), []) == sum(want, []) and [int(k) for _, n in got for k in n] == list(map(len, want))


def test_ids_of_generated_words():
    rng = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyzABCéèñß0123456789'.,!#-")
    text = " ".join("".join(rng.choice(letters, rng.integers(1, 30))) for _ in range(3000))
    assert tokens.word_bpe(PATH).encode(pa.array([text]))[0].tolist() == library().encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, hard, none):
    got = collections.Counter((r.doc_id, r.n_tokens) for r in token_files.token_counts(hard, PATH, block_ids=64).collect())
    assert got == collections.Counter((i, len(library().encode(t, add_special_tokens=False).ids)) for i, t, _ in TEXTS)
    assert token_files.token_counts(none, PATH).count() == 0


def test_ids_that_do_not_fit_are_refused():
    for bad in (65536, 65535):
        with pytest.raises(ValueError):
            token_files.fitting(np.array([1, bad], np.uint32), token_files.SEPARATOR)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_separator_scan(spark, tmp_path, block):
    files = {"a": [9, 1, 2, 9, 9, 3, 3, 3, 3, 3, 3, 3, 9], "b": [1, 1, 1, 9, 2, 2], "c": [4] * 20, "d": [9] * 5, "e": []}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    blocks = token_files.scan_blocks(spark, f"file://{tmp_path}", spark.createDataFrame([(n,) for n in files], "file string"), separator=9, block_ids=block)
    got = collections.defaultdict(list)
    for r in token_files.document_lengths(blocks).orderBy("file", "number").collect():
        got[r.file].append((r.n_tokens, r.closed))
    assert got == {"a": [(0, True), (2, True), (0, True), (7, True)], "b": [(3, True), (2, False)], "c": [(20, False)], "d": [(0, True)] * 5}


def test_packing_is_whole(spark, hard, none):
    rows = packing.pack_documents(hard, PATH).collect()
    want = collections.Counter()
    for i, t, _ in TEXTS:
        ids = np.array([*Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.update((i, k, a, min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048
    assert packing.pack_documents(none, PATH).count() == 0
    sequences = packing.packed_ids(hard.where("doc_id is not null"), PATH).collect()
    assert all(len(r.ids) <= 2048 for r in sequences)
    got = collections.Counter(x for r in sequences for x in r.ids)
    assert got == collections.Counter(x for i, t, _ in TEXTS if i is not None for x in [*library().encode(t, add_special_tokens=False).ids, 0])
    assert sum(1 for r in sequences for x in r.ids if x == 0) == sum(i is not None for i, _, _ in TEXTS)


def test_evolution_is_as_good_as_best_fit_decreasing():
    rng = np.random.default_rng(4)
    for _ in range(5):
        length = [int(x) for x in rng.integers(1, 100, 300)]
        code = packing.evolved(length, [], 100, 1, generations=20)[0]
        owner = np.frombuffer(code, np.int32)
        assert len(owner) == 300 and np.bincount(owner, length).max() <= 100
        bins: list = []
        packing.best_fit(sorted(range(300), key=length.__getitem__, reverse=True), length, bins, [], 100)
        assert owner.max() + 1 <= len(bins)
        a, b = (packing.Packing.decoded(c, length, 100) for c in packing.evolved(length, [], 100, 2)[:2])
        child = packing.crossed(a, b, length, 100, __import__("random").Random(1))
        assert sorted(i for x in child.bins for i in x) == list(range(300)) and all(r >= 0 for r in child.room)


def triplets(rng, n: int) -> list[int]:
    """Lengths that fill n bins of 1000 by threes."""
    first = rng.integers(380, 490, n)
    second = (1000 - first) // 2 + rng.integers(-60, 60, n)
    return [int(x) for x in np.concatenate([first, second, 1000 - first - second])]


def test_evolution_beats_best_fit_decreasing():
    rng, won = np.random.default_rng(12), 0
    for k in range(6):
        length, bins = triplets(rng, 40), []
        packing.best_fit(sorted(range(120), key=length.__getitem__, reverse=True), length, bins, [], 1000)
        owner = np.frombuffer(packing.evolved(length, [], 1000, k, generations=200, population=12)[0], np.int32)
        assert 40 == packing.least_bins(length, 1000) <= owner.max() + 1 <= len(bins) and np.bincount(owner, length).max() <= 1000
        won += owner.max() + 1 < len(bins)
    assert won >= 5


def test_small_instances_are_packed_best():
    """Against the best of all packings, by search."""
    rng = np.random.default_rng(2)

    def best(left: list[int], bins: list[int], most: int) -> int:
        if len(bins) >= most:
            return most
        if not left:
            return len(bins)
        for r in {b for b in bins if b >= left[0]}:
            i = bins.index(r)
            most = min(most, best(left[1:], [*bins[:i], r - left[0], *bins[i + 1 :]], most))
        return min(most, best(left[1:], [*bins, 20 - left[0]], most))

    for k in range(20):
        length = [int(x) for x in rng.integers(2, 13, 9)]
        found = np.frombuffer(packing.evolved(length, [], 20, k, generations=60, population=8)[0], np.int32).max() + 1
        assert found == best(sorted(length, reverse=True), [], 10)


def test_blocks_win_back_what_the_split_costs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 60, 600))]
    pieces = spark.createDataFrame(rows, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")
    got = packing.packed(pieces, 100, block=64).collect()
    filled = collections.Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert sorted(r.row for r in got) == list(range(600)) and max(filled.values()) <= 100
    assert len(filled) == -(-sum(r[4] for r in rows) // 100)


# --- Order MinHash


def brute_signature(text: str, k: int = 3, l: int = 2, m: int = 64, rings: int = 4) -> list[int]:  # noqa: E741
    """Order MinHash in plain Python: XXH64 in a chain of seeds, k-mers numbered by occurrence, the l first of each order."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def chain(*parts) -> int:
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p, h)
        return signed(h)

    long = lambda v: v.to_bytes(8, "little", signed=True)
    small = lambda v: v.to_bytes(4, "little")
    words = re.findall(order_minhash.TOKEN, text)
    grams = [words[i : i + k] for i in range(len(words) - k + 1)] if len(words) >= k else [[" ".join(words)]] if words else []
    seen: collections.Counter = collections.Counter()
    placed = []
    for at, g in enumerate(grams):
        h = chain(*g) >> 30
        placed.append((chain(long(h), small(seen[h])) >> 30, at))
        seen[h] += 1
    out = []
    for ring in range(rings):
        order = sorted((chain(long(h), small(ring)) >> 30 if ring else h, at) for h, at in placed)
        for j in range(m // rings):
            start = -(1 << 63) + j * ((1 << 64) // (m // rings))
            first = sum((h << 30 | at) < start for h, at in order)
            chosen = sorted((at, h) for h, at in (order[(first + i) % len(order)] for i in range(min(l, len(order)))))
            out.append(chain(*(long(h & (1 << 34) - 1) for _, h in chosen)) & 0xFFFFFFFF)
    return out


def test_signatures(spark, hard):
    rows = hard.where("doc_id <> 8 or doc_id is null").select("text", order_minhash.signature(F.col("text")).alias("sig")).collect()
    for r in rows:
        assert [v & 0xFFFFFFFF for v in r.sig] == brute_signature(r.text or ""), r.text
    more = ["a b c a b c a b c", "one two", "He He He He He He", "日本語 テキスト x 日本語", "w" * 500 + " a b c"]
    for r in few(spark, [(i, t, None) for i, t in enumerate(more)]).select("text", order_minhash.signature(F.col("text"), k=2, l=3, m=16, rings=2).alias("sig")).collect():
        assert [v & 0xFFFFFFFF for v in r.sig] == brute_signature(r.text, 2, 3, 16, 2)


@pytest.mark.parametrize(("n", "most"), [(20, 1.35), (60, 1.15), (200, 1.15)])
def test_spread_of_likeness(n, most):
    """The likeness of pairs that share three quarters spreads about as that of 64 independent orders does."""
    like = []
    for seed in range(120):
        words = [f"w{seed}_{i}" for i in range(n)]
        a, b = brute_signature(" ".join(words), k=1), brute_signature(" ".join([*words[: 3 * n // 4], *(f"v{i}" for i in range(n // 4))]), k=1)
        like.append(np.mean([x == y for x, y in zip(a, b, strict=True)]))
    mean = np.mean(like)
    independent = math.sqrt(mean * (1 - mean) / 64)
    assert 0.2 < mean < 0.5 and np.std(like) <= most * 1.15 * independent


def test_order_counts(spark):
    a = prose(11, 400).split()
    moved = a[200:] + a[:200]
    shuffled = list(a)
    __import__("random").Random(1).shuffle(shuffled)
    rows = [(1, " ".join(a)), (2, " ".join([*a[:395], "new", *a[395:]])), (3, " ".join(moved)), (4, " ".join(shuffled))]
    sig = {r.doc_id: r.s for r in few(spark, rows, "doc_id long, text string").select("doc_id", order_minhash.signature(F.col("text"), m=256).alias("s")).collect()}
    like = lambda x, y: np.mean([p == q for p, q in zip(sig[x], sig[y], strict=True)])
    assert like(1, 2) > 0.85 > like(1, 3) > like(1, 4) and like(1, 3) > 0.2


def test_edited_texts(spark, hard, none):
    everything = order_minhash.edited_likeness(hard).collect()
    order = sorted(((i is not None, i or 0, xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63), t) for i, t, _ in TEXTS)
    want = collections.Counter()
    for ((has, i, _), t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        want[i if has else None, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in everything) == want
    rows = hard.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in order_minhash.edited_likeness(rows).collect()}
    texts = dict(sorted({i: t for i, t, _ in TEXTS if i is not None}.items()))
    ids = list(texts)
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1 and (got[i].near_edited == 1 or edited != t)
    assert got[4].fingerprint == got[6].fingerprint
    assert order_minhash.edited_likeness(none).count() == 0
    assert order_minhash.edited_likeness(rows.where("doc_id = 4")).first().near_next == 1.0


# --- source mix


def test_mix_meets_targets(spark, hard, none):
    rng = np.random.default_rng(8)
    rows = [(i, prose(i, int(rng.integers(0, 60))), "s%d" % (i % 7 if i % 3 else 0)) for i in range(3000)] + [(5000, None, None), (5001, prose(1, 500), None), (5002, "", "empty"), (5003, None, "empty")]
    got = source_mix.mix(few(spark, rows)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    sizes = {s: sum(r.size for r in x) for s, x in by.items()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, total, open_ = {s: 1 + k % 3 for k, s in enumerate(order)}, sum(sizes.values()), set(order)
    want = {}
    left = total
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        open_ -= over
    for s, x in by.items():
        assert x[0].target == pytest.approx(want[s]) and x[0].source_size == sizes[s]
        if s is not None:
            assert abs(sum(r.taken for r in x) - want[s]) <= max(60, 0.02 * want[s])
    # Within a source the rates are exponential in size, up to the cap, and meet the target before rounding.
    for s, x in by.items():
        if sizes[s] and want[s] < 3 * sizes[s]:
            assert sum(r.rate * r.size for r in x) == pytest.approx(want[s], rel=1e-6)
            lam = {round(math.log(r.rate) / r.size, 9) for r in x if r.size and r.rate < 3}
            assert max(lam) - min(lam) < 1e-6
    again = source_mix.mix(few(spark, rows)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    mixed = source_mix.mixed_documents(hard)
    assert mixed.columns == hard.columns and source_mix.mix(hard).count() == len(TEXTS)
    assert source_mix.mix(none).count() == 0 and source_mix.mixed_documents(none).count() == 0
    # No single document that is able is as short as what its source lacks or has too much.
    for x in by.values():
        rest = round(x[0].target - sum(r.taken for r in x))
        assert not [r for r in x if 0 < r.size <= abs(rest) and (r.copies < 3 if rest > 0 else r.copies > 0)]


def brute_moves(rows, cap):
    """(row, source, size, copies, target, hash): the copies after moving documents from the longest down, round by round."""
    copies = {r[0]: r[3] for r in rows}
    for _ in range(cap + 1):
        moved = False
        for source in {r[1] for r in rows}:
            mine = [r for r in rows if r[1] == source]
            rest = round(mine[0][4] - sum(r[2] * copies[r[0]] for r in mine))
            step, left = (1 if rest > 0 else -1), abs(rest)
            able = [r for r in mine if 0 < r[2] <= left and (copies[r[0]] < cap if rest > 0 else copies[r[0]] > 0)]
            for r in sorted(able, key=lambda r: (-r[2], r[5] % (1 << 64), r[0])):
                if r[2] <= left:
                    copies[r[0]], left, moved = copies[r[0]] + step, left - r[2], True
        if not moved:
            break
    return copies


def test_moves_equal_brute_force(spark):
    rng = random.Random(11)
    for sizes in ([1], [1, 2, 3, 5, 8, 200, 3000], [7, 7, 7, 1000]):
        rows = [(i, rng.choice("ab"), rng.choice(sizes), rng.randint(0, 3), None, rng.randint(-(1 << 63), (1 << 63) - 1)) for i in range(300)]
        total = {s: sum(r[2] * r[3] for r in rows if r[1] == s) for s in "ab"}
        target = {"a": total["a"] * 1.4, "b": total["b"] * 0.6 + 0.3}
        rows = [(*r[:4], target[r[1]], r[5]) for r in rows]
        df = spark.createDataFrame(rows, "row long, source string, size long, copies int, target double, shuffled long").withColumn("has_source", F.lit(True))
        assert {r.row: r.copies for r in source_mix.moved(df, 3, len(rows)).collect()} == brute_moves(rows, 3)


def test_few_long_and_many_tiny_texts_settle_in_few_rounds(spark, monkeypatch):
    jobs = []
    monkeypatch.setattr(source_mix, "moved", lambda *a, f=source_mix.moved: jobs.append(0) or f(*a))
    monkeypatch.setattr(source_mix, "fitted", lambda *a, f=source_mix.fitted: jobs.append(1) or f(*a))
    got = source_mix.mix(few(spark, [(i, "w " * (2000 if i < 50 else 1), "a" if i % 2 else "b") for i in range(3000)])).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
    assert all(abs(r.t - r.n) <= 0.5 for r in got)
    assert len(jobs[jobs.index(0) :]) <= 1 + 5 * 3  # three tables of counts a round


def test_targets_far_from_the_sizes_are_met(spark):
    """Tiny texts beside one of a million words: their rates need a tilt of many thousands."""
    rows = [(0, "w " * 1_000_000, "b"), *((i, "w " * (1 + i % 3), "b") for i in range(1, 400)), *((i, "w " * 50, "a") for i in range(400, 440))]
    sizes = few(spark, rows).select(F.lit(True).alias("has_source"), "source", source_mix.word_count(F.col("text")).alias("size")).groupBy("has_source", "source", "size").agg(F.count("*").alias("n"))
    targets = sizes.groupBy("has_source", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    for target in (1e-3, 300.0, 2_000_000.0):
        state = source_mix.tilts(sizes, targets.withColumn("target", F.least(F.lit(target), F.col("source_size") * 2.5))).collect()
        hist = sizes.collect()
        for s in state:
            x = sum(h.n * h.size * min(3.0, math.exp(min(50.0, s.lam * h.size / s.mean))) for h in hist if h.source == s.source)
            assert abs(x - s.target) <= 1e-6 * s.target + 1e-9, (s, x)


def test_mix_of_rows_without_number_and_of_repeated_rows(spark):
    rows = [(None, "a b c d", "s")] * 500 + [(7, "a b c", "s")] * 300 + [(8, "x " * 40, "t")]
    got = source_mix.mix(few(spark, rows)).collect()
    taken = collections.defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert abs(r.copies - r.rate) < 2
    assert len(got) == 801
    for s in "st":
        target = next(r.target for r in got if r.source == s)
        assert abs(taken[s] - target) <= (4 if s == "s" else 40)


def test_many_sources_are_ranked_by_code_point(spark):
    names = ["b", "a", "é", "Z", "", "😀", "\uffff", None, *(f"h{k}" for k in range(300))]
    order = [*sorted(n for n in names if n is not None), None]
    got = {r.source: r.target for r in source_mix.mix(few(spark, [(i, "w " * 100, n) for i, n in enumerate(names)])).collect()}
    unit = 100 * len(names) / sum(1 + k % 3 for k in range(len(names)))
    assert all(got[n] == pytest.approx(unit * (1 + k % 3)) for k, n in enumerate(order))


@pytest.mark.parametrize("stage", [exact_dedup.drop_exact_copies, simhash.drop_near_copies, near_copies.drop_near_copies, source_mix.mixed_documents])
def test_columns_of_any_name_are_kept(spark, stage):
    extra = ["a.b", "__size", "row", "ROW_", "rid", "times", "copy", "__copies", "key`s", "label"]
    docs = spark.createDataFrame([(i, prose(i, 40), "s", *(f"{i}{c}" for c in extra)) for i in range(30)], ["doc_id", "text", "source", *extra])
    shuffled = docs.repartition(3)  # not stable: stored once
    for df in (docs, shuffled):
        kept = stage(df)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(tuple(r)[3:] == tuple(f"{r.doc_id}{c}" for c in extra) and r.text == prose(r.doc_id, 40) for r in rows)


# --- quality


def test_quality_learns_and_keeps_the_fold(spark, hard, none):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = prose(i, 40)
        rows.append((i, " ".join(w + "$$$" for w in text.split()) if bad else text, "s"))
        labels.append((i, int(not bad) if zlib.crc32(str(i).encode()) % 5 else int(bad)))  # held-out labels are lies
    docs, marks = few(spark, rows), few(spark, labels, "doc_id long, quality int")
    got = quality.classify(docs, marks).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.doc_id % 4 != 0) == int(r.score >= 0.3) and 0 <= r.score <= 1
    assert quality.good_documents(docs, marks).columns == docs.columns
    kept = quality.good_documents(hard, marks)
    assert kept.columns == hard.columns and quality.classify(hard, marks).count() == len(TEXTS)
    assert quality.classify(none, marks).count() == 0
    alone = quality.classify(docs, marks.where("quality = 1 and doc_id % 4 <> 0").limit(5)).select("score").distinct().collect()
    assert len(alone) == 1
    assert quality.classify(docs, marks.limit(0)).select("score").first().score == pytest.approx(0.5)


def test_features_of_long_texts_in_parts(monkeypatch):
    texts = [prose(1, 500), "É " * 300 + "He He!" * 50, " \t" * 200, "x" * 700, "日本語 、" * 150]
    want = [set(quality.features(t).tolist()) for t in texts]
    monkeypatch.setattr(quality, "PART", 37)
    monkeypatch.setattr(quality, "KNOWN", 3)
    assert [set(quality.features(t).tolist()) for t in texts] == want


def test_ratios_and_dual_optimum():
    """Ratios against plain counts; the optimality conditions of the dual for every row."""
    texts = [prose(i, 15) + (" $$$" if i % 3 == 0 else "") for i in range(60)]
    labels = [int(i % 3 != 0) if i % 7 else 1 for i in range(60)]
    rows = [quality.features(t).astype(np.int32) for t in texts]
    ratio = quality.ratios(rows, labels)
    for b in rng_bins(rows):
        pos, neg = (sum(b in set(r.tolist()) for r, y in zip(rows, labels, strict=True) if y == c) + 1 for c in (1, 0))
        totals = [sum(len(r) for r, y in zip(rows, labels, strict=True) if y == c) + quality.BINS for c in (1, 0)]
        assert ratio[b] == pytest.approx(math.log(pos / totals[0] / (neg / totals[1])))
    y = np.array(labels)
    weights, bias, alpha = quality.fit(rows, y, ratio, passes=3000, least=1e-9)
    share = np.mean(y)
    again = np.zeros(quality.BINS)
    for r, label, a in zip(rows, labels, alpha, strict=True):
        x = ratio[r] / np.linalg.norm(ratio[r])
        sign, upper = (1, 0.5 / share) if label else (-1, 0.5 / (1 - share))
        gradient = sign * (weights[r] @ x + bias) - 1
        again[r] += a * sign * x
        assert -1e-9 <= a <= upper + 1e-9
        assert (a > 1e-7 or gradient > -1e-4) and (a < upper - 1e-7 or gradient < 1e-4) and (not 1e-7 < a < upper - 1e-7 or abs(gradient) < 1e-4)
    assert np.allclose(again, weights, atol=1e-5) and bias == pytest.approx(sum(a * (1 if label else -1) for a, label in zip(alpha, labels, strict=True)), abs=1e-6)


def rng_bins(rows):
    return np.random.default_rng(3).choice(np.unique(np.concatenate(rows)), 40, replace=False).tolist()


def test_sample_of_the_fit_is_bounded(spark):
    docs = few(spark, [(i, prose(i, 30) + " $$$" * (i % 2), "s") for i in range(300)])
    marks = few(spark, [(i, i % 2) for i in range(300)], "doc_id long, quality int")
    whole = quality.train(docs, marks)
    cut = quality.train(docs, marks, grams=20_000)
    assert whole.score(prose(5, 30) + " $$$") > 0.5 > whole.score(prose(5, 30)) and cut.score(prose(5, 30) + " $$$") > 0.5
    assert np.count_nonzero(cut.scaled) < np.count_nonzero(whole.scaled)
