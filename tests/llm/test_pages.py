"""WARC and HTML operators: round trips, damage, and pages of known content."""

import base64
import collections
import gzip
import hashlib
import html
import io
import random
import time

import pytest

from pairloom.llm import html_text, warc
from pairloom.llm.common import scratch

SCHEMA = "page_id long, url string, html string, file string, type string, keep long, sha string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "f", "t", 1, "s") for r in rows], SCHEMA)


HARD = [(1, "http://a/", "<p>x</p>"), (2, None, None), (3, "http://b/\r\nBad: y é", ""), (4, "u", "<p>é\r\n\r\nWARC/1.0</p>"), (5, "u", "<p>é\r\n\r\nWARC/1.0</p>"), (6, "http://a/", "<p>x</p>"), (7, "v", "y" * 300_000), (7, "v", "y" * 300_000), (8, "w", "\x1f\x08\x00 WARC/1.1")]


def test_round_trip(spark):
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_records(pages(spark, HARD)).collect())
    best = {}
    for i, _, h in HARD:
        best[h or ""] = max(best.get(h or "", -1), i)
    want = collections.Counter()
    for i, _, h in HARD:
        p, k = (h or "").encode(), best[h or ""]
        want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if k == i else "revisit", None if k == i else k] += 1
    assert got == want
    assert warc.page_records(pages(spark, [])).count() == 0


def test_small_splits_and_payloads(spark):
    folder, df = scratch(spark, "warc"), pages(spark, HARD)
    found = warc.read_archives(spark, folder, warc.write_archives(df, folder, file_bytes=2000), split_bytes=100)
    rows = found.collect()
    assert warc.gaps(found).count() == 0 and len(rows) == len(HARD)
    assert {bytes(r.block).split(b"\r\n\r\n", 1)[1].decode() for r in rows if r.type == "response"} == {h or "" for _, _, h in HARD}


RECORDS = [warc.record("response", i, f"http://h/{i}", bytes(random.Random(i).choices(b"abc \x1f\x8b\x08WARC/1.\r\n:", k=300 * i))) for i in range(1, 40)]


def read(data: bytes, step: int) -> list[warc.Found]:
    return [f for a in range(0, len(data), step) for f in warc.salvage(io.BytesIO(data), len(data), a, a + step)]


@pytest.mark.parametrize("step", [10**9, 5000, 777])
@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped, step):
    parts = [warc.gzipped(r) if zipped else r for r in RECORDS]
    at = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    whole = b"".join(parts)
    assert [(f.start, f.stop, f.problem) for f in read(whole, step)] == [(a, b, None) for a, b in zip(at, at[1:], strict=False)]
    bad = bytearray(whole)
    bad[at[10] + len(parts[10]) // 2] ^= 0x55  # a payload byte
    bad[at[20] : at[20] + 2] = b"zz"  # a magic number
    data = b"junk" + bytes(bad[: at[30]]) + b"junk" * 10 + bytes(bad[at[30] : -20])
    got = read(data, step)
    ids = [f.headers["warc-record-id"] for f in got if not f.problem]
    assert ids == [f"<urn:page:{i + 1}>" for i in range(39) if i not in (10, 20, 38)]
    assert len([f for f in got if f.problem]) == 5
    covered = sorted((f.start, f.stop) for f in got)  # every byte once: in a record or in a logged gap
    assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))


def ids_of(found: list[warc.Found]) -> list[str]:
    return [f.headers["warc-record-id"][10:-1] for f in found if not f.problem]


@pytest.mark.parametrize("step", [10**9, 3000])
def test_several_records_in_a_member(step):
    """Each record of a member is read, bad bytes between them are a gap within it."""
    several = warc.gzipped(b"".join(RECORDS[1:4]) + b"noise" + RECORDS[4] + RECORDS[5][:200] + RECORDS[6])
    data = warc.gzipped(RECORDS[0]) + several + warc.gzipped(RECORDS[7])
    got = read(data, step)
    assert ids_of(got) == ["1", "2", "3", "4", "5", "7", "8"]
    gaps = [(f.start, f.stop, f.inner_stop - f.inner) for f in got if f.problem]
    a = len(warc.gzipped(RECORDS[0]))
    assert gaps == [(a, a + len(several), 5), (a, a + len(several), 200)]


@pytest.mark.parametrize("step", [10**9, 3000])
@pytest.mark.parametrize("damage", ["cut", "bits", "crc"])
def test_records_before_the_damage_of_a_member(damage, step):
    several = bytearray(warc.gzipped(b"".join(RECORDS[10:30])))
    if damage == "cut":
        del several[len(several) // 2 :]
    elif damage == "bits":
        several[len(several) // 2 : len(several) // 2 + 40] = bytes(40)
    else:
        several[-8] ^= 1
    first, last = warc.gzipped(RECORDS[0]), warc.gzipped(RECORDS[7])
    data = first + bytes(several) + last
    got = read(data, step)
    ids = ids_of(got)
    assert ids[0] == "1" and ids[-1] == "8" and ids[1:-1] == [str(i) for i in range(11, 11 + len(ids) - 2)]
    assert len(ids) == 22 if damage == "crc" else 5 < len(ids) < 20
    spans = sorted({(f.start, f.stop) for f in got})
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_long_members_take_time_in_proportion():
    import time

    data = warc.gzipped(warc.record("response", 1, None, random.Random(1).randbytes(32 << 20)))
    began = time.process_time()
    assert ids_of(read(data, 10**9)) == ["1"]
    assert time.process_time() - began < 5


def test_null_and_repeated_pages(spark):
    rows = [(None, "u", "<p>same</p>"), (None, None, None), (3, "u", "<p>same</p>"), (3, "u", "<p>same</p>")]
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.page_records(pages(spark, rows)).collect())
    assert got == [("3", "response", None), ("3", "response", None), ("None", "response", None), ("None", "revisit", 3)]


def test_salvage_of_nothing_valid():
    assert [(f.start, f.stop) for f in read(b"no archive at all" * 50, 10**9)] == [(0, 850)]
    assert read(b"", 10) == []


PARTS = {
    "menu": '<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav>',
    "header": '<header><div class="logo">The Site, a site</div></header>',
    "side": '<div class="sidebar"><h3>Side, side</h3><p>Other words, in a side bar, that are rather long, so long that they might score.</p></div>',
    "notice": '<div id="cookie-notice"><p>We use cookies, as everyone does, please accept them all, thank you.</p></div>',
    "advert": '<div class="ad-banner">Buy, buy, buy, now, at once, and at a very low price, today.</div>',
    "form": '<form action="x"><label>Your mail, please</label><input name="m"><button>Send it</button></form>',
    "script": '<script>var t = "<p>not text, no</p>";</script><style>p { margin: 0 }</style><!-- <p>comment</p> -->',
    "comments": '<section id="comments"><h2>Comments</h2><div class="comment"><p>Nice, nice, nice, very nice indeed, I say, and more, and more, and more, and more of it.</p></div></section>',
    "footer": "<footer>&copy; someone, 2024</footer>",
}
BODY = [("h1", "A title &amp; more"), ("p", "First, a <b>bold</b>er   start,\n with &lt;signs&gt;, and words, words, words enough for a paragraph."), ("p", 'Short <a href="x">link</a>.'), ("blockquote", "Quoted, as it was said."), ("p", "x")]


def expected() -> str:
    import re

    return " ".join(" ".join(html.unescape(re.sub("<[^>]+>", "", t)).split()) for _, t in BODY)


@pytest.mark.parametrize("holder", ["article", "main", 'div class="content"', 'div id="post-body"', "div"])
@pytest.mark.parametrize("cut", [0, 40])
def test_article_alone_is_kept(holder, cut):
    inner = "".join(f"<{t}>{x}</{t}>" for t, x in BODY)
    tag = holder.split()[0]
    p = PARTS
    page = f"<!DOCTYPE html><html><head><title>T, t</title>{p['script']}</head><body class='has-sidebar'>{p['header']}{p['menu']}{p['notice']}{p['advert']}<{holder}>{inner}</{tag}>{p['side']}{p['form']}{p['comments']}{p['footer']}</body></html>"
    assert html_text.main_text(page[: len(page) - cut]) == expected()


def test_parts_inside_the_article_go():
    p = PARTS
    page = f"<body><article><header><h1>T</h1></header><p>One, two, three, and a good deal more of text here.{p['script']}</p>{p['advert']}<p>Four.</p>{p['comments']}<footer>by me</footer></article></body>"
    assert html_text.main_text(page) == "T One, two, three, and a good deal more of text here. Four."


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p></p>", ""), ("plain, only", "plain, only"), ("<p>a<p>b<br>c", "a b c"), ("<article><p>a &am", "a &am"), ("<p>x < y &notit; &#65;&#x42;</p>", "x < y ¬it; AB"), ("<p title=\"a>b\">t</p>", "t"), ("<p>a<script>x", "a"), ("<div><p>" * 3000 + "deep", "deep"), ("<table><tr><td>a<td>b</table>", "a b")])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_paragraphs_in_many_wrappers_stay_together():
    words = [f"Paragraph {k}, with words, and more words, enough of them to count as running text." for k in range(12)]
    page = "<body><div>" + "".join("<div>" * 7 + f"<p>{w}</p>" + "</div>" * 7 for w in words) + "</div></body>"
    assert html_text.main_text(page) == " ".join(words)


def test_points_fall_by_levels():
    root = html_text.parsed("<div>" * 40 + "text of some length, in here")
    html_text.measured_once(root)
    by_level = [n.points for n in html_text.score(root).values()]
    assert len(by_level) == 41 and all(abs(p * (k + 1) - by_level[0]) < 1e-6 for k, p in enumerate(by_level))


CARDS = "".join(f'<article><h2><a href="/{k}">Teaser number {k}</a></h2><p>Short, of {k}.</p></article>' for k in range(6))
LONG = "".join(f"<p>Paragraph {k}, with words, and more words, enough of them to count as running text.</p>" for k in range(6))


@pytest.mark.parametrize("holder", ["div", "article", "main"])
def test_the_score_chooses_among_articles(holder):
    """Cards of other articles stand beside the page's own, which need not be marked."""
    page = f"<body><div class='a'><div class='b'>{CARDS}</div></div><div class='c'><{holder}><h1>Own title</h1>{LONG}</{holder}></div></body>"
    got = html_text.main_text(page)
    assert got.startswith("Own title Paragraph 0,") and "Teaser" not in got and got.count("Paragraph") == 6


def test_all_of_the_best_container_and_what_stands_between_is_kept():
    links = "<ul><li><a href='/1'>Source one</a></li><li><a href='/2'>Source two</a></li></ul>"
    assert "Source one Source two" in html_text.main_text(f"<body><div><div>{LONG}{links}{LONG}</div></div></body>")
    page = f"<body><section><header><h1>Title</h1></header><div>{LONG}</div><h2>Middle</h2><table><tr><td>cell</td></tr></table>bare text<div>{LONG[: len(LONG) // 2]}</div><h3>After</h3></section></body>"
    got = html_text.main_text(page.replace("section", "article"))
    assert got.startswith("Title Paragraph 0,") and "Middle cell bare text Paragraph 0," in got and "After" not in got


def naive_points(page: str) -> list[float]:
    """Points of each div in page order, by its definition: every paragraph's points over one more than the divs between."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.path, self.divs, self.texts = [], [], []

        def handle_starttag(self, tag, attrs):
            if tag == "div":
                self.path.append(len(self.divs))
                self.divs.append(0.0)

        def handle_endtag(self, tag):
            if tag == "div":
                self.path.pop()

        def handle_data(self, data):
            self.texts.append((list(self.path), data))

    tree = Tree()
    tree.feed(page)
    for path, text in tree.texts:
        points = (0.25 if len(text) < 25 else 1) + text.count(",") + min(len(text) / 100, 3.0)
        for levels, div in enumerate(reversed(path)):
            tree.divs[div] += points / (levels + 1)
    return tree.divs


@pytest.mark.parametrize("seed", range(20))
def test_points_against_their_definition(seed):
    rng = random.Random(seed)

    def part(depth: int) -> str:
        inner = "".join(part(depth + 1) if depth < 6 and rng.random() < 0.5 else f"<p>{', '.join(rng.choices(['some', 'more', 'words'], k=rng.randrange(1, 40)))}</p>" for _ in range(rng.randrange(1, 5)))
        return f"<div>{inner}</div>"

    page = part(0)
    root = html_text.parsed(page)
    html_text.measured_once(root)
    scored = html_text.score(root)
    want = naive_points(page)
    got = [n.points for n in html_text.every(root) if n.tag == "div"]
    assert len(got) == len(want) and all(abs(a - b) < 1e-6 for a, b in zip(got, want, strict=True))
    best = max((n for n in scored.values() if n.tag == "div"), key=lambda n: n.points)
    assert want[got.index(best.points)] == pytest.approx(max(want))


def test_extract(spark):
    rows = [(1, "u", "<article><p>é x</p></article>"), (2, None, None), (2, None, None), (3, "v", "<p>" + "word, " * 50_000)]
    got = sorted(((r.page_id, r.url, len(r.text), r.n_chars) for r in html_text.extract(pages(spark, rows)).collect()), key=str)
    assert got == [(1, "u", 3, 3), (2, None, 0, 0), (2, None, 0, 0), (3, "v", 299_999, 299_999)]
    assert html_text.extract(pages(spark, [])).count() == 0


def seconds(function) -> float:
    began = time.process_time()
    function()
    return time.process_time() - began


@pytest.mark.parametrize("unit", [b"WARC/1.", b"WARC/1.0\r\n", b"WARC/1.1\r\na: b\r\n", warc.MEMBER, warc.MEMBER + bytes(7)])
@pytest.mark.parametrize("packed", [False, True])
def test_salvage_of_hostile_bytes_takes_linear_time(unit, packed):
    def salvaged(size):
        data = unit * (size // len(unit))
        data = gzip.compress(data, 1) if packed else data
        found = list(warc.salvage(io.BytesIO(data), len(data)))
        assert all(f.problem for f in found) and found[0].start == 0 and found[-1].stop == len(data)

    assert seconds(lambda: salvaged(400_000)) < 3 * seconds(lambda: salvaged(200_000)) + 1


def test_headers_that_end_in_the_next_read_are_read():
    long = warc.record("response", 1, "http://a/" + "x" * 300_000, b"payload")
    for data in (long, gzip.compress(long), b"noise" + long):
        records = [f for f in warc.salvage(io.BytesIO(data), len(data)) if not f.problem]
        assert len(records) == 1 and records[0].block.endswith(b"payload")


HOSTILE_PAGES = {
    "noscript": lambda k: "<noscript>" * k,
    "items under many containers": lambda k: "<div>" * k + "<li>x" * k,
    "stray ends in a cell": lambda k: "<td>" + "<div>" * k + "</section>" * k + "</p>" * k,
    "ends in a cell": lambda k: "<div>" * k + "<td>" + "</div>" * k,
    "headings in paragraphs": lambda k: "<p><h1>" * k + "<div>" * k,
}


@pytest.mark.parametrize("page", HOSTILE_PAGES.values(), ids=HOSTILE_PAGES)
def test_hostile_pages_take_linear_time(page):
    assert seconds(lambda: html_text.parsed(page(20_000))) < 3 * seconds(lambda: html_text.parsed(page(10_000))) + 1
