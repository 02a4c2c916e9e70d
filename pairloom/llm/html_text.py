"""Main text of web pages by tree scoring.

A page is cut into tags and text by one expression and put into a tree of its block elements; text between block
boundaries is a paragraph. Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are taken out by element, role or the words of class and id. Every paragraph passes points for its length and
commas to its container, half as many to the one above, a third to the next and so on up to the root; a container's points are
discounted by the share of its text inside links. The best container is kept with all that is in it, and so are the siblings
that score beside it, running paragraphs and the title beside it, and headings, lists, tables and text between any of these.

Defined results: null or empty html, and pages without text, give the empty string; markup cut off anywhere is read as
far as it goes; character references are decoded, unknown ones stay as they are; repeated rows are rows of their own;
other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z|(?=["']))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Fixed values of HTML: elements whose content is not text, that have no content, and that break paragraphs.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html "
    "legend li main menu nav ol option p pre search section select summary svg table tbody td tfoot th thead tr ul button object".split()
)
#: A new one of these ends an open one of the second set, up to the nearest element of the third.
ENDS = {
    **dict.fromkeys(("li",), (frozenset(["li"]), frozenset(["ul", "ol", "menu"]))),
    **dict.fromkeys(("dt", "dd"), (frozenset(["dt", "dd"]), frozenset(["dl"]))),
    **dict.fromkeys(("td", "th"), (frozenset(["td", "th"]), frozenset(["tr", "table"]))),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
CLOSES_P = BLOCKS - frozenset(["option", "select", "button", "object", "svg"])
#: Elements and roles that are never the article, and the words of class or id that name such parts.
OUT_TAGS = frozenset("nav footer aside form dialog menu head select option button svg search object fieldset".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
OUT_WORDS = re.compile(
    r"ads?|adv|advert\w*|adbox|adslot|adsense|banners?|sponsor\w*|promo\w*|sidebars?|side|rail|widgets?|menus?|nav|navbar|navigation|breadcrumbs?|cookies?|consent|gdpr|"
    r"notices?|notifications?|alerts?|newsletter|subscri\w*|signup|login|popup|modal|overlay|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|discussion|"
    r"reply|replies|respond|responses|footer|foot|header|masthead|topbar|toolbar|search|searchform|pagination|pager|skip|outbrain|taboola|form|aside|toc"
)
IN_WORDS = frozenset("article content main post entry story body text page".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Nodes and weights on 0..1 whose sum of weight * node ** d is 1 / (d + 1): shares that fold level by level, exact for the
#: first 2 * 24 levels and smooth above.
NODES, WEIGHTS = (v / 2 for v in np.polynomial.legendre.leggauss(24))
NODES = NODES + 0.5
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Cells that an end tag inside does not leave, but for these.
CELLS, TABLE_ENDS = ("td", "th", "table"), frozenset(["tr", "tbody", "thead", "tfoot", "table", "td", "th", "body", "html"])
CONTAINERS = BLOCKS - HEADINGS - frozenset(["p", "pre", "li", "dt", "dd", "td", "th", "tr", "thead", "tbody", "tfoot", "figcaption", "caption", "summary", "legend", "address", "ul", "ol", "dl", "dir", "table", "head", "html"])


class Node:
    __slots__ = ("children", "links", "out", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.points, self.size, self.links, self.out = 0.0, 0, 0, ""


def unwanted(tag: str, attributes: str, inside: bool) -> str:
    """Why an element is no part of an article: 'tag', 'comment', 'word', or '' if it may be one. inside: it stands in
    an article or main element."""
    if tag in OUT_TAGS or tag == "header" and not inside:
        return "tag"
    if not attributes or tag in ("html", "body", "article", "main"):
        return ""
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    role = found.get("role", "").lower()
    if role in OUT_ROLES and not (role == "banner" and inside):
        return "tag"
    if found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) or re.search(r"(?:^|\s)hidden(?=\s|=|/|$)", ATTRIBUTE.sub(" ", attributes)):
        return "tag"
    words = [w.lower() for w in WORDS.findall(found.get("class", "") + " " + found.get("id", ""))]
    bad = [w for w in words if OUT_WORDS.fullmatch(w)]
    if not bad:
        return ""
    if any(w.startswith(("comment", "disqus", "repl", "respon", "discuss")) for w in bad):
        return "comment"
    if set(bad) <= {"header", "side", "form", "foot", "share"} and (inside or IN_WORDS & set(words)):
        return ""
    return "word"


def parsed(page: str) -> Node:
    """The tree of block elements; paragraphs are (text, characters inside links) among the children."""
    root = Node("body", None)
    stack, texts, linked, in_link = [root], [], 0, 0
    places: defaultdict[str, list[int]] = defaultdict(list)  # on the stack, by name: no tag makes a search of the stack
    headings: list[int] = []
    at, n = 0, len(page)

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def flush() -> None:
        nonlocal texts, linked
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                stack[-1].children.append((text, min(linked, len(text))))
            texts, linked = [], 0

    def close(upto: int) -> None:
        flush()
        for s in stack[upto:]:
            places[s.tag].pop()
        del stack[upto:]
        while headings and headings[-1] >= upto:
            headings.pop()

    while at < n:
        m = TAG.search(page, at)
        if not m:
            texts.append(page[at:])
            linked += (n - at) * bool(in_link)
            break
        if m.start() > at:
            texts.append(page[at : m.start()])
            linked += (m.start() - at) * bool(in_link)
        at = m.end()
        name = m[2]
        if not name:
            continue
        tag = name.lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag == "br":
                flush()
            elif tag in BLOCKS:
                flush()
                mine = innermost((tag,))
                if mine and (tag in TABLE_ENDS or mine >= innermost(CELLS)):
                    close(mine)
            continue
        if tag in RAW:
            if tag == "noscript":
                continue
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = page.find(">", end.start()) + 1 or n if end else n
            continue
        if tag == "a":
            in_link = 1
        if tag in ("br", "hr"):
            flush()
        elif tag == "img" or tag in EMPTY:
            continue
        elif tag in BLOCKS:
            flush()
            if tag in ("html", "body"):
                continue
            if tag in CLOSES_P and places["p"]:
                mine = places["p"][-1]
                if len(headings) - bisect_right(headings, mine) == len(stack) - 1 - mine:  # nothing but headings stands in it
                    close(mine)
            if tag in ENDS:
                mine, limit = map(innermost, ENDS[tag])
                if mine and mine >= limit:
                    close(mine)
            if places["head"] and tag != "head":
                close(places["head"][0])
            node = Node(tag, stack[-1])
            node.out = unwanted(tag, m[3], bool(places["article"] or places["main"]))
            stack[-1].children.append(node)
            places[tag].append(len(stack))
            if tag in HEADINGS:
                headings.append(len(stack))
            stack.append(node)
            if m[3].endswith("/") and tag == "svg":
                close(len(stack) - 1)
    flush()
    return root


def measured(node: Node) -> None:
    """Sizes of text and of text inside links, from the leaves up; parts that are out count for nothing above."""
    todo: list[tuple[Node, bool]] = [(node, False)]
    while todo:
        at, ready = todo.pop()
        if not ready:
            todo.append((at, True))
            todo += [(c, False) for c in at.children if isinstance(c, Node)]
            continue
        for c in at.children:
            if isinstance(c, Node):
                if not c.out:
                    at.size, at.links = at.size + c.size, at.links + c.links
            else:
                at.size, at.links = at.size + len(c[0]), at.links + c[1]


def every(node: Node) -> Iterator[Node]:
    """All nodes that are not out, in page order."""
    todo = [node]
    while todo:
        at = todo.pop()
        yield at
        todo += [c for c in reversed(at.children) if isinstance(c, Node) and not c.out]


def density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def paragraphs(node: Node) -> Iterator[str]:
    """All text of a part but what is out, in page order."""
    todo: list = [node]
    while todo:
        at = todo.pop()
        if isinstance(at, Node):
            if not at.out:
                todo += reversed(at.children)
        else:
            yield at[0]


def score(root: Node) -> dict[int, Node]:
    """Gives each container its points: those of each paragraph below, divided by one more than the containers between."""
    holders: dict[int, Node | None] = {id(None): None}  # the nearest container of each node, itself included
    scored: dict[int, Node] = {}
    own: dict[int, float] = {}
    nodes = list(every(root))
    for node in nodes:
        holder = holders[id(node)] = node if node.tag in CONTAINERS else holders[id(node.parent)]
        for c in node.children:
            if isinstance(c, Node) or holder is None:
                continue
            text, linked = c
            points = (0.25 if len(text) < 25 else 1) + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)
            points *= 1 - linked / len(text)
            if node.tag in HEADINGS:
                points = 0.0
            own[id(holder)] = own.get(id(holder), 0.0) + points
            at = holder
            while at is not None and id(at) not in scored:
                scored[id(at)] = at
                at = holders[id(at.parent)]
    passed: dict[int, np.ndarray] = {}
    for node in reversed(nodes):
        if id(node) not in scored:
            continue
        folded = passed.pop(id(node), 0.0) + np.full(len(NODES), own.get(id(node), 0.0))
        node.points = round(float(WEIGHTS @ folded), 9)
        above = holders[id(node.parent)]
        if above is not None:
            passed[id(above)] = passed.get(id(above), 0.0) + NODES * folded
    return scored


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parsed(page)
    # Without an article element, a part that holds most of the running text is the article, whatever its class says.
    measured_once(root)
    marked = any(n.tag in ("article", "main") and n.size for n in every(root))
    for n in [] if marked else list(every_named(root)):
        if n.size > 0.6 * (root.size + n.size) and density(n) < 0.3:
            n.out = ""
    measured_once(root)
    if not root.size:
        return ""
    scored = score(root)
    worth = lambda n: n.points * (1 - density(n))
    best = max(scored.values(), key=worth, default=root)
    if best.parent is None:
        return " ".join(paragraphs(best))
    siblings = best.parent.children
    at = next(i for i, c in enumerate(siblings) if c is best)
    taken = [i for i, c in enumerate(siblings) if i == at or isinstance(c, Node) and not c.out and beside(c, best, worth, i < at)]
    kept, wanted = [], set(taken)
    for i, c in enumerate(siblings):
        between = taken[0] < i < taken[-1] and (not isinstance(c, Node) or not c.out and c.tag not in CONTAINERS and density(c) < 0.5)
        if i in wanted or between:
            kept += paragraphs(c) if isinstance(c, Node) else [c[0]]
    return " ".join(kept)


def beside(c: Node, best: Node, worth, before: bool) -> bool:
    """Does a sibling of the best container belong to the article?"""
    running = c.tag in ("p", "pre", "blockquote") and (c.size > 80 and density(c) < 0.25 or 0 < c.size and not c.links and best.tag not in ("article", "main"))
    title = before and (c.tag in ("h1", "hgroup") or c.tag == "header") and density(c) < 0.5  # a header that is not out stands in an article
    return running or title or c.tag in CONTAINERS and c.tag == best.tag and worth(c) >= max(3.0, 0.2 * worth(best)) and density(c) < 0.5


def every_named(root: Node) -> Iterator[Node]:
    """Outermost parts that are out for a word of their class or id."""
    todo = [root]
    while todo:
        at = todo.pop()
        for c in at.children:
            if isinstance(c, Node):
                if c.out == "word":
                    yield c
                elif not c.out:
                    todo.append(c)


def measured_once(root: Node) -> None:
    todo = [root]
    while todo:
        at = todo.pop()
        at.size = at.links = 0
        todo += [c for c in at.children if isinstance(c, Node)]
    measured(root)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col("page_id").cast("long"), "url", "html"), run, "page_id long, url string, text string, n_chars long")
