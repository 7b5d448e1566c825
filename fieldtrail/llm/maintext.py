"""Main text of HTML pages by minimum-cut labelling.

A page becomes a row of text blocks. A linear classifier gives each block its costs of being content or
boilerplate: the capacities to source and sink. Neighbouring blocks, and blocks near each other in the DOM,
are joined by smoothness edges. The minimum cut (by maximum flow) separates content from boilerplate.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template svg math iframe object canvas title".split())
#: Of these, those whose text is that of the page if nothing closes them; the others then go on to the page's end.
OPEN_ENDED = frozenset("noscript template svg math object canvas".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "head", "option", "optgroup", "legend", "summary", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd"}
SELF_CLOSING = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}

#: Elements, roles and words of class or id that speak for or against content. Fixed values.
BAD_TAGS = frozenset("nav aside footer button select menu dialog label fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar alertdialog toolbar".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars "
    "aside footer footers header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login register "
    "share sharing social comment comments commentlist disqus discussion reply replies respond related recommended recommendations pagination pager paging widget widgets copyright legal disclaimer "
    "search searchbox form skip tags taglist toc teaser".split()
)
GOOD_WORDS = frozenset("article content post entry story main body text hentry".split())
#: With one of these a header is an article's own.
ARTICLE_WORDS = frozenset("article post entry story hentry".split())

#: Weights of the classifier: a positive sum speaks for content.
WEIGHTS = {"bias": 0.0, "article": 3.0, "outside": -3.5, "bad": -14.0, "marked": -8.0, "good": 1.2, "length": 0.5, "links": -4.0, "sentence": 1.0, "heading": 1.0, "item": -0.4}
ADJACENT, SIBLING = 0.5, 0.3

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT_WORDS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    tag: str
    parent: int  # number of the containing element
    article: bool
    bad: bool
    good: bool
    marks: tuple[str, ...] = ()  # forms, and classes or ids with a bad word, around it
    inner: str = ""  # the innermost of article and main around it


@dataclass
class Element:
    tag: str
    number: int = 0
    article: bool = False
    bad: bool = False
    good: bool = False
    marks: tuple[str, ...] = ()
    inner: str = ""


def _hints(tag: str, raw: str, in_article: bool) -> tuple[bool, str, bool, str]:
    """Whether the element speaks against content, its mark (a form, or a class or id with a bad word), whether it
    speaks for content, and the article or main that it states to be."""
    bad, good, of_site = tag in BAD_TAGS, tag in GOOD_TAGS, tag == "header" and not in_article
    mark, stated = "form" if tag == "form" else "", tag if good else ""
    if raw and "=" in raw or "hidden" in raw:
        for m in _ATTRIBUTE.finditer(raw):
            name = m[1].lower()
            value = m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                words = {w.lower() for w in _SPLIT_WORDS.split(value)} | set(value.lower().split())
                against = words & BAD_WORDS
                if "header" in against and (words & ARTICLE_WORDS or (tag == "header" and in_article)):
                    against, of_site = against - {"header"}, False
                if tag not in ("body", "html") and against:
                    mark = f"{tag} {value}"
                elif words & GOOD_WORDS:
                    good = True
            elif name == "role":
                role = value.lower()
                bad, good = bad or role in BAD_ROLES, good or role in GOOD_TAGS
                mark, stated = mark or "form" * (role == "form"), stated or role * (role in GOOD_TAGS)
            elif (name == "hidden") or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
                bad = True
    # class words do not outweigh an element that states what it is
    return bad or of_site, "" if stated else mark, good, stated


def _wrappers(page: list[Block], stated: list[tuple[str, str, tuple[str, ...]]]) -> set[str]:
    """Marks of what only wraps the content: those around main and the first of its least marked articles, or, on a page
    with neither, forms and marks around elements of good words that hold more than half of the text."""

    def size(inner: str, marks: tuple[str, ...]) -> int:
        return sum(len(b.text) - b.links for b in page if not b.bad and b.inner == inner and b.marks == marks)

    main = next((marks for kind, _, marks in stated if kind == "main"), None)
    article = min((marks for kind, within, marks in stated if kind == "article" and (main is None or within == "main")), key=len, default=None)
    if main is None and article is None:
        seen = [b for b in page if not b.bad]
        around = {k: sum(len(b.text) for b in seen if k in b.marks) for k in {k for b in seen for k in b.marks if k == "form" or b.good}}
        return {k for k, n in around.items() if 2 * n > sum(len(b.text) for b in seen)}
    out = set(main or ())
    # a main with more text of its own is the content; its marked articles are teasers or comments
    if article is not None and (main is None or size("article", article) > size("main", main)):
        out |= set(article)
    return out


def blocks(html: str) -> list[Block]:
    """Text blocks in page order; text in the head, scripts, styles and comments is none. A script, style, title, text area or frame
    that nothing closes goes on to the end, as the standard has it; drawings and the like that nothing closes hide nothing."""
    out: list[Block] = []
    stack = [Element("")]
    # articles and mains: what each is, the main around it, its marks
    stated: list[tuple[str, str, tuple[str, ...]]] = []
    parts: list[str] = []
    links, in_link, count, at, skip_head = 0, 0, 0, 0, False
    opened: Counter[str] = Counter()  # elements on the stack
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                holder = next((x for x in reversed(stack) if x.tag in BLOCK), stack[0])
                out.append(Block(text, min(links, len(text)), holder.tag, stack[-2].number if len(stack) > 1 and stack[-1] is holder else holder.number, holder.article, stack[-1].bad, stack[-1].good, stack[-1].marks, stack[-1].inner))
            parts.clear()
        links = 0

    def close(k: int) -> None:
        nonlocal in_link, skip_head
        for x in stack[k:]:
            opened[x.tag] -= 1
            in_link -= x.tag == "a"
            skip_head = skip_head and x.tag != "head"
        del stack[k:]

    def add(text: str) -> None:
        nonlocal links
        if text and not skip_head:
            parts.append(text)
            links += len(text) if in_link else 0

    while True:
        m = _TOKEN.search(html, at)
        add(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        raw = m[3] or m[6] or ""
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    if tag in BLOCK:
                        flush()
                    close(k)
                    break
            continue
        if tag in RAW and not raw.endswith("/"):
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if end or tag not in OPEN_ENDED:
                at = end.end() if end else len(html)
            else:
                unclosed.add(tag)
            if tag not in ("svg", "math", "canvas", "object"):
                continue
            add(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P and opened["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in BLOCK:
                        break
            if tag in SELF_CLOSING:
                same, stop = SELF_CLOSING[tag]
                for k in range(len(stack) - 1, 0, -1) if any(opened[t] for t in same.split()) else ():
                    if stack[k].tag in stop:
                        break
                    if stack[k].tag in same.split():
                        close(k)
                        break
            if tag == "head":
                skip_head = True
            elif tag == "body":
                skip_head = False
        if tag in VOID:
            if tag in ("br", "img", "hr", "input"):
                add(" ")
            continue
        if raw.endswith("/") and tag not in BLOCK:
            continue
        top = stack[-1]
        bad, mark, good, kind = _hints(tag, raw, top.article)
        count += 1
        article = top.article or (good and tag in GOOD_TAGS) or "role" in raw and good and not bad and not mark
        if kind and not (top.bad or bad) and top.inner != "article":
            stated.append((kind, top.inner, top.marks))
        stack.append(Element(tag, count, article, top.bad or bad, top.good or good, (*top.marks, mark) if mark else top.marks, top.inner if top.inner == "article" else kind or top.inner))
        opened[tag] += 1
        in_link += tag == "a"
    flush()
    if any(b.marks for b in out):
        wraps = _wrappers(out, stated)
        for b in out:
            b.marks = tuple(k for k in b.marks if k not in wraps)
    return out


def costs(page: list[Block], weights: dict[str, float] = WEIGHTS) -> list[float]:
    """The classifier's sum for each block: above 0 for content."""
    has_article = any(b.article and not b.bad and not b.marks for b in page)
    out = []
    for b in page:
        n, w = len(b.text), weights
        z = w["bias"] + w["length"] * min(4.0, math.log1p(n / 20)) + w["links"] * b.links / n
        z += w["sentence"] * (b.text[-1] in ".!?:;…\"”»" and n > 20)
        z += (w["bad"] if b.bad else w["marked"] * bool(b.marks)) + w["good"] * b.good + (w["article"] if b.article else w["outside"] * has_article)
        z += w["heading"] * (b.tag in ("h1", "h2", "h3", "h4", "h5", "h6")) + w["item"] * (b.tag == "li")
        out.append(z)
    return out


def min_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut. ``terminal``: above 0 the capacity from the
    source, below 0 that to the sink. Edges have their capacity in both directions. Dinic's algorithm."""
    n = len(terminal)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    graph: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(there)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for v, z in enumerate(terminal):
        if z > 0:
            link(source, v, z, 0.0)
        elif z < 0:
            link(v, sink, -z, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    eps = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in graph[v]:
                if room[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        here = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if room[e] <= eps)
                del path[k:]
                v = to[path[-1]] if path else source
                continue
            for i in range(here[v], len(graph[v])):
                e = graph[v][i]
                if room[e] > eps and level[to[e]] == level[v] + 1:
                    here[v] = i
                    path.append(e)
                    v = to[e]
                    break
            else:
                here[v] = len(graph[v])
                level[v] = -2
                if v == source:
                    break
                e = path.pop()
                v = to[e ^ 1]


def label(page: list[Block], adjacent: float = ADJACENT, sibling: float = SIBLING) -> list[bool]:
    """True for content blocks."""
    z = costs(page)
    if all(x > 0 for x in z) or not any(x > 0 for x in z):
        return [x > 0 for x in z]
    edges = [(i, i + 1, adjacent * (1.0 if page[i].parent == page[i + 1].parent else 0.3)) for i in range(len(page) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(page):
        if b.parent in last:
            edges.append((last[b.parent], i, sibling))
        last[b.parent] = i
    return min_cut(z, edges)


def main_text(html: str | None) -> tuple[str, int, int]:
    """Content blocks in page order joined by a blank line; blocks of content and of all."""
    page = blocks(html or "")
    keep = label(page) if page else []
    return "\n\n".join(b.text for b, k in zip(page, keep, strict=True) if k), sum(keep), len(page)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (empty if none), n_chars (code points), n_blocks, n_content. A null html counts as empty; repeated rows stay; an empty table gives no row; pages are read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(x) for x in batch[2].to_pylist()]
            texts = [g[0] for g in got]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], [id_col, "url", "text", "n_chars", "n_blocks", "n_content"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, url string, text string, n_chars long, n_blocks long, n_content long")
