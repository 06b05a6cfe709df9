"""HTML main-text extraction (op 9) by tree scoring.

The page is read once into a flat tree. Elements that are never part of an article (menus, page
headers, footers, sidebars, dialogs, scripts, hidden parts) are left out as they open. Names of classes and ids leave nothing
out by themselves: they mark elements, and what a mark means is decided when the sizes, the links and the points of
the whole page are known (``_dropped``). That holds for elements in the line too: where a block has any text outside of marked ones,
it is a sentence and stays whole; where it has none, it is judged like a marked block. Each paragraph passes points for its length and its commas to its
ancestors, less with every level; a container's points are discounted by its link density. The best
container, with the siblings that belong to it, is the article; its blocks come out in page order.

Work is linear in the page: tags are read by an attribute scanner without limits, and the positions of open
elements are kept by name, so that nesting of any depth costs the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pick, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag, and never part of an article.
RAW = frozenset("script style textarea title noscript noframes iframe template".split())
#: Everything in them stands in the line, formulas with their letters.
FOREIGN = frozenset(("svg", "math"))
#: Of formulas and drawings, what isn't shown.
UNSEEN = frozenset("annotation annotation-xml desc metadata defs".split())
#: The tag of a node that is no element but a block of marked text in the line.
IN_LINE = "-"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: They end an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A start tag on the left ends an open element on the right within the same parent.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = frozenset("ul ol dl table article main body section div td th".split())
LEFT_OUT = frozenset("nav footer aside button select option input menu dialog object canvas audio video map datalist head".split())
#: Of these, what stands in the line: the sentence goes on behind it.
IN_LINE_OUT = frozenset("button select option input object canvas audio video map datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
#: Names of what stands beside an article.
WIDGET = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion promoted banner breadcrumb breadcrumbs comment comments commentlist disqus reply replies "
    "respond responses cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar sidebars aside rail menu nav navbar navigation topnav "
    "footer foot masthead social share sharing related recommended recommendations outbrain taboola widget widgets toolbar pagination pager toc copyright disclaimer alert announcement toast".split()
)
#: Of these, what no part of an article is called, whatever it is about.
SURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsored promo promotion promoted breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login sidebar sidebars navbar topnav masthead outbrain taboola toolbar pagination pager".split()
)
#: These tell of something beside an article only where no element is marked as one.
OUTSIDE = frozenset("header tags legal skip search form".split())
#: Readers' comments may well be longer than the article.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond responses".split())
#: Words that stand with one of the above in a hyphenated name without changing what it means.
WITH = frozenset("slot box bar button buttons icon icons link links block blocks container wrapper wrap unit area list posts stories articles section sections panel inner outer label site page post global top bottom left right primary secondary main sticky fixed floating mobile desktop thread body head title text bottom row col item js".split())
WEAK, STRONG, SURE, READERS = 1, 2, 3, 4
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_KEY = re.compile(r"[\s/]*(=?[^\s/>=]*)")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _name_mark(token: str, in_article: bool) -> int:
    """What one class or id says: STRONG if all its words name something beside the article, WEAK if some do, SURE if one of
    all of them names nothing else."""
    parts = [w.lower() for w in _WORD.findall(token)]
    if len(parts) > 1 and "".join(parts) in WIDGET:
        parts = ["".join(parts)]
    words = {w for w in parts if not w.isdigit()}
    found = words & (WIDGET if in_article else WIDGET | OUTSIDE)
    if not found:
        return STRONG if token.lower() == "hidden" else 0
    if words - found - WITH:
        return WEAK
    return READERS if found & COMMENTS else SURE if found & SURE_NAMES else STRONG


def _attributes(html: str, at: int, quotes: dict[str, int]) -> tuple[dict[str, str], int]:
    """The attributes of a tag whose name ends at ``at``, and the place behind its ">" (-1: the page ends before).

    A quoted value ends at its quote, whatever stands between. Where the page holds no such quote any more, the quote is
    a plain character; ``quotes`` remembers from where on that is so, so that no part of the page is searched twice.
    """
    own: dict[str, str] = {}
    n = len(html)
    while True:
        m = _KEY.match(html, at)
        key, at = m[1], m.end()
        if not key:
            if at < n and html[at] == ">":
                return own, at + 1
            if at >= n:
                return own, -1
        value = ""
        m = _EQUALS.match(html, at) if key else None
        if m:
            at = m.end()
            quote = html[at : at + 1]
            end = -1
            if quote in ("'", '"') and quote and at < quotes.get(quote, n):
                end = html.find(quote, at + 1)
                if end < 0:
                    quotes[quote] = at
            if end >= 0:
                value, at = html[at + 1 : end], end + 1
            else:
                m = _BARE.match(html, at)
                value, at = m.group(), m.end()
        own.setdefault(key.lower(), value)


def _marked(name: str, own: dict[str, str], in_article: bool) -> tuple[bool, bool, int]:
    """Is the element left out? Is it marked as the article itself? What do its names say?"""
    if name in LEFT_OUT or (name == "header" and not in_article):
        return True, False, 0
    body, mark, out = name in ("article", "main"), SURE if name == "form" else 0, False
    for key, value in own.items():
        if key in ("class", "id"):
            for token in value.split():
                mark = max(mark, _name_mark(token, in_article))
        elif key == "role":
            role = value.strip().lower()
            out |= role in ROLES
            body |= role in ("main", "article")
        elif key == "itemprop":
            body |= value.strip().lower() == "articlebody"
        elif key == "hidden":
            out |= value.lower() != "until-found"
        elif key == "aria-hidden":
            out |= value.strip().lower() == "true"
        elif key == "style":
            out |= _UNSEEN_STYLE.search(unescape(value)) is not None
    if name in ("html", "body"):
        out, mark = False, 0
    return out, body and not out, mark


class _Page:
    """Nodes in page order: parent, tag, is article, mark of its names (of what is marked as the article apart, as it isn't left out
    for a name, but for readers' comments beside others); blocks: (node, text, length of link text)."""

    def __init__(self, html: str):
        self.parent, self.tag, self.body, self.mark, self.body_mark = [-1], [""], [False], [0], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._parts: list[str] = []
        self._linked, self._least = 0, READERS
        self._read(html)
        if any(b and m != READERS for b, m in zip(self.body, self.body_mark, strict=True)):
            for i, m in enumerate(self.body_mark):  # a reader's comment may be an article element of its own
                if m == READERS:
                    self.body[i], self.mark[i] = False, m

    def _node(self, parent: int, tag: str, body: bool, mark: int) -> int:
        self.parent.append(parent), self.tag.append(tag), self.body.append(body)
        self.mark.append(0 if body else mark), self.body_mark.append(mark if body else 0)
        return len(self.parent) - 1

    def _flush(self, node: int) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                if self._least:  # all of it stands in marked elements in the line
                    node = self._node(node, IN_LINE, False, self._least)
                self.blocks.append((node, text, min(self._linked, len(text))))
            self._parts, self._linked, self._least = [], 0, READERS

    def _read(self, html: str) -> None:
        # stack entries: (tag, in the line, node of the nearest block, inside a link, inside an article, mark in the line)
        stack: list[tuple[str, bool, int, bool, bool, int]] = [("", False, 0, False, False, 0)]
        opened: dict[str, list[int]] = {}  # places in the stack, by name
        blocks, scopes, foreign = [0], [0], []  # places of elements that are not in the line, that bound a search, that are foreign
        skipping, skipped = "", 0  # name of the left-out element, and how many of that name are open in it
        quotes: dict[str, int] = {}
        pos, n = 0, len(html)

        def text(s: str) -> None:
            if s and not skipping:
                s = unescape(s) if "&" in s else s
                self._parts.append(s)
                own = len(s.strip())
                if own and stack[-1][5] < self._least:
                    self._least = stack[-1][5]
                if stack[-1][3]:
                    self._linked += own

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                tag, inline, node, *_ = stack.pop()
                at = len(stack)
                opened[tag].pop()
                for places in (blocks, scopes, foreign):
                    if places and places[-1] == at:
                        places.pop()
                if not inline:
                    self._flush(node)

        while pos < n:
            lt = html.find("<", pos)
            if lt < 0:
                text(html[pos:])
                break
            if lt > pos:
                text(html[pos:lt])
            nxt = html[lt + 1 : lt + 2]
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 2)
                pos = n if end < 0 else end + 3
                continue
            if nxt in ("!", "?"):
                end = html.find(">", lt)
                pos = n if end < 0 else end + 1
                continue
            closing = nxt == "/"
            m = _NAME.match(html, lt + 1 + closing)
            if not m:
                if closing:
                    end = html.find(">", lt)
                    pos = n if end < 0 else end + 1
                else:
                    text("<")
                    pos = lt + 1
                continue
            name = m.group().lower()
            if html.startswith(">", m.end()):
                own, pos = {}, m.end() + 1
            else:
                own, pos = _attributes(html, m.end(), quotes)
                if pos < 0:  # a tag that the page's end cuts off
                    break
            empty = name in VOID or html[pos - 2] == "/"
            if not closing and name in RAW:
                if html[pos - 2] != "/":
                    end = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(html, pos)
                    if end is None:
                        pos = n
                    else:
                        close = html.find(">", end.start())
                        pos = n if close < 0 else close + 1
                continue
            if skipping == "p" and (name in CLOSES_P if not closing else name != "p" and name not in INLINE):
                skipping = ""  # a paragraph ends without a tag of its own
            if skipping:
                # only the nesting of the left-out element's own tag counts
                if name == skipping:
                    if closing:
                        skipped -= 1
                        if not skipped:
                            skipping = ""
                    elif not empty:
                        skipped += 1
                elif closing and name in ("body", "html", "article", "main") and opened.get(name):
                    skipping = ""  # it was never closed
                    pop_to(opened[name][-1])
                continue
            if closing:
                if not opened.get(name):
                    continue
                at = opened[name][-1]
                if (stack[at][1] and blocks[-1] > at) or (name == "p" and scopes[-1] > at):
                    continue
                pop_to(at)
                continue
            if name in VOID:
                if name == "hr":
                    self._flush(stack[-1][2])
                elif name == "br" or name in IN_LINE_OUT:
                    text(" ")
                continue
            if name in CLOSES_P:
                if opened.get("p") and scopes[-1] < opened["p"][-1]:
                    pop_to(opened["p"][-1])
            elif name in ENDS:
                at = max((opened[t][-1] for t in ENDS[name] if opened.get(t)), default=0)
                # td and th are bounds themselves, those that end included
                if at and scopes[-1] <= at:
                    pop_to(at)
            _, _, block, linked, in_article, line_mark = stack[-1]
            out, body, mark = _marked(name, own, in_article)
            inline = name in INLINE or name in FOREIGN or bool(foreign)
            if out or (foreign and name in UNSEEN):
                if name in IN_LINE_OUT:
                    text(" ")
                elif not (empty or inline):
                    self._flush(block)
                if not (empty or name == "option"):
                    skipping, skipped = name, 1
                continue
            if empty and (inline or name not in CLOSES_P):
                if foreign or name in FOREIGN:
                    continue
            if not inline:
                self._flush(block)
                block = self._node(block, name, body, mark)
                blocks.append(len(stack))
                if name in SCOPE:
                    scopes.append(len(stack))
            if name in FOREIGN:
                foreign.append(len(stack))
            opened.setdefault(name, []).append(len(stack))
            stack.append((name, inline, block, linked or name == "a", in_article or body, max(line_mark, mark) if inline and not foreign else line_mark if inline else 0))
        pop_to(1)
        self._flush(0)


def _points(text: str, links: int) -> float:
    """A paragraph's points: one, one more for each comma, and up to three for its length; none where links make up most of it."""
    return 0.0 if len(text) < 25 or links > len(text) / 2 else 1 + text.count(",") + min(len(text) / 100, 3)


def _dropped(page: _Page, article: list[int]) -> list[bool]:
    """Which marked elements, with all that they hold, are left out. ``article``: for each node, the outermost element marked as
    the article that holds it, or -1.

    In an article: SURE ones, unless more than half of its text is in them; of these STRONG ones that hold no paragraph with points or
    in which links make up over a half; and WEAK ones in which links make up over a half.
    Elsewhere: WEAK ones in which links make up over a third, and STRONG and SURE ones, unless no element with text is
    marked as an article and what the page holds outside of any such element has less than a tenth of their points. Readers'
    comments are exempt only where nothing else has any points.
    """
    parent, n = page.parent, len(page.parent)
    if not any(page.mark):
        return [False] * n
    size, linked, points, told = [0] * n, [0] * n, [0.0] * n, [0.0] * n
    for node, text, links in page.blocks:
        size[node] += len(text)
        linked[node] += links
        points[node] += _points(text, links)
        told[node] += points[node] if page.tag[node] == "p" else 0.0
    under = [False] * n  # in a strong element
    rest = 0.0
    for i in range(n):
        under[i] = i > 0 and (under[parent[i]] or page.mark[i] >= STRONG)
        rest += 0.0 if under[i] else points[i]
    for i in range(n - 1, 0, -1):
        for x in (size, linked, points, told):
            x[parent[i]] += x[i]
    if any(article[i] == i and size[i] and not under[i] for i in range(1, n)):
        rest = float("inf")
    out = [False] * n
    for i in range(1, n):
        mark, links = page.mark[i], linked[i] / size[i] if size[i] else 1.0
        if out[parent[i]]:
            out[i] = True
        elif mark == WEAK:
            out[i] = links > (1 / 2 if article[i] >= 0 else 1 / 3)
        elif mark and article[i] >= 0:
            out[i] = mark == READERS or (2 * size[i] <= size[article[i]] and (mark == SURE or told[i] == 0 or links > 1 / 2))
        elif mark:
            out[i] = rest > 0 if mark == READERS else rest >= 0.1 * points[i]
    return out


def main_text(html: str) -> str:
    """The main text of a page: blocks in page order, joined by newlines."""
    page = _Page(html)
    parent, n = page.parent, len(page.parent)
    article = [-1] * n
    for i in range(1, n):
        article[i] = article[parent[i]] if article[parent[i]] >= 0 else i if page.body[i] else -1
    out = _dropped(page, article)
    blocks = [b for b in page.blocks if not out[b[0]]]
    size, linked, points = [0] * n, [0] * n, [0.0] * n
    for node, text, links in blocks:
        size[node] += len(text)
        linked[node] += links
        own = _points(text, links)
        node = parent[node] if page.tag[node] == IN_LINE else node
        at, level = node if page.tag[node] in ("div", "article", "section", "main", "body", "td", "") else parent[node], 0
        while own and at >= 0 and level < 5:
            points[at] += own / (1 if level == 0 else 2 if level == 1 else 3 * level)
            at, level = parent[at], level + 1
    last = list(range(n))  # the last node of each subtree
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
        linked[parent[i]] += linked[i]
        last[parent[i]] = max(last[parent[i]], last[i])
    score = [points[i] * (1 - linked[i] / size[i]) if size[i] else 0.0 for i in range(n)]
    best = max(range(n), key=lambda i: (score[i], -i))
    marked = [i for i in range(1, n) if article[i] == i and size[i]]
    if score[best] <= 0:
        best = max(marked, key=lambda i: size[i]) if marked else 0
    # a container that spreads its paragraphs over wrappers of its own scores nearly as much as the best of them
    while best > 0 and score[best] > 0 and parent[best] > 0 and page.tag[parent[best]] not in ("html", "body") and score[parent[best]] >= 0.9 * score[best]:
        best = parent[best]
    if article[best] >= 0:
        best = article[best]
    else:
        held = [i for i in marked if best < i <= last[best] and 2 * size[i] >= size[best]]
        if held:
            best = max(held, key=lambda i: size[i])
    keep = [False] * n
    keep[best] = True
    peak = list(score)  # the highest score in each subtree: an element that is marked as the article needn't be a container of paragraphs itself
    for i in range(n - 1, 0, -1):
        peak[parent[i]] = max(peak[parent[i]], peak[i])
    for i in range(1, n) if best > 0 else ():
        if parent[i] == parent[best] and i != best and size[i]:
            density = linked[i] / size[i]
            heading = page.tag[i] in ("h1", "h2")
            if page.body[best]:  # beside an element marked as the article only others marked so belong to it
                keep[i] = page.body[i] and page.body_mark[i] < SURE and peak[i] >= 0.2 * peak[best] > 0 and density < 0.5
            else:
                keep[i] = (score[i] >= 0.2 * score[best] > 0 and density < 0.5) or (page.tag[i] == "p" and size[i] > 80 and density < 0.25) or (heading and density < 0.5)
    for i in range(1, n):
        keep[i] |= keep[parent[i]]
    return "\n".join(text for node, text, _ in blocks if keep[node])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages without text, have an empty text; ids and urls may be null or repeat, and
    repeated rows come back as often; other columns are ignored, whatever their names; an empty table gives no rows. A very
    long page is held by one task, in memory of a few times its size and time linear in it. Of containers with equal
    scores the first in the page is the best.
    """
    d = pick(pages, "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) if h else "" for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = d.schema["page_id"].dataType.simpleString()
    return d.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op9_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
