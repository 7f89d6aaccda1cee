"""Main text of HTML pages by tree scoring.

The page becomes a tree; each paragraph gives points for its length and commas to its ancestors, halved at
each step up; a container's points are discounted by its link density; the best container is kept together
with its siblings, and those of the containers around it, that are neither side matters by name nor mostly links.

A name (class, id or role) that sounds like a side matter only lowers the points below it. The subtree goes if it also
has little prose or many links, and holds no article, no main and not the best container. A name that means one thing
(reader comments, adverts, notices) takes its subtree away first, however long it is, unless the page's only article or
main is inside or nothing else on the page is prose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .common import table

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript", "template", "head", "nav", "footer", "aside", "form", "button", "select", "textarea", "iframe", "object", "svg", "canvas", "dialog", "menu"}
BLOCK = {"address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
UNLIKELY = re.compile(r"ads?|advert(?:s|ising|isements?)?|banners?|breadcrumbs?|comments?|cookies?|consent|disqus|footer|menu|nav(?:bar|igation|s)?|newsletter|notice|pagination|popup|promo(?:s|ted|tions?)?|related|share|sharing|sidebar|social|sponsor(?:s|ed)?|subscribe|toolbar|widgets?", re.I)
#: Words that say nothing beside an unlikely one: page-footer, related-links.
NEUTRAL = re.compile(r"site|page|main|top|bottom|left|right|primary|secondary|global|box|bar|list|links?|posts?|articles?|wrapper|wrap|container|block|section|area|inner|outer|items?|buttons?|icons?|unit|slot|\d+", re.I)
#: Words whose subtrees are never part of an article, and words beside them that change nothing.
FOREIGN = re.compile(r"ads?|advert(?:s|ising|isements?)?|comments?|cookies?|consent|disqus|newsletter|notices?|sponsor(?:s|ed)?", re.I)
OF_FOREIGN = re.compile(r"user|readers?|visitors?|thread|body|content|text|meta|author|reply|replies|respond|responses?|banner|sense|message|signup|form|view|count|header|title", re.I)
FAINT, LITTLE_PROSE, MANY_LINKS = 0.25, 80, 0.5
NEVER_UNLIKELY = {"html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "code", "blockquote", "td", "th"}


def unlikely(marks: str) -> bool:
    """Whether one of the names, taken whole, has unlikely words and else neutral ones only."""
    for name in marks.split():
        parts = [w for w in re.split("[-_]+", name) if w]
        said = [w for w in parts if not NEUTRAL.fullmatch(w)]
        if said and all(UNLIKELY.fullmatch(w) for w in said):
            return True
    return False


def foreign(marks: str) -> bool:
    """Whether one of the names, taken whole, has words that mean comments, adverts or notices and else only what goes with them."""
    for name in marks.split():
        parts = [w for w in re.split("[-_]+", name) if w]
        said = [w for w in parts if not NEUTRAL.fullmatch(w) and not OF_FOREIGN.fullmatch(w)]
        if said and all(FOREIGN.fullmatch(w) for w in said):
            return True
    return False


class Node:
    __slots__ = ("tag", "parent", "items", "dropped", "points", "named", "faint", "foreign", "code")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, named: bool = False, foreign: bool = False):
        self.code = tag in ("pre", "code") or parent is not None and parent.code  # names there colour the code
        named, self.foreign = named and not self.code, foreign and not self.code
        self.tag, self.parent, self.items, self.dropped, self.points = tag, parent, [], dropped, 0.0
        self.named, self.faint = named, named or parent is not None and parent.faint


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("html", None)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            while self.at.tag in ("head", "title"):
                self.at = self.at.parent
        if tag in BLOCK:
            self.end_open({"p"}, {"td", "th", "button"} | (BLOCK - {"p"}))
        if tag in CLOSED_BY:
            self.end_open(CLOSED_BY[tag], SCOPE[tag])
        marks = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs)
        node = Node(tag, self.at, tag in DROPPED or hidden, tag not in NEVER_UNLIKELY and unlikely(marks), tag in BLOCK - {"html", "body", "main"} and foreign(marks))
        if tag == "header":  # a page's header goes, an article's own stays
            up = self.at
            while up and up.tag not in ("article", "main"):
                up = up.parent
            node.dropped |= up is None
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def end_open(self, tags: set, stop: set):
        up = self.at
        while up.parent and up.tag not in tags and up.tag not in stop:
            up = up.parent
        if up.parent and up.tag in tags:
            self.at = up.parent

    def handle_endtag(self, tag):
        up = self.at
        while up.parent and up.tag != tag:
            if tag not in BLOCK and up.tag in BLOCK:
                return  # inline tags don't close blocks
            up = up.parent
        if up.parent:
            self.at = up.parent

    def handle_data(self, data):
        self.at.items.append(data)


def walk(top: Node):
    """Opening and closing of nodes, and strings, in page order, without recursion; dropped subtrees are left out."""
    stack = [("open", top)]
    while stack:
        what, x = stack.pop()
        yield what, x
        if what == "open" and x.tag not in VOID:
            stack.append(("close", x))
            for y in reversed(x.items):
                if isinstance(y, str):
                    stack.append(("text", y))
                elif not y.dropped:
                    stack.append(("open", y))


def blocks(nodes: list[Node]) -> list[str]:
    out, part = [], []

    def end():
        if line := " ".join("".join(part).split()):
            out.append(line)
        part.clear()

    for node in nodes:
        for what, x in walk(node):
            if what == "text":
                part.append(x)
            elif x.tag in BLOCK:
                end()
            elif x.tag == "br":
                part.append(" ")
        end()
    return out


def measure(top: Node) -> dict[int, tuple[int, int, int]]:
    """Characters, characters in links and commas below each node."""
    found, stack, links = {}, [], 0
    for what, x in walk(top):
        if what == "text":
            n = len(x.strip())
            if stack:
                stack[-1][0] += n
                stack[-1][1] += n * bool(links)
                stack[-1][2] += x.count(",")
        elif what == "open":
            if x.tag not in VOID:
                stack.append([0, 0, 0])
                links += x.tag == "a"
        else:
            mine = found[id(x)] = tuple(stack.pop())
            links -= x.tag == "a"
            if stack:
                stack[-1] = [a + b for a, b in zip(stack[-1], mine)]
    return found


def scored(top: Node):
    """The sizes below each node and the nodes, which get their points."""
    sizes, nodes = measure(top), [x for what, x in walk(top) if what == "open" and x.tag not in VOID]
    for x in nodes:
        x.points = 0.0
    for x in nodes:
        if x.tag in ("p", "pre", "td", "blockquote") or x.tag in ("div", "section", "article", "main", "body") and any(isinstance(y, str) and y.strip() for y in x.items):
            n, linked, commas = sizes[id(x)]
            if n < 2:
                continue
            points = (1 + commas + min(n / 100, 3)) * (1 - linked / n)
            up, share = (x.parent if x.tag in ("p", "pre", "td", "blockquote") else x), 1.0
            while up and share > 0.1:
                up.points += points * share
                up, share = up.parent, share / 2
    return sizes, nodes


def weak(nodes: list[Node], sizes: dict, best: Node) -> list[Node]:
    """The nodes of unlikely name with little prose or many links that hold neither article, main nor best."""
    holds = set()
    for x in nodes:
        if x is best or x.tag in ("article", "main"):
            while x and id(x) not in holds:
                holds.add(id(x))
                x = x.parent
    return [x for x in nodes if x.named and id(x) not in holds and (sizes[id(x)][0] - sizes[id(x)][1] < LITTLE_PROSE or sizes[id(x)][1] > MANY_LINKS * sizes[id(x)][0])]


def without_foreign(top: Node) -> None:
    """Drops the outermost nodes of foreign names: all of them where an article or main stands outside, else those that hold
    none. They stay if what is left has under LITTLE_PROSE characters outside links and they have more."""
    outside, outer, inner = False, [], set()
    for what, x in walk(top):
        if what != "open":
            continue
        up = x.parent
        if up is not None and id(up) in inner:
            inner.add(id(x))
        elif x.foreign:
            inner.add(id(x))
            outer.append(x)
        elif x.tag in ("article", "main"):
            outside = True
    gone = outer if outside else [x for x in outer if not any(y.tag in ("article", "main") for what, y in walk(x) if what == "open")]
    if not gone:
        return
    prose = lambda x: (n := measure(x)[id(x)])[0] - n[1]
    held = sum(prose(x) for x in gone)
    for x in gone:
        x.dropped = True
    if not outside and prose(top) < min(LITTLE_PROSE, held):
        for x in gone:
            x.dropped = False


def main_text(html: str | None) -> str:
    """The main text: one line for each block, white space inside it made single spaces."""
    tree, html = Tree(), html or ""
    if (cut := html.rfind("<!--")) > html.rfind("-->") and cut > html.lower().rfind("<script"):
        html = html[:cut]  # a comment without end goes to the end of the page
    tree.feed(html)
    HTMLParser.close(tree)
    without_foreign(tree.top)
    sizes, nodes = scored(tree.top)
    density = lambda x: sizes[id(x)][1] / max(1, sizes[id(x)][0])
    score = lambda x: x.points * (1 - density(x)) * (1.5 if x.tag in ("article", "main") else 1) * (FAINT if x.faint else 1)
    best = max(nodes, key=score)
    if any(x.named for x in nodes) and (gone := weak(nodes, sizes, best)):
        for x in gone:
            x.dropped = True
        if not blocks([tree.top]):  # all the text there is
            for x in gone:
                x.dropped = False
        sizes, nodes = scored(tree.top)
        best = max(nodes, key=score)
    if not best.points:
        return "\n".join(blocks([tree.top]))
    while best.parent and best.parent.tag in ("article", "main"):
        best = best.parent
    if best.tag in ("article", "main"):
        whole = [x for x in nodes if x.tag == best.tag and (x is best or not x.faint and not inside(x, best.tag) and density(x) <= MANY_LINKS)]
        return "\n".join(blocks(whole))
    # from the best container up to the page: what stands beside it stays unless it is named a side matter or is mostly links
    way, up = [], best
    while up:
        way.append(up)
        up = up.parent
    if best.tag in ("body", "html"):  # nothing stands beside it: its own parts are looked at, but for paragraphs
        way.insert(0, Node("p", None))
    beside = [y for inner, outer in zip(way, way[1:]) for y in outer.items if isinstance(y, Node) and y is not inner and not y.dropped]
    gone = [y for y in beside if y.tag not in VOID and y.tag != "p" and (y.faint or density(y) > MANY_LINKS)]
    for y in gone:
        y.dropped = True
    if not (out := blocks([tree.top])):  # all the text there is
        for y in gone:
            y.dropped = False
        out = blocks([tree.top])
    return "\n".join(out)


def inside(x: Node, tag: str) -> bool:
    up = x.parent
    while up and up.tag != tag:
        up = up.parent
    return up is not None


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    Defined results: a null or empty html, and one without text, gives the empty text and 0; repeated rows each give
    a row; nulls in page_id or url are carried; further columns are ignored. Broken markup never fails."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            b["text"] = [main_text(h).encode("utf-8", "replace").decode() for h in b.pop("html")]
            b["n_chars"] = b["text"].str.len()
            yield b

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op8_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
