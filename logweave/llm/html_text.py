"""Main text of web pages by composite text density.

A page is read into a DOM by the rules of HTML for tags, attributes, comments and elements that close by themselves; scripts, styles and other raw text are skipped.
Every node gets its composite density: characters per tag, adjusted for link text, after Sun, Song and Liao (2011),

    density = C/T * log(C/LC * T/LT) to the base ln(C/N * LC + LCb/Cb * C + e)

with C characters, T tags, LC link characters, LT link tags, N characters outside links, and b for the body; 0 counts as 1 in
divisions. On a page without links the base's logarithm is 0; there the factor is log(C * T) + 1. The density sum of
a node is the sum over its children, text directly in it (outside links) counting as one child of as many characters per tag. The subtree of the largest sum is the main
content; the least density on the path from the body to it is the threshold, and what lies outside it but reaches the threshold is
content too, by its own largest sum.

Two rules stand beside the density. What a page itself names as no article text is cut before: by element (nav, footer, aside, the page's header, controls), by role, by
hidden or aria-hidden, or by a class or id whose words say so (menu, sidebar, cookie notice, advert, comments; `article-header`, `no-ad` or `has-sidebar` do not). What is only named so, but for readers' comments, and a form
are no boilerplate where they are the page: with paragraphs or an article, and more than half of the text. And short blocks are not lost: where the chosen subtree lies in an <article> or <main>
element, all of that is content, and so are headings and paragraphs beside the path to the subtree of which less than half is links.

Blocks are in page order, joined by an empty line; white space inside a block is one space. Tables, lists and headings are blocks;
<br> is white space.

Cases: null or empty html gives an empty text. Markup that breaks off, is never closed or is closed in the wrong order is read as far as it goes.
A page without a body, or plain text, is its own body. Very long and deep pages are read without recursion. Null ids and urls, repeated rows and
extra columns pass; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.shared import slices

# Fixed values of HTML: elements without content, of raw text, and of blocks; what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes select object video audio canvas annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())

# Elements and roles that are never article text, and controls that are none in a form.
DROPPED = frozenset("nav footer aside button head dialog menu input fieldset".split()) | RAW
CONTROLS = frozenset("label legend output meter progress datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
# Words of classes and ids. A name goes if one of the first begins or ends it, or if all its words are marks or places. Words of state say nothing about what is inside.
STRONG = frozenset(
    "sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar advert adverts advertisement advertising adbox sponsor sponsored cookie cookies consent gdpr popup modal newsletter subscribe subscription sharing commentlist comments disqus responses replies pagination pager toolbar".split()
)
WEAK = frozenset("ad ads adv promo promotion side header notice notices notification banner alert overlay signup login share social related recommended widget comment reply skip hidden".split())
PLACES = frozenset("site page left right top bottom box block list area section wrapper wrap container bar item items link links global primary secondary inner outer text message icons buttons panel form unit slot".split())
KEPT = frozenset("article main".split())
STATES = frozenset("no not non without has have with open opened opens active enabled layout".split())
MANY = frozenset("comments commentlist disqus responses replies".split())
REMARKS = MANY | frozenset("comment reply".split())
ABOUT = frozenset("article main body content meta author thread post entry user reader readers respond count header footer".split())
SOFT, REMARK = 1, 2

COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>", re.S)
OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
SHUT = re.compile(r"[\s/]*>")
ASKED = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
PARTS = re.compile(r"[^a-z0-9]+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "up", "block", "kids", "off", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "picked", "soft")

    def __init__(self, name: str, up: Node | None, kind: int = 0):
        self.name, self.up, self.off, self.soft = name, up, kind == REMARK, kind == SOFT
        self.block: Node | None = self if name in BLOCK or up is None else up.block  # the nearest block, itself included
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.best = self
        self.picked = False


def named(value: str, remarks: bool) -> int:
    """What a class or id attribute names: REMARK for readers' comments, SOFT for something else that is no article text, 0 for neither; with `remarks`, only comments are looked for."""
    found = 0
    for name in value.lower().split():
        words = [w for w in PARTS.split(name) if w]
        if not words or not STATES.isdisjoint(words):
            continue
        ends = {words[0], words[-1]}
        others = [w for w in words if w not in REMARKS]
        if not ends.isdisjoint(MANY) or (len(others) < len(words) and all(w in PLACES or w in ABOUT for w in others)):
            return REMARK
        if remarks or (not KEPT.isdisjoint(words) and ends.isdisjoint(STRONG)):
            continue
        if not ends.isdisjoint(STRONG) or (all(w in WEAK or w in PLACES for w in words) and not WEAK.isdisjoint(words)):
            found = SOFT
    return found


def boilerplate(name: str, attributes: dict[str, str], node: Node, in_form: bool) -> int:
    """REMARK if an opening tag begins something that is never article text, SOFT if it only is named so, else 0."""
    if name in DROPPED or (in_form and name in CONTROLS):
        return REMARK
    if name == "header":  # an article's own header may hold its headings
        while node is not None and node.name not in ("article", "main"):
            node = node.up
        return 0 if node is not None else REMARK
    if not attributes or name in ("html", "body"):
        return 0
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").strip().lower() in ROLES:
        return REMARK
    remarks = name in ("article", "main")
    return max((named(attributes[k], remarks) for k in ("class", "id") if k in attributes), default=0)


def tag_at(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes that count of the tag whose name ends at `at`, and where the tag ends; -1: it never does."""
    found: dict[str, str] = {}
    while True:
        end = SHUT.match(page, at)
        if end:
            return found, end.end()
        m = ATTRIBUTE.match(page, at)
        if m is None:
            return found, -1
        name = m[1].lower()
        if name in ASKED and name not in found:
            found[name] = m[2] or m[3] or m[4] or ""
        at = m.end()


class Tree:
    """Builds the DOM. How many elements of a name are open, in all and inline within each block, is counted, so that an end tag without its element costs nothing."""

    def __init__(self) -> None:
        self.root = self.node = Node("html", None)
        self.open: Counter = Counter()
        self.inline: list[Counter] = [Counter()]  # by open block

    def enter(self, node: Node) -> None:
        self.node = node
        self.open[node.name] += 1
        if node.name in BLOCK:
            self.inline.append(Counter())
        else:
            self.inline[-1][node.name] += 1

    def leave(self, above: Node) -> None:
        """Close everything up to and with `above`."""
        while True:
            node, self.node = self.node, self.node.up
            self.open[node.name] -= 1
            if node.name in BLOCK:
                self.inline.pop()
            else:
                self.inline[-1][node.name] -= 1
            if node is above:
                return

    def end(self, name: str) -> None:
        """An end tag closes the nearest such element; one of an inline element does not close blocks."""
        if not (self.open[name] if name in BLOCK else self.inline[-1][name]):
            return
        above = self.node
        while above.name != name:
            above = above.up
        self.leave(above)

    def begin(self, name: str) -> None:
        """What a start tag closes: an open paragraph before a block, and the elements that it cannot be in."""
        if name in BLOCK and self.node.block.name == "p":
            self.leave(self.node.block)
        if any(self.open[k] for k in CLOSES.get(name, ())):
            above, found = self.node, None
            while above.up is not None and above.name not in SCOPE[name]:
                if above.name in CLOSES[name]:
                    found = above
                above = above.up
            if found is not None:
                self.leave(found)


def parse(page: str) -> Node:
    """The page's DOM; boilerplate nodes are marked off."""
    tree, at, size = Tree(), 0, len(page)
    endless: set[str] = set()  # raw elements of which no end follows any more
    body = False
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            tree.node.kids.append(page[at:])
            break
        if mark > at:
            tree.node.kids.append(page[at:mark])
        m = OPEN.match(page, mark)
        if m is None:
            skipped = COMMENT.match(page, mark)
            if skipped is None:  # a bare <
                tree.node.kids.append("<")
            at = skipped.end() if skipped else mark + 1
            continue
        name = m[2].lower()
        attributes, at = tag_at(page, m.end())
        if at < 0:  # broken off inside a tag
            break
        if m[1]:
            tree.end(name)
            continue
        if name in RAW:
            end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template"):
                break
            else:
                endless.add(name)  # never closed: only the tag goes
            continue
        if name == "html" or (name == "body" and body):
            continue
        body |= name == "body"
        tree.begin(name)
        if name == "br":
            tree.node.kids.append(" ")
            continue
        made = Node(name, tree.node, boilerplate(name, attributes, tree.node, tree.open["form"] > 0))
        tree.node.kids.append(made)
        if name == "head":
            end = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
            if end:
                at = end.end() if end[0][1] == "/" else end.start()
        elif name not in VOID:
            tree.enter(made)
    return tree.root


def cut_named(body: Node) -> None:
    """Mark off forms and what is only named as boilerplate, but for those that are the page: with paragraphs or an article, and more than half of the characters (links' do not count for names)."""
    doubtful, size, plain, prose = [], {}, {}, set()
    order, stack = [], [body]
    while stack:
        node = stack.pop()
        order.append(node)
        if node.name == "form" or node.soft:
            doubtful.append(node)
        stack.extend(k for k in node.kids if isinstance(k, Node) and not k.off)
    if not doubtful:
        return
    for node in reversed(order):
        size[id(node)] = sum(len(k.strip()) if isinstance(k, str) else size.get(id(k), 0) for k in node.kids)
        plain[id(node)] = 0 if node.name == "a" else sum(len(k.strip()) if isinstance(k, str) else plain.get(id(k), 0) for k in node.kids)
        if node.name in ("p", "article", "main") or any(id(k) in prose for k in node.kids):
            prose.add(id(node))
    for node in doubtful:
        count = plain if node.soft else size
        node.off = id(node) not in prose or 2 * count[id(node)] <= count[id(body)]


def measure(body: Node) -> list[Node]:
    """Count, and set densities and sums, from the leaves up; gives all nodes that are not off, parents first."""
    order, stack = [], [(body, body.name == "a")]
    links: list[bool] = []
    while stack:
        node, link = stack.pop()
        order.append(node)
        links.append(link)
        for k in node.kids:
            if isinstance(k, Node) and not k.off:
                stack.append((k, link or k.name == "a"))
    own: list[int] = []
    for node, link in zip(reversed(order), reversed(links), strict=True):
        direct = sum(len(k) - k.count(" ") for k in map(str.strip, (k for k in node.kids if isinstance(k, str))))
        node.chars += direct
        if link:
            node.link_chars += direct
            node.link_tags += 1
        own.append(0 if link else direct)
        up = node.up
        if up is not None and node is not body:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    share = body.link_chars / max(1, body.chars)
    for node, direct in zip(reversed(order), own, strict=True):
        node.density = density(node, share)
        node.total += direct
        best = node
        for k in node.kids:
            if isinstance(k, Node) and not k.off and k.best.total > best.total:
                best = k.best
        node.best = best
        if node.up is not None and node is not body:
            node.up.total += node.density
    return order


def density(node: Node, share: float) -> float:
    c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
    return c / t * max(0.0, math.log(c / max(1, lc) * t / lt)) / math.log(base) if base > 1 + 1e-9 else c / t * max(0.0, math.log(c / max(1, lc) * t / lt) + 1)


def choose(body: Node) -> None:
    """Mark the content."""
    target = body.best
    path, node = [], target
    while node is not None:
        path.append(node)
        if node is body:
            break
        node = node.up
    least = min(n.density for n in path)
    home = next((n for n in path if n.name in ("article", "main")), target)
    home.picked = True
    inside = set(map(id, path))
    stack = [body]
    while stack:
        for k in stack.pop().kids:
            if not isinstance(k, Node) or k.off or k.picked:
                continue
            if id(k) in inside:
                stack.append(k)
            elif k.name in TEXTS and 2 * k.link_chars < k.chars:
                k.picked = True
            elif k.density >= least and k.chars:
                found = k.best if k.best.total > 0 else k
                above = found
                while above is not k and above.name not in ("article", "main"):
                    above = above.up
                (above if above.name in ("article", "main") else found).picked = True


def blocks(body: Node) -> list[str]:
    """The blocks of the marked subtrees, in page order."""
    out: list[str] = []
    held: list[str] = []

    def cut() -> None:
        text = SPACE.sub(" ", "".join(held)).strip()
        if text:
            out.append(text)
        held.clear()

    stack: list[tuple[Node | str | None, bool, bool]] = [(body, False, False)]
    while stack:
        item, taken, headings = stack.pop()
        if item is None:
            cut()
        elif isinstance(item, str):
            if taken and not headings:
                held.append(html.unescape(item))
        elif not item.off:
            taken |= item.picked
            if item.name == "header":
                headings = True
            elif item.name in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"):
                headings = False
            if item.name in BLOCK:
                cut()
                stack.append((None, False, False))
            stack.extend((k, taken, headings) for k in reversed(item.kids))
    cut()
    return out


def main_text(page: str | None) -> str:
    """The page's main text: blocks joined by an empty line."""
    if not page:
        return ""
    root = parse(page)
    body = next((k for k in root.kids if isinstance(k, Node) and k.name == "body"), root)
    cut_named(body)
    measure(body)
    choose(body)
    return "\n\n".join(blocks(body))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 8 << 20, 2048):
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    kinds = dict(chosen.dtypes)
    return chosen.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
