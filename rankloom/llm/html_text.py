"""Main text of HTML pages by composite text density.

A page becomes a small DOM. For every node the composite density is its characters per tag, scaled
down by the share of its characters that links hold; a node's density sum adds up its children's
densities. The node with the largest density sum is the densest subtree. The least density on the
path from it up to the body is the threshold: every subtree that reaches it gives its own densest
node, and the smallest subtree that holds all of those is the main text.

What is never main text by its element, role or class (scripts, styles, menus, page headers and
footers, sidebars, notices, adverts, forms, reader comments) takes no part. A class or id is only a
hint: :func:`release` takes back what it dropped where that holds the article or most of the text. Blocks keep page order;
white space inside a block, line breaks included, becomes one space; character references are
decoded as HTML5 says. Outside of article and main, lists, tables, divs and sections of which links
hold over 90 % are menus. Nothing else is dropped and no text is cut.

Defined results: a null or empty page has the empty text; pages without a body element are read as if
they had one; elements nested deeper than ``DEPTH`` stand beside each other, so time is linear in the
page; a quote that is never closed is a letter of its attribute; repeated rows are read one by one; extra columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, with raw text, that make blocks, and what ends an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption thead tbody tfoot tr td th ul".split())
CLOSES_P = BLOCK - frozenset("body html legend option optgroup caption thead tbody tfoot tr td th".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
SCOPE = frozenset("article aside body button div dialog fieldset figure footer form header html main nav object section table td th caption ul ol dl blockquote".split())
DROP = frozenset("script style noscript template iframe object embed svg math canvas audio video map head title nav footer aside form button select textarea input label fieldset menu dialog search datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
#: Words of class and id values that name what isn't main text.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "footer sidebar sidebars aside widget widgets related recommended comment comments commentlist respond disqus reply replies "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "pagination pager skip toolbar masthead".split()
)
TEASERS = frozenset("ad ads advert advertisement sponsored promo related recommended comment comments reply replies teaser".split())
KEEP_INSIDE = frozenset(("article", "main"))
_OWN = ("role", "hidden", "aria-hidden", "class", "id")
#: Attributes as HTML5 reads them: a quote opens a value only after an equals sign, and only if it is closed; elsewhere it is a letter.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]++)"""
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:=\s*+" + _VALUE + r"?|[^>=]++)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(" + _VALUE + "))?")
_TELLS = re.compile("class|id|role|hidden", re.I)
#: HTML has no self-closing elements but void ones; a slash at the end of these says nothing.
_STAYS_OPEN = BLOCK | {"a", "b", "i", "span", "em", "strong"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup a".split())
_NAME = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


#: Elements deeper than this stay empty and what follows stands beside them, as in browsers; it bounds every climb.
DEPTH = 512


class Node:
    __slots__ = ("tag", "parent", "kids", "depth", "inside", "best", "drop", "chars", "tags", "link_chars", "link_tags", "density", "sum", "named", "words")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.kids, self.drop = tag, parent, [], False
        self.depth = parent.depth + 1 if parent else 0
        self.inside = parent is not None and (parent.inside or parent.tag in KEEP_INSIDE)  # an article or main
        self.best = self  # the densest node of the subtree
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.named = ""  # dropped by a class or id only: "part" of the page's frame, or "teaser"
        self.words: frozenset[str] = frozenset()  # of its class and id


def _dropped(tag: str, attributes: str, node: Node) -> bool:
    if tag in DROP:
        return True
    inside = node.inside
    if tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "main") or not _TELLS.search(attributes):
        return False
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(attributes):
        found.setdefault(name.lower(), value.strip("\"'"))  # the first of a name counts
    for name in [n for n in _OWN if n in found]:  # what isn't only a hint first
        value = found[name]
        if name == "role":
            if value.lower() in ROLES:
                return True
        elif name in ("hidden", "aria-hidden"):
            if name == "hidden" or value.lower() == "true":
                return True
        else:
            words = set(_NAME.findall(_CAMEL.sub(" ", value).lower()))
            node.words |= {w for w in words if w.isalpha()}
            if TEASERS & words and (tag == "article" or NAMES & words):  # a reader's comment or a teaser may be an article
                node.named = "teaser"
            elif tag != "article" and (NAMES & words or (not inside and "header" in words)):
                node.named = node.named or "part"
    return bool(node.named)


def parse(page: str) -> Node:
    """The DOM, its text nodes as strings; lenient like a browser about ends that are missing."""
    root = Node("html", None)
    body = Node("body", root)
    root.kids.append(body)
    at, here, n = 0, body, len(page)

    def text(t: str) -> None:
        if t:
            here.kids.append(_html.unescape(t) if "&" in t else t)

    def close_to(tags, stop) -> None:
        nonlocal here
        up = here
        while up is not body and up.tag not in stop:
            if up.tag in tags:
                here = up.parent
                if up.tag == "tr" or "tr" not in tags:
                    return
            up = up.parent

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        end, tag = m[1], m[2]
        if end:
            end = end.lower()
            if end in ("html", "body"):
                continue
            up = here
            while up is not body and up.tag != end:
                if up.tag in SCOPE and end not in SCOPE:
                    up = body  # an end inside a block doesn't close what stands outside of it
                    break
                up = up.parent
            if up is not body:
                here = up.parent
            elif end == "p":
                here.kids.append(Node("p", here))
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            up = here
            while up is not body and up.tag not in SCOPE and up.tag != "p":
                up = up.parent
            if up.tag == "p":
                here = up.parent
        if tag in ENDS:
            close_to(*ENDS[tag])
        node = Node(tag, here)
        node.drop = _dropped(tag, m[3], node)
        here.kids.append(node)
        if tag in RAW:
            found = _RAW_END[tag].search(page, at)
            inner = page[at : found.start()] if found else page[at:]
            if not node.drop:
                node.kids.append(_html.unescape(inner))
            at = found.end() if found else n
        elif tag not in VOID and node.depth < DEPTH and (not m[3].rstrip().endswith("/") or tag in _STAYS_OPEN):
            here = node
    return body


def _walk(body: Node) -> list[Node]:
    """Nodes that take part, parents first."""
    out, todo = [], [body]
    while todo:
        node = todo.pop()
        if node.drop:
            continue
        out.append(node)
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return out


def measure(body: Node) -> list[Node]:
    """Fill in characters, tags, densities, density sums and densest nodes; the nodes, parents first."""
    nodes = _walk(body)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.sum = 0.0
        for k in node.kids:
            if isinstance(k, str):
                node.chars += len(_SPACE.sub("", k))
            elif not k.drop:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags
                node.sum += k.density
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        plain = node.chars - node.link_chars
        node.density = node.chars / max(1, node.tags) * (plain / node.chars if node.chars else 0.0)
        node.best = node
        for k in node.kids:  # of equals the first of the page
            if not isinstance(k, str) and not k.drop and k.chars and (k.best.sum, k.best.density) > (node.best.sum, node.best.density):
                node.best = k.best
    return nodes


def _strength(top: Node) -> tuple[float, int]:
    """The largest density sum or density in a subtree, and its characters outside links."""
    best = max((max(n.sum, n.density) for n in measure(top)), default=0.0)
    return best, top.chars - top.link_chars


def _prose(top: Node) -> bool:
    """Whether a subtree has text outside headings and links."""
    todo = [top]
    while todo:
        node = todo.pop()
        for k in node.kids:
            if isinstance(k, str):
                if not k.isspace():
                    return True
            elif not k.drop and k.tag not in _HEADINGS:
                todo.append(k)
    return False


def _outermost(body: Node) -> list[Node]:
    """Nodes that a class or id drops, none inside another dropped one."""
    out, todo = [], [body]
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, str):
                continue
            if not k.drop:
                todo.append(k)
            elif k.named:
                out.append(k)
    return out


def _holds(top: Node, tag: str) -> bool:
    """Whether an element lies in a subtree, not below what its own element or role drops."""
    todo = [top]
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, str) or (k.drop and not k.named):
                continue
            if k.tag == tag and not k.drop:
                return True
            todo.append(k)
    return False


def _opened(top: Node) -> tuple[float, int]:
    """The strength of a subtree with all that only names drop inside it; for a part without its teasers."""
    names = ("part",) if top.named == "part" else ("part", "teaser")
    held, todo = [], [top]
    while todo:
        node = todo.pop()
        if node.named in names and node.drop:
            node.drop = False
            held.append(node)
        if not node.drop:
            todo += [k for k in node.kids if isinstance(k, Node)]
    found = _strength(top)
    for node in held:
        node.drop = True
    return found


def release(body: Node) -> None:
    """Take back subtrees that a class or id dropped although they hold the main text, the strongest first.

    One that holds a main element, or an article where no other article or main has text, is the
    text's wrapper. Where an article or main has text, nothing outside of it comes back by density
    alone. Else a part of the frame is main text if it is denser than all the rest of its article, main
    or body and holds more characters; readers' comments, adverts and teasers, which often are longer
    than the article, only if the rest has nothing but headings and links. What has the same parent,
    element and names comes back together.
    """
    while True:
        named = _outermost(body)
        if not named:
            return
        wraps = [n for n in named if _holds(n, "main")]
        for n in wraps:
            n.drop = False
        if wraps:
            continue
        live = any(n.tag in KEEP_INSIDE and _prose(n) for n in _walk(body))
        best, chosen, rests = (), None, {}
        for n in named:
            article = _holds(n, "article")
            scope = n.parent
            while scope is not body and scope.tag not in KEEP_INSIDE:
                scope = scope.parent
            if live and scope is body and not article:
                continue
            value, plain = _opened(n)
            if not plain:
                continue
            if not (article and not live):
                if id(scope) not in rests:
                    rests[id(scope)] = (*_strength(scope), _prose(scope))
                rest, other, prose = rests[id(scope)]
                if n.named == "teaser" and prose or n.named == "part" and not (value > rest and plain > other):
                    continue
            rank = (n.named == "part", value)
            if chosen is None or rank > best:
                best, chosen = rank, n
        if chosen is None:
            return
        for n in named:  # with its peers: comments of a page of comments
            if n is chosen or (n.parent is chosen.parent and n.tag == chosen.tag and n.words == chosen.words):
                n.drop = False


def main_node(body: Node) -> Node | None:
    """The smallest subtree with all densest nodes over the path threshold; None where there is no text."""
    release(body)
    measure(body)
    if not body.chars:
        return None
    best = body.best
    if best.sum == 0:
        return body
    threshold, up = best.density, best
    while up is not None:
        threshold = min(threshold, up.density) if up.tag != "html" else threshold
        up = up.parent
    found, todo = best, [body]
    while todo:  # the densest node of a subtree, then of every subtree beside the way to it
        node = todo.pop()
        up = node.best
        one, other = found, up
        while one is not other:  # the smallest subtree with both
            if one.depth >= other.depth:
                one = one.parent
            else:
                other = other.parent
        found = one
        while up is not node:
            way, up = up, up.parent
            todo += [k for k in up.kids if k is not way and isinstance(k, Node) and not k.drop and k.chars and k.density >= threshold and k.link_chars * 2 <= k.chars]
    # Up to the enclosing article or main, where there is one: its headings and short paragraphs belong to it.
    up = found
    while up is not None:
        if up.tag in KEEP_INSIDE:
            return up
        up = up.parent
    while found.tag not in BLOCK or found.tag in ("p", "li", "td", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "pre"):
        found = found.parent
    return found


def extract(page: str | None) -> str:
    """The main text: blocks in page order, joined by a line end."""
    if not page:
        return ""
    top = main_node(parse(page))
    if top is None:
        return ""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        t = _SPACE.sub(" ", "".join(held)).strip()
        if t:
            blocks.append(t)
        held.clear()

    todo: list = [(top, False)]
    while todo:
        node, leave = todo.pop()
        if isinstance(node, str):
            held.append(node)
            continue
        block = node.tag in BLOCK
        if leave:
            flush()
            continue
        if node.drop:
            if block:
                flush()
            continue
        if node.tag in BLOCK and node is not top and node.link_chars * 10 > node.chars * 9 and node.tags > 1 and node.tag in ("ul", "ol", "div", "table", "section") and not (node.inside or node.tag in KEEP_INSIDE):
            flush()  # a block of nothing but links is a menu, outside of an article
            continue
        if block:
            flush()
            todo.append((node, True))
        elif node.tag == "br":
            held.append(" ")
        todo.extend((k, False) for k in reversed(node.kids))
    flush()
    return "\n".join(blocks)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    schema = "page_id bigint, url string, text string, n_chars bigint"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in (batch.slice(k, 256) for batch in batches for k in range(0, batch.num_rows, 256)):
            htmls, at = b.column(2).to_pylist(), 0
            while at < len(htmls):
                to, load = at, 0
                while to < len(htmls) and (to == at or load < 8 << 20):
                    load += len(htmls[to] or "")
                    to += 1
                texts = [extract(h) for h in htmls[at:to]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), b.column(1).slice(at, to - at), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                at = to

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, schema)
