"""Main text of web pages by composite text density.

Every page becomes a small element tree. A node's composite density is its characters per tag, lowered by the share of
characters and tags inside links; a node's density sum adds up its children's densities. The body's node with the
largest sum is the core of the article. The lowest density on the path from it up to the body is the threshold: on that
path, neighbours of at least that density belong to the article too, as does text right inside its elements. Parts whose element or name says that they are
menus, adverts, forms, notices or comments are cut out before anything is measured.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object".split())
DROPPED = frozenset(
    "nav footer aside form script style noscript template textarea title iframe svg object head button select "
    "dialog menu canvas audio video fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: words in class, id or role that name what is not the article
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice popup promo promoted "
    "related recommended replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "toolbar widget pagination pager copyright skip".split())
#: those that an article element carries if it is not the page's own
BESIDE_ARTICLES = frozenset(
    "ad ads advert comment comments promo promoted related recommended replies reply sponsored widget".split())
HEADER_NAMES = frozenset(["header", "banner"])
#: elements whose id may name boilerplate
CONTAINERS = frozenset("div ul ol span table dl a p iframe".split())

# a quote counts only after an equals sign; possessive parts never go back, so odd markup costs no extra time
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>", re.S)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_CLOSES_P = BLOCKS - {"body", "html"}
_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
         "th": ("tr", "table"), "option": ("select",)}


class Node:
    """An element: children are nodes and strings in page order."""

    __slots__ = ("tag", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _is_boilerplate(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True
    if not attributes or tag in ("body", "html", "main"):
        return False
    names = BESIDE_ARTICLES if tag == "article" else BOILERPLATE
    for name, value in _NAMED.findall(attributes):
        if name.lower() == "id" and tag not in CONTAINERS:
            continue  # ids of sections and headings are made from their heading
        for token in value.lower().strip("\"'").split():
            words = _WORD.findall(token)
            listed = sum(w in names or (w in HEADER_NAMES and not inside_article) for w in words)
            # a name of its own or with one more word (share-buttons, site-footer); longer ones only if all of it is listed
            if listed and (len(words) <= 2 or listed == len(words)):
                return True
    return False


def parse(page: str) -> Node:
    """The element tree without boilerplate. Unclosed, misnested and cut-off markup is closed as browsers close it."""
    root = Node("html", None)
    stack = [root]  # open elements that are kept
    skipped: list[str] = []  # open elements inside a dropped one, itself first
    at, n = 0, len(page)
    last = page.rfind(">")  # no tag ends after it
    while at < n:
        m = _TOKEN.search(page, at) if at <= last else None
        if not m:
            if not skipped:
                stack[-1].children.append(page[at:])
            break
        if m.start() > at and not skipped:
            stack[-1].children.append(page[at:m.start()])
        at = m.end()
        closing, name, attributes = m.group(1), m.group(2), m.group(3)
        if name is None:
            continue
        tag = name.lower()
        if not closing and tag in RAW:
            # raw text ends at its own end tag only
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else (n if tag in ("script", "style") else at)
            continue
        if not closing and tag == "body":
            skipped.clear()  # a head without its end
        if skipped:
            if not closing:
                if tag != "p" or skipped != ["p"]:
                    if tag not in VOID and not attributes.endswith("/"):
                        skipped.append(tag)
                    continue
                skipped.clear()  # the next paragraph ends a dropped one
            elif tag in skipped:
                while skipped.pop() != tag:
                    pass
                continue
            elif tag in ("article", "main", "body", "html") and any(x.tag == tag for x in stack):
                skipped.clear()  # its end ends everything inside it
            else:
                continue
        if closing:
            if tag in ("body", "html"):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break  # an inline end tag does not close blocks
            continue
        if tag in ("html", "body"):
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in _SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag or (tag in ("dt", "dd") and stack[i].tag in ("dt", "dd")):
                    del stack[i:]
                    break
                if stack[i].tag in _SAME[tag]:
                    break
        inside = any(x.tag in ("article", "main") for x in stack)
        if _is_boilerplate(tag, attributes, inside):
            if tag not in VOID and not attributes.endswith("/"):
                skipped.append(tag)
            continue
        node = Node(tag, stack[-1])
        stack[-1].children.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
    return root


def _nodes(root: Node) -> list[Node]:
    """Parents before children, without recursion: pages may nest deeply."""
    out = [root]
    for node in out:
        out.extend(x for x in node.children if isinstance(x, Node))
    return out


def measure(root: Node) -> list[Node]:
    """Fill in counts, densities and density sums; gives all nodes."""
    nodes = _nodes(root)
    for node in reversed(nodes):
        for x in node.children:
            if isinstance(x, Node):
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
            else:
                node.chars += len("".join(x.split()))
        if node.tag == "a":
            node.link_chars = node.chars
    c, lc = max(root.chars, 1), root.link_chars
    for node in nodes:
        chars, links = node.chars, node.link_chars
        if not chars:
            continue
        base = math.log(chars / max(chars - links, 1) * links + lc / c * chars + math.e)
        ratio = chars / max(links, 1) * max(node.tags, 1) / max(node.link_tags, 1)
        node.density = chars / max(node.tags, 1) * math.log(max(ratio, 1.0)) / max(base, 1e-9)
    for node in nodes:
        node.total = sum(x.density for x in node.children if isinstance(x, Node))
    return nodes


def article_nodes(root: Node) -> list[Node | str | None]:
    """The subtree with the largest density sum, widened along its path to the body; in page order, None where a block ends."""
    nodes = measure(root)
    if not root.chars:
        return []
    best = max(nodes, key=lambda x: (x.total, x.chars))  # the first of equals
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    # an article or main element around the core is the whole article, and is never left
    named = [x for x in path if x.tag in ("article", "main")]
    if named:
        return [named[-1] if named[-1].tag == "article" else named[0]]
    if best is root:
        return [root]
    threshold = min(x.density for x in path)
    before, after = [], []
    for inner, outer in zip(path, path[1:]):
        i = next(i for i, x in enumerate(outer.children) if x is inner)
        edge = [None] if inner.tag in BLOCKS else []  # its text does not run into the outer one's
        # text that stands directly in an element of the path belongs to it
        before.append([x for x in outer.children[:i] if _belongs(x, threshold)] + edge)
        after += edge + [x for x in outer.children[i + 1:] if _belongs(x, threshold)]
    return [*(x for part in reversed(before) for x in part), best, *after]


def _belongs(x: Node | str, threshold: float) -> bool:
    """Is what stands beside the path part of the page's text? Boilerplate is gone already; what is left out is mostly links."""
    return isinstance(x, str) or x.density >= threshold or 2 * x.link_chars < x.chars or (
        re.fullmatch(r"h[1-6]|hgroup|header", x.tag) is not None)


def blocks(top: list[Node | str | None]) -> list[str]:
    """Text of every block in page order: references decoded, white space made one space."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        words = html.unescape("".join(run)).split()
        run.clear()
        if words:
            out.append(" ".join(words))

    todo: list = list(reversed(top))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        else:
            if x.tag in BLOCKS:
                flush()
                todo.append(None)
            elif x.tag in ("br", "td", "th"):
                run.append(" ")
            todo.extend(reversed(x.children))
    flush()
    return out


def extract(page: str | None) -> str:
    return "\n".join(blocks(article_nodes(parse(page)))) if page else ""


def main_text(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` plus the article's text.

    NULL and empty pages, and pages without text, give ''. A page of any size is parsed whole, in time and memory
    proportional to it; equal pages give equal texts. An existing column ``name`` is replaced.
    """
    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        return pa.array([extract(x) for x in column.to_pylist()], type=pa.string())

    return pages.withColumn(name, texts(F.col(html_col).cast("string")))
