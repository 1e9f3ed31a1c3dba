"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML and customary names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody "
    "td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "option", "html", "head", "body"}
SAME_CLOSES = {
    "li": "ul ol menu dir", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select",
    "tbody": "table", "thead": "table", "tfoot": "table"}
SIBLINGS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",),
            "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
FURNITURE_TAGS = frozenset("nav footer aside form button select menu dialog input object embed canvas audio video head".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice popup modal overlay newsletter subscribe subscription signup share sharing social comment comments disqus respond "
    "replies sidebar rail widget widgets related recommended recommendations nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs pagination pager footer masthead toolbar skip".split())
COMMENT_NAMES = frozenset("comment comments commentlist commentarea disqus respond replies".split())
STATE_NAMES = frozenset("with has no open closed enabled disabled allow".split())  # "with-comments" says something of what holds comments
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

# No part gives back what it took, and what is unfinished reaches to the end of the page: a page is read once, whatever is in it.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[a-z0-9]+")


class Node:
    """An element with its children and text pieces in page order, and the counts that density needs."""

    __slots__ = ("tag", "parent", "parts", "furniture", "chars", "tags", "link_chars", "link_tags", "density", "total", "inside", "named", "landmark")

    def __init__(self, tag: str, parent: "Node | None", furniture: bool):
        self.tag, self.parent, self.furniture = tag, parent, furniture
        self.parts: list = []
        self.named, self.landmark = 0, False
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)


def _is_furniture(tag: str, attributes: str, inside: bool) -> bool:
    if tag in FURNITURE_TAGS or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "role" and value.strip() in FURNITURE_ROLES:
            return True
        if name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name == "hidden":
            return True
    return False


def _named(tag: str, attributes: str) -> int:
    """3 for reader comments, 2 if a whole class or id is a furniture name, 1 if a part of one is, else 0."""
    if not attributes or tag in ("html", "body"):
        return 0
    names = {n for name, *values in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for n in "".join(values).lower().split()}
    parts = [set(NAME.findall(n)) for n in names]
    if any(not COMMENT_NAMES.isdisjoint(p) and STATE_NAMES.isdisjoint(p) for p in parts):
        return 3
    if not FURNITURE_NAMES.isdisjoint(names):
        return 2
    return int(any(not FURNITURE_NAMES.isdisjoint(p) for p in parts))


class _Open:
    """The open elements from the root down, with the depths of each tag and of all blocks, so that no search walks up."""

    def __init__(self, root: Node):
        self.nodes, self.depths, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def deepest(self, tags: tuple[str, ...]) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def close(self, depth: int) -> None:
        """Closes the element at ``depth`` and all in it."""
        for node in reversed(self.nodes[depth:]):
            self.depths[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
        del self.nodes[depth:]


def parse(page: str) -> Node:
    """The element tree; unclosed, cut and stray tags are repaired the way browsers do for common cases. Time is linear in the page."""
    root = Node("#root", None, False)
    opened = _Open(root)
    at, end = 0, len(page)
    while at < end:
        found = TOKEN.search(page, at)
        if not found:
            opened.nodes[-1].parts.append(page[at:])
            break
        if found.start() > at:
            opened.nodes[-1].parts.append(page[at : found.start()])
        at = found.end()
        tag = found.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if found.group(1):
            depth = opened.deepest((tag,))
            # A stray end tag does not close the table cell, list item or section around it.
            if depth and (tag in BLOCK or depth > opened.blocks[-1]):
                opened.close(depth)
            continue
        if tag in CLOSES_P and opened.nodes[opened.blocks[-1]].tag == "p":
            opened.close(opened.blocks[-1])
        if tag in SAME_CLOSES:
            depth = opened.deepest(SIBLINGS.get(tag, (tag,)))
            if depth > opened.deepest(tuple(SAME_CLOSES[tag].split())):
                opened.close(depth)
        here = opened.nodes[-1]
        node = Node(tag, here, _is_furniture(tag, found.group(3), here.inside))
        node.named = _named(tag, found.group(3))
        if tag in ("article", "main"):
            node.landmark = not node.named
            # Other names do not make an article furniture.
            node.named = node.named if node.named == 3 else 0
        here.parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID:
            opened.push(node)
    return root


def _counted(root: Node) -> list[Node]:
    """Characters, tags and their link parts of every node, bottom up, without furniture; nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in node.parts if isinstance(p, Node) and not p.furniture and p.tag not in RAW)
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len("".join(part.split()))
            elif not part.furniture and part.tag not in RAW:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    return order


def _measure(root: Node) -> None:
    """Decides which marked elements are furniture, and counts what is left.

    A name marks an element; so does being a list of links and hardly anything else, outside an article. A mark is
    void around an ``article`` or ``main`` or, on a page without them, around most of the text. A name that is only part of a
    class or id is void on a quarter of the text or more that is as dense as the page. Reader comments go however long they are.
    """
    order = _counted(root)
    holds = set()
    for node in order:
        if node.landmark:
            while node is not None and node not in holds:
                holds.add(node)
                node = node.parent
    usual = (root.chars - root.link_chars) / (root.tags + 1)
    for node in order:
        if node.named == 3 and node not in holds:
            node.furniture = True
        if node in holds or (not holds and 2 * node.chars > root.chars):
            continue
        links = node.tag in ("ul", "ol", "dl", "table") and not node.inside and node.link_tags >= 3 and node.link_chars > 0.8 * node.chars
        thin = 4 * node.chars < root.chars or (node.chars - node.link_chars) / (node.tags + 1) < usual
        node.furniture = links or node.named >= 2 or (node.named == 1 and thin)
    _counted(root)


def _densities(body: Node) -> list[Node]:
    """Composite density of every node under ``body`` and, as ``total``, the sum over its children."""
    share = body.link_chars / max(body.chars, 1)
    order, stack = [], [body]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in node.parts if isinstance(p, Node) and not p.furniture and p.tag not in RAW)
    for node in reversed(order):
        c, t = node.chars, max(node.tags, 1)
        links, link_tags = max(node.link_chars, 1), max(node.link_tags, 1)
        plain = max(c - node.link_chars, 1)
        base = math.log(c / plain * node.link_chars + share * c + math.e)
        node.density = c / t * math.log(max(c / links * t / link_tags, 1.0)) / math.log(base + math.e) if c else 0.0
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.furniture and p.tag not in RAW)
        if not node.total and c:
            node.total = node.density
    return order


def _blocks(node: Node, out: list[list[str]]) -> None:
    """Text pieces of a subtree, a new list wherever a block begins or ends."""
    stack: list = [node]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out[-1].append(part)
        elif part is None:
            out.append([])
        elif part.furniture or part.tag in RAW:
            if part.tag in BLOCK:
                out.append([])
        else:
            if part.tag in BLOCK:
                out.append([])
                stack.append(None)
            stack.extend(reversed(part.parts))


def main_text(page: str) -> str:
    """The article of one page; empty if it has none."""
    root = parse(page)
    body = root
    for part in [p for top in root.parts if isinstance(top, Node) for p in [top, *top.parts] if isinstance(p, Node)]:
        if part.tag == "body":
            body = part
            break
    _measure(root)
    if not hasattr(body, "chars") or not body.chars:
        return ""
    order = _densities(body)
    best = max(order, key=lambda n: (n.total, n is body))
    # The least density on the way up to the body tells text from what lies between.
    path, node = [], best
    while node is not None and node is not body.parent:
        path.append(node)
        node = node.parent
    threshold = min(n.density for n in path)
    top = best
    for node in path[1:]:
        if top.tag in ("article", "main") and (not top.parent or not top.parent.inside):
            break
        beside = [p for p in node.parts if p is not top and (
            p.strip() if isinstance(p, str) else not p.furniture and p.tag not in RAW and p.chars)]
        texts = [p for p in beside if isinstance(p, str) or node.inside or p.density >= threshold]
        if texts or len(beside) == 0:
            top = node
        else:
            break
    out: list[list[str]] = [[]]
    _blocks(top, out)
    lines = (" ".join(html.unescape("".join(pieces)).split()) for pieces in out)
    return "\n".join(line for line in lines if line)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row.

    Each node's characters per tag are adjusted for its links and for the body's share of
    links; the subtree with the greatest sum of child densities holds the article. From
    there the selection widens towards the body while what stands beside it is as dense as the
    thinnest node on the path, or while it is still inside the same ``article`` or ``main``. Elements that are
    page furniture by tag, role or confirmed name, and lists of nothing but links outside an article, count nowhere and
    are left out inside the article too. Character references are decoded, white space in a block becomes one
    space, blocks are joined by a line feed; a line break starts a block.

    Null and empty pages give an empty text with 0 characters; unclosed tags are closed, a cut tag is no text; null ids and
    urls stay null; repeated rows give their rows again; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "") for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
