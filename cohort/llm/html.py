"""Main text of web pages by composite text density over the whole DOM tree."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg math iframe object textarea select title head canvas audio video".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never belong to the article.
ASIDE = set("nav footer aside form button menu dialog".split())
#: Names of classes, ids and roles of parts that don't belong to the article: a name counts as a whole, or if all
#: words between its hyphens are such names or say no more than that it is a part (FILLERS).
ASIDE_NAMES = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar side aside ad ads advert advertisement advertising "
    "banner sponsor sponsored promo promotion cookie cookies consent notice popup modal newsletter subscribe comment comments "
    "comment-list replies reply discussion disqus related recommended share sharing social widget toolbar pagination pager login "
    "signup search copyright skip-link hidden adsbygoogle gdpr disqus-thread respond".split()
)
FILLERS = set("area bar block box container inner list section slot thread unit wrap wrapper zone".split())
#: Ids that tell a section of reader comments; other ids of sections are addresses.
COMMENTS = set("comments comment-list comments-area comment-section respond disqus-thread".split())
#: What a head may hold; anything else ends it.
HEAD_CONTENT = set("base link meta noscript script style template title".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
#: Elements whose id can name a part of the layout; elsewhere it is the address of a heading, a section or a place.
LAYOUT = set("div ul ol dl table tbody tr td center header".split())
#: What an opening tag closes first, and the elements that hold this back.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
SPACE = re.compile(r"\s+")
CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}


class Node:
    __slots__ = ("tag", "aside", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "most")

    def __init__(self, tag: str, parent: "Node | None", aside: bool = False) -> None:
        self.tag, self.parent, self.aside = tag, parent, aside
        self.parts: list = []  # texts and nodes in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.most = False  # holds more than half of the page's unlinked text


def _aside_named(tag: str, extra: str) -> bool:
    """Whether a class, id or role in the attributes is that of a part beside the article."""
    if tag in HEADING:
        return False
    for kind, *values in NAMED.findall(extra):
        for name in "".join(values).lower().replace("_", "-").split():
            if kind.lower() == "id" and tag not in LAYOUT:
                if tag == "section" and name in COMMENTS:
                    return True
                continue
            words = name.split("-")
            if name in ASIDE_NAMES or not ASIDE_NAMES.isdisjoint(words) and all(w in ASIDE_NAMES or w in FILLERS for w in words):
                return True
    return False


def parse(page: str) -> Node:
    """A tree from any string of HTML: unknown and unclosed tags are tolerated, nothing raises."""
    root = node = Node("html", None)
    depth = {}
    at = 0

    def close(target: Node) -> Node:
        walk = node
        while walk is not target:
            depth[walk.tag] -= 1
            walk = walk.parent
        depth[target.tag] -= 1
        return target.parent

    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            node.parts.append(text)
        if not m:
            return root
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        ending, tag, extra = m[1] or m[4], name.lower(), m[3] or m[6] or ""
        if ending:
            if depth.get(tag):
                target = node
                while target.tag != tag:
                    target = target.parent
                node = close(target)
            elif tag in ("p", "br"):
                node.parts.append(Node(tag, node))
            continue
        if node.tag == "head" and tag not in HEAD_CONTENT and tag not in ("html", "head"):  # its end was left out
            node = close(node)
        if tag in ("html", "body"):
            if tag == "body" and not depth.get("body"):
                child = Node("body", node)
                node.parts.append(child)
                node, depth["body"] = child, 1
            continue
        if tag in BLOCK and depth.get("p"):  # a block ends an open paragraph
            walk = node
            while walk is not root and walk.tag != "p" and walk.tag not in ("table", "td", "th"):
                walk = walk.parent
            if walk.tag == "p":
                node = close(walk)
        if tag in CLOSES:
            ends, holds = CLOSES[tag]
            walk, last = node, None
            while walk is not root and walk.tag not in holds:
                if walk.tag in ends:
                    last = walk
                walk = walk.parent
            if last is not None:
                node = close(last)
        aside = tag in ASIDE or bool(extra) and (_aside_named(tag, extra) or bool(HIDDEN.search(extra)))
        child = Node(tag, node, aside)
        node.parts.append(child)
        if tag in VOID or extra.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW and tag not in ("head", "noscript"):  # its content is not markup
            end = CLOSING[tag].search(page, at)
            close_at = page.find(">", end.start()) + 1 if end else 0
            at = close_at or len(page)
            continue
        node = child
        depth[tag] = depth.get(tag, 0) + 1


def _in_order(root: Node) -> list[Node]:
    """Parents before children."""
    out = [root]
    for node in out:
        out.extend(p for p in node.parts if isinstance(p, Node))
    return out


def _find_most(root: Node, nodes: list[Node]) -> None:
    """Mark the elements with more than half of the unlinked text, unless an article or main elsewhere has text."""
    named, apart = dict.fromkeys(map(id, nodes), 0), {id(root.parent): False}
    for n in nodes:  # parents first
        n.most = 2 * (n.chars - n.link_chars) > root.chars - root.link_chars
        apart[id(n)] = apart[id(n.parent)] or n.tag in RAW or n.aside and not n.most
        own = n.tag in ("article", "main") and n.chars > n.link_chars and not apart[id(n)]
        named[id(n)] = int(own)
    inside = dict(named)
    for n in reversed(nodes):
        if n.parent is not None:
            inside[id(n.parent)] += inside[id(n)]
    around = {id(root.parent): 0}
    for n in nodes:
        around[id(n)] = around[id(n.parent)] + named[id(n)]
        # what is left lies neither in it nor around it
        n.most = n.most and inside[id(root)] == inside[id(n)] + around[id(n.parent)]


def measure(root: Node) -> list[Node]:
    """Composite text density of every node and the sum over its children; returns the nodes, parents first."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        link = node.tag == "a"
        for p in node.parts:
            if isinstance(p, str):
                node.chars += len("".join(p.split()))
            elif p.tag not in RAW:
                node.chars += p.chars
                node.tags += p.tags + 1
                node.link_chars += p.chars if p.tag == "a" else p.link_chars
                node.link_tags += p.link_tags + (p.tag == "a")
        if link:
            node.link_chars, node.link_tags = node.chars, node.tags
    _find_most(root, nodes)
    body = next((n for n in nodes if n.tag == "body"), root)
    ratio = body.link_chars / max(body.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        if c and node.tag not in RAW:
            base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
            inside = c / max(lc, 1) * (t / lt)
            node.density = c / t * (math.log(inside) / math.log(base) if inside > 1 and base > 1 else 0.0)
    for node in nodes:
        node.total = sum(p.density for p in node.parts if isinstance(p, Node))
    return nodes


def main_node(root: Node) -> Node:
    """The subtree of the article.

    The node with the greatest density sum is found first. The threshold is the least density on its path to
    the body. Of the nodes outside menus and the like that reach the threshold, the one with the greatest
    density sum is the article; it is widened to an enclosing ``article`` or ``main`` element. An element that holds
    more than half of the page's unlinked text is not taken for a menu or the like, unless another ``article`` or
    ``main`` element, neither in it nor around it, has text.
    """
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    apart: set[int] = set()
    for n in nodes:  # parents first
        if n.aside and not n.most or n.tag in RAW or n.parent is not None and id(n.parent) in apart:
            apart.add(id(n))
    inside = [n for n in nodes if id(n) not in apart and n.tag != "html"] or [body]
    top = max(inside, key=lambda n: n.total)
    threshold, walk = top.density, top
    while walk is not None and walk is not body:
        threshold, walk = min(threshold, walk.density), walk.parent
    if walk is not None:
        threshold = min(threshold, body.density)
    best = max((n for n in inside if n.density >= threshold), key=lambda n: n.total, default=body)
    walk = best
    while walk is not None:
        if walk.tag in ("article", "main"):
            best = walk
        walk = walk.parent
    if best.tag not in ("article", "main", "body") and best.parent is not None and best.tag in ("p", "h1", "h2", "h3", "li", "b", "span"):
        best = best.parent  # a single dense paragraph stands for its column
    return best


def text_of(node: Node) -> str:
    """Text of a subtree: white space inside a block is one space, blocks are joined by one space."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif item is None:
            out.append(" ")
        elif item is node or item.tag not in RAW and (item.most or not (item.aside or item.tag == "header" and item.parent.tag == "body")):
            edge = item.tag in BLOCK or item.tag == "br"
            stack += [None] * edge + item.parts[::-1] + [None] * edge
    return SPACE.sub(" ", entities.unescape("".join(out))).strip()


def main_text(page: str | None) -> str:
    """Main text of one page; empty for null, empty or text-free pages."""
    return text_of(main_node(parse(page))) if page else ""


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` (its code points) for every page; all other columns stay but the page's source.

    Null and empty pages have an empty text. Pages are independent: one pass, no shuffle, and a repeated page
    gives a repeated row. Columns named ``text`` or ``n_chars`` are replaced.
    """
    kept = [f for f in pages.schema.fields if f.name not in (column, "text", "n_chars")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(p) for p in batch[column]]
            yield batch[[f.name for f in kept]].assign(text=texts, n_chars=[len(t) for t in texts])

    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*[f.name for f in kept], column).mapInPandas(run, schema)
