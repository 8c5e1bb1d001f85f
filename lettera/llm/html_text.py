"""Main text of web pages by composite text density.

For every element of the DOM the characters per tag are computed and adjusted
by the share of link text; a subtree's score is the sum of its children's densities.
The subtree of the largest sum is the content, together with other subtrees of body
whose density reaches the least density on its path to body.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements that are never part of an article.
OUTSIDE = frozenset("head script style noscript template nav footer aside form button select textarea iframe object svg canvas dialog menu".split())
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "dt", "dd"} | {"dd", "dt"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select", "optgroup"})}
#: Names by which pages mark what is not the article: menus, headers, footers, sidebars, notices, adverts, forms, reader comments.
MARKED = re.compile(
    r"ad|ads|adv|advert\w*|ad[-_]\S+|\S+[-_]ads?|banner\S*|sponsor\S*|promo\S*|cookie\S*|consent\S*|gdpr\S*|notice\S*|alert\S*|popup\S*|modal\S*|overlay\S*|newsletter\S*|subscri\S*|signup\S*|login\S*"
    r"|menu\S*|nav|nav[-_]\S+|navbar\S*|navigation\S*|breadcrumb\S*|pagination\S*|pager|toolbar\S*|site-?header|page-?header|masthead\S*|topbar\S*|site-?footer|page-?footer|footer\S*|header|sidebar\S*|side-?bar\S*|aside\S*"
    r"|comments?|comments?[-_]\S+|\S+[-_]comments?|disqus\S*|respond|replies|reply\S*|related\S*|recommend\S*|share|share[-_]\S+|sharing\S*|social\S*|widget\S*|search|search[-_]?(?:form|box)|skip\S*|complementary|contentinfo|search",
    re.I,
)


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.children, self.dropped = tag, parent, [], dropped
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def is_outside(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in OUTSIDE:
        return True
    if tag == "header":
        return not in_article
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    return any(MARKED.fullmatch(name) for m in ATTRIBUTE.finditer(attributes) for name in (m[2] or m[3] or m[4] or "").split())


def tokens(html: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name, rest, end): a text, a start or an end tag, in one pass. A quote that is never closed is an ordinary character; what begins like a tag that never ends is left out with all after it."""
    at, n, open_quotes = 0, len(html), set()
    while at < n:
        start = html.find("<", at)
        if start < 0:
            break
        if start > at:
            yield "text", "", html[at:start], start
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = n if end < 0 else end + 3
        elif html.startswith("<![CDATA[", start):
            end = html.find("]]>", start + 9)
            at = n if end < 0 else end + 3
            yield "text", "", html[start + 9 : n if end < 0 else end], at
        elif html.startswith(("<!", "<?"), start):
            end = html.find(">", start)
            at = n if end < 0 else end + 1
        elif m := TAG.match(html, start):
            end = m.end()
            while (stop := STOP.search(html, end)) is not None and (q := stop[0]) != ">":
                close = -1 if q in open_quotes else html.find(q, stop.end())
                if close < 0:
                    open_quotes.add(q)
                end = stop.end() if close < 0 else close + 1
            if stop is None:
                return
            at = stop.end()
            at = (yield "end" if m[1] else "start", m[2].lower(), html[m.end() : stop.start()], at) or at
        else:
            yield "text", "", "<", start + 1
            at = start + 1
    else:
        return
    yield "text", "", html[at:], n


class Open:
    """The open elements, with the places of each name and of the blocks among them."""

    def __init__(self, root: Node):
        self.nodes, self.of, self.blocks = [root], {"html": [0]}, [0]

    def last(self, *tags: str) -> int:
        return max((self.of[t][-1] for t in tags if self.of.get(t)), default=-1)

    def push(self, n: Node) -> None:
        self.of.setdefault(n.tag, []).append(len(self.nodes))
        if n.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(n)

    def close(self, at: int) -> None:
        """Closes all from a place on; the root stays."""
        while len(self.nodes) > max(at, 1):
            n = self.nodes.pop()
            self.of[n.tag].pop()
            if n.tag in BLOCK:
                self.blocks.pop()


def parse(html: str) -> Node:
    """The DOM as far as it matters here: elements, their text and what is open when; broken markup is taken as browsers do for paragraphs, lists and tables. Time is in proportion to the page."""
    root = Node("html", None, False)
    now, stream, jump = Open(root), tokens(html), None
    while True:
        try:
            kind, tag, rest, at = stream.send(jump)
        except StopIteration:
            return root
        jump, top = None, now.nodes[-1]
        if kind == "text":
            if not top.dropped:
                top.children.append(unescape(rest))
            continue
        if kind == "end":
            k = now.last(tag)
            # an inline end tag doesn't close blocks
            if k > 0 and (tag in BLOCK or tag == "a" or now.blocks[-1] < k):
                now.close(k)
            continue
        if tag in ("html", "body") and now.last(tag) >= 0:
            continue
        if tag == "body":
            now.close(1)
        if tag in ENDS_P and now.nodes[now.blocks[-1]].tag == "p":
            now.close(now.blocks[-1])
        if tag in SIBLINGS:
            own, within = SIBLINGS[tag]
            if (k := now.last(*own)) > now.last(*within):
                now.close(k)
        top = now.nodes[-1]
        node = Node(tag, top, top.dropped or is_outside(tag, rest, now.last("article", "main") >= 0))
        top.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            jump = end.end() if end else len(html)
        elif tag not in VOID and (not rest.rstrip().endswith("/") or tag in BLOCK):
            now.push(node)


def in_order(root: Node) -> list[Node]:
    """The kept elements, parents first; no recursion, so depth is not limited."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if not n.dropped:
            out.append(n)
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return out


def measure(nodes: list[Node]) -> None:
    """Densities of the kept elements. Counts of zero are taken as one, as the formula divides by them."""
    for n in reversed(nodes):
        n.chars = sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        for c in n.children:
            if isinstance(c, Node) and not c.dropped:
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags + (c.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    whole = next((n for n in nodes if n.tag == "body"), nodes[0])
    share = whole.link_chars / max(whole.chars, 1)
    for n in nodes:
        c, t, lc, lt = n.chars, max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
        if c:
            base = math.log(c / max(c - n.link_chars, 1) * n.link_chars + share * c + math.e)
            # a logarithm to a base next to 1 is left at its natural value
            n.density = c / t * math.log(max(c / lc * t / lt, 1.0) + 1) / max(math.log(base), 1.0)
    for n in nodes:
        n.total = sum(c.density for c in n.children if isinstance(c, Node) and not c.dropped)


def content(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    nodes = in_order(root)
    measure(nodes)
    body = next((n for n in nodes if n.tag == "body"), root)
    if not body.chars:
        return []
    best = max(nodes, key=lambda n: (n.total, n.density))  # the first in page order on a tie
    least, n = best.density, best
    while n is not None and n is not body:
        least, n = min(least, n.density), n.parent
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:  # the page itself says how far the text around the best subtree goes
        best = up
    above, n = set(), best
    while n is not None:
        above.add(n)
        n = n.parent
    found, todo = [], [body]
    while todo:
        n = todo.pop()
        if n is best or n.tag in ("h1", "h2") or n is not body and n.density >= least and n not in above:
            found.append(n)
        elif n in above:
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node) and not c.dropped)
    return [body] if best is body else found


def blocks(tops: list[Node]) -> list[str]:
    """The text of each block, with its white space runs as one space and trimmed; empty blocks are left out."""
    out, run = [], []

    def cut() -> None:
        if t := " ".join("".join(run).split()):
            out.append(t)
        run.clear()

    for top in tops:
        cut()
        todo: list = [top]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                run.append(n)
            elif n is None:
                cut()
            elif n.tag == "br":
                run.append(" ")
            elif not n.dropped:
                if n.tag in BLOCK:
                    cut()
                    todo.append(None)
                todo.extend(reversed(n.children))
        cut()
    return out


def main_text(html: str | None) -> str:
    """The main text of a whole page; null, empty or textless pages give the empty text."""
    return "\n".join(blocks(content(parse(html)))) if html else ""


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with text_col for html_col: one row per row, other columns as they were; a column named text_col before is replaced.

    Null and empty html give an empty text; repeated rows give equal texts; an empty table gives no rows.
    """
    names = [c for c in pages.columns if c != text_col or c == html_col]
    rows = pages.select(*names)

    def run(batches):
        for b in batches:
            kept = [c for c in b.schema.names if c != html_col]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array([main_text(h.as_py()) for h in b[html_col]], pa.string())], [*kept, text_col])

    kept = [f for f in rows.schema.fields if f.name != html_col]
    return rows.mapInArrow(run, type(rows.schema)(kept).add(text_col, "string"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
