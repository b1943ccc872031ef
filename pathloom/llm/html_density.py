"""Main-text extraction by composite text density.

The page's tags become a tree. For every node, with C characters of text and T tags, of which LC characters and LT tags
are in links (each at least 1), and for the body's C_b and LC_b, the density is
    C / T * log(1 + C * T / (LC * LT)) / log(1 + log(C / (C - LC) * LC + LC_b / C_b * C + e)),
that is, characters per tag, weighed down where many of them are in links, the more so the fewer links the page has.
A node's own text counts as a leaf of its own: each run of text and inline tags between two blocks or line breaks. So a paragraph may be a ``p``, a ``div`` or bare
text between line breaks; a block that has leaves only is a text block, whatever its tag, and others are containers.
The densities of a node's children, leaves among them, are summed, and the node with the largest sum is the content's centre; the body counts
with its own leaves and text blocks only, as all that a page shows is in it. The threshold is the least density on the path from the
centre up to the body. A centre that its parent wraps with nothing but text blocks beside it gives way to that parent, and
containers beside it that hold text blocks of their own and reach the threshold are content too. In the content, blocks under
the threshold that are mostly links are left out, and nothing else.
Before that a light filter takes off what by tag, role or class name is a menu, header, footer, sidebar, notice, advert, form,
script, style or comment, so its text counts nowhere; a node that is so by its class name only, but has most of the page's text
outside links, is left to the densities.

Time and memory grow with the page's length, also for pages of unclosed tags, quotes or comments.

Defined results: a null page counts as empty and gives empty text; markup that never closes is closed where its parent ends;
a tag that never ends is text; a page without block tags is one block; repeated rows and null keys have rows of their own; an
empty table gives no rows. Only the key, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas noembed noframes xmp".split())
DROPPED = RAW | frozenset("nav footer aside form button select option menu dialog head audio video map label input".split())
SECTIONS = frozenset("aside dialog footer form menu nav".split())
BLOCKS = frozenset(
    "address article blockquote body br center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Tags of headings, text and tables: beside the centre these are content, whereas a div of text there may be a line of the page's own.
RUNNING = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol dl table figure".split())
#: A run of text and inline tags.
LEAF = "#text"
CLOSED_BY = {"p": BLOCKS - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
# A class or id is one of these names as a whole: only words for a place or a shape may stand beside it, so that has-sidebar,
# page-header-fixed, search-results or content-with-comments name no boilerplate.
NAME = r"(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promos?|banners?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|footers?|header|masthead|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|newsletters?|subscribe|signup|login|search|share|sharing|social|related|recommended|widgets?|comments?|disqus|replies|respond|pagination|pager|toolbar|skip-link)"
BESIDE = r"(?:main|site|page|post|primary|secondary|global|top|bottom|left|right|upper|lower|list|area|box|bar|block|section|links?|buttons?|icons?|form|items?|posts?|articles?|thread|wrapper|wrap|container|inner|outer|unit|slot|id|\d+)"
NAMES = re.compile(rf"(?:^|\s)(?:{BESIDE}[-_]+)*{NAME}\d*(?:[-_]+(?:{NAME}|{BESIDE})\d*)*(?:$|\s)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
TAG_STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    __slots__ = ("tag", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "parent", "dropped", "block", "in_article", "gone", "begin", "end", "holds")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.dropped, self.holds = "", False  # whether it is a block or has blocks inside
        self.gone, self.begin, self.end = False, 0, 0  # dropped by its tag or inside such a node; its span in the order of nodes
        self.block = self if parent is None or tag in BLOCKS or tag in SECTIONS or tag == "button" else parent.block
        self.in_article = tag in ("article", "main") or parent is not None and parent.in_article

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def boilerplate(tag: str, attributes: str) -> str:
    """Why a node is boilerplate: "tag" (also for a role or hidden ones), "name" or "" if it isn't."""
    if tag in DROPPED:
        return "tag"
    if not attributes or tag in ("html", "body", "main", "article"):
        return ""
    why = ""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return "tag"
        if name in ("class", "id") and NAMES.search(value):
            why = "name"
    return why


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """("", "", text, its end), or ("/" or "", tag, attributes, the tag's end); comments and declarations are left out.

    The caller may send a place from which to go on.
    """
    at, n, begin = 0, len(page), 0
    last = {c: page.rfind(c) for c in "<>\"'"}
    while at <= last["<"]:
        start = page.find("<", at)
        if page.startswith(("<!", "<?"), start):
            mark = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(mark, start + len(mark) if mark == "-->" else start)
            end = n if end < 0 else end + len(mark)
            found = None
        else:
            found = TAG_NAME.match(page, start + 1)
            if not found or last[">"] < found.end():
                at = start + 1  # an ordinary character
                continue
            end = found.end()
            while page[(stop := TAG_STOP.search(page, end).start())] != ">":
                quote = page[stop]
                end = page.find(quote, stop + 1) + 1 if last[quote] > stop else stop + 1
                if end > last[">"]:
                    end = stop + 1  # a quote that closes after the last tag's end opens none
            end = stop + 1
        if start > begin:
            yield "", "", page[begin:start], start
        at = begin = end
        if found:
            jump = yield found[1], found[2].lower(), page[found.end() : end - 1], end
            if jump is not None:
                at = begin = jump
                yield "", "", "", jump
    if begin < n:
        yield "", "", page[begin:], n


def parse(page: str) -> Node:
    """The tree of the page without its boilerplate nodes. These are in the tree while it grows, so that they end as all others do."""
    root = node = Node("html", None)
    opened: Counter[str] = Counter()
    endless: set[str] = set()  # raw tags with no end from here on
    found = tokens(page)
    for slash, tag, said, at in found:
        if not tag:
            if said:
                node.parts.append(said)
            continue
        if tag in RAW and not slash:
            if tag in ("svg", "math") and said.endswith("/") or tag in endless and tag in ("svg", "math", "object", "canvas"):
                continue
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end or tag not in ("svg", "math", "object", "canvas"):
                found.send(end.end() if end else len(page))
            else:
                endless.add(tag)
            continue
        if slash:
            if opened[tag]:
                node = close(node, tag, opened)
            continue
        while node.tag in CLOSED_BY and tag in CLOSED_BY[node.tag]:
            node = close(node, node.tag, opened)
        if (tag in BLOCKS and tag != "br" or tag in SECTIONS) and node.block.tag == "p":  # a block ends an unclosed paragraph, also one with open inline tags in it
            node = close(node, "p", opened)
        new = Node(tag, node)
        new.dropped = "tag" if tag == "header" and not node.in_article else boilerplate(tag, said)
        node.parts.append(new)
        if tag not in VOID and not said.endswith("/"):
            node = new
            opened[tag] += 1
    prune(root)
    with_leaves(root)
    return root


def with_leaves(root: Node) -> None:
    """Put the runs of text and inline tags in each node that holds blocks, or is one, into leaves; line breaks end a leaf."""
    nodes = in_order(root)
    root.holds = True
    for node in reversed(nodes):
        if (node.holds or node.tag in BLOCKS or node.tag in SECTIONS) and node.tag != "br":
            node.holds = True
            if node.parent is not None:
                node.parent.holds = True
    for node in nodes:
        if not node.holds:
            continue
        parts, leaf = [], None
        for part in node.parts:
            if isinstance(part, Node) and (part.holds or part.tag == "br"):
                leaf = None
                parts.append(part)
                continue
            if leaf is None:
                leaf = Node(LEAF, node)
                parts.append(leaf)
            leaf.parts.append(part)
            if isinstance(part, Node):
                part.parent = leaf
        node.parts = [p for p in parts if p.tag != LEAF or any(isinstance(x, Node) or x.strip() for x in p.parts)]


def close(node: Node, tag: str, opened: Counter[str]) -> Node:
    """The parent of the innermost open node with this tag; all nodes in that one are closed too."""
    while True:
        opened[node.tag] -= 1
        if node.tag == tag:
            return node.parent
        node = node.parent


def prune(root: Node) -> None:
    """Take the dropped nodes off. One dropped by its name only stays if it has most of the page's text outside links, unless an article is elsewhere."""
    nodes = in_order(root)
    if not any(x.dropped for x in nodes):
        return
    plain: dict[Node, int] = {}
    for i, node in enumerate(nodes):
        node.begin = i
        node.gone = node.dropped == "tag" or node.parent is not None and node.parent.gone
    for node in reversed(nodes):
        own, inside = sum(len(p.strip()) for p in node.parts if isinstance(p, str)), node.children()
        node.end = inside[-1].end if inside else node.begin
        plain[node] = 0 if node.dropped == "tag" or node.tag == "a" else own + sum(plain[c] for c in inside)
    articles = [x.begin for x in nodes if x.tag in ("article", "main") and plain[x] and not x.gone]
    for node in nodes:
        if node.dropped == "name" and 2 * plain[node] > plain[root] and (not articles or node.begin <= articles[0] and articles[-1] <= node.end):
            node.dropped = ""
    for node in nodes:
        if any(c.dropped for c in node.children()):
            node.parts = [p for p in node.parts if isinstance(p, str) or not p.dropped]


def in_order(root: Node) -> list[Node]:
    """Parents before children."""
    out, queue = [], [root]
    while queue:
        node = queue.pop()
        out.append(node)
        queue.extend(reversed(node.children()))
    return out


def densities(root: Node) -> list[Node]:
    nodes = in_order(root)
    for node in reversed(nodes):
        node.chars = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        for child in node.children():
            node.chars += child.chars
            node.tags += child.tags + (child.tag != LEAF)
            node.link_chars += child.chars if child.tag == "a" else child.link_chars
            node.link_tags += child.link_tags + (child.tag == "a")
    body_chars, body_links = max(root.chars, 1), root.link_chars
    for node in nodes:
        if node.chars:
            tags, link_chars, link_tags, plain = max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1), max(node.chars - node.link_chars, 1)
            base = log(node.chars / plain * node.link_chars + body_links / body_chars * node.chars + e)
            node.density = node.chars / tags * log(node.chars * tags / (link_chars * link_tags) + 1) / log(max(base, 1 + 1e-9) + 1)
    for node in nodes:
        node.total = sum(c.density for c in node.children())
    return nodes


def plain(node: Node) -> int:
    return node.chars - node.link_chars


def is_text(node: Node) -> bool:
    """A leaf, or a block with leaves and line breaks only."""
    return node.tag == LEAF or all(c.tag in (LEAF, "br", "hr") for c in node.children())


def own_sum(node: Node) -> float:
    """The sum of densities by which a node is chosen: all children's, or of the body and above those of text, by half if it may be a line of the page's own."""
    if node.tag not in ("body", "html"):
        return node.total
    return sum(c.density * (1 if c.tag == LEAF or c.tag in RUNNING else 0.5) for c in node.children() if is_text(c))


def beside(node: Node) -> list[Node]:
    return [c for c in node.parent.children() if c is not node and not is_text(c) and plain(c) > 0] if node.parent else []


def centre(nodes: list[Node]) -> tuple[list[Node], float]:
    """The content's nodes, and the least density on their path to the body."""
    best = max((x for x in nodes if x.holds), key=own_sum)
    if own_sum(best) == 0:
        return nodes[:1], 0.0
    up = best
    while up.parent is not None and up.tag not in ("article", "main", "body", "html"):
        up = up.parent
    if up.tag in ("article", "main") and plain(up) > 0:
        best = up  # what stands in the same article belongs to it
    while best.parent is not None and best.parent.tag not in ("body", "html") and best.tag not in ("body", "html") and not beside(best):
        best = best.parent
    threshold, up = best.density, best.parent
    while up is not None and up.tag != "html":
        threshold = min(threshold, up.density or threshold)
        up = up.parent
    if best.parent is None or best.tag in ("body", "html"):
        return [best], threshold
    others = {x for x in beside(best) if x.total > 0 and x.density >= threshold and plain(x) > x.link_chars and any(is_text(c) and c.density >= threshold for c in x.children())}
    running = {x for x in best.parent.children() if x.tag in RUNNING and plain(x) > x.link_chars}
    return [x for x in best.parent.children() if x is best or x in others or x in running], threshold


def blocks(content: list[Node], threshold: float) -> list[str]:
    """Texts of the kept blocks, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    kept = set(content)
    stack: list[Node | str | None] = list(reversed(content))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        else:
            if x not in kept and x.tag in BLOCKS and x.chars and x.density < threshold and plain(x) <= x.link_chars:
                flush()
                continue
            if x.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(x.parts))
    flush()
    return out


def main_text(page: str | None) -> str:
    nodes = densities(parse(page or ""))
    return "\n".join(blocks(*centre(nodes)))


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars for every row."""

    @F.pandas_udf("string")
    def text(found: pd.Series) -> pd.Series:
        return found.map(main_text)

    return pages.select(key, url, text(F.coalesce(F.col(html).cast("string"), F.lit(""))).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
