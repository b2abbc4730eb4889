"""Main text of web pages by composite text density.

Of every node of a page's tree: the density is its characters for each tag, set off against
the characters and tags in links; the density sum adds up the densities of its blocks. A block is
an element that stands for itself, or an inline one that holds such; a run of text beside blocks
counts as one, and inline elements belong to the text around them. The node of the largest sum is
the article's core. The least density on its path to the body is the threshold by which subtrees
beside the path belong to the article too; within an article or main element that holds the core,
where authors have said what belongs together, it is enough that no more than half of a subtree's
characters are in links. A heading goes with what follows it.

Elements that are never part of an article, by their tag or role, are cut off first. Words in
class or id are evidence only: an element goes by them if they make up a whole token; but on pages
without an article or main element outside of such elements, those that hold the core or most of
the text stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags, roles and words in class or id of what is no part of an article; words that may stand beside these in a token.
CUT_TAGS = frozenset("head nav header footer aside form script style noscript template iframe object embed svg canvas audio video map button select option textarea input label dialog menu title".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promos promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar sidebars aside widget widgets related recommended share sharing social cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login form search comment comments commentlist disqus reply replies pagination pager toolbar skip hidden".split()
)
BESIDE_WORDS = frozenset("left right top bottom box bar list links area block".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | CUT_TAGS
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An element of the key's kind ends at the start of one of these, up to a scope that holds it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
NEVER = frozenset(("html", "body", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "doubtful", "block", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", cut: bool = False, doubtful: bool = False):
        self.tag, self.parent, self.cut, self.doubtful, self.children = tag, parent, cut, doubtful, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.block = tag in BLOCKS


class Tree(HTMLParser):
    """A tolerant tree: missing end tags are implied, stray ones ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("body", None)
        self.open: Counter[str] = Counter()  # elements from the root to here, by tag

    def _close(self, node: Node) -> None:
        """Ends all open elements up to this one."""
        while self.now is not node:
            self.open[self.now.tag] -= 1
            self.now = self.now.parent
        self.open[node.tag] -= 1
        self.now = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag in BLOCKS:
            self._end({"p"}, BLOCKS - {"p"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        node = Node(tag, self.now, tag in CUT_TAGS or _is_cut(tag, attrs), _is_doubtful(tag, attrs))
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as browsers do, "/>" ends only void elements

    def _end(self, tags, scope):
        if not any(self.open[t] for t in tags):
            return
        node = self.now
        while node.parent is not None and node.tag not in scope | tags:
            node = node.parent
        if node.parent is not None and node.tag in tags:
            self._close(node)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return  # a stray one; no walk to the root
        node = self.now
        while node.tag != tag:
            node = node.parent
        self._close(node)

    def handle_data(self, data):
        self.now.children.append(data)


def _is_cut(tag: str, attrs) -> bool:
    if tag in NEVER:
        return False
    found = dict(attrs)
    return found.get("role") in CUT_ROLES or "hidden" in found or found.get("aria-hidden") == "true"


def _is_doubtful(tag: str, attrs) -> bool:
    """Whether a whole token of class or id says that this is no part of an article."""
    if tag in NEVER:
        return False
    found = dict(attrs)
    for token in f"{found.get('class') or ''} {found.get('id') or ''}".split():
        words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()))
        if words & CUT_WORDS and words <= CUT_WORDS | BESIDE_WORDS:
            return True
    return False


def _order(root: Node) -> list[Node]:
    """All nodes that aren't cut, parents first."""
    out, i = [root], 0
    while i < len(out):
        out += [x for x in out[i].children if isinstance(x, Node) and not x.cut]
        i += 1
    return out


def _composite(chars: int, tags: int, link_chars: int, link_tags: int, whole: float) -> float:
    """Characters for each tag, times a logarithm that falls as more of them are in links; whole: the page's share of characters in links."""
    if not chars:
        return 0.0
    tags, link_tags = max(tags, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + whole * chars + math.e)
    return chars / tags * max(math.log(chars / max(link_chars, 1) * tags / link_tags + 1e-9) / base, 0.0)


def _measure(root: Node) -> list[Node]:
    nodes = _order(root)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.block = node.tag in BLOCKS
        for x in node.children:
            if isinstance(x, str):
                node.chars += len(" ".join(x.split()))
            elif not x.cut:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
                node.block = node.block or x.block
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    whole = root.link_chars / max(root.chars, 1)
    for node in reversed(nodes):
        node.density = _composite(node.chars, node.tags, node.link_chars, node.link_tags, whole)
        run, node.total = [0, 0, 0, 0], 0.0  # of the run of text between blocks: characters, tags, and those of links

        for x in node.children if node.block else ():
            if isinstance(x, str):
                run[0] += len(" ".join(x.split()))
            elif not x.cut and not x.block and x.tag != "br":
                run = [a + b for a, b in zip(run, (x.chars, x.tags + 1, x.link_chars, x.link_tags), strict=True)]
            elif not x.cut:
                node.total += _composite(*run, whole) + x.density
                run = [0, 0, 0, 0]
        node.total += _composite(*run, whole)
    return nodes


def _judge(root: Node) -> None:
    """Cuts the doubtful elements that hold nothing which speaks for them."""
    nodes = _measure(root)
    doubtful = [n for n in nodes if n.doubtful]
    if not doubtful:
        return
    kept, inside = set(), set()
    for n in nodes:  # parents first
        if n.doubtful or id(n.parent) in inside:
            inside.add(id(n))
    named = any(n.tag in ("article", "main") and n.chars and id(n) not in inside for n in nodes)
    for node in [] if named else [max(nodes, key=lambda n: n.total), *(n for n in doubtful if 2 * n.chars > root.chars)]:
        while node is not None and id(node) not in kept:
            kept.add(id(node))
            node = node.parent
    for n in doubtful:
        n.cut = id(n) not in kept


def _content(root: Node) -> list:
    """The article's subtrees and texts beside these, in page order."""
    _judge(root)
    nodes = _measure(root)
    core = max(nodes, key=lambda n: n.total)  # the first of equals, which is the outermost
    if not core.total:
        return [root]
    path = [core]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    least = min(n.density for n in path)
    named = max((i for i, n in enumerate(path) if n.tag in ("article", "main")), default=0)
    keep: set = {id(core)}  # nodes, and texts by their parent and place
    for i, (node, inner) in enumerate(zip(path[1:], path, strict=False), 1):
        follows = False  # whether what comes after belongs to the article
        for at in range(len(node.children) - 1, -1, -1):
            x = node.children[at]
            if x is inner:
                follows = True
            elif isinstance(x, str):
                if x.strip():
                    follows = i <= named or len(" ".join(x.split())) >= least
                    if follows:
                        keep.add((id(node), at))
            elif not x.cut and x.chars:
                if not (x.tag in HEADINGS and follows):
                    follows = 2 * x.link_chars <= x.chars if i <= named else x.density >= least
                if follows:
                    keep.add(id(x))
    if core is root:
        return [root]
    out, stack = [], [(root, (0, 0))]
    while stack:
        x, place = stack.pop()
        if place in keep or id(x) in keep and not isinstance(x, str):
            out.append(x)
        elif isinstance(x, Node):
            stack += [(y, (id(x), at)) for at, y in reversed(list(enumerate(x.children))) if isinstance(y, str) or not y.cut]
    return out


def extract(html: str | None) -> str:
    """The article's blocks, each with its white space collapsed, joined by two line ends."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    blocks: list[str] = []
    run: list[str] = []
    for top in _content(tree.root):
        edge = [None] if isinstance(top, Node) and top.block else []
        stack: list = edge + [top] + edge
        while stack:
            x = stack.pop()
            if x is None:
                blocks.append("".join(run))
                run.clear()
            elif isinstance(x, str):
                run.append(x)
            elif x.tag == "br":
                run.append(" ")
            elif not x.cut:
                edge = [None] if x.tag in BLOCKS else []
                stack += edge + list(reversed(x.children)) + edge
            elif x.tag in BLOCKS:
                stack.append(None)
    blocks.append("".join(run))
    found = [" ".join(b.split()) for b in blocks]
    return "\n\n".join(b for b in found if b)


def extracted(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """Adds text and n_chars to the pages. Null and empty pages, and pages without an article, give an empty text.

    Rows that are alike all stay; columns named text or n_chars are replaced, others are carried.
    """

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array([extract(x) for x in column.to_pylist()], pa.string())

    return pages.withColumn("text", text(F.col(f"`{html}`"))).withColumn("n_chars", F.char_length("text").cast("long"))


def digest(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row, as extracted() has them; null ids and URLs stay null, rows that are alike all stay, an empty table gives an empty one."""
    return extracted(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
