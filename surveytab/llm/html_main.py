"""The main text of web pages, by scoring the page's tree.

A page becomes a tree of its block elements. Menus, headers, footers, notices, adverts, forms,
scripts and comments of readers are cut out by element and by class, id or role, and so is what is hidden; by
names, as a form or as hidden not what holds all of the page's articles, nor what nearly all text is in. Every
paragraph passes points for its length and its commas to its ancestors: all to the parent, half to
the next, a third of that to those above, and so on. A container's points are discounted
by its link density. The best one is kept (or what is around it, if that has much more text
with few links), with the text directly around it and those of its siblings that score well too or are paragraphs or
articles of prose, and the headings before them.

The work on a page is proportional to its length, without recursion.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh, small_batches

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
# What is cut out, by element and by a word in class, id or role.
CUT = frozenset(
    "aside audio button canvas datalist dialog embed footer header iframe input map math menu meta nav "
    "noembed noframes noscript object script search select style svg template textarea title video head".split()
)
CUT_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|adv|advert|adverts|advertisement|advertisements|advertising|banner|banners|"
    r"breadcrumb|breadcrumbs|comment|comments|commentlist|complementary|consent|contentinfo|cookie|cookies|disqus|"
    r"footer|gdpr|header|masthead|menu|menus|modal|nav|navbar|navigation|newsletter|notice|notices|pager|pagination|"
    r"popup|promo|promos|promotion|related|replies|respond|search|share|sharing|sidebar|sidebars|skip|social|"
    r"sponsor|sponsored|sponsors|subscribe|toolbar|widget|widgets)(?:$|[^a-z])"
)
NEVER_CUT = frozenset(("html", "body", "main", "article"))
CONTAINERS = frozenset("article blockquote body dd details div figure html li main ol pre section table tbody td ul".split())

CLOSES_ALL = frozenset("article main body html table div section".split())  # also what is open inside a table or article
CELLS = frozenset(("dd", "li", "td"))  # their own text is a paragraph of what is around them

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
# These may also be what an article is about: they count as the first part of a name only, and cut no table.
OFTEN_CONTENT = frozenset("notice promotion related search share sharing social".split())
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)


LEAST_LEFT = 0.1  # share of a page's text that has to be left by cuts by name
MOST_NAMED = 0.5  # otherwise, share that one such element may have
WRAPPED = 1.5  # a parent with so many times the text of its best child is better


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "named", "points", "length", "linked", "blocks", "order")

    def __init__(self, tag: str, parent: Node | None, cut: bool, named: bool = False):
        self.tag, self.parent, self.cut, self.named = tag, parent, cut, named
        self.children: list[Node] = []
        self.blocks: list[tuple[int, str]] = []  # text directly in it: (place in the page, text)
        self.points, self.length, self.linked, self.order = 0.0, 0, 0, 0


def _named(tag: str, attributes: str) -> bool:
    """Is it a form, hidden, or called like something that is not the article? By the attributes hidden,
    aria-hidden, style, class, id and role alone."""
    if tag == "form":
        return True
    if tag in NEVER_CUT or not attributes:
        return False
    named = []
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style" and _UNSEEN.search(value):
            return True
        if name in ("class", "id", "role"):
            named += re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split()
    return any(_boilerplate(tag, n) for n in named)


def _boilerplate(tag: str, name: str) -> bool:
    """Does one of the names of an element tell that it is not the article?"""
    if not CUT_WORDS.search(name):
        return False
    first, *others = [w for w in re.split(r"[^a-z]+", name) if w] or [""]
    words = [w for w in (first, *others) if CUT_WORDS.search(w) and w not in OFTEN_CONTENT]
    return bool(words) or (first in OFTEN_CONTENT and tag != "table")


def _tree(html: str) -> tuple[Node, list[Node]]:
    """The root, and all block nodes in page order. Inline elements are no nodes: their text
    belongs to the block around them."""
    root = Node("html", None, False)
    nodes, stack, links, buffer, inline_cut = [root], [root], 0, [], []
    linked, place, at = [0], 0, 0
    opened: dict[str, list[int]] = defaultdict(list)  # places in the stack, by tag

    def flush() -> None:
        nonlocal place
        text = " ".join("".join(buffer).split())
        node = stack[-1]
        if text and not node.cut:
            place += 1
            node.blocks.append((place, text))
            node.length += len(text)
            node.linked += min(linked[0], len(text))
        buffer.clear()
        linked[0] = 0

    def add(text: str) -> None:
        if not inline_cut and not stack[-1].cut:
            text = unescape(text)
            buffer.append(text)
            if links:
                linked[0] += len(text.strip())

    def last(tags) -> int:
        """The place in the stack of the last open element of these tags; 0 without one."""
        return max((opened[t][-1] for t in tags if opened[t]), default=0)

    def leave(place: int) -> None:
        flush()
        while len(stack) > place:
            opened[stack.pop().tag].pop()

    def close(tags, until) -> None:
        at = last(tags)
        if at and at > last(until - tags):
            leave(at)

    end = len(html)
    while at < end:
        sign = html.find("<", at)
        if sign < 0:
            add(html[at:])
            break
        m = _TOKEN.match(html, sign)
        if m is None:  # a plain <
            add(html[at : sign + 1])
            at = sign + 1
            continue
        if sign > at:
            add(html[at:sign])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if at >= end and not html.endswith(">"):  # cut off within a tag
            break
        if tag == "br" or tag == "wbr":
            buffer.append("\n" if tag == "br" else "")
            continue
        if tag in RAW and not closing:
            over = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = over.end() if over else end
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            if closing:
                if inline_cut and inline_cut[-1] == tag:
                    inline_cut.pop()
            elif inline_cut:
                if tag == inline_cut[0]:
                    inline_cut.append(tag)
            elif tag != "img" and (tag in CUT or _named(tag, attributes)):
                inline_cut.append(tag)
            continue
        inline_cut.clear()
        links = 0
        if closing:
            at_tag = last((tag,))
            around = 0 if tag in CLOSES_ALL else last(("table", "article", "main"))
            if at_tag and at_tag >= around:
                leave(at_tag)
            elif not around:
                flush()
            continue
        if tag in ("html", "body"):
            flush()
            if tag == "body" and stack[-1] is root:
                node = Node("body", root, False)
                root.children.append(node)
                nodes.append(node)
                opened["body"].append(len(stack))
                stack.append(node)
            continue
        if tag in CLOSES_P:
            close({"p"}, CONTAINERS)
        if tag in SAME_LEVEL:
            close(*SAME_LEVEL[tag])
        flush()
        if tag in VOID:
            continue
        if tag == "head":
            continue
        # An article's own header has its headline.
        cut = tag in CUT and not (tag == "header" and opened["article"])
        node = Node(tag, stack[-1], stack[-1].cut or cut, _named(tag, attributes))
        node.order = len(nodes)
        stack[-1].children.append(node)
        nodes.append(node)
        if not attributes.rstrip().endswith("/") or tag not in ("svg", "path"):
            opened[tag].append(len(stack))
            stack.append(node)
    flush()
    return root, nodes


def _cut_named(nodes: list[Node]) -> None:
    """Cut out by name, but for what holds all articles, or too much of the text."""
    length, articles = [n.length for n in nodes], [int(not n.cut and n.tag in ("article", "main")) for n in nodes]
    for i, node in enumerate(nodes):
        node.order = i
    for i in range(len(nodes) - 1, 0, -1):
        length[nodes[i].parent.order] += length[i]
        articles[nodes[i].parent.order] += articles[i]
    most = length[0]
    for limit in (most, MOST_NAMED * most, -1):
        cut = [n.cut for n in nodes]
        left = nodes[0].length
        for i, node in enumerate(nodes[1:], 1):
            holds = articles[0] > 0 and articles[i] == articles[0]
            cut[i] = cut[i] or cut[node.parent.order] or (node.named and not holds and length[i] <= limit)
            left += 0 if cut[i] else node.length
        if left >= LEAST_LEFT * most:
            break
    for node, c in zip(nodes, cut):
        node.cut = c


def _score(nodes: list[Node]) -> None:
    """Points of paragraphs to their ancestors; lengths summed up."""
    for node in nodes:
        if node.cut or not node.blocks:
            continue
        points = sum(1 + t.count(",") + min(len(t) / 100, 3) for _, t in node.blocks)
        points *= 1 - node.linked / max(node.length, 1)
        own = node.tag in CONTAINERS and node.tag not in CELLS or node.parent is None
        share, up = 1.0, node if own else node.parent
        step = 0
        while up is not None and share > 1e-3:
            up.points += points * share
            step += 1
            share = 0.5 if step == 1 else share / 3
            up = up.parent
    for node in reversed(nodes):
        if node.parent is not None and not node.cut:
            node.parent.length += node.length
            node.parent.linked += node.linked


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _texts(node: Node, out: list[tuple[int, str]]) -> None:
    """The text blocks below ``node``, but for lists of links that are not between paragraphs."""
    todo = [node]
    while todo:
        n = todo.pop()
        if n.cut:
            continue
        out.extend(n.blocks)
        prose = [i for i, c in enumerate(n.children) if c.tag == "p" and not c.cut and c.length and _density(c) <= 0.5]
        for i, c in enumerate(n.children):
            links = c.tag in ("ul", "ol", "table", "dl") and _density(c) > 0.5
            if not links or (prose and prose[0] < i < prose[-1]):
                todo.append(c)


def main_text(html: str | None) -> str:
    """The main text of a page: blocks in page order, joined by two line feeds."""
    if not html:
        return ""
    root, nodes = _tree(html)
    _cut_named(nodes)
    _score(nodes)
    best, best_score = None, 0.0
    for node in nodes:
        if node.cut or node.tag not in CONTAINERS:
            continue
        score = node.points * (1 - _density(node)) * (1.5 if node.tag in ("article", "main") else 1)
        if score > best_score:
            best, best_score = node, score
    if best is None:
        best = root
    while (  # text of the same kind in other wrappers
        best.parent is not None and not best.parent.cut and best.parent.length >= WRAPPED * best.length
        and _density(best.parent) < 0.25
    ):
        best = best.parent
    up = best
    while up is not None:  # what the page itself calls its article
        if up.tag in ("article", "main"):
            best = up
            if up.tag == "article":
                break
        up = up.parent
    out: list[tuple[int, str]] = []
    least = max(1.0, best.points * (1 - _density(best)) * 0.2)
    if best.parent is not None and not best.parent.cut and _density(best.parent) < 0.25:
        out.extend(best.parent.blocks)
    siblings = best.parent.children if best.parent is not None else [best]
    headings = []  # belong to what comes after them
    for node in siblings:
        if node.cut:
            continue
        if node.tag in HEADINGS:
            headings.append(node)
            continue
        prose = node.tag in ("p", "article") and node.length and _density(node) < 0.25
        if node is best or prose or node.points * (1 - _density(node)) >= least and node.tag in CONTAINERS:
            for kept in (*headings, node):
                _texts(kept, out)
        elif not node.length:
            continue
        headings = []
    return "\n\n".join(t for _, t in sorted(out))


def extracted(pages: DataFrame) -> tuple[DataFrame, str]:
    """``pages`` with one more column, and its name (``text``, with underscores if the
    table has one): the main text of ``html``, empty for a null or empty page or one without text."""
    name, at = fresh(pages, "text"), pages.columns.index("html")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema) + f", `{name}` string"
    names = [*pages.columns, name]
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(h) for h in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names)

    return pages.mapInArrow(run, schema), name


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` (code points) for every row of ``pages``."""
    found, text = extracted(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col(text).alias("text"), F.length(text).cast("bigint").alias("n_chars"))
