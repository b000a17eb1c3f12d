"""Main text of web pages by tree scoring.

A forgiving tokenizer builds a tree of block elements. As the published readability heuristics have it, paragraphs pass
points for their length and commas to their ancestors (each gets half of what the one below it got), a container's points
are discounted by its link density, and the best container is kept with those siblings that read like part of the same
article. Markup that never is article text is left out before scoring. So are boxes whose names say nothing but that they
are menus, adverts, notices or comments, unless they hold the article, or all there is; a name that says more (a
layout that has a sidebar, the price of a share) only halves a box's points.

Defined results: null, empty or tag-only pages give "". White space inside a block becomes one space; blocks are joined
in page order by one line end. Nothing is capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import slices

# Names of HTML elements, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
SKIPPED = frozenset("head nav footer aside form svg math object audio video canvas button select option datalist dialog menu map figure-menu".split())
BLOCKS = frozenset("html body address article blockquote center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr legend li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()) | SKIPPED
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"} | {"table"}
# Elements that end an open sibling of the named kinds, up to the given container.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
# Words in class, id and role that mark a box as no part of the article, and those that mark the article.
COMMENTS = frozenset("comment comments commentlist respond disqus replies reply discussion".split())
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side header masthead footer foot notice notices cookie cookies consent gdpr alert popup modal overlay dialog newsletter subscribe subscription signup login share sharing social related recommended widget widgets toolbar pagination pager copyright disclaimer skip search complementary contentinfo legal".split()
)
LIKELY = frozenset("article content main body post entry story text".split())
# Words of names that say where or how a box is, those of boxes around everything, and those that turn a word.
NEUTRAL = frozenset("area bar bars block blocks body bottom box boxes btn button buttons card center col column container content desktop entry fixed form global group head heading holder icon icons inner item items left line link links list main message mobile module outer pane panel post posts primary region right row secondary section site slot small stories sticky story text thread title top unit wrap wrapper zone".split())
WRAPPERS = frozenset("app container layout page root site wrap wrapper".split())
TURNED = frozenset("has have with without no not is in".split())
HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
COMMA = re.compile("[,،、，;]")

#: A paragraph shorter than this passes no points.
MIN_CHARS = 25
#: Siblings with this share of the best container's points are kept.
SIBLING_SHARE = 0.2


class Node:
    __slots__ = ("tag", "names", "parent", "parts", "points", "scored", "order", "size", "linked", "raw", "doubt")

    def __init__(self, tag: str, names: frozenset[str], parent: Node | None):
        self.tag, self.names, self.parent, self.parts, self.points, self.scored = tag, names, parent, [], 0.0, False
        self.size = self.linked = self.doubt = 0
        self.raw = 0.0


#: How far an element's names tell against it.
DOUBTED, NAMED = 1, 2


def _names(attributes: str) -> tuple[frozenset[str], bool, int]:
    """The words in class, id and role, whether the element is hidden, and what its names say."""
    words: set[str] = set()
    hidden, doubt, around = False, 0, False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            for token in unescape(value).split():
                parts = [w.lower() for w in NAME_PARTS.findall(token)]
                words.update(parts)
                around |= bool(parts) and WRAPPERS.issuperset(parts)
                if not (UNLIKELY | COMMENTS).isdisjoint(parts):
                    more = [w for w in parts if len(w) > 1 and w not in UNLIKELY and w not in COMMENTS and w not in NEUTRAL]
                    doubt = max(doubt, DOUBTED if more or parts[0] in TURNED else NAMED)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN.search(value)):
            hidden = True
    if words & LIKELY and not words & COMMENTS:
        doubt = 0
    return frozenset(words), hidden, min(doubt, DOUBTED) if around else doubt


def _left_out(tag: str, in_article: bool) -> bool:
    return tag in SKIPPED or (tag == "header" and not in_article)


def tree(page: str) -> Node:
    """The page's block elements; a node's parts are child nodes and (text, linked) runs. What is left out isn't in it."""
    root = node = Node("html", frozenset(), None)
    last = page.rfind(">")
    out: Node | None = None  # the outermost element that is being left out
    depth = links = articles = 0
    open_tags: list[str] = []  # of elements inside what is left out
    at, n = 0, len(page)
    ended = {"-->": False, "]]>": False}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            if out is None:
                node.parts.append((unescape(page[at:lt]), links > 0))
            at = lt
            continue
        if at > last and (page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] in ("!", "/", "?")) and at + 1 < n:
            break  # markup that the page's end cuts off
        if page.startswith("<!--", at):
            end = -1 if ended["-->"] else page.find("-->", at + 4)
            if end < 0:
                ended["-->"] = True
                end = page.find(">", at)
                at = end + 1 if end >= 0 else n
            else:
                at = end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else n
            continue
        m = TAG.match(page, at)
        if not m:
            if out is None:
                node.parts.append(("<", links > 0))
            at += 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if not closing and tag in RAW:
            end = re.compile(rf"(?i)</{re.escape(tag)}\s*>").search(page, at)
            at = end.end() if end else (n if tag in ("script", "style") else at)
            continue
        if out is not None:
            # inside what is left out only its own end counts
            if tag == out.tag:
                depth += -1 if closing else (0 if tag in VOID or attributes.endswith("/") else 1)
            elif tag in ("body", "html") and closing:
                depth = 0
            elif not closing and out.tag == "p" and tag in CLOSES_P:
                depth, at = 0, m.start()
            if depth <= 0:
                out = None
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br" or tag == "hr":
            node.parts.append((" ", False))
        if closing:
            if tag in BLOCKS:
                links = 0 if tag != "p" else links
                up = node
                while up is not None and up.tag != tag:
                    up = up.parent
                if up is not None and up.parent is not None:
                    while node is not up:
                        articles -= node.tag in ("article", "main")
                        node = node.parent
                    articles -= node.tag in ("article", "main")
                    node = node.parent
            continue
        if tag in VOID or tag in ("html", "body"):
            continue
        if tag not in BLOCKS:
            if attributes and ("hidden" in attributes or "class" in attributes or "id" in attributes or "style" in attributes or "role" in attributes):
                names, hidden, doubt = _names(attributes)
                if hidden or doubt == NAMED:
                    out, depth = Node(tag, names, node), 1
            continue
        if tag in CLOSES_P:
            up = node
            while up is not None and up.tag not in ("p", *HEADINGS) and up.tag not in ("div", "article", "section", "td", "body", "li"):
                up = up.parent
            if up is not None and up.tag == "p":
                node = up.parent
            links = 0
        if tag in ENDS:
            kinds, until = ENDS[tag]
            up, found = node, None
            while up is not None and up.tag not in until:
                found = up if up.tag in kinds else found
                up = up.parent
            node = found.parent if found is not None else node
        names, hidden, doubt = _names(attributes) if attributes else (frozenset(), False, 0)
        child = Node(tag, names, node)
        child.doubt = 0 if tag in ("article", "main") and not names & COMMENTS else doubt
        if hidden or _left_out(tag, articles > 0):
            node.parts.append(("\n", False))
            if not attributes.endswith("/"):
                out, depth = child, 1
            continue
        node.parts.append(child)
        if not attributes.rstrip().endswith("/"):
            node = child
            articles += tag in ("article", "main")
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes, parents first."""
    found = [root]
    for x in found:
        found.extend(p for p in x.parts if isinstance(p, Node))
    return found


def _without_named(nodes: list[Node]) -> list[tuple[Node, int]]:
    """Takes boxes that are named as no part of the article out of the tree, but for those that hold an article; returns
    them with their places."""
    holding: set[int] = set()
    for x in nodes:
        if x.tag in ("article", "main") and not x.doubt:
            up = x.parent
            while up is not None and id(up) not in holding:
                holding.add(id(up))
                up = up.parent
    taken = []
    for x in nodes:
        for i, p in enumerate(x.parts):
            if isinstance(p, Node) and p.doubt == NAMED and id(p) not in holding:
                taken.append((p, i))
                x.parts[i] = ("\n", False)
    return taken


def _own_text(node: Node) -> str:
    return " ".join("".join(p[0] for p in node.parts if not isinstance(p, Node)).split())


def _measure(nodes: list[Node]) -> None:
    """Characters of text, and of linked text, below every node."""
    for x in reversed(nodes):
        x.size = x.linked = 0
        for p in x.parts:
            if isinstance(p, Node):
                x.size += p.size
                x.linked += p.linked
            else:
                size = len(" ".join(p[0].split()))
                x.size += size
                x.linked += size if p[1] else 0


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


# Points that a container has by its kind.
KIND_POINTS = {"article": 10.0, "main": 10.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "address": -3.0, "th": -5.0}


def score(nodes: list[Node]) -> Node | None:
    """Passes the paragraphs' points to their ancestors, half of what one gets to the next; the best container, or None
    if no paragraph has points. Children come before their parents, so depth costs nothing."""
    held = []
    for x in reversed(nodes):
        if x.tag not in HEADINGS and x.parent is not None:
            text = _own_text(x)
            if len(text) >= MIN_CHARS:
                to = x.parent if x.tag in ("p", "li", "dd", "dt", "td", "th", "pre", "blockquote", "figcaption", "summary") else x
                to.points += 1 + len(COMMA.findall(text)) + min(len(text) / 100, 3.0)
                to.scored = True
        if x.scored:
            held.append(x)
            if x.parent is not None:
                x.parent.scored = True
                x.parent.points += x.points / 2
    for x in held:
        x.raw = x.points * (1 - _density(x))
        x.points = (x.points + KIND_POINTS.get(x.tag, 0.0) + (25.0 if x.names & LIKELY else 0.0)) * (1 - _density(x)) * (0.5 if x.doubt else 1.0)
    return max(reversed(held), key=lambda x: x.points, default=None)


def _kept_siblings(best: Node) -> list[Node]:
    """The best container and the siblings that belong to its article, in page order."""
    if best.parent is None:
        return [best]
    least = SIBLING_SHARE * best.raw
    kept = []
    for x in best.parent.parts:
        if not isinstance(x, Node):
            continue
        text = _own_text(x) if x.tag == "p" else ""
        if x is best or (x.scored and x.raw + (least if x.names and x.names == best.names else 0) >= least) or (text and (len(text) > 80 and _density(x) < 0.25 or len(text) <= 80 and _density(x) == 0 and text.endswith((".", "!", "?", "。")))) or (x.tag == "h1" and _density(x) < 0.5):
            kept.append(x)
    return kept


def _blocks(node: Node, found: list[str]) -> None:
    """The text blocks below a node, in page order; lists that are mostly links are menus."""
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if text := " ".join(x.split()):
                found.append(text)
            continue
        if x.tag in ("ul", "ol", "dl") and x.size and _density(x) > 0.5:
            continue
        following: list = []
        run: list[str] = []
        for p in x.parts:
            if isinstance(p, Node):
                following += ["".join(run), p]
                run = []
            elif p[0] == "\n":
                following.append("".join(run))
                run = []
            else:
                run.append(p[0])
        stack.extend(reversed([*following, "".join(run)]))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    taken = _without_named(_walk(root))
    nodes = _walk(root)
    _measure(nodes)
    best = score(nodes)
    if not root.size and taken:  # there is nothing else
        for x, i in taken:
            x.parent.parts[i] = x
        nodes = _walk(root)
        _measure(nodes)
        best = score(nodes)
    while best is not None and best.parent is not None and best.parent.tag == "article":
        best = best.parent  # the article is the whole of what its parts belong to
    if best is None:
        best = max((x for x in nodes if x.tag in ("article", "main")), key=lambda x: x.size, default=root)
    found: list[str] = []
    for x in _kept_siblings(best):
        _blocks(x, found)
    return "\n".join(found)


def extract(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """The rows with the main text of ``html`` in ``text`` (replaced if there is one). A pure map; nulls in other
    columns and repeated rows are kept."""
    rest = [c for c in df.columns if c != text]
    kept = df.select(*(df[c].alias(f"c{i}") for i, c in enumerate(rest)))
    at = rest.index(html)
    schema = ", ".join([*(f"c{i} {kind}" for i, (_, kind) in enumerate(kept.dtypes)), "main string"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            texts = [main_text(page) for page in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "main"])

    return kept.mapInArrow(run, schema).toDF(*rest, text)
