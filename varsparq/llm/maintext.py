"""Main text of HTML pages by tree scoring.

Paragraphs pass points, for their length and commas, to their ancestors, fewer the farther; a container's points are
discounted by the share of its text that is links. The best container is kept with all beside it but boilerplate and
blocks of links, on its own level and on those above it up to the last that holds further paragraphs; an article or main
element around it is taken whole. Elements that are never content (menus, forms, scripts) are dropped beforehand. A class,
id or role that names such a thing drops an element too, unless the element holds so much of the page's text that the name
must mean something else: nearly all of it where the name says nothing else (comments-list), more than a quarter where it
does (cookie-recipe). Names that deny (no-sidebar, has-header) don't count, and those of content (post, article) make an
element stay unless it is an advert or full of links.

Defined cases: a null or empty page has an empty text. Unclosed and stray tags, comments and scripts are read as browsers
do for the common cases (a paragraph ends where a block begins). A page without paragraphs gives the text of its body.
Very long and very deep pages are read whole, in time that grows with their length.
Repeated rows and rows with null ids are read one by one. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from varsparq.llm.shared import map_texts

#: Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("br option body caption dialog head html legend tbody td tfoot th thead tr".split())
DROPPED = frozenset("aside button datalist dialog footer form head header iframe input menu nav noscript object optgroup option script select style svg template textarea title video audio canvas math map".split())
PARAGRAPHS = frozenset("p pre td blockquote dd".split())
#: Words in a class, id or role that name what isn't content.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification "
    "outbrain pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe taboola toolbar widget alert complementary".split()
)
#: Words that turn a name into its opposite or say what else is there; words that say only where or how; words of content; words that outweigh those.
DENIED = frozenset("no non not has have with without free".split())
PLACES = frozenset("area bar block body bottom box button buttons class col column container content fixed full group holder inner item left link links list main outer panel region right row section site slot text title top unit wide wrap wrapper".split())
CONTENT = frozenset("article content entry main post story".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising banner consent cookie cookies gdpr newsletter outbrain popup promo promoted promotion sponsor sponsored subscribe taboola".split())
#: Shares of the page's text up to which a name decides: alone, and with other words beside it; share of links that settles it.
ALONE, BESIDE, LINKED = 0.9, 0.25, 0.5
_NAME, _STOP = re.compile(r"/?[a-zA-Z][^\s/>]*"), re.compile(r"[>\"']")
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPLIT, _CASE, _COMMENT = re.compile(r"[^a-z0-9]+"), re.compile(r"(?<=[a-z0-9])(?=[A-Z])"), re.compile(r"--!?>")
#: Elements that a tag closes, and those that keep it from closing what is outside of them.
_CLOSED = [
    ({"p"}, {"table", "button", "td", "th", "caption"}, CLOSES_P),
    ({"li"}, {"ul", "ol", "menu"}, {"li"}),
    ({"dt", "dd"}, {"dl"}, {"dt", "dd"}),
    ({"tr", "td", "th"}, {"table"}, {"tr"}),
    ({"td", "th"}, {"tr", "table"}, {"td", "th"}),
    ({"option"}, {"select"}, {"option"}),
]
#: A bit for each line above. By tag: bits that it opens, bits that it hides, lines that it closes.
_OPENS = {t: sum(1 << k for k, (closed, _, _) in enumerate(_CLOSED) if t in closed) for closed, _, _ in _CLOSED for t in closed}
_HIDES = {t: sum(1 << k for k, (_, scope, _) in enumerate(_CLOSED) if t in scope) for _, scope, _ in _CLOSED for t in scope}
_BY_TAG = {t: [k for k, (_, _, by) in enumerate(_CLOSED) if t in by] for _, _, by in _CLOSED for t in by}


class Node:
    __slots__ = ("children", "commas", "drop", "holds", "links", "named", "open", "parent", "score", "size", "tag")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children = tag, parent, []  # children: nodes and texts
        self.drop, self.score, self.size, self.links, self.commas = False, 0.0, 0, 0, 0
        self.named = 0.0  # share of the page's text up to which its name drops it
        self.holds = tag in ("article", "main")  # itself or below
        self.open = (parent.open if parent is not None else 0) & ~_HIDES.get(tag, 0) | _OPENS.get(tag, 0)  # lines of _CLOSED open in scope


def _named(attributes: str) -> float:
    """The share of a page's text up to which the names of an element drop it; 0 if they don't."""
    found, content, alone, advert = False, False, False, False
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w for w in _SPLIT.split(_CASE.sub(" ", name).lower()) if w and not w.isdigit()]
            if not DENIED.isdisjoint(words):
                continue
            content = content or not CONTENT.isdisjoint(words)
            if not NAMED.isdisjoint(words):
                found = True
                alone = alone or all(w in NAMED or w in PLACES for w in words)
                advert = advert or not ADVERTS.isdisjoint(words)
    if not found:
        return 0.0
    return (BESIDE if advert else 0.0) if content else ALONE if alone else BESIDE


def _boilerplate(tag: str, attributes: str) -> tuple[bool, float]:
    """Whether an element is never content, and the share of text up to which it isn't because of its names."""
    if tag == "form":
        return False, ALONE  # some pages are a form as a whole
    if tag in DROPPED:
        return True, 0.0
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, 0.0
    if _HIDDEN.search(attributes):
        return True, 0.0
    return False, _named(attributes)


class _Tags:
    """The tags of a page in order. Every character is looked at a bounded number of times, however broken the page is."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}  # nothing to look for behind these

    def find(self, c: str, at: int) -> int:
        return self.page.find(c, at) if at <= self.last[c] else -1

    def end(self, at: int) -> int:
        """The > that ends a tag, past quoted values; a quote that is never closed is a plain character. -1 without one."""
        while at <= self.last[">"]:
            m = _STOP.search(self.page, at)
            if m[0] == ">":
                return m.start()
            close = self.find(m[0], m.end())
            at = (close if close >= 0 else m.start()) + 1
        return -1

    def next(self, at: int) -> tuple[int, str, str, int] | None:
        """(start, name with / before it when closing, attributes, end) of the next tag, the name empty for comments and the like."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                for short in (">", "->"):
                    if page.startswith(short, start + 4):
                        return start, "", "", start + 4 + len(short)
                close = _COMMENT.search(page, start + 4)
                return start, "", "", close.end() if close else len(page)
            if page[start + 1 : start + 2] in ("!", "?"):
                close = self.find(">", start)
                if close >= 0:
                    return start, "", "", close + 1
            elif (m := _NAME.match(page, start + 1)) and (close := self.end(m.end())) >= 0:
                return start, m[0].lower(), page[m.end() : close], close + 1
            at = start + 1
        return None


def parse(page: str) -> Node:
    """The tree of a page, with boilerplate elements marked."""
    root = node = Node("html", None)
    tags, at, end = _Tags(page), 0, len(page)
    open_: dict[str, int] = {}  # elements open around the place by name

    def leave(node: Node, names: frozenset[str] | set[str]) -> Node:
        """The parent of the nearest element of these names; one of them is open."""
        while True:
            open_[node.tag] -= 1
            if node.tag in names:
                return node.parent
            node = node.parent

    while at < end:
        found = tags.next(at)
        text = page[at : found[0] if found else end]
        if text:
            node.children.append(entities.unescape(text))
        if not found:
            break
        _, tag, attributes, at = found
        if tag[:1] == "/":
            if open_.get(tag[1:]):
                node = leave(node, {tag[1:]})
        elif tag:
            for k in _BY_TAG.get(tag, ()):
                if node.open >> k & 1:
                    node = leave(node, _CLOSED[k][0])
            child = Node(tag, node)
            child.drop, child.named = _boilerplate(tag, attributes)
            node.children.append(child)
            if tag in RAW:
                close = re.compile(f"</{tag}", re.I).search(page, at)
                close = tags.find(">", close.end()) if close else -1
                at = close + 1 if close >= 0 else end
            elif tag not in VOID and not attributes.rstrip().endswith("/"):
                open_[tag] = open_.get(tag, 0) + 1
                node = child
    return root


def _measure(root: Node) -> list[Node]:
    """Nodes in page order, with sizes of texts and links and commas below them; what holds an article isn't dropped."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    for node in reversed(order):
        below = [c for c in node.children if isinstance(c, Node)]
        if any(c.holds for c in below):
            node.holds = True
            node.drop = node.drop and node.tag in DROPPED
        _count(node, below)
    total = max(root.size, 1)
    within = {id(root): False}  # in an article or main
    for node in order[1:]:
        within[id(node)] = within[id(node.parent)] or node.tag in ("article", "main")
        if node.named and not node.holds and node.size:
            outside = root.holds and not within[id(node)]  # there is an article, and this isn't in it
            linked = node.links >= LINKED * node.size and node.size < ALONE * total
            node.drop = node.drop or outside or linked or node.size <= node.named * total
    for node in reversed(order):
        node.size = node.links = node.commas = 0
        _count(node, [c for c in node.children if isinstance(c, Node)])
    return order


def _count(node: Node, below: list[Node]) -> None:
    if not node.drop:
        own, below = [c for c in node.children if isinstance(c, str)], [c for c in below if not c.drop]
        node.size = sum(len(c.strip()) for c in own) + sum(c.size for c in below)
        node.commas = sum(c.count(",") for c in own) + sum(c.commas for c in below)
        node.links = node.size if node.tag == "a" else sum(c.links for c in below)


def _text(node: Node) -> str:
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.drop:
            if x.tag in BLOCKS:
                out.append(" ")
                todo.append(" ")
            todo += reversed(x.children)
    return "".join(out)


def _runs(parent: Node, node: Node) -> list[list[Node | str]]:
    """The children of ``parent`` without boilerplate: blocks and ``node`` alone, what stands between them together."""
    out: list[list[Node | str]] = [[]]
    for c in parent.children:
        if isinstance(c, Node) and (c is node or c.tag in BLOCKS):
            out += [[] if c.drop else [c], []]
        elif isinstance(c, str) or not c.drop:
            out[-1].append(c)
    return [r for r in out if r]


def _beside(best: Node, keep: Callable[[int, int, float], bool]) -> str:
    """The text of ``best`` and of what ``keep`` takes (by size, size of links and worth) beside it and beside what holds it."""
    node, before, behind, take = best, [], [], (0, 0)  # parts before (the nearest first) and behind; how many of them count
    more = False
    while node.parent is not None and node.tag != "body":
        sides = [[], []]
        side = sides[0]
        useful = not more
        for run in _runs(node.parent, node):
            if run[0] is node:
                side = sides[1]
                continue
            size = sum(len(c.strip()) if isinstance(c, str) else c.size for c in run)
            links = sum(c.links for c in run if isinstance(c, Node))
            score = sum(c.score for c in run if isinstance(c, Node))
            if size and keep(size, links, score * (1 - links / size)):
                side.append("".join(map(_text, run)))
                useful = useful or score > 0 or any(c.tag in PARAGRAPHS for c in run if isinstance(c, Node))
        before += reversed(sides[0])
        behind += sides[1]
        if useful:
            take, more = (len(before), len(behind)), True
        node = node.parent
    return " ".join([*reversed(before[: take[0]]), _text(best), *behind[: take[1]]])


def main_text(page: str | None) -> str:
    """The main text of one whole page."""
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    hidden: set[int] = set()
    scored = []
    for node in order:
        if node.drop or (node.parent is not None and id(node.parent) in hidden):
            hidden.add(id(node))
            continue
        blocks = any(isinstance(c, Node) and c.tag in BLOCKS and c.tag != "br" for c in node.children)
        if not node.size or not (node.tag in PARAGRAPHS or (node.tag in ("div", "section", "article") and not blocks)):
            continue
        points = 1 + min(node.size / 100, 3) + node.commas
        target, part = (node if node.tag not in PARAGRAPHS else node.parent), 1.0
        while target is not None and part > 0.1:
            if not target.score:
                scored.append(target)
            target.score += points * part
            target, part = target.parent, part / 2
    if not scored:
        return " ".join(_text(root).split())
    worth = lambda n: n.score * (1 - n.links / max(n.size, 1))
    best = max(scored, key=worth)
    whole = best
    while whole is not None and whole.tag not in ("article", "main"):
        whole = whole.parent
    if whole is not None:
        articles = [n for n in whole.parent.children if isinstance(n, Node) and n.tag == "article"] if whole.parent is not None and whole.tag == "article" else [whole]
        kept = [n for n in articles if n is whole or worth(n) >= 0.2 * worth(whole)]
        return " ".join(" ".join(map(_text, kept)).split())
    return " ".join(_beside(best, lambda size, links, value: links < 0.25 * size or value >= 0.2 * worth(best)).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html)."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_texts(pages.select("page_id", "url", "html"), rows, f"page_id {kind}, url string, text string, n_chars long")
