"""Main text of web pages by tree scoring.

Every paragraph passes points for its length and commas to its ancestors, less with each level; a
container's points are discounted by its link density. If the best container stands in an article (an article or main
element, else an element named so by its class), all of that is kept but for siblings that are mostly links; else the best
container, the headings before it, those of its siblings that score well or are prose, and lists behind it. Parts that are furniture by
element or by class (menus, adverts, comments, forms, ...) go; a part named by a word that may also name an article (legal, notice, ...) stays where a page has no other text. The blocks are joined by a line feed.

Defined results: null or empty html, or a page without article text, gives the empty string; unclosed
elements end with their parent or at the next block; a comment, script or tag that never ends hides the
rest of the page; pages of any length take time in proportion to it; repeated rows are extracted one by one; an empty table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "page_id long, url string, text string, n_chars long"
#: Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
CHOICES = frozenset("select datalist optgroup option".split())
DROPPED = frozenset("head nav footer aside form button menu object canvas audio video".split()) | RAW | CHOICES
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article blockquote body center details div figure header main section table tbody td tr html".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Siblings of the best container that go with it if they are prose, or lists and the like without links.
PROSE, LISTS = frozenset("p div section".split()), frozenset("ul ol dl table pre blockquote".split())
#: Elements whose start ends an open one of the second set, up to the nearest of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
}
#: Elements whose start ends an open paragraph are blocks that CLOSES doesn't have; headings end headings too. Other blocks hide an open one.
HIDES_PARAGRAPHS = BLOCKS - HEADINGS - {"p"}
SCOPED = HEADINGS | {"p"} | frozenset(CLOSES)
#: The names that an element's start hides from elements inside it.
HIDES = {name: frozenset((*(x for ends, stop in CLOSES.values() if name in stop for x in ends), *((*HEADINGS, "p") if name in HIDES_PARAGRAPHS else ()))) for name in BLOCKS | CHOICES | {"menu"}}
#: Words in a class, id or role that name furniture.
FURNITURE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|banners?|breadcrumbs?|comments?|cookies?|consent|disqus|footers?|menus?|nav|navbar|navigation|newsletters?|notices?|pagers?|pagination|popups?|promos?|promotions?|related|remarks?|replies|respond|search|shar(?:e|ing)|sidebars?|social|sponsor(?:ed|s)?|subscribe|subscription|toolbars?|widgets?|masthead|complementary|contentinfo|modal|alert|legal)(?:$|[\s_-])", re.I)
#: Words beside a furniture word that make it a state of something else: no-sidebar, page-with-ads, comments-open.
STATE = re.compile(r"(?:^|[_-])(?:no|not|has|have|with|without|hide|hides|show|shows|is|are)(?:[_-]|$)|[_-](?:open|opened|closed|enabled|disabled|on|off|left|right)$", re.I)
#: Furniture that is never taken for an article, even where a page has nothing else.
NEVER = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|comments?|cookies?|consent|disqus|footers?|menus?|nav|navbar|navigation|remarks?|replies|respond|sponsor(?:ed|s)?)(?:$|[\s_-])", re.I)
CLOSING = re.compile(r"\W*(?:©|\(c\)|copyright\b|all rights\b)", re.I)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text)(?:$|[\s_-])", re.I)
NAMED_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|entry|post|story)(?:$|[\s_-])", re.I)
#: An attribute's name and value. All attributes match, so that a name inside another's value isn't read as one.
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|<""", re.S)
MIN_PARAGRAPH = 25
SIBLING_SHARE = 0.2


class Node:
    __slots__ = ("name", "parent", "parts", "chars", "commas", "linked", "score", "dropped", "bonus", "article", "articles", "depth", "block", "container", "scope", "inline", "why")

    def __init__(self, name: str, parent: Node | None, dropped: bool, bonus: float):
        self.name, self.parent, self.dropped, self.bonus = name, parent, dropped, bonus
        self.parts: list = []
        self.chars = self.commas = self.linked = self.articles = 0
        self.score = 0.0
        self.article = name in ("article", "main")
        self.depth = parent.depth + 1 if parent else 0
        #: The nearest block, itself included, and the nearest container above.
        self.block = self if parent is None or name in BLOCKS else parent.block
        self.container = None if parent is None else parent if parent.parent is None or parent.name in CONTAINERS else parent.container
        #: A block's open inline elements by name.
        self.inline: dict[str, int] = {} if self.block is self else self.block.inline
        #: The open element of each scoped name that a start may end.
        self.scope: dict[str, Node] = parent.scope if parent else {}
        if parent and (name in SCOPED or name in HIDES):
            self.scope = {k: v for k, v in self.scope.items() if k not in HIDES.get(name, ())}
            if name in SCOPED:
                self.scope[name] = self
        #: The class, id or role by which it or an element around it goes, in a list with the characters inside.
        self.why: list | None = parent.why if parent else None


def furniture(value: str) -> bool:
    """Whether one of the words of a class, id or role names furniture, and not a state of what it stands at."""
    return bool(FURNITURE.search(value)) and any(FURNITURE.search(x) and not STATE.search(x) for x in value.split())


def parse(html: str, spared: frozenset[str] = frozenset()) -> tuple[Node, list[list]]:
    """(a tree of elements and texts with the counts that scoring needs, what went by its class: [value, characters]).

    spared: values that don't count as furniture. Every step takes constant time but for elements that it ends.
    """
    root = node = Node("html", None, False, 0.0)
    at, size = 0, len(html)
    links = 0
    opened: dict[str, int] = {}
    gone: list[list] = []

    def end(last: Node) -> Node:
        """Ends all elements up to last."""
        nonlocal links
        up = node
        while up is not last.parent:
            links -= up.name == "a"
            opened[up.name] -= 1
            if up.block is not up:
                up.inline[up.name] -= 1
            up = up.parent
        return up

    while at < size:
        m = TOKEN.search(html, at)
        raw = html[at : m.start()] if m else html[at:]
        if m and m[0] == "<":
            raw += "<"
        if raw:
            text = unescape(raw) if "&" in raw else raw
            node.parts.append(text)
            n = len(text.strip())
            if not node.dropped:
                node.chars += n
                node.commas += text.count(",") + text.count("，") + text.count("、")
                if links:
                    node.linked += n
            elif node.why:
                node.why[1] += n
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:  # an inline element's end doesn't reach beyond its block
            if (opened if name in BLOCKS else node.inline).get(name):
                up = node
                while up.name != name:
                    up = up.parent
                node = end(up)
            continue
        if name == "html" or name == "body" and node is root:
            continue
        attrs = m[3]
        if name in RAW:
            if not attrs.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
                at = html.find(">", stop.start()) + 1 or size if stop else size
            continue
        if name in BLOCKS:  # no block stands in a list of choices, so one that was never closed ends here
            while node.name in CHOICES:
                node = end(node)
        if name in BLOCKS or name in CLOSES:
            ends = CLOSES[name][0] if name in CLOSES else HEADINGS | {"p"} if name in HEADINGS else {"p"}
            if open_ := [node.scope[x] for x in ends if x in node.scope]:
                node = end(min(open_, key=lambda x: x.depth))
        named, why = False, node.why
        dropped, bonus = node.dropped or name in DROPPED or (name == "header" and node.name in ("html", "body")) or (name == "dialog" and "open" not in attrs.lower()), 0.0
        if attrs and ("=" in attrs or "hidden" in attrs) and not dropped:
            for a in ATTRIBUTE.finditer(attrs):
                key, value = a[1].lower(), (a[2] or "").strip("\"'")
                if key == "hidden" or key == "aria-hidden" and value == "true":
                    dropped = True
                elif key in ("class", "id", "role"):
                    if name not in ("article", "main", "body") and value not in spared and furniture(value):
                        dropped, why = True, [value, 0]
                        gone.append(why)
                    elif ARTICLE.search(value):
                        bonus = 25.0
                        named = named or bool(NAMED_ARTICLE.search(value))
        if name in ("article", "main"):
            bonus = 25.0
        child = Node(name, node, dropped, bonus)
        child.article, child.why = child.article or named, why
        node.parts.append(child)
        if name in VOID or attrs.endswith("/"):
            continue
        node = child
        links += name == "a"
        opened[name] = opened.get(name, 0) + 1
        if child.block is not child:
            child.inline[name] = child.inline.get(name, 0) + 1
    return root, gone


def walk(root: Node) -> list[Node]:
    """All elements, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [x for x in reversed(n.parts) if isinstance(x, Node)]
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """The text of the given elements, cut at blocks; white space inside a block is one space."""
    out, run = [], []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not x.dropped:
            if x.name == "br":
                run.append(" ")
            elif x.name in BLOCKS:
                flush()
                todo.append(None)
                todo += reversed(x.parts)
            else:
                todo += reversed(x.parts)
    flush()
    return out


def article_of(best: Node) -> Node | None:
    """The nearest article or main element around best, or itself; else the outermost element named so that isn't a list of articles: no element
    named so stands in it beside those around best, and under a third of it are links."""
    around, node = [], best
    while node is not None:
        around.append(node)
        node = node.parent
    path, named = best.articles - best.article, []
    for n in around:
        path += n.article
        if n.article and n.articles == path and 3 * n.linked <= n.chars:
            named.append(n)
    return next((n for n in around if n.name in ("article", "main")), named[-1] if named else None)


def main_text(html: str | None) -> str:
    """Where furniture by class leaves no text, its part of most text is read as if it weren't any, until there is text; but for NEVER."""
    spared: frozenset[str] = frozenset()
    while html:
        root, gone = parse(html, spared)
        text = tree_text(root)
        most = max((x for x in gone if not NEVER.search(x[0])), key=lambda x: x[1], default=None)
        if text or most is None or not most[1]:
            return text
        spared |= {most[0]}
    return ""


def belongs(x: Node, best: Node, bar: float, begun: bool) -> bool:
    """Whether a sibling of the best container is a part of the article. begun: it stands behind the container's start."""
    density = x.linked / max(x.chars, 1)
    if x is best or x.score >= bar:
        return True
    if x.name in HEADINGS:
        return not begun and density < 0.5
    if x.name in LISTS:
        return begun and x.chars > 0 and not x.linked
    if x.name not in PROSE or x.name != "p" and not begun:
        return False
    text = "".join(blocks([x])) if x.chars <= 80 else ""
    return (x.chars > 80 and density < 0.25 or 0 < x.chars <= 80 and not x.linked and "." in text) and not CLOSING.match(text)


def tree_text(root: Node) -> str:
    nodes = [n for n in walk(root) if not n.dropped]
    own = {id(n): (n.chars, n.commas) for n in nodes}
    for n in reversed(nodes):  # children before parents
        p = n.parent
        n.articles += n.article
        if p is not None:
            p.chars += n.chars
            p.commas += n.commas
            p.linked += n.linked
            p.articles += n.articles
            if n.name not in BLOCKS:  # a paragraph's own text goes on in its inline elements
                a, b = own[id(p)]
                own[id(p)] = a + own[id(n)][0], b + own[id(n)][1]
    best, candidates = None, []
    for n in nodes:
        chars, commas = own[id(n)]
        if n.name not in PARAGRAPHS or not chars:
            continue
        points = min(chars / MIN_PARAGRAPH, 1.0) * (1 + commas + min(chars / 100, 3.0))
        up = n if n.name == "div" else n.container
        for share in (1, 2, 6, 9, 12, 15):
            if up is None:
                break
            if not up.score:
                candidates.append(up)
            up.score += points / share
            up = up.container
    for n in candidates:
        n.score = (n.score + n.bonus) * (1 - n.linked / max(n.chars, 1))
        if best is None or n.score > best.score:
            best = n
    if best is None:
        return "\n".join(blocks(nodes[:1]))
    if (whole := article_of(best)) is not None:
        inner = best
        while inner is not whole:
            for x in inner.parent.parts:
                if isinstance(x, Node) and x is not inner and x.name in BLOCKS and x.name not in HEADINGS and 2 * x.linked > x.chars:
                    x.dropped = True
            inner = inner.parent
        top = [whole]
    elif best.parent is None:
        top = [best]
    else:
        bar, top, begun = max(10.0, SIBLING_SHARE * best.score), [], False
        for x in best.parent.parts:
            if isinstance(x, Node) and not x.dropped:
                if belongs(x, best, bar, begun):
                    top.append(x)
                begun = begun or x is best
    return "\n".join(blocks(top))


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> RESULT. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, RESULT)
