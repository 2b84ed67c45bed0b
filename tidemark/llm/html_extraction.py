"""Main text of web pages by composite text density.

Every DOM node gets its link-adjusted characters per tag; a node's density sum is that of its block children. The subtree of
the maximum sum is the main text; the lowest density on the path from the body to it is the threshold at which further
subtrees beside that path belong to it too. An <article> element is one more feature: one around the chosen subtree, or
beside its path with an element that reaches the threshold, belongs to it whole.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of the HTML standard by role.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NEVER = {"script", "style", "noscript", "template", "iframe", "head", "title", "nav", "aside", "footer", "form", "button", "select", "option", "input", "textarea", "label", "menu", "dialog", "svg", "canvas", "object", "embed", "audio", "video", "noembed", "noframes", "search", "fieldset"}
ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "li", "dd", "dt"}
#: A start tag of the key ends an open element of the values, up to the limits.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class and id names, and ARIA roles, of what is not article text.
ASIDE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "banners", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "menus",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "outbrain", "pagination", "pager", "popup", "promo", "promos", "promoted", "promotion", "recommended", "related", "replies", "respond", "rss", "share", "sharing", "sidebar", "sidebars", "signup",
    "skip", "social", "sponsor", "sponsored", "sponsors", "subscribe", "subscription", "taboola", "teaser", "toolbar", "topbar", "tags", "widget", "widgets",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "alertdialog", "dialog", "toolbar"}
#: Words that say how or where such a part is shown. A name whose last word but for these is another ("share-price") is
#: about something else: there the density decides.
SHOWN = {
    "a", "area", "article", "articles", "author", "avatar", "bar", "block", "blocks", "body", "bottom", "box", "button", "buttons", "card", "cards", "cell", "col", "column", "container", "content", "contents", "count", "cta", "date", "desktop", "feed", "field", "fixed", "form", "frame", "global", "grid", "group",
    "heading", "holder", "icon", "icons", "image", "img", "inline", "inner", "item", "items", "label", "large", "layer", "left", "link", "links", "list", "main", "message", "meta", "mobile", "name", "news", "outer", "overlay", "page", "panel", "panels", "policy", "post", "posts", "primary", "prompt", "region", "right", "row", "secondary", "section",
    "site", "slot", "small", "space", "sticky", "stories", "story", "strip", "tab", "text", "thread", "title", "toggle", "top", "tower", "trigger", "unit", "units", "user", "wrap", "wrapper", "zone",
}
#: Names that begin so say what an element around the article has beside it, or hasn't. Elements that may wrap a page.
WITH, WRAPPERS = {"no", "without", "with", "has", "hide", "hides", "disable", "disabled"}, {"form", "fieldset"}
#: An element named ``header`` with one of these is the article's own title.
OWN_HEADER = {"article", "story", "post", "entry"}

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTR = re.compile(r"([^\s=/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s]+))?")
SPACES = re.compile(r"\s+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "kids", "aside", "soft", "weak", "block", "inside", "chars", "tags", "link_chars", "links", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, aside: int = 0):
        self.tag, self.parent, self.aside, self.soft, self.weak = tag, parent, 0 < aside < 3, aside == 2, aside == 3
        self.block = self if tag in BLOCK else parent and parent.block  # the nearest block around
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.sum = 0.0


def is_aside(tag: str, attrs: str, parent: Node) -> int:
    """1 for what is never article text; 2 for what isn't by its name or as a form, unless it wraps most of the page; 3 where
    a name has such a word beside its own subject, so that the density decides."""
    weak = 0
    if tag in WRAPPERS:
        return 2
    if tag in NEVER:
        return 1
    if tag == "header":  # an article's own header holds its title
        return int(not parent.inside)
    if not attrs or tag in ("body", "html", "main", "article"):
        return int(bool(attrs) and tag == "article" and "comment" in attrs.lower())
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
            return 1
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 1
        if name in ("class", "id"):
            for one in value.split():
                said = [w.lower() for w in WORD.findall(one)]
                hit = ASIDE_WORDS & set(said)
                if hit and said[0] not in WITH and not (hit == {"header"} and OWN_HEADER & set(said)):
                    subject = [w for w in said if w not in SHOWN]
                    if subject[-1] in ASIDE_WORDS:
                        return 2
                    weak = 3
    return weak


def tag_end(source: str, at: int, lost: set[str]) -> int:
    """Place of the ``>`` that ends a tag. A quote after ``=`` opens a value, up to the next such quote; where there is none
    (``lost`` then holds it, so that it isn't sought again), the tag ends at the first ``>``."""
    start = at
    while m := STOP.search(source, at):
        if m[0] == ">":
            return m.start()
        at, before = m.end(), m.start() - 1
        while before > start and source[before].isspace():
            before -= 1
        if source[before] == "=" and m[0] not in lost:
            if (close := source.find(m[0], at)) < 0:
                lost.add(m[0])
                first = source.find(">", start)
                return first if first >= 0 else len(source)
            at = close + 1
    return len(source)


def parse(source: str) -> Node:
    """A light DOM: unclosed and crossed tags end as browsers end them in the common cases; the rest is kept as it nests.
    Time is linear in the page but for climbing from a tag to what it ends, which ends it."""
    root = top = Node("html", None)
    at, end, lost, seen_body = 0, len(source), set(), False
    count: Counter[str] = Counter()  # open elements by name

    def leave(to: Node | None) -> None:
        """Closes elements up to and without ``to``."""
        nonlocal top
        while top is not to:
            count[top.tag] -= 1
            top = top.parent

    while at < end:
        to = source.find("<", at)
        if to < 0:
            to = end
        if to > at:
            top.kids.append(source[at:to])
        if to == end:
            break
        if source.startswith(("<!--", "<![CDATA[", "<!", "<?"), to):
            mark = "-->" if source.startswith("<!--", to) else "]]>" if source.startswith("<![CDATA[", to) else ">"
            at = source.find(mark, to + 2 + 2 * (mark == "-->"))
            at = end if at < 0 else at + len(mark)
            continue
        m = NAME.match(source, to + 1)
        if not m:
            top.kids.append("<")
            at = to + 1
            continue
        close = tag_end(source, m.end(), lost)
        attrs, at, tag = source[m.end() : close], close + 1, m[1].lower()
        if source[to + 1] == "/":
            if count[tag] > 0:
                x = top
                while x.tag != tag and not (tag == "p" and x.tag in BLOCK):
                    x = x.parent
                if x.tag == tag:
                    leave(x.parent)
            continue
        if tag in ("html", "body"):
            if tag == "body" and not seen_body:
                seen_body = True
                if count["head"] > 0:
                    leave(next(x for x in _up(top) if x.tag == "head").parent)
            continue
        if tag in VOID:
            top.kids.append(Node(tag, top, int(tag in NEVER)))
            continue
        if tag in ENDS_P and count["p"] > 0 and top.block.tag == "p":
            leave(top.block.parent)
        if tag in ENDS and any(count[x] > 0 for x in ENDS[tag][0]):
            ends, stop = ENDS[tag]
            x = top
            while x is not None and x.tag not in stop and x.tag not in ends:
                x = x.parent
            if x is not None and x.tag in ends:
                row = x if tag != "tr" or x.tag == "tr" else next((y for y in _up(x) if y.tag in ("tr", "table")), x)
                leave(row.parent if row.tag != "table" else x.parent)
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" and len(top.tag) == 2 and top.tag[0] == "h" and top.tag[1] in "123456":
            leave(top.parent)
        node = Node(tag, top, is_aside(tag, attrs, top))
        top.kids.append(node)
        if tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = found.end() if found else end
        elif not attrs.endswith("/") or tag in BLOCK:
            top = node
            count[tag] += 1
    free_wrappers(root)
    return root


def free_wrappers(root: Node) -> None:
    """Elements that are aside by name, or forms, but hold over half of the page's text are the page: forms as they are,
    the others if a heading of the first level, a main or an article stands in them."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(k for k in x.kids if isinstance(k, Node) and (not k.aside or k.soft))
    if not any(x.soft for x in order):
        return
    held: dict[int, tuple[int, bool]] = {}
    for x in reversed(order):
        n, main = sum(len(k) - k.count(" ") for k in x.kids if isinstance(k, str)), x.tag in ("main", "h1") or x.tag == "article" and not x.aside
        for k in x.kids:
            if id(k) in held:
                n, main = n + held[id(k)][0], main or held[id(k)][1]
        held[id(x)] = n, main
    for x in order:
        if x.soft and 2 * held[id(x)][0] > held[id(root)][0] and (x.tag in WRAPPERS or held[id(x)][1]):
            x.aside = False


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _inner(node: Node) -> list[Node]:
    """Elements in the node that aren't aside, last first."""
    return [k for k in reversed(node.kids) if isinstance(k, Node) and not k.aside]


def _below(node: Node) -> Iterator[Node]:
    stack = _inner(node)
    while stack:
        x = stack.pop()
        yield x
        stack.extend(_inner(x))


def dense(node: Node, threshold: float) -> bool:
    return node.tag in BLOCK and node.density >= max(threshold, 1e-9)


def drop_thin(order: list[Node], path: set[int], threshold: float) -> None:
    """Elements with a weak name that the path doesn't cross go aside: blocks below the threshold, and links."""
    for x in order:
        if x.weak and id(x) not in path:
            x.aside = not dense(x, threshold) if x.tag in BLOCK else x.link_chars > 0


def measure(root: Node) -> list[Node]:
    """Fills in counts and densities of all nodes that aren't aside; returns them, parents first."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(k for k in reversed(x.kids) if isinstance(k, Node) and not k.aside)
    for x in reversed(order):
        for k in x.kids:
            if isinstance(k, str):
                x.chars += len(SPACES.sub(" ", k).strip())
            elif not k.aside:
                x.chars, x.tags, x.link_chars, x.links = x.chars + k.chars, x.tags + k.tags + 1, x.link_chars + k.link_chars, x.links + k.links
        if x.tag == "a":
            x.link_chars, x.links = x.chars, x.links + 1
    whole = root.link_chars / max(root.chars, 1)
    for x in order:
        c, t, lc, lt = x.chars, max(x.tags, 1), x.link_chars, max(x.links, 1)
        if c:
            # Composite density: characters per tag, damped by the share of link text; the base of the logarithm grows with it.
            base = math.log(c / max(c - lc, 1) * lc + whole * c + math.e)
            x.density = c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0) + 1e-9) / math.log(max(base, 1.0) + 1.0) if lc < c else 0.0
            x.density = max(x.density, 0.0)
    for x in order:
        x.sum = sum(k.density for k in x.kids if isinstance(k, Node) and not k.aside and k.tag in BLOCK)
    return order


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below the nodes, in page order, white space folded."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        if part and (text := SPACES.sub(" ", html.unescape("".join(part))).strip()):
            out.append(text)
        part.clear()

    for node in nodes:
        stack: list[Node | str | None] = [node]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                part.append(x)
            elif x.tag == "br":
                part.append(" ")
            elif not x.aside:
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(x.kids))
        flush()
    return out


def extract(source: str | None) -> str:
    """Main text of one page; empty for null, empty and text-free pages."""
    if not source:
        return ""
    root = parse(source.replace("\x00", ""))
    order = measure(root)
    best = max(order, key=lambda x: x.sum)
    if best.sum <= 0:  # no element holds text: what is there stands directly in the body
        best = root
    threshold = min(x.density for x in _up(best))
    while best.parent is not None and best.tag not in BLOCK:
        best = best.parent
    best = next((x for x in _up(best) if x.tag == "article"), best)
    path = set(map(id, _up(best)))
    drop_thin(order, path, threshold)
    chosen: list[Node] = []
    stack = [root]
    while stack:
        x = stack.pop()
        if x is best or id(x) not in path and (dense(x, threshold) or x.tag == "article" and any(dense(y, threshold) for y in _below(x))):
            chosen.append(x)
        elif id(x) in path or x.tag != "article":
            stack.extend(_inner(x))
    return "\n".join(blocks(chosen))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row of ``pages``, from the whole html; no shuffle.

    Null and empty html give an empty text. Keys and urls pass through as they are, null or repeated. Parsing uses
    explicit stacks and looks for no quote twice, so deep nesting and very long pages are bounded by their own size. Extra
    columns are ignored; an empty table gives no rows.
    """
    fields = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, batch.schema.field(2).type), pa.array(map(len, text), pa.int64())], names=[key, url, "text", "n_chars"])

    return pages.select(key, url, source).mapInArrow(run, f"`{key}` {fields[key]}, `{url}` {fields[url]}, text string, n_chars long")
