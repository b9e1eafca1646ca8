"""The main text of web pages by tree scoring.

A page becomes a tree of elements. Every paragraph (a block with text of its own) passes points for its length and its
commas to its ancestors, less with each level, and discounted by the share of its text that is in links. The container
with most points is taken, up to the ``article`` or ``main`` that holds it, and those of its siblings which read like text
are kept beside it, at every level within ``main``. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out by element and role. Names (class, id) count only where a whole name says nothing else ("cookie-notice", not "cookie-recipes"),
never for headings, and not for what holds the page's articles, its only main heading or most of its paragraphs; names that sections of an article have too
("discussion") only lower a container's score, unless links or controls show what it is. Of the header of an article itself the headings stay.

Defined results: a null or empty page, and one without text, has the empty text; null ids and urls are kept; repeated rows give a row
each; an empty table an empty result; extra columns are not returned. A line break element is white space within its block. Of containers with
equal points the first in page order is taken. Pages of any length and depth are read whole, in time that grows with their length: the scanner never goes
back. A tag whose quote is never closed ends at its next ``>``, and a tag that never ends is dropped with the rest of the page.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Kinds of elements, as HTML has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
LEFT_OUT = frozenset("nav header footer aside script style noscript template iframe button select textarea input label dialog menu svg canvas object embed head title".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CONTROLS = frozenset("button select textarea input form".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SCOPE = ("table", "td", "th", "caption", "button", "template")
TABLE = frozenset("table caption colgroup thead tbody tfoot tr td th button template".split())
SECTIONS = ("article", "aside", "blockquote", "footer", "form", "header", "main", "nav", "section")
#: An open element of the first kind ends when one of the second kind starts, unless one of the third is between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", *SECTIONS, *SCOPE)), "dd": (("dd", "dt"), ("dl", *SECTIONS, *SCOPE)), "dt": (("dd", "dt"), ("dl", *SECTIONS, *SCOPE)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "a": (("a",), SCOPE),
}
# Words of names. A name counts if all its words are in these lists, by the strongest of them.
COMMENT_WORDS = frozenset("comment comments commentlist commentform disqus guestbook readercomments usercomments".split())
SURE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social newsletter subscribe subscription signup login popup modal toolbar pagination pager".split())
TALK_WORDS = frozenset("discussion feedback reactions reply replies respond response responses".split())
UNSURE_WORDS = TALK_WORDS | frozenset("side related recommended overlay widget skip".split())
NEUTRAL_WORDS = frozenset("site main page top bottom left right list wrapper wrap container box block area section item items link links button buttons bar row col inner outer holder group panel count text title icon icons module slot unit zone primary secondary global mobile desktop sticky floating post posts article articles entry entries story stories content more thread user users reader readers add leave new sub the to".split())
LAYOUT_WORDS = frozenset("wrap wrapper container main page content site".split())
OWN_HEADER = frozenset("post entry article content story".split())
GOOD_WORDS = frozenset("article content entry main post story text body".split())
TEASER_WORDS = frozenset("teaser teasers card preview excerpt promo related recommended".split())
COMMENT, SURE, UNSURE, PLAIN = 3, 2, 1, 0

_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"'=]*+)>")
_TAG_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTR = re.compile(r"""[\s/]*+(?:(?P<end>>)|(?P<name>[^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"(?P<a>[^"]*+)"|'(?P<b>[^']*+)'|(?P<c>[^\s>"'][^\s>]*+)|(?P<open>["'])|))?+)""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_READ = frozenset(["class", "id", "role", "hidden", "style", "aria-hidden"])


@functools.lru_cache(1 << 16)
def name_kind(name: str) -> int:
    """What one class or id says of an element."""
    words = [w.lower() for w in _WORD.findall(name)]
    words = [w for w in words if len(w) > 1]
    if not words or any(w not in COMMENT_WORDS and w not in SURE_WORDS and w not in UNSURE_WORDS and w not in NEUTRAL_WORDS for w in words):
        return PLAIN
    if any(w in COMMENT_WORDS for w in words):
        return COMMENT
    if any(w in SURE_WORDS for w in words):
        return PLAIN if "header" in words and not OWN_HEADER.isdisjoint(words) else SURE
    return UNSURE if any(w in UNSURE_WORDS for w in words) else PLAIN


class Node:
    __slots__ = ("articles", "attrs", "children", "commas", "controls", "h1", "length", "linked", "low", "out", "own", "own_linked", "paragraphs", "parent", "points", "tag", "total", "up")

    def __init__(self, tag: str, parent: Node | None, attrs: dict[str, str]):
        self.tag, self.parent, self.attrs, self.out, self.low = tag, parent, attrs, False, False
        self.up = parent if parent is None or parent.tag in BLOCK else parent.up  # the nearest block above
        self.children: list[Node | str] = []
        self.length = self.linked = self.own = self.own_linked = self.commas = self.h1 = self.articles = self.controls = self.paragraphs = 0
        self.points = self.total = 0.0

    def says(self) -> int:
        """What the names say; an id alone, which headings and sections get generated, says less than a class."""
        if not self.attrs or self.tag in HEADINGS or self.tag in ("html", "body", "main"):
            return PLAIN
        by_class = max(map(name_kind, self.attrs.get("class", "").split()), default=PLAIN)
        if by_class == UNSURE:
            by_class = SURE if TALK_WORDS.isdisjoint(self.words()) else COMMENT
        kind = max(by_class, name_kind(self.attrs["id"].strip()) if "id" in self.attrs else PLAIN)
        return kind if self.tag != "article" or kind == COMMENT else PLAIN

    def words(self) -> set[str]:
        return {w.lower() for w in _WORD.findall(f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}")} if self.attrs else set()


def _hidden(attrs: dict[str, str]) -> bool:
    return bool(attrs) and (attrs.get("role", "").strip().lower() in LEFT_OUT_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower())


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes that matter of a tag, read from behind its name, and where the tag ends (-1: never)."""
    attrs: dict[str, str] = {}
    while m := _ATTR.match(page, at):
        if m["end"]:
            return attrs, m.end()
        if m["open"]:
            at = page.find(">", m.end())
            return attrs, at + 1 if at >= 0 else -1
        if (name := m["name"].lower()) in _READ:
            attrs.setdefault(name, html.unescape(m["a"] or m["b"] or m["c"] or ""))
        at = m.end()
    return attrs, -1


def tokens(page: str) -> Iterator[tuple]:
    """("text", source), ("start", tag, attributes) and ("end", tag), in page order; of raw elements the start only."""
    at, n = 0, len(page)
    while at < n:
        k = page.find("<", at)
        if k < 0:
            yield "text", page[at:]
            return
        m = _PLAIN_TAG.match(page, k)
        if m:
            rest = m[3]
            attrs, end, closes, tag = ({w: "" for w in rest.lower().split() if w == "hidden"} if rest else {}), m.end(), m[1], m[2].lower()
        elif m := _TAG_START.match(page, k):
            closes, tag = m[1], m[2].lower()
            attrs, end = _attributes(page, m.end())
        else:
            mark, tag, closes, attrs = page[k + 1 : k + 2], "", "", {}
            if page.startswith("<!--", k):
                end = k + 5 if page.startswith("<!-->", k) else page.find("-->", k + 4) + 3
                end = -1 if end == 2 else end
            elif mark and mark in "!?/":
                end = page.find(">", k + 2) + 1 or -1
            else:  # a sign that is no tag
                yield "text", page[at : k + 1]
                at = k + 1
                continue
        if k > at:
            yield "text", page[at:k]
        if end < 0:
            return
        at = end
        if not tag:
            continue
        yield ("end", tag) if closes else ("start", tag, attrs)
        if tag in RAW and not closes:
            m = _raw_end(tag).search(page, at)
            at = page.find(">", m.end()) + 1 or n if m else n


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE)


class Tree:
    """Open elements, and where among them the elements of each tag are, so that nothing has to be looked for."""

    def __init__(self):
        self.root = Node("html", None, {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags; 0: none."""
        places = self.places
        return max((p[-1] for t in tags if (p := places.get(t))), default=0)

    def close(self, k: int) -> None:
        for node in self.open[k:]:
            self.places[node.tag].pop()
        del self.open[k:]

    def text(self, source: str) -> None:
        k = self.last("header")
        if k and not self.open[k].out and self.last(*HEADINGS, "hgroup") < k:
            return  # of an article's own header the headings stay
        self.open[-1].children.append(html.unescape(source) if "&" in source else source)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html" or tag == "body" and self.last("body"):
            return
        if tag in ENDS_P and (k := self.last("p")) and k > self.last(*SCOPE):
            self.close(k)
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            if (k := self.last(*ends)) > self.last(*stops):
                self.close(k)
        parent = self.open[-1]
        node = Node(tag, parent, attrs)
        node.out = tag in LEFT_OUT or tag in RAW or _hidden(attrs) and tag not in ("html", "body")
        if tag == "header" and (k := self.last("article", "main")) and not self.open[k].out and not _hidden(attrs):
            node.out = False
        parent.children.append(node)
        if tag not in VOID and tag not in RAW:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br", self.open[-1], {}))
            return
        k = self.last(*HEADINGS) if tag in HEADINGS else 0 if tag in ("html", "body") else self.last(tag)
        if k and k >= (self.last("table") if tag in TABLE else self.last(*SCOPE)):
            self.close(k)


def parse(page: str) -> Node:
    """A tree that closes what a browser would close for itself."""
    tree = Tree()
    for kind, *rest in tokens(page):
        getattr(tree, kind)(*rest)
    return tree.root


def blocks(node: Node) -> list[str]:
    """The text of each block below a node, in page order."""
    out: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(piece).split()):
            out.append(text)
        piece.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            piece.append(x)
        elif not x.out:
            if x.tag == "br":
                piece.append(" ")
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return out


def measure(root: Node) -> list[Node]:
    """Gives every element that isn't left out the sums of what is below it; returns these in page order."""
    order: list[tuple[Node, bool]] = []
    stack = [(root, False)]
    while stack:
        x, linked = stack.pop()
        linked = linked or x.tag == "a"
        order.append((x, linked))
        for c in reversed(x.children):
            if isinstance(c, Node):
                if c.out:
                    x.controls += c.tag in CONTROLS
                else:
                    stack.append((c, linked))
    for x, linked in reversed(order):
        for c in x.children:
            if isinstance(c, str):
                n = len(" ".join(c.split()))
                if n:
                    x.length += n
                    x.own += n
                    x.linked += n * linked
                    x.own_linked += n * linked
                    x.commas += c.count(",") + c.count("،") + c.count("，")
            elif not c.out:
                x.length += c.length
                x.linked += c.linked
                x.h1 += c.h1 + (c.tag == "h1")
                x.articles += c.articles + (c.tag in ("article", "main") and c.says() != COMMENT)
                x.controls += c.controls + (c.tag in CONTROLS)
                x.total += c.total
                x.paragraphs += c.paragraphs
                if c.tag not in BLOCK:
                    x.own += c.own
                    x.commas += c.commas
                    x.own_linked += c.own_linked
        if x.tag in BLOCK and x.own:
            x.total += points(x)
            x.paragraphs += 1
    return [x for x, _ in order]


def points(x: Node) -> float:
    """Of a paragraph: 1, more for commas and length, discounted by link density."""
    return (1 + x.commas + min(x.own / 100, 3)) * (1 - x.own_linked / x.own)


def leave_out(root: Node, order: list[Node]) -> bool:
    """Marks what names and forms show to be no part of the article; whether there is any."""
    some = False
    for x in order:
        kind = max(x.says(), SURE if x.tag == "form" else PLAIN)
        if kind == PLAIN:
            continue
        most = x.total >= 0.6 * root.total and (x.paragraphs > 2 or not LAYOUT_WORDS.isdisjoint(x.words()))
        only_h1 = x.h1 and x.h1 == root.h1 and x.total >= 0.3 * root.total
        if kind == UNSURE:
            x.out = x.controls > 0 or x.linked >= 0.4 * x.length
            x.low = not x.out
        else:
            x.out = not only_h1 and (x.total < root.total if kind == COMMENT else not (x.articles or most))
        some = some or x.out
    return some


def best_container(order: list[Node]) -> Node | None:
    """Paragraphs pass points to the blocks above them; the container with most, by the first in page order."""
    found: dict[Node, None] = {}
    for x in order:
        x.low = x.low or x.parent is not None and x.parent.low
        if x.tag not in BLOCK or not x.own:
            continue
        y = x if x.tag in ("div", "section", "article", "main", "body", "html") else x.up or x
        for level in range(6):
            y.points += points(x) / (1 if level == 0 else 2 if level == 1 else 3 * level)
            found[y] = None
            if (y := y.up) is None:
                break
    best, most = None, -1.0
    for x in order:
        if x in found:
            x.points *= (1 - (x.linked / x.length if x.length else 0)) * (0.2 if x.low else 1) * (1.2 if x.attrs and not GOOD_WORDS.isdisjoint(x.words()) else 1)
            if x.points > most:
                best, most = x, x.points
    return best


def _reads_like_text(x: Node, best: Node, within: bool) -> bool:
    """Headings, paragraphs and lists beside the best container, further containers of its kind, and others with a fifth of its points; beside an
    article that nothing but the page holds, only headings and articles that are no teasers."""
    if x.low or x.linked >= 0.5 * x.length:
        return False
    if x.tag == "article":
        heads = [c for c in x.children if isinstance(c, Node) and c.tag in HEADINGS]
        teaser = not TEASER_WORDS.isdisjoint(x.words()) or any(h.length and h.linked >= h.length for h in heads)
        return not teaser and x.says() != COMMENT
    if x.tag in HEADINGS:
        return True
    if not within and best.tag in ("article", "main"):
        return False
    same = x.tag == best.tag and x.attrs.get("class", "").lower().split() == best.attrs.get("class", "").lower().split()
    return same or x.tag in ("p", "blockquote", "pre", "figure", "table", "ul", "ol", "dl") or x.points >= max(3.0, best.points * 0.2)


def main_blocks(page: str) -> list[str]:
    root = parse(page)
    order = measure(root)
    if leave_out(root, order):
        for x in order:
            x.length = x.linked = x.own = x.own_linked = x.commas = x.h1 = x.articles = x.controls = x.paragraphs = 0
            x.total = 0.0
        order = measure(root)
    best = best_container(order)
    if best is None:
        return []
    if best.tag not in ("article", "main"):
        up = best.parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        best = up or best
    # the best container with its siblings, then what stands beside these, up to main
    inside, node = best.parent, best
    while inside is not None and inside.tag != "main":
        inside = inside.parent
    picked = blocks(best)
    while node.parent is not None and node.tag not in ("main", "body"):
        before, after, seen = [], [], False
        for x in node.parent.children:
            if x is node:
                seen = True
            elif isinstance(x, Node) and not x.out and _reads_like_text(x, best, inside is not None):
                (after if seen else before).extend(blocks(x))
        picked, node = [*before, *picked, *after], node.parent
        if inside is None:
            break
    return picked


def main_text(page: str | None) -> str:
    return "\n".join(main_blocks(page)) if page else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"].cast(pa.int64()), batch["url"].cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
