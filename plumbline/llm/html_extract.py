"""Main text of web pages by tree scoring.

A page is parsed in one pass into a tree that forgives missing and misplaced end tags. Parts that hold
no text (scripts, styles and the like) go first; menus, headers, footers, forms, adverts, comments and
the like, told by tag, role or the names in class and id, go too, unless most of the page's text or
an article is in them: names are hints, the score decides. Readers' comments go whatever their size, if
any other text is left: parts with such names, and siblings of one form that each have an author and a
date, or a link to reply, and no heading. A page's only article (or main, if it has no article) is the
container. Elsewhere every paragraph-like block then passes
points to its ancestors: one for itself, one for each comma, one for each 100 characters up to 3; the
parent gets all of them, its parent half, those above a third and less by distance. A container's
points are discounted by its share of text in links, and cut to a fifth if its names speak against it.
The best container is kept with those of its siblings that score a fifth of it or read like text; in
what is kept only menus, lists of short links, are dropped, but not in an article nor between paragraphs.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import map_text

# Fixed values of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
#: A start tag of the key closes an open element of these names: the nearest one, or for parts of tables the outermost one,
#: unless a border is in between.
CLOSES = {
    "li": ("item", {"li"}, {"ul", "ol", "menu"}), "dt": ("term", {"dt", "dd"}, {"dl"}), "dd": ("term", {"dt", "dd"}, {"dl"}), "option": ("option", {"option"}, {"select"}),
    "td": ("cell", {"td", "th"}, {"table"}), "th": ("cell", {"td", "th"}, {"table"}), "tr": ("row", {"tr", "td", "th"}, {"table"}),
    "tbody": ("rows", {"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ("rows", {"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
P_BORDERS = {"td", "th", "li", "table", "button"}
OUTERMOST = {"cell", "row", "rows"}
# What marks a part as no article text.
NO_TEXT_TAGS = {"head", "script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "embed", "title", "select", "option", "textarea", "button"}
CUT_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu"}
CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "note", "status"}
CUT_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "cookie", "cookies", "consent", "disqus", "footer", "footnav", "gdpr", "header", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "notification", "outbrain", "pager", "pagination", "popup", "promo", "promoted", "promotion", "related", "replies", "reply", "respond", "responses", "share",
    "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "taboola", "toolbar", "topbar", "widget", "login", "paywall", "tags", "disclaimer", "alert", "hidden",
}
#: Names of readers' comments, and what marks one: its author, its date, a link to answer it.
REMARK_WORDS = {"comment", "comments", "commentlist", "disqus", "discussion", "discussions", "feedback", "guestbook", "reactions", "remarks", "replies", "reply", "respond", "responses", "reviews", "thread", "threads"}
AUTHOR_WORDS = {"author", "avatar", "commenter", "member", "nick", "nickname", "poster", "user", "username"}
DATE_WORDS = {"ago", "date", "datetime", "posted", "time", "timestamp", "when"}
REPLY_TEXTS = {"reply", "answer", "quote", "report", "like", "antworten", "melden", "zitieren", "répondre", "signaler", "responder", "denunciar", "me gusta", "j'aime", "gefällt mir"}
CUT_STARTS = ("advert", "sidebar", "comment", "cookie", "navbar", "newsletter", "sponsor", "breadcrumb")
#: Words that make a name speak of a layout, not of the part itself, and words that follow the name of a part.
LAYOUT_WORDS = {"has", "with", "no", "without", "not", "layout", "page", "is", "js"}
PART_WORDS = {"area", "bar", "block", "body", "box", "container", "content", "count", "form", "group", "holder", "inner", "item", "items", "left", "links", "list", "meta", "middle", "outer", "panel", "right", "row", "section", "slot", "text", "thread", "top", "unit", "wrap", "wrapper", "zone"}
#: Elements of running text: only names of adverts and the like speak against them.
TEXT_TAGS = {"p", "li", "td", "th", "tr", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "span", "a", "b", "i", "em", "strong", "code"}
TEXT_CUT_STARTS = ("advert", "sponsor", "comment", "cookie", "newsletter")
GOOD_WORDS = {"article", "content", "entry", "main", "post", "story", "text", "body", "blog"}
PARAGRAPHS = {"p", "td", "pre", "blockquote", "li", "dd"}
HEADINGS = {"h1", "h2", "h3"}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""[^>"']*(?:"[^"]*"|'[^']*'|(>))""")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "score", "size", "linked", "links", "holds_article", "against", "remark", "marks", "articles", "open_p", "open_parts")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up = tag, attrs, up
        self.kids: list[Node | str] = []
        self.score, self.size, self.linked, self.links = 0.0, 0, 0, 0
        self.holds_article, self.against = tag in ("article", "main"), False
        self.remark, self.marks, self.articles = False, 0, 0
        # The open elements that a start tag within this one would close.
        above = up.open_p if up else None
        self.open_p: Node | None = self if tag == "p" else None if tag in P_BORDERS else above
        parts = up.open_parts if up else {}
        if tag in _PART_TAGS:
            parts = dict(parts)
            for family, names, borders in _FAMILIES:
                if tag in borders:
                    parts.pop(family, None)
                elif tag in names and not (family in OUTERMOST and family in parts):
                    parts[family] = self
        self.open_parts: dict[str, Node] = parts


_FAMILIES = list({family: (family, names, borders) for family, names, borders in CLOSES.values()}.values())
_PART_TAGS = {t for _, names, borders in _FAMILIES for t in names | borders}


class _Scanner:
    """Where the tags of a page end: at the first > outside of quotes, or at the first one if quotes don't close."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose name ends here; -1 if none does."""
        first = self.page.find(">", at)
        if first < 0 or not self.quotes:
            return first
        k = at
        while m := _QUOTED.match(self.page, k):
            k = m.end()
            if m[1]:
                return k - 1
        self.quotes = False  # a quote is never closed: from here on quotes are not looked at, which keeps time linear
        return first


def parse(page: str) -> Node:
    """The tree of a page, end tags mended as browsers do in the common cases, in linear time.

    A tag that the page's end cuts off is dropped.
    """
    root = at = Node("#root", {}, None)
    scanner, open_tags = _Scanner(page), Counter()
    done = 0

    def close(node: Node) -> None:
        nonlocal at
        while at is not node:
            open_tags[at.tag] -= 1
            at = at.up
        open_tags[node.tag] -= 1
        at = node.up

    def text(end: int) -> None:
        if end > done:
            at.kids.append(html.unescape(page[done:end]))

    look = 0
    while (start := page.find("<", look)) >= 0:
        if page.startswith("<!--", start):
            text(start)
            end = page.find("-->", start + 4)
            done = look = len(page) if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", start):
            text(start)
            end = page.find("]]>", start + 9)
            at.kids.append(page[start + 9 : len(page) if end < 0 else end])
            done = look = len(page) if end < 0 else end + 3
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            text(start)
            end = page.find(">", start)
            done = look = len(page) if end < 0 else end + 1
            continue
        m = _TAG.match(page, start)
        if not m:
            look = start + 1
            continue
        text(start)
        end = scanner.end(m.end())
        if end < 0:
            done = look = len(page)
            break
        done = look = end + 1
        tag, inside = m[2].lower(), page[m.end() : end]
        if m[1]:
            if open_tags[tag] > 0:
                node = at
                while node.tag != tag:
                    node = node.up
                close(node)
            elif tag == "p":
                at.kids.append(Node("p", {}, at))
            continue
        if tag in BLOCKS and at.open_p is not None:
            close(at.open_p)
        if tag in CLOSES and (node := at.open_parts.get(CLOSES[tag][0])) is not None:
            close(node)
        attrs = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(inside)} if inside else {}
        node = Node(tag, attrs, at)
        at.kids.append(node)
        if tag in RAW:
            ends = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, done)
            node.kids.append(page[done : ends.start() if ends else len(page)])
            done = look = ends.end() if ends else len(page)
        elif tag not in VOID and not inside.endswith("/") or tag in BLOCKS and tag not in VOID:
            at = node
            open_tags[tag] += 1
    text(len(page))
    return root


_AUTHOR, _DATE, _REPLY, _HEADING, _HEADLINE = 1, 2, 4, 8, 16


def _own_marks(node: Node) -> int:
    """What an element itself says about a comment that it may be part of."""
    tag, marks = node.tag, 0
    if tag == "time":
        marks |= _DATE
    elif tag == "cite":
        marks |= _AUTHOR
    elif tag in HEADINGS:
        marks |= _HEADING | (_HEADLINE if tag == "h1" else 0)
    elif tag == "main":
        marks |= _HEADLINE
    elif tag == "a" and node.size <= 12 and len(node.kids) == 1 and isinstance(node.kids[0], str) and node.kids[0].strip().lower() in REPLY_TEXTS:
        marks |= _REPLY
    if name := node.attrs.get("class"):
        words = set(_NAME_WORD.findall(name.lower()))
        marks |= (_AUTHOR if words & AUTHOR_WORDS else 0) | (_DATE if words & DATE_WORDS else 0)
    return marks


def _named_remarks(node: Node) -> bool:
    """Whether a name in class or id speaks of readers' comments."""
    if node.tag in TEXT_TAGS and node.tag not in ("li", "dd", "blockquote"):
        return False
    for token in f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower().split():
        words = _NAME_WORD.findall(token)
        if words and not LAYOUT_WORDS & set(words) and (words[-1] in REMARK_WORDS or words[0] in REMARK_WORDS and words[-1] in PART_WORDS):
            return True
    return False


def _remarks(order: list[Node]) -> set[int]:
    """Parts that are readers' comments; none of them holds the page's headline, its main part or its only article."""
    articles = order[-1].articles
    found = set()
    for node in order:
        if node.remark and not node.marks & _HEADLINE and not (articles == 1 and node.articles):
            found.add(id(node))
        forms: dict[tuple[str, str], list[Node]] = {}
        for k in node.kids:
            if not isinstance(k, str) and not k.marks & _HEADING and (k.marks & _REPLY or k.marks & (_AUTHOR | _DATE) == _AUTHOR | _DATE) and k.tag in BLOCKS:
                forms.setdefault((k.tag, k.attrs.get("class", "")), []).append(k)
        for same in forms.values():
            if len(same) > 1:
                found |= {id(k) for k in same if not (articles == 1 and k.articles)}
    return found


def _named_against(node: Node) -> bool:
    """Whether a name in class or id says that this part is no article text."""
    for token in f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower().split():
        words = _NAME_WORD.findall(token)
        if not words or LAYOUT_WORDS & set(words):
            continue
        first, last = words[0], words[-1]
        if node.tag in TEXT_TAGS:
            if first in ("ad", "ads") or first.startswith(TEXT_CUT_STARTS):
                return True
            continue
        bad = lambda w: w in CUT_WORDS or w.startswith(CUT_STARTS)
        if bad(last) or first in ("ad", "ads") or bad(first) and last in PART_WORDS:
            return True
    return False


def _against(node: Node, in_article: bool) -> bool:
    """Whether tag, role, style or names speak against a part."""
    tag, attrs = node.tag, node.attrs
    if tag in CUT_TAGS or tag == "header" and not in_article:  # a page's header goes, an article's holds its headline
        return True
    if not attrs or tag in ("html", "body", "#root"):
        return False
    if attrs.get("role", "").lower() in CUT_ROLES:
        return True
    return tag not in ("article", "main", "header") and _named_against(node)


def _hidden(node: Node) -> bool:
    attrs = node.attrs
    return bool(attrs) and node.tag not in ("html", "body") and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style", ""))))


def _measure(order: list[Node]) -> None:
    """Sets size, linked, links, holds_article, marks and articles; children come first."""
    for node in order:
        node.size = node.linked = node.links = node.marks = 0
        node.articles = int(node.tag == "article")
        for k in node.kids:
            if isinstance(k, str):
                node.size += len(" ".join(k.split()))
            else:
                node.size += k.size
                node.linked += k.linked
                node.links += k.links
                node.holds_article |= k.holds_article
                node.marks |= k.marks
                node.articles += k.articles
        node.marks |= _own_marks(node)
        if node.tag == "a":
            node.linked, node.links = node.size, 1


def _prune_and_measure(root: Node) -> list[Node]:
    """Drops what is no article text and measures the rest; all elements, children first."""
    order, stack = [], [(root, False)]
    while stack:
        node, in_article = stack.pop()
        order.append(node)
        in_article = in_article or node.tag in ("article", "main")
        node.kids = [k for k in node.kids if isinstance(k, str) or k.tag not in NO_TEXT_TAGS and not _hidden(k)]
        for k in node.kids:
            if not isinstance(k, str):
                k.against = _against(k, in_article)
                k.remark = bool(k.attrs) and _named_remarks(k)
                stack.append((k, in_article))
    order.reverse()
    _measure(order)
    if (remarks := _remarks(order)) and _reads_without(root, remarks):
        order = _without(root, remarks)
    text = root.size - root.linked
    dropped = {id(n) for n in order if n.against and not n.holds_article and 2 * (n.size - n.linked) <= text}
    return _without(root, dropped)


def _without(root: Node, dropped: set[int]) -> list[Node]:
    """Drops parts and measures the rest; all elements that stay, children first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.kids = [k for k in node.kids if isinstance(k, str) or id(k) not in dropped]
        stack += [k for k in node.kids if not isinstance(k, str)]
    order.reverse()
    _measure(order)
    return order


def _reads_without(root: Node, dropped: set[int]) -> bool:
    """Whether text that is no link and not against the article is left without some parts."""
    stack: list[Node] = [root]
    while stack:
        node = stack.pop()
        if id(node) in dropped or node.tag == "a" or node.against and not node.holds_article:
            continue
        for k in node.kids:
            if not isinstance(k, str):
                stack.append(k)
            elif node.tag not in HEADINGS and k.strip():
                return True
    return False


def _own_text(node: Node) -> str:
    """The text of a block without that of the blocks in it."""
    out, stack = [], [iter(node.kids)]
    while stack:
        for k in stack[-1]:
            if isinstance(k, str):
                out.append(k)
            elif k.tag == "br":
                out.append(" ")
            elif k.tag not in BLOCKS:
                stack.append(iter(k.kids))
                break
        else:
            stack.pop()
    return " ".join("".join(out).split())


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def best_containers(root: Node) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    order = _prune_and_measure(root)
    scored: dict[int, Node] = {}
    for node in reversed(order):  # parents first, so that ties go to the outer one
        if node.tag not in PARAGRAPHS and node.tag not in ("div", "section", "article", "main", "body", "center"):
            continue
        text = _own_text(node)
        if not text:
            continue
        points = (1 + text.count(",") + min(3.0, len(text) / 100)) * (1 - min(1.0, _density(node))) * min(1.0, len(text) / 25)
        up, level = (node.up, 1) if node.tag in PARAGRAPHS else (node, 1)
        while up is not None and level < 6:
            if up.tag != "#root":
                up.score += points / (1, 2, 6, 9, 12)[level - 1]
                scored[id(up)] = up
            up, level = up.up, level + 1
    best, top = None, -1.0
    for node in scored.values():
        words = set(_NAME_WORD.findall(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()))
        bonus = 1.25 if node.tag in ("article", "main") or words & GOOD_WORDS else 1.0
        node.score *= (1 - _density(node)) * bonus * (0.2 if node.against else 1.0)
        if node.score > top:
            best, top = node, node.score
    if best is None:
        return [root]
    alone = _only_article(order)
    if alone is not None and (alone.tag == "article" or not _within(best, alone)):
        around = [k for k in alone.up.kids if not isinstance(k, str)] if alone.up else [alone]
        return [k for k in around if k is alone or k.tag in HEADINGS]
    if best.tag in ("body", "html", "#root") or best.up is None:
        return [best]
    kept = []
    for k in best.up.kids:
        if isinstance(k, str):
            continue
        near = k.score >= max(2.0, 0.2 * top) and _density(k) < 0.5
        reads = k.tag == "p" and (k.size > 80 and _density(k) < 0.25 or 0 < k.size <= 80 and not k.linked and best.up.tag not in ("body", "html"))
        headline = k.tag in HEADINGS or k.tag in ("header", "hgroup") and best.up.tag in ("article", "main")
        if k is best or near or reads or headline:
            kept.append(k)
    return kept


def _only_article(order: list[Node]) -> Node | None:
    """The page's only article with text, or its only main part if it has no article."""
    for tag in ("article", "main"):
        outer, inside = [], set()
        for node in reversed(order):  # parents first
            if id(node.up) in inside:
                inside.add(id(node))
            elif node.tag == tag and node.size > node.linked and not _named_against(node):
                outer.append(node)
                inside.add(id(node))
        if outer:
            return outer[0] if len(outer) == 1 else None
    return None


def _within(node: Node, outer: Node) -> bool:
    at: Node | None = node
    while at is not None and at is not outer:
        at = at.up
    return at is outer


class _Places:
    """Which lists of links are part of the text: those in an article, and those between paragraphs of their parent."""

    def __init__(self):
        self.of: dict[int, tuple[dict[int, int], int, int]] = {}
        self.inside: dict[int, bool] = {}

    def in_text(self, node: Node) -> bool:
        return self._in_article(node.up) or self._between(node)

    def _in_article(self, node: Node | None) -> bool:
        seen = []
        at = node
        while at is not None and id(at) not in self.inside and at.tag not in ("article", "main"):
            seen.append(at)
            at = at.up
        known = at is not None and (at.tag in ("article", "main") or self.inside[id(at)])
        self.inside |= {id(n): known for n in seen}
        return known

    def _between(self, node: Node) -> bool:
        if node.up is None:
            return False
        if id(node.up) not in self.of:
            texts = [i for i, k in enumerate(node.up.kids) if not isinstance(k, str) and k.tag in ("p", "blockquote", "pre") and k.size >= 25 and _density(k) < 0.5]
            self.of[id(node.up)] = ({id(k): i for i, k in enumerate(node.up.kids)}, min(texts, default=0), max(texts, default=-1))
        at, low, high = self.of[id(node.up)]
        return low < at[id(node)] < high


def _is_menu(node: Node) -> bool:
    """Whether a part is a list of short links; references in an article have titles, or text beside their links."""
    if node.tag not in ("ul", "ol", "div", "section", "table", "dl", "p") or node.links < 3:
        return False
    return _density(node) > 0.8 and node.linked < 20 * node.links


def _blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks under the nodes, in page order."""
    out: list[str] = []
    run: list[str] = []
    places = _Places()

    def close() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    stack: list[object] = [*reversed(nodes)]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            run.append(k)
        elif k is None:
            close()
        elif k.tag in ("br", "td", "th", "img") and not k.kids:
            run.append(" ")
        elif k.tag in BLOCKS:
            if _is_menu(k) and not places.in_text(k):
                continue
            close()
            stack.append(None)
            stack += reversed(k.kids)
        else:
            if k.tag in ("td", "th"):
                run.append(" ")
            stack += reversed(k.kids)
    close()
    return out


def main_text(page: str) -> str:
    return "\n\n".join(_blocks(best_containers(parse(page)))) if page else ""


def extract_pages(df: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of each row.

    Null or empty markup gives the empty text, and so does a page without text outside of the parts
    that are cut. Null ids and repeated rows pass through row by row; an empty table gives no rows;
    other columns of df are ignored.
    """

    def run(pages):
        texts = [main_text(p).encode("utf-8", "replace").decode() for p in pages]
        return [texts, [len(t) for t in texts]]

    return map_text(df, lambda: run, "text string, n_chars long", markup, [page_id, url])
