"""Pages as trees: reading HTML into nested blocks, and what markup alone says of a block.

Only what structures a text is kept: block elements, inline elements that are no part of the text, and runs of text. Other
inline elements are transparent. Reading never fails: unclosed, crossed and unknown tags are settled as browsers do, as far
as blocks are concerned.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: An element nested deeper than this is transparent, so that no page can exhaust the stack.
MAX_DEPTH = 150

BLOCKS = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend"
    " li listing main menu nav ol p pre search section summary table caption colgroup thead tbody tfoot tr td th ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that hold no text of an article.
NO_TEXT = frozenset("nav aside footer form menu dialog template noscript button select datalist object svg canvas audio video map search head".split())
#: Start tags that end an open element, with the elements where the search for it stops.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "thead": (("thead", "tbody", "tfoot", "caption"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "caption"), ("table",))}
WALLS = frozenset("table td th caption".split())

#: Words of class, id and role that name what is no part of an article.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion promoted banner banners"
    " sidebar sidebars rail aside widget widgets complementary nav navs navbar navigation menu menus menubar submenu breadcrumb breadcrumbs pager pagination toolbar"
    " masthead topbar footer footers contentinfo copyright colophon cookie cookies consent gdpr notice notices notification notifications alert alerts alertdialog popup"
    " modal overlay lightbox toast newsletter subscribe subscription signup login search searchbox share sharing social follow skip hidden dialog status".split()
)
#: Of these, what may hold articles of others: readers' comments, teasers.
OTHERS_WORDS = frozenset("comment comments commentlist commentary discussion disqus respond reply replies related recommended recommendations popular trending teaser teasers".split())
#: Words that name the article itself, by level: the lower level wins.
ROOT_WORDS = {"articlebody": 2, "main": 2, "maincontent": 2, "article": 3, "story": 3, "post": 3, "entry": 3, "content": 4}
LEVELS = 4

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z) | <[!?][^>]*>? | </[^a-zA-Z>][^>]*>? | </>
    | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+)>
    | <[a-zA-Z/][^>]*\Z | (?P<text>[^<]++ | <)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}


@dataclass(slots=True)
class Node:
    """An element with what is inside it, or (tag "#") a run of text.

    role: "-" no part of an article, "=" the same and may hold articles of others, "~" a header, "1" to "4" an article by its
    level, " " nothing known."""

    tag: str
    role: str = " "
    name: str = ""
    inside: list[Node] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    links: int = 0

    @property
    def key(self) -> str:
        return f"{self.role}{self.tag}{self.name}"

    def said(self) -> str:
        return " ".join("".join(self.text).split())


def _role(tag: str, attrs: str) -> tuple[str, str]:
    """Role and name of an element; the name is its classes and id without digits."""
    found: dict[str, str] = {}
    if attrs:
        for name, *values in _ATTR.findall(attrs):
            found.setdefault(name.lower(), html.unescape("".join(values)))
    named = " ".join(filter(None, (found.get("class"), found.get("id"))))
    words = [w.lower() for w in _WORD.findall(" ".join((named, found.get("role", ""), found.get("itemprop", ""))))] if found else []
    whole = {*words, *("".join(words[k : k + 2]) for k in range(len(words) - 1))}
    name = f".{re.sub(r'[\d\s]+', '', named)[:80]}" if named.strip() else ""
    if tag in NO_TEXT:
        return ("=" if tag == "aside" else "-"), name
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return "-", name
    if whole & OTHERS_WORDS and tag not in ("main", *HEADINGS):
        return "=", name
    if tag in ("article", "main"):
        return ("=" if whole & {"ad", "advert", "advertisement", "sponsored", "promo"} else "1" if tag == "article" else "2"), name
    if tag == "header" or "header" in whole:
        return "~", name
    if whole & ASIDE_WORDS and tag not in HEADINGS:
        return "-", name
    if tag in ("div", "section", "td") and whole & ROOT_WORDS.keys():
        return str(min(level for word, level in ROOT_WORDS.items() if word in whole)), name
    return " ", name


def read(page: str | None) -> Node:
    """The page's tree. Null is an empty page."""
    top = Node("page")
    if not page:
        return top
    stack, links, at, size = [top], 0, 0, len(page)

    def close(tags: tuple[str, ...], walls: tuple[str, ...] | frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in walls:
                return

    def say(text: str) -> None:
        inside = stack[-1].inside
        if not inside or inside[-1].tag != "#":
            if text.isspace():
                return
            inside.append(Node("#"))
        inside[-1].text.append(text)
        if links:
            inside[-1].links += len(text)

    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"]:
            text = m["text"]
            say(html.unescape(text) if "&" in text else text)
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            links = 0 if tag == "a" else links
            if tag in HEADINGS:
                close(tuple(HEADINGS), WALLS)
            elif tag in BLOCKS or any(n.tag == tag for n in stack):
                close((tag,), WALLS if tag not in ("table", "tr", "td", "th", "caption", "thead", "tbody", "tfoot") else ("table",) if tag != "table" else ())
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.start() if end else size
            continue
        if tag in ("br", "hr"):
            if tag == "br":
                say(" ")
            else:
                close(("p",), WALLS)
                stack[-1].inside.append(Node("hr"))
            continue
        if tag in VOID or tag == "html":
            continue
        if tag == "body" or (tag in BLOCKS and stack[-1].tag == "head"):
            close(("head",), ())
            if tag == "body":
                continue
        if tag in BLOCKS:
            close(("p",), WALLS)
            if tag in ENDS:
                close(*ENDS[tag])
            elif tag in HEADINGS:
                if stack[-1].tag in HEADINGS:
                    stack.pop()
            role, name = _role(tag, m["attrs"])
        else:
            role, name = _role(tag, m["attrs"]) if tag in NO_TEXT or m["attrs"] else (" ", "")
            links = 1 if tag == "a" else links
            if role not in "-=" and not any(n.tag == tag and n.role in "-=" for n in stack):
                continue
            if m["attrs"].endswith("/"):
                continue
        if len(stack) <= MAX_DEPTH:
            node = Node(tag, role, name)
            stack[-1].inside.append(node)
            stack.append(node)
    return top
