"""Pages as tokens and text blocks: a lenient reader of HTML, one page at a time."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

# Fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
# Blocks that say nothing about the page's layout; all others are part of a path.
PLAIN = frozenset("address blockquote center dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li ol p pre tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - {"noscript", "option", "select"}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIST_OF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

# Elements and words of class, id and role that never hold the article.
OUTSIDE = frozenset("aside button dialog footer head menu nav noscript option select".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies copyright dialog discussion disqus footer legal login masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo recommended related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe toolbar widget".split()
)
# Words beside those above that say nothing of their own: "share-links" is outside, "related-work" is not.
NEUTRAL_WORDS = frozenset(
    "area article articles bar block body bottom box button buttons container content entry form group header holder icon icons "
    "inline inner item items left link links list main message module outer page panel post posts region right row section "
    "site slot small stories story text top unit wrap wrapper zone".split()
)
INSIDE_WORDS = frozenset("article articlebody content entry main post story".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Numbers in names count pages or posts; a single digit may tell columns apart.
_DIGITS = re.compile(r"\d{2,}")

# How surely a block belongs to the article.
NOWHERE, BY_NAME, IN_MAIN, IN_ARTICLE = 0, 1, 2, 3


@dataclass
class Block:
    """A block of text: white space folded, references decoded; `place` counts the page's tokens before it."""

    path: str
    text: str
    link_chars: int
    level: int
    outside: bool
    place: int


@dataclass
class _Open:
    name: str
    path: str
    level: int
    outside: str  # why the element is outside the article, or empty


def _named_outside(value: str) -> bool:
    """Whether one of the names in a class or id says outside, and nothing else."""
    for token in value.split():
        words = {w.lower() for w in _WORDS.findall(token)}
        if words & OUTSIDE_WORDS and words <= OUTSIDE_WORDS | NEUTRAL_WORDS:
            return True
    return False


def _opened(name: str, attributes: str, parent: _Open) -> _Open:
    label, words, role, named = name, set(), "", False
    if attributes:
        for kind, value in _ATTRIBUTE.findall(attributes):
            value = unescape(value.strip("\"'"))
            if kind.lower() == "role":
                role = value.lower()
            else:
                words.update(w.lower() for w in _WORDS.findall(value))
                named = named or _named_outside(value)
                if kind.lower() != "itemprop":
                    label += "." + _DIGITS.sub("#", value)
    level = parent.level
    if name == "article" or role == "article" or "articlebody" in words:
        level = max(level, IN_ARTICLE)
    elif name == "main" or role == "main":
        level = max(level, IN_MAIN)
    elif words & INSIDE_WORDS:
        level = max(level, BY_NAME)
    outside = parent.outside
    if outside == "form" and level >= IN_MAIN:
        outside = ""
    if not outside and name not in ("html", "body"):
        if name in OUTSIDE or role in OUTSIDE_WORDS:
            outside = name
        elif name == "header" or "header" in words:
            outside = "" if level or words & INSIDE_WORDS else "header"
        elif name == "form":
            outside = "form"
        elif named and name not in ("article", "main"):
            outside = "name"
        elif name == "article" and named and not words & (INSIDE_WORDS - {"article"}):
            outside = "name"
    path = parent.path if name in PLAIN and not outside else f"{parent.path}/{label}"
    return _Open(name, path, level, outside)


def read_page(html: str) -> tuple[list[tuple[str, int]], list[Block]]:
    """(tags: path with the tag, place), and the text blocks, in page order.

    Unclosed, misnested and cut-off elements are read as far as they go. Scripts, styles
    and comments are skipped.
    """
    tags: list[tuple[str, int]] = []
    blocks: list[Block] = []
    root = _Open("", "", NOWHERE, "")
    stack = [root]
    parts: list[str] = []
    links = 0
    link_chars = 0
    at, place, n = 0, 0, len(html)

    def flush() -> None:
        nonlocal link_chars, place
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                top = stack[-1]
                blocks.append(Block(top.path, text, link_chars, top.level, bool(top.outside), place))
                place += 1
            parts.clear()
        link_chars = 0

    def add(text: str) -> None:
        nonlocal link_chars
        if text:
            parts.append(text)
            if links:
                link_chars += len(text)

    while at < n:
        match = _TAG.search(html, at)
        if match is None:
            add(html[at:])
            break
        add(html[at : match.start()])
        at = match.end()
        if match[1] is not None:
            add(match[1].replace("&", "&amp;"))
            continue
        name = match[3] or match[6]
        if name is None:
            continue
        name = name.lower()
        closing = bool(match[2] or match[5])
        if name == "a":
            links = max(0, links - 1) if closing else links + 1
        elif name == "br":
            add(" ")
        elif name in RAW:
            if not closing:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                at = end.end() if end else n
                add(" ")
        elif name in BLOCK or name == "button":
            flush()
            links = 0
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        del stack[k:]
                        break
                    if name in PLAIN and stack[k].name not in PLAIN:
                        break
                continue
            if name in CLOSES_P and stack[-1].name == "p":
                stack.pop()
            if name == "body":
                while len(stack) > 1 and stack[-1].name == "head":
                    stack.pop()
            if name in SAME_CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in SAME_CLOSES[name]:
                        del stack[k:]
                        break
                    if stack[k].name in LIST_OF[name] or stack[k].name not in PLAIN:
                        break
            element = _opened(name, match[4] if match[3] else match[7], stack[-1])
            tags.append((f"{element.path}>{name}", place))
            place += 1
            if name not in VOID:
                stack.append(element)
    flush()
    return tags, blocks
