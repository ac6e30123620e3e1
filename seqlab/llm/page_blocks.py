"""Blocks of text of one HTML page, each with what its place in the markup says about it."""

from __future__ import annotations

import re
from html import unescape

BOILERPLATE, UNDECIDED, ARTICLE = 0, 1, 2

# Element names by their role in HTML.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody
td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style template noscript svg math iframe object canvas textarea select title audio video".split())
CHROME = frozenset("nav aside footer form menu dialog button head".split())
LANDMARKS = frozenset("article main".split())
#: an article may be wrapped in these (a form round the page, a menu whose end tag is missing)
WRAPPERS = frozenset("nav form header head".split())
#: elements that hold text as such; others (div, section, the article itself) only group
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption address summary center".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
CHROME_NAMES = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu
menubar breadcrumb breadcrumbs footer sidebar widget cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe
subscription signup login share sharing social comment comments commentlist disqus reply replies respond related recommended pagination pager
copyright disclaimer masthead topbar toolbar""".split())

_TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>"']+|"[^"]*"|'[^']*')*+)(?:>|\Z)|([^>]*)(?:>|\Z))|/[^a-zA-Z][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")


def _named_chrome(value: str, inside_article: bool) -> bool:
    for name in value.lower().split():
        parts = [p for p in re.split(r"[-_:]+", name) if p]
        if parts and parts[0] not in ("has", "with", "no", "without") and (parts[0] in CHROME_NAMES or parts[-1] in CHROME_NAMES):
            return True
        if parts and not inside_article and "header" in (parts[0], parts[-1]):
            return True
    return False


def _place(tag: str, attributes: str, outer: int, wrapper: bool) -> tuple[int, bool]:
    """Role of what the element holds, and whether an article inside may still claim it."""
    role = tag in LANDMARKS
    chrome = tag in CHROME or (tag == "header" and outer != ARTICLE)
    soft = tag in WRAPPERS
    if attributes and tag not in ("body", "html"):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "role":
                role = role or value.lower() in ("main", "article")
                chrome = chrome or value.lower() in CHROME_ROLES
            elif name in ("class", "id") and _named_chrome(value, outer == ARTICLE):
                chrome, soft = True, False
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.lower().replace(" ", "")):
                chrome, soft = True, False
    if chrome:
        return BOILERPLATE, soft and (outer != BOILERPLATE or wrapper)
    if outer == BOILERPLATE:
        return (ARTICLE, False) if role and wrapper else (BOILERPLATE, wrapper)
    return (ARTICLE, False) if role else (outer, False)


def page_blocks(html: str) -> list[tuple[str, int]]:
    """(text, role) of every block in page order: references decoded, white space made one space, no empty blocks."""
    return [(text, role) for text, role, _ in placed_blocks(html)]


def placed_blocks(html: str) -> list[tuple[str, int, bool]]:
    """Like ``page_blocks``, with whether the nearest block element around the text is one that holds text as such."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int, bool]] = [("", UNDECIDED, False)]
    held: list[str] = []
    role, told = UNDECIDED, False

    def begin_block():
        nonlocal role, told
        role, told = stack[-1][1], next((f[0] in TEXT for f in reversed(stack) if f[0] in BLOCKS), False)

    def flush():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((text, role, told))

    def close(upto: int):
        del stack[upto:]

    at, size = 0, len(html)
    while at < size:
        begin = html.find("<", at)
        tag = _TAG.match(html, begin) if begin >= 0 else None
        text = html[at:begin if begin >= 0 else size] if begin != at else ""
        if text:
            if not held:
                begin_block()
            held.append(unescape(text) if "&" in text else text)
        if begin < 0:
            break
        if tag is None:  # a sign, not a tag
            if not held:
                begin_block()
            held.append("<")
            at = begin + 1
            continue
        at = tag.end()
        if tag.group(2) is None:
            continue
        ending, name = tag.group(1) == "/", tag.group(2).lower()
        attributes = tag.group(3) if tag.group(3) is not None else tag.group(4) or ""
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if ending:
            spot = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if spot and (name in BLOCKS or all(f[0] not in BLOCKS for f in stack[spot + 1:])):
                close(spot)
            elif spot:
                del stack[spot]
            continue
        if name in UNSEEN and not attributes.endswith("/"):
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
            if stop is None:
                at = size
            else:
                gone = html.find(">", stop.end())
                at = size if gone < 0 else gone + 1
            continue
        if name in VOID:
            continue
        if name in BLOCKS:
            spot = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p"), 0)
            if spot and all(f[0] not in ("td", "th", "table", "button") for f in stack[spot + 1:]):
                close(spot)
        if name in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SCOPES[name]:
                    break
                if stack[i][0] in CLOSES[name]:
                    close(i)
                    break
        outer = stack[-1]
        if name in BLOCKS or attributes:
            stack.append((name, *_place(name, attributes, outer[1], outer[2])))
        else:
            stack.append((name, outer[1], outer[2]))
    flush()
    return out
