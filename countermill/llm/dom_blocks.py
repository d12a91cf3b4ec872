"""Leaf blocks of an HTML page: text between block-level tags, with the elements it stands in."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Fixed values of HTML: elements that start a new block, have no end tag, or hold no text to read.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p"
    " pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup, up to their end tag or the end of the page.
RAW_TAGS = frozenset("script style template noscript iframe".split())
#: Their content is a picture, a film or a formula, or what stands in for it, up to the end tag that matches.
HIDDEN_TAGS = frozenset("svg math canvas audio video".split())
#: An element of the key is ended by the start of one of the values.
ENDED_BY = {
    "p": BLOCK_TAGS - {"button", "label"},
    "li": {"li"},
    "option": {"option", "optgroup"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "tr": {"tr", "tbody", "tfoot"},
    "head": {"body"},
}
#: An end or implied end does not look past these.
SCOPE = {"li": {"ul", "ol", "menu"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "p": {"td", "th", "table", "li", "div", "article", "section", "body"}}

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)|<[!?/][^>]*(?:>|\Z)", re.S)
PLAIN_REST = re.compile(r"[^>\"']*(?:>|\Z)")
STOP = re.compile(r"[>\"']")
OPENS_VALUE = re.compile(r"=\s*\Z")
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block(NamedTuple):
    """text, (tag, name parts) of the open elements from the outside in, and its characters inside links."""

    text: str
    path: tuple[tuple[str, str], ...]
    linked: int


def tag_end(page: str, at: int, missing: set[str]) -> int:
    """Where the tag whose name ends at this place ends. A quoted value, of any length, may hold a `>`; a quote
    that opens no value or is never closed is a sign like others. `missing` keeps the quotes that do not
    occur any more, so that no page is searched for one twice."""
    plain = PLAIN_REST.match(page, at)
    if plain:
        return plain.end()
    start = at
    while stop := STOP.search(page, at):
        at = stop.end()
        if stop[0] == ">":
            return at
        if stop[0] not in missing and OPENS_VALUE.search(page, max(start, at - 65), at - 1):
            close = page.find(stop[0], at)
            if close < 0:
                missing.add(stop[0])
            else:
                at = close + 1
    return len(page)


def matching_ends(page: str, name: str) -> dict[int, int]:
    """For each start of an element of this name that is closed, where its end tag ends."""
    found, open_at = {}, []
    for m in re.finditer(rf"<(/?){name}(?=[\s/>])[^>]*(?:>|\Z)", page, re.I):
        if not m[1]:
            if not m[0].endswith("/>"):
                open_at.append(m.start())
        elif open_at:
            found[open_at.pop()] = m.end()
    return found


def blocks(page: str) -> list[Block]:
    """Blocks in page order. References are decoded, white space is one space, empty blocks are left out.

    A raw element that is never closed hides the rest of the page, as it does in a browser; a picture or
    film that is never closed hides nothing. A comment that is never closed is one to the end of the page.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    texts: list[str] = []
    linked = links = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                out.append(Block(text, tuple(x for x in stack if x[0] in BLOCK_TAGS), linked))
            texts.clear()
        linked = 0

    def pop_to(place: int) -> None:
        nonlocal links
        for tag, _ in stack[place:]:
            links -= tag == "a"
        del stack[place:]

    missing: set[str] = set()
    ends: dict[str, dict[int, int]] = {}
    while m := MARKUP.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            texts.append(piece)
            linked += len(piece) if links else 0
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        at = tag_end(page, m.end(), missing)
        attributes = page[m.end() : at - 1] if page[at - 1] == ">" else page[m.end() : at]
        if name in RAW_TAGS and not m["end"]:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in HIDDEN_TAGS and not m["end"]:
            if name not in ends:
                ends[name] = matching_ends(page, name)
            at = max(at, ends[name].get(m.start(), at))
            continue
        if m["end"]:
            if name in BLOCK_TAGS:
                flush()
            for place in range(len(stack) - 1, -1, -1):
                if stack[place][0] == name:
                    pop_to(place)
                    break
                if stack[place][0] in SCOPE.get(name, ()):
                    break
            continue
        if name in BLOCK_TAGS:
            flush()
            for place in range(len(stack) - 1, -1, -1):
                tag = stack[place][0]
                if name in ENDED_BY.get(tag, ()):
                    pop_to(place)
                elif tag in BLOCK_TAGS:
                    break
        elif name == "br":
            texts.append(" ")
        if name in VOID_TAGS or attributes.endswith("/"):
            continue
        links += name == "a"
        named = " ".join(
            part.lower() for found in NAMES.findall(attributes) for part in PARTS.findall(" ".join(found))
        ) if attributes and "=" in attributes else ""
        stack.append((name, named))
    if at < len(page):
        piece = page[at:]
        texts.append(piece)
        linked += len(piece) if links else 0
    flush()
    return out
