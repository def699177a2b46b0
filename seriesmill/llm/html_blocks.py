"""The blocks of a web page: runs of text between the borders of block elements, with the path of elements that they stand in.

Parsing forgives what browsers forgive: unclosed and crossing tags, missing quotes, markup inside scripts and comments.
It takes time in proportion to the page.
"""

from __future__ import annotations

import html
import re

#: Elements that begin and end blocks; all others run within a line.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu "
    "nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose whole content is no text of the page. The first ones go on to the end of the page if they aren't closed.
RAW = frozenset("script style xmp noembed noframes".split())
SKIPPED = RAW | frozenset("title template noscript iframe svg math canvas audio video object map datalist".split())
#: A start tag closes the nearest of these elements, unless one of the others is met before.
_CELLS, _LISTS = frozenset("td th caption table button dialog".split()), frozenset("ul ol menu dir table td th".split())
CLOSES = {
    "li": (frozenset(["li"]), _LISTS), "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])), "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
} | {x: (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])) for x in ("thead", "tbody", "tfoot")}
#: Block elements that may stand in a paragraph or its like without closing it.
_IN_P = frozenset("button label option optgroup select textarea td th tr tbody thead tfoot caption legend summary html head body".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_IN_HEAD = frozenset("title base link meta style script noscript template".split())

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^=>]++|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMED = re.compile(r"\b(?:class|id|role|hidden|aria-hidden|style|itemprop)\b", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    """A block element's tag, the words of its names (class, id, role), its depth, and a number for what stands between it and the root."""

    __slots__ = ("tag", "names", "parent", "number")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Element | None, number: int):
        self.tag, self.names, self.parent, self.number = tag, names, parent, number


class Block:
    """text: with white space made one space; linked: how many of its characters are links'; inline: names of line elements in it; at: its element."""

    __slots__ = ("text", "linked", "inline", "at")

    def __init__(self, text: str, linked: int, inline: tuple[str, ...], at: Element):
        self.text, self.linked, self.inline, self.at = text, linked, inline, at


def names_of(attributes: str) -> tuple[str, ...]:
    """Words of class, id, role and itemprop in lower case, sorted; `hidden` for what a reader doesn't see."""
    if not _NAMED.search(attributes):
        return ()
    out = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop"):
            out.update(x.lower() for x in _PART.findall(value) if 1 < len(x) < 24)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.add("hidden")
    return tuple(sorted(out))


def blocks(page: str) -> list[Block]:
    """All blocks with text, in page order."""
    out: list[Block] = []
    number = 0
    at = Element("", (), None, 0)
    parts: list[str] = []
    linked, link, inline = 0, None, []

    def close() -> None:
        nonlocal parts, linked, inline
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, min(linked, len(text)), tuple(inline), at))
        parts, linked, inline = [], 0, []

    def leave(found: frozenset, walls: frozenset) -> None:
        """Closes elements up to the nearest of found, if no wall stands before it."""
        nonlocal at, link
        x = at
        while x.parent is not None and x.tag not in walls:
            if x.tag in found:
                close()
                at, link = x.parent, None
                return
            x = x.parent

    def say(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if link is not None:
            linked += len(text)

    position, end = 0, page.rfind(">") + 1
    while m := TOKEN.search(page, position, end):
        if m.start() > position:
            say(page[position : m.start()])
        position = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")) and m[0] != "<!-->":
                position = len(page)  # a comment that never ends
                break
            continue
        tag = m[2].lower()
        if tag in SKIPPED:
            if not m[1]:
                rest = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, position)
                if rest:
                    position = rest.end()
                elif tag in RAW:
                    position = len(page)
                    break
        elif m[1]:
            if tag == "a":
                link = None
            elif tag == "br":
                parts.append(" ")
            elif tag in BLOCK and tag not in ("html", "body"):
                leave(_HEADS if tag in _HEADS else frozenset([tag]), frozenset(["table"]) if tag in ("td", "th", "tr", "tbody", "thead", "tfoot") else frozenset() if tag == "table" else _CELLS - {tag})
        elif tag in BLOCK:
            if tag in ("html", "body") and any(x == tag for x in _tags(at)):
                continue
            close()
            if tag not in _IN_P:
                leave(frozenset(["p"]), _CELLS)
            if tag in CLOSES:
                leave(*CLOSES[tag])
            if tag not in ("html", "head") and tag not in _IN_HEAD:
                leave(frozenset(["head"]), frozenset(["body"]))
            if tag not in VOID:
                number += 1
                at = Element(tag, names_of(m[3]), at, number)
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = at
            inline.extend(names_of(m[3]))
        elif m[3]:
            inline.extend(names_of(m[3]))
    if position < len(page):  # a tag that never ends is no text
        say(re.split(r"<(?=[A-Za-z/!?])", page[position:], maxsplit=1)[0])
    close()
    return out


def _tags(x: Element):
    while x.parent is not None:
        yield x.tag
        x = x.parent
