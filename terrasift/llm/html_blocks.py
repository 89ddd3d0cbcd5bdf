"""Leaf blocks of a web page: a lenient scan of the markup into texts with their paths of open elements."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element names of HTML by how they are laid out and closed.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page: code, what is in the head, and what readers type.
RAW = frozenset("script style template textarea title".split())
#: An element that is closed when one of these begins, up to the nearest of the limits.
ENDED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


@dataclass(slots=True)
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    """What is known of an element: its name, and the words of its class, id and role."""
    out = [tag]
    if "=" in attributes:
        for m in _NAMES.finditer(attributes):
            out.extend("." + w.lower() for w in _PARTS.findall(m[2] or m[3] or m[4] or ""))
    return tuple(out)


def blocks(page: str | None) -> list[Block]:
    """The non-empty leaf blocks of a page, in order; character references decoded, white space single, trimmed.

    Scripts, styles and other raw elements, comments and declarations have no text. Formulas, drawings and what stands in
    for embedded things count as text where they stand. Unclosed and stray tags are borne. A path has all open elements, or
    for depths above 32 the outer 8 and the inner 24; texts are never cut.
    """
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, at, n = 0, False, 0, len(page)
    path: tuple[str, ...] | None = None

    def flush():
        nonlocal linked, path
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                if path is None:
                    path = tuple(t for _, ts in (stack if len(stack) <= 32 else stack[:8] + stack[-24:]) for t in ts)
                out.append(Block(path, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            if in_link:
                linked += n - at
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[1] or m[4])
        if tag in RAW:
            if not closing:
                end = _END[tag].search(page, at)
                at = end.end() if end else n
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag in ("br", "img"):
            parts.append(" ")
            continue
        if tag not in BLOCK:
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    path = None
                    break
            continue
        if tag == "hr":
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        ended, limits = ENDED_BY.get(tag, (frozenset(), frozenset()))
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in limits or not ended:
                break
            if stack[k][0] in ended:
                del stack[k:]
                break
        stack.append((tag, _tokens(tag, m[3] or m[6] or "")))
        path = None
    flush()
    return out
