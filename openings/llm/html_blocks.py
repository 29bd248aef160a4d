"""Blocks of an HTML page: leaf texts with their tag paths."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Attributes: a > in a quoted value (after =) doesn't end the tag, other quotes are characters; where quotes don't pair, the first > ends it.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+(?=>|$)|[^>]*"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<(script|style|template|noscript|svg|iframe|object)\b(?:{_ATTRIBUTES})>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})(?:>|$)|<[!?][^>]*(?:>|$)", re.S | re.I
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea "
    "tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open one of the values.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}


@dataclass(slots=True)
class Block:
    """A run of text without a block boundary: its path of (tag, names), its text, and how much of it stands in links."""

    path: tuple[str, ...]
    text: str
    linked: int


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order; character references are decoded, white space is one space, blocks without text are left out.

    Comments, scripts, styles and other content that isn't shown are skipped.  An
    element that isn't closed ends with the one around it; a paragraph ends where
    another block begins.
    """
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, str]] = []  # tag, and tag with its names
    parts: list[str] = []
    linked = depth_a = 0
    at = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(s for _, s in stack), text, linked))
            parts.clear()
        linked = 0

    def drop(n: int) -> None:
        nonlocal depth_a
        for tag, _ in stack[n:]:
            depth_a -= tag == "a"
        del stack[n:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if depth_a:
                linked += len(text)
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _VOID:
            if tag == "hr":
                close()
            elif tag == "br":
                parts.append(" ")
            continue
        if m[2]:
            if tag in BLOCKS:
                close()
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == tag:
                    drop(n)
                    break
                if tag not in BLOCKS and stack[n][0] in BLOCKS:
                    break
            continue
        if tag in BLOCKS:
            close()
            for n in range(len(stack) - 1, -1, -1):
                other = stack[n][0]
                if other == "p" or other in _ENDS.get(tag, ()):
                    drop(n)
                    break
                if other in BLOCKS:
                    break
        names = ""
        attributes = m[4]
        if "=" in attributes:
            names = " ".join((a or b or c).lower() for a, b, c in _NAMES.findall(attributes))
        if not attributes.rstrip().endswith("/"):
            stack.append((tag, f"{tag} {names}" if names else tag))
            depth_a += tag == "a"
    if at < len(page):
        parts.append(unescape(page[at:]))
    close()
    return out
