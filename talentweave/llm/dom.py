"""Block elements and text blocks of a web page as a tree, read leniently and in linear time.

A node is a block element or a run of inline content between block borders (a text block, always a leaf). Inline elements only
mark what is inside links. White space in a text block becomes one space; a line break counts as white space. What browsers
don't show as text (scripts, styles, the head, comments, markup) has no node.
"""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass, field

#: Fixed values of HTML: elements that stand inside a line, that have no end, and whose content is no text of the page.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = set("script style template iframe noembed noframes object svg math title".split())
#: An element that starts ends an open one of these, if no border element is between.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BORDERS = set("ul ol dl table select body html".split())
IN_PARAGRAPH = INLINE | VOID - {"hr"}  # what doesn't end an open paragraph

MAX_DEPTH = 256  # deeper elements have no node; their text belongs to the deepest one

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<",
    re.S)
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in UNSHOWN}
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z][\w:-]*)")


@dataclass
class Tree:
    """Parallel lists over the nodes; a parent comes before its children, the root is its own parent."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)  # "" for a text block
    attributes: list[dict[str, str]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters inside links

    def add(self, parent: int, tag: str, attributes: dict[str, str], text: str = "", linked: int = 0) -> int:
        node = len(self.parent)
        self.parent.append(parent if node else 0)
        self.depth.append(self.depth[parent] + 1 if node else 0)
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.text.append(text)
        self.linked.append(linked)
        return node


def _attributes(source: str) -> dict[str, str]:
    if not source or source.isspace():
        return {}
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)}


def parse(html: str) -> Tree:
    """The tree of a page; without any element or text just a root."""
    tree = Tree()
    stack = [tree.add(0, "root", {})]
    below = 0  # open elements deeper than the limit
    words: list[str] = []
    linked, link_at = 0, None

    def flush() -> None:
        nonlocal linked
        if words:
            if text := " ".join("".join(words).split()):
                tree.add(stack[-1], "", {}, text, min(linked, len(text)))
            words.clear()
        linked = 0

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            piece = m[0]
            if piece[0] == "<" and len(piece) > 1:
                continue  # a comment or declaration
            if "&" in piece:
                piece = references.unescape(piece)
            words.append(piece)
            if link_at is not None:
                linked += len(piece)
            continue
        name, closing = name.lower(), m[1] or m[4]
        if name in INLINE:
            if name == "br":
                words.append(" ")
            elif name == "a":
                link_at = None if closing else len(stack)
            continue
        flush()
        if closing:
            if below:
                below -= 1
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if tree.tag[stack[k]] == name:
                        del stack[k:]
                        break
            if link_at is not None and len(stack) < link_at:
                link_at = None
            continue
        if name in UNSHOWN and not (m[3] or m[6] or "").endswith("/"):
            stop = _ENDS[name].search(html, at)
            at = end if stop is None else stop.end()
            continue
        if name in VOID:
            continue
        ended = ENDED_BY.get(name, ()) if name in ENDED_BY else {"p"}
        for k in range(len(stack) - 1, 0, -1):
            if tree.tag[stack[k]] in ended:
                del stack[k:]
                if name != "tr":
                    break
            elif tree.tag[stack[k]] in BORDERS or (ended == {"p"}):
                break
        if len(stack) >= MAX_DEPTH:
            below += 1
        else:
            stack.append(tree.add(stack[-1], name, _attributes(m[3] or m[6] or "")))
    flush()
    return tree
