"""A small, forgiving HTML reader: pages as trees of elements and texts."""

from __future__ import annotations

import html
import re

#: Element names of the HTML standard by the way they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Which open elements a start tag ends, and where the search for them stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}

_NAME = r"[a-zA-Z][^\s/>]*+"
_TOKEN = re.compile(
    rf"<!--(?P<remark>.*?)(?:--!?>|\Z)|<[!?][^>]*+>|<(?P<end>/?)(?P<name>{_NAME})"
    r"(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CUT_TAG = re.compile(r"</?[a-zA-Z!?][^>]*\Z")


class Node:
    """An element: its name, its attributes, and its children (nodes and decoded texts)."""

    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []


def attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTR.finditer(text)))}


def parse(page: str) -> Node:
    """The tree under a root without a name. Comments and declarations are dropped, open elements
    end with the page, and an unfinished tag at its end is dropped."""
    root = Node("", {})
    stack, at, n = [root], 0, len(page)

    def say(text: str) -> None:
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(_CUT_TAG.sub("", page[at:]))
            break
        say(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            _close(stack, name)
            continue
        if name not in INLINE and name not in VOID:
            _close_paragraph(stack)
        if name in ENDS:
            ended, stop = ENDS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in stop:
                    break
                if stack[k].name in ended:
                    del stack[k:]
        node = Node(name, attributes(m["attrs"]))
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            raw = page[at : end.start() if end else n]
            node.children.append(html.unescape(raw) if name in ("title", "textarea") else raw)
            at = end.end() if end else n
        elif name not in VOID and not m["attrs"].endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[Node], name: str) -> None:
    """An end tag: ends the nearest open element of its name. That of an inline element does not
    reach over a block, that of a list item not over its list."""
    stop = ENDS[name][1] if name in ENDS else ()
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name == name:
            del stack[k:]
            return
        if stack[k].name in stop or (name in INLINE or name == "p") and stack[k].name not in INLINE:
            return


def _close_paragraph(stack: list[Node]) -> None:
    """A block ends an open paragraph with the inline elements in it."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name == "p":
            del stack[k:]
            return
        if stack[k].name not in INLINE:
            return
