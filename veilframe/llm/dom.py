"""A forgiving HTML reader: the tree of block elements and the text runs in them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

#: Elements whose content is no text of the page.
DROPPED = frozenset("script style noscript template svg math canvas iframe object video audio head title select option textarea button".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: What can stand in a head; any other element, or text, ends it.
HEAD = frozenset("html head title base basefont bgsound link meta style script noscript noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr acronym".split()
)
_CLOSES = {  # an opening tag ends these open elements
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
_BARRIER = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "body": {"html"}}
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_NAME_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    """A block element, or a text run (``tag`` is then that of its block and ``leaf`` is set)."""

    tag: str
    parent: int
    depth: int
    names: tuple[str, ...] = ()
    leaf: bool = False
    text: str = ""
    linked: int = 0  # characters of the text inside links
    marks: dict = field(default_factory=dict)


def _names(attributes: str) -> tuple[str, ...]:
    out = []
    if "=" in attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            if key.lower() in ("class", "id", "role", "aria-label", "itemprop"):
                out += _NAME_PART.findall(_CAMEL.sub("-", value.strip("\"'")).lower())
    return tuple(dict.fromkeys(out))


def parse(page: str) -> list[Node]:
    """The nodes in order, parents first; node 0 is the root. Reads in linear time."""
    nodes = [Node("html", -1, 0)]
    stack: list[tuple[str, int]] = []  # (tag, its block node)
    run: list[str] = []
    linked = links = dropped = 0
    block = 0

    def close_run() -> None:
        nonlocal run, linked
        text = " ".join("".join(run).split())
        if text:
            owner = nodes[block]
            nodes.append(Node(owner.tag, block, owner.depth + 1, leaf=True, text=text, linked=min(linked, len(text))))
        run, linked = [], 0

    def pop() -> None:
        nonlocal block, links, dropped
        tag, _ = stack.pop()
        if tag in DROPPED:
            dropped -= 1
        if tag == "a":
            links -= 1
        elif tag not in INLINE and tag not in DROPPED:
            close_run()
        block = stack[-1][1] if stack else 0

    at, end, last = 0, len(page), page.rfind(">")
    opened: dict[str, list[int]] = {}  # of each tag the heights at which it is open

    def height(tags: Iterable[str]) -> int:
        """Of the innermost open one of the tags."""
        return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

    def close(tag: str) -> None:
        while stack:
            top = stack[-1][0]
            opened[top].pop()
            pop()
            if top == tag:
                return

    def add_text(text: str) -> None:
        nonlocal linked
        if stack and stack[-1][0] == "head" and text.strip():
            close("head")
        if text and not dropped:
            text = html.unescape(text)
            run.append(text)
            if links:
                linked += len(text.strip())

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            add_text(page[at:])
            break
        add_text(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, lt) if lt < last else None
        if not m:
            add_text("<")
            at = lt + 1
            continue
        at, tag = m.end(), m.group(2).lower()
        if m.group(1):
            # Behind an open cell's table an end tag is stray.
            if opened.get(tag) and (tag in ("table", "body", "html") or height(("table",)) <= height((tag,))):
                close(tag)
            continue
        if stack and stack[-1][0] == "head" and tag not in HEAD:
            close("head")
        if tag == "br":
            add_text(" ")
        if tag in VOID:
            if tag == "hr":
                close_run()
            continue
        if tag in _CLOSES:
            own = height(_CLOSES[tag])
            if own > height(_BARRIER[tag]):
                close(stack[own][0])
        if tag not in INLINE and tag not in DROPPED and opened.get("p"):
            close("p")  # a block ends an open paragraph
        if m.group(3).rstrip().endswith("/") and tag in ("svg", "math", "path"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in DROPPED:
            dropped += 1
        elif tag == "a":
            links += 1
        elif tag not in INLINE and not dropped:
            close_run()
            nodes.append(Node(tag, block, nodes[block].depth + 1, _names(m.group(3))))
            block = len(nodes) - 1
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, block))
    close_run()
    return nodes
