"""Markdown of a page: its tags and texts folded with a stack of open lists.

The page is cut at its tags, and one walk over the pieces keeps a small state: the
break and the markers that wait for the next content, the open lists, the open link,
preformatted text and the row of a table. Pages come in Arrow batches and each is worked
on alone; the walk is plain Python, since Spark interprets a fold of SQL functions and
copies its whole state at every piece.

Rules, where HTML leaves a choice:

* A tag is ``<``, a letter (``</`` likewise) and everything up to ``>``, without ``<``.
* Comments, ``head``, ``nav``, ``script``, ``style``, doctypes and processing instructions
  are dropped; unknown tags vanish, their texts stay.
* White space is one space outside ``pre``, none at the edges of a block. Blocks are
  separated by a blank line, list items, rows and ``br`` by a line break.
* Items are indented below the item that holds them; levels below the 32nd count as it.
  Items and headings without content vanish.
* A table has its first row as head. Inside a cell blocks are separated by a space, ``|`` is
  written ``\\|``, and the tags of a table in a cell only separate.
* ``pre`` becomes a fenced block with its text as it is, without a line break at its edges.
* References are decoded once: decimal, hexadecimal and the names of HTML 4; others stay.
* ``null`` gives null, an empty page an empty text.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilframe.functions.spans import MARK, STAND_IN

_ANY_CASE = re.ASCII | re.IGNORECASE | re.DOTALL
_DROPPED = (
    re.compile(r"<!--.*?-->", re.DOTALL),
    *(re.compile(rf"<{name}(?=[\s/>])[^>]*>.*?</{name}\s*>", _ANY_CASE) for name in ("script", "style", "nav", "head")),
    re.compile(r"<[!?][^<>]*>"),
)
_TAGS = re.compile(r"(</?[a-zA-Z][^<>]*>)")
_NAME = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9]*)")
_REFERENCE = re.compile(r"&(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,9});")
_BLANKS = re.compile(r"[ \t\n\r\f\u00a0]+")
_LINE_END = re.compile(r"\r?\n")
_ATTRIBUTES = {
    name: re.compile(rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", _ANY_CASE)
    for name in ("href", "src", "start", "alt")
}
#: of a tag its target, source or first number counts
_COUNTS = {"a": "href", "img": "src", "ol": "start"}
_NAMES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
_BLOCKS = (
    "p", "div", "section", "article", "header", "footer", "main", "body", "html", "aside", "address",
    "blockquote", "figure", "figcaption", "form", "fieldset", "dl", "dt", "dd", "caption",
)
MAX_DEPTH = 32

#: breaks that wait for content: glued to what stands before it, none, a line, a blank line
_GLUED, _NONE, _LINE, _BLANK = -1, 0, 1, 2
_GAPS = {_LINE: "\n", _BLANK: "\n\n"}


def _both(*names: str) -> tuple[str, ...]:
    """Tags that open and that close."""
    return (*names, *("/" + name for name in names))


def _decoded(ref: re.Match) -> str:
    name = ref[1]
    if name[0] != "#":
        return _NAMES.get(name, ref[0])
    code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return chr(code) if 1 <= code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "�"


def decode_references(text: str) -> str:
    """References of a text decoded, once."""
    return _REFERENCE.sub(_decoded, text) if "&" in text else text


def attribute(tag: str, name: str) -> str | None:
    """An attribute in double, single or no quotes, decoded; ``None`` if the tag has none."""
    found = _ATTRIBUTES[name].search(tag)
    return decode_references(found[1] or found[2] or found[3] or "") if found else None


def _first_number(text: str | None) -> int:
    """What an ordered list counts from, less one; 0 for what is no number of 32 bits."""
    if text is None or not re.fullmatch(r"[\x00-\x20]*[+-]?[0-9]+[\x00-\x20]*", text):
        return 0
    number = int(text.strip("".join(map(chr, range(33)))))
    return max(number - 1, 0) if -(1 << 31) <= number < 1 << 31 else 0


class _Page:
    """What is known while the pieces of a page go by: the break, the space and the markers
    that wait; whether anything was written; open lists (the last number of an ordered one,
    -1 for another), their indent and how many more are open; ``pre``; the target of the
    open link; depth of tables, cells of the row, rows before it."""

    __slots__ = ("out", "brk", "sp", "any", "lead", "nums", "ind", "deep", "pre", "link", "tab", "cols", "rows")

    def __init__(self):
        self.out, self.nums = [], []
        self.brk, self.deep, self.tab, self.cols, self.rows = _NONE, 0, 0, 0, 0
        self.sp = self.any = self.pre = False
        self.lead = self.ind = ""
        self.link = None

    def put(self, content: str, before: bool = False, brk: int | None = None, after: int = _NONE) -> None:
        """Visible content behind the break that waits or ``brk``, with white space before it
        or not; ``after`` is the break that waits then."""
        brk = self.brk if brk is None else brk
        gap = ""
        if self.any:
            gap = _GAPS.get(brk) or (" " if brk == _NONE and (self.sp or before) else "")
        self.out.append(gap + (self.lead or (self.ind if self.any and brk > _NONE else "")) + content)
        self.any, self.brk, self.sp, self.lead = True, after, False, ""

    def at_least(self, least: int) -> int:
        """The break that waits, at least this one; none after a marker or the beginning of a link."""
        return self.brk if self.lead or self.brk == _GLUED else max(self.brk, least)

    def separate(self, brk: int) -> None:
        self.brk, self.sp = brk, False

    def fence_end(self) -> str:
        return "```" if self.sp else "\n```"

    def link_end(self) -> str:
        return f"]({self.link})"

    def row_end(self) -> str:
        return " |" + ("" if self.rows else f"\n{self.ind}|" + " --- |" * self.cols)

    def text(self, piece: str) -> None:
        piece = decode_references(piece)
        if self.pre:
            # The line break directly behind the tag does not count: ``brk`` says so.
            start = _LINE_END.match(piece) if self.brk == _LINE else None
            raw = piece[start.end():] if start else piece
            if piece:
                self.out.append(raw)
                self.brk = _NONE
                self.sp = raw.endswith("\n") if raw else self.sp
            return
        flat = _BLANKS.sub(" ", piece)
        if flat == " ":
            self.sp = True
        elif flat:
            words = flat.strip(" ")
            self.put(words.replace("|", "\\|") if self.cols else words, flat[0] == " ")
            self.sp = flat[-1] == " "

    def end_link(self) -> None:
        self.out.append(self.link_end())
        self.link, self.brk = None, max(self.brk, _NONE)

    def anchor(self, name: str, target: str | None) -> None:
        """An ``a`` opens a link if it has a target, and ends the one that is open."""
        if name == "/a" or target is None:
            if self.link is not None:
                self.end_link()
        elif self.link is None:
            self.put("[", after=_GLUED)
            self.link = target
        else:
            gap = _GAPS.get(self.brk) or (" " if self.brk == _NONE and self.sp else "")
            self.out.append(self.link_end() + gap + "[")
            self.link = target
            self.separate(_GLUED)

    def image(self, source: str | None, shown: str | None) -> None:
        if source is not None:
            self.put(f"![{shown or ''}]({source})")

    def close_row(self) -> None:
        if self.cols:
            self.out.append(self.row_end())
            self.rows, self.cols, self.lead = self.rows + 1, 0, ""
            self.separate(_LINE)

    def table(self, name: str) -> None:
        if name == "table" and not self.tab:
            self.tab, self.rows, self.cols = 1, 0, 0
            self.separate(self.at_least(_BLANK))
        elif name == "/table" and self.tab == 1:
            self.close_row()
            self.tab, self.brk = 0, _BLANK
        elif name in ("table", "/table"):
            self.tab = max(self.tab + (1 if name == "table" else -1), 0)
            self.sp = True
        elif self.tab == 1 and name in ("tr", "/tr"):
            self.close_row()
        elif self.tab == 1 and name in ("td", "th"):
            if self.cols:
                self.out.append(" |")
                self.brk, self.lead = _NONE, ""
            else:
                self.put("|")
            self.cols, self.sp = self.cols + 1, True
        else:
            self.sp = True

    def list(self, name: str, begin: str | None) -> None:
        num = self.nums[-1] if self.nums else -1
        outer_ind = self.ind[:max(len(self.ind) - (2 if num < 0 else 3), 0)]
        if name in ("ul", "ol"):
            if len(self.nums) >= MAX_DEPTH:
                self.deep += 1
                return
            brk = self.at_least(_LINE if self.nums else _BLANK)
            self.nums.append(_first_number(begin) if name == "ol" else -1)
            self.ind += "   " if name == "ol" else "  "
        elif name in ("/ul", "/ol"):
            if self.deep:
                self.deep -= 1
                return
            brk = max(self.brk, _LINE if len(self.nums) > 1 else _BLANK)
            del self.nums[-1:]
            self.ind, self.lead = outer_ind, ""
        elif name == "/li":
            brk, self.lead = max(self.brk, _LINE), ""
        else:
            brk = max(self.brk, _LINE)
            if num >= 0:
                self.nums[-1] = num + 1
            self.lead = outer_ind + (f"{num + 1}. " if num >= 0 else "- ")
        self.separate(brk)

    def heading(self, name: str) -> None:
        if name[0] == "/":
            brk, self.lead = max(self.brk, _BLANK), ""
        else:
            brk = self.at_least(_BLANK)
            if self.link is None:
                self.lead = (self.lead or self.ind) + "#" * int(name[1]) + " "
        self.separate(brk)

    def tag(self, tag: str) -> None:
        name = _NAME.match(tag)[1].lower()
        kind = _KINDS.get(name)
        if self.pre:
            if name == "/pre":
                self.out.append(self.fence_end())
                self.pre = False
                self.separate(_BLANK)
        elif kind is None:
            return
        elif kind == "link":
            self.anchor(name, attribute(tag, "href") if name == "a" else None)
        elif kind == "image":
            self.image(attribute(tag, "src"), attribute(tag, "alt"))
        elif kind == "table":
            self.table(name)
        elif self.cols:
            self.sp = True
        elif kind == "block":
            self.separate(self.at_least(_BLANK))
        elif kind == "list":
            self.list(name, attribute(tag, "start") if name == "ol" else None)
        elif kind == "heading":
            self.heading(name)
        elif name == "br":
            self.separate(self.at_least(_LINE))
        elif name == "pre":
            self.put("```\n", brk=self.at_least(_BLANK), after=_LINE)
            self.pre = self.sp = True
        elif name == "hr":
            self.put("---", brk=self.at_least(_BLANK), after=_BLANK)

    def markdown(self) -> str:
        if self.pre:
            self.out.append(self.fence_end())
        if self.link is not None:
            self.out.append(self.link_end())
        if self.cols:
            self.out.append(self.row_end())
        return "".join(self.out)


#: what a tag does; the others vanish
_KINDS = {name: kind for kind, names in {
    "link": _both("a"), "image": ("img",), "table": _both("table", "tr", "thead", "tbody", "tfoot", "td", "th"),
    "block": _both(*_BLOCKS), "list": _both("ul", "ol", "li"), "heading": _both(*(f"h{n}" for n in range(1, 7))),
    "other": ("br", "hr", *_both("pre")),
}.items() for name in names}


def markdown_of(html: str | None) -> str | None:
    """The markdown of a page, by the rules of this module."""
    if html is None:
        return None
    for pattern in _DROPPED:
        html = pattern.sub("", html)
    page = _Page()
    for i, piece in enumerate(_TAGS.split(html)):
        if i % 2:
            page.tag(piece)
        elif piece:
            page.text(piece)
    return page.markdown()


@F.arrow_udf(StringType())
def _markdown(html: pa.Array) -> pa.Array:
    return pa.array([markdown_of(page.as_py()) for page in html], pa.string())


def page_to_markdown(html: Column) -> Column:
    """The markdown of a column of pages; each batch of rows is one call."""
    return _markdown(F.translate(F.make_valid_utf8(html), MARK, STAND_IN))
