"""HTML extraction: layout-aware rendering of all visible text.

A tree builder keeps the stack of open elements and applies the implied tags
(end tags of paragraphs, list items, table cells, options; a row around a bare
cell).  It drives a renderer that skips what is invisible and lays out the
rest: blocks on lines of their own, blank lines around paragraphs, headings,
lists and tables, list markers with indentation, preformatted text as it is,
and table cells aligned in columns.

Visibility: script, style, template, head, noscript and similar elements, the
``hidden`` attribute, ``display: none``, closed dialogs and hidden inputs hide
their whole subtree; ``visibility: hidden`` hides text until a descendant sets
it back.  Nothing else is left out: navigation and footers are visible text.
Formulas (MathML) and the text elements of SVG are inline text, their parts a
space apart; annotations, titles, descriptions and definitions are not shown
(SVG ``use`` is not followed).

Bounds: elements are laid out up to the depth ``MAX_DEPTH`` (deeper ones only
keep their lines apart; their text and its visibility stay); column padding stops at ``MAX_PAD`` characters, longer cells are
written whole.

Defined results: null and empty pages give an empty text; rows are independent,
so null and repeated ids do not matter; cells that overlap by their spans keep
the columns of both; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from heapq import merge
from html import unescape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DEPTH = 512
MAX_PAD = 60
MAX_SPAN = 1000

#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas "
                   "datalist meta link base area param source track col colgroup rp".split())
SVG_UNSEEN = frozenset("desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split())
MATH_TOKENS = frozenset("mi mn mo ms mtext".split())
#: The children of these lie beside or above each other.
MATH_SPACED = frozenset("mfrac msup msub msubsup munder mover munderover mroot mmultiscripts mtr mtable".split())
#: A start tag that ends an open svg or math element.
LEAVES_FOREIGN = frozenset("b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing "
                           "menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
                     "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary "
                     "table ul dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PADDED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre figure table hr fieldset".split())
BLOCK = CLOSES_P | PADDED | frozenset("html body li option optgroup legend caption tr select button textarea".split())
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
TABLE_PARTS = SECTIONS | CELLS | frozenset(("tr", "caption", "col", "colgroup"))
#: A start tag ends the open elements on the right, up to the nearest barrier.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "table", "td", "th")),
    "dt": (("dt", "dd"), ("dl", "table", "td", "th")),
    "dd": (("dt", "dd"), ("dl", "table", "td", "th")),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("optgroup", "option"), ("select", "datalist")),
    "tr": (("tr", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "caption": (("caption",), ("table",)),
}

_TOKEN = re.compile(
    r"<(?:(?P<start>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|/(?P<end>[A-Za-z][^\s/>]*)[^>]*+>"
    r"|!--(?:>|->|(?s:.*?)(?:--!?>|\Z))"
    r"|[!?/][^>]*+(?:>|\Z)"
    r"|(?P<odd>[A-Za-z][^\s/>]*)[^>]*+(?:>|\Z))")
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)")
_NOTABLE = re.compile(r"hidden|style|open|type|span|start|value|display|visibility", re.I)
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+\Z")


def attributes(text: str) -> dict[str, str]:
    """The attributes that matter here; the first of a name counts."""
    found: dict[str, str] = {}
    if _NOTABLE.search(text):
        for name, a, b, c in _ATTR.findall(text):
            found.setdefault(name.lower(), unescape(a or b or c))
    return found


def _number(text: str | None, least: int, most: int, otherwise: int) -> int:
    try:
        return max(least, min(most, int((text or "").strip()[:9])))
    except ValueError:
        return otherwise


class Flow:
    """Lines of one block context (the page, or one table cell)."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False          # a collapsed space waits for the next word
        self.gap = False            # a blank line waits for the next line
        self.indents: list[str] = []
        self.marker = ""

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s[0] == " ":
            self.space = True
            s = s[1:]
        if not s:
            return
        tail = s[-1] == " "
        if self.space and self.line:
            self.line.append(" ")
        self.line.append(s[:-1] if tail else s)
        self.space = tail

    def raw(self, s: str) -> None:
        """Preformatted text: line ends and spaces count."""
        first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self.line.append(first)
        for part in rest:
            self.newline()
            if part:
                self.line.append(part)

    def newline(self) -> None:
        self._put("".join(self.line))
        self.line, self.space = [], False

    def block(self, padded: bool = False) -> None:
        if self.line:
            self.newline()
        self.space = False
        self.gap |= padded

    def _put(self, line: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        lead = "".join(self.indents)
        if self.marker:
            lead, self.marker = lead[:len(lead) - len(self.marker)] + self.marker, ""
        self.lines.append((lead + line).rstrip())

    def done(self) -> list[str]:
        self.block()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Table:
    """Cells by row; rows that a cell spans downward are kept as intervals of
    columns, so a span costs the same however wide and long it is."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []   # (column, columns spanned, lines)
        self.spans: list[tuple[int, int, int]] = []              # (first column, end, last row), by column
        self.fresh: list[tuple[int, int, int]] = []              # those that begin in this row
        self.at = 0                                              # the next of ``spans`` to step over
        self.column = 0

    def row(self) -> None:
        if self.fresh:
            self.spans = self._joined(self.spans, self.fresh)
            self.fresh = []
        self.at = self.column = 0
        self.rows.append([])

    def _joined(self, *spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The spans that reach the next row, neighbours of one end as one."""
        out: list[tuple[int, int, int]] = []
        for first, end, last in merge(*spans):
            if last < len(self.rows):
                continue
            if out and out[-1][1] >= first and out[-1][2] == last:
                out[-1] = (out[-1][0], max(end, out[-1][1]), last)
            else:
                out.append((first, end, last))
        return out

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        here = len(self.rows) - 1
        while self.at < len(self.spans) and self.spans[self.at][0] <= self.column:
            if self.spans[self.at][2] >= here:
                self.column = max(self.column, self.spans[self.at][1])
            self.at += 1
        self.rows[-1].append((self.column, across, lines))
        if down > 1:
            self.fresh.append((self.column, self.column + across, here + down - 1))
        self.column += across

    def layout(self) -> list[str]:
        """Rows of cells under each other, columns two spaces apart."""
        widths: Counter = Counter()
        for row in self.rows:
            for column, across, lines in row:
                if across == 1:
                    widths[column] = max(widths[column], min(MAX_PAD, max(map(len, lines), default=0)))
        used = sorted(widths)
        starts, at = {}, 0
        for column in used:
            starts[column] = at
            at += widths[column] + 2
        out = []
        for row in self.rows:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                parts, length = [], 0
                for column, _, lines in row:
                    piece = lines[k] if k < len(lines) else ""
                    if not piece:
                        continue
                    start = starts.get(column, at)
                    pad = max(start - length, 2 if parts else 0)
                    parts.append(" " * pad + piece)
                    length += pad + len(piece)
                out.append("".join(parts).rstrip())
        return out


class Element:
    __slots__ = ("tag", "attrs", "unseen", "blank", "pre", "foreign", "count")

    def __init__(self, tag, attrs, unseen, blank, pre, foreign=""):
        self.foreign = foreign      # "math", "svg" (draws no text), or "text" inside svg
        self.tag, self.attrs, self.unseen, self.blank, self.pre = tag, attrs, unseen, blank, pre
        self.count = _number(attrs.get("start"), -10**8, 10**8, 1) if tag == "ol" else 0


class Renderer:
    """Open elements, implied tags, and the text laid out so far."""

    def __init__(self):
        self.root = Element("html", {}, False, False, False)
        self.stack = [self.root]
        self.open_tags: Counter = Counter()
        self.flows = [Flow()]
        self.tables: list[Table] = []
        self.over: list[Element] = []                            # open elements beyond MAX_DEPTH
        self.over_at: dict[str, list[int]] = {}                  # tag -> its places in ``over``

    @property
    def top(self) -> Element:
        return self.over[-1] if self.over else self.stack[-1]

    # -- the tree ------------------------------------------------------------

    def start(self, tag: str, attr_text: str) -> None:
        if tag in ("html", "body", "frameset"):
            if self.open_tags["head"]:
                self.pop_to("head")
            return
        if self.open_tags["head"] and tag not in UNSEEN and tag not in RAW:
            self.pop_to("head")
        if tag in LEAVES_FOREIGN and self.top.tag not in MATH_TOKENS:
            while self.top.foreign:
                self.pop_top()
        if tag in TABLE_PARTS:
            if not self.open_tags["table"] and not self.over_at.get("table"):
                return                                    # no table to belong to
            if not self.over_at.get("table"):
                self._table_context(tag)
        elif tag in CLOSES_P:
            self._implied(("p",), ("table", "td", "th", "caption", "button", "object"))
        if tag in IMPLIED_END:
            self._implied(*IMPLIED_END[tag])
        elif tag in HEADINGS and self.top.tag in HEADINGS:
            self.pop_top()
        foreign = self.top.foreign
        self.push(tag, attributes(attr_text) if attr_text else {})
        if (foreign or tag in ("svg", "math")) and self.self_closed(attr_text) and self.top.tag == tag:
            self.pop_top()

    @staticmethod
    def self_closed(attr_text: str) -> bool:
        return attr_text.endswith("/") and not _UNQUOTED.search(attr_text)

    def pop_top(self) -> None:
        if self.over:
            self._cut(len(self.over) - 1)
        else:
            self.pop()

    def _cut(self, size: int) -> None:
        """End the elements beyond MAX_DEPTH but the first ``size``."""
        lines = False
        while len(self.over) > size:
            e = self.over.pop()
            self.over_at[e.tag].pop()
            lines |= not e.unseen and (e.tag in BLOCK or e.tag in TABLE_PARTS)
        if lines:
            self.flow.block()

    def _wall(self, barriers) -> int:
        return max((at[-1] for t in barriers if (at := self.over_at.get(t))), default=-1)

    def _implied(self, tags, barriers) -> None:
        if self.over:
            wall = self._wall(barriers)
            first = [at[i] for t in tags if (at := self.over_at.get(t)) and (i := bisect_right(at, wall)) < len(at)]
            if first:
                self._cut(min(first))
            if first or wall >= 0:
                return
        self.close_until(tags, barriers)

    def _table_context(self, tag: str) -> None:
        if tag in CELLS:
            if not self._inside("tr"):
                self.push("tr", {})
        elif tag not in ("col", "colgroup", "caption"):
            # a row or section ends the cell and the row before it
            self.close_until(("tr", *CELLS) if tag in SECTIONS or tag == "tr" else (), ("table",))
            if tag in SECTIONS:
                self.close_until(tuple(SECTIONS), ("table",))

    def _inside(self, tag: str) -> bool:
        for e in reversed(self.stack):
            if e.tag == tag:
                return True
            if e.tag == "table":
                return False
        return False

    def close_until(self, tags, barriers) -> None:
        """End the outermost open element of ``tags`` that no barrier hides."""
        if not any(self.open_tags[t] for t in tags):
            return
        found = 0
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in barriers:
                break
            if self.stack[i].tag in tags:
                found = i
        if found:
            while len(self.stack) > found:
                self.pop()

    def end(self, tag: str) -> None:
        if tag == "br":
            self.push("br", {})
            return
        if self.over:
            own = tag in ("table", "tr") or tag in SECTIONS or tag in CELLS
            wall = self._wall(("table",) if own else ("td", "th", "table", "caption"))
            at = self.over_at.get(tag)
            if at and at[-1] >= wall:
                self._cut(at[-1])
                return
            if wall >= 0:
                return
        if tag == "p" and not self.open_tags["p"]:
            self.flow.block(True) if not self.top.unseen else None
        elif self.open_tags[tag]:
            # an end tag does not reach out of its table cell
            barrier = () if tag in ("table", "tr") or tag in SECTIONS or tag in CELLS else ("td", "th", "table", "caption")
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == tag:
                    while len(self.stack) > i:
                        self.pop()
                    return
                if self.stack[i].tag in barrier or (self.stack[i].tag == "table" and tag != "table"):
                    return

    def pop_to(self, tag: str) -> None:
        while len(self.stack) > 1:
            if self.pop() == tag:
                return

    # -- the layout ----------------------------------------------------------

    @property
    def flow(self) -> Flow:
        return self.flows[-1]

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        up = self.top
        foreign = up.foreign
        unseen, blank = up.unseen or tag in UNSEEN or "hidden" in attrs, up.blank
        if "style" in attrs:
            for name, value in _STYLE.findall(attrs["style"].lower()):
                if name == "display":
                    unseen |= value == "none"
                else:
                    blank = value in ("hidden", "collapse")
        if tag == "dialog" and "open" not in attrs:
            unseen = True
        if tag in ("svg", "math"):
            foreign = tag
        elif foreign == "math":
            unseen |= tag in ("annotation", "annotation-xml")
            blank |= tag == "mphantom"
            if up.tag in MATH_TOKENS:
                foreign = ""
        elif foreign:
            unseen |= tag in SVG_UNSEEN or attrs.get("display", "").strip() == "none"
            if "visibility" in attrs:
                blank = attrs["visibility"].strip() in ("hidden", "collapse")
            foreign = "" if tag == "foreignobject" else "text" if tag == "text" else foreign
        e = Element(tag, attrs, unseen, blank, up.pre or tag in ("pre", "textarea", "xmp"), foreign)
        if not unseen and (tag in ("svg", "text") and foreign or foreign == "math" and up.tag in MATH_SPACED):
            self.flow.space = True
        if tag not in VOID and len(self.stack) > MAX_DEPTH:
            if not unseen and (tag in BLOCK or tag in TABLE_PARTS):
                self.flow.block()
            self.over_at.setdefault(tag, []).append(len(self.over))
            self.over.append(e)
            return
        if not unseen:
            self._enter(e)
        if tag not in VOID:
            self.stack.append(e)
            self.open_tags[tag] += 1

    def _enter(self, e: Element) -> None:
        tag, flow = e.tag, self.flow
        if tag == "br":
            flow.newline()
        elif tag == "math" and e.attrs.get("display") == "block":
            flow.block()
        elif tag == "table":
            flow.block(True)
            self.tables.append(Table())
        elif tag == "tr":
            if self.tables:
                self.tables[-1].row()
        elif tag in CELLS or tag == "caption":
            self.flows.append(Flow())
        elif tag in BLOCK:
            nested = tag in ("ul", "ol") and self.open_tags["li"] > 0
            flow.block(tag in PADDED and not nested)
            if tag == "li":
                self._item(e)
            elif tag in ("dd", "blockquote"):
                flow.indents.append("  ")

    def _item(self, e: Element) -> None:
        marker = "- "
        for up in reversed(self.stack):
            if up.tag == "ol":
                number = _number(e.attrs.get("value"), -10**8, 10**8, up.count)
                up.count = number + 1
                marker = f"{number}. "
                break
            if up.tag in ("ul", "menu", "dir", "table"):
                break
        self.flow.indents.append(" " * len(marker))
        self.flow.marker = marker

    def pop(self) -> str:
        self._cut(0)
        e = self.stack.pop()
        self.open_tags[e.tag] -= 1
        if not e.unseen:
            self._leave(e)
        return e.tag

    def _leave(self, e: Element) -> None:
        tag = e.tag
        if tag == "math" and e.attrs.get("display") == "block":
            self.flow.block()
        elif tag in ("svg", "text") and e.foreign or tag in MATH_SPACED and e.foreign == "math":
            self.flow.space = True
        elif tag == "table":
            lines = self.tables.pop().layout()
            self._lines(lines)
            self.flow.block(True)
        elif tag in CELLS and len(self.flows) > 1:
            lines = self.flows.pop().done()
            if self.tables:
                self.tables[-1].cell(lines, _number(e.attrs.get("colspan"), 1, MAX_SPAN, 1),
                                     _number(e.attrs.get("rowspan"), 1, MAX_SPAN, 1))
            else:
                self._lines(lines)
        elif tag == "caption" and len(self.flows) > 1:
            self._lines(self.flows.pop().done())
        elif tag in BLOCK and tag != "tr":
            nested = tag in ("ul", "ol") and self.open_tags["li"] > 0
            self.flow.block(tag in PADDED and not nested)
            if tag in ("li", "dd", "blockquote") and self.flow.indents:
                self.flow.indents.pop()
                if tag == "li":
                    self.flow.marker = ""

    def _lines(self, lines: list[str]) -> None:
        self.flow.block()
        for line in lines:
            self.flow.line.append(line)
            self.flow.newline()

    def text(self, s: str, literal: bool = False) -> None:
        e = self.top
        if e.foreign == "svg":
            return                                       # shapes and groups draw no text
        if e.unseen or e.blank or not s:
            if not (e.unseen or not s) and self.flow.line:
                self.flow.space = True
            return
        if "&" in s and not literal:
            s = unescape(s)
        if e.pre:
            self.flow.raw(s)
            return
        if e.tag in ("table", "tr") or e.tag in SECTIONS:
            if not s.strip():
                return                                   # between cells
        self.flow.text(s)

    def finish(self) -> str:
        while len(self.stack) > 1:
            self.pop()
        while len(self.flows) > 1:
            lines = self.flows.pop().done()
            self._lines(lines)
        return "\n".join(self.flow.done()).replace("\xa0", " ")


def render(html: str | None) -> str:
    """All visible text of a page, laid out."""
    if not html:
        return ""
    page = Renderer()
    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            page.text(html[at:])
            break
        if m.start() > at:
            page.text(html[at:m.start()])
        at = m.end()
        if page.top.foreign and html.startswith("<![CDATA[", m.start()):
            stop = html.find("]]>", m.start())
            page.text(html[m.start() + 9:stop if stop >= 0 else size], True)
            at = stop + 3 if stop >= 0 else size
            continue
        tag = m["start"] or m["odd"]
        if tag:
            tag = tag.lower()
            foreign = page.top.foreign
            page.start(tag, m["attrs"] or "")
            if tag in RAW and not (foreign and page.self_closed(m["attrs"] or "")):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
                end = stop.start() if stop else size
                page.text(html[at:end])
                at = end
        elif m["end"]:
            page.end(m["end"].lower())
    return page.finish()


@F.pandas_udf(T.StringType())
def rendered(pages: pd.Series) -> pd.Series:
    return pd.Series([render(p) for p in pages], dtype=object)
