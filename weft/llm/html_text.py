"""HTML to text by a layout-aware rendering of the element tree.

A tree builder reads the page with implied tags (a paragraph ends where a block
begins, list items, table cells and rows, options and definition terms end at the
next of their kind) and tolerates stray and missing end tags.  The renderer walks
the tree with visibility rules (head, script, style, template, hidden attributes
and inline ``display:none`` or ``visibility:hidden`` give nothing) and emits *all*
visible text: navigation and footers too.  White space collapses except in
``pre`` and ``textarea``; blocks begin on new lines, paragraphs and headings stand
between blank lines; list items carry a bullet or number and an indent by depth;
table cells are padded to the width of their column and joined by two blanks; cells
that span columns or rows keep their places.
Formulas and the text of drawings are visible.  Elements may nest to any depth: the
tree is walked with an explicit stack, open elements are found by tag.

One page is one row: a single pass without a shuffle, memory bounded by a batch.
Defined cases: a null page gives null text; an empty page or one without visible
text gives an empty string; broken markup is text or is skipped, never an error; a
colspan above 1000 is 1000 and a rowspan of 0 reaches to the end of its row group, as
the HTML standard reads them; an empty table of pages gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import textblock as tb

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript iframe object canvas audio video datalist title annotation annotation-xml".split())
#: Parts of a drawing that are not drawn where they stand.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split())
BLOCK = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
#: A start tag closes an open element of the set, looking no further up than a boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
    "a": ({"a"}, {"td", "th", "table"}),
}
CLOSES["thead"] = CLOSES["tfoot"] = CLOSES["tbody"]
_PARAGRAPH_ENDS = BLOCK - {"dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "body", "html"}
_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_WALLS = ("td", "th", "table")


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def hidden(self) -> bool:
        """Whether the element renders nothing."""
        return self.tag in HIDDEN or "hidden" in self.attrs or (self.tag == "input" and self.attrs.get("type") == "hidden") or self.attrs.get("aria-hidden") == "true" or bool(_STYLE.search(self.attrs.get("style") or ""))


class TreeBuilder(HTMLParser):
    """Builds the element tree with implied tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}

    def _last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of the tags; 0: none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _cut(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()

    def _foreign(self) -> bool:
        return self._last(("svg", "math")) > self._last(("foreignobject",))

    def _close(self, tags: set, bounds: set) -> None:
        last = self._last(tags)
        if last and last > self._last(bounds):
            while last > 1 and self.open[last - 1].tag in tags and self.open[last - 1].tag not in bounds:
                last -= 1
            self._cut(last)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        """Close what the tag implies and open the element."""
        if tag in _PARAGRAPH_ENDS:
            self._close({"p"}, {"table", "td", "th", "li", "button", "object"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in BLOCK and tag not in ("html", "head") and self.open[-1].tag == "head":
            self._cut(len(self.open) - 1)
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.handle_starttag("tr", [])
        node = Node(tag, {k: v or "" for k, v in attrs})
        if tag in UNDRAWN and self.places.get("svg") and self._foreign():
            node.attrs["hidden"] = ""
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """A slash in a start tag means nothing in HTML, and ends the element in drawings and formulas."""
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self._foreign():
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        """Close the nearest such element; cells are a wall for tags opened outside."""
        if tag == "br":
            self.handle_starttag("br", [])
            return
        last = self._last((tag,))
        if last and (tag in ("table", "tr", "tbody", "thead", "tfoot") or last >= self._last(_WALLS)):
            self._cut(last)
            return
        if tag == "p":  # an end without a start is an empty paragraph
            self.open[-1].children.append(Node("p", {}))

    def handle_data(self, data: str) -> None:
        """Text goes to the innermost open element."""
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    """The element tree of a page."""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


#: Columns that margins of nested lists, and places of table cells, grow to; text further in or right stays whole.
MARGIN, ALIGNED = 160, 2000


class _Part:
    """Lines that a mark stands before: it opens the first one, the others are indented by its width."""

    def __init__(self, mark: str, lines: list) -> None:
        self.mark, self.lines = mark, lines


def _flat(lines: list) -> list[str]:
    """Lines with their marks and margins, written once whatever the depth; a margin grows to ``MARGIN`` columns."""
    out: list[str] = []
    marks: list[str] = []  # of parts whose first line is still to come
    indent, parts = 0, [(iter(lines), 0)]
    while parts:
        line = next(parts[-1][0], None)
        if line is None:
            indent -= parts.pop()[1]
        elif isinstance(line, _Part):
            marks.append(line.mark)
            parts.append((iter(line.lines), len(line.mark)))
        else:
            front = " " * min(indent, MARGIN) + "".join(marks)
            out.append(front + line if line or not front.isspace() else "")
            indent += sum(map(len, marks))
            marks.clear()
    return out


class _Lines:
    """Lines under construction; ``gap`` blank lines are owed before the next text."""

    def __init__(self) -> None:
        self.lines: list[str | _Part] = []
        self.text, self.space, self.gap, self.mark = "", False, 0, ""

    def flush(self, gap: int = 0) -> None:
        line = self.text.rstrip(" ")
        if line:
            if self.lines:
                self.lines += [""] * self.gap
            self.lines.append(line)
            self.gap = 0
        self.text, self.space = "", False
        self.gap = max(self.gap, gap)

    def put(self, piece: str) -> None:
        flat = _SPACE.sub(" ", piece)
        body = flat.strip(" ")
        if not body:
            self.space = self.space or bool(flat)
            return
        if self.text and (self.space or flat[0] == " "):
            self.text += " "
        if self.mark and not self.text:
            self.text, self.mark = self.mark, ""
        self.text += body
        self.space = flat[-1] == " "

    def raw(self, piece: str) -> None:
        first, *rest = piece.split("\n")
        self.text += first
        for line in rest:
            if self.lines and self.text.strip() and self.gap:
                self.lines += [""] * self.gap
                self.gap = 0
            self.lines.append(self.text.rstrip())
            self.text = line

    def block(self, lines: list[str | _Part], gap: int) -> None:
        self.flush(gap)
        if lines:
            if self.lines:
                self.lines += [""] * self.gap
            self.lines += lines
            self.gap = gap


#: Part of the rendering: yields the parts it needs, is sent what they return.
Step = Generator["Step", object, object]


def _run(step: Step) -> object:
    """What a step returns; the steps under way are a list, so that depth is not bounded by Python's stack."""
    steps, value = [step], None
    while steps:
        try:
            steps.append(steps[-1].send(value))
            value = None
        except StopIteration as end:
            steps.pop()
            value = end.value
    return value


def _digits(node: Node, name: str, other: int, most: int) -> int:
    """A whole number of an attribute, ``most`` where it is larger, ``other`` where it is none."""
    digits = node.attrs.get(name, "")
    if not (digits.isascii() and digits.isdecimal()):
        return other
    digits = digits.lstrip("0") or "0"
    return most if len(digits) > 9 else min(most, int(digits))


def _placed(rows: list[tuple[int, list]]) -> Iterator[list[tuple[int, list[str]]]]:
    """Cells of every row with their first column; a cell that spans rows keeps its columns in the next ones of its row group.

    Spans are intervals, so their width costs nothing; neighbours that end together are one.
    """
    group, taken = -1, []  # (first column, column behind, row behind)
    for at, (own, row) in enumerate(rows):
        if own != group:
            group, taken = own, []
        taken = [t for t in taken if t[2] > at]
        column = behind = i = 0
        out: list[tuple[int, list[str]]] = []
        for lines, wide, high in row:
            while True:
                while i < len(taken) and taken[i][0] <= column:
                    behind = max(behind, taken[i][1])
                    i += 1
                if behind <= column:
                    break
                column = behind
            out.append((column, lines))
            if high > 1:
                taken.append((column, column + wide, min(at + high, len(rows))))
            column += wide
        merged: list[tuple[int, int, int]] = []
        for first, end, last in sorted(taken):
            if merged and merged[-1][2] == last and first <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]), last)
            else:
                merged.append((first, end, last))
        taken = merged
        yield out


def _table(node: Node, pre: bool) -> Step:
    rows, captions, groups = [], [], 0

    def collect(at: Node, group: int) -> Step:
        nonlocal groups
        for child in at.children:
            if isinstance(child, str) or child.hidden():
                if isinstance(child, str) and child.strip():
                    captions.append(_SPACE.sub(" ", child).strip())
                continue
            if child.tag == "tr":
                row = []
                for c in child.children:
                    if isinstance(c, str):
                        if c.strip():
                            row.append(([_SPACE.sub(" ", c).strip()], 1, 1))
                    elif not c.hidden():
                        lines = _flat((yield _render(c, pre)).lines) or [""]
                        row.append((lines, max(1, _digits(c, "colspan", 1, 1000)), _digits(c, "rowspan", 1, 65534) or 65534))
                rows.append((group, row))
            elif child.tag in ("thead", "tbody", "tfoot"):
                groups += 1
                yield collect(child, groups)
            else:
                captions.extend(_flat((yield _render(child, pre)).lines))

    yield collect(node, 0)
    cells = list(_placed(rows))
    # columns in which a cell starts, and where they stand: behind the widest cells before and two places a column
    columns = sorted({j for row in cells for j, _ in row})
    width = dict.fromkeys(columns, 0)
    for row in cells:
        for j, cell in row:
            width[j] = max(width[j], *map(len, cell))
    place, x = {}, 0
    for j in columns:
        place[j] = min(x + 2 * j, ALIGNED)
        x += width[j]
    out = captions
    for row in cells:
        lines: list[list[tuple[int, str]]] = [[]]
        for j, cell in row:
            for k, text in enumerate(cell):
                if k == len(lines):
                    lines.append([])
                if text:
                    lines[k].append((place[j], text))
        for k, pieces in enumerate(lines):
            line, size = [], 0
            for at, text in pieces:
                gap = max(at - size, 2 if size else 0)
                line += [" " * gap, text]
                size += gap + len(text)
            whole = "".join(line).rstrip()
            if whole or (k == 0 and row):
                out.append(whole)
    while out and not out[-1]:
        out.pop()
    return out


def _render(node: Node, pre: bool = False, depth: int = 0) -> Step:
    out = _Lines()
    yield _walk(node, out, pre, depth)
    out.flush()
    return out


def _walk(node: Node, out: _Lines, pre: bool, depth: int) -> Step:
    number = _digits(node, "start", 1, 2**31 - 1) if node.tag == "ol" else 1
    for child in node.children:
        if isinstance(child, str):
            (out.raw if pre else out.put)(child)
            continue
        if child.hidden():
            continue
        tag = child.tag
        if tag == "br":
            line = out.text
            out.flush()
            if not line and out.lines:
                out.gap = max(out.gap, 1)
            continue
        if tag == "img":
            out.put(child.attrs.get("alt", ""))
            continue
        if tag == "input":
            if child.attrs.get("type", "text") in ("submit", "button", "reset", "text"):
                out.put(f" {child.attrs.get('value', '')} ")
            continue
        gap = 1 if tag in SPACED and not (tag in ("ul", "ol") and depth) else 0
        if tag == "table":
            out.block((yield _table(child, pre)), 1)
        elif tag in ("ul", "ol", "menu"):
            out.flush(gap)
            inner = yield _render(child, pre, depth + 1)
            out.block(inner.lines, gap)
        elif tag == "li":
            out.flush()
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            inner = yield _render(child, pre, depth)
            out.block([_Part(mark, inner.lines or [""])], 0)
        elif tag in ("pre", "textarea"):
            inner = _Lines()
            yield _walk(child, inner, True, depth)
            inner.lines.append(inner.text.rstrip())
            lines = inner.lines
            while lines and not lines[0]:
                lines.pop(0)
            while lines and not lines[-1]:
                lines.pop()
            out.block(lines, 1)
        elif tag in BLOCK or tag == "text":  # a text of a drawing has its own place
            out.flush(gap)
            if tag == "dd":
                lines = (yield _render(child, pre, depth)).lines
                out.block([_Part("  ", lines)] if lines else [], 0)
            else:
                yield _walk(child, out, pre, depth)
            out.flush(gap)
        else:
            yield _walk(child, out, pre, depth)


def render(html: str | None) -> str | None:
    """All visible text of a page in its layout."""
    if html is None:
        return None
    return "\n".join(_flat(_run(_render(tree(html))).lines))


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """Add the visible text of every page as ``into``; all other columns stay, one of that name is replaced."""

    @F.pandas_udf(T.StringType())
    def rendered(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            with tb.watched(int(column.str.len().sum() or 0)):
                found = column.map(render, na_action="ignore").astype(object)
            yield found

    tb.arrow_batches(pages.sparkSession)
    return pages.select(*[pages[c] for c in pages.columns if c != into], rendered(pages[html].cast("string")).alias(into))
