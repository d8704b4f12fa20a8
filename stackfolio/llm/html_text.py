"""HTML extraction: layout-aware rendering.

A tree builder reads tags with the usual implied ends (a paragraph ends at a block, an item at the
next item, a cell at the next cell or row), visibility rules drop what a browser does not show, and
the tree is laid out as text: blocks on lines of their own, blank lines around paragraphs, headings,
lists and tables, markers before list items, table columns aligned.

Cases: a null or empty page gives an empty text; a tag that is never closed by > is dropped with all
after it, as browsers do; stray quotes in a tag end with it at its >; elements may be nested to any depth: the tree is built and laid
out with a stack of its own, not by recursion; columns are aligned up to ``CELL`` characters, longer cells stand as they are; repeated rows are
rendered each; input columns named like the result give way.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Generator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .base import per_batch, prepare, texts_of, with_columns

CELL = 40

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes datalist param source track title area".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
BLOCKS = SPACED | frozenset(
    "html body div section article aside header footer main nav address li dt dd form figcaption details summary legend "
    "center dir menu hgroup search dialog caption option optgroup select tr thead tbody tfoot td th".split()
)
ENDS_P = BLOCKS - frozenset("html body li dt dd caption option optgroup select tr thead tbody tfoot td th legend summary".split())
# start tag: the open elements that it ends, and those at which the search stops
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th", "caption"), ("tr", "table")), "th": (("td", "th", "caption"), ("tr", "table")),
    "tr": (("tr", "caption"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption"), ("table",)),
}
HEAD_ONLY = frozenset("base link meta script style title template noscript head html".split())
SCOPE = frozenset("table td th caption html".split())
TABLE_PARTS = frozenset("table tr tbody thead tfoot".split())

# a quote opens a value right after = only, and if it is closed; elsewhere it is part of a name or value
ONE = r"""([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+("[^"]*"|'[^']*'|[^ \t\n\r\f>]*+))?+"""
ATTRIBUTE = re.compile(ONE)
TAG = re.compile(rf"""<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]++|{ONE})*+)>""")
CONCEALED = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []


def attributes_of(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(source):
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        found.setdefault(name.lower(), entities.unescape(value))
    return found


class Builder:
    """Open elements as a stack; ``read`` gives the root."""

    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # of the open elements but the root, by name

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.open))
        self.open.append(node)

    def cut(self, size: int) -> None:
        """Ends open elements until ``size`` are left."""
        while len(self.open) > size:
            self.places[self.open.pop().name].pop()

    def last(self, names) -> int:
        """Place of the innermost open element with one of the names, 0 if there is none."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def text(self, data: str) -> None:
        if data:
            if self.open[-1].name == "head" and data.strip():
                self.close_to("head")  # text belongs to the body
            self.open[-1].children.append(data)

    def close_to(self, name: str) -> None:
        self.cut(max(1, self.last((name,))))

    def end_implied(self, names, stops) -> None:
        # a row ends its cells, a section its rows: look again after each
        while (at := self.last(names)) > self.last(stops):
            self.cut(at)

    def start(self, name: str, source: str) -> None:
        if name in ("html", "body"):
            return
        if self.open[-1].name == "head" and name not in HEAD_ONLY:
            self.close_to("head")
        if name in ENDS_P:
            self.end_implied(("p",), SCOPE | {"button"})
        if name in IMPLIED:
            self.end_implied(*IMPLIED[name])
        node = Node(name, attributes_of(source) if source else {})
        self.open[-1].children.append(node)
        if name not in VOID:
            self.push(node)

    def end(self, name: str) -> None:
        at = self.last((name,))
        if not at and name in ("br", "p"):
            self.start(name, "")  # as browsers do with a lone </br> or </p>
            if name == "p":
                self.cut(len(self.open) - 1)
        elif at and (name in TABLE_PARTS or at >= self.last(SCOPE)):
            self.cut(at)

    def read(self, page: str) -> Node:
        at, lower = 0, None
        while at < len(page):
            tag = page.find("<", at)
            if tag < 0:
                self.text(entities.unescape(page[at:]))
                break
            self.text(entities.unescape(page[at:tag]))
            if page.startswith("<!--", tag):
                end = page.find("-->", tag + 4)
                at = len(page) if end < 0 else end + 3
                continue
            if page[tag + 1 : tag + 2] in ("!", "?"):
                end = page.find(">", tag)
                at = len(page) if end < 0 else end + 1
                continue
            if not re.match(r"</?[a-zA-Z]", page[tag : tag + 3]):
                self.text("<")
                at = tag + 1
                continue
            found = TAG.match(page, tag)
            if not found:
                break
            at, name = found.end(), found[2].lower()
            if found[1]:
                self.end(name)
                continue
            self.start(name, found[3])
            if name in RAW and self.open[-1].name == name:
                lower = lower or page.lower()
                end = lower.find(f"</{name}", at)
                end = len(page) if end < 0 else end
                raw = page[at:end]
                self.text(entities.unescape(raw) if name in ("title", "textarea") else raw)
                self.cut(len(self.open) - 1)
                at = page.find(">", end) + 1 or len(page)
        return self.root


def shown(node: Node) -> bool:
    a = node.attributes
    if node.name in HIDDEN or "hidden" in a or (node.name == "dialog" and "open" not in a):
        return False
    return not (node.name == "input" and a.get("type", "").lower() == "hidden") and not CONCEALED.search(a.get("style", ""))


def done(steps: Generator):
    """Result of a generator; what it yields are generators, whose results it gets."""
    stack, result = [steps], None
    while stack:
        try:
            stack.append(stack[-1].send(result))
            result = None
        except StopIteration as end:
            stack.pop()
            result = end.value
    return result


class Layout:
    """Lines of one flow: the page, or a table cell. What goes down the tree is a generator for ``done``."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # a collapsed space waits for text
        self.blank = False  # a blank line waits for text
        self.indent = 0
        self.marker = ""

    def write(self, text: str) -> None:
        """Inline text, white space collapsed."""
        words = SPACE.sub(" ", text)
        if not words:
            return
        if words[0] == " ":
            self.space = True
        body = words.strip(" ")
        if body:
            if self.space and self.line:
                self.line.append(" ")
            self.line.append(body)
            self.space = words[-1] == " "

    def flush(self) -> None:
        if self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.lines.append(" " * max(0, self.indent - len(self.marker)) + self.marker + "".join(self.line))
            self.marker, self.line, self.blank = "", [], False
        self.space = False

    def gap(self, spaced: bool) -> None:
        self.flush()
        self.blank = self.blank or spaced

    def verbatim(self, text: str) -> None:
        for i, part in enumerate(text.split("\n")):
            if i:
                self.hard_break()
            self.line += [part] if part else []

    def hard_break(self) -> None:
        if self.line:
            self.flush()
        elif self.lines and self.lines[-1]:
            self.lines.append("")

    def children(self, node: Node, pre: bool = False) -> Generator:
        number = 0
        if node.name == "ol":
            start = node.attributes.get("start", "")
            number = int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0
        only_summary = node.name == "details" and "open" not in node.attributes
        for child in node.children:
            if isinstance(child, str):
                if not only_summary:
                    self.verbatim(child) if pre else self.write(child)
            elif only_summary and child.name != "summary":
                continue
            elif shown(child):
                if child.name == "li":
                    number += 1
                yield self.node(child, pre, f"{number}. " if node.name == "ol" else "- ")

    def node(self, node: Node, pre: bool, marker: str) -> Generator:
        name = node.name
        if name == "br":
            self.hard_break()
        elif name == "hr":
            self.gap(True)
            self.line.append("----")
            self.gap(True)
        elif name == "img":
            self.write(node.attributes.get("alt", ""))
        elif name == "input":
            if node.attributes.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
                self.write(node.attributes.get("value", ""))
        elif name == "table":
            self.gap(True)
            for line in (yield table_lines(node)):
                self.line.append(line)
                self.flush()
            self.gap(True)
        elif name not in BLOCKS:
            yield self.children(node, pre or name in ("textarea", "xmp"))
        else:
            nested = name in ("ul", "ol", "dl", "menu", "dir") and self.indent > 0
            self.gap(name in SPACED and not nested)
            step = {"li": len(marker), "dd": 4, "blockquote": 2}.get(name, 0)
            self.indent += step
            if name == "li":
                self.marker = marker
            yield self.children(node, pre or name == "pre")
            self.flush()
            if name == "li":
                self.marker = ""
            self.indent -= step
            self.gap(name in SPACED and not nested)

    def result(self) -> list[str]:
        self.flush()
        lines = [x.rstrip() for x in self.lines]
        while lines and not lines[-1]:
            lines.pop()
        return lines


def table_lines(table: Node) -> Generator:
    """Caption and other text first, then a line per row with its cells in columns."""
    before = Layout()
    rows = yield table_rows(table, before)
    return before.result() + aligned([cells for _, cells in rows])


def table_rows(node: Node, before: Layout) -> Generator:
    """(row element, cells) of the rows under a table, section or row; other text goes to ``before``."""
    rows: list = []
    for child in node.children:
        if isinstance(child, str):
            before.write(child)
        elif shown(child) and child.name in ("td", "th"):
            cell = Layout()
            yield cell.children(child)
            if not rows or rows[-1][0] is not node:
                rows.append((node, []))
            span = child.attributes.get("colspan", "1")
            text = " ".join(x.strip() for x in cell.result() if x.strip())
            rows[-1][1].append((text, min(int(span), 1000) if re.fullmatch(r"[1-9]\d{0,8}", span) else 1))
        elif shown(child) and child.name in ("tr", "thead", "tbody", "tfoot"):
            rows += yield table_rows(child, before)
        elif shown(child):
            yield before.node(child, False, "- ")
    return rows


def aligned(rows: list[list[tuple[str, int]]]) -> list[str]:
    widths: dict[int, int] = {}
    for cells in rows:
        column = 0
        for text, span in cells:
            if span == 1 and len(text) <= CELL:
                widths[column] = max(widths.get(column, 0), len(text))
            column += span
    out = []
    for cells in rows:
        column, parts = 0, []
        for text, span in cells:
            parts.append(text.ljust(widths.get(column, 0) if span == 1 else 0))
            column += span
        line = "  ".join(parts).rstrip()
        if line:
            out.append(line)
    return out


def rendered(page: str) -> str:
    layout = Layout()
    done(layout.children(Builder().read(page)))
    return "\n".join(layout.result())


def extracted(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """The rows with their visible text."""
    prepare(pages.sparkSession)
    pages = pages.drop(*[c for c in (text,) if c != html])

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [rendered(p.decode("utf-8", "replace")) for p in texts_of(batch.column(html))]
        return with_columns(batch, {text: pa.array(out, pa.string())})

    return pages.mapInArrow(per_batch(add), T.StructType([*pages.schema, T.StructField(text, T.StringType())]))
