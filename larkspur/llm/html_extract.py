"""Visible text of web pages by layout: a tree builder with implied tags, then a renderer.

Each page is one row's work inside a task; nothing is gathered.  The tree builder
closes elements that HTML lets authors leave open (p, li, dt, dd, option, table
parts) and ignores stray end tags; it keeps no more state than the open elements.
Visibility: head, script, style, template and the like, ``hidden``, ``display:none``,
``visibility:hidden`` and hidden inputs are not rendered.  The text in math and svg is,
but for what only names or defines (annotation, title, desc, defs, metadata and the
like); a text of an svg stands on a line of its own, and parts of a fraction, root or
matrix apart.  The fallback of object is rendered, as nothing is loaded that could
stand for it; those of video, audio and canvas are not, as browsers show the medium or
the drawing, nor that of iframe and noscript, which browsers do not read.  Blocks stand apart by one
newline, or by a blank line where browsers leave a margin; list items carry their
mark and depth; ``pre`` keeps its white space; table cells are padded to columns, but in
tables inside more than ALIGNED others, where cells follow each other as blocks.

Defined results: a null or empty page gives an empty text; bare text is rendered as
it stands; a page of any length or depth is rendered whole; null ids stay null; repeated rows are rendered each by itself; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link base datalist iframe canvas audio video".split())
#: Within svg and math, these only name or define; what use elements repeat is not followed.
UNDRAWN = frozenset("title desc defs metadata annotation annotation-xml symbol clippath mask marker pattern lineargradient radialgradient filter".split())
#: Within svg and math, elements that hold HTML again.
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: Within svg and math, these start a line; and the children of these stand apart.
FOREIGN_BLOCK = frozenset("text foreignobject mtr mlabeledtr".split())
APART = frozenset("mfrac mroot mtr mlabeledtr munder mover munderover".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset hr".split())
BLOCK = SPACED | frozenset(
    "html body div article section nav header footer main aside address li dt dd form details summary figcaption caption thead tbody tfoot tr td th legend option optgroup select hgroup center dialog".split()
)
#: An opening tag closes these open elements, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: These close an open paragraph.
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "li", "option", "optgroup", "caption", "thead", "tbody", "tfoot"}
#: In svg or math these end it, as HTML that follows one left open.
BREAKS_OUT = (ENDS_P - {"details", "summary", "legend"}) | frozenset("b big br code em i img li s small span strike strong sub sup tt u var".split())
#: A new block closes an open paragraph no further out than these.
P_SCOPE = frozenset("td th button caption table".split())
_UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


#: Tables nested deeper are not aligned: their cells follow each other as blocks.
ALIGNED = 20
#: Their content is text up to their own end tag.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_TAG = re.compile(r"""<(?:!--(?s:.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[!?/][^>]*>)""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")  # a tag whose quotes do not pair
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Only these matter to the layout.
_USED = re.compile(r"hidden|style|type|alt|value|start|colspan|display", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children", "foreign")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.children = tag, {}, []
        self.foreign = tag in ("svg", "math") or parent is not None and parent.holds_foreign()
        if attrs and _USED.search(attrs):
            for name, *values in _ATTR.findall(attrs):
                self.attrs.setdefault(name.lower(), unescape("".join(values)))

    def holds_foreign(self) -> bool:
        return self.foreign and self.tag not in HOLDS_HTML

    def visible(self) -> bool:
        a = self.attrs
        if self.foreign and (self.tag in UNDRAWN or a and (a.get("display") == "none" or a.get("visibility") == "hidden")):
            return False
        if self.tag in HIDDEN:
            return False
        return not a or not ("hidden" in a or self.tag == "input" and a.get("type", "").lower() == "hidden" or _UNSEEN_STYLE.search(a.get("style", "")))


class TreeBuilder:
    def __init__(self):
        self.root = Node("#root")
        self.open = [self.root]
        self.n: Counter[str] = Counter()  # open elements by tag, so that none is looked for in vain

    def feed(self, html: str) -> None:
        at, tagged, comment = 0, None, html.rfind("<!--")
        while True:
            start = html.find("<", at)
            if start < 0 or start > comment and html.find(">", start) < 0:
                break
            if tagged is None or tagged.start() < at:  # else the one found before is still the next
                tagged = _TAG.search(html, at)
            m = tagged
            if m is None or 0 <= start < m.start():
                loose = _LOOSE.search(html, at)
                if loose and (m is None or loose.start() < m.start()):
                    m = loose
            if m is None:
                break
            if m.start() > at:
                self._data(html[at : m.start()])
            at = m.end()
            tag = m.lastindex and m[2]
            if not tag:
                continue
            tag = tag.lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW and not self.open[-1].foreign:
                end = re.compile(f"</{tag}[\\s/>]|\\Z", re.I).search(html, at)
                if tag in ("textarea", "xmp") and end.start() > at:
                    self._data(html[at : end.start()])
                at = end.start()
        if at < len(html):
            self._data(html[at:])

    def _data(self, text: str) -> None:
        self.open[-1].children.append(unescape(text) if "&" in text else text)

    def _leave(self, i: int) -> None:
        self.n.subtract(x.tag for x in self.open[i:])
        del self.open[i:]

    def _close(self, tags, until) -> None:
        if not any(self.n[t] > 0 for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in until:
                return
            if tag in tags:
                self._leave(i)
                return self._close(tags, until)

    def _start(self, tag: str, attrs: str) -> None:
        while tag in BREAKS_OUT and self.open[-1].holds_foreign():
            self._leave(len(self.open) - 1)
        if tag in ENDS_P:
            self._close({"p"}, P_SCOPE)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        node = Node(tag, attrs, self.open[-1])
        self.open[-1].children.append(node)
        if not (attrs.endswith("/") if node.foreign else tag in VOID):
            self.open.append(node)
            self.n[tag] += 1

    def _end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br"))
        if self.n[tag] <= 0:
            return
        for i in range(len(self.open) - 1, 0, -1):
            here = self.open[i].tag
            if here == tag:
                self._leave(i)
                return
            if here in ("table", "td", "th") and tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "body", "html"):
                return  # a stray end tag does not leave its cell


class _Out:
    """Lines in the making: text flows into the last line, breaks are merged."""

    def __init__(self, depth: int = 0):
        self.depth = depth  # tables around
        self.lines: list[str] = [""]
        self.blank = False  # a blank line is due before the next text
        self.indent = ""
        self.mark = ""

    def brk(self, blank: bool = False) -> None:
        if self.lines[-1].strip():
            self.lines[-1] = self.lines[-1].rstrip()
            self.lines.append("")
        self.blank |= blank

    def newline(self) -> None:
        self.lines[-1] = self.lines[-1].rstrip()
        self.lines.append("")

    def text(self, s: str) -> None:
        if not self.lines[-1]:
            s = s.lstrip(" ")
            if not s:
                return
            if self.blank and len(self.lines) > 1 and self.lines[-2]:
                self.lines.insert(-1, "")
            self.blank = False
            self.lines[-1] = self.indent + self.mark
            self.mark = ""
        elif self.lines[-1].endswith(" "):
            s = s.lstrip(" ")
        self.lines[-1] += s

    def verbatim(self, s: str) -> None:
        for i, part in enumerate(s.split("\n")):
            if i:
                self.lines.append("")
            if part:
                if not self.lines[-1]:
                    self.text(part[:0] or "​")
                    self.lines[-1] = self.lines[-1].removesuffix("​")
                self.lines[-1] += part

    def done(self) -> str:
        return "\n".join(x.rstrip() for x in self.lines).strip("\n")


def _inline(node: Node, depth: int) -> str:
    out = _Out(depth)
    for c in node.children:
        _render(c, out, False)
    return " ".join(out.done().split())


def _rows(table: Node):
    """The rows of a table, those of inner tables left to their cells."""
    todo = list(reversed(table.children))
    while todo:
        n = todo.pop()
        if isinstance(n, Node) and n.visible():
            if n.tag == "tr":
                yield n
            elif n.tag in ("thead", "tbody", "tfoot"):
                todo.extend(reversed(n.children))


def _span(cell: Node) -> int:
    got = (cell.attrs.get("colspan") or "1").strip()
    return max(1, min(int(got), 100)) if got.isascii() and got.isdigit() else 1


def _table(node: Node, out: _Out) -> None:
    out.depth += 1
    for c in node.children:
        if isinstance(c, Node) and c.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup", "col") or isinstance(c, str) and c.strip():
            _render(c, out, False)
            out.brk()
    grid = []
    for tr in _rows(node):
        row: list[str] = []
        for cell in tr.children:
            if isinstance(cell, Node) and cell.tag in ("td", "th"):
                if cell.visible():
                    row += [_inline(cell, out.depth)] + [""] * (_span(cell) - 1)
            elif isinstance(cell, Node) or cell.strip():
                row.append(_inline(cell, out.depth) if isinstance(cell, Node) else " ".join(cell.split()))
        if any(row):
            grid.append(row)
    width: list[int] = []
    for row in grid:
        for i, c in enumerate(row):
            if i == len(width):
                width.append(0)
            width[i] = max(width[i], len(c))
    for row in grid:
        out.brk()
        out.text("​")
        out.lines[-1] = out.lines[-1].removesuffix("​") + " | ".join(c.ljust(w) for c, w in zip(row, width, strict=False))
        out.newline()
    out.depth -= 1


def _render(root, out: _Out, pre: bool) -> None:
    """Depth first over a stack of its own, so that deep pages do not exhaust Python's."""
    todo: list = [(root, pre)]
    while todo:
        node, pre = todo.pop()
        if callable(node):
            node()
            continue
        if isinstance(node, str):
            out.verbatim(node) if pre else out.text(_SPACE.sub(" ", node))
            continue
        if not node.visible():
            continue
        tag = node.tag
        if tag == "br":
            out.newline()
            continue
        if tag == "img" or tag == "input":
            shown = node.attrs.get("alt" if tag == "img" else "value")
            if shown:
                out.text(_SPACE.sub(" ", shown))
            continue
        if node.foreign:
            line = tag in FOREIGN_BLOCK
            if line:
                out.brk()
                todo.append((out.brk, pre))
            for c in reversed(node.children):
                todo.append((c, pre))
                if tag in APART and isinstance(c, Node):
                    todo.append((" ", False))
            continue
        if tag not in BLOCK:
            todo.extend((c, pre) for c in reversed(node.children))
            continue
        spaced = tag in SPACED and not (tag in ("ul", "ol") and out.indent)
        out.brk(spaced)
        if tag == "table" and out.depth < ALIGNED:
            _table(node, out)
            out.brk(True)
            continue
        before = out.indent
        if tag in ("ul", "ol"):
            start = node.attrs.get("start") or "1"
            count = int(start) if start.isascii() and start.isdigit() else 1
            for c in node.children:
                if isinstance(c, Node) and c.tag == "li":
                    c.attrs["#mark"] = f"{count}. " if tag == "ol" else "- "
                    count += 1
        if tag == "li":
            out.mark = node.attrs.get("#mark", "- ")
        elif tag in ("dd", "blockquote"):
            out.indent += "  "

        def leave(before=before, spaced=spaced):
            out.brk(spaced)
            out.indent, out.mark = before, ""

        def deeper(before=before):
            out.indent = before + "  "

        todo.append((leave, pre))
        inner = pre or tag == "pre"
        for c in reversed(node.children):
            todo.append((c, inner))
            if tag == "li" and isinstance(c, Node) and c.tag in ("ul", "ol"):
                todo.append((deeper, inner))


def extract_text(html: str | None) -> str:
    builder = TreeBuilder()
    builder.feed((html or "").replace("\x00", ""))
    out = _Out()
    _render(builder.root, out, False)
    return out.done()


def html_extract(pages: DataFrame) -> DataFrame:
    """page_id, text and n_chars for every row of pages (page_id, html)."""

    def run(batches):
        for b in batches:
            text = [extract_text(h) for h in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, text string, n_chars long")


# --- the registered query -------------------------------------------------


def op5_html_extract(spark, sf_dir: str) -> DataFrame:
    return html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_html_extract": op5_html_extract}
ORACLES: dict[str, str] = {}
