"""Operator 8: layout-aware text of web pages.

A page is parsed into a tree (with the tags that HTML lets authors leave out),
and the tree is laid out as plain text: everything a reader would see, blocks
apart from one another, lists with their marks and indents, table cells in
aligned columns, preformatted text as it stands. Parsing and layout keep their
own stacks, so deep nesting is no recursion.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes datalist object audio video canvas annotation annotation-xml".split())
#: Not drawn where they stand inside svg.
_SVG_HIDDEN = frozenset("defs desc metadata symbol clippath mask marker pattern".split())
#: MathML elements whose parts stand above, below or beside one another.
_MATH_PARTS = frozenset("mfrac msub msup msubsup munder mover munderover mmultiscripts mroot mtable mtr".split())
#: Inputs that do not show their value as text.
_NO_VALUE = frozenset("hidden password checkbox radio file image range color".split())
FORMAT = frozenset("a b big code em font i nobr s small span strike strong tt u".split())
#: Blocks set apart by a blank line, and other blocks.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCK = SPACED | frozenset("address article aside body caption center dd details dialog div dt fieldset figcaption footer form "
                           "header hgroup html legend li main menu nav option search section summary tr".split())
#: What a start tag closes, up to the nearest of the tags after it.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
           "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           **{t: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")}}
_NO_P = (BLOCK | {"menu"}) - {"html", "body", "option", "tr", "legend", "caption"}
#: An end tag does not reach beyond these, unless it names them.
_WALLS = frozenset({"table", "td", "th", "caption", "html", "template"})
MAX_DEPTH = 512
MAX_TABLES = 16

_OPEN = re.compile(r"</?[a-zA-Z][^\s/>]*|<[!?/]")
_REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children", "apart")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.apart = False    # a blank goes before and after it


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(source):
        if value[:1] in "\"'" and value:
            value = value[1:-1]
        out.setdefault(name.lower(), html.unescape(value))
    return out


class TreeBuilder:
    """Builds the tree; ``root.children`` holds nodes and text."""

    def __init__(self):
        self.root = Node("#root", {})
        self.stack = [self.root]

    def text(self, s: str) -> None:
        if s:
            self.stack[-1].children.append(s)

    def _close_up_to(self, tags: set[str], walls: set[str]) -> None:
        """Pop the elements above and including the outermost of ``tags`` that
        lies inside the nearest wall."""
        last = None
        for i in range(len(self.stack) - 1, max(0, len(self.stack) - MAX_DEPTH), -1):
            t = self.stack[i].tag
            if t in walls:
                break
            if t in tags:
                last = i
        if last is not None:
            del self.stack[last:]

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.stack[1:3]):
            return
        if tag == "body":  # an open head ends here
            self._close_up_to({"head"}, set())
        if tag in _NO_P:
            self._close_up_to({"p"}, _WALLS | {"button"})
        if tag[0] == "h" and len(tag) == 2 and tag[1] in "123456" and self.stack[-1].tag in _HEADINGS:
            self.stack.pop()
        if tag in _CLOSES:
            self._close_up_to(*_CLOSES[tag])
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Node("tr", {}))
        if tag in _SVG_HIDDEN and self._in_svg():
            attrs = {"hidden": ""}
        node = Node(tag, attrs)
        node.apart = self.stack[-1].tag in _MATH_PARTS or tag == "text" and self._in_svg()
        if tag in VOID or closed and tag not in BLOCK:
            self.stack[-1].children.append(node)
        else:
            self._push(node)

    def _in_svg(self) -> bool:
        return any(n.tag == "svg" for n in self.stack[-MAX_DEPTH:])

    def _push(self, node: Node) -> None:
        """Open an element. Below MAX_DEPTH the tree has it empty, and what it
        holds goes to the last element above the bound, or nowhere if hidden."""
        into = self.stack[-1].children
        into.append(node)
        if len(self.stack) >= MAX_DEPTH:
            shown = visible(node)
            node = Node(node.tag, node.attrs)
            node.children = into if shown else []
        self.stack.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {}, False)
            return
        for i in range(len(self.stack) - 1, max(0, len(self.stack) - MAX_DEPTH), -1):
            t = self.stack[i].tag
            if t == tag:
                if tag in FORMAT and any(n.tag in BLOCK for n in self.stack[i + 1:]):
                    del self.stack[i]  # the blocks opened inside it go on
                else:
                    del self.stack[i:]
                    if i >= MAX_DEPTH and tag in BLOCK:  # what follows is apart
                        self.stack[-1].children.append(Node("div", {}))
                return
            if t in _WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                return


_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))


def parse(source: str) -> Node:
    """The tree of a page."""
    b, at, n = TreeBuilder(), 0, len(source)
    while at < n:
        m = _OPEN.search(source, at)
        if not m:
            b.text(html.unescape(source[at:]))
            break
        b.text(html.unescape(source[at:m.start()]))
        name, at = m[0], m.end()
        if name in ("<!", "<?", "</"):
            if source.startswith("--", at):
                end = source.find("-->", at + 2) if not source.startswith("-->", at) else at
                at = n if end < 0 else end + 3
            elif source.startswith("[CDATA[", at):
                end = source.find("]]>", at)
                b.text(source[at + 7:n if end < 0 else end])
                at = n if end < 0 else end + 3
            else:
                end = source.find(">", at)
                at = n if end < 0 else end + 1
            continue
        rest = _REST.match(source, at)
        stop = rest.end() if rest else source.find(">", at) + 1
        if not stop:  # a tag that never ends is no content
            break
        inner, at = source[at:stop - 1], stop
        tag = name.lstrip("</").lower()
        if name[1] == "/":
            b.end(tag)
            continue
        b.start(tag, _attributes(inner) if inner.strip(" /\n\t") else {}, inner.endswith("/"))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            body = source[at:end.start() if end else n]
            at = n if not end else end.start()
            b.text(html.unescape(body) if tag in ("textarea", "title") else body)
    return b.root


def visible(node: Node) -> bool:
    a = node.attrs
    if node.tag in HIDDEN:
        return False
    if not a:
        return node.tag != "dialog"
    if "hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "dialog" and "open" not in a:
        return False
    if node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    return not ("style" in a and _NONE.search(a["style"]))


class Layout:
    """Collects lines. Runs of white space become one blank, except in
    preformatted text; blocks start on a line of their own."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.gap = 0          # line breaks owed before the next text
        self.blank = False    # a blank is owed before the next text
        self.indent = ""
        self.mark = ""        # list mark of the next line

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s[:1] == " ":
            self.blank, s = True, s[1:]
        if not s:
            return
        tail = s[-1] == " "
        self._open()
        if self.blank and self.line:
            self.line += " "
        self.line += s[:-1] if tail else s
        self.blank = tail

    def _open(self) -> None:
        if self.gap and not self.line:
            if self.lines and self.gap > 1:
                self.lines.append("")
            self.gap = 0

    def raw(self, s: str) -> None:
        """Preformatted text."""
        for i, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if i:
                self.newline()
            if part:
                self._open()
                self.line += part
        self.blank = False

    def newline(self) -> None:
        self._open()
        self._emit()

    def _emit(self) -> None:
        lead = self.indent
        if self.mark:
            lead, self.mark = lead[:len(lead) - len(self.mark)] + self.mark, ""
        self.lines.append((lead + self.line).rstrip(" ") if self.line else "")
        self.line, self.blank = "", False

    def block(self, gap: int) -> None:
        if self.line:
            self._emit()
        self.blank = False
        self.gap = max(self.gap, gap)

    def result(self) -> str:
        self.block(1)
        return "\n".join(self.lines).strip("\n")


def _cells(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """Captions and rows (lists of cells) of a table, without nested ones."""
    captions, rows, todo = [], [], [iter(table.children)]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
        elif isinstance(child, str):
            if child.strip():
                captions.append(_wrap(child))
        elif visible(child):
            if child.tag in ("thead", "tbody", "tfoot"):
                todo.append(iter(child.children))
            elif child.tag == "tr":
                loose = [c if isinstance(c, Node) else _wrap(c) for c in child.children
                         if (isinstance(c, Node) and visible(c)) or (isinstance(c, str) and c.strip())]
                rows.append(loose)
            elif child.tag not in ("colgroup", "col"):
                captions.append(child)
    return captions, rows


def _wrap(s: str) -> Node:
    n = Node("span", {})
    n.children.append(s)
    return n


def _span(cell: Node) -> int:
    v = cell.attrs.get("colspan", "1").strip()
    return min(1000, max(1, int(v))) if v.isdecimal() and len(v) < 9 else 1


def _table(node: Node, out: Layout, tables: int) -> None:
    captions, rows = _cells(node)
    for c in captions:
        out.block(1)
        text = render(c, tables + 1)
        for line in text.split("\n") if text else []:
            out.raw(line)
            out.block(1)
    laid: list[list[tuple[int, int, list[str]]]] = []
    width: dict[int, int] = {}
    for row in rows:
        at, cells = 0, []
        for cell in row:
            lines = render(cell, tables + 1).split("\n")
            span = _span(cell)
            cells.append((at, span, lines))
            if span == 1:
                width[at] = max(width.get(at, 0), max(map(len, lines)))
            at += span
        laid.append(cells)
    columns = max((a + s for cells in laid for a, s, _ in cells), default=0)
    begin, x = [], 0
    for c in range(columns):
        begin.append(x)
        x += width[c] + 2 if width.get(c) else 0
    for cells in laid:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line = ""
            for at, _, lines in cells:
                if k < len(lines) and lines[k]:
                    line = line.ljust(begin[at]) if len(line) <= begin[at] else line + "  "
                    line += lines[k]
            if line:
                out.raw(line)
                out.block(1)


def render(root: Node, tables: int = 0) -> str:
    """Lay a tree out as text."""
    out = Layout()
    # (iterator over children, what to do after them)
    todo: list[tuple[Iterator, Node, str]] = [(iter(root.children), root, "")]
    lists: list[list] = []
    pre = 0
    while todo:
        children, node, indent = todo[-1]
        child = next(children, None)
        if child is None:
            todo.pop()
            tag = node.tag
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            if tag in ("pre", "textarea", "xmp"):
                pre -= 1
            if tag in BLOCK:
                out.block(2 if tag in SPACED and not (lists and tag in ("ul", "ol")) else 1)
            if node.apart:
                out.text(" ")
            if indent is not None and node is not root:
                out.indent = indent
            continue
        if isinstance(child, str):
            if pre:
                out.raw(child)
            else:
                out.text(child)
            continue
        if not visible(child):
            continue
        tag = child.tag
        if tag == "br":
            out.newline()
            continue
        if tag in BLOCK:
            out.block(2 if tag in SPACED and not (lists and tag in ("ul", "ol")) else 1)
        if tag == "table" and tables < MAX_TABLES:
            _table(child, out, tables)
            out.block(2)
            continue
        if tag in ("td", "th") or child.apart:
            out.text(" ")
        if tag in VOID:
            if tag == "input" and child.attrs.get("type", "text").lower() not in _NO_VALUE:
                out.text(child.attrs.get("value", ""))
            continue
        before = out.indent
        if tag in ("ul", "ol", "menu"):
            first = child.attrs.get("start", "1")
            lists.append([tag, int(first) if first.lstrip("-").isdecimal() and len(first) < 9 else 1])
        elif tag == "li":
            mark = "- "
            if lists and lists[-1][0] == "ol":
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            out.mark, out.indent = mark, before + " " * len(mark)
        elif tag in ("blockquote", "dd"):
            out.indent = before + "  "
        elif tag in ("pre", "textarea", "xmp"):
            pre += 1
            if child.children and isinstance(child.children[0], str) and child.children[0].startswith("\n"):
                child.children[0] = child.children[0][1:]
        todo.append((iter(child.children), child, before))
    return out.result()


def page_text(source: str | None) -> str:
    return render(parse(source)) if source else ""


def extract_text(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """Adds ``text string`` to ``pages`` (replacing a column of that name): the
    visible text of each page, laid out. Null and empty pages have empty text;
    text without tags is one block; broken tags are read as browsers do (a tag
    that never ends drops the rest). One row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index("__html")
            for i in range(0, len(b), 256):
                rows = b.slice(i, 256)
                text = pa.array([page_text(x) for x in rows.column(at).to_pylist()], pa.string())
                rest = rows.drop_columns(["__html"])
                yield pa.RecordBatch.from_arrays([*rest.columns, text], names=[*rest.schema.names, "text"])

    src = pages.withColumn("__html", F.col(html)).drop("text")
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__html"]
    return src.mapInArrow(run, ", ".join([*schema, "text string"]))


def op8_html_extraction(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines of every page."""
    t = extract_text(pages.select("page_id", F.col("html").alias("__h")), html="__h")
    return t.select("page_id", "text", F.length("text").cast("long").alias("n_chars"),
                    F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"))
