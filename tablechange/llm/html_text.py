"""Layout-aware text of HTML pages.

A tokenizer and a tree builder with implied tags give a tree; what a reader would not see is left
out; the rest is rendered with block spacing, list marks and aligned table cells. What is visible is
emitted, navigation, footers, formulas, labels of drawings and text areas included. Of a list to choose
from (``select``) the option marked as selected is shown, and all options where the list stands open.

A page is one row of work; nothing is shuffled. Memory is bounded by the longest page.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe object audio video canvas datalist noembed noframes input img".split())
# Unseen within svg, or within math.
UNSEEN_IN = {**dict.fromkeys("desc defs metadata symbol clippath mask marker pattern".split(), "svg"), **dict.fromkeys("annotation annotation-xml mphantom".split(), "math")}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption h1 h2 h3 h4 h5 h6".split()
)
SPACED = frozenset("blockquote dl figure ol p pre table ul h1 h2 h3 h4 h5 h6 hr".split())
# An opening tag of the first kind closes an open element of the second, up to the third.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
_SCOPE = frozenset("table td th caption button object html body".split())

_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<odd>[!?][^>]*(?:>|\Z))|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|(?P<bad>/?[A-Za-z][^>]*)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.I)
_ROWS = frozenset("tr thead tbody tfoot".split())
_BARRIER, _IS_BARRIER = "/barrier", (_SCOPE | BLOCK) - {"p"}
# Fixed values of HTML: the widest spans.
_SPANS = {"colspan": 1000, "rowspan": 65534}
_LABEL = "/label"  # marks text elements of an svg; no attribute of a page has a slash
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attrs", "items", "around")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.items = name, attrs or {}, []
        # "svg" or "math" where what is inside follows its rules, None in ordinary text
        self.around: str | None = None


class _Open:
    """The open elements, the root first, and where those of each name stand, so that no tag walks the whole stack."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        for name in (node.name, _BARRIER) if node.name in _IS_BARRIER else (node.name,):
            self.places.setdefault(name, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            name = self.nodes.pop().name
            self.places[name].pop()
            if name in _IS_BARRIER:
                self.places[_BARRIER].pop()

    def last(self, *names: str) -> int:
        """Where the innermost open element of these names stands; 0 if there is none."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=0)

    def first_above(self, place: int, names: set[str]) -> int:
        """Where the outermost element of these names within ``place`` stands; 0 if there is none."""
        found = (self.places.get(x, []) for x in names)
        return min((at[i] for at in found if (i := bisect_right(at, place)) < len(at)), default=0)


def build_tree(html: str) -> Node:
    """The tree of a page. Wrong nesting is mended: implied ends are put in, ends without an opening
    tag are ignored, what is open at the end of the page is closed."""
    root = Node("html")
    stack, at, n = _Open(root), 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            _text(stack, unescape(html[at:]))
            break
        if m.start() > at:
            _text(stack, unescape(html[at : m.start()]))
        at = m.end()
        name = m["name"]
        if name is None:
            if not m["bad"]:
                continue
            # a tag with a stray quote ends at the first bracket
            part = re.match(r"(/?)([A-Za-z][^\s/>\"']*)", m["bad"])
            end, name, attrs = part[1], part[2], ""
        else:
            end, attrs = m["end"], m["attrs"]
        name = name.lower()
        if end:
            _close(stack, name)
            continue
        _imply(stack, name)
        found = {a.lower(): unescape(x or y or z or "") for a, x, y, z in _ATTR.findall(attrs)} if attrs and attrs != "/" else {}
        if name == "html":
            continue
        around = stack.top.around
        if name in UNSEEN_IN and UNSEEN_IN[name] == around:
            found["hidden"] = ""
        elif name == "text" and around == "svg":
            found[_LABEL] = ""
        node = Node(name, found)
        if name in ("svg", "math"):
            node.around = name
        elif name != "foreignobject" and _LABEL not in found:
            node.around = around
        stack.top.items.append(node)
        # a form between the parts of a table holds nothing
        if name in VOID or name == "form" and (stack.top.name == "table" or stack.top.name in _ROWS):
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            raw = html[at : stop.start() if stop else n]
            node.items.append(unescape(raw) if name == "textarea" else raw)
            at = stop.end() if stop else n
            continue
        stack.push(node)
    return root


def _text(stack: _Open, text: str) -> None:
    """Put text in; in an open head it ends the head, if it is not white space."""
    if stack.top.name == "head" and text.strip(" \t\n\r\f"):
        stack.cut(len(stack.nodes) - 1)
    if stack.top.around != "svg":
        stack.top.items.append(text)


# Ends that reach beyond the cell or table they stand in.
_FAR = frozenset("table tr td th thead tbody tfoot body html div article section main".split())


def _close(stack: _Open, name: str) -> None:
    at = stack.last(name)
    if at and (name in _FAR or at > stack.last("table", "td", "th")):
        stack.cut(at)


def _imply(stack: _Open, name: str) -> None:
    if name in _ENDS_P:
        at = stack.last("p")
        if at > stack.last(_BARRIER):
            stack.cut(at)
    if name in CLOSES:
        closed, until = CLOSES[name]
        lowest = stack.first_above(stack.last(*until), closed)
        if lowest:
            stack.cut(lowest)
    if stack.top.name == "head" and name not in ("title", "meta", "link", "style", "script", "base", "noscript", "template"):
        stack.cut(len(stack.nodes) - 1)


def _styles(node: Node) -> dict[str, str]:
    """The ``display`` and ``visibility`` of a node's own style: the last of each, important ones before others."""
    found: dict[str, tuple[bool, str]] = {}
    for what, value, important in _STYLE.findall(node.attrs.get("style", "")):
        if important or not found.get(what.lower(), (False, ""))[0]:
            found[what.lower()] = bool(important), value.lower()
    return {what: value for what, (_, value) in found.items()}


def visible(node: Node) -> bool:
    """Whether a node takes part in the layout; what only ``visibility`` hides keeps its place."""
    if node.name in UNSEEN or "hidden" in node.attrs:
        return False
    styles = _styles(node) if "style" in node.attrs else {}
    return styles.get("display") != "none" and not (styles.get("visibility") == "collapse" and node.name in _ROWS)


def _hide(root: Node) -> None:
    """Take out text that inherits a hidden ``visibility``; what is inside may be made visible again."""
    todo = [(root, True)]
    while todo:
        node, shown = todo.pop()
        own = _styles(node).get("visibility") if "style" in node.attrs else None
        shown = own in ("visible", "initial") if own in ("visible", "initial", "hidden", "collapse") else shown
        if not shown:
            node.items = [x for x in node.items if isinstance(x, Node)]
        todo.extend((x, shown) for x in node.items if isinstance(x, Node))


class _Page:
    """Lines under way. ``gap`` is how many line ends the next text needs before it."""

    def __init__(self):
        self.out: list[str] = []
        self.gap, self.space, self.indent, self.mark = 0, False, [], None

    def block(self, lines: int) -> None:
        self.gap, self.space = max(self.gap, lines), False

    def text(self, text: str) -> None:
        parts = _SPACE.sub(" ", text)
        if parts.startswith(" "):
            self.space = True
        core = parts.strip(" ")
        if not core:
            return
        self._start()
        if self.space:
            self.out.append(" ")
        self.out.append(core)
        self.space = parts.endswith(" ")

    def _start(self) -> None:
        if self.out and not self.gap:
            return
        if self.out:
            self.out.append("\n" * self.gap)
        self.gap, self.space = 0, False
        pad = "".join(self.indent)
        if self.mark is not None:
            pad = pad[: -len(self.mark)] + self.mark if pad.endswith(" " * len(self.mark)) else pad + self.mark
            self.mark = None
        self.out.append(pad)

    def exactly(self, lines: list[str]) -> None:
        """Lines as they are."""
        self.block(1)
        for line in lines:
            self._start()
            self.out.append(line)
            self.gap = 1

    def line_end(self) -> None:
        if self.out or self.mark is not None:
            self.gap, self.space = self.gap + 1 if self.gap < 2 else 2, False

    def result(self) -> str:
        return "\n".join(line.rstrip() for line in "".join(self.out).split("\n"))


def render(root: Node) -> str:
    """The visible text below a node. Tables are laid out from the innermost outwards, and what holds them is walked
    with a stack of its own, so depth is no limit."""
    _hide(root)
    tables, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.name == "table":
            tables.append(node)
        todo.extend(x for x in node.items if isinstance(x, Node) and visible(x))
    done: dict[int, list[str]] = {}
    for table in reversed(tables):
        done[id(table)] = _table(table, done)
    return _flow(root, done)


def _flow(root: Node, done: dict[int, list[str]]) -> str:
    """The text below a node, whose tables are ``done``."""
    page = _Page()
    todo: list[tuple] = [("node", root, None)]
    while todo:
        kind, item, more = todo.pop()
        if kind == "close":
            if more:
                page.indent.pop()
                page.mark = None
            page.block(item)
        elif isinstance(item, str):
            page.text(item)
        elif visible(item):
            name = item.name
            if name == "br":
                page.line_end()
            elif name == "hr":
                page.block(2)
            elif name == "pre":
                page.block(2)
                page.exactly(_plain(item).strip("\n").split("\n"))
                page.block(2)
            elif name == "textarea":
                text = _plain(item).removeprefix("\n").rstrip()
                if text:
                    page.exactly(text.split("\n"))
                    page.block(1)
            elif name == "table":
                page.block(2)
                page.exactly(done.pop(id(item)))
                page.block(2)
            elif name == "select":
                open_list, options = _options(item)
                for option in options:
                    if open_list:
                        page.block(1)
                    page.text(f" {option} ")
                if open_list and options:
                    page.block(1)
            else:
                lines = 2 if name in SPACED else 1 if name in BLOCK or _LABEL in item.attrs else 0
                if name in ("ul", "ol", "dl") and page.indent:
                    lines = 1  # a list in a list
                if lines:
                    page.block(lines)
                inside = False
                if name == "li":
                    page.mark = f"{more}. " if more else "- "
                    page.indent.append(" " * len(page.mark))
                    inside = True
                elif name in ("dd", "blockquote"):
                    page.indent.append("  ")
                    inside = True
                if lines:
                    todo.append(("close", lines, inside))
                number = _first_number(item) if name == "ol" else None
                children = []
                for child in item.items:
                    if number is not None and isinstance(child, Node) and child.name == "li":
                        children.append(("node", child, number))
                        number += 1
                    else:
                        children.append(("node", child, None))
                todo.extend(reversed(children))
    return page.result()


def _first_number(node: Node) -> int:
    start = node.attrs.get("start", "")
    return int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1


def _plain(node: Node) -> str:
    """The visible text of a node, white space as it is."""
    out, todo = [], [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        elif visible(item):
            if item.name == "br":
                out.append("\n")
            if item.name == "select":
                out.append(" ".join(_options(item)[1]))
            else:
                todo.extend(reversed(item.items))
    return "".join(out)


def _options(node: Node) -> tuple[bool, list[str]]:
    """Whether a list to choose from stands open, and the options it shows: all of an open one, else the last one
    that is marked as selected."""
    size = node.attrs.get("size", "")
    open_list = "multiple" in node.attrs or bool(re.fullmatch(r"[0-9]{1,9}", size)) and int(size) > 1
    shown, chosen, todo = [], [], [*reversed(node.items)]
    while todo:
        item = todo.pop()
        if isinstance(item, str) or not visible(item):
            continue
        if item.name == "option":
            text = _SPACE.sub(" ", _plain(item)).strip()
            if text:
                shown.append(text)
            if "selected" in item.attrs:
                chosen = [text] if text else []
        else:
            todo.extend(reversed(item.items))
    return open_list, shown if open_list else chosen


def _span(cell: Node, what: str) -> int:
    given = cell.attrs.get(what, "").strip()
    n = int(given) if re.fullmatch(r"[0-9]{1,9}", given) else 1
    if n == 0:  # to the end of the table, for rows
        return _SPANS[what] if what == "rowspan" else 1
    return min(n, _SPANS[what])


def _table(node: Node, done: dict[int, list[str]]) -> list[str]:
    """The rows of a table with aligned cells, two spaces between. A cell of several lines takes
    several lines, a cell over several columns or rows their room; a table within a cell is put there."""
    Cell = tuple[list[str], int, int]
    captions, rows, loose, todo = [], [], [], [*reversed(node.items)]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            if item.strip():
                loose.append(_SPACE.sub(" ", item).strip())
        elif not visible(item):
            continue
        elif item.name in ("thead", "tbody", "tfoot"):
            todo.extend(reversed(item.items))
        elif item.name == "tr":
            row: list[Cell] = []
            for cell in item.items:
                if isinstance(cell, str):
                    if cell.strip():
                        row.append(([_SPACE.sub(" ", cell).strip()], 1, 1))
                elif visible(cell):
                    row.append(_cell(cell, done) if cell.name in ("td", "th") else (_lines([cell], done), 1, 1))
            rows.append(row)
        elif item.name == "caption":
            captions += _cell(item, done)[0]
        elif item.name in ("td", "th"):
            if not rows:
                rows.append([])
            rows[-1].append(_cell(item, done))
        else:
            loose += _lines([item], done)
    return [x for x in [*captions, *loose] if x] + _grid(rows)


def _grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """The lines of rows of cells ``(lines, columns, rows)``. Columns in which no cell starts take no room."""
    placed, held = [], []  # held: (first column, column behind, row behind) of cells that reach into later rows
    for y, row in enumerate(rows):
        held = [h for h in held if h[2] > y]
        x, at, new = 0, 0, []
        for lines, width, height in row:
            while at < len(held) and held[at][0] <= x:
                x, at = max(x, held[at][1]), at + 1
            placed.append((x, y, x + width, min(y + height, len(rows)), lines))
            if height > 1:
                new.append((x, x + width, y + height))
            x += width
        held = sorted(held + new) if new else held
    starts = sorted({p[0] for p in placed})
    number = {x: i for i, x in enumerate(starts)}
    widths, heights = [0] * len(starts), [0] * len(rows)
    spanning = []
    for x, y, x_end, y_end, lines in placed:
        first, behind = number[x], bisect_right(starts, x_end - 1)
        spanning.append((first, behind, y, y_end, lines))
        if behind - first == 1:
            widths[first] = max(widths[first], max(map(len, lines)))
        heights[y] = max(heights[y], len(lines) if y_end - y == 1 else 1)
    # wider and higher cells extend the last column or row they reach, the shortest spans first
    for first, behind, _, _, lines in sorted((c for c in spanning if c[1] - c[0] > 1), key=lambda c: (c[1] - c[0], c[1])):
        widths[behind - 1] += max(0, max(map(len, lines)) - sum(widths[first:behind]) - 2 * (behind - first - 1))
    for _, _, y, y_end, lines in sorted((c for c in spanning if c[3] - c[2] > 1), key=lambda c: (c[3] - c[2], c[3])):
        heights[y_end - 1] += max(0, len(lines) - sum(heights[y:y_end]))
    left, top = [0], [0]
    for w in widths:
        left.append(left[-1] + w + 2)
    for h in heights:
        top.append(top[-1] + h)
    out: list[list[tuple[int, str]]] = [[] for _ in range(top[-1])]
    for first, _, y, _, lines in spanning:
        for k, line in enumerate(lines):
            if line:
                out[top[y] + k].append((left[first], line))
    return [_painted(parts) for parts in out]


def _painted(parts: list[tuple[int, str]]) -> str:
    line, at = [], 0
    for x, text in sorted(parts):
        # cells of a broken table may overlap; none is lost
        line.append(" " * max(x - at, 2 if at and x < at else 0) + text)
        at = max(x, at + 2 if at and x < at else x) + len(text)
    return "".join(line).rstrip()


def _lines(items: list, done: dict[int, list[str]]) -> list[str]:
    inner = Node("div")
    inner.items = items
    return _flow(inner, done).split("\n")


def _cell(node: Node, done: dict[int, list[str]]) -> tuple[list[str], int, int]:
    return _lines(node.items, done), _span(node, "colspan"), _span(node, "rowspan")


def html_to_text(html: str | None) -> str:
    """The visible text of one page; empty for null."""
    return render(build_tree(html)) if html else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, text)`` per row of ``pages``: the whole visible text.

    Null and empty pages give the empty text; text without any tag stays, with white space folded.
    Repeated rows and null ids are kept; an empty table gives no rows; other columns are ignored.
    """
    rows = pages.select(F.col(id_col), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("__html"))
    schema = T.StructType([rows.schema[0], T.StructField("text", T.StringType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([html_to_text(h.as_py()) for h in b.column(1)], pa.string())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)
