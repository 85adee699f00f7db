"""Layout-aware rendering of HTML: a tree builder with implied tags, visibility rules, and a text layout.

The tree builder opens and closes elements as browsers do where tags are left out: a block start closes an open
paragraph, list items, table parts and options close their like, cells open a row, an end tag without a start is
ignored, void elements have no content, and script, style and the like hold raw text.

Not visible: what is in HIDDEN_TAGS; elements with `hidden` or a style of display:none; text under visibility:hidden, but for what a style within makes visible again; closed `details` but for their summary; closed `dialog`; comments.

Layout: white space collapses but in `pre` and `textarea`; blocks begin lines; paragraphs, headings, lists, tables and
quotes stand apart by a blank line; a cell that spans rows or columns holds its place in each; list items get "- " or their number, nested ones two spaces more; a table's cells
are padded to the width of their column and parted by " | ", a cell's own lines joined by a space; `hr` is "---".

Defined cases: null or empty html gives an empty title and text; broken markup is read as text where it isn't a tag, and a
tag that the page's end cuts off is dropped; time and memory follow the page's length, whatever its depth; repeated rows and ids are rendered each; an empty table gives an empty
result; other columns are kept, one named `page` as `page_in`.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import spare

#: A comment or declaration, or the start of a tag; what the page's end cuts off reaches to it.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: One attribute of a tag, or a slash; a quote counts as one after "=" alone, so each character is read once.
ATTRIBUTE = re.compile(r"[\s/]*(?:(=?[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?)")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: Characters of a cell that widen its column; a padded table's size over its cells'; levels of indentation; of tables that are laid out.
WIDEST, SLACK, DEEPEST, NESTED = 80, 8, 20, 8
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN_TAGS = frozenset("head script style title template noscript noframes noembed iframe object audio video canvas datalist col colgroup map desc defs metadata symbol clippath annotation annotation-xml".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr form fieldset article section".split())
BLOCK = APART | frozenset("address aside body center dd details dialog dir div dt figcaption footer header hgroup html legend li main menu nav option optgroup search select summary tr caption thead tbody tfoot".split())
#: A start tag closes open elements of these names, up to the nearest of the second group.
CLOSES = (
    {x: (frozenset(["p"]), frozenset("table td th button caption".split())) for x in BLOCK - frozenset("html body option optgroup tr caption thead tbody tfoot select".split())}
    | {"li": (frozenset(["li", "p"]), frozenset("ul ol menu dir table".split()))}
    | {x: (frozenset(["dt", "dd", "p"]), frozenset(["dl", "table"])) for x in ("dt", "dd")}
    | {"option": (frozenset(["option"]), frozenset(["select", "datalist"])), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"]))}
    | {"tr": (frozenset("tr td th p caption".split()), frozenset(["table"])), "caption": (frozenset(["caption"]), frozenset(["table"]))}
    | {x: (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])) for x in ("td", "th")}
    | {x: (frozenset("thead tbody tfoot tr td th p caption".split()), frozenset(["table"])) for x in ("thead", "tbody", "tfoot")}
)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(source: str, at: int) -> tuple[dict[str, str], int, bool]:
    """The attributes of a tag whose name ends at `at`, the place after it, and whether it ends with a slash; the place
    is -1 where the page ends within the tag."""
    found: dict[str, str] = {}
    while at < len(source):
        if source[at] == ">":
            return found, at + 1, source[at - 1] == "/"
        m = ATTRIBUTE.match(source, at)
        if m.end() == at:
            at += 1
            continue
        at = m.end()
        if m[1]:
            found.setdefault(m[1].lower(), entities.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return found, -1, False


class Open:
    """The stack of open elements, with the places of each name."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        for node in self.stack[at:]:
            self.places[node.tag].pop()
        del self.stack[at:]

    def last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places.get(tag) else 0

    def close(self, names: frozenset, until: frozenset) -> None:
        """Closes the elements of these names above the last of the others, and all within them."""
        floor = max((self.last(x) for x in until), default=0)
        found = [own[i] for x in names if (own := self.places.get(x)) and (i := bisect_right(own, floor)) < len(own)]
        if found:
            self.cut(min(found))


def parse(source: str) -> Node:
    root = Node("#root", {})
    open_, at = Open(root), 0
    stack = open_.stack

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(entities.unescape(s))

    while m := TOKEN.search(source, at):
        text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        attrs, at, slash = attributes(source, at)
        if at < 0:
            return root
        if m[1]:
            place = open_.last(tag)
            if place and (tag in ("table", "html", "body") or place > open_.last("table")):
                open_.cut(place)
            continue
        if tag in CLOSES:
            open_.close(*CLOSES[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            stack[-1].children.append(row := Node("tr", {}))
            open_.push(row)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in VOID or slash and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            body, at = source[at : end.start() if end else len(source)], end.end() if end else len(source)
            node.children.append(entities.unescape(body) if tag in ("textarea", "title") else body)
            continue
        open_.push(node)
    text(source[at:])
    return root


def hidden(node: Node) -> bool:
    a = node.attrs
    return node.tag in HIDDEN_TAGS or bool(a) and ("hidden" in a or bool(NO_DISPLAY.search(a.get("style", "")))) or node.tag == "dialog" and "open" not in a or node.tag == "input" and a.get("type", "").lower() == "hidden"


class Page:
    """Lines under way: what is said goes to the current line; gaps are kept until something follows."""

    def __init__(self) -> None:
        self.lines, self.line, self.space, self.gap, self.mark, self.indent = [], [], False, 0, "", 0

    def say(self, text: str, as_is: bool = False) -> None:
        if as_is:
            for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
                if i:
                    self.end(blank_too=True)
                if part:
                    self.put(part)
            return
        words = text.split()
        if text[:1].isspace():
            self.space = True
        if words:
            self.put((" " if self.space and self.line else "") + " ".join(words))
            self.space = text[-1:].isspace()

    def put(self, text: str) -> None:
        if not self.line:
            if self.lines and self.gap:
                self.lines.append("")
            self.gap = 0
            self.line.append("  " * min(DEEPEST, self.indent - bool(self.mark)) + self.mark)
            self.mark = ""
        self.line.append(text)

    def end(self, apart: bool = False, blank_too: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        elif blank_too and self.lines:
            self.lines.append("")
        self.space = False
        self.gap = max(self.gap, int(apart))

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines)


def aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Cells (text, columns and rows spanned) as lines, padded to their columns' widths. A cell that spans rows keeps its
    columns empty in the rows below. A cell of over WIDEST characters widens no column; no span reaches beyond the
    columns of the row with the most cells; and a table whose padding would be over SLACK times its cells isn't padded."""
    most = max((len(row) for row in rows), default=0)
    grid: list[list[tuple[str, int, int]]] = []  # text, column, columns
    taken: dict[int, int] = {}  # the last row in which a column is held by a cell above
    widths = [0] * (2 * most + 1)
    for r, row in enumerate(rows):
        at, placed = 0, []
        for cell, span, deep in row:
            start = at
            while taken.get(at, -1) >= r:
                at += 1
            if at > start:
                placed.append(("", start, at - start))
            span = max(1, min(span, most - at))
            placed.append((cell, at, span))
            if deep > 1:
                taken |= dict.fromkeys(range(at, at + span), r + deep - 1)
            widths += [0] * (at + span + 1 - len(widths))
            if span == 1 and len(cell) <= WIDEST:
                widths[at] = max(widths[at], len(cell))
            at += span
        grid.append(placed)
    upto = [0, *accumulate(w + 3 for w in widths)]
    padded = sum(max(len(cell), upto[c + span] - upto[c]) for placed in grid for cell, c, span in placed)
    pad = padded <= SLACK * sum(len(cell) + 16 for row in rows for cell, _, _ in row)
    out = []
    for placed in grid:
        cells = [cell.ljust(upto[c + span] - upto[c] - 3) if pad else cell for cell, c, span in placed]
        if line := " | ".join(cells).rstrip(" |"):
            out.append(line if cells[0].strip() or len(cells) == 1 else " | ".join(cells).rstrip())
    return out


def spanned(node: Node, name: str) -> int:
    given = node.attrs.get(name, "")
    return min(1000, max(1, int(given))) if re.fullmatch(r"\d{1,4}", given) else 1


def render(root: Node) -> str:
    """The visible text. Tables within NESTED others are blocks like any; visibility is inherited until a style changes it."""
    pages, tables, lists, pre, flat = [Page()], [], [], 0, 0
    todo: list[tuple] = [("in", root, True)]
    while todo:
        what, node, shown = todo.pop()
        page = pages[-1]
        if isinstance(node, str):
            if shown:
                page.say(node, as_is=pre > 0)
            continue
        tag = node.tag
        if what == "flat":
            flat -= 1
            page.end(True)
            continue
        if what == "in":
            if hidden(node):
                continue
            children = node.children
            if "style" in node.attrs and (style := VISIBILITY.findall(node.attrs["style"])):
                shown = style[-1].lower() == "visible"
            if tag == "table" and len(tables) >= NESTED:
                flat += 1
                page.end(True)
                todo.append(("flat", node, shown))
                todo += [("in", c, shown) for c in reversed(children)]
                continue
            if tag == "br":
                page.end(blank_too=True)
                continue
            if tag == "hr" and shown:
                page.end(True)
                page.put("---")
                page.end(True)
                continue
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if not isinstance(c, str) and c.tag == "summary"]
            if tag == "table":
                page.end(True)
                tables.append([])
            elif tag == "tr" and tables and not flat:
                tables[-1].append([])
            elif tag in ("td", "th") and tables and not flat:
                if not tables[-1]:
                    tables[-1].append([])
                pages.append(Page())
            elif tag == "caption" and tables:
                page.end()
            elif tag in BLOCK:
                page.end(tag in APART and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start", "")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                page.indent += 1
            elif tag == "li":
                kind = lists[-1] if lists else [False, 1]
                page.mark = f"{kind[1]}. " if kind[0] else "- "
                kind[1] += 1
            elif tag in ("pre", "textarea"):
                pre += 1
            elif tag == "blockquote":
                page.indent += 1
            todo.append(("out", node, shown))
            todo += [("in", c, shown) for c in reversed(children)]
            continue
        if tag in ("td", "th") and tables and not flat:
            cell = " ".join(x.strip() for x in pages.pop().text().split("\n") if x.strip())
            tables[-1][-1].append((cell, spanned(node, "colspan"), spanned(node, "rowspan")))
            continue
        if tag == "table":
            page.end()
            for line in aligned(tables.pop()):
                page.put(line)
                page.end()
            page.end(True)
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
            page.indent -= 1
            page.mark = ""
        elif tag in ("pre", "textarea"):
            pre -= 1
        elif tag == "blockquote":
            page.end()
            page.indent -= 1
        if tag in BLOCK and tag != "tr":
            page.end(tag in APART and not (tag in ("ul", "ol") and lists))
            if tag == "li":
                page.mark = ""
    return pages[0].text()


def title(root: Node) -> str:
    todo = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            continue
        if node.tag == "title":
            return " ".join("".join(c for c in node.children if isinstance(c, str)).split())
        todo += reversed(node.children)
    return ""


PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with struct column `page`: title and visible text."""

    @F.arrow_udf(PAGE)
    def run(source: pa.Array) -> pa.Array:
        titles, bodies = [], []
        for x in source.to_pylist():
            tree = parse(x or "")
            titles.append(title(tree))
            bodies.append(render(tree))
        return pa.StructArray.from_arrays([pa.array(titles, pa.string()), pa.array(bodies, pa.string())], names=["title", "text"])

    return spare(pages, "page").withColumn("page", run(F.col(html).cast("string")))
