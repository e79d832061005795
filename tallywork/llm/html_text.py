"""HTML to text, laid out: block spacing, lists and aligned table cells; invisible content left out.

The standard library's tokenizer feeds a tree builder that closes elements whose end tags HTML lets
authors leave out; open elements are found by their tag, so that a page takes time in proportion to its
length however deep it nests. The tree is walked without recursion. Not visible are comments, hidden elements
(``hidden``, ``display:none``, hidden inputs), closed dialogs, all but the summary of closed details, what
``visibility:hidden`` covers (but not a ``visibility:visible`` inside it), the head, scripts, styles, templates,
titles, datalists, what stands in for scripts or embedded media (noscript, iframe, object, audio, video,
canvas), and in formulas and drawings annotations, descriptions, metadata and definitions. Blocks stand
on lines of their own, paragraphs and headings after a blank line, list items behind a bullet or number,
table cells in columns of equal width (``colspan`` and ``rowspan`` keep the places they span empty),
preformatted text as it is. Formulas, text areas, all options of a
select and the text elements of drawings run with the text around them.

Defined results: a null page gives null, an empty one an empty text; text outside any element is kept;
stray end tags are ignored; what is still open at the end is closed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

# Fixed values of the language: elements without content, invisible elements, blocks.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INVISIBLE = set("script style template noscript head title iframe object audio video canvas datalist".split())
# What an open head can hold, elements set off by spaces; of drawings and formulas what is not shown, and
# parts of drawings whose own text is not shown.
IN_HEAD = set("head base basefont bgsound link meta noframes noscript script style template title".split())
APART = set("textarea select option text".split())
UNSHOWN = set("desc metadata defs annotation annotation-xml".split())
DRAWN = set("svg g switch".split())
FOREIGN = UNSHOWN | DRAWN | {"math", "text"}
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())
BLOCKS = SPACED | set(
    "html body address article aside main nav section header footer div li dt dd form fieldset figcaption "
    "details summary tr caption thead tbody tfoot center dir menu hgroup search legend".split()
)
# An opening tag closes these open elements ...
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th", "caption"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "thead": {"tr", "td", "th", "caption"}, "tbody": {"tr", "td", "th", "thead", "tbody", "caption"},
    "tfoot": {"tr", "td", "th", "thead", "tbody", "caption"}, "body": {"head"},
}
# ... but looks for them only inside these.
SCOPE = {
    "li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"},
    "optgroup": {"select"}, "body": {"html"},
} | {t: {"table"} for t in ("tr", "td", "th", "thead", "tbody", "tfoot")}
CLOSES_P = SPACED | set("address article aside details div fieldset figcaption footer form header main menu nav section".split())
ROOTS = {"table", "td", "th", "caption"}
SPACE = re.compile(r"[ \t\n\r\f\v]+")
HIDING = re.compile(r"display\s*:\s*none", re.I)
VEILING = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
TO_THE_END = 65_534  # fixed value of the language: the tallest cell


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class Builder(HTMLParser):
    """Tokens to a tree, with the end tags that authors may leave out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}  # positions of the open elements of each tag

    def cut(self, at: int) -> None:
        """Close the open elements from position ``at`` on."""
        while len(self.open) > at:
            self.at[self.open.pop().tag].pop()

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close_to(self, tags: set[str], within: set[str]) -> None:
        """Close the outermost open element of ``tags`` that no element of ``within`` encloses further in."""
        edge = self.last(within)
        found = [held[i] for held in map(self.at.get, tags) if held and (i := bisect_right(held, edge)) < len(held)]
        if found:
            self.cut(min(found))

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self.close_to({"p"}, ROOTS)
        if tag in CLOSES:
            self.close_to(CLOSES[tag], SCOPE[tag])
        if tag not in IN_HEAD and self.open[-1].tag == "head":
            self.cut(len(self.open) - 1)
        node = Node(tag, {k: v or "" for k, v in attrs})
        if tag in UNSHOWN and self.inside("svg", "math"):
            node.attrs["hidden"] = ""
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def inside(self, *tags: str) -> bool:
        return any(self.at.get(t) for t in tags)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing on HTML elements that can have content
        if tag in FOREIGN and self.inside("svg", "math"):
            self.cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        at = self.last([tag])
        if at and (tag in ROOTS or tag in CLOSES or at > self.last(ROOTS)):
            self.cut(at)

    def handle_data(self, data):
        if self.open[-1].tag == "head" and SPACE.sub("", data):
            self.cut(len(self.open) - 1)
        if self.open[-1].tag in DRAWN and self.inside("svg"):
            return
        self.open[-1].children.append(data)


def visible(node: Node) -> bool:
    a = node.attrs
    return not (
        node.tag in INVISIBLE or "hidden" in a or HIDING.search(a.get("style", ""))
        or (node.tag == "input" and a.get("type", "").lower() == "hidden")
        or (node.tag == "dialog" and "open" not in a)
    )


def shown_children(node: Node) -> list:
    """Of closed details only the first summary is shown."""
    if node.tag != "details" or "open" in node.attrs:
        return node.children
    return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]


class Page:
    """Collects lines: inline text runs together, blocks break, spaced blocks leave a blank line."""

    def __init__(self):
        self.lines, self.gap, self.prefix = [], False, ""
        self.parts, self.inked, self.last = [], False, " "  # of the line begun: its pieces, any text in it, its last character

    def put(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.inked, self.last = self.inked or not text.isspace(), text[-1]

    def inline(self, text: str) -> None:
        text = SPACE.sub(" ", text)
        self.put(text.lstrip(" ") if self.last == " " else text)

    def end_line(self) -> None:
        if self.inked:
            if self.gap and self.lines:
                self.lines.append("")
            self.lines.append((self.prefix + "".join(self.parts)).rstrip())
            self.gap, self.prefix = False, " " * len(self.prefix)
        self.parts, self.inked, self.last = [], False, " "

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap |= spaced

    def raw(self, text: str) -> None:
        first, *rest = text.split("\n")
        self.put(first)
        for more in rest:
            if not self.inked and self.lines:
                self.lines.append("")
            self.end_line()
            self.put(more)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def whole(text: str, limit: int) -> int:
    """A span as authors write it; what is no number counts as one."""
    return min(int(text), limit) if re.fullmatch(r"\d{1,5}", text) else 1


def laid_out(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells (text, columns, rows) in their places; the places that a cell spans stay empty."""
    out, taken = [], {}  # column -> rows below in which a taller cell still takes it
    for row in rows:
        line: list[str] = []
        below: dict[int, int] = {}
        for text, wide, tall in row:
            while taken.get(len(line)):
                line.append("")
            for _ in range(wide):
                below[len(line)] = tall - 1
                line.append(text)
                text = ""
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | {c: n for c, n in below.items() if n > 0}
        out.append(line)
    return out


def aligned(rows: list[list[str]]) -> list[str]:
    """Rows of cell texts as lines whose columns have equal width."""
    widths: list[int] = []
    for row in rows:
        for i, cell in enumerate(row):
            wide = max(map(len, cell.split("\n")))
            if i == len(widths):
                widths.append(wide)
            widths[i] = max(widths[i], wide)
    out = []
    for row in rows:
        cells = [c.split("\n") for c in row]
        for k in range(max(map(len, cells), default=0)):
            out.append(" | ".join((c[k] if k < len(c) else "").ljust(widths[i]) for i, c in enumerate(cells)).rstrip())
    return out


def render(root: Node) -> str:
    """The visible text below ``root``. Open pages, list counters and tables are kept on explicit stacks."""
    pages, tables, lists, pre = [Page()], [], [], 0
    veils = [False]  # whether the text met is covered, with the elements that say so further out
    todo: list = [(root, False)]
    while todo:
        item, leaving = todo.pop()
        page = pages[-1]
        if isinstance(item, str):
            if not veils[-1]:
                (page.raw if pre else page.inline)(item)
            continue
        tag = item.tag
        veiling = VEILING.search(item.attrs.get("style", ""))
        if not leaving:
            if not visible(item):
                continue
            if tag == "br":
                if page.inked:
                    page.end_line()
                elif page.lines:
                    page.gap = True
                continue
            veiled = veils[-1] if not veiling else veiling[1].lower() != "visible"
            if tag == "img":
                page.inline("" if veiled else item.attrs.get("alt", ""))
                continue
            if veiling:
                veils.append(veiled)
            if tag in BLOCKS:
                page.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu"):
                start = item.attrs.get("start", "1")
                lists.append(int(start) - 1 if tag == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 0 if tag == "ol" else None)
            elif tag == "li":
                mark = "* "
                if lists and lists[-1] is not None:
                    lists[-1] += 1
                    mark = f"{lists[-1]}. "
                page.prefix = "  " * max(0, len(lists) - 1) + mark
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                pages.append(Page())
            if tag in APART:
                page.inline(" ")
            todo.append((item, True))
            todo.extend((child, False) for child in reversed(shown_children(item)))
            continue
        if veiling:
            veils.pop()
        if tag in APART:
            page.inline(" ")
        elif tag in ("td", "th") and tables:
            cell = pages.pop().text()
            tall = whole(item.attrs.get("rowspan", "1"), TO_THE_END)
            tables[-1][-1].append((cell, max(1, whole(item.attrs.get("colspan", "1"), 100)), tall or TO_THE_END))
        elif tag == "table":
            page.end_line()
            for line in aligned([r for r in laid_out(tables.pop()) if any(r)]):
                page.put(line)
                page.end_line()
            page.gap = True
        elif tag in ("ul", "ol", "menu") and lists:
            page.block(len(lists) == 1)
            lists.pop()
            page.prefix = ""
        elif tag == "li":
            page.end_line()
            page.prefix = ""
        elif tag in BLOCKS:
            page.block(tag in SPACED)
            pre -= tag == "pre"
    return pages[0].text()


def to_text(html: str | None) -> str | None:
    if html is None:
        return None
    builder = Builder()
    builder.feed(html)
    builder.close()
    return render(builder.root)


def _texts(html: pd.Series) -> pd.Series:
    return html.map(to_text, na_action="ignore")


def text_of(html: Column | str) -> Column:
    """Column: the visible text of a page."""
    return F.pandas_udf(_texts, "string")(html)
