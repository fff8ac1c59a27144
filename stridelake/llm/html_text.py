"""HTML extraction by layout: all visible text, with blocks, lists and aligned table cells.

A small tree builder reads tags, closes what HTML lets authors leave open (paragraphs, list items, table parts)
and drops what is never seen: comments, scripts, styles, hidden elements, closed dialogs, content for browsers that
cannot show an element. Formulas, text in drawings and what form fields show is seen. A renderer then walks the tree:
blocks stand on lines of their own, with an empty line around paragraphs and headings; list items get
a bullet or number and are indented by depth; table cells are padded to their columns' widths; white space
collapses except in ``pre``; images give their ``alt``.

Null and empty pages give an empty text. Broken markup never fails: unknown tags are inline, stray end tags are
ignored, and what is open at the end is closed there. Each page is one row in one task.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: element classes of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title meta link object iframe canvas audio video datalist "
                   "desc metadata defs annotation annotation-xml".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: Types of input that show no text of their own.
TEXTLESS = frozenset("hidden checkbox radio password file color range".split())
RAW = frozenset(("script", "style", "title", "textarea", "noscript", "iframe"))
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCKS = SPACED | frozenset("html body div section article aside header footer nav main address form fieldset legend li dt dd "
                            "tr caption thead tbody tfoot figcaption details summary center".split())
#: Tables within tables that are aligned.
TABLES = 20
#: An opening tag ends these open elements, up to (not beyond) the elements behind them.
IMPLIED_END = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th", "caption")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))), "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))), "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "select": (frozenset(("select",)), frozenset()),
    **{k: (frozenset(("tr", "td", "th", "thead", "tbody", "tfoot", "caption")), frozenset(("table",))) for k in ("thead", "tbody", "tfoot")},
}

# possessive, and without "<" outside quotes, so that broken markup costs no second reading
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}


class Element:
    __slots__ = ("attrs", "content", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.content = tag, attrs, []

    @property
    def hidden(self) -> bool:
        a = self.attrs
        return (self.tag in UNSEEN or "hidden" in a or bool(_HIDING.search(a.get("style", "")))
                or self.tag == "dialog" and "open" not in a)


class _Open(list):
    """Open elements, and how many there are of each tag, so that a search for none ends at once."""

    def __init__(self, root: Element) -> None:
        super().__init__([root])
        self.count: Counter[str] = Counter()

    def push(self, element: Element) -> None:
        self[-1].content.append(element)
        self.append(element)
        self.count[element.tag] += 1

    def cut(self, k: int) -> None:
        self.count.subtract(e.tag for e in self[k:])
        del self[k:]

    def end(self, tags: frozenset[str], limit: frozenset[str]) -> bool:
        """Close the outermost open element among ``tags``, not looking beyond one of ``limit``."""
        if not any(self.count[t] > 0 for t in tags):
            return False
        found = None
        for k in range(len(self) - 1, 0, -1):
            if self[k].tag in tags:
                found = k
            elif self[k].tag in limit:
                break
        if found:
            self.cut(found)
        return bool(found)

    def end_last(self, tag: str) -> bool:
        """Close the innermost ``tag``; tags other than the page's do not reach out of a table."""
        if self.count[tag] > 0:
            for k in range(len(self) - 1, 0, -1):
                if self[k].tag == tag:
                    self.cut(k)
                    return True
                if self[k].tag == "table" and tag not in ("body", "html"):
                    break
        return False


def build(html: str) -> Element:
    """Tree of the page; implied ends are filled in."""
    root = Element("html", {})
    open_ = _Open(root)
    at = 0
    while at < len(html):
        m = _TOKEN.match(html, at)
        at = m.end()
        end, start, rest = m.groups()
        if start:
            tag = start.lower()
            attrs = {k.lower(): unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(rest)} if rest else {}
            if tag == "html":
                root.attrs |= attrs
                continue
            _imply(open_, tag)
            element = Element(tag, attrs)
            if rest.endswith("/") and (open_.count["svg"] > 0 or open_.count["math"] > 0):
                open_[-1].content.append(element)
            elif tag in RAW:
                stop = _RAW_END[tag].search(html, at)
                if tag == "textarea":
                    element.content.append(unescape(html[at : stop.start() if stop else len(html)]).replace("\r\n", "\n").removeprefix("\n"))
                    open_[-1].content.append(element)
                at = html.find(">", stop.start()) + 1 or len(html) if stop else len(html)
            elif tag in VOID:
                open_[-1].content.append(element)
            else:
                open_.push(element)
        elif end:
            tag = end.lower()
            if not open_.end_last(tag) and tag == "p":
                open_[-1].content.append(Element("p", {}))
        elif m.group()[:2] not in ("<!", "<?"):
            if open_[-1].tag == "head" and m.group().strip():
                open_.cut(len(open_) - 1)
            open_[-1].content.append(unescape(m.group()))
    return root


def _imply(open_: _Open, tag: str) -> None:
    """Close what an opening ``tag`` ends, and open the row that a cell needs."""
    if open_[-1].tag == "head" and tag not in HEAD:
        open_.cut(len(open_) - 1)
    if tag in BLOCKS:
        open_.end(frozenset(("p",)), frozenset(("table", "td", "th", "li")))
    if tag in IMPLIED_END:
        open_.end(*IMPLIED_END[tag])
    if tag in ("td", "th") and open_[-1].tag in ("table", "thead", "tbody", "tfoot"):
        open_.push(Element("tr", {}))


class _Page:
    """Lines made so far; ``gap`` is 0 within a line, 1 after a line, 2 after an empty line."""

    def __init__(self, prefix: str = "") -> None:
        self.lines: list[str] = []
        self.now, self.space, self.blank = "", False, False
        self.prefix, self.next_prefix = prefix, None

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s.startswith(" "):
            self.space = True
        core = s.strip(" ")
        if core:
            if self.space and self.now:
                self.now += " "
            self.now += core
            self.space = s.endswith(" ")

    def line(self, spaced: bool = False, keep: bool = False) -> None:
        if self.now or keep:
            if self.blank and self.lines:
                self.lines.append("")
            lead = self.prefix if self.next_prefix is None else self.next_prefix
            self.lines.append((lead + self.now).rstrip() if not keep else lead + self.now)
            self.next_prefix = None
            self.blank = False
        self.now, self.space = "", False
        self.blank = self.blank or spaced


def _field(item: Element) -> str:
    """What an input or select shows: its value or placeholder, its chosen option or, in a list box, all of them."""
    a = item.attrs
    if item.tag == "input":
        kind = a.get("type", "").lower()
        return "" if kind in TEXTLESS else a.get("alt", "") if kind == "image" else a.get("value") or a.get("placeholder", "")
    box = "multiple" in a or bool(re.fullmatch(r"0*[1-9]\d+|0*[2-9]", a.get("size", "")))
    labels, chosen, first, todo = [], None, None, list(reversed(item.content))
    while todo:
        node = todo.pop()
        if isinstance(node, str) or node.hidden:
            continue
        if node.tag != "option":
            if node.tag == "optgroup":
                labels.append(node.attrs.get("label", ""))
            todo.extend(reversed(node.content))
            continue
        parts, inner = [], list(reversed(node.content))
        while inner:
            part = inner.pop()
            if isinstance(part, str):
                parts.append(part)
            elif not part.hidden:
                inner.extend(reversed(part.content))
        label = node.attrs.get("label") or "".join(parts)
        labels.append(label)
        if "selected" in node.attrs:
            chosen = label
        if first is None and "disabled" not in node.attrs:
            first = label
    return " ".join(labels) if box else chosen if chosen is not None else first or ""


def _walk(node: Element, page: _Page, depth: int, pre: bool, level: int) -> None:
    """Depth-first without recursion; only tables in tables recur, and beyond ``TABLES`` they are plain blocks."""
    stack: list[tuple] = [("in", node, depth, pre)]
    while stack:
        step, item, depth, pre = stack.pop()
        if step == "out":
            page.line(item.tag in SPACED and not (item.tag in ("ul", "ol") and depth))
            if item.tag == "li":
                page.prefix, page.next_prefix = item.attrs[""], None
            continue
        if isinstance(item, str):
            if pre:
                first, *more = item.replace("\r\n", "\n").split("\n")
                page.now += first
                for part in more:
                    page.line(keep=True)
                    page.now = part
            else:
                page.text(item)
            continue
        if item.hidden:
            continue
        tag = item.tag
        if tag == "br":
            page.line(keep=not page.now)
        elif tag == "hr":
            page.line(True)
        elif tag == "img":
            page.text(item.attrs.get("alt", ""))
        elif tag in ("input", "select"):
            page.text(f" {_field(item)} ")
        elif tag == "textarea":
            if any(item.content):
                stack.extend([("in", " ", depth, pre), *(("in", c, depth, True) for c in item.content), ("in", " ", depth, pre)])
            else:
                page.text(f" {item.attrs.get('placeholder', '')} ")
        elif tag == "table" and level < TABLES:
            page.line(True)
            for row in _table(item, level + 1):
                page.now = row
                page.line()
            page.line(True)
        else:
            inner = depth
            if tag in BLOCKS:
                page.line(tag in SPACED and not (tag in ("ul", "ol") and depth))
                stack.append(("out", item, depth, pre))
            if tag in ("ul", "ol", "menu"):
                inner = depth + 1
                n = int(item.attrs.get("start", "1")) if re.fullmatch(r"\d{1,6}", item.attrs.get("start", "1")) else 1
                for child in item.content:
                    if isinstance(child, Element) and child.tag == "li":
                        child.attrs["\0"] = f"{n}. " if tag == "ol" else "- "
                        n += 1
            if tag == "li":
                mark = "  " * max(depth - 1, 0) + item.attrs.get("\0", "- ")
                item.attrs[""] = page.prefix
                page.next_prefix, page.prefix = page.prefix[:0] + mark, " " * len(mark)
            inside = [" ", *item.content, " "] if tag == "text" else item.content  # labels of a drawing stand apart
            stack.extend(("in", c, inner, pre or tag == "pre") for c in reversed(inside))


def _width(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _table(table: Element, level: int) -> list[str]:
    """Rows of the table, cells padded to their columns; a caption comes first, inner tables as one line."""
    head, rows, todo = [], [], list(reversed(table.content))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            if node.strip():
                head.append(_SPACE.sub(" ", node).strip())
        elif node.hidden:
            continue
        elif node.tag == "tr":
            cells: list[str] = []
            for c in node.content:
                if isinstance(c, Element) and c.tag in ("td", "th"):
                    if not c.hidden:
                        cells.append(" ".join(x.strip() for x in render(c, level).split("\n") if x.strip()))
                        wide = c.attrs.get("colspan", "1")
                        cells += [""] * (min(int(wide), 1000) - 1 if re.fullmatch(r"\d{1,4}", wide) and int(wide) else 0)
                elif isinstance(c, Element) or c.strip():
                    cells.append(" ".join(render(c, level).split()) if isinstance(c, Element) else _SPACE.sub(" ", c).strip())
            if any(cells):
                rows.append(cells)
        elif node.tag == "caption":
            head.append(" ".join(render(node, level).split()))
        elif node.tag in ("thead", "tbody", "tfoot"):
            todo.extend(reversed(node.content))
        elif text := " ".join(render(node, level).split()):
            head.append(text)
    widths = [max((_width(r[k]) for r in rows if k < len(r)), default=0) for k in range(max(map(len, rows), default=0))]
    return head + [" | ".join(c + " " * (widths[k] - _width(c)) for k, c in enumerate(r)).rstrip() for r in rows]


def render(node: Element, level: int = 0) -> str:
    page = _Page()
    _walk(node, page, 0, node.tag == "pre", level)
    page.line()
    return "\n".join(page.lines).strip("\n")


def visible_text(html: str) -> str:
    return render(build(html))


@F.pandas_udf(T.StringType())
def _rendered(html: pd.Series) -> pd.Series:
    return html.map(lambda h: visible_text(h or ""))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page; rows without page_id keep their null."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _rendered("html").alias("text"))
