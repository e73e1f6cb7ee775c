"""Visible text of HTML pages with their layout.

Tags open and close elements on a stack, with the end tags that HTML implies; what is
invisible (head matter, scripts, templates, hidden elements) is passed over. Text is laid
out as it would be read: blocks start lines, paragraphs and headings are set apart by an
empty line, list items carry marks and indents, preformatted text keeps its spaces, and
the cells of a table stand in aligned columns, also where they span columns or rows or have
several lines. A page's own style rules of single tags, classes and ids can hide elements;
invisible elements may hold visible ones.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
HIDDEN = frozenset("head script style template noscript iframe object svg math audio video canvas datalist noembed noframes title".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
BLOCK = APART | frozenset("html body div article section nav header footer main aside address form fieldset li dt dd tr caption figcaption details summary center dialog".split())
#: A start tag closes these open elements, up to the boundary elements.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: An end tag does not close elements beyond these.
WALL = frozenset(("td", "th", "table", "caption"))
TABLE_PARTS = frozenset(("table", "tr", "tbody", "thead", "tfoot"))
#: Levels that are indented, and characters to which cells are aligned: deeper lists and
#: longer cells keep all their text, but do not widen every line.
MAX_INDENT, MAX_ALIGN = 40, 200

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)", re.S)
_STOP = re.compile(r"[\"'>]")
_ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_GONE = re.compile(r"display\s*:\s*none", re.I)
_SEEN = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_BRACE = re.compile(r"[{};]")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)(\}?)")
_SELECTOR = re.compile(r"[.#]?[A-Za-z_][\w-]*")
#: Columns and rows that a cell may span, and cells that reach into the rows below at once.
#: Text beyond is aligned as if it spanned less; all of it stays.
MAX_SPAN, MAX_TAKEN = 1000, 2000
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NUMBER = re.compile(r"-?[0-9]{1,9}")


class _Flow:
    """Lines of one flow of text (the page, or a table cell)."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.part: list[str] = []
        self.space = self.gap = False
        self.lead = ""

    def words(self, text: str, indent: str) -> None:
        for i, piece in enumerate(_SPACE.split(text)):
            if i:
                self.space = bool(self.part)
            if piece:
                if not self.part:
                    self._open(indent)
                elif self.space:
                    self.part.append(" ")
                self.part.append(piece)
                self.space = False

    def _open(self, indent: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.part.append(indent + self.lead if self.lead else indent)
        self.lead = ""

    def exact(self, text: str, indent: str) -> None:
        for i, line in enumerate(text.split("\n")):
            if i:
                if not self.part:
                    self._open(indent)
                self.end()
            if line:
                if not self.part:
                    self._open(indent)
                self.part.append(line)

    def end(self, apart: bool = False) -> None:
        if self.part:
            self.lines.append("".join(self.part).rstrip())
            self.part = []
        self.space = False
        self.gap = self.gap or apart

    def line(self, text: str) -> None:
        self.end()
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(text.rstrip())


class _Tags:
    """Ends of the tags of a page, found in one linear scan.

    A quote opens a value of any length after '=' only; elsewhere, or where nothing closes
    it, it is a character. The last place of each kind of quote, the stop found last and
    the places from which no end was found are remembered, so that a page of open quotes or
    tags is not read again and again.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'>"}
        self.dead: set[int] = set()
        self.since, self.stop = 0, -1

    def _next(self, at: int) -> int:
        if not self.since <= at <= self.stop:
            m = _STOP.search(self.page, at)
            self.since, self.stop = at, m.start() if m else len(self.page)
        return self.stop

    def end(self, at: int) -> int:
        """Place of the '>' of the tag whose name ends at ``at``; -1 if there is none."""
        page, seen, begin = self.page, [], at
        while at <= self.last[">"]:
            stop = self._next(at)
            if stop in self.dead:
                break
            seen.append(stop)
            c, at = page[stop], stop + 1
            if c == ">":
                return stop
            before = stop - 1
            while before >= begin and page[before] in " \t\n\r\f":
                before -= 1
            if before >= begin and page[before] == "=" and at <= self.last[c]:
                at = page.find(c, at) + 1
        self.dead.update(seen)
        return -1


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}


def _without_at_rules(css: str) -> str:
    """A style sheet without the blocks of its at-rules, which hold in some cases only."""
    out, begin = [], 0
    while (at := css.find("@", begin)) >= 0:
        out.append(css[begin:at])
        depth, begin = 0, len(css)
        for m in _BRACE.finditer(css, at):
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            if depth <= 0 and m[0] != "{":
                begin = m.end()
                break
    return "".join([*out, css[begin:]])


def style_rules(css: str) -> dict[str, list[str]]:
    """Declarations by selector, for selectors that are one tag, class or id; others and at-rules are passed over."""
    out: dict[str, list[str]] = defaultdict(list)
    css = _COMMENT.sub(" ", css)
    for m in _RULE.finditer(_without_at_rules(css)):
        head = m[1]
        low = m[2].lower()
        if "display" in low or "visibility" in low:
            for part in head.split(","):
                if _SELECTOR.fullmatch(name := part.strip()):
                    out[name.lower() if name[0] not in ".#" else name].append(m[2])
    return out


class _Cell:
    def __init__(self, raw: str) -> None:
        a = _attributes(raw) if "span" in raw.lower() else {}
        self.cols, self.rows = (self._span(a.get(k, "")) for k in ("colspan", "rowspan"))
        self.lines: list[str] = []

    @staticmethod
    def _span(value: str) -> int:
        n = int(value) if _NUMBER.fullmatch(value) else 1
        return min(max(n, 1), MAX_SPAN) if value != "0" else MAX_SPAN


class _Table:
    """Rows of cells; a cell that spans rows keeps its columns free in the rows below."""

    def __init__(self, indent: str) -> None:
        self.rows: list[list[_Cell]] = []
        self.indent = indent

    def lines(self) -> list[str]:
        taken: list[tuple[int, int, int]] = []  # columns from, to, and the first row in which they are free again
        placed: list[list[tuple[int, _Cell]]] = []
        width: dict[int, int] = {}
        for r, row in enumerate(self.rows):
            at = k = 0
            own, new = [], []
            taken = [x for x in taken if x[2] > r] if row else taken
            for cell in row:
                while k < len(taken) and taken[k][0] <= at:
                    at = max(at, taken[k][1])
                    k += 1
                own.append((at, cell))
                if cell.cols == 1:
                    width[at] = max(width.get(at, 0), min(max(map(len, cell.lines), default=0), MAX_ALIGN))
                if cell.rows > 1 and len(taken) + len(new) < MAX_TAKEN:
                    new.append((at, at + cell.cols, r + cell.rows))
                at += cell.cols
            taken = sorted(taken + new) if new else taken
            placed.append(own)
        start, sums = {}, 0
        for k in sorted({k for own in placed for k, _ in own} | width.keys()):
            start[k] = sums
            sums += width[k] + 2 if k in width else 0
        out = []
        for own in placed:
            for i in range(max((len(c.lines) for _, c in own), default=0)):
                line = ""
                for k, cell in own:
                    if i < len(cell.lines) and cell.lines[i]:
                        line = line.ljust(start[k]) if len(line) <= start[k] or not line else line + "  "
                        line += cell.lines[i]
                if line.strip():
                    out.append(self.indent + line.rstrip())
        return out


class _Renderer:
    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool]] = []  # element, whether it hides (-1: shows again), whether text was visible outside
        self.open: dict[str, list[int]] = defaultdict(list)  # element -> places on the stack
        self.blocks: list[int] = []  # places of block elements and walls
        self.hidden = 0
        self.visible = True
        self.rules: dict[str, list[str]] = defaultdict(list)
        self.flows = [_Flow()]
        self.tables: list[_Table] = []
        self.lists: list[list] = []  # kind, next number, step
        self.quotes = self.pre = 0
        self.title: list[str] = []

    @property
    def indent(self) -> str:
        return "  " * min(max(0, len(self.lists) - 1) + self.quotes, MAX_INDENT) if len(self.flows) == 1 else ""

    def _last(self, tags) -> int:
        """Place of the innermost open element of some kinds; -1 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def text(self, s: str) -> None:
        if self.hidden or not self.visible or not s:
            return
        s = html.unescape(s) if "&" in s else s
        if self.pre:
            self.flows[-1].exact(s, self.indent)
        else:
            self.flows[-1].words(s, self.indent)

    def start(self, tag: str, raw: str) -> None:
        if tag in IMPLIED:
            closes, wall = IMPLIED[tag]
            inside = self._last(wall)
            lowest = min((at[k] for t in closes if (at := self.open.get(t)) and (k := bisect_right(at, inside)) < len(at)), default=None)
            if lowest is not None:
                self._pop_to(lowest)
        elif tag in BLOCK and self.blocks and self.stack[self.blocks[-1]][0] == "p":
            self._pop_to(self.blocks[-1])
        if tag in VOID:
            if self.hidden:
                return
            flow = self.flows[-1]
            if tag == "br":
                if flow.part:
                    flow.end()
                else:
                    flow.gap = True
            elif not self.visible:
                return
            elif tag == "hr":
                flow.end(True)
                flow.line("-" * 20)
                flow.gap = True
            elif tag == "img" and (alt := _attributes(raw).get("alt")):
                self.text(alt)
            return
        hides, visible = self._state(tag, raw)
        self.open[tag].append(len(self.stack))
        if tag in BLOCK or tag in WALL:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, hides, self.visible))
        self.hidden += hides
        self.visible = visible
        if self.hidden:
            return
        flow = self.flows[-1]
        if tag in BLOCK:
            flow.end(tag in APART and not (tag in ("ul", "ol") and self.lists))
        if tag in ("ul", "ol"):
            a = _attributes(raw) if tag == "ol" else {}
            begin = a.get("start", "")
            self.lists.append([tag, int(begin) if _NUMBER.fullmatch(begin) else 1, -1 if "reversed" in a and begin else 1])
        elif tag == "li":
            if self.lists and self.lists[-1][0] == "ol":
                own = _attributes(raw).get("value", "") if "value" in raw.lower() else ""
                if _NUMBER.fullmatch(own):
                    self.lists[-1][1] = int(own)
                flow.lead = f"{self.lists[-1][1]}. "
                self.lists[-1][1] += self.lists[-1][2]
            else:
                flow.lead = "- "
        elif tag == "dd":
            flow.lead = "  "
        elif tag == "blockquote":
            self.quotes += 1
        elif tag == "pre":
            self.pre += 1
        elif tag == "table":
            self.tables.append(_Table(self.indent))
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1].rows:
                self.tables[-1].rows.append([])
            self.tables[-1].rows[-1].append(_Cell(raw))
            self.flows.append(_Flow())
        elif tag == "option":
            flow.words(" ", self.indent)

    def _state(self, tag: str, raw: str) -> tuple[int, bool]:
        """Whether an element hides what is in it (-1: shows it again), and whether its text is visible."""
        if tag in HIDDEN:
            return 1, self.visible
        if tag == "summary" and self.stack and self.stack[-1][0] == "details" and self.stack[-1][1]:
            return -1, self.visible
        low = raw.lower()
        some = "hid" in low or "none" in low or "collapse" in low or "visib" in low
        if not some and not self.rules and tag not in ("details", "dialog"):
            return 0, self.visible
        a = _attributes(raw)
        styles = [x for k in (tag, *(f".{c}" for c in a.get("class", "").split()), f"#{a.get('id', '')}") for x in self.rules.get(k, ())] if self.rules else []
        styles.append(a.get("style", ""))
        shut = tag in ("details", "dialog") and "open" not in a
        hides = shut or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or any(map(_GONE.search, styles))
        seen = [m[1].lower() == "visible" for x in styles for m in _SEEN.finditer(x)]
        return int(hides), seen[-1] if seen else self.visible

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        at = self.open.get(tag)
        if at and at[-1] >= self._last(("table",) if tag in TABLE_PARTS else WALL):
            self._pop_to(at[-1])

    def _pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            tag, hides, self.visible = self.stack.pop()
            self.open[tag].pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            if self.hidden:
                self.hidden -= hides
                continue
            self.hidden -= hides  # a summary ends within closed details
            flow = self.flows[-1]
            if tag in ("td", "th") and self.tables and len(self.flows) > 1:
                flow.end()
                self.flows.pop()
                self.tables[-1].rows[-1][-1].lines = [x for x in flow.lines if x]
            elif tag == "table" and self.tables:
                table = self.tables.pop()
                for line in table.lines():
                    flow.line(line)
                flow.gap = True
            elif tag in BLOCK:
                flow.end(tag in APART and not (tag in ("ul", "ol") and len(self.lists) > 1))
                flow.lead = "" if tag in ("li", "dd") else flow.lead
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            elif tag == "blockquote":
                self.quotes -= 1
            elif tag == "pre":
                self.pre -= 1


def render(page: str) -> tuple[str, str]:
    """Title and laid-out visible text of a page."""
    r = _Renderer()
    at, title = 0, ""
    tags = _Tags(page)
    begin = 0
    while m := _TOKEN.search(page, begin):
        stop = m.end()
        if m[3]:
            stop = tags.end(stop) + 1
            if not stop:  # no tag: text
                begin = m.start() + 1
                continue
        r.text(page[at : m.start()])
        raw = page[m.end() : stop - 1]
        at = begin = stop
        if m[1] is not None:
            r.text(html.escape(m[1]))
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            r.end(tag)
            continue
        r.start(tag, raw)
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            body, after = (page[at : close.start()], close.end()) if close else (page[at:], len(page))
            if tag == "title" and not title:
                title = _SPACE.sub(" ", html.unescape(body)).strip()
            if tag == "style":
                for name, own in style_rules(body).items():
                    r.rules[name] += own
            if r.stack and r.stack[-1][0] == tag:
                if tag not in HIDDEN:
                    r.text(body)
                r._pop_to(len(r.stack) - 1)
            at = begin = after
    r.text(page[at:])
    r._pop_to(0)
    r.flows[0].end()
    return title, "\n".join(r.flows[0].lines).strip("\n")


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, title, text, n_chars, n_lines`` for every page.

    A null page has null title and text; an empty one has empty ones. Rows repeat as
    given. Pages of any length are read whole; an empty table gives no rows. Columns other than page_id, url and html are not read.
    """
    small_batches(pages.sparkSession, 500)

    def run(batches):
        for b in batches:
            got = [render(h) if h is not None else (None, None) for h in b.column(2).to_pylist()]
            text = [t for _, t in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([t for t, _ in got], pa.string()), pa.array(text, pa.string()), pa.array([len(t) if t is not None else None for t in text], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in text], pa.int64())],
                ["page_id", "url", "title", "text", "n_chars", "n_lines"],
            )

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, title string, text string, n_chars long, n_lines long")
