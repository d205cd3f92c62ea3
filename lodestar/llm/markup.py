"""HTML to text as it is laid out: a tree builder with implied tags, visibility rules and a block layout.

All visible text is emitted, but the options of `select`. White space collapses but in `pre`, `xmp` and `textarea`; blocks
start on a new line, those with margins after an empty line; list items get a mark and an indent; the cells of a table's
columns are padded to one width, of MAX_PAD characters at most: a longer cell stands whole and moves what follows it in
its row. Only elements whose layout needs their own lines (items, quotes, cells) hold them apart, up to MAX_NEST of them
in each other, beyond which they are plain blocks; so time and memory follow the page, whatever its nesting.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; that of the first kind is no text that shows either.
UNSEEN_RAW = frozenset("script style title iframe noembed noframes noscript".split())
SEEN_RAW = frozenset({"textarea", "xmp"})
UNSEEN = frozenset("head template datalist canvas audio video select".split())
#: In `svg` only what these hold shows, and in `svg` and `math` nothing of those.
LABELS = frozenset({"text", "foreignobject"})
UNSEEN_IN = {"svg": frozenset("desc metadata defs symbol clippath mask pattern marker".split()), "math": frozenset({"annotation", "annotation-xml"})}
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure fieldset hr".split())
BLOCK = MARGIN | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav search section summary tbody tfoot thead tr td th".split())
#: A start tag on the left ends open elements on the right, up to the bound.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir", "table", "td", "th"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr", "td", "th", "caption"}), frozenset({"table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
}
ENDS["thead"] = ENDS["tfoot"] = ENDS["tbody"]
#: Elements that an end tag of another kind doesn't reach through.
SCOPE = frozenset({"table", "td", "th", "caption", "template"})
#: A cell's padding ends here, so that one long cell doesn't widen all rows; and so many elements indent each other.
MAX_PAD, MAX_NEST = 80, 32
INDENT = "  "

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in UNSEEN_RAW | SEEN_RAW}
_UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class _Lines:
    """Lines under construction."""

    __slots__ = ("lines", "inline", "gap")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0

    def flush(self) -> None:
        if self.inline:
            for line in "".join(self.inline).split("\n"):
                self.put(_SPACE.sub(" ", line).strip(" \t"), False)
            self.inline = []

    def put(self, line: str, verbatim: bool) -> None:
        if line or verbatim:
            if self.gap and self.lines:
                self.lines.append("")
            self.lines.append(line)
            self.gap = 0

    def block(self, margin: bool) -> None:
        self.flush()
        self.gap |= margin

    def take(self, lines: list[str]) -> None:
        self.flush()
        for line in lines:
            self.put(line, True)


class _Open:
    """An open element; `own` are the lines that it holds apart."""

    __slots__ = ("tag", "unseen", "drawn", "hidden", "own", "mark", "number", "rows", "span", "down", "pre")

    def __init__(self, tag: str, unseen: bool, drawn: bool, own: _Lines | None, pre: bool) -> None:
        self.tag, self.unseen, self.drawn, self.own, self.pre = tag, unseen, drawn, own, pre
        self.hidden = unseen or drawn
        self.mark, self.number, self.rows, self.span, self.down = "", 0, [], 1, 1


class Page:
    """Builds the tree of open elements and lays out what closes."""

    def __init__(self) -> None:
        self.out = _Lines()
        self.stack = [_Open("", False, False, self.out, False)]
        self.counts: dict[str, int] = {}
        self.depths: dict[str, list[int]] = {}
        self.writers = [self.out]

    def text(self, s: str) -> None:
        top = self.stack[-1]
        if top.hidden or not s:
            return
        s = html.unescape(s) if "&" in s else s
        w = self.writers[-1]
        if top.pre:
            w.flush()
            for line in s.strip("\n").split("\n"):
                w.put(line.rstrip("\r"), True)
        else:
            w.inline.append(_SPACE.sub(" ", s))

    def start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK and self.counts.get("p"):
            self.close_upto(frozenset({"p"}), SCOPE | {"button"})
        if tag in ENDS:
            self.close_upto(*ENDS[tag])
        top = self.stack[-1]
        found = {a.lower(): (b or c or d) for a, b, c, d in _ATTR.findall(attrs)} if attrs.strip(" /\n\t") else {}
        unseen = top.unseen or tag in UNSEEN or any(tag in t and self.counts.get(x) for x, t in UNSEEN_IN.items()) or "hidden" in found or (tag == "dialog" and "open" not in found) or bool(_UNSEEN_STYLE.search(found.get("style", "")))
        label = tag in LABELS and bool(self.counts.get("svg"))
        drawn = tag == "svg" or (top.drawn and not label)
        hidden = unseen or drawn
        if tag in VOID:
            if not hidden and tag == "br":
                self.writers[-1].inline.append("\n")
            elif not hidden and tag == "hr":
                self.writers[-1].block(True)
            elif not hidden and tag == "input" and found.get("type", "").lower() in ("submit", "button", "reset"):
                self.text(found.get("value", ""))
            return
        e = _Open(tag, unseen, drawn, None, top.pre or tag == "pre")
        if not hidden:
            if label:
                self.writers[-1].block(False)
            if tag in BLOCK:
                self.writers[-1].block(tag in MARGIN and not (tag in ("ul", "ol") and self.counts.get("li")))
            if tag in ("li", "blockquote", "td", "th", "dd") and len(self.writers) <= MAX_NEST:
                e.own = _Lines()
                self.writers.append(e.own)
            if tag == "li":
                owner = self.stack[self.innermost(("ol", "ul", "menu", "dir"))]
                if owner.tag == "ol":
                    owner.number = int(found["value"]) if found.get("value", "").lstrip("-").isdecimal() and len(found["value"]) < 10 else owner.number + 1
                    e.mark = f"{owner.number}. "
                else:
                    e.mark = "* "
                if e.own is None:
                    self.writers[-1].inline.append(e.mark)
            elif tag == "ol" and found.get("start", "").lstrip("-").isdecimal() and len(found["start"]) < 10:
                e.number = int(found["start"]) - 1
            elif tag in ("td", "th"):
                e.span, e.down = (max(1, int(found[a])) if re.fullmatch("[0-9]{1,3}", found.get(a, "")) else 1 for a in ("colspan", "rowspan"))
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append(e)
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def innermost(self, tags: Iterable[str]) -> int:
        """The depth of the innermost open element of tags, 0 if there is none."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def close_upto(self, tags: frozenset[str], bound: frozenset[str]) -> None:
        """Close the elements down to the outermost of tags that is not below the innermost of bound; of one tag, to its innermost.

        Depths at which a tag is open are kept in order, so a step costs no more than the kinds of tags it asks for.
        """
        floor = self.innermost(bound)
        if len(tags) == 1:
            at = self.innermost(tags)
            at = at if at >= floor else 0
        else:
            at = min((d[bisect_left(d, floor)] for t in tags if (d := self.depths.get(t)) and d[-1] >= floor), default=0)
        while at and len(self.stack) > at:
            self.close()

    def end(self, tag: str) -> None:
        if self.counts.get(tag):
            bound = frozenset({"table"}) if tag in ("table", "tr", "tbody", "thead", "tfoot") else SCOPE if tag in BLOCK else SCOPE | BLOCK  # an inline end tag ends no block
            self.close_upto(frozenset({tag}), bound - {tag})
        elif tag == "p":
            self.writers[-1].block(not self.stack[-1].hidden)
        elif tag == "br":
            self.start("br", "")

    def close(self) -> None:
        e = self.stack.pop()
        self.counts[e.tag] -= 1
        self.depths[e.tag].pop()
        if e.hidden:
            return
        if e.tag in LABELS and self.counts.get("svg"):
            self.writers[-1].block(False)
        if e.own is not None:
            e.own.flush()
            self.writers.pop()
            if e.tag in ("td", "th"):
                row = self.stack[self.innermost(("tr", "table"))]
                if row.tag:
                    row.rows.append((e.own.lines, e.span, e.down))
                    return
            pad = len(e.mark) if e.tag == "li" else len(INDENT)
            self.writers[-1].take([(e.mark if e.tag == "li" and not k else " " * pad if line else "") + line for k, line in enumerate(e.own.lines)])
        elif e.tag == "tr":
            table = self.stack[self.innermost(("table",))]
            if table.tag:
                table.rows.append(e.rows)
            else:
                self.writers[-1].take(_aligned([e.rows]))
        elif e.tag == "table":
            loose = [r for r in e.rows if isinstance(r, tuple)]
            self.writers[-1].take(_aligned([r for r in e.rows if isinstance(r, list)] + ([loose] if loose else [])))
        if e.tag in BLOCK:
            self.writers[-1].block(e.tag in MARGIN and not (e.tag in ("ul", "ol") and self.counts.get("li")))

    def finish(self) -> str:
        while len(self.stack) > 1:
            self.close()
        self.out.flush()
        return "\n".join(self.out.lines)


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """The lines of a table: cells padded to their column's width, two spaces apart; a cell over columns widens none.

    A cell over several rows keeps its columns free in those below it.
    """
    width: dict[int, int] = {}
    taken: dict[int, int] = {}
    placed: list[list[tuple[int, list[str], int]]] = []
    for row in rows:
        at, cells, below = 0, [], {}
        for lines, span, down in row:
            while taken.get(at):
                at += 1
            if span == 1:
                width[at] = max(width.get(at, 0), min(MAX_PAD, max(map(len, lines), default=0)))
            cells.append((at, lines, span))
            if down > 1:
                below |= dict.fromkeys(range(at, at + span), down)
            at += span
        taken = {c: n - 1 for c, n in (taken | below).items() if n > 1}
        placed.append(cells)
    out = []
    for cells in placed:
        for k in range(max((len(lines) for _, lines, _ in cells), default=0)):
            parts, now = [], 0
            for at, lines, span in cells:
                parts += ["".ljust(width.get(c, 0)) for c in range(now, at)]
                parts.append((lines[k] if k < len(lines) else "").ljust(sum(width.get(c, 0) + 2 for c in range(at, at + span)) - 2))
                now = at + span
            out.append("  ".join(parts).rstrip())
    return out


def render(page: str) -> str:
    """The visible text of a page."""
    tree, pos, n = Page(), 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    while pos < n:
        i = page.find("<", pos)
        if i < 0:
            tree.text(page[pos:])
            break
        if i > pos:
            tree.text(page[pos:i])
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            pos = n if j < 0 else j + 3
            continue
        closing = page.startswith("</", i)
        m = _NAME.match(page, i + 1 + closing)
        if m is None:
            if page[i + 1 : i + 2] in ("!", "?", "/"):
                j = page.find(">", i)
                pos = n if j < 0 else j + 1
            else:
                tree.text("&lt;")
                pos = i + 1
            continue
        tag, at = m[0].lower(), m.end()
        j = page.find(">", at)
        if j < 0:
            break
        while (q := re.search(r"""=\s*(["'])""", page[at:j])) and j >= 0:  # a quoted value may hold the bracket
            begin = at + q.end()
            shut = page.find(q[1], begin) if begin <= last[q[1]] else -1
            if shut < 0:
                break
            at = shut + 1
            if shut > j and (j := page.find(">", shut)) < 0:
                break
        if j < 0:
            break
        attrs, pos = page[m.end() : j], j + 1
        if closing:
            tree.end(tag)
        elif tag in _RAW_END:
            stop = _RAW_END[tag].search(page, pos)
            raw, after = page[pos : stop.start() if stop else n], stop.end() if stop else n
            if tag in SEEN_RAW:
                tree.start("pre", attrs)
                tree.text(raw.replace("&", "&amp;") if tag == "xmp" else raw)
                tree.end("pre")
            pos = page.find(">", after) + 1 if stop and page.find(">", after) >= 0 else n
        else:
            tree.start(tag, attrs)
    return tree.finish()


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(t.as_py() or "") for t in part.column(1)], pa.string())], names=["k", "t"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: the id and `text`. A null or empty page gives an empty text; repeated rows are repeated.

    An empty table gives no rows, and a page may be as long as a row can be; other columns are left out, so that no name
    clashes.
    """
    key = pages.schema[id_col].dataType.simpleString()
    df = pages.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{html_col}`").alias("t"))
    return df.mapInArrow(_rendered, f"k {key}, t string").toDF(id_col, "text")
