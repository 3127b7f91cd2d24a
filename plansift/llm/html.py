"""Layout-aware rendering of HTML pages to text.

A page is tokenised once; a tree builder keeps the stack of open elements, closes those that a tag
closes by implication (<li>, <p>, table parts, <option>, ...) and ignores stray end tags. Nothing in
<head>, <script>, <style>, <template>, <title> is visible, nor what browsers show only when they can't do the thing itself
(<noscript>, <iframe>, <noframes>, <canvas>, <audio>, <video>), what is only data (<datalist>, SVG's <desc> and <metadata>, MathML's
<annotation>), nor an element that is hidden by its attributes (hidden, aria-hidden="true", display:none, visibility:hidden,
<input>, a closed <dialog>). Options, labels in SVG, formulas and the fallback of an <object> come out.
All visible text comes out: blocks stand on lines of their own, paragraphs, headings, lists and tables
with a blank line around (also where they begin or end a block without one); white space collapses, but not in <pre> and <textarea> (whose text is a block); options and SVG labels are lines of their own; list items have
their bullet or number and are indented by depth; the cells of a table's column are padded to equal
width (up to PAD code points; wider cells are kept whole), and a cell that spans columns or rows keeps the others in their columns.

Nulls and empty pages give ''. Text without any tag is kept. Unclosed elements end with the page. Repeated rows give repeated rows, an empty table
none. A page is held whole in its task; the work on it is linear in its length, however deep it is nested, but for the marks of nested lists and quotes.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import map_rows, text_or_empty

PAD = 80

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+|(?=>)))*+)>|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")

# Names from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title iframe canvas audio video datalist noframes desc metadata annotation annotation-xml".split())
RAW = frozenset("script style title textarea iframe noframes noscript".split())
BLOCK = frozenset("address article aside body center details dd div dl dt fieldset figcaption figure footer form header hgroup html legend li main nav ol p pre search section summary table tbody td tfoot th thead tr caption ul blockquote h1 h2 h3 h4 h5 h6 hr textarea select optgroup option text".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure article section hr".split())
ENDS_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption li dd dt legend summary textarea select optgroup option text".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "thead": {"caption", "colgroup"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "rt": {"rt", "rp"}, "rp": {"rt", "rp"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "thead": {"table"}, "option": {"select"}, "optgroup": {"select"}, "rt": {"ruby"}, "rp": {"ruby"}, "body": {"html"}, "p": {"table", "td", "th", "body", "li", "blockquote", "article", "section", "div", "aside", "main", "button"}}
HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


class Box:
    """An open element: what it has rendered so far."""

    __slots__ = ("name", "seen", "pre", "lines", "line", "lead", "gap", "number", "rows", "holder", "table", "list", "in_item", "span")

    def __init__(self, name: str, seen: bool, pre: bool, up: Box | None = None):
        self.name, self.seen, self.pre = name, seen, pre
        self.lines: list[str] = []  # finished lines; '' is a blank one
        self.line: list[str] = []  # parts of the line being written
        self.lead = self.gap = False  # whether a blank line is due before what is here, and after it
        self.number = 0
        self.rows: list[list[tuple[str, int, int]]] | None = [] if name == "table" else None
        self.span = (1, 1)
        #: The innermost block, which holds the line being written; the innermost table and list; whether a list item is open around.
        self.holder: Box = self if up is None or name in BLOCK else up.holder
        self.table: Box | None = self if name == "table" else up.table if up else None
        self.list: Box | None = self if name in ("ul", "ol") else up.list if up else None
        self.in_item = up is not None and (up.in_item or up.name == "li")

    def text(self, s: str) -> None:
        if self.pre:
            first, *more = s.split("\n")
            self.line.append(first)
            for x in more:
                self.feed()
                self.line.append(x)
        else:
            self.line.append(s)

    def feed(self) -> None:
        """Ends the line being written."""
        s = "".join(self.line)
        s = s.rstrip() if self.pre else " ".join(s.split())
        self.line = []
        if s or self.pre:
            if self.gap and self.lines and s:
                self.lines.append("")
            self.gap = False if s else self.gap
            self.lines.append(s)

    def add(self, lines: list[str], before: bool, after: bool) -> None:
        """Puts a finished block's lines in, with a blank line due before or after."""
        if "".join(self.line).strip():
            self.feed()
        else:
            self.line = []
        low, high = 0, len(lines)
        while low < high and not lines[low]:
            low += 1
        while high > low and not lines[high - 1]:
            high -= 1
        if low == high:
            self.gap = self.gap or before or after
            self.lead = self.lead or not self.lines and self.gap
            return
        if not self.lines:
            self.lead = self.lead or self.gap or before
        elif (self.gap or before) and self.lines[-1]:
            self.lines.append("")
        part = lines[low:high] if high - low < len(lines) else lines
        if self.lines:
            self.lines += part
        else:  # taken as it is, so that deep nesting copies nothing
            self.lines = part
        self.gap = after


def _attributes(said: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(said)}


def _visible(name: str, attributes: str) -> bool:
    if name in UNSEEN:
        return False
    if not attributes or attributes.isspace():
        return name != "dialog"
    has = _attributes(attributes)
    return not ("hidden" in has or has.get("aria-hidden", "").lower() == "true" or name == "dialog" and "open" not in has or HIDDEN.search(entities.unescape(has.get("style", ""))))


def _span(attributes: str) -> tuple[int, int]:
    """Columns and rows of a cell; 0 rows are all that follow."""
    has = _attributes(attributes)
    number = lambda x, most: min(int(x), most) if x.isascii() and x.isdigit() and len(x) < 9 else 1
    return max(1, number(has.get("colspan", "").strip(), 1000)), number(has.get("rowspan", "").strip(), 65534)


def _table(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of (text, columns, rows) cells as lines; short cells of a column are padded to equal width."""
    placed: list[list[tuple[int, int, str]]] = []  # first column, end, text
    open_: list[tuple[int, int, int]] = []  # first column, end, rows still to come of cells from above (-1: all)
    for r in rows:
        taken, out, at = sorted(open_), [], 0
        now = [(a, b, n - 1 if n > 0 else n) for a, b, n in taken if n != 1]
        k = 0
        for text, columns, span in r:
            while k < len(taken) and taken[k][0] <= at:
                at = max(at, taken[k][1])
                k += 1
            out.append((at, at + columns, text))
            if span != 1:
                now.append((at, at + columns, span - 1 if span else -1))
            at += columns
        open_ = now
        placed.append(out)
    starts = sorted({a for r in placed for a, _, _ in r})
    at = {a: i for i, a in enumerate(starts)}
    width = [0] * len(starts)
    end = lambda b: bisect_left(starts, b)
    for r in placed:
        for a, b, text in r:
            if end(b) - at[a] == 1:
                width[at[a]] = max(width[at[a]], min(len(text), PAD))
    lines = []
    for r in placed:
        if not any(text for _, _, text in r):
            continue
        parts, i = [], 0
        for a, b, text in r:
            parts += [" " * w for w in width[i : at[a]]]  # columns that a cell from above takes
            i = max(end(b), at[a] + 1)
            parts.append(text.ljust(sum(width[at[a] : i]) + 3 * (i - at[a] - 1)))
        lines.append(" | ".join(parts).rstrip())
    return lines


def _close(stack: list[Box], open_: Counter) -> None:
    box = stack.pop()
    open_[box.name] -= 1
    up = stack[-1].holder
    name = box.name
    if name not in BLOCK:
        return
    if "".join(box.line).strip():
        box.feed()
    if not box.seen:
        return
    if name in ("td", "th") and box.table is not None:
        rows = box.table.rows
        if not rows:
            rows.append([])
        rows[-1].append((" ".join(x for x in box.lines if x), *box.span))
        return
    if name == "table":
        box.lines = [*box.lines, *_table(box.rows)]
    elif name == "tr":
        up.add(box.lines, False, False)
        return
    elif name == "li":
        owner = box.list
        if owner is not None:
            owner.number += 1
        mark = f"{owner.number}. " if owner is not None and owner.name == "ol" else "- "
        box.lines = [(mark + box.lines[0]).rstrip(), *((" " * len(mark) + x if x else "") for x in box.lines[1:])] if box.lines else []
    elif name == "blockquote":
        box.lines = [("> " + x).rstrip() for x in box.lines]
    elif name == "dd":
        box.lines = ["  " + x if x else "" for x in box.lines]
    spaced = name in SPACED and not (name in ("ul", "ol") and box.in_item)
    up.add(box.lines, spaced or box.lead, spaced or box.gap)


def render(page: str) -> str:
    """All visible text of a page."""
    stack, open_ = [Box("", True, False)], Counter()
    raw = None  # the element whose content is not markup
    i, n = 0, len(page)
    while i < n:
        if raw:
            m = re.compile(rf"</{raw}\s*/?>", re.I).search(page, i)
            end = m.start() if m else n
            if stack[-1].seen and raw == "textarea":
                stack[-1].text(entities.unescape(page[i:end]))
            i, raw = (m.end() if m else n), None
            _close(stack, open_)
            continue
        m = TOKEN.match(page, i)
        if not m:  # '<' of a tag that never ends
            stack[-1].holder.text(page[i]) if stack[-1].seen else None
            i += 1
            continue
        i = m.end()
        top = stack[-1]
        if m[4] is not None:
            if top.seen:
                top.holder.text(entities.unescape(m[4]) if "&" in m[4] else m[4])
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                top.holder.feed()
            elif open_[name]:
                while stack[-1].name != name:
                    _close(stack, open_)
                _close(stack, open_)
            elif name == "p":
                top.holder.add([], True, True)
            continue
        if name in ENDS_P and open_["p"]:
            _until(stack, open_, {"p"}, SCOPE["p"] - {"p"})
        if name in CLOSES:
            _until(stack, open_, CLOSES[name], SCOPE[name])
        top = stack[-1]
        if name in VOID:
            box = top.holder
            if top.seen:
                if name == "br":
                    if "".join(box.line).strip() or box.pre:
                        box.feed()
                    else:
                        box.line = []
                elif name == "hr":
                    box.add(["---"], True, True)
                elif name == "img" and (alt := _attributes(m[3]).get("alt")):
                    box.text(entities.unescape(alt))
            continue
        if m[3].endswith("/") and (name in ("svg", "math", "path") or open_["svg"] or open_["math"]):
            continue
        box = Box(name, top.seen and _visible(name, m[3]), top.pre or name in ("pre", "textarea"), top)
        if name == "tr" and top.seen and top.table is not None:
            top.table.rows.append([])
        elif name in ("td", "th") and "span" in m[3].lower():
            box.span = _span(m[3])
        stack.append(box)
        open_[name] += 1
        if name == "optgroup" and box.seen and (label := _attributes(m[3]).get("label")):
            box.text(entities.unescape(label))
        if name in RAW:
            raw = name
    while len(stack) > 1:
        _close(stack, open_)
    top = stack[0]
    if "".join(top.line).strip():
        top.feed()
    lines = top.lines
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def _until(stack: list[Box], open_: Counter, names: set[str], scope: set[str]) -> None:
    """Closes the innermost open elements of these names, and all in them, unless one of scope stands between."""
    while any(open_[x] for x in names):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names or stack[k].name in scope:
                break
        if stack[k].name not in names:
            return
        while len(stack) > k:
            _close(stack, open_)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id, the kept columns, text, n_chars (code points) of every page. A kept column can't be called as one of these."""
    if clash := {"page_id", "text", "n_chars"}.intersection(c.lower() for c in keep):
        raise ValueError(f"{sorted(clash)} would stand twice")

    def run(batches):
        for rows in batches:
            out = []
            for *held, page in rows:
                text = render(page)
                out.append((*held, text, len(text)))
            yield out

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), *keep, text_or_empty(html_col).alias("_html"))
    held = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:-1])
    return map_rows(rows, run, f"page_id long{held}, text string, n_chars long")
