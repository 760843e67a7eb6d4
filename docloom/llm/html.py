"""Layout-aware text of HTML pages.

A forgiving tree builder (implied end tags, void elements, raw text elements)
drives a renderer that emits all visible text: blocks on lines of their own,
paragraphs and headings set off by an empty line, list items with their marks
and depth, preformatted text as it stands, and table cells padded to columns.
Both run over one stack, so deep nesting costs no recursion; open elements are
found by name, and no tag or quote is looked for twice, so time and memory
follow the page's length, whatever stands in it.

Hidden: head, script, style, template, noscript and other replaced elements, a
closed dialog, brackets of ruby text, the hidden attribute (unless the element's
style gives it a display), ``display: none`` and ``visibility: hidden`` (which a
child may lift) where that is the declaration that counts, hidden inputs, and what
a closed ``details`` holds but its summary. Style sheets aren't read: only an
element's own style and attributes hide it. Items of ordered lists are numbered
as ``start``, ``value``, ``reversed`` and ``type`` say. Formulas show as their
characters stand, drawings as their labels, a line each.

A tag that never ends is text, as is all behind it. A cell's column is as wide as
the cells that begin and end in it, wide characters taking two places; a table's
first head stands above, and its first foot below, all other rows. Indents end
at INDENTS levels, and tables inside NESTED others show as blocks: n levels, each
with a line, would take n * n blanks.

A null or empty page gives empty text. Rows are rendered alike, one by one, in
Python, which a tree builder needs; repeated rows stay, and columns besides the
page are carried along, but one named as the result, which it replaces.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

# Element names of the HTML standard, by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head script style template noscript iframe object audio video canvas datalist noembed noframes title rp".split())
# Values of display that a style may give; others are no declarations.
DISPLAYS = frozenset("none block inline inline-block flex inline-flex grid inline-grid flow-root contents list-item table inline-table table-row table-cell table-row-group table-header-group table-footer-group table-column table-column-group table-caption ruby run-in initial inherit unset revert".split())
# In svg, characters show only inside these; in svg and math, what these hold doesn't show.
LABEL = frozenset("text foreignobject".split())
UNSHOWN = frozenset("defs symbol clippath mask marker pattern metadata desc annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption option optgroup".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
ENDS_P = BLOCK - frozenset("body html caption option optgroup legend".split())
# An opening tag on the left ends open ones on the right, up to the scope after the bar.
IMPLIED = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist optgroup"), "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th caption colgroup", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th caption colgroup", "table"), "thead": ("tbody thead tfoot tr td th caption colgroup", "table"), "tfoot": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "colgroup": ("caption colgroup", "table"), "body": ("head", "html"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
#: An end tag doesn't reach past these.
WALLS = frozenset("table td th caption template html".split())

#: Quotes count only behind an equals sign, as in browsers; one that never closes is a character.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>")
#: Levels of indent that a line shows, and tables in tables whose cells are aligned.
INDENTS, NESTED = 24, 24
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANKS = re.compile(r"[ \t\n\f\r]+")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?")
_COMMENT_END = re.compile("--!?>")
#: Comments and tags of lists, for items to be counted before they come.
_LISTS = re.compile(r"<!--(?:-?>|(?:(?!--!?>).)*+(?:--!?>|\Z))|<(/?)(ol|ul|menu|dir|li)(?=[\s/>])[^<>]*+>", re.I | re.S)
_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def ordinal(n: int, kind: str) -> str:
    """A number as an ordered list of the type (1, a, A, i or I) shows it."""
    out, k = "", n
    if kind in ("a", "A") and n > 0:
        while k:
            k, rest = divmod(k - 1, 26)
            out = chr(97 + rest) + out
    elif kind in ("i", "I") and 0 < n < 4000:
        for size, letters in _ROMAN:
            out += letters * (k // size)
            k %= size
    else:
        return str(n)
    return out.upper() if kind.isupper() else out


def list_sizes(html: str) -> dict[int, int]:
    """Items of each list, by where the list's tag begins."""
    out: dict[int, int] = {}
    opened: list[int] = []
    for m in _LISTS.finditer(html):
        if m[2] is None:
            continue
        if m[2].lower() != "li":
            if not m[1]:
                opened.append(m.start())
                out[m.start()] = 0
            elif opened:
                opened.pop()
        elif not m[1] and opened:
            out[opened[-1]] += 1
    return out


def places(line: str) -> int:
    """Columns that a line takes."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


class Writer:
    """Lines of text with blocks, marks and indents."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.mark: str | None = None
        self.indent: list[str] = []

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            self.now.append(first)
            for line in rest:
                self.flush(keep=True)
                self.now.append(line)
            return
        s = _BLANKS.sub(" ", s)
        if s[:1] == " " and (not self.now or self.now[-1][-1:] in (" ", "")):
            s = s[1:]
        if s:
            self.now.append(s)

    def flush(self, keep: bool = False) -> None:
        line = "".join(self.now)
        self.now = []
        if not keep:
            line = line.rstrip(" ")
        if not line and not keep:
            return
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        pad = "".join(self.indent[-INDENTS:])
        if self.mark is not None:
            pad = pad[: len(pad) - len(self.mark)] + self.mark
            self.mark = None
        self.lines.append((pad + line).rstrip() if not keep else pad + line)

    def block(self, spaced: bool) -> None:
        self.flush()
        self.gap = self.gap or spaced

    def add(self, lines: list[str]) -> None:
        self.flush()
        for line in lines:
            self.now = [line]
            self.flush(keep=True)

    def done(self) -> list[str]:
        self.flush()
        if self.mark is not None:  # an empty item still shows its mark
            self.now = [""]
            self.flush(keep=True)
        lines = [x.rstrip() for x in self.lines]
        while lines and not lines[-1]:
            lines.pop()
        return lines


class Element:
    __slots__ = ("bare", "count", "down", "foreign", "hidden", "invisible", "kind", "name", "out", "pre", "rows", "shut", "span", "step")

    def __init__(self, name: str):
        self.name, self.rows, self.out, self.count, self.step, self.span, self.down = name, None, None, 0, 1, 1, 1
        self.hidden = self.invisible = self.pre = self.shut = self.foreign = self.bare = False
        self.kind = ""


def in_order(rows: list) -> list:
    """A table's rows with its first head before all others and its first foot behind; a group's name stands before its rows and None behind, and None parts groups in what comes back."""
    groups: list[tuple[str | None, list]] = [(None, [])]
    for row in rows:
        if row is None or isinstance(row, str):
            groups.append((row, []))
        else:
            groups[-1][1].append(row)
    head = next((g for g in groups if g[0] == "thead"), None)
    foot = next((g for g in groups if g[0] == "tfoot"), None)
    rest = [g for g in groups if g is not head and g is not foot]
    return [x for g in ([head] if head else []) + rest + ([foot] if foot else []) for x in (None, *g[1])]


def placed(rows: list[list[tuple[list[str], int, int]] | None]) -> list[list[tuple[int, list[str], int]]]:
    """First column, lines and columns of each cell; cells that reach down from rows above keep their columns, up to the end (None) of their group of rows."""
    taken: list[tuple[int, int, int]] = []  # columns held from one to another, before the row of the last number
    runs: list[tuple[int, int]] = []  # the same without gaps
    change = 0  # the first row for which some are free again
    out: list[list[tuple[int, list[str], int]]] = []
    for row in rows:
        if row is None:
            taken, runs = [], []
            continue
        c, k, cells, new = 0, 0, [], []
        for lines, span, down in row:
            while k < len(runs) and runs[k][0] <= c:
                c = max(c, runs[k][1])
                k += 1
            cells.append((c, lines, span))
            if down > 1:
                new.append((c, c + span, len(out) + down))
            c += span
        out.append(cells)
        if new or (taken and change <= len(out)):
            taken = sorted(x for x in taken + new if x[2] > len(out))
            change = min((x[2] for x in taken), default=0)
            runs = []
            for a, b, _ in taken:
                if runs and runs[-1][1] >= a:
                    runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
                else:
                    runs.append((a, b))
    return out


def grid(rows: list[list[tuple[list[str], int, int]] | None]) -> list[str]:
    """Cells padded to columns, two blanks apart; a cell with several lines takes several."""
    table = placed(rows)
    width = {c: 0 for row in table for c, _, _ in row}
    for row in table:
        for c, lines, span in row:
            if span == 1:
                width[c] = max(width[c], max(map(places, lines), default=0))
    starts, at = {}, 0
    for c in sorted(width):
        starts[c] = at
        at += width[c] + 2
    out = []
    for row in table:
        for k in range(max((len(lines) for _, lines, _ in row), default=0)):
            line, size = [], 0
            for c, lines, _ in row:
                if k < len(lines):
                    to = max(starts[c], size + 2 if size else 0)
                    line += [" " * (to - size), lines[k]]
                    size = to + places(lines[k])
            out.append("".join(line).rstrip())
    return out


def _number(text: str) -> int | None:
    return int(text) if re.fullmatch(r"\s*-?[0-9]{1,9}\s*", text) else None


class Renderer:
    def __init__(self) -> None:
        self.stack = [Element("#root")]
        self.at: dict[str, list[int]] = {}  # where on the stack elements of a name are
        self.tables: list[Element] = []
        self.deep = 0  # open tables beyond those whose cells are aligned
        self.out = Writer()
        self.sizes: dict[int, int] | None = None
        self.page, self.where = "", 0

    def last(self, names) -> int:
        """Where the innermost open element of these names is; 0 if there is none."""
        return max((at[-1] for n in names if (at := self.at.get(n))), default=0)

    def pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            e = self.stack.pop()
            self.at[e.name].pop()
            self.leave(e)

    def attributes(self, raw: str) -> dict[str, str]:
        return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}

    def open(self, name: str, raw: str) -> None:
        if name in IMPLIED:
            ends, scope = IMPLIED[name]
            self.close_to(ends, scope | WALLS - ends)
        if name in ENDS_P:
            self.close_to(frozenset(("p",)), WALLS | frozenset(("button", "object")))
        if name in ("td", "th") and self.last(("tr",)) <= self.last(("table",)):
            self.open("tr", "")
        a = self.attributes(raw) if raw.strip(" /\n\t") else {}
        top, e = self.stack[-1], Element(name)
        e.hidden = top.hidden or name in HIDDEN or (name == "input" and a.get("type", "").lower() == "hidden") or (top.shut and name != "summary")
        e.invisible, e.pre = top.invisible, top.pre or name in ("pre", "textarea", "xmp")
        e.shut = name == "details" and "open" not in a
        e.foreign = name in ("svg", "math") or (top.foreign and name != "foreignobject")
        e.bare = name == "svg" or (top.bare and name not in LABEL)  # characters that stand bare in a drawing don't show
        e.hidden = e.hidden or (e.foreign and name in UNSHOWN)
        said: dict[str, tuple[bool, str]] = {}
        for k, v, important in _STYLE.findall(a.get("style", "").lower()):  # of equals the last counts
            if (bool(important) or not said.get(k, (False, ""))[0]) and (k != "display" or v in DISPLAYS):
                said[k] = bool(important), v
        if "display" in said:
            e.hidden = e.hidden or said["display"][1] == "none"
        else:
            e.hidden = e.hidden or "hidden" in a or (name == "dialog" and "open" not in a)
        if "visibility" in said:
            e.invisible = said["visibility"][1] in ("hidden", "collapse")
        if not e.hidden:
            self.enter(e, a)
        if e.foreign and raw.rstrip().endswith("/"):
            self.leave(e)
        elif name not in VOID:
            self.at.setdefault(name, []).append(len(self.stack))
            self.stack.append(e)

    def enter(self, e: Element, a: dict[str, str]) -> None:
        name = e.name
        if name == "br":
            self.out.flush(keep=True)
        elif name == "input" and a.get("type", "text").lower() not in ("checkbox", "radio", "image", "file", "color", "range", "password"):
            self.out.text(a.get("value", ""), False)
        elif name == "table" and len(self.tables) >= NESTED:
            self.out.block(True)
            e.kind = "deep"
            self.deep += 1
        elif self.deep and name in ("td", "th", "tr", "tbody", "thead", "tfoot"):
            self.out.block(False)
            e.kind = "deep"
        elif name == "table":
            self.out.block(True)
            e.rows, e.out, self.out = [], self.out, Writer()
            self.tables.append(e)
        elif name in ("td", "th") and (t := self.table()) is not None:
            if not t.rows or not isinstance(t.rows[-1], list):
                t.rows.append([])
            e.out, self.out = self.out, Writer()
            span, down = a.get("colspan", "1"), a.get("rowspan", "1")
            e.span = min(max(int(span), 1), 1000) if span.isascii() and span.isdigit() else 1
            e.down = min(int(down) or 65534, 65534) if down.isascii() and down.isdigit() else 1  # 0: to the end of the group
        elif name == "tr" and (t := self.table()) is not None:
            t.rows.append([])
        elif name in ("tbody", "thead", "tfoot") and (t := self.table()) is not None:
            t.rows.append(name)
        elif name == "text" and e.foreign:
            self.out.block(False)
        elif name in ("ul", "ol", "menu", "dir"):
            self.out.block(not self.at.get("li"))
            e.count, e.kind = _number(a.get("start", "")), a.get("type", "1")
            if name == "ol" and "reversed" in a:
                e.step = -1
                if e.count is None:
                    self.sizes = list_sizes(self.page) if self.sizes is None else self.sizes
                    e.count = self.sizes.get(self.where, 1)
            e.count = 1 if e.count is None else e.count
        elif name == "li":
            self.out.block(False)
            home = self.stack[self.last(("ul", "ol", "menu", "dir"))]
            mark = "- "
            if home.name == "ol":
                value = _number(a.get("value", ""))
                n = home.count if value is None else value
                mark = ordinal(n, a.get("type", home.kind)) + ". "
                home.count = n + home.step
            e.kind = mark
            self.out.mark = mark
            self.out.indent.append(" " * len(mark))
        elif name in ("dd", "blockquote"):
            self.out.block(name == "blockquote")
            self.out.indent.append("  ")
        elif name in BLOCK:
            self.out.block(name in SPACED)

    def table(self) -> Element | None:
        return self.tables[-1] if self.tables else None

    def leave(self, e: Element) -> None:
        if e.hidden:
            return
        name = e.name
        if e.kind == "deep":
            self.deep -= name == "table"
            self.out.block(name == "table")
        elif name == "table":
            rest = self.out.done()
            self.tables.pop()
            self.out = e.out
            self.out.add(rest + grid(in_order(e.rows)))
            self.out.block(True)
        elif name in ("td", "th") and e.out is not None:
            lines = self.out.done()
            self.out = e.out
            self.table().rows[-1].append((lines, e.span, e.down))
        elif name in ("tbody", "thead", "tfoot") and (t := self.table()) is not None:
            t.rows.append(None)
        elif name == "text" and e.foreign:
            self.out.block(False)
        elif name == "li":
            if self.out.mark is not None and not self.out.now:
                self.out.now = [""]
                self.out.flush(keep=True)
            self.out.block(False)
            self.out.indent.pop()
        elif name in ("dd", "blockquote"):
            self.out.block(name == "blockquote")
            self.out.indent.pop()
        elif name in BLOCK:
            self.out.block(name in SPACED and not (name in ("ul", "ol") and bool(self.at.get("li"))))

    def close_to(self, names: frozenset[str], walls: frozenset[str]) -> None:
        """Ends the outermost open element of these names this side of a wall, and all inside it."""
        wall = self.last(walls - names)
        inner = [at[k] for n in names if (at := self.at.get(n)) and (k := bisect.bisect_right(at, wall)) < len(at)]
        if inner:
            self.pop_to(min(inner))

    def close(self, name: str) -> None:
        at = self.last((name,))
        if at and (name in WALLS or name in ("tr", "tbody", "thead", "tfoot", "body") or self.last(WALLS) < at):
            self.pop_to(at)
            return
        if name == "br":
            self.open("br", "")
        elif name == "p":  # an end without a start is an empty paragraph
            self.open("p", "")
            self.close("p")

    def text(self, s: str) -> None:
        top = self.stack[-1]
        if not top.hidden and not top.shut and not top.invisible and not top.bare:
            self.out.text(s, top.pre)

    def after_comment(self, html: str, to: int) -> int:
        """Where a comment or declaration that begins there ends; one that is empty ends at once."""
        if not html.startswith("<!--", to):
            end = html.find(">", to + 2)
            return len(html) if end < 0 else end + 1
        for empty in ("<!-->", "<!--->"):
            if html.startswith(empty, to):
                return to + len(empty)
        m = _COMMENT_END.search(html, to + 4)
        return m.end() if m else len(html)

    def render(self, html: str) -> str:
        at, size, last = 0, len(html), html.rfind(">")
        self.page = html
        while at < size:
            m, to = None, html.find("<", at)
            while to >= 0:  # one that begins no tag is text
                if html.startswith(("<!", "<?"), to):
                    break
                m = _TAG.match(html, to)
                if m or (to + 1 < size and (html[to + 1].isascii() and html[to + 1].isalpha() or html[to + 1 : to + 2] == "/" and html[to + 2 : to + 3].isascii() and html[to + 2 : to + 3].isalpha())):
                    break
                to = html.find("<", to + 1)
            if to != at:
                self.text(unescape(html[at : to if to >= 0 else size]))
            if to < 0:
                break
            if m is None:
                if html[to + 1] in "!?":
                    at = self.after_comment(html, to)
                    continue
                self.text(unescape(html[to:]))  # a tag without an end
                break
            at, name = m.end(), m[2].lower()
            if m[1]:
                self.close(name)
                continue
            self.where = m.start()
            self.open(name, m[3])
            if name == "pre" or name == "textarea":
                at += html[at : at + 1] == "\n"
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.I).search(html, at, last + 1)
                inside = html[at : end.start() if end else size]
                at = end.end() if end else size
                self.text(unescape(inside) if name in ("textarea", "title") else inside)
                self.close(name)
        self.pop_to(1)
        return "\n".join(self.out.done())


def visible_text(html: str) -> str:
    return Renderer().render(html or "")


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages with the visible text in place of the page."""
    rest = [c for c in pages.columns if c not in (html, into)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in ta.slices(whole, html, 4 << 20):
                texts = [visible_text(x.as_py()) for x in b.column(len(rest))]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(texts, pa.string())], [*rest, into])

    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), f"`{into}` string"])
    return pages.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{html}`")).mapInArrow(ta.lean(run), schema)
