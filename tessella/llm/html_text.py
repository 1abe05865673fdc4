"""HTML extraction by layout: a tree with implied tags, visibility rules, and a renderer that keeps blocks, lists, tables.

Tags, entities and raw text are read as browsers do, unclosed or misplaced tags included. Everything a reader would see
is kept: blocks begin new lines, paragraphs and headings keep a blank line, list items their marks and indentation,
table cells their columns, preformatted text its blanks, drawings and formulas their text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate, chain, zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag; entities count in the second kind only.
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW = frozenset("title textarea".split())
HIDDEN = frozenset(
    "head script style template noscript iframe noembed noframes object audio video canvas datalist title "
    "meta link param source track".split()
)
#: What drawings and formulas hold besides what they show.
HIDDEN_IN = {
    "svg": frozenset(
        "title desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter".split()
    ),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
#: Elements of drawings and formulas that hold HTML.
HOLDS_HTML = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext".split())}
#: Start tags that end a drawing or formula.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol "
    "p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Parts of formulas that stand above, below or beside each other.
STACKED = frozenset("mfrac msub msup msubsup munder mover munderover mroot mmultiscripts mtable mtr mlabeledtr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre "
    "search section summary table textarea ul xmp caption tr td th thead tbody tfoot".split()
)
#: Blocks with a blank line before and behind them.
SPACED = frozenset("blockquote dir dl fieldset figure h1 h2 h3 h4 h5 h6 hr listing menu ol p pre table ul xmp".split())
CLOSES_P = BLOCK - frozenset("body html option optgroup caption tr td th thead tbody tfoot legend textarea".split())
LISTS = frozenset("ul ol menu dir".split())
#: A start tag ends these open elements, as far up as the elements behind the colon.
ENDS = {
    "li": (frozenset(["li"]), LISTS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["tr", "table"])),
} | {
    part: (frozenset("tr td th thead tbody tfoot caption colgroup".split()), frozenset(["table"]))
    for part in ("thead", "tbody", "tfoot", "caption", "colgroup")
}
#: End tags do not close elements outside of these.
SCOPE = frozenset(["table", "td", "th", "caption", "html", "template", "button"])
#: Tables nested deeper in cells have a line for each cell, or columns would take the square of a page.
DEEPEST_TABLE = 50
#: Lines are indented by so many blanks at most.
MOST_INDENT = 300
#: Stands for the elements of drawings and formulas that hold HTML.
HOLDER = "#holder"

#: Nothing in it is tried twice, so the time is in proportion to the text.
TAG = re.compile(r"""</?+([a-zA-Z][^\s/>\x00]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|"|')*+)>""")
TAG_BEGINS = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
BLANKS = re.compile(r"[ \t\n\f\r]+")
NOT_DISPLAYED = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: Input fields that show their value, or what stands in for it.
SHOWS_VALUE = frozenset("submit button reset text search email url tel number date month week time datetime-local".split())
NUMBER = re.compile(r"-?\d{1,9}")
#: Roman numerals of the digits of a place: 1 stands for the place, 5 for five of them, 10 for the next place.
ROMAN = ("", "1", "11", "111", "15", "5", "51", "511", "5111", "1X")


@dataclass
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)
    #: svg or math for what is part of a drawing or formula.
    space: str = ""

    def holds_html(self) -> bool:
        if self.tag == "annotation-xml":
            return self.attributes.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")
        return not self.space or self.tag in HOLDS_HTML[self.space]


class Open(list[Element]):
    """The open elements, the root first, and the places of each tag among them; so no tag is searched through them."""

    def __init__(self, root: Element):
        super().__init__([root])
        self.places: dict[str, list[int]] = defaultdict(list)

    def names(self, element: Element) -> tuple[str, ...]:
        return (element.tag, HOLDER) if element.space and element.holds_html() else (element.tag,)

    def open(self, element: Element) -> None:
        for name in self.names(element):
            self.places[name].append(len(self))
        self[-1].children.append(element)
        self.append(element)

    def close(self, place: int = -1) -> None:
        """Ends the element at a place and all in it."""
        place = place % len(self)
        while len(self) > place:
            for name in self.names(self.pop()):
                self.places[name].pop()

    def innermost(self, names: Iterable[str]) -> int:
        """The place of the innermost one, or 0."""
        return max((self.places[name][-1] for name in names if self.places.get(name)), default=0)

    def outermost(self, tags: frozenset[str], limit: frozenset[str]) -> int:
        """The place of the outermost one of ``tags`` in the innermost of ``limit``, or 0."""
        bound = self.innermost(chain(limit, (HOLDER,)))
        own = [places for tag in tags if (places := self.places.get(tag)) and places[-1] > bound]
        return min((places[bisect_right(places, bound)] for places in own), default=0)


def parse(html: str) -> Element:
    """The tree below an element ``html``."""
    root = Element("html")
    stack = Open(root)
    at, lowered = 0, None

    def text(raw: str) -> None:
        if stack[-1].tag == "head" and raw.strip(" \t\n\f\r"):
            stack.close()
        if raw:
            stack[-1].children.append(raw)

    while at < len(html):
        begin = html.find("<", at)
        if begin < 0:
            text(unescape(html[at:]))
            break
        text(unescape(html[at:begin]))
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 2 if html.startswith("<!-->", begin) else begin + 4)
            at = len(html) if end < 0 else end + 3
            continue
        if stack[-1].space and html.startswith("<![CDATA[", begin):
            end = html.find("]]>", begin)
            text(html[begin + 9 : len(html) if end < 0 else end])
            at = len(html) if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), begin):
            end = html.find(">", begin)
            at = len(html) if end < 0 else end + 1
            continue
        found = TAG.match(html, begin)
        if not found and TAG_BEGINS.match(html, begin):
            break
        if not found:
            text("<")
            at = begin + 1
            continue
        at, tag = found.end(), found[1].lower()
        if html[begin + 1] == "/":
            _end(stack, tag)
            continue
        attributes = {}
        for name, *values in ATTRIBUTE.findall(found[2]):
            attributes.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
        _start(stack, tag, attributes)
        if stack[-1].space:
            if html[at - 2] == "/" and stack[-1].tag == tag and stack[-1].attributes is attributes:
                stack.close()
            continue
        if tag in RAW or tag in ESCAPABLE_RAW:
            lowered = html.lower() if lowered is None else lowered
            end = lowered.find(f"</{tag}", at) if len(lowered) == len(html) else -1
            if end < 0:
                close = re.compile(f"</{tag}", re.I).search(html, at)
                end = close.start() if close else len(html)
            text(unescape(html[at:end]) if tag in ESCAPABLE_RAW else html[at:end])
            at = end
    return root


def _leave(stack: Open) -> None:
    """Ends a drawing or formula up to what holds HTML."""
    while not stack[-1].holds_html():
        stack.close()


def _start(stack: Open, tag: str, attributes: dict[str, str]) -> None:
    if tag in BREAKS_OUT or tag == "font" and not attributes.keys().isdisjoint(("color", "face", "size")):
        _leave(stack)
    if not stack[-1].holds_html():
        stack.open(Element(tag, attributes, space=tag if tag in HIDDEN_IN else stack[-1].space))
        return
    if tag in ("html", "body"):
        for name, value in attributes.items():
            stack[0].attributes.setdefault(name, value)
        _end(stack, "head")
        return
    if stack[-1].tag == "head" and tag not in HIDDEN and tag not in ("base", "basefont"):
        stack.close()
    if tag in ENDS:
        ended, limit = ENDS[tag]
        if place := stack.outermost(ended, limit):
            stack.close(place)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            stack.open(Element("tr"))
    if tag in CLOSES_P and (place := stack.outermost(frozenset("p"), SCOPE)):
        stack.close(place)
    stack.open(Element("img" if tag == "image" else tag, attributes, space=tag if tag in HIDDEN_IN else ""))
    if tag in VOID:
        stack.close()


def _end(stack: Open, tag: str) -> None:
    if tag in ("br", "p"):
        _leave(stack)
    if tag == "br":
        stack[-1].children.append(Element("br"))
        return
    limit = frozenset(["table", "html"]) if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else SCOPE
    bound = stack.innermost(limit if tag in HIDDEN_IN else chain(limit, (HOLDER,)))
    place = stack.innermost((tag,))
    if place and place >= bound:
        stack.close(place)
        return
    if tag == "p":
        stack[-1].children.append(Element("p"))


def visible(element: Element) -> bool:
    a = element.attributes
    if element.tag in HIDDEN or "hidden" in a or element.tag == "dialog" and "open" not in a:
        return False
    if element.space and element.tag in HIDDEN_IN[element.space]:
        return False
    return not (a and "style" in a and NOT_DISPLAYED.search(a["style"]))


def _visibility(element: Element) -> str:
    """visible or hidden if the element's own style says so."""
    style = element.attributes.get("style", "") if element.attributes else ""
    said = VISIBILITY.findall(style) if style else []
    return "" if not said else "visible" if said[-1].lower() == "visible" else "hidden"


def _shown_within(element: Element) -> Iterator[Element]:
    """The outermost parts of a hidden element that are visible again."""
    waiting = [c for c in reversed(element.children) if isinstance(c, Element)]
    while waiting:
        own = waiting.pop()
        if not visible(own):
            continue
        if _visibility(own) == "visible":
            yield own
        else:
            waiting += [c for c in reversed(own.children) if isinstance(c, Element)]


def _children(element: Element) -> Iterator[Element | str]:
    for child in element.children:
        if isinstance(child, Element) and _visibility(child) == "hidden":
            yield from _shown_within(child)
        else:
            yield child


def _alphabetic(n: int) -> str:
    """a to z, aa, ab, .."""
    found = ""
    while n > 0:
        n, last = divmod(n - 1, 26)
        found = chr(ord("a") + last) + found
    return found


def _roman(n: int) -> str:
    found = ""
    for digit, letters in zip(f"{n:04d}", ("m  ", "cdm", "xlc", "ivx")):
        found += "".join(letters["15X".index(k)] for k in ROMAN[int(digit)])
    return found


def _mark(number: int, kind: str) -> str:
    """The mark of a list item: numbers, letters or Roman numerals, as far as these go."""
    if kind in ("a", "A") and number > 0:
        found = _alphabetic(number)
    elif kind in ("i", "I") and 0 < number < 4000:
        found = _roman(number)
    else:
        found = str(number)
    return f"{found.upper() if kind in ('A', 'I') else found}. "


@dataclass
class Counter:
    """Numbers of an ordered list's items."""

    next: int
    step: int
    kind: str

    @classmethod
    def of(cls, element: Element) -> Counter:
        a = element.attributes
        backwards = "reversed" in a
        items = sum(isinstance(c, Element) and c.tag == "li" and visible(c) for c in element.children) if backwards else 1
        start = a.get("start", "")
        return cls(int(start) if NUMBER.fullmatch(start) else items, -1 if backwards else 1, a.get("type", ""))

    def mark(self, item: Element) -> str:
        value = item.attributes.get("value", "")
        self.next = int(value) if NUMBER.fullmatch(value) else self.next
        self.next += self.step
        return _mark(self.next - self.step, item.attributes.get("type", "") or self.kind)


class Layout:
    """Lines of text; runs of blanks are one blank, and blank lines between blocks do not add up."""

    def __init__(self, tables: int = 0) -> None:
        self.tables = tables
        self.lines: list[str] = []
        self.line = ""
        self.gap = False
        self.mark = ""
        self.indents = [0]

    def inline(self, text: str) -> None:
        text = BLANKS.sub(" ", text)
        if not self.line or self.line.endswith(" "):
            text = text.lstrip(" ")
        self.line += text

    def end_line(self, forced: bool = False) -> None:
        line = self.line.rstrip(" ")
        self.line = ""
        if line or forced:
            self.put(line)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        if self.mark:
            line, self.mark = f"{' ' * self.indents[-2]}{self.mark}{line}", ""
        elif line:
            line = " " * self.indents[-1] + line
        self.lines.append(line.rstrip(" "))

    def space(self) -> None:
        self.end_line()
        if not self.mark:
            self.gap = True


def _blanks(child: Element, parent: Element) -> tuple[str, str]:
    """What sets a part of a drawing or formula apart from the text before and behind it."""
    if child.space == "math":
        first = next(c for c in parent.children if isinstance(c, Element))
        return " " if parent.space and parent.tag in STACKED and child is not first else "", ""
    placed = child.tag == "text" or child.tag == "tspan" and not child.attributes.keys().isdisjoint(("x", "y", "dx", "dy"))
    return (" ", " ") if placed else ("", "")


def _shows_blanks(element: Element) -> bool:
    return element.holds_html() or element.space == "svg" and element.tag in ("text", "tspan", "textpath", "a")


#: A step of the layout hands out the steps it needs done, and gets their results; so any depth takes no call stack.
Steps = Generator["Steps", object, object]


def _done(steps: Steps) -> object:
    waiting, result = [steps], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(result))
            result = None
        except StopIteration as end:
            waiting.pop()
            result = end.value
    return result


def render(element: Element, out: Layout, pre: bool = False, ordinal: Counter | None = None) -> Steps:
    for child in _children(element):
        if isinstance(child, str):
            if element.space and not _shows_blanks(element) and not child.strip():
                continue
            if not pre:
                out.inline(child)
                continue
            first, *rest = child.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            out.line += first
            for line in rest:
                out.end_line(forced=True)
                out.line = line
            continue
        tag = child.tag
        if not visible(child):
            continue
        if child.space:
            block = tag == "math" and child.attributes.get("display", "").lower() == "block"
            before, behind = _blanks(child, element)
            out.end_line() if block else out.inline(before)
            yield render(child, out)
            out.end_line() if block else out.inline(behind)
        elif tag == "br":
            out.end_line(forced=True)
        elif tag == "input":
            kind = child.attributes.get("type", "text").lower()
            if kind in SHOWS_VALUE:
                out.inline(child.attributes.get("value", "") or child.attributes.get("placeholder", ""))
            elif kind == "image":
                out.inline(child.attributes.get("alt", ""))
        elif tag == "table":
            out.space()
            yield _table(child, out)
            out.space()
        elif tag == "details" and "open" not in child.attributes:
            out.end_line()
            first = next((c for c in child.children if isinstance(c, Element) and c.tag == "summary"), None)
            if first:
                yield render(first, out)
            out.end_line()
        elif tag in LISTS:
            nested = len(out.indents) > 1
            out.end_line() if nested else out.space()
            yield render(child, out, ordinal=Counter.of(child) if tag == "ol" else None)
            out.end_line() if nested else out.space()
        elif tag in ("li", "dd", "blockquote"):
            out.space() if tag == "blockquote" else out.end_line()
            mark = "  "
            if tag == "li":
                mark = "- " if ordinal is None else ordinal.mark(child)
            out.indents.append(min(out.indents[-1] + len(mark), MOST_INDENT))
            out.mark = mark if tag == "li" else ""
            yield render(child, out)
            out.space() if tag == "blockquote" else out.end_line()
            if out.mark:
                out.put("")
            out.indents.pop()
        elif tag in BLOCK:
            step = out.space if tag in SPACED else out.end_line
            step()
            if tag == "textarea" and not any(isinstance(c, str) and c.strip() for c in child.children):
                out.inline(child.attributes.get("placeholder", ""))
            yield render(child, out, pre=pre or tag in ("pre", "listing", "xmp", "textarea"), ordinal=ordinal if tag == "div" else None)
            step()
        else:
            yield render(child, out, pre=pre, ordinal=ordinal)


def _groups(table: Element) -> list[list[Element]]:
    """The rows of each group, as shown: the first head comes first, the first foot last."""
    groups: list[tuple[str, list[Element]]] = []
    waiting = [(c, "") for c in reversed(list(_children(table)))]
    while waiting:
        child, group = waiting.pop()
        if isinstance(child, str) or not visible(child):
            continue
        if child.tag == "tr":
            if not groups or not group and groups[-1][0]:
                groups.append(("", []))
            groups[-1][1].append(child)
        elif child.tag in ("thead", "tbody", "tfoot"):
            groups.append((child.tag, []))
            waiting += [(c, child.tag) for c in reversed(list(_children(child)))]
    head = next((g for g in groups if g[0] == "thead"), None)
    foot = next((g for g in groups if g[0] == "tfoot"), None)
    middle = [g for g in groups if g is not head and g is not foot]
    return [g[1] for g in ([head] if head else []) + middle + ([foot] if foot else [])]


def _span(cell: Element | str, name: str, most: int) -> int:
    value = cell.attributes.get(name, "") if isinstance(cell, Element) else ""
    return min(int(value), most) if re.fullmatch(r"\d{1,6}", value) else 1


def _lines(element: Element, out: Layout) -> Steps:
    """The lines of an element of a table in ``out``."""
    inner = Layout(out.tables + 1)
    yield render(element, inner)
    inner.end_line()
    return inner.lines


def _table(table: Element, out: Layout) -> Steps:
    """Cells in columns as wide as their widest line, two blanks between them; what is in no cell comes first."""
    if out.tables >= DEEPEST_TABLE:
        yield render(table, out)
        return
    for child in table.children:
        if isinstance(child, str):
            out.inline(child) if child.strip() else None
        elif visible(child) and child.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup"):
            out.end_line()
            for line in (yield _lines(child, out)):
                out.put(line)
    out.end_line()
    grid: list[list[tuple[int, list[str]]]] = []
    widths: dict[int, int] = {}
    for group in _groups(table):
        hanging: list[tuple[int, int, int]] = []  # first column, column behind and last row of cells that reach down
        for number, row in enumerate(group):
            hanging = [h for h in hanging if h[2] >= number]
            cells, column, passed, fresh = [], 0, 0, []
            for cell in row.children:
                if isinstance(cell, str) and not cell.strip() or isinstance(cell, Element) and not visible(cell):
                    continue
                while passed < len(hanging) and hanging[passed][0] <= column:
                    column = max(column, hanging[passed][1])
                    passed += 1
                shown = cell if isinstance(cell, Element) else Element("td", {}, [cell])
                if _visibility(shown) == "hidden":
                    shown = Element("td", {}, list(_shown_within(shown)))
                own = yield _lines(shown, out)
                span, rows = max(_span(cell, "colspan", 1000), 1), _span(cell, "rowspan", 65_534) or len(group)
                if span == 1:
                    widths[column] = max(widths.get(column, 0), max(map(len, own), default=0))
                if rows > 1:
                    fresh.append((column, column + span, number + rows - 1))
                cells.append((column, own))
                column += span
            grid.append(cells)
            hanging = sorted(hanging + fresh) if fresh else hanging
    used = sorted(widths)
    upto = [0, *accumulate(widths[c] for c in used)]
    for cells in grid:
        for parts in zip_longest(*(own for _, own in cells), fillvalue=""):
            line = ""
            for part, (column, _) in zip(parts, cells):
                if not part:
                    continue
                line = line.ljust(2 * column + upto[bisect_left(used, column)])
                if line and not line.endswith("  "):  # wider than its columns: the next cell still stands apart
                    line += "  "
                line += part
            if line.strip():
                out.put(line.rstrip())


def html_to_text(html: str | None) -> str:
    """The visible text of a page; empty for null."""
    out = Layout()
    root = parse(html or "")
    if visible(root):
        _done(render(root, out))
        out.end_line()
    return "\n".join(out.lines).strip("\n")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            own = batch.slice(first, 256)
            texts = [html_to_text(h.as_py()) for h in own.column("html")]
            yield pa.RecordBatch.from_arrays([own.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id and text for every row of ``pages``, from its whole html.

    Null and empty html give empty text, and so do pages without anything visible. Not visible are scripts, styles, head and
    templates, what browsers show only in place of something else (noscript, iframe, object, audio, video, canvas), data
    lists, what is hidden by an attribute or its own style (but for parts of it that are made visible again), closed details
    but for their summary, check boxes, and of drawings and formulas descriptions, definitions and
    annotations. Labels of a drawing and the parts of fractions, scripts and matrices are set apart by a blank; definitions
    that a drawing shows by ``use`` are not looked up. Fields show their value or what stands in for it. Cells may reach over
    columns and down over rows; a table's head comes first and its foot last. Lists count up or down in numbers, letters or
    Roman numerals. Text without tags is kept with its
    blanks run together; a tag that does not end is dropped with what follows. Elements may be nested to any depth; lines
    are indented by at most 300 blanks, and tables more than 50 deep in tables have a line for each cell. Repeated rows are
    rendered each; other columns are not looked at; an empty table gives no rows.
    """
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string"
    return pages.select("page_id", F.col("html").cast("string").alias("html")).mapInArrow(_extracted, schema)
