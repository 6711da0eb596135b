"""Pages to records.

One small Python step turns each page into rows of elements (`elements`); everything after it is joins,
filters and aggregations over those rows by page.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate
from operator import attrgetter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabary.functions import dates, text, urls
from syllabary.functions.text import BLOCK_TAGS
from syllabary.operators.aggregates import counter
from syllabary.session import checkpointed

# Workers get the functions themselves, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---- Fixed values: labels, names and classes of the pages -------------------------------------------
MODULE_LABELS = {
    "Modulverantwortliche": "responsible_person", "Dauer": "duration_semesters", "Leistungspunkte": "credits",
    "Startsemester": "start_semester", "Turnus": "frequency", "Ziele": "goals", "Inhalt": "content",
    "Prüfungsvorleistungen": "exam_prerequisites", "Teilnahmevoraussetzungen": "prerequisites",
    "Literaturangabe": "literature", "Anzahl Wahlkurse": "elective_course_count",
    "Teilnahmevoraussetzungen für den Wahlbereich": "elective_prerequisites",
    "Moduleinstufung im Wahlbereich": "elective_classification", "Anmerkung zur Benotung": "grading_note",
}
COURSE_LABELS = {
    "Lehrende": ("staff", "span"), "Veranstaltungsart": ("type", "div"), "Semesterwochenstunden": ("weekly_hours", "div"),
    "Unterrichtssprache": ("language", "span"), "Orga-Einheit": ("org_unit", "span"),
    "Offizielle Kursbeschreibung": ("official_description", "span"), "Organisatorisches": ("organisational", "span"),
    "Literatur": ("literature", "span"),
}
ROOM_LABELS = {
    "Name": "name", "Externe Kennung": "external_id", "Beschreibung": "description", "Raumtyp": "type",
    "Plätze": "seats", "Größe (qm)": "size", "Barrierefrei": "accessibility",
}
BUILDING_LABELS = {"Name": "name", "Kürzel": "short_name", "Adresse": "address"}
LABEL_CLASSES = {"font-semibold", "break-all"}
MOBILE_LABEL = "lg:hidden"
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
KEPT = frozenset(("h1", "a", "td", "th", "tr", "table", "span", "div", "b", "dt", "dd"))
# ------------------------------------------------------------------------------------------------------

ELEMENT_DDL = """page_id string, node int, parent int, tag string, name string, classes array<string>, href string,
    area array<string>, tbl int, tr int, td int, pos int, box int, label string, section string, heading string,
    summary string, direct boolean, text string, flat string, glued string, pieces string, n_lines int, cell_values array<string>"""
_TYPES = {part.split()[0]: part.split()[1] for part in ELEMENT_DDL.replace("\n", " ").split(",")}
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_SPACE = re.compile(r"\s+")

Span = tuple[int, int]  # of words


class _Buffers:
    """The text of a page, written once: what an element says is a slice of it, given by where it starts and ends."""

    def __init__(self, lines: bool = True) -> None:
        self.lined = lines  # whether anybody asks for the text with its line feeds
        self.words: list[str] = []  # pieces of text without the white space around them
        self.lines: list[str] = []  # squeezed text, a break being a line feed and other white space a blank
        self.length = self.gap = 0  # of ``lines``; white space that waits for what follows: 1 a blank, 2 a break

    def put(self, piece: str) -> None:
        """Text for the lines."""
        if "\n" not in piece:  # nearly all of them
            if words := piece.split():
                self._line(" ".join(words), int(piece[0].isspace()), int(piece[-1].isspace()))
            elif piece and not self.gap:
                self.gap = 1
            return
        core = piece.strip()
        if not core:
            self.gap = 2
            return
        head, tail = piece[: len(piece) - len(piece.lstrip())], piece[len(piece.rstrip()) :]
        squeezed = "\n".join(filter(None, (" ".join(line.split()) for line in core.split("\n"))))
        self._line(squeezed, 2 if "\n" in head else int(head != ""), 2 if "\n" in tail else int(tail != ""))

    def _line(self, squeezed: str, ahead: int, behind: int) -> None:
        if gap := max(self.gap, ahead):
            squeezed = "\n "[2 - gap] + squeezed
        self.lines.append(squeezed)
        self.length += len(squeezed)
        self.gap = behind

    def tag(self, block: bool) -> None:
        """What a tag that opens puts between the texts around it."""
        if block:
            self.gap = 2
        elif not self.gap:
            self.gap = 1

    def text(self, data: str) -> None:
        if word := data.strip():
            self.words.append(word)
        if self.lined:
            self.put(data)

    def seal(self) -> None:
        """Join the buffers and note where each word starts in them."""
        self.whole, self.flat, self.glued = "".join(self.lines), " ".join(self.words), "".join(self.words)
        self.at = [0, *accumulate(map(len, self.words))]
        lines = (sum(1 for x in word.split("\n") if x.strip()) if "\n" in word else 1 for word in self.words)
        self.line_at = [0, *accumulate(lines)] if "\n" in self.flat else range(len(self.words) + 1)

    def flat_of(self, span: Span) -> str:
        start, end = span
        return self.flat[self.at[start] + start : self.at[end] + end - 1] if end > start else ""

    def glued_of(self, span: Span) -> str:
        return self.glued[self.at[span[0]] : self.at[span[1]]]

    def pieces_of(self, span: Span) -> str:
        """The pieces one below the other, where ``flat_of`` has them side by side."""
        return "\n".join(self.words[span[0] : span[1]])

    def n_lines(self, span: Span) -> int:
        return self.line_at[span[1]] - self.line_at[span[0]]


# What stands between < and > in the tags of nearly all pages.
_TAG = re.compile(r"""/([a-z][a-z0-9]*)|([a-z][a-z0-9]*)((?:[ \t\r\n]+[a-z][a-z0-9:_-]*="[^"<>]*")*)[ \t\r\n]*(/?)""")
_ATTRIBUTE = re.compile(r'([a-z][a-z0-9:_-]*)="([^"]*)"')
#: Elements whose content a parser reads in another way.
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "svg", "math"))
#: Tags as they are written, and what they say; emptied when full.
_SEEN: dict[str, _Tag] = {}
_MOST_SEEN = 4096


class _Tag:
    """What a tag says by itself: an end tag has only ``end``, a start tag all else."""

    __slots__ = ("end", "tag", "closed", "void", "kept", "block", "classes", "name", "href", "summary", "id", "box", "changes", "plain", "outer", "labels", "bold")

    def __init__(self, tag: str, attrs: dict[str, str], closed: bool = False, end: str | None = None) -> None:
        self.end, self.tag, self.void = end, tag, tag in VOID
        self.closed = closed and not self.void
        self.kept, self.block = tag in KEPT, tag in BLOCK_TAGS
        self.classes = attrs["class"].split() if "class" in attrs else []
        self.name, self.href, self.summary, self.id = attrs.get("name"), attrs.get("href"), attrs.get("summary"), attrs.get("id")
        self.box = "tbdata" in self.classes
        self.outer = tag == "span" and MOBILE_LABEL not in self.classes
        self.labels = len(self.classes) > 1 and LABEL_CLASSES.issubset(self.classes)
        self.bold = tag == "div" and "font-bold" in self.classes
        #: Whether what is around an element ends at it, and whether it is none of those that may do or say more.
        self.changes = self.box or bool(self.id) or self.summary is not None or tag in ("table", "tr", "td", "th")
        self.plain = not (self.changes or tag in ("dd", "div", "span"))


def _tag(written: str) -> _Tag | None:
    """The tag that is written so; None for one that takes the whole parser to read."""
    found = _TAG.fullmatch(written)
    if found is None:
        return None
    end, tag, attributes, slash = found.groups()
    if end:
        told = _Tag("", {}, end=end)
    else:
        attrs = dict(_ATTRIBUTE.findall(attributes)) if attributes else {}
        if tag in _RAW or ("&" in attributes and any(unescape(v) != v for v in attrs.values())):
            return None
        told = _Tag(tag, attrs, bool(slash))
    if len(_SEEN) >= _MOST_SEEN:
        _SEEN.clear()
    _SEEN[written] = told
    return told


def _events(html: str) -> list[tuple[_Tag | None, str]] | None:
    """(tag, text behind it) in order, the first without a tag; None for a page that takes the whole parser to read."""
    if "\0" in html:
        return None
    pieces = html.split("<")
    out: list[tuple[_Tag | None, str]] = [(None, unescape(pieces[0]) if "&" in pieces[0] else pieces[0])]
    seen = _SEEN.get
    for piece in pieces[1:]:
        written, shut, data = piece.partition(">")
        tag = seen(written) or _tag(written)
        if tag is None or not shut:
            return None
        out.append((tag, unescape(data) if "&" in data else data))
    return out


class _Around:
    """What an element and all in it have from around them, up to the next that changes some of it."""

    __slots__ = ("area", "summary", "group", "tbl", "tr", "td", "box", "heading", "open_spans", "cell")

    def copy(self) -> _Around:
        new = _Around()
        new.area, new.summary, new.group, new.tbl, new.tr, new.td = self.area, self.summary, self.group, self.tbl, self.tr, self.td
        new.box, new.heading, new.open_spans, new.cell = self.box, self.heading, self.open_spans, self.cell
        return new


class _Open:
    """An element with what its row needs; most of it is set where it differs from these values."""

    own: _Tag
    around: _Around
    node = parent = near = label = values = pos = pending = term = section = head = page_id = None
    direct = tables = outer = divs = False
    cells = 0

    def __getitem__(self, column: str):
        return _FIELD[column](self)


def _root() -> _Open:
    """What holds the outermost elements; it takes no part itself."""
    top = _Open()
    top.own, top.around = _Tag("", {}), _Around()
    for field in _Around.__slots__:
        setattr(top.around, field, None)
    top.around.area = []
    return top


_FIELD = {
    **{c: attrgetter(c) for c in ("page_id", "node", "parent", "label", "pos", "direct")},
    **{c: attrgetter(f"own.{c}") for c in ("tag", "name", "classes", "href")},
    **{c: attrgetter(f"around.{c}") for c in ("area", "tbl", "tr", "td", "box", "summary")},
}
#: What is around the outermost elements, and what takes what these tell to those behind them, which is nothing.
_NOTHING, _NOBODY = _root(), _root()


class _Elements(HTMLParser):
    """Open elements with what their rows need; an element closes with the spans of its text."""

    def __init__(self, lines: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.buffers = _Buffers(lines)
        self.open: dict[str, int] = {}  # open elements by tag
        self.rows: list[_Open] = []
        self.count = 0

    def read(self, html: str) -> list[_Open]:
        """The rows of a whole page, which is cut at once where its tags are plain, and fed to the parser otherwise."""
        events = _events(html)
        if events is None:
            self.feed(html)
            return self.finish()
        lined, words, text = self.buffers.lined, self.buffers.words, self.buffers.text
        start, shut = self._start, self.handle_endtag
        for tag, data in events:
            if tag is not None:
                if tag.end is not None:
                    shut(tag.end)
                else:
                    start(tag)
                    if tag.closed:
                        shut(tag.tag)
            if data:
                if lined:
                    text(data)
                elif word := data.strip():
                    words.append(word)
        return self._rest()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._start(_Tag(tag, {k: v or "" for k, v in attrs}))

    def _start(self, own: _Tag) -> None:
        buffers, stack, tag = self.buffers, self.stack, own.tag
        if buffers.lined:
            buffers.tag(own.block)
        up = stack[-1] if stack else _NOTHING
        e = _Open()
        e.own, e.parent = own, up.node
        e.node = node = self.count
        self.count = node + 1
        e.start, e.begin = len(buffers.words), buffers.length
        # The heading of the nearest section, for the tables in it.
        e.near = up.near if up.head is None else up.head
        e.around = around = up.around
        if not own.plain:
            if own.changes or (tag == "div" and up.own.tag == "dl") or (own.outer and around.open_spans is not None):
                e.around = around = around.copy()
            if own.box:
                around.box = node
            if own.summary is not None:
                around.summary = own.summary
            if own.id:
                around.area = [*around.area, own.id]
            if tag == "div":
                if up.own.tag == "dl":
                    around.group = e
                if up.pending is not None:
                    e.label, up.pending = up.pending, None
            elif tag == "span":
                if own.outer and around.open_spans is not None:
                    e.outer = around.open_spans == 0
                    around.open_spans += 1
            elif tag == "td" or tag == "th":
                around.td, around.open_spans, around.cell, e.values = node, 0, e, []
                e.direct = up.own.tag == "tr"
                if tag == "td":
                    e.pos = up.cells if e.direct else None
                    if stack:
                        up.cells += 1
            elif tag == "tr":
                around.tr = node
            elif tag == "table":
                around.tbl, around.heading = node, e.near
            elif tag == "dd":
                e.label = up.term
                e.direct = up.around.group is up and up.own.tag == "div"
        if own.void:
            return
        stack.append(e)
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        self.buffers.text(data)

    def handle_comment(self, data: str) -> None:
        if self.buffers.lined:
            self.buffers.put(data)

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            while self._close() != tag:
                pass

    def _close(self) -> str:
        e = self.stack.pop()
        own = e.own
        tag = own.tag
        self.open[tag] -= 1
        up = self.stack[-1] if self.stack else _NOBODY
        tables = e.tables or tag == "table" or tag == "dl"
        if tables:
            e.tables = up.tables = True  # told level by level, as each ancestor closes later
        if not own.kept:
            return tag
        if tag == "tr" or tag == "table" or (tables and tag == "div" and e.label is None):
            e.span, e.end = (0, 0), e.begin
        else:
            e.span, e.end = (e.start, len(self.buffers.words)), self.buffers.length
        if e.outer:
            e.around.cell.values.append(e.span)
        if tag == "div":
            group = e.around.group
            if own.bold and group is not None and group.section is None:
                group.section = e.span
            # The first plain div of a section is its heading.
            if not tables and not e.divs and up.head is None:
                up.head = e.span
            up.divs = True
        elif tag == "td" or tag == "th":
            if not e.values and e.span[1] > e.span[0]:
                e.values = [e.span]
        elif tag == "dt":
            up.term = ("term", e.span)
        if own.labels:
            up.pending = ("label", e.span)
        self.rows.append(e)
        return tag

    def finish(self) -> list[_Open]:
        self.close()
        return self._rest()

    def _rest(self) -> list[_Open]:
        while self.stack:
            self._close()
        self.buffers.seal()
        return self.rows


#: Columns that are cut out of the buffers.
CUT = frozenset(("text", "flat", "glued", "pieces", "n_lines", "label", "section", "heading", "cell_values"))


def _value(column: str, e: _Open, b: _Buffers):
    """A column of an element's row, cut out of the buffers where it is text."""
    if column == "text":
        return b.whole[e.begin : e.end].strip()
    if column == "flat":
        return b.flat_of(e.span)
    if column == "glued":
        return b.glued_of(e.span)
    if column == "pieces":
        return b.pieces_of(e.span)
    if column == "n_lines":
        return b.n_lines(e.span)
    if column == "label" and e.label is not None:
        kind, span = e.label
        label = _SPACE.sub(" ", b.flat_of(span)).strip()
        return label.rstrip(":") if kind == "label" else label
    if column == "section":
        group = e.around.group
        return None if group is None or group.section is None else b.flat_of(group.section)
    if column == "heading":
        return None if e.around.heading is None else b.flat_of(e.around.heading)
    if column == "cell_values":
        return None if e.values is None else [b.flat_of(span) for span in e.values]
    return e[column]


def _pages(columns: tuple[str, ...], tags: frozenset[str], labelled: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in columns]
        columned = [(c, values.append, None if c in CUT else _FIELD[c]) for c, values in zip(columns, out, strict=True)]

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(values, _ARROW[_TYPES[c]]) for c, values in zip(columns, out, strict=True)]
            for values in out:
                values.clear()
            return pa.record_batch(arrays, names=list(columns))

        for batch in batches:
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = _Elements("text" in columns)
                buffers = parser.buffers
                for e in parser.read(html or ""):
                    tag = e.own.tag
                    if tag not in tags or (labelled and tag == "div" and e.label is None and e.around.box is None):
                        continue
                    e.page_id = page_id
                    for c, add, field in columned:
                        add(_value(c, e, buffers) if field is None else field(e))
                if len(out[0]) > 20_000:
                    yield flush()
        if out[0]:
            yield flush()

    return run


def elements(pages: DataFrame, *uses: Callable) -> DataFrame:
    """Rows of the elements of each page (page_id, url, html), in document order by ``node``.

    ``uses`` are the functions that will read them, by their names in ``NEEDS``: then only the tags and columns that these need are cut out
    and sent to the JVM. Reading is linear in the page; what is sent is as long as the texts that are asked for.
    """
    needs = [NEEDS[u.__name__] for u in uses]
    tags = frozenset(t for own, _ in needs for t in own) or frozenset(KEPT)
    wanted = {c for _, own in needs for c in own} | {"page_id", "node", "tag"}
    columns = tuple(c for c in _TYPES if not needs or c in wanted)
    slim = pages.select(F.col("page_id").cast("string").alias("page_id"), "html")
    return slim.mapInArrow(_pages(columns, tags, bool(needs)), ", ".join(f"{c} {_TYPES[c]}" for c in columns))


def _cell(separator: str = " ") -> Column:
    return text.squeeze(F.array_join("cell_values", separator))


def _has_class(name: str) -> Column:
    return F.array_contains("classes", name)


# ---- headers, labels, links --------------------------------------------------------------------------


def headers(els: DataFrame) -> DataFrame:
    """(page_id, header, number, name, malformed) of the first heading of each page that has one."""
    first = els.where("tag = 'h1'").groupBy("page_id").agg(F.min_by("glued", "node").alias("header"))
    parts = text.split_header(F.col("header"))
    return first.select(
        "page_id", "header", parts["number"].alias("number"), parts["name"].alias("name"),
        (parts["name"] == "").alias("malformed"),
    )


def module_labels(els: DataFrame) -> DataFrame:
    """(page_id, node, label, value, …) of label and value pairs in the left column, with those renderings of the value that ``els`` has."""
    inside = els.where(F.array_contains("area", "contentlayoutleft"))
    told = {"text": "value", "flat": "flat", "glued": "glued", "pieces": "pieces", "n_lines": "n_lines"}
    return inside.where("tag = 'div' and label is not null").select(
        "page_id", "node", "label", *[F.col(c).alias(name) for c, name in told.items() if c in els.columns]
    )


def course_labels(els: DataFrame) -> DataFrame:
    """(page_id, node, label, span, div) of the label rows of course pages."""
    inside = els.where(F.array_contains("area", "contentlayoutleft") & F.col("box").isNotNull())
    rows = inside.groupBy("page_id", "box").agg(
        F.min_by("flat", F.when((F.col("tag") == "b") & (F.col("parent") == F.col("box")), F.col("node"))).alias("label"),
        F.min_by("text", F.when((F.col("tag") == "span"), F.col("node"))).alias("span"),
        F.min_by("text", F.when((F.col("tag") == "div") & (F.col("node") != F.col("box")), F.col("node"))).alias("div"),
    )
    return rows.where("label is not null").select("page_id", F.col("box").alias("node"), _course_label(F.col("label")).alias("label"), "span", "div")


def _course_label(label: Column) -> Column:
    return F.when(label.isNotNull(), F.regexp_replace(text.single_line(label), ":+$", ""))


def _last_field(label: str, tag: str, told: Column, node: str = "box") -> Column:
    return F.max_by(tag, F.when(told & (F.col("label") == label) & F.col(tag).isNotNull(), F.col(node)))


def _course_headers_and_fields(els: DataFrame) -> DataFrame:
    """`headers` of each page with its `course_fields`, '' where it has none, in one reading of the pages."""
    inside = F.coalesce(F.array_contains("area", "contentlayoutleft") & F.col("box").isNotNull(), F.lit(False))
    node, tag, top = F.col("node"), F.col("tag"), F.col("tag") == "h1"

    def first(value: Column, where: Column) -> Column:
        return F.min_by(value, F.when(where, node))

    rows = els.where(top | inside).groupBy("page_id", F.when(inside, F.col("box")).alias("box")).agg(
        F.min(F.when(top, node)).alias("top"), first(F.col("glued"), top).alias("header"),
        first(F.col("flat"), (tag == "b") & (F.col("parent") == F.col("box"))).alias("label"),
        first(F.col("text"), tag == "span").alias("span"), first(F.col("text"), (tag == "div") & (node != F.col("box"))).alias("div"),
    )
    rows = rows.withColumn("label", _course_label(F.col("label")))
    # Pages without a key are not told apart, so no label belongs to them.
    told = F.col("box").isNotNull() & F.col("label").isNotNull() & F.col("page_id").isNotNull()
    wanted = [F.coalesce(_last_field(label, tag, told), F.lit("")).alias(field) for label, (field, tag) in COURSE_LABELS.items()]
    found = rows.groupBy("page_id").agg(F.min_by("header", "top").alias("header"), *wanted).where("header is not null")
    parts = text.split_header(F.col("header"))
    return found.withColumns({"number": parts["number"], "name": parts["name"]})


def unknown_labels(labels: DataFrame, known: dict) -> DataFrame:
    """Reject rows for labels the extraction does not know."""
    rows = labels.where((F.col("label") != "") & ~F.col("label").isin(list(known)))
    context = F.create_map(F.lit("label"), F.col("label"), F.lit("page_id"), F.col("page_id"))
    return rows.select(F.lit("unknown_label").alias("kind"), F.col("label").alias("message"), context.alias("context"))


def module_fields(els: DataFrame) -> DataFrame:
    """One row per page with a column per known label; of repeated labels the last one counts."""
    last = last_labels(module_labels(els), "value")
    return last.select("page_id", *[F.coalesce(F.col(field)["value"], F.lit("")).alias(field) for field in MODULE_LABELS.values()])


def last_labels(labels: DataFrame, *columns: str) -> DataFrame:
    """One row per page with these columns of the last label of each known name, as a struct under the name of its field."""
    wanted = [F.max_by(F.struct(*columns), F.when(F.col("label") == label, F.col("node"))).alias(field) for label, field in MODULE_LABELS.items()]
    return labels.groupBy("page_id").agg(*wanted)


def course_fields(els: DataFrame) -> DataFrame:
    labels = course_labels(els)
    wanted = [
        F.coalesce(_last_field(label, tag, F.lit(True), "node"), F.lit("")).alias(field)
        for label, (field, tag) in COURSE_LABELS.items()
    ]
    return labels.groupBy("page_id").agg(*wanted)


def links(els: DataFrame, name: str | None = None, containing: str | None = None) -> DataFrame:
    """(page_id, href, text, first): the different link targets of each page, placed by first occurrence."""
    anchors = els.where("tag = 'a' and href is not null")
    if name is not None:
        anchors = anchors.where(F.col("name") == name)
    if containing is not None:
        anchors = anchors.where(F.col("href").contains(containing))
    return anchors.groupBy("page_id", "href").agg(F.min_by("flat", "node").alias("text"), F.min("node").alias("first"))


def course_links(els: DataFrame) -> DataFrame:
    return links(els, name="eventLink", containing="COURSEDETAILS")


def kinds(pages: DataFrame) -> DataFrame:
    """(kind, n): pages by the kind in their address."""
    return counter(pages.withColumn("kind", F.coalesce(urls.page_kind(F.col("url")), F.lit("UNKNOWN"))), "kind")


# ---- table rows --------------------------------------------------------------------------------------


def _named(name: str, value: Column) -> Column:
    return F.max_by(value, F.when(F.col("name") == name, F.col("node")))


def _classed(name: str, value: Column) -> Column:
    return F.min_by(value, F.when(_has_class(name), F.col("node")))


def _placed(pos: int, value: Column) -> Column:
    return F.min_by(value, F.when(F.col("pos") == pos, F.col("node")))


def _cells(els: DataFrame, **values: Column) -> DataFrame:
    """Cells of table rows, with ``values`` made once a cell, however many aggregates name them."""
    return els.where("tag = 'td' and direct and tr is not null").withColumns(values)


def sessions(els: DataFrame) -> DataFrame:
    """Session rows: number, date, times, rooms and staff, by cell names or else by position.

    ``room`` is the first of ``rooms``, '' if there is none.
    """
    values, room, one, listed = F.col("cell_values"), F.col("_room"), F.col("_one"), F.col("_listed")
    first = F.coalesce(text.squeeze(F.get(values, 0)), F.lit(""))
    cells = _cells(els, _room=first, _one=_cell(), _listed=_cell(", "))
    names = {"date": "appointmentDate", "start": "appointmentTimeFrom", "end": "appointmentDateTo"}
    rows = cells.groupBy("page_id", "tr").agg(
        *[_named(n, one).alias(f"n_{k}") for k, n in names.items()],
        _named("appointmentInstructors", listed).alias("n_staff"),
        _classed("rw-course-room", room).alias("n_room"),
        _classed("rw-course-room", values).alias("n_rooms"),
        _placed(0, one).alias("p0"), _placed(1, one).alias("p1"), _placed(2, one).alias("p2"),
        _placed(3, one).alias("p3"), _placed(4, room).alias("p4"), _placed(5, listed).alias("p5"),
        _placed(4, values).alias("p_rooms"), F.max("heading").alias("heading"), F.count(F.lit(1)).alias("n_cells"),
        F.max((F.col("name") == "appointmentDate").cast("int")).alias("has_date"),
    )
    semantic = F.col("n_date").isNotNull() & F.col("n_start").isNotNull() & F.col("n_end").isNotNull() & F.col("n_staff").isNotNull()
    positional = (F.col("heading") == "Termine") & (F.col("n_cells") >= 6)
    rows = rows.withColumn("semantic", semantic).where(F.col("semantic") | positional)

    def choose(named: str, placed: str) -> Column:
        return F.when(F.col("semantic"), F.col(named)).otherwise(F.col(placed))

    date_text, start_text, end_text = choose("n_date", "p1"), choose("n_start", "p2"), choose("n_end", "p3")
    all_rooms = F.coalesce(choose("n_rooms", "p_rooms"), F.array().cast("array<string>"))
    return rows.select(
        "page_id", "tr", F.col("p0").alias("number"), date_text.alias("date_text"), start_text.alias("start_text"),
        end_text.alias("end_text"), dates.german_date(date_text).alias("event_date"),
        dates.clock_minutes(start_text).alias("start_min"), dates.clock_minutes(end_text).alias("end_min"),
        F.coalesce(choose("n_room", "p4"), F.lit("")).alias("room"),
        text.clean_staff(choose("n_staff", "p5")).alias("staff"),
        F.filter(F.transform(all_rooms, text.squeeze), lambda x: x != "").alias("rooms"), F.size(all_rooms).alias("n_rooms"),
    )


def exams(els: DataFrame) -> DataFrame:
    """Exam rows by cell class or else by position under the exams heading."""
    one, listed = F.col("_one"), F.col("_listed")
    rows = _cells(els, _one=_cell(), _listed=_cell(", ")).groupBy("page_id", "tr").agg(
        _classed("rw-detail-exam", one).alias("c_name"), _classed("rw-detail-date", one).alias("c_date"),
        _classed("rw-detail-instructors", listed).alias("c_staff"), _classed("rw-detail-compulsory", one).alias("c_required"),
        _placed(0, one).alias("p0"), _placed(1, one).alias("p1"), _placed(2, listed).alias("p2"),
        _placed(3, one).alias("p3"), F.max("heading").alias("heading"), F.count(F.lit(1)).alias("n_cells"),
    )
    rows = rows.where(F.col("heading") == "Modulabschlussprüfungen")
    semantic = F.col("c_name").isNotNull() & F.col("c_date").isNotNull() & F.col("c_staff").isNotNull() & F.col("c_required").isNotNull()
    rows = rows.withColumn("semantic", semantic).where(F.col("semantic") | (F.col("n_cells") >= 4))

    def choose(classed: str, placed: str) -> Column:
        return F.when(F.col("semantic"), F.col(classed)).otherwise(F.col(placed))

    slot_text = choose("c_date", "p1")
    slot = dates.exam_slot(slot_text)
    return rows.select(
        "page_id", "tr", choose("c_name", "p0").alias("name"), slot_text.alias("date_text"),
        slot["exam_date"].alias("date"), slot["start_min"].alias("start_min"), slot["end_min"].alias("end_min"),
        text.clean_staff(choose("c_staff", "p2")).alias("staff"), (choose("c_required", "p3") == "Ja").alias("required"),
    )


def achievements(els: DataFrame) -> DataFrame:
    one = F.col("_one")
    rows = _cells(els.where("summary = 'Leistungen'"), _one=_cell()).groupBy("page_id", "tr").agg(
        _classed("rw-detail-reqachieve", one).alias("name"),
        F.coalesce(_classed("rw-detail-compulsory", one), F.lit("")).alias("combination"),
        F.coalesce(_classed("rw-detail-weight", one), F.lit("")).alias("weight_text"),
    )
    weight = F.when(F.col("weight_text") != "", text.parse_float(F.col("weight_text")))
    return rows.where("name <> ''").select(
        "page_id", "tr", "name", (F.col("combination") == "Ja").alias("required"), weight.alias("weight"), "combination"
    )


def rooms(els: DataFrame) -> DataFrame:
    """Room and building of each room page."""
    terms = els.where("tag = 'dd' and label is not null")

    def last(label: str, where: Column) -> Column:
        hit = where & (F.col("label") == label)
        return F.coalesce(F.max_by("text", F.when(hit, F.col("node"))), F.lit(""))

    direct = F.col("direct")
    building = F.coalesce(F.col("section").contains("Gebäude"), F.lit(False))
    rows = terms.groupBy("page_id").agg(
        *[last(label, direct).alias(f"r_{field}") for label, field in ROOM_LABELS.items()],
        *[last(label, building).alias(f"b_{field}") for label, field in BUILDING_LABELS.items()],
    )
    return rows.select(
        "page_id", F.col("r_name").alias("name"), F.col("r_external_id").alias("external_id"),
        F.col("r_description").alias("description"), F.col("r_type").alias("type"),
        text.parse_int(F.col("r_seats"), None).alias("seats"), text.parse_float(F.col("r_size"), None).alias("size"),
        F.col("r_accessibility").alias("accessibility"),
        F.struct(
            F.col("b_name").alias("name"), F.col("b_short_name").alias("short_name"),
            F.replace("b_address", F.lit("\n"), F.lit(", ")).alias("address"),
        ).alias("building"),
    )


def room_index(room_rows: DataFrame, known: DataFrame) -> DataFrame:
    """(page_id, key) for room pages that are not yet found under the key of their room name."""
    keyed = room_rows.where("name <> ''").select("page_id", text.room_key(F.col("name")).alias("key"))
    fresh = keyed.groupBy("key").agg(F.min("page_id").alias("page_id"))
    return fresh.join(known.select(F.col("key").alias("_k")).distinct(), F.col("key") == F.col("_k"), "left_anti")


def course_exams(els: DataFrame) -> DataFrame:
    """Rows of the exam table that course pages carry themselves."""
    rows = _cells(els).groupBy("page_id", "tr").agg(
        F.coalesce(_named("examName", text.squeeze(F.col("flat"))), F.lit("")).alias("name"),
        _named("examDate", text.squeeze(F.col("flat"))).alias("date_text"),
    )
    return rows.where("date_text is not null").withColumn("date_text", F.regexp_replace("date_text", r"^Datum\s+", ""))


# ---- whole records -----------------------------------------------------------------------------------


def module_rows(els: DataFrame) -> DataFrame:
    """One flat row per module page, typed as the load expects it (without courses, exams, achievements)."""
    els = checkpointed(els.where("tag = 'h1' or label is not null"))  # pages are read once
    joined = headers(els).join(module_fields(els), "page_id", "left")
    blank = {f: F.coalesce(F.col(f), F.lit("")) for f in MODULE_LABELS.values()}
    joined = joined.withColumns(blank)
    return joined.select(
        "page_id", "number", "name", "responsible_person",
        text.parse_int(F.col("duration_semesters")).alias("duration_semesters"),
        text.parse_float(F.col("credits")).alias("credits"), "start_semester", "frequency", "goals", "content",
        "exam_prerequisites", text.parse_requirements(F.col("prerequisites")).alias("prerequisites"), "literature",
        text.parse_int(F.col("elective_course_count")).alias("elective_course_count"), "elective_prerequisites",
        "elective_classification", "grading_note",
    )


def course_rows(els: DataFrame) -> DataFrame:
    joined = _course_headers_and_fields(els)
    hours = F.when(F.col("weekly_hours").rlike(r"^\d+$"), F.col("weekly_hours").try_cast("int"))
    return joined.select(
        "page_id", "number", "name", text.clean_staff(F.col("staff")).alias("staff"), "type",
        F.coalesce(hours, F.lit(0)).alias("weekly_hours"), "language", "org_unit", "official_description",
        "organisational", "literature",
    )


_CELLS = ("name", "classes", "tr", "pos", "direct", "cell_values")
#: Tags and columns that a function reads, of this module or of the scans, besides page_id, node and tag.
NEEDS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "headers": (("h1",), ("glued",)),
    "module_labels": (("div",), ("area", "label", "text", "flat", "glued", "n_lines")),
    "course_labels": (("div", "span", "b"), ("area", "box", "parent", "text", "flat")),
    "links": (("a",), ("name", "href", "flat")),
    "course_links": (("a",), ("name", "href", "flat")),
    "unknown_labels": (("div",), ("area", "label")),
    "label_frequencies": (("div",), ("area", "label", "text")),
    "separator_verdicts": (("div",), ("area", "label", "text", "flat", "glued", "n_lines")),
    "prerequisite_loss": (("div",), ("area", "label", "text", "pieces")),
    "module_capture": (("div", "td", "tr"), (*_CELLS, "area", "label", "text", "flat", "heading", "summary", "tbl")),
    "sessions": (("td",), (*_CELLS, "heading")),
    "exams": (("td",), (*_CELLS, "heading")),
    "achievements": (("td",), (*_CELLS, "summary")),
    "course_exams": (("td",), ("name", "tr", "direct", "flat")),
    "rooms": (("dd",), ("label", "direct", "section", "text")),
    "module_rows": (("h1", "div"), ("area", "label", "text", "glued")),
    "course_rows": (("h1", "div", "span", "b"), ("area", "box", "parent", "text", "flat", "glued")),
    "room_cells": (("td", "a"), ("name", "classes", "td", "flat")),
    "impossible_times": (("td",), ("name", "classes", "flat")),
    "anomalies": (("h1", "td"), ("name", "classes", "flat", "glued", "cell_values")),
    "table_shapes": (("td",), ("classes", "tbl", "heading")),
}
