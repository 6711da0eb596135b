"""Text: whitespace, numbers, names, templates."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entries of a staff cell that name nobody.
NON_STAFF = ("k.Terminbuchung", "ohne Termin")
# A bare time (range) or a bare date in a staff cell.
TIME_ONLY = r"^\d{1,2}:\d{2}(?:\s*[-–]\s*\d{1,2}:\d{2})?$"
DATE_ONLY = r"^(?:[A-Za-zÄÖÜäöü]{2},?\s*)?\d{1,2}\.\s*[A-Za-zÄÖÜäöü]{3}\.?\s*\d{2,4}$"
# Fixed value: key of requirement lines that name no context.
GENERAL_KEY = "allgemein"

# Java's \s is ASCII only unless told otherwise.
_SPACES = r"(?U)\s+"


def is_blank(c: Column) -> Column:
    """The one "is empty" test: NULL or ''."""
    return F.coalesce(c == "", F.lit(True))


def squeeze(c: Column) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def single_line(c: Column) -> Column:
    """`squeeze` with NBSP read as a space and NULL as ''."""
    return squeeze(F.translate(F.coalesce(c, F.lit("")), "\u00a0", " "))


def fold_case(c: Column) -> Column:
    """Caseless form; lower() alone keeps the sharp s."""
    return F.regexp_replace(F.lower(c), "ß", "ss")


def parse_int(c: Column, default: int | None = 0) -> Column:
    number = F.regexp_extract(c, r"-?\d+", 0).try_cast("int")
    return number if default is None else F.coalesce(number, F.lit(default))


def parse_float(c: Column, default: float | None = 0.0) -> Column:
    plain = F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), ",", ".")
    number = F.regexp_extract(plain, r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    return number if default is None else F.coalesce(number, F.lit(default))


def split_header(c: Column) -> Column:
    """``"number name"`` as a struct; a header of one token has the name ''."""
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    parts = F.split(trimmed, _SPACES, 2)
    return F.struct(
        F.get(parts, 0).alias("number"),
        F.coalesce(F.get(parts, 1), F.lit("")).alias("name"),
    )


def split_people(c: Column) -> Column:
    """Names separated by ; or , without blanks."""
    return F.filter(F.transform(F.split(c, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def clean_staff(c: Column) -> Column:
    """Names of a staff cell: no placeholders, times or dates, each once, in order."""
    names = F.transform(F.split(c, "[,;]"), squeeze)
    kept = F.filter(
        names,
        lambda x: (x != "") & ~x.isin(*NON_STAFF) & ~x.rlike("(?U)" + TIME_ONLY) & ~x.rlike("(?U)" + DATE_ONLY),
    )
    return F.array_distinct(kept)


def normalise_name(c: Column) -> Column:
    """Lower case without the leading number token (one holding a hyphen and a digit)."""
    lowered = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    dropped = F.regexp_replace(lowered, r"(?U)^(?=\S*-)(?=\S*\d)\S+\s+(?=\S)", "")
    return squeeze(dropped)


def leading_number(c: Column) -> Column:
    """The leading token where it looks like a number of the catalogue, else NULL."""
    token = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?U)^\s*(\S+)", 1)
    return F.when(token.contains("-") & token.rlike(r"(?U)\d"), token)


def room_key(c: Column) -> Column:
    """Digest under which the detail page of a room is found by its display name."""
    return F.sha1(F.lower(squeeze(F.coalesce(c, F.lit("")))))


def join_names(names: Column, separator: str) -> Column:
    return F.array_join(F.filter(names, lambda x: ~is_blank(x)), separator)


def template(text: str, column: Callable[[str], Column | None]) -> Column:
    """Compile ``{field}`` placeholders to one concat; unknown fields and NULLs give ''."""
    pieces: list[Column] = []
    for literal, name in re.findall(r"([^{]*)(?:\{(\w*)\})?", text):
        if literal:
            pieces.append(F.lit(literal))
        found = column(name) if name else None
        if found is not None:
            pieces.append(F.coalesce(found.cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def parse_requirements(c: Column) -> Column:
    """Lines ``context: text`` as a map.

    A line is cut at its first colon outside parentheses. Texts of a repeated context are joined by a
    space, lines without a context are kept together under a general key.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\r\n]+"), _strip), lambda x: x != "")
    return _once(F.transform(lines, _cut_requirement), _requirement_map)


def _requirement_map(cut: Column) -> Column:
    keyed = F.filter(cut, lambda p: p["key"].isNotNull())
    general = F.transform(F.filter(cut, lambda p: p["key"].isNull()), lambda p: p["text"])
    return _once(F.struct(keyed.alias("keyed"), general.alias("general")), _joined_requirements)


def _joined_requirements(parts: Column) -> Column:
    keyed, general = parts["keyed"], parts["general"]
    keys = F.array_distinct(F.transform(keyed, lambda p: p["key"]))

    def texts_of(key: Column) -> Column:
        return F.array_join(F.transform(F.filter(keyed, lambda p: p["key"] == key), lambda p: p["text"]), " ")

    named = F.map_from_arrays(keys, F.transform(keys, texts_of))
    rest = F.when(
        F.size(general) > 0, F.create_map(F.lit(GENERAL_KEY), F.array_join(general, " "))
    ).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))
    # A general text replaces a context that happens to have the general key.
    return F.map_concat(F.map_filter(named, lambda k, v: (k != GENERAL_KEY) | (F.size(general) == 0)), rest)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is bound as the item of a list, so that it is computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _cut_requirement(line: Column) -> Column:
    def parts(at: Column) -> Column:
        key = _strip(F.substring(line, F.lit(1), at - 1))
        text = _strip(F.substring(line, at + 1, F.length(line)))
        return F.struct(at.alias("at"), key.alias("key"), text.alias("text"))

    def chosen(p: Column) -> Column:
        ok = (p["at"] > 0) & (p["key"] != "") & (p["text"] != "")
        return F.struct(F.when(ok, p["key"]).alias("key"), F.when(ok, p["text"]).otherwise(line).alias("text"))

    return _once(_once(_top_level_colon(line), parts), chosen)


def _top_level_colon(line: Column) -> Column:
    """1-based position of the first colon outside parentheses at any depth, 0 for none."""
    flat = ~line.rlike(r"[()]")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(0).alias("at"))

    def step(acc: Column, ch: Column) -> Column:
        depth = (
            F.when(ch == "(", acc["depth"] + 1)
            .when(ch == ")", F.greatest(acc["depth"] - 1, F.lit(0)))
            .otherwise(acc["depth"])
        )
        here = (acc["at"] == 0) & (ch == ":") & (acc["depth"] == 0)
        return F.struct(
            (acc["i"] + 1).alias("i"), depth.alias("depth"), F.when(here, acc["i"] + 1).otherwise(acc["at"]).alias("at")
        )

    return F.when(flat, F.instr(line, ":")).otherwise(F.aggregate(F.split(line, ""), start, step)["at"])


# Tags that start a line.
BLOCK_TAGS = ("br", "div", "p", "li", "ul", "ol", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table")


def html_lines(c: Column) -> Column:
    """Markup to text: an opening block tag starts a line, an opening inline tag is a space.

    Closing tags add nothing, comments count as text. Lines are squeezed and blank ones dropped.
    """
    block = "|".join(BLOCK_TAGS)
    text = F.regexp_replace(c, r"(?s)<!--(.*?)-->", "$1")
    text = F.regexp_replace(text, rf"(?i)<(?:{block})(?:\s[^>]*)?/?>", "\n")
    text = F.regexp_replace(text, r"<[a-zA-Z][^>]*>", " ")
    text = _entities(F.regexp_replace(text, r"</[^>]*>", ""))
    lines = F.transform(F.split(F.translate(text, "\u00a0", " "), "\n"), squeeze)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


# The five XML entities and the non-breaking space.
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _entities(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def any_of(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out | condition
    return out
