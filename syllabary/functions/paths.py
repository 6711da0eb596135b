"""Navigation paths: arrays of node arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEMESTER_NODE = r"(?i)^(SoSe|WiSe)\s*\d"


def parse_paths(c: Column) -> Column:
    """Paths from JSON text, nested or (older rows) flat; empty groups are dropped."""
    nested = F.from_json(c, "array<array<string>>")
    flat = F.from_json(c, "array<string>")
    paths = F.coalesce(nested, F.when(F.size(flat) > 0, F.array(flat)))
    return drop_empty(paths)


def drop_empty(paths: Column) -> Column:
    return F.filter(F.coalesce(paths, F.expr("cast(array() as array<array<string>>)")), lambda p: F.size(p) > 0)


def is_flat(c: Column) -> Column:
    """JSON text whose first element is itself text."""
    return F.coalesce(F.get_json_object(c, "$[0]").isNotNull() & F.get_json_object(c, "$[0][0]").isNull(), F.lit(False))


def has_segment(path: Column, segment: str) -> Column:
    return F.array_contains(path, segment)


def has_prefix(path: Column, prefix: str) -> Column | None:
    """The path starts with the ``a/b/c`` segments; blank segments do not count."""
    wanted = [s.strip() for s in prefix.split("/") if s.strip()]
    if not wanted:
        return None
    return F.slice(path, 1, len(wanted)) == F.array(*[F.lit(s) for s in wanted])


def any_has_segment(paths: Column, segment: str) -> Column:
    return F.exists(paths, lambda p: has_segment(p, segment))


def any_has_prefix(paths: Column, prefix: str) -> Column | None:
    if has_prefix(paths, prefix) is None:
        return None
    return F.exists(paths, lambda p: has_prefix(p, prefix))


def semester_nodes(paths: Column) -> Column:
    """Semester nodes of all paths, each once, in order."""
    return F.array_distinct(F.filter(F.flatten(paths), lambda x: x.rlike(_SEMESTER_NODE)))


def term_nodes(paths: Column) -> Column:
    """Nodes that name a term, for the load: they start with it and hold a year, whatever stands between; each once, in order."""
    # The plain comparison comes first, as most nodes fail it.
    starts = F.filter(F.flatten(paths), lambda x: x.startswith("SoSe") | x.startswith("WiSe"))
    named = F.filter(starts, lambda x: x.rlike(r"^(SoSe|WiSe)(?s:.*)\d{2}"))
    return F.array_distinct(named)


def contains_text(paths: Column, text: str) -> Column:
    return F.exists(F.flatten(paths), lambda x: F.lower(x).contains(text.lower()))


def number_prefix(number: Column) -> Column:
    """Faculty digits at the start of a number, e.g. 10 in ``A10-…``."""
    return F.regexp_extract(number, r"^A?(\d{2})", 1).try_cast("int")


def faculty_digits(node: Column) -> Column:
    """As `node_prefix`, for derived degrees, where blanks around the dash are free: 6 in ``06-…``."""
    return F.regexp_extract(node, r"^\s*A?(\d{2})\s*-\s*", 1).try_cast("int")


def node_prefix(node: Column) -> Column:
    """Faculty digits of a path node, e.g. 6 in ``06 - …``."""
    return F.regexp_extract(node, r"^A?(\d{2}) - ", 1).try_cast("int")
