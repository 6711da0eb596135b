"""Predicates of list queries.

Each takes a column and the values of one parameter and returns a Column, or None where the parameter
is unset. Values of one parameter are OR-ed, parameters are AND-ed by `where_all`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabary.functions import dates
from syllabary.functions.text import any_of

Predicate = Column | None


def where_all(df: DataFrame, predicates: Iterable[Predicate]) -> DataFrame:
    for predicate in predicates:
        if predicate is not None:
            df = df.where(predicate)
    return df


def as_list(values) -> list:
    if values is None:
        return []
    if isinstance(values, (list, tuple, set, frozenset)):
        return list(values)
    return [values]


def is_in(c: Column, values) -> Predicate:
    wanted = as_list(values)
    return c.isin(wanted) if wanted else None


def contains_any(c: Column, values) -> Predicate:
    """Case-insensitive substring of any value; % and _ of the user stay wildcards, backslash is plain."""
    wanted = [str(v).replace("\\", "\\\\") for v in as_list(values)]
    return any_of([c.ilike(f"%{v}%") for v in wanted]) if wanted else None


def at_least(c: Column, bound) -> Predicate:
    return None if bound is None else c >= F.lit(bound)


def at_most(c: Column, bound) -> Predicate:
    return None if bound is None else c <= F.lit(bound)


def known_at_least(c: Column, bound) -> Predicate:
    return None if bound is None else c.isNotNull() & (c >= F.lit(bound))


def known_at_most(c: Column, bound) -> Predicate:
    return None if bound is None else c.isNotNull() & (c <= F.lit(bound))


def is_flag(c: Column, value: bool | None) -> Predicate:
    return None if value is None else c == F.lit(value)


def date_in(c: Column, values) -> Predicate:
    return is_in(c, [dates.parse_day(v) for v in as_list(values)])


def date_from(c: Column, value) -> Predicate:
    return None if value is None else at_least(c, dates.parse_day(value))


def date_to(c: Column, value) -> Predicate:
    return None if value is None else at_most(c, dates.parse_day(value))


def weekday_in(c: Column, values) -> Predicate:
    """0 = Monday … 6 = Sunday."""
    return is_in(F.weekday(c), values)


def on_day(c: Column, day) -> Column:
    return c == F.lit(dates.parse_day(day))


def in_week(c: Column, day) -> Column:
    """Monday to Sunday around the day. The bounds are literals, so they reach the scan."""
    d = dates.parse_day(day)
    monday = d - dt.timedelta(days=d.weekday())
    return c.between(F.lit(monday), F.lit(monday + dt.timedelta(days=6)))


def in_month(c: Column, year: int, month: int) -> Column:
    first = dt.date(year, month, 1)
    following = dt.date(year + month // 12, month % 12 + 1, 1)
    return (c >= F.lit(first)) & (c < F.lit(following))


def clock_from(c: Column, value: str | None) -> Predicate:
    return None if value is None else at_least(c, dates.parse_clock(value))


def clock_to(c: Column, value: str | None) -> Predicate:
    return None if value is None else at_most(c, dates.parse_clock(value))


def covers_any(start: Column, end: Column, clocks) -> Predicate:
    """The closed span start…end holds one of the times."""
    wanted = [dates.parse_clock(v) for v in as_list(clocks)]
    return any_of([F.lit(t).between(start, end) for t in wanted]) if wanted else None


def accessible(c: Column, value: bool | None) -> Predicate:
    """``Ja``, or text on barrier-free access that is not negated; False also takes the unknown."""
    if value is None:
        return None
    text = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    positive = (text == "ja") | (text.contains("barrierefrei") & ~text.contains("nicht"))
    return positive if value else ~positive


def all_of(predicates: Sequence[Predicate]) -> Predicate:
    out: Predicate = None
    for predicate in predicates:
        if predicate is not None:
            out = predicate if out is None else out & predicate
    return out
