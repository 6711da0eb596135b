"""Dates, minutes of the day and semesters."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations of the pages.
MONTHS = {
    "Jan": 1, "Feb": 2, "Mär": 3, "Apr": 4, "Mai": 5, "Jun": 6,
    "Jul": 7, "Aug": 8, "Sep": 9, "Okt": 10, "Nov": 11, "Dez": 12,
}
# Fixed value: text of an exam cell without an appointment.
NO_APPOINTMENT = "k.Terminbuchung"

_DATE = r"(?U)(\d{1,2})\.\s*(\w{3})\.?\s*(\d{4})"
_TIME = r"(\d{1,2}):(\d{2})"
_EXAM = r"(?U)^\w{2}, (\d{1,2}\. \w{3}\.? \d{4}), (\d{2}:\d{2}) - (\d{2}:\d{2})"


def german_date(c: Column) -> Column:
    """``15. Jul. 2026`` (dots optional) as a date; unknown months and impossible days give NULL."""
    numbers = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    found = F.array(*[F.regexp_extract(c, _DATE, k) for k in (3, 2, 1)])

    def dated(parts: Column) -> Column:
        month = F.try_element_at(numbers, F.get(parts, 1))
        return F.when(month.isNotNull(), F.try_to_date(F.concat_ws("-", F.get(parts, 0), month.cast("string"), F.get(parts, 2)), "yyyy-M-d"))

    # Bound as the item of a list, so that each part is extracted once.
    return F.get(F.transform(F.array(found), dated), 0)


def clock_minutes(c: Column) -> Column:
    """``H:MM`` as minutes of the day; hour 24 is the last minute, other impossible times give NULL."""
    hour = F.regexp_extract(c, _TIME, 1).try_cast("int")
    minute = F.regexp_extract(c, _TIME, 2).try_cast("int")
    return F.when(hour == 24, F.lit(23 * 60 + 59)).when((hour <= 23) & (minute <= 59), hour * 60 + minute)


def exam_slot(c: Column) -> Column:
    """``Mi, 15. Jul. 2026, 08:30 - 09:30`` as (exam_date, start_min, end_min), all NULL otherwise."""
    return F.struct(
        german_date(F.regexp_extract(c, _EXAM, 1)).alias("exam_date"),
        clock_minutes(F.regexp_extract(c, _EXAM, 2)).alias("start_min"),
        clock_minutes(F.regexp_extract(c, _EXAM, 3)).alias("end_min"),
    )


def is_exam_slot(c: Column) -> Column:
    return c.rlike(_EXAM)


def clock_text(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def semester(c: Column) -> Column:
    """Term and year of a semester name, NULL where it is none; a two-digit year stays as it is."""
    term = F.when(c.startswith("SoSe"), F.lit("SoSe")).when(c.startswith("WiSe"), F.lit("WiSe"))
    year = F.regexp_extract(c, r"\d{2,4}", 0).try_cast("int")
    return F.when(
        term.isNotNull() & year.isNotNull(),
        F.struct(c.alias("name"), year.alias("year"), term.alias("term")),
    )


def week_start(c: Column) -> Column:
    return F.date_sub(c, F.weekday(c))


def local_stamp(day: Column, minutes: Column) -> Column:
    """Wall-clock stamp as calendars write it: ``20260715T083000``."""
    return F.concat(
        F.date_format(day, "yyyyMMdd"),
        F.format_string("T%02d%02d00", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")),
    )


def utc_stamp(day: Column, minutes: Column, zone: str) -> Column:
    """The instant of a wall-clock time in an IANA zone."""
    wall = F.to_timestamp(day) + F.make_dt_interval(mins=minutes)
    return F.to_utc_timestamp(wall, zone)


def weekly_dates(first: Column, last: Column) -> Column:
    return F.sequence(first, last, F.expr("interval 7 days"))


def parse_day(value: str | dt.date) -> dt.date:
    """ISO date of a parameter; anything else is an error."""
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def parse_clock(value: str) -> int:
    """``HH:MM`` of a parameter as minutes; anything else is an error."""
    match = re.fullmatch(r"([01]\d|2[0-3]):([0-5]\d)", value)
    if match is None:
        raise ValueError(f"not a time of day: {value!r}")
    return int(match[1]) * 60 + int(match[2])
