"""List queries per entity: every parameter is one entry of a table and maps to one predicate.

    list_rows(store, "event", {"weekday": [0, 1], "course_name": "Analysis"}, sort="event_date",
              page=1, page_size=50, include=["location.building"])
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabary.functions import dates, paths
from syllabary.functions.text import any_of
from syllabary.operators import filters as P
from syllabary.operators import ordering, projection
from syllabary.operators.rank_index import RankIndex, rank_index
from syllabary.operators.relations import fan_out, inner_to_one, where_related
from syllabary.operators.schedule import weekday_or_zero, weekly_slots
from syllabary.store import Store

Build = Callable[[Column, object], P.Predicate]


@dataclass(frozen=True)
class Own:
    """A predicate on a column of the entity itself."""

    column: str
    build: Build

    def apply(self, store: Store, df: DataFrame, entity: str, value) -> DataFrame:
        predicate = self.build(df[self.column], value)
        return df if predicate is None else df.where(predicate)


@dataclass(frozen=True)
class Row:
    """A predicate over several columns of the entity."""

    build: Callable[[DataFrame, object], P.Predicate]

    def apply(self, store: Store, df: DataFrame, entity: str, value) -> DataFrame:
        predicate = self.build(df, value)
        return df if predicate is None else df.where(predicate)


@dataclass(frozen=True)
class Exists:
    """A related row over one or more relations meets the predicate."""

    path: str
    column: str
    build: Build

    def apply(self, store: Store, df: DataFrame, entity: str, value) -> DataFrame:
        if self.build(F.col(self.column), value) is None:
            return df
        return where_related(store, df, entity, self.path, lambda t: self.build(t[self.column], value))


@dataclass(frozen=True)
class Has:
    """True: some related row exists. False: none does."""

    path: str

    def apply(self, store: Store, df: DataFrame, entity: str, value) -> DataFrame:
        if value is None:
            return df
        return where_related(store, df, entity, self.path, negate=not value)


@dataclass(frozen=True)
class Joined:
    """Inner join on a foreign key; with ``repeat`` a row repeats per matching child."""

    relation: str
    column: str
    build: Build
    repeat: bool = False

    def apply(self, store: Store, df: DataFrame, entity: str, value) -> DataFrame:
        if not P.as_list(value):
            return df
        join = fan_out if self.repeat else inner_to_one
        return join(store, df, entity, self.relation, lambda t: self.build(t[self.column], value))


def _any_path(build: Callable[[Column, str], P.Predicate]) -> Build:
    def predicate(c: Column, values) -> P.Predicate:
        terms = [t for t in (build(c, v) for v in P.as_list(values)) if t is not None]
        return any_of(terms) if terms else None

    return predicate


def _ilike(*names: str) -> dict[str, Own]:
    return {n: Own(n, P.contains_any) for n in names}


def _range(name: str, low: Build = P.at_least, high: Build = P.at_most) -> dict[str, Own]:
    return {f"{name}_min": Own(name, low), f"{name}_max": Own(name, high)}


_ID = {"id": Own("id", P.is_in)}
_EVENT_LINKS = {
    "course_id": Exists("courses", "id", P.is_in),
    "course_name": Exists("courses", "name", P.contains_any),
    "module_id": Exists("courses.modules", "id", P.is_in),
    "module_name": Exists("courses.modules", "name", P.contains_any),
    "staff": Exists("staff", "name", P.contains_any),
    "staff_id": Exists("staff", "id", P.is_in),
}

PARAMETERS: dict[str, dict[str, object]] = {
    "module": {
        **_ID,
        "faculty_id": Own("faculty_id", P.is_in),
        **_ilike(
            "name", "number", "language", "frequency", "goals", "content", "exam_prerequisites", "literature",
            "grading_note", "elective_classification",
        ),
        **_range("credits"),
        **_range("duration_semesters"),
        "degree_id": Exists("degrees", "id", P.is_in),
        "course_id": Exists("courses", "id", P.is_in),
        "semester_id": Exists("semesters", "id", P.is_in),
        "staff_id": Exists("responsible_persons", "id", P.is_in),
        "responsible_person": Exists("responsible_persons", "name", P.contains_any),
        "start_semester": Exists("start_semester", "name", P.contains_any),
        "has_courses": Has("courses"),
        "has_events": Has("courses.events"),
        "has_staff": Has("responsible_persons"),
        "has_achievements": Has("achievements"),
        "path": Exists("paths", "path", _any_path(paths.has_segment)),
        "path_prefix": Exists("paths", "path", _any_path(paths.has_prefix)),
    },
    "course": {
        **_ID,
        **_ilike("name", "number", "language", "org_unit"),
        "type": Exists("type", "name", P.contains_any),
        "type_id": Own("type", P.is_in),
        "staff": Exists("staff", "name", P.contains_any),
        "staff_id": Exists("staff", "id", P.is_in),
        "semester_id": Exists("semesters", "id", P.is_in),
        "module_id": Exists("modules", "id", P.is_in),
        "module_name": Exists("modules", "name", P.contains_any),
        "module_number": Exists("modules", "number", P.contains_any),
        "has_events": Has("events"),
        **_range("weekly_hours"),
    },
    "event": {
        **_ID,
        "date": Own("event_date", P.date_in),
        "date_from": Own("event_date", P.date_from),
        "date_to": Own("event_date", P.date_to),
        "weekday": Own("event_date", P.weekday_in),
        "start_time_from": Own("start_min", P.clock_from),
        "start_time_to": Own("start_min", P.clock_to),
        "end_time_from": Own("end_min", P.clock_from),
        "end_time_to": Own("end_min", P.clock_to),
        "time_overlap": Row(lambda df, v: P.covers_any(df["start_min"], df["end_min"], v)),
        "location_id": Own("location_id", P.is_in),
        "location": Exists("location", "name", P.contains_any),
        "building_id": Exists("location", "building_id", P.is_in),
        "building": Exists("location.building", "name", P.contains_any),
        "building_address": Exists("location.building", "address", P.contains_any),
        "course_number": Exists("courses", "number", P.contains_any),
        "course_type": Exists("courses.type", "name", P.contains_any),
        "course_type_id": Exists("courses", "type", P.is_in),
        "module_number": Exists("courses.modules", "number", P.contains_any),
        "semester_id": Exists("semesters", "id", P.is_in),
        **_EVENT_LINKS,
    },
    "exam": {
        **_ID,
        **_ilike("name"),
        "exam_date": Own("exam_date", P.date_in),
        "exam_date_from": Own("exam_date", P.date_from),
        "exam_date_to": Own("exam_date", P.date_to),
        "start_time_from": Own("start_min", P.clock_from),
        "start_time_to": Own("start_min", P.clock_to),
        "end_time_from": Own("end_min", P.clock_from),
        "end_time_to": Own("end_min", P.clock_to),
        "required": Own("required", P.is_flag),
        "staff": Exists("staff", "name", P.contains_any),
        "staff_id": Exists("staff", "id", P.is_in),
        "semester_id": Exists("semesters", "id", P.is_in),
        "module_id": Own("module_id", P.is_in),
        "module_name": Joined("module", "name", P.contains_any),
        "module_number": Joined("module", "number", P.contains_any),
    },
    "achievement": {
        **_ID,
        "module_id": Own("module_id", P.is_in),
        **_ilike("name", "combination"),
        "required": Own("required", P.is_flag),
        **_range("weight", P.known_at_least, P.known_at_most),
        "module_name": Joined("module", "name", P.contains_any),
        "module_number": Joined("module", "number", P.contains_any),
    },
    "degree": {
        **_ID,
        "faculty_id": Own("faculty_id", P.is_in),
        **_ilike("name", "subject", "degree"),
        "module_id": Exists("modules", "id", P.is_in),
    },
    "staff": {
        **_ID,
        **_ilike("name"),
        "event_id": Exists("events", "id", P.is_in),
        "course_id": Exists("courses", "id", P.is_in),
        "module_id": Exists("modules", "id", P.is_in),
        "has_courses": Has("courses"),
        "has_events": Has("events"),
    },
    "location": {
        **_ID,
        "building_id": Own("building_id", P.is_in),
        **_ilike("name", "external_id", "type"),
        **_range("seats"),
        **_range("size"),
        "accessible": Own("accessibility", P.accessible),
        "event_id": Exists("events", "id", P.is_in),
        "has_events": Has("events"),
    },
    "building": {
        **_ID,
        **_ilike("name", "short_name", "address"),
        "location_id": Joined("locations", "id", P.is_in, repeat=True),
    },
    "faculty": {**_ID, **_ilike("name"), "degree_id": Exists("degrees", "id", P.is_in)},
    "semester": {**_ID, **_ilike("name", "term"), "year": Own("year", P.is_in)},
    "event_type": {**_ID, **_ilike("name")},
    "status": {**_ID, **_ilike("name")},
}


def where(store: Store, entity: str, parameters: Mapping[str, object] | None = None) -> DataFrame:
    """All rows of the entity that meet every set parameter."""
    df = store[entity]
    for name, value in (parameters or {}).items():
        known = PARAMETERS[entity]
        if name not in known:
            raise ValueError(f"{entity} has no parameter {name!r}; known are {sorted(known)}")
        df = known[name].apply(store, df, entity, value)
    return df


def list_rows(
    store: Store, entity: str, parameters: Mapping[str, object] | None = None, sort: str | None = None,
    order: str = "asc", page: int | None = None, page_size: int | None = None,
    fields: Sequence[str] | None = None, include: Sequence[str] | None = None,
) -> DataFrame:
    """Filter, sort, page and shape in one plan. `count_rows` gives the matching envelope."""
    rows = where(store, entity, parameters)
    return present(store, rows, entity, sort, order, page, page_size, fields, include)


def present(
    store: Store, rows: DataFrame, entity: str, sort: str | None = None, order: str = "asc",
    page: int | None = None, page_size: int | None = None, fields: Sequence[str] | None = None,
    include: Sequence[str] | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Sort, page and project rows of an entity; the rows come out in sort order.

    A page counts entities. With to-many relations each has its parts (see `projection`), those of one entity in turn.
    """
    tree = projection.projection(store, entity, fields, include)
    if not tree.relations:
        chosen = ordering.page(rows, page, page_size, sort, order)
        own = store.columns(entity) if tree.everything else sorted(tree.fields)
        return chosen.select(*own, *[k for k in keep if k not in own])
    chosen = ordering.page(rows, page, page_size, sort, order) if page_size is not None else rows
    hidden = [c for c in ("id", sort) if c and c in rows.columns]
    renamed = chosen.select("*", *[F.col(c).alias(f"_sort_{c}") for c in hidden])
    by = ordering.order_columns(renamed, f"_sort_{sort}" if sort else None, order, tie="_sort_id")
    names = [f"_sort_{c}" for c in (sort, "id") if c in hidden]
    shaped = projection.project(
        store, renamed, entity, tree, keep=[*keep, *[f"_sort_{c}" for c in hidden]], restrict=page_size is not None,
        by=dict(zip(names, by, strict=True)),
    )
    by += [F.col(projection.PART).asc_nulls_first()] if projection.PART in shaped.columns else []
    return shaped.orderBy(*by).drop(*[f"_sort_{c}" for c in hidden])


def page_index(
    store: Store, entity: str, parameters: Mapping[str, object] | None = None, sort: str | None = None, order: str = "asc"
) -> RankIndex:
    """The rows that `list_rows` would page, sorted once: deep pages then read one or two ranges of them."""
    return rank_index(where(store, entity, parameters), sort, order)


def indexed_page(
    store: Store, entity: str, index: RankIndex, page: int, page_size: int, fields: Sequence[str] | None = None,
    include: Sequence[str] | None = None,
) -> DataFrame:
    """The page that `list_rows` gives for the same sort, from its index."""
    return _shaped(store, entity, index, index.page(page, page_size), page_size, fields, include)


def indexed_after(
    store: Store, entity: str, index: RankIndex, token: Sequence[object], n: int, fields: Sequence[str] | None = None,
    include: Sequence[str] | None = None,
) -> DataFrame:
    """The ``n`` entities after the one whose sort value and id are ``token``."""
    return _shaped(store, entity, index, index.after(token, n), n, fields, include)


def _shaped(
    store: Store, entity: str, index: RankIndex, rows: DataFrame, n: int, fields: Sequence[str] | None, include: Sequence[str] | None
) -> DataFrame:
    return present(store, rows, entity, index.keys[0], "desc" if index.descending else "asc", 1, n, fields, include)


def count_rows(
    store: Store, entity: str, parameters: Mapping[str, object] | None = None, page: int | None = None,
    page_size: int | None = None,
) -> DataFrame:
    return ordering.page_meta(where(store, entity, parameters), page, page_size)


def distinct_field(
    store: Store, entity: str, field: str, order: str = "asc", page: int | None = None, page_size: int | None = None
) -> DataFrame:
    return ordering.distinct_values(store[entity], field, order, page, page_size)


def events_in(
    store: Store, window: str, day=None, year: int | None = None, month: int | None = None, today: str | None = None, **parameters
) -> DataFrame:
    """Events of a window: ``day``, ``week`` or ``month``, or ``today``, ``tomorrow`` or ``this_week`` as of ``today``.

    ``today`` is an ISO date; left out, it is the current date.
    """
    rows = where(store, "event", parameters)
    now = F.lit(dates.parse_day(today)) if today else F.current_date()
    if window == "day":
        predicate = P.on_day(rows["event_date"], day)
    elif window == "week":
        predicate = P.in_week(rows["event_date"], day)
    elif window == "month":
        predicate = P.in_month(rows["event_date"], year, month)
    elif window == "today":
        predicate = rows["event_date"] == now
    elif window == "tomorrow":
        predicate = rows["event_date"] == F.date_add(now, 1)
    elif window == "this_week":
        monday = dates.week_start(now)
        predicate = rows["event_date"].between(monday, F.date_add(monday, 6))
    else:
        raise ValueError(f"unknown window {window!r}")
    return rows.where(predicate)


WEEKLY: dict[str, object] = {
    "semester_id": Exists("semesters", "id", P.is_in),
    "faculty_ids": Exists("courses.modules", "faculty_id", P.is_in),
    "degree_ids": Exists("courses.modules.degrees", "id", P.is_in),
    "course_ids": Exists("courses", "id", P.is_in),
    "module_ids": Exists("courses.modules", "id", P.is_in),
    "staff_ids": Exists("staff", "id", P.is_in),
    "location_ids": Own("location_id", P.is_in),
    "building_ids": Exists("location", "building_id", P.is_in),
    "weekdays": Own("event_date", P.weekday_in),
}


def weekly_schedule(
    store: Store, parameters: Mapping[str, object] | None = None, split_by_day: bool = False, sort: str | None = None,
    order: str = "asc", page: int | None = None, page_size: int | None = None,
    fields: Sequence[str] | None = None, include: Sequence[str] | None = None,
) -> DataFrame:
    """Weekly slots of the events that meet the parameters, with their weekday.

    With ``split_by_day`` the weekday is the first sort key and ``sort`` orders within a day.
    """
    events = store["event"]
    for name, value in (parameters or {}).items():
        if name not in WEEKLY:
            raise ValueError(f"unknown parameter {name!r}; known are {sorted(WEEKLY)}")
        events = WEEKLY[name].apply(store, events, "event", value)
    slots = weekly_slots(events.select(*store.columns("event")))
    if fields and "event_date" not in fields:
        fields = [*fields, "event_date"]
    if not split_by_day:
        return present(store, slots, "event", sort, order, page, page_size, fields, include, keep=["weekday"])
    # One composite sort column keeps the paging and the presentation the same as for any other sort.
    within = F.col(sort) if sort and sort in slots.columns else F.lit("")
    flip = order == "desc" and sort is not None
    if flip:
        by = [F.col("weekday").asc(), within.desc_nulls_last(), F.col("id").asc()]
    else:
        by = [F.col("weekday").asc(), within.asc_nulls_first(), F.col("id").asc()]
    chosen = slots.orderBy(*by)
    if page_size is not None:
        chosen = chosen.offset(((page or 1) - 1) * page_size).limit(page_size)
    tree = projection.projection(store, "event", fields, include)
    own = store.columns("event") if tree.everything else sorted(tree.fields)
    if not tree.relations:
        return chosen.select(*own, "weekday")
    hidden = chosen.select("*", within.alias("_within"), F.col("id").alias("_id"))
    shaped = projection.project(store, hidden, "event", tree, keep=["weekday", "_within", "_id"], restrict=True)
    last = F.col("_within").desc_nulls_last() if flip else F.col("_within").asc_nulls_first()
    parts = [F.col(projection.PART)] if projection.PART in shaped.columns else []
    return shaped.orderBy(F.col("weekday").asc(), last, F.col("_id").asc(), *parts).drop("_within", "_id")


def with_weekday(df: DataFrame) -> DataFrame:
    return df.withColumn("weekday", weekday_or_zero(F.col("event_date")))
