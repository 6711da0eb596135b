"""Audit and integrity checks: every check is the DataFrame of its offending rows.

Count and sample of a check come from that one plan; `summary` runs any number of checks as one job.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabary.functions import text
from syllabary.operators.aggregates import duplicate_groups, having_several, joined_values, table_counts, top_counter
from syllabary.operators.relations import where_related, without_links
from syllabary.store import Store

Rows = Callable[[Store], DataFrame]


@dataclass(frozen=True)
class Without:
    """Rows of an entity that no link side names: those of a relation, or of the tables in ``links`` by a column of theirs."""

    entity: str
    relation: str = ""
    links: tuple[tuple[str, str], ...] = ()

    def __call__(self, store: Store) -> DataFrame:
        if self.links:
            return without_links(store[self.entity], "id", [(store[t], c) for t, c in self.links])
        return where_related(store, store[self.entity], self.entity, self.relation, negate=True)

    def sides(self, store: Store) -> tuple[tuple[str, str], ...] | None:
        """(table, column) of the link sides that name a row by its id; None where another column is named."""
        if self.links:
            return self.links
        relation = store.catalog.relation(self.entity, self.relation)
        if relation.link is not None:
            return ((relation.link, relation.near),)
        return ((relation.target, relation.far),) if relation.near == "id" else None


@dataclass(frozen=True)
class Where:
    """Rows of an entity on which a condition over their own columns holds."""

    entity: str
    condition: Callable[[], Column]

    def __call__(self, store: Store) -> DataFrame:
        return store[self.entity].where(self.condition())


@dataclass(frozen=True)
class Check:
    key: str
    severity: str
    rows: Rows
    hint: str = ""


_without, _where = Without, Where


def _blank(column: str) -> Callable[[], Column]:
    return lambda: text.is_blank(F.col(column))


def _unlocated_with_located_sibling(store: Store) -> DataFrame:
    """Events without a location of which some course also has an event with one."""
    events = store["event"].select("id", "location_id")
    links = store["course_event"].join(events, F.col("event_id") == F.col("id"))
    located = links.where("location_id is not null").select(F.col("course_id").alias("_course")).distinct()
    mixed = (
        links.where("location_id is null")
        .join(located, F.col("course_id") == F.col("_course"), "left_semi")
        .select(F.col("event_id").alias("_event"))
        .distinct()
    )
    return store["event"].join(mixed, F.col("id") == F.col("_event"), "left_semi")


def unlocated_per_course(store: Store) -> DataFrame:
    """(course_id, unlocated) for courses that also have located events: the sample of the mixed check."""
    events = store["event"].select("id", "location_id")
    links = store["course_event"].join(events, F.col("event_id") == F.col("id"))
    per_course = links.groupBy("course_id").agg(
        F.count(F.when(F.col("location_id").isNull(), 1)).alias("unlocated"), F.count("location_id").alias("located")
    )
    return per_course.where("unlocated > 0 and located > 0").select("course_id", "unlocated")


_orphan_staff = Without("staff", links=tuple((t, "staff_id") for t in ("module_staff", "course_staff", "event_staff", "exam_staff")))


def _numbers_with_several_names(store: Store) -> DataFrame:
    return having_several(store["module"], ["number"], "name", name="n_names")


CHECKS: tuple[Check, ...] = (
    Check("modules_without_semester", "error", _without("module", "semesters"), "no semester link"),
    Check("modules_without_start_semester", "error", _without("module", "start_semester"), "no start semester"),
    Check("modules_without_courses", "error", _without("module", "courses"), "no course link"),
    Check("modules_without_degrees", "warn", _without("module", "degrees"), "derive degrees again"),
    Check("modules_without_faculty", "warn", _where("module", lambda: F.col("faculty_id").isNull()), "no prefix matched"),
    Check("modules_with_empty_path", "warn", _without("module", "paths"), "no navigation path"),
    Check("modules_zero_credits", "warn", _where("module", lambda: F.col("credits") == 0), "credits not read"),
    Check("modules_zero_duration", "warn", _where("module", lambda: F.col("duration_semesters") == 0), "duration not read"),
    Check("courses_without_events", "warn", _without("course", "events"), "no session"),
    Check("courses_without_modules", "error", _without("course", "modules"), "not reachable"),
    Check("events_without_location", "warn", _where("event", lambda: F.col("location_id").isNull()), "no room"),
    Check("events_without_location_mixed", "warn", _unlocated_with_located_sibling, "room missing for some sessions only"),
    Check("events_without_courses", "error", _without("event", "courses"), "not reachable"),
    Check("events_without_semester", "error", _without("event", "semesters"), "no semester link"),
    Check("locations_without_events", "warn", _without("location", "events"), "unused room"),
    Check("locations_without_building", "warn", _where("location", lambda: F.col("building_id").isNull()), "no building"),
    Check("orphan_degrees", "warn", _without("degree", "modules"), "prune degrees"),
    Check("orphan_staff", "warn", _orphan_staff, "no link at all"),
    Check("duplicate_module_numbers", "warn", _numbers_with_several_names, "several names for one number"),
)


def _out_of_range(store: Store) -> DataFrame:
    day = F.col("event_date")
    return store["event"].where((day < F.lit("2000-01-01").cast("date")) | (day > F.lit("2100-01-01").cast("date")))


def _duplicates(entity: str, *keys: str) -> Rows:
    return lambda store: duplicate_groups(store[entity], list(keys))


def _shared_across_modules(store: Store) -> DataFrame:
    """Events whose courses belong to more than one module.

    Smallest and largest module per course, then per event: they differ exactly if there are two
    modules. No (event, module) pairs are made, so a course in many of both costs one row per link.
    """
    per_course = store["module_course"].groupBy("course_id").agg(F.min("module_id").alias("lo"), F.max("module_id").alias("hi"))
    per_event = store["course_event"].join(per_course, "course_id").groupBy("event_id").agg(
        F.min("lo").alias("first_module"), F.max("hi").alias("last_module")
    )
    return per_event.where("first_module <> last_module")


def location_split_sample(store: Store, n: int = 8) -> DataFrame:
    """The n most split location names with their external ids."""
    top = duplicate_groups(store["location"], ["name"]).orderBy(F.col("n").desc(), "name").limit(n)
    rows = store["location"].join(top, "name")
    return rows.groupBy("name").agg(F.max("n").alias("n"), joined_values("external_id").alias("external_ids"))


def _exam_time_conflict(store: Store) -> DataFrame:
    start, end = F.coalesce("start_min", F.lit(-1)), F.coalesce("end_min", F.lit(-1))
    timed = store["exam"].withColumns({"start_min": start, "end_min": end})
    return having_several(timed, ["module_id", "name", "exam_date"], "start_min", "end_min")


INTEGRITY: tuple[Check, ...] = (
    Check("module_several_names", "error", _numbers_with_several_names),
    Check("module_empty_name", "error", _where("module", _blank("name"))),
    Check("module_no_path", "error", _without("module", "paths")),
    Check("module_no_courses", "error", _without("module", "courses")),
    Check("semester_two_digit_year", "error", _where("semester", lambda: F.col("year") < 100)),
    Check("semester_duplicate_name", "error", _duplicates("semester", "name")),
    Check("course_no_events", "error", _without("course", "events")),
    Check("course_empty_org_unit", "error", _where("course", lambda: F.col("org_unit") == "")),
    Check("course_zero_weekly_hours", "error", _where("course", lambda: F.col("weekly_hours") == 0)),
    Check("event_null_location", "error", _where("event", lambda: F.col("location_id").isNull())),
    Check("event_start_not_before_end", "error", _where("event", lambda: F.col("start_min") >= F.col("end_min"))),
    Check("event_date_out_of_range", "error", _out_of_range),
    Check("location_duplicate_identity", "error", _duplicates("location", "name", "external_id", "building_id")),
    Check("location_empty_external_id", "error", _where("location", lambda: F.col("external_id") == "")),
    Check("location_empty_name", "error", _where("location", lambda: F.col("name") == "")),
    Check("building_empty_name", "error", _where("building", lambda: F.col("name") == "")),
    Check("staff_empty_name", "error", _where("staff", _blank("name"))),
    Check("degree_orphan", "error", _without("degree", "modules")),
    Check("degree_empty_name", "error", _where("degree", _blank("name"))),
    Check("dup_module", "error", _duplicates("module", "number", "name")),
    Check("dup_course", "error", _duplicates("course", "name", "number", "type")),
    Check("dup_event", "error", _duplicates("event", "event_date", "start_min", "end_min", "location_id")),
    Check("event_shared_modules", "error", _shared_across_modules),
    Check("dup_exam", "error", _duplicates("exam", "module_id", "name", "exam_date", "required")),
    Check("dup_achievement", "error", _duplicates("achievement", "module_id", "name", "required", "weight")),
    Check("location_name_split", "error", _duplicates("location", "name")),
    Check("dup_staff", "error", _duplicates("staff", "name")),
    Check("exam_time_conflict", "error", _exam_time_conflict),
)


def flat_paths(raw: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose stored JSON path is a flat list: a check on stores that keep paths as text."""
    from syllabary.functions.paths import is_flat

    return raw.where(is_flat(F.col(path)))


def rows_of(store: Store, key: str, checks: tuple[Check, ...] = CHECKS + INTEGRITY) -> DataFrame:
    for check in checks:
        if check.key == key:
            return check.rows(store)
    raise ValueError(f"unknown check {key!r}")


def _entity_counts(store: Store, entity: str, checks: Sequence[Check]) -> DataFrame:
    """(check, n) of the checks that ask for rows of one entity without links, or with a condition on their own columns.

    One pass: each row says which conditions hold on it, each link side sets one bit under the key it names, and a row's
    links are the ``bit_or`` of its key. So every table is read once, whatever the number of checks, and a key with many links
    is combined before it is sent.
    """
    sides: list[tuple[str, str]] = []
    for c in checks:
        if isinstance(c.rows, Without):
            sides += [s for s in c.rows.sides(store) if s not in sides]
    flags = {c.key: F.coalesce(c.rows.condition(), F.lit(False)).cast("long") for c in checks if isinstance(c.rows, Where)}
    own = {k: f"_c{i}" for i, k in enumerate(flags)}
    nothing = F.lit(0).cast("long")
    rows = store[entity].select(
        F.col("id").alias("_key"), nothing.alias("_links"), F.lit(1).cast("long").alias("_rows"), *(flags[k].alias(c) for k, c in own.items())
    )
    if not sides:
        counts = rows.agg(*(F.coalesce(F.sum(c), nothing).alias(k) for k, c in own.items()))
    else:
        for i, (table, column) in enumerate(sides):
            bit = F.lit(1 << i).cast("long")
            named = store[table].where(F.col(column).isNotNull())
            rows = rows.unionByName(named.select(F.col(column).alias("_key"), bit.alias("_links"), nothing.alias("_rows"), *(nothing.alias(c) for c in own.values())))
        by_key = rows.groupBy("_key").agg(F.bit_or("_links").alias("_links"), F.sum("_rows").alias("_rows"), *(F.sum(c).alias(c) for c in own.values()))
        wanted = {c.key: sum(1 << sides.index(s) for s in c.rows.sides(store)) for c in checks if isinstance(c.rows, Without)}
        lacking = [F.sum(F.when(F.col("_links").bitwiseAND(F.lit(mask)) == 0, F.col("_rows")).otherwise(0)).alias(k) for k, mask in wanted.items()]
        counts = by_key.agg(*lacking, *(F.sum(c).alias(k) for k, c in own.items()))
    each = F.array(*(F.struct(F.lit(c.key).alias("check"), F.coalesce(F.col(c.key), nothing).alias("n")) for c in checks))
    return counts.select(F.explode(each).alias("e")).select("e.check", "e.n")


def summary(store: Store, checks: tuple[Check, ...] = CHECKS) -> DataFrame:
    """(check, severity, n, hint), all checks counted in one job with one pass over each entity and its link sides."""
    grouped: dict[str, list[Check]] = {}
    parts = []
    for c in checks:
        if isinstance(c.rows, Where) or (isinstance(c.rows, Without) and c.rows.sides(store) is not None):
            grouped.setdefault(c.rows.entity, []).append(c)
        else:
            parts.append(c.rows(store).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c.key).alias("check"), "n"))
    parts += [_entity_counts(store, entity, own) for entity, own in grouped.items()]

    def told(of: Callable[[Check], str]) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for c in checks for x in (c.key, of(c)))), F.col("check"))

    counts = reduce(DataFrame.unionByName, parts)
    return counts.select("check", told(lambda c: c.severity).alias("severity"), "n", told(lambda c: c.hint).alias("hint"))


def failures(report: DataFrame) -> DataFrame:
    """One row: number of failing error and warn checks."""
    def failing(severity: str) -> Column:
        return F.count(F.when((F.col("severity") == severity) & (F.col("n") > 0), 1))

    return report.agg(failing("error").alias("errors"), failing("warn").alias("warnings"))


def exit_code(report: DataFrame, strict: bool = False) -> int:
    """1 on any error, 2 on warnings where strict, else 0."""
    row = failures(report).first()
    return 1 if row["errors"] else 2 if strict and row["warnings"] else 0


TOTALS = ("module", "course", "event", "exam", "achievement", "location", "building", "staff", "semester", "degree", "faculty")


def totals(store: Store, names: tuple[str, ...] = TOTALS) -> DataFrame:
    return table_counts({n: store[n] for n in names if n in store})


def sample(store: Store, key: str, n: int = 10) -> DataFrame:
    """The first rows of a failing check, in key order."""
    rows = rows_of(store, key)
    return rows.orderBy(*[F.col(c).asc_nulls_first() for c in rows.columns[:1]]).limit(n)


# ---- crawl snapshot against the store ---------------------------------------------------------------


def snapshot_status(snapshot: DataFrame, modules: DataFrame) -> DataFrame:
    """Each snapshot row (name, …) with ``status``: matched, renamed or missing.

    Matched: its normalised name is stored. Renamed: its leading number is stored under other names.
    """
    names = modules.select(text.normalise_name(F.col("name")).alias("_name")).where("_name <> ''").distinct()
    numbers = modules.where(~text.is_blank(F.col("number"))).select(F.col("number").alias("_number")).distinct()
    keyed = snapshot.withColumns(
        {"_norm": text.normalise_name(F.col("name")), "_lead": text.leading_number(F.col("name"))}
    )
    joined = keyed.join(names, F.col("_norm") == F.col("_name"), "left").join(
        numbers, F.col("_lead") == F.col("_number"), "left"
    )
    status = F.when(F.col("_name").isNotNull(), "matched").when(F.col("_number").isNotNull(), "renamed").otherwise("missing")
    return joined.select(*snapshot.columns, status.alias("status"))


def snapshot_diff(snapshot: DataFrame, modules: DataFrame) -> DataFrame:
    rows = snapshot_status(snapshot, modules)

    def of(status: str) -> Column:
        return F.count(F.when(F.col("status") == status, 1)).alias(status)

    return rows.agg(F.count(F.lit(1)).alias("snapshot_modules"), of("matched"), of("renamed"), of("missing"))


def warning_summary(warnings: DataFrame, k: int = 15) -> DataFrame:
    """The most frequent warning kinds."""
    return top_counter(warnings.withColumn("kind", F.coalesce("kind", F.lit("unknown"))), "kind", k)


def run_audit(
    store: Store, snapshot: DataFrame | None = None, warnings: DataFrame | None = None,
    checks: tuple[Check, ...] = CHECKS,
) -> Mapping[str, DataFrame]:
    """The tables of an audit report."""
    report = {"totals": totals(store), "checks": summary(store, checks)}
    report["result"] = failures(report["checks"])
    if snapshot is not None:
        report["snapshot_status"] = snapshot_status(snapshot, store["module"])
        report["snapshot_diff"] = snapshot_diff(snapshot, store["module"])
    if warnings is not None:
        report["warnings"] = warning_summary(warnings)
    return report
