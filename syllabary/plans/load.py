"""Load: nested module records to entity and link tables, as set-based merges.

Rows that mean the same thing (equal natural key) become one. Scalars take the first non-empty value in
arrival order, sets of links are united. Every merge is an aggregate over partially combined rows, so a
key that occurs in a third of all records costs one row per task, and merging is associative: merging
merged parts again gives the same result, which the incremental load relies on.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syllabary.catalog import LINKS
from syllabary.functions import dates, paths, text
from syllabary.operators.aggregates import first_by, first_number, first_text
from syllabary.operators.relations import missing_from
from syllabary.session import checkpointed
from syllabary.store import Store

ROOM_DDL = """struct<name: string, external_id: string, description: string, type: string, seats: int,
    size: double, accessibility: string,
    building: struct<name: string, short_name: string, address: string, url: string>, url: string>"""
EVENT_DDL = f"""struct<number: string, name: string, event_date: date, start_min: int, end_min: int,
    location: {ROOM_DDL}, staff: array<string>, url: string>"""
COURSE_DDL = f"""struct<name: string, number: string, staff: array<string>, type: string,
    weekly_hours: int, language: string, events: array<{EVENT_DDL}>, status: string, org_unit: string,
    official_description: string, organisational: string, literature: string, url: string>"""
EXAM_DDL = """struct<name: string, date: date, start_min: int, end_min: int, staff: array<string>,
    required: boolean, url: string>"""
LINK_TYPE = "array<struct<link: tinyint, near: binary, far: binary>>"
ACHIEVEMENT_DDL = "struct<name: string, required: boolean, weight: double, combination: string, url: string>"
MODULE_DDL = f"""name string, number string, path array<array<string>>, responsible_person string,
    duration_semesters int, credits double, start_semester string, frequency string, goals string,
    content string, exam_prerequisites string, prerequisites map<string,string>, literature string,
    elective_course_count int, elective_prerequisites string, elective_classification string,
    grading_note string, courses array<{COURSE_DDL}>, exams array<{EXAM_DDL}>,
    achievements array<{ACHIEVEMENT_DDL}>, url string"""

MODULE_TEXTS = (
    "frequency", "goals", "content", "exam_prerequisites", "literature", "elective_prerequisites",
    "elective_classification", "grading_note", "url",
)
COURSE_TEXTS = ("language", "org_unit", "official_description", "organisational", "literature", "url")


def key_id(*parts: Column) -> Column:
    """128-bit digest of a natural key; NULL parts differ from ''. Stable across runs and partitions."""
    marked = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.md5(F.concat_ws("\u001f", *marked))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _room_texts(place: Column) -> Column:
    """A room whose absent key texts are ''."""
    house = place["building"]
    house = F.struct(*[_text(house[c]).alias(c) for c in ("name", "short_name", "address", "url")])
    full = place.withField("name", _text(place["name"])).withField("external_id", _text(place["external_id"]))
    return F.when(place.isNotNull(), full.withField("building", house))


def in_arrival_order(records: DataFrame) -> DataFrame:
    """Add ``seq``: records arrive in module name order, equal names by number and address, then by a digest of the record.

    Two crawls of one page can differ, and neither partitions nor batches may decide which of them is first.
    """
    if "seq" in records.columns:
        return records
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("name", "number", "url")]
    return records.withColumn("seq", F.struct(*named, F.md5(F.to_json(F.struct(*records.columns))).alias("digest")))


def stage(records: DataFrame) -> dict[str, DataFrame]:
    """Flatten nested records to one table per level. Each row knows its place in the arrival order."""
    records = in_arrival_order(records)
    found = paths.term_nodes(F.filter(F.col("path"), lambda p: F.size(p) > 0))
    named = F.filter(F.transform(found, dates.semester), lambda s: s.isNotNull())
    base = (
        records.withColumn("path", paths.drop_empty(F.col("path")))
        .withColumn("module_id", key_id(F.col("number"), F.col("name")))
        .withColumn("semesters", named)
        .withColumn("semester_id", F.get(F.transform(F.slice("semesters", 1, 1), lambda s: key_id(s["name"])), 0))
    )
    modules = base.drop("courses", "exams", "achievements")
    courses = base.select(
        "seq", "module_id", "semester_id", F.posexplode("courses").alias("course_pos", "course")
    ).where("course is not null")
    courses = courses.select(
        F.struct("seq", "course_pos").alias("seq"), "module_id", "semester_id", "course.*"
    ).withColumn("course_id", key_id(F.col("name"), F.col("number"), F.col("type")))
    events = courses.select(
        "seq", "module_id", "course_id", "semester_id", F.posexplode("events").alias("event_pos", "event")
    ).where("event is not null")
    events = events.select(
        F.struct("seq", "event_pos").alias("seq"), "module_id", "course_id", "semester_id", "event.*"
    )
    events = events.withColumn("location", _room_texts(F.col("location")))
    place = F.col("location")
    building_key = key_id(place["building"]["name"], place["building"]["short_name"], place["building"]["address"])
    events = events.withColumn("building_id", F.when(place.isNotNull(), building_key)).withColumn(
        "location_id", F.when(place.isNotNull(), key_id(place["name"], place["external_id"], F.col("building_id")))
    )
    complete = F.col("event_date").isNotNull() & F.col("start_min").isNotNull() & F.col("end_min").isNotNull()
    same_slot = [F.col(c) for c in ("event_date", "start_min", "end_min", "location_id")]
    # Without a room an equal slot is no evidence of one event, so the course joins the key there.
    events = events.withColumn("event_id", key_id(*same_slot, F.when(F.col("location_id").isNull(), F.col("course_id"))))
    exams = base.select("seq", "module_id", "semester_id", F.posexplode("exams").alias("exam_pos", "exam")).select(
        F.struct("seq", "exam_pos").alias("seq"), "module_id", "semester_id", "exam.*"
    )
    exams = exams.withColumn("exam_id", key_id(*[F.col(c) for c in ("module_id", "name", "required", "date")]))
    achievements = base.select("seq", "module_id", F.posexplode("achievements").alias("ach_pos", "ach")).select(
        F.struct("seq", "ach_pos").alias("seq"), "module_id", "ach.*"
    )
    return {
        "modules": modules,
        "courses": courses.drop("events"),
        "events": events.where(complete),
        "exams": exams,
        "achievements": achievements,
        "rejects": _rejects(events.where(~complete)),
    }


def _rejects(events: DataFrame) -> DataFrame:
    """Sessions without a date or time; the rest of their record is loaded all the same."""
    context = F.create_map(
        F.lit("course_id"), F.col("course_id"), F.lit("event_date"), F.coalesce(F.col("event_date").cast("string"), F.lit("")),
        F.lit("start_min"), F.coalesce(F.col("start_min").cast("string"), F.lit("")),
        F.lit("end_min"), F.coalesce(F.col("end_min").cast("string"), F.lit("")),
    )
    return events.select(
        F.lit("event_incomplete").alias("kind"), F.lit("session without date or time").alias("message"), context.alias("context")
    )


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def resolve(staged: dict[str, DataFrame]) -> Store:
    """Entity and link tables of staged records."""
    modules, courses, events = staged["modules"], staged["courses"], staged["events"]
    exams, achievements = staged["exams"], staged["achievements"]
    people = module_people(modules)
    faculty = resolve_faculties(modules)
    module = resolve_modules(modules, faculty, courses)
    location, building = resolve_places(events)
    tables = {
        "event_type": _names(courses.select(F.col("type").alias("name"))),
        "status": _names(courses.select(F.coalesce("status", F.lit("")).alias("name"))),
        "staff": _names(
            _union([people.select("name")] + [_exploded_staff(t).select("name") for t in (courses, events, exams)])
        ),
        "faculty": faculty,
        "semester": resolve_semesters(modules),
        "module": module,
        "module_path": resolve_paths(modules),
        "course": resolve_courses(courses, events),
        "event": resolve_events(events),
        "location": location,
        "building": building,
        "exam": resolve_exams(exams),
        "achievement": resolve_achievements(achievements),
    }
    return Store({**tables, **resolve_links(staged)})


def staged_once(records: DataFrame) -> dict[str, DataFrame]:
    """The levels of ``stage`` over a written table of the records: they are read, parsed and put in order once, and every merge
    reads the nested columns that it needs from there."""
    return stage(checkpointed(in_arrival_order(records)))


def load(records: DataFrame, once: bool = True) -> tuple[Store, DataFrame]:
    """All tables of the nested records, and the rejected rows.

    With ``once`` the records are written first, which pays where they are dear to make or most tables are asked for. Without,
    each table is merged from the records themselves, of which Spark then makes the fields that this merge reads.
    """
    staged = staged_once(records) if once else stage(records)
    return resolve(staged), staged["rejects"]


def _same(*columns: str) -> list[Column]:
    """What the digest that rows are grouped by says; it is sent only where somebody reads it."""
    return [F.any_value(c).alias(c) for c in columns]


def _names(df: DataFrame) -> DataFrame:
    names = df.where(F.col("name").isNotNull()).distinct()
    return names.select(key_id(F.col("name")).alias("id"), "name")


def _exploded_staff(df: DataFrame) -> DataFrame:
    ids = [c for c in ("course_id", "event_id", "exam_id") if c in df.columns][-1:]
    return df.select(*ids, F.explode("staff").alias("name")).where("name <> ''")


def module_people(modules: DataFrame) -> DataFrame:
    names = F.explode(text.split_people(F.coalesce("responsible_person", F.lit(""))))
    return modules.select("module_id", names.alias("name"))


def resolve_faculties(modules: DataFrame) -> DataFrame:
    """Faculties named by path nodes like ``10 - …`` whose digits agree with the module's number, if it has any.

    Per record the first such node counts.
    """
    # Most nodes hold no dash, and are not searched for digits.
    nodes = F.transform(
        F.filter(F.flatten("path"), lambda n: n.contains(" - ")), lambda n: F.struct(n.alias("name"), paths.node_prefix(n).alias("prefix"))
    )
    own = paths.number_prefix(F.col("number"))
    fitting = F.filter(nodes, lambda n: n["prefix"].isNotNull() & F.coalesce(n["prefix"] == own, F.lit(True)))
    # A generator, so that the nodes of a record are read once and not for each use of what they say.
    first = modules.select("seq", F.explode_outer(F.slice(fitting, 1, 1)).alias("f")).where("f is not null")
    # A name says its prefix, so both are the key.
    named = first.groupBy(F.col("f.name").alias("name"), F.col("f.prefix").alias("prefix")).agg(F.min("seq").alias("seq"))
    return named.select(key_id(F.col("name")).alias("id"), "name", "prefix", "seq")


def resolve_modules(modules: DataFrame, faculty: DataFrame, courses: DataFrame) -> DataFrame:
    seq = F.col("seq")
    filled = F.coalesce(F.size("prerequisites") > 0, F.lit(False))
    merged = modules.groupBy("module_id").agg(
        *_same("number", "name"),
        *[first_text(F.col(c), seq).alias(c) for c in MODULE_TEXTS],
        first_number(F.col("credits"), seq, 0.0).alias("credits"),
        first_number(F.col("duration_semesters"), seq, 0).alias("duration_semesters"),
        first_number(F.col("elective_course_count"), seq, 0).alias("elective_course_count"),
        first_by(F.col("prerequisites"), seq, filled).alias("prerequisites"),
    )
    by_prefix = faculty.groupBy("prefix").agg(F.min_by("id", "seq").alias("faculty_id"))
    merged = merged.withColumn("prefix", paths.number_prefix(F.col("number"))).join(by_prefix, "prefix", "left")
    language = _mode(courses.where("language <> ''"), "module_id", "language")
    merged = merged.join(language, "module_id", "left")
    return merged.select(
        F.col("module_id").alias("id"), "name", "number", F.coalesce("language", F.lit("")).alias("language"),
        "duration_semesters", "credits", "frequency", "goals", "content", "exam_prerequisites", "prerequisites",
        "literature", "elective_course_count", "elective_prerequisites", "elective_classification",
        "grading_note", "faculty_id", "url",
    )


def resolve_paths(modules: DataFrame) -> DataFrame:
    """The union of each module's path groups, one row per distinct group, with its position in arrival order.

    Paths stay rows: a module met on any number of paths never becomes one long list.
    """
    # The outer form keeps Spark from making the paths of each record a second time to see that it has some.
    rows = modules.select("module_id", "seq", F.posexplode_outer("path").alias("pos", "path")).where("pos is not null")
    groups = rows.groupBy("module_id", "path").agg(F.min(F.struct("seq", "pos")).alias("place"))
    key = key_id(F.col("module_id"), F.to_json(F.struct("path")))
    # The rows of a module are its distinct paths, after all its records were combined.
    by_place = Window.partitionBy("module_id").orderBy("place", "id")
    return groups.select(key.alias("id"), "module_id", "path", "place").select(
        "id", "module_id", "path", F.row_number().over(by_place).alias("position")
    )


def _mode(df: DataFrame, key: str, value: str) -> DataFrame:
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_first"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(value))


def resolve_semesters(modules: DataFrame) -> DataFrame:
    start = dates.semester(F.col("start_semester"))
    both = modules.select(F.explode(F.array_append("semesters", start)).alias("s")).where("s is not null")
    return both.select("s.*").distinct().select(key_id(F.col("name")).alias("id"), "name", "year", "term")


def resolve_courses(courses: DataFrame, events: DataFrame) -> DataFrame:
    seq = F.col("seq")
    merged = courses.groupBy("course_id").agg(
        *_same("name", "number", "type"),
        *[first_text(F.col(c), seq).alias(c) for c in COURSE_TEXTS],
        first_number(F.col("weekly_hours"), seq, 0).alias("weekly_hours"),
        F.min_by(F.coalesce("status", F.lit("")), seq).alias("status_name"),
    )
    weekday = _mode(events.withColumn("weekday", F.weekday("event_date") + 1), "course_id", "weekday")
    return merged.join(weekday, "course_id", "left").select(
        F.col("course_id").alias("id"), "name", "number", key_id(F.col("type")).alias("type"), "weekday", "weekly_hours",
        "language", key_id(F.col("status_name")).alias("status"), "org_unit", "official_description",
        "organisational", "literature", "url",
    )


def resolve_events(events: DataFrame) -> DataFrame:
    first = F.min_by(F.struct(F.coalesce("number", F.lit("")).alias("number"), F.coalesce("name", F.lit("")).alias("name")), "seq")
    merged = events.groupBy("event_id").agg(
        *_same("event_date", "start_min", "end_min", "location_id"), first.alias("f"), first_text(F.col("url"), F.col("seq")).alias("url")
    )
    return merged.select(
        F.col("event_id").alias("id"), "f.number", "f.name", "start_min", "end_min", "event_date", "location_id", "url"
    )


def resolve_places(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    rooms = events.where("location is not null").select("seq", "location_id", "building_id", "location.*")
    details = ("description", "type", "seats", "size", "accessibility")
    location = rooms.groupBy("location_id", "name", "external_id", "building_id").agg(
        F.min_by(F.struct(*details), "seq").alias("d"), first_text(F.col("url"), F.col("seq")).alias("url")
    )
    location = location.select(F.col("location_id").alias("id"), "name", "external_id", "d.*", "building_id", "url")
    houses = rooms.select("seq", "building_id", "building.*")
    building = houses.groupBy("building_id", "name", "short_name", "address").agg(
        first_text(F.col("url"), F.col("seq")).alias("url")
    )
    return location, building.withColumnRenamed("building_id", "id")


def resolve_exams(exams: DataFrame) -> DataFrame:
    """The time of day is no part of the key, so two slots of one day are one exam with the first slot."""
    merged = exams.withColumnRenamed("date", "exam_date").groupBy("exam_id").agg(
        *_same("module_id", "name", "required", "exam_date"), F.min_by(F.struct("start_min", "end_min"), "seq").alias("t"), first_text(F.col("url"), F.col("seq")).alias("url")
    )
    return merged.select(F.col("exam_id").alias("id"), "module_id", "name", "exam_date", "t.*", "required", "url")


def resolve_achievements(achievements: DataFrame) -> DataFrame:
    merged = achievements.groupBy("module_id", "name", "required", "weight").agg(
        F.min_by(F.coalesce("combination", F.lit("")), "seq").alias("combination"),
        first_text(F.col("url"), F.col("seq")).alias("url"),
    )
    key = key_id(*[F.col(c) for c in ("module_id", "name", "required", "weight")])
    return merged.select(key.alias("id"), "module_id", "name", "required", "weight", "combination", "url")


def _digests(ids: Column) -> Column:
    return F.transform(ids, lambda n: key_id(n))


def _link_ends() -> dict[str, tuple[str, str, Column]]:
    """For each link table the level of ``stage`` that tells it, the near id and the far ids of a row.

    Courses, events and exams take the first semester of their record, modules take all.
    """
    named, one = F.coalesce("responsible_person", F.lit("")), F.array("semester_id")
    staff = _digests(F.filter("staff", lambda n: n != ""))
    start = dates.semester(F.col("start_semester"))["name"]
    return {
        "module_staff": ("modules", "module_id", _digests(text.split_people(named))),
        "module_semester": ("modules", "module_id", F.transform("semesters", lambda s: key_id(s["name"]))),
        "module_start_semester": ("modules", "module_id", F.array(F.when(start.isNotNull(), key_id(start)))),
        "module_course": ("courses", "module_id", F.array("course_id")),
        "course_event": ("events", "course_id", F.array("event_id")),
        "course_staff": ("courses", "course_id", staff),
        "course_semester": ("courses", "course_id", one),
        "event_staff": ("events", "event_id", staff),
        "event_semester": ("events", "event_id", one),
        "exam_staff": ("exams", "exam_id", staff),
        "exam_semester": ("exams", "exam_id", one),
    }


def _link(place: int, near: str, far: Column) -> Column:
    """(link, near, far) of each far id, none where there is no list of them."""
    links = F.transform(far, lambda f: F.struct(F.lit(place).cast("byte").alias("link"), F.unhex(near).alias("near"), F.unhex(f).alias("far")))
    return F.coalesce(links, F.array().cast(LINK_TYPE))


def linked(staged: dict[str, DataFrame], *names: str) -> DataFrame:
    """(link, near, far) of the link tables ``names``, each link once: every level is read once, and digests travel as bytes."""
    ends, parts = _link_ends(), []
    for level in dict.fromkeys(ends[n][0] for n in names):
        told = [_link(place, *ends[name][1:]) for place, name in enumerate(names) if ends[name][0] == level]
        # The outer form keeps Spark from making the links of each row a second time to see that it has some.
        rows = staged[level].select(F.explode_outer(F.concat(*told)).alias("l"))
        parts.append(rows.select("l.link", "l.near", "l.far").where("far is not null").distinct())
    name = F.element_at(F.array(*map(F.lit, names)), F.col("link").cast("int") + 1)
    return _union(parts).select(name.alias("link"), F.lower(F.hex("near")).alias("near"), F.lower(F.hex("far")).alias("far"))


def resolve_links(staged: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The link tables."""
    return {name: linked(staged, name).select(*[F.col(c).alias(own) for c, own in zip(("near", "far"), LINKS[name], strict=True)]) for name in _link_ends()}


def new_rows(store: Store, existing: Store, entity: str) -> DataFrame:
    """Rows of ``store`` whose key ``existing`` does not hold."""
    return missing_from(store[entity], existing[entity], ["id"])


def insert_counts(store: Store, existing: Store) -> DataFrame:
    """New modules, courses and events as one row; exams count as events."""
    def count(entity: str, label: str) -> DataFrame:
        return new_rows(store, existing, entity).agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("what"), "n")

    parts = [count("module", "modules"), count("course", "courses"), count("event", "events"), count("exam", "events")]
    totals = [F.sum(F.when(F.col("what") == w, F.col("n")).otherwise(0)).alias(w) for w in ("modules", "courses", "events")]
    return _union(parts).agg(*totals)


def module_set(links: DataFrame) -> DataFrame:
    """Crawl links (name, url, path) unique by (name, url), their distinct paths as (name, url, path) rows."""
    exploded = links.select("name", "url", F.explode("path").alias("group"))
    return exploded.distinct()


def enrich_locations(location: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Optional: fold a name-only room into the one detailed room of that name, if there is exactly one."""
    detailed = location.where("external_id <> ''").groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("full_id")
    ).where("n = 1")
    moved = location.where("external_id = ''").join(detailed, "name").select(F.col("id").alias("bare_id"), "full_id")
    kept = location.join(moved, location["id"] == moved["bare_id"], "left_anti")
    remapped = events.join(moved, events["location_id"] == moved["bare_id"], "left").withColumn(
        "location_id", F.coalesce("full_id", "location_id")
    )
    return kept, remapped.drop("bare_id", "full_id")
