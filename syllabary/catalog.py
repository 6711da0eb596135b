"""Schemas of the catalogue entities and the relations between them.

Times of day are minutes since midnight. An empty string means "unknown". Keys are strings in
loaded stores (a digest of the natural key) but no operator depends on their type.
"""

from __future__ import annotations

from dataclasses import dataclass

ENTITY_DDL: dict[str, str] = {
    "module": """id string, name string, number string, language string, duration_semesters int,
        credits double, frequency string, goals string, content string, exam_prerequisites string,
        prerequisites map<string,string>, literature string, elective_course_count int,
        elective_prerequisites string, elective_classification string, grading_note string,
        faculty_id string, url string""",
    "module_path": "id string, module_id string, path array<string>, position int",
    "course": """id string, name string, number string, type string, weekday int, weekly_hours int,
        language string, status string, org_unit string, official_description string,
        organisational string, literature string, url string""",
    "event": """id string, number string, name string, start_min int, end_min int, event_date date,
        location_id string, url string""",
    "location": """id string, name string, external_id string, description string, type string,
        seats int, size double, accessibility string, building_id string, url string""",
    "building": "id string, name string, short_name string, address string, url string",
    "degree": """id string, name string, subject string, degree string, school_type string, ects int,
        version string, confidence string, faculty_id string""",
    "faculty": "id string, name string, prefix int",
    "semester": "id string, name string, year int, term string",
    "staff": "id string, name string",
    "status": "id string, name string",
    "event_type": "id string, name string",
    "exam": """id string, module_id string, name string, exam_date date, start_min int, end_min int,
        required boolean, url string""",
    "achievement": """id string, module_id string, name string, required boolean, weight double,
        combination string, url string""",
    "sync_run": """id string, status string, started_at timestamp, finished_at timestamp, pid int,
        log string, error string""",
}

# link table -> (column of the first side, column of the second side)
LINKS: dict[str, tuple[str, str]] = {
    "module_staff": ("module_id", "staff_id"),
    "module_semester": ("module_id", "semester_id"),
    "module_start_semester": ("module_id", "semester_id"),
    "module_course": ("module_id", "course_id"),
    "module_degree": ("module_id", "degree_id"),
    "course_event": ("course_id", "event_id"),
    "course_staff": ("course_id", "staff_id"),
    "course_semester": ("course_id", "semester_id"),
    "event_staff": ("event_id", "staff_id"),
    "event_semester": ("event_id", "semester_id"),
    "exam_staff": ("exam_id", "staff_id"),
    "exam_semester": ("exam_id", "semester_id"),
}


@dataclass(frozen=True)
class Relation:
    """How rows of one entity reach rows of another.

    Without a link table ``near`` is a column of the source and ``far`` one of the target; with a
    link table they are its two columns, meeting the ``id`` of source and target.
    """

    target: str
    many: bool
    near: str
    far: str
    link: str | None = None


def _through(link: str, target: str, reverse: bool = False) -> Relation:
    first, second = LINKS[link]
    near, far = (second, first) if reverse else (first, second)
    return Relation(target, True, near, far, link)


def _to_one(target: str, column: str) -> Relation:
    return Relation(target, False, column, "id")


def _owned(target: str, column: str) -> Relation:
    return Relation(target, True, "id", column)


RELATIONS: dict[str, dict[str, Relation]] = {
    "module": {
        "faculty": _to_one("faculty", "faculty_id"),
        "responsible_persons": _through("module_staff", "staff"),
        "start_semester": _through("module_start_semester", "semester"),
        "semesters": _through("module_semester", "semester"),
        "degrees": _through("module_degree", "degree"),
        "courses": _through("module_course", "course"),
        "exams": _owned("exam", "module_id"),
        "achievements": _owned("achievement", "module_id"),
        "paths": _owned("module_path", "module_id"),
    },
    "module_path": {"module": _to_one("module", "module_id")},
    "course": {
        "type": _to_one("event_type", "type"),
        "status": _to_one("status", "status"),
        "staff": _through("course_staff", "staff"),
        "semesters": _through("course_semester", "semester"),
        "modules": _through("module_course", "module", reverse=True),
        "events": _through("course_event", "event"),
    },
    "event": {
        "location": _to_one("location", "location_id"),
        "staff": _through("event_staff", "staff"),
        "semesters": _through("event_semester", "semester"),
        "courses": _through("course_event", "course", reverse=True),
    },
    "location": {"building": _to_one("building", "building_id"), "events": _owned("event", "location_id")},
    "building": {"locations": _owned("location", "building_id")},
    "degree": {
        "faculty": _to_one("faculty", "faculty_id"),
        "modules": _through("module_degree", "module", reverse=True),
    },
    "faculty": {"modules": _owned("module", "faculty_id"), "degrees": _owned("degree", "faculty_id")},
    "semester": {
        "modules": _through("module_semester", "module", reverse=True),
        "starting_modules": _through("module_start_semester", "module", reverse=True),
        "courses": _through("course_semester", "course", reverse=True),
        "events": _through("event_semester", "event", reverse=True),
        "exams": _through("exam_semester", "exam", reverse=True),
    },
    "staff": {
        "modules": _through("module_staff", "module", reverse=True),
        "courses": _through("course_staff", "course", reverse=True),
        "events": _through("event_staff", "event", reverse=True),
        "exams": _through("exam_staff", "exam", reverse=True),
    },
    "exam": {
        "module": _to_one("module", "module_id"),
        "staff": _through("exam_staff", "staff"),
        "semesters": _through("exam_semester", "semester"),
    },
    "achievement": {"module": _to_one("module", "module_id")},
    "status": {},
    "event_type": {},
    "sync_run": {},
}


@dataclass(frozen=True)
class Catalog:
    """Relations by entity. Any other entity graph can be described the same way."""

    relations: dict[str, dict[str, Relation]]

    def relation(self, entity: str, name: str) -> Relation:
        try:
            return self.relations[entity][name]
        except KeyError:
            raise ValueError(f"{entity} has no relation {name!r}") from None

    def has_relation(self, entity: str, name: str) -> bool:
        return name in self.relations.get(entity, {})


CATALOG = Catalog(RELATIONS)
