"""Audit, integrity and snapshot checks over the star catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabary.plans import audit
from syllabary.plans import reconcile as R
from syllabary.registry.base import add, on_star, on_table
from syllabary.registry.star import star_store, table, with_views

V = with_views


def _check(key: str, name: str, columns: str, sql: str, *views: str) -> None:
    on_star(key, lambda s: audit.rows_of(s, name).select(*columns.split(", ")), V(*views) + sql)


def _none(entity: str, link: str, column: str) -> str:
    return f"SELECT id FROM v_{entity} x WHERE NOT EXISTS (SELECT 1 FROM v_{link} l WHERE l.{column} = x.id)"


_check("audit_modules_without_courses", "modules_without_courses", "id", _none("module", "module_course", "module_id"), "module", "module_course")
_check("audit_modules_without_semester", "modules_without_semester", "id", _none("module", "module_semester", "module_id"), "module", "module_semester")
_check("audit_modules_without_faculty", "modules_without_faculty", "id", "SELECT id FROM v_module WHERE faculty_id IS NULL", "module")
_check("audit_modules_zero_credits", "modules_zero_credits", "id, name", "SELECT id, name FROM v_module WHERE credits = 0", "module")
_check("audit_courses_without_events", "courses_without_events", "id", _none("course", "course_event", "course_id"), "course", "course_event")
_check("audit_courses_without_modules", "courses_without_modules", "id", _none("course", "module_course", "course_id"), "course", "module_course")
_check("audit_events_without_location", "events_without_location", "id", "SELECT id FROM v_event WHERE location_id IS NULL", "event")
MIXED = """SELECT id FROM v_event e WHERE location_id IS NULL AND EXISTS (SELECT 1 FROM v_course_event a JOIN v_course_event b
    ON b.course_id = a.course_id JOIN v_event f ON f.id = b.event_id WHERE a.event_id = e.id AND f.location_id IS NOT NULL)"""
_check("audit_events_without_location_mixed", "events_without_location_mixed", "id", MIXED, "event", "course_event")
_check("audit_events_without_courses", "events_without_courses", "id", _none("event", "course_event", "event_id"), "event", "course_event")
_check("audit_events_without_semester", "events_without_semester", "id", _none("event", "event_semester", "event_id"), "event", "event_semester")
_check("audit_locations_without_events", "locations_without_events", "id", _none("location", "event", "location_id"), "location", "event")
_check("audit_locations_without_building", "locations_without_building", "id", "SELECT id FROM v_location WHERE building_id IS NULL", "location")
ORPHANS = "SELECT id FROM v_staff s WHERE " + " AND ".join(
    f"NOT EXISTS (SELECT 1 FROM v_{t} l WHERE l.staff_id = s.id)" for t in ("module_staff", "course_staff", "event_staff", "exam_staff"))
_check(
    "audit_orphan_staff", "orphan_staff", "id", ORPHANS, "staff", "module_staff", "course_staff", "event_staff", "exam_staff",
)
_check(
    "audit_duplicate_module_numbers", "duplicate_module_numbers", "number, n_names",
    "SELECT number, count(DISTINCT name) AS n_names FROM v_module GROUP BY number HAVING count(DISTINCT name) > 1", "module",
)
on_star(
    "join_correlated_sibling", audit.unlocated_per_course,
    V("event", "course_event")
    + """SELECT course_id, count(*) FILTER (WHERE location_id IS NULL) AS unlocated FROM v_course_event JOIN v_event ON id = event_id
         GROUP BY course_id HAVING count(*) FILTER (WHERE location_id IS NULL) > 0 AND count(location_id) > 0""",
)
_check("audit_modules_without_start_semester", "modules_without_start_semester", "id", _none("module", "module_start_semester", "module_id"), "module", "module_start_semester")
_check("audit_modules_without_degrees", "modules_without_degrees", "id", _none("module", "module_degree", "module_id"), "module", "module_degree")
_check("audit_modules_with_empty_path", "modules_with_empty_path", "id", _none("module", "module_path", "module_id"), "module", "module_path")
_check("audit_modules_zero_duration", "modules_zero_duration", "id", "SELECT id FROM v_module WHERE duration_semesters = 0", "module")
_check("audit_orphan_degrees", "orphan_degrees", "id", _none("degree", "module_degree", "degree_id"), "degree", "module_degree")
REPORT = {
    "modules_without_semester": ("error", _none("module", "module_semester", "module_id")),
    "modules_without_start_semester": ("error", _none("module", "module_start_semester", "module_id")),
    "modules_without_courses": ("error", _none("module", "module_course", "module_id")),
    "modules_without_degrees": ("warn", _none("module", "module_degree", "module_id")),
    "modules_without_faculty": ("warn", "SELECT id FROM v_module WHERE faculty_id IS NULL"),
    "modules_with_empty_path": ("warn", _none("module", "module_path", "module_id")),
    "modules_zero_credits": ("warn", "SELECT id FROM v_module WHERE credits = 0"),
    "modules_zero_duration": ("warn", "SELECT id FROM v_module WHERE duration_semesters = 0"),
    "courses_without_events": ("warn", _none("course", "course_event", "course_id")),
    "courses_without_modules": ("error", _none("course", "module_course", "course_id")),
    "events_without_location": ("warn", "SELECT id FROM v_event WHERE location_id IS NULL"),
    "events_without_location_mixed": ("warn", MIXED),
    "events_without_courses": ("error", _none("event", "course_event", "event_id")),
    "events_without_semester": ("error", _none("event", "event_semester", "event_id")),
    "locations_without_events": ("warn", _none("location", "event", "location_id")),
    "locations_without_building": ("warn", "SELECT id FROM v_location WHERE building_id IS NULL"),
    "orphan_degrees": ("warn", _none("degree", "module_degree", "degree_id")),
    "orphan_staff": ("warn", ORPHANS),
    "duplicate_module_numbers": ("warn", "SELECT number FROM v_module GROUP BY number HAVING count(DISTINCT name) > 1"),
}
on_star(
    "audit_report_sink", lambda s: audit.summary(s).select(F.col("check").alias("name"), "severity", "n"),
    V("module", "module_course", "module_semester", "module_start_semester", "module_degree", "module_path", "course", "course_event", "event",
      "event_semester", "event_staff", "location", "degree", "staff", "module_staff", "course_staff", "exam_staff")
    + " UNION ALL ".join(f"SELECT '{n}' AS name, '{sev}' AS severity, count(*) AS n FROM ({q})" for n, (sev, q) in REPORT.items()),
)
on_table(
    "audit_warning_summary", "events", lambda d: audit.warning_summary(d.select(F.nullif("event_type", F.lit("view")).alias("kind"))),
    """SELECT coalesce(nullif(event_type, 'view'), 'unknown') AS kind, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, kind LIMIT 15""",
)

# ---- integrity ---------------------------------------------------------------------------------------
_check("int_module", "module_several_names", "number, n_names", "SELECT number, count(DISTINCT name) AS n_names FROM v_module GROUP BY number HAVING count(DISTINCT name) > 1", "module")
_check("int_semester", "semester_two_digit_year", "id", "SELECT id FROM v_semester WHERE year < 100", "semester")
_check("int_course", "course_no_events", "id, name", "SELECT id, name FROM v_course x WHERE NOT EXISTS (SELECT 1 FROM v_course_event l WHERE l.course_id = x.id)", "course", "course_event")
_check("int_event", "event_date_out_of_range", "id", "SELECT id FROM v_event WHERE event_date < DATE '2000-01-01' OR event_date > DATE '2100-01-01'", "event")
_check("int_event_times", "event_start_not_before_end", "id", "SELECT id FROM v_event WHERE start_min >= end_min", "event")
_check("int_location", "location_empty_external_id", "id, name", "SELECT id, name FROM v_location WHERE external_id = ''", "location")
_check("int_building", "building_empty_name", "id", "SELECT id FROM v_building WHERE name = ''", "building")
_check("int_degree", "degree_empty_name", "id", "SELECT id FROM v_degree WHERE name = '' OR name IS NULL", "degree")
_check("int_degree_orphan", "degree_orphan", "id", _none("degree", "module_degree", "degree_id"), "degree", "module_degree")
_check("int_module_empty_name", "module_empty_name", "id", "SELECT id FROM v_module WHERE name = '' OR name IS NULL", "module")
_check("int_module_no_path", "module_no_path", "id", _none("module", "module_path", "module_id"), "module", "module_path")
_check("int_module_no_courses", "module_no_courses", "id", _none("module", "module_course", "module_id"), "module", "module_course")
_check("int_semester_duplicate", "semester_duplicate_name", "name, n", "SELECT name, count(*) AS n FROM v_semester GROUP BY name HAVING count(*) > 1", "semester")
_check("int_course_org_unit", "course_empty_org_unit", "id", "SELECT id FROM v_course WHERE org_unit = ''", "course")
_check("int_course_weekly_hours", "course_zero_weekly_hours", "id", "SELECT id FROM v_course WHERE weekly_hours = 0", "course")
_check("int_event_location", "event_null_location", "id", "SELECT id FROM v_event WHERE location_id IS NULL", "event")
_check("int_location_identity", "location_duplicate_identity", "name, n", "SELECT name, count(*) AS n FROM v_location GROUP BY name, external_id, building_id HAVING count(*) > 1", "location")
_check("int_location_name", "location_empty_name", "id", "SELECT id FROM v_location WHERE name = ''", "location")
_check("int_staff", "staff_empty_name", "id", "SELECT id FROM v_staff WHERE name = '' OR name IS NULL", "staff")


def _dup(key: str, check: str, entity: str, *keys: str) -> None:
    shown = ", ".join(f"CAST({k} AS VARCHAR) AS {k}" if k.endswith("date") else k for k in keys)
    _check(key, check, ", ".join([*keys, "n"]), f"SELECT {shown}, count(*) AS n FROM v_{entity} GROUP BY {', '.join(keys)} HAVING count(*) > 1", entity)


_dup("int_dup_module", "dup_module", "module", "number", "name")
_dup("int_dup_course", "dup_course", "course", "name", "number", "type")
_dup("int_dup_event", "dup_event", "event", "event_date", "start_min", "end_min", "location_id")
_dup("int_dup_exam", "dup_exam", "exam", "module_id", "name", "exam_date", "required")
_dup("int_dup_achievement", "dup_achievement", "achievement", "module_id", "name", "required", "weight")
_dup("int_dup_staff", "dup_staff", "staff", "name")
_dup("int_location_split", "location_name_split", "location", "name")
_check(
    "int_event_shared_modules", "event_shared_modules", "event_id",
    """SELECT event_id FROM v_course_event JOIN v_module_course USING (course_id) GROUP BY event_id HAVING count(DISTINCT module_id) > 1""",
    "course_event", "module_course",
)
_check(
    "int_exam_time_conflict", "exam_time_conflict", "module_id, name, exam_date",
    """SELECT module_id, name, CAST(exam_date AS VARCHAR) AS exam_date FROM v_exam GROUP BY module_id, name, exam_date
       HAVING count(DISTINCT start_min) > 1 OR count(DISTINCT end_min) > 1""", "exam",
)


# ---- snapshot against store --------------------------------------------------------------------------
def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as crawl entries ``number name`` with two semester paths; some renamed, some unknown."""
    module = star_store(spark, sf_dir)["module"].select("id", "number", "name")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("y"))
    name = F.when(F.col("id") % 10 == 0, "Unknown 7").when(F.col("id") % 10 == 1, F.concat("number", F.lit(" New title"))).otherwise(F.concat("number", F.lit("  "), "name"))
    path = F.array(
        F.array(F.lit("Root"), F.concat(F.lit("SoSe "), "y"), F.lit("x")), F.array(F.lit("Root"), F.concat(F.lit("WiSe "), "y"), F.lit("x"))
    )
    return module.join(orders, "id").select("id", name.alias("name"), F.concat(F.lit("u"), "id").alias("url"), path.alias("path"))


SNAP = """, snap AS (SELECT m.id, CASE WHEN m.id % 10 = 0 THEN 'Unknown' ELSE m.number END AS number,
    CASE WHEN m.id % 10 = 0 THEN '7' WHEN m.id % 10 = 1 THEN 'New title' ELSE m.name END AS name, year(o_orderdate) AS y
    FROM v_module m JOIN orders ON o_orderkey = m.id) """
add(
    "audit_snapshot_diff",
    lambda spark, d: audit.snapshot_diff(_snapshot(spark, d), star_store(spark, d)["module"]),
    V("module") + SNAP + """SELECT count(*) AS snapshot_modules, count(*) FILTER (WHERE id % 10 > 1) AS matched,
        count(*) FILTER (WHERE id % 10 = 1) AS renamed, count(*) FILTER (WHERE id % 10 = 0) AS missing FROM snap""",
)
add(
    "rec_coverage",
    lambda spark, d: R.coverage(_snapshot(spark, d), star_store(spark, d)).groupBy("semester", "status").agg(F.count(F.lit(1)).alias("n")),
    V("module", "module_semester") + SNAP + """, e AS (SELECT number, name, concat(t, ' ', y) AS semester FROM snap, (VALUES ('SoSe'), ('WiSe')) AS v(t)),
        keys AS (SELECT DISTINCT number, name FROM v_module),
        links AS (SELECT DISTINCT m.number, m.name, l.semester_id FROM v_module m JOIN v_module_semester l ON l.module_id = m.id)
        SELECT semester, CASE WHEN k.number IS NULL THEN 'missing_module' WHEN l.number IS NULL THEN 'missing_link' ELSE 'linked' END AS status, count(*) AS n
        FROM e LEFT JOIN keys k ON k.number = e.number AND k.name = e.name
        LEFT JOIN links l ON l.number = e.number AND l.name = e.name AND l.semester_id = e.semester GROUP BY 1, 2""",
)
add(
    "rec_semester_links",
    lambda spark, d: R.semester_histograms(_snapshot(spark, d), star_store(spark, d)),
    V("module", "module_semester") + SNAP + """, a AS (SELECT concat(t, ' ', y) AS semester, count(*) AS n FROM snap, (VALUES ('SoSe'), ('WiSe')) AS v(t) GROUP BY 1),
        b AS (SELECT semester_id AS semester, count(*) AS n FROM v_module_semester JOIN v_module ON id = module_id GROUP BY 1)
        SELECT coalesce(a.semester, b.semester) AS semester, coalesce(a.n, 0) AS in_snapshot, coalesce(b.n, 0) AS in_store
        FROM a FULL JOIN b ON a.semester = b.semester""",
)
add(
    "rec_under_linked",
    lambda spark, d: R.under_linked(_snapshot(spark, d), star_store(spark, d)),
    V("module", "module_semester") + SNAP + """, f AS (SELECT number, name, 2 * count(DISTINCT y) AS found FROM snap GROUP BY 1, 2),
        s AS (SELECT number, name, count(DISTINCT semester_id) AS stored FROM v_module JOIN v_module_semester ON module_id = id GROUP BY 1, 2)
        SELECT f.number, f.name, found, coalesce(stored, 0) AS stored FROM f LEFT JOIN s ON s.number = f.number AND s.name = f.name
        WHERE coalesce(stored, 0) < found""",
)


def _retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = star_store(spark, sf_dir)
    stored = store["module_semester"].select(F.col("module_id"), F.array("semester_id").alias("path"))
    one_each = store["module"].groupBy("number", "name").agg(F.min("id").alias("id"))
    return R.path_retention(_snapshot(spark, sf_dir), store.with_tables(module_path=stored, module=one_each))


add(
    "rec_path_retention", _retention,
    V("module", "module_semester") + SNAP + """, f AS (SELECT number, name, 2 * count(DISTINCT y) AS found FROM snap GROUP BY 1, 2),
        s AS (SELECT number, name, 1 AS stored FROM v_module GROUP BY 1, 2)
        SELECT f.number, f.name, found, CAST(coalesce(stored, 0) AS BIGINT) AS stored FROM f LEFT JOIN s ON s.number = f.number AND s.name = f.name""",
)


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = star_store(spark, sf_dir)
    links = store["course_event"].join(store["event"], F.col("event_id") == F.col("id"))
    return links.select("event_date", "start_min", "end_min", F.coalesce("location_id", F.lit("")).alias("room"), F.col("course_id").alias("course"))


SESSION_KEYS = """, k AS (SELECT event_date, start_min, end_min, coalesce(location_id, '') AS room, count(*) AS n_rows, count(DISTINCT course_id) AS n_courses
    FROM v_course_event JOIN v_event ON id = event_id GROUP BY ALL) """
add(
    "rec_event_collision", lambda spark, d: R.event_collisions(R.event_keys(_sessions(spark, d))),
    V("event", "course_event") + SESSION_KEYS + """SELECT CAST(sum(n_rows) AS BIGINT) AS sessions, CAST(coalesce(sum(n_rows) FILTER (WHERE room = ''), 0) AS BIGINT) AS without_room,
        count(*) AS keys, count(*) FILTER (WHERE n_courses > 1) AS shared_keys, count(*) FILTER (WHERE n_courses > 1 AND room = '') AS shared_without_room,
        CAST(sum(n_rows) - count(*) AS BIGINT) AS folded_rows, CAST(coalesce(sum(n_rows - 1) FILTER (WHERE room = ''), 0) AS BIGINT) AS folded_without_room FROM k""",
)
add(
    "rec_event_collision_top", lambda spark, d: R.top_collisions(R.event_keys(_sessions(spark, d))),
    V("event", "course_event") + SESSION_KEYS + """SELECT CAST(event_date AS VARCHAR) AS event_date, start_min, end_min, room, n_rows, n_courses FROM k
        WHERE n_courses > 1 ORDER BY n_courses DESC, k.event_date, start_min, end_min, room LIMIT 15""",
)
on_star(
    "rec_bare_locations", R.events_on_bare_locations,
    V("event", "location") + """SELECT count(*) AS events, count(DISTINCT e.location_id) AS locations FROM v_event e JOIN v_location l ON l.id = e.location_id
        WHERE l.external_id = ''""",
)
