"""List queries: scans, filters, sort, paging, projection, distinct values."""

from __future__ import annotations

from pyspark.sql import functions as F

from syllabary.functions import paths
from syllabary.operators import ordering, relations
from syllabary.operators.aggregates import stats_record, table_counts
from syllabary.operators.schedule import slot_representatives
from syllabary.plans import entities as E
from syllabary.registry.base import add, on_star, on_table
from syllabary.registry.star import table, with_views
from syllabary.sources.readers import filter_snapshot, resume
from syllabary.sources.writers import flat_columns

EVENT = "e.id, e.number, e.name, e.start_min, e.end_min, CAST(e.event_date AS VARCHAR) AS event_date, e.location_id, e.url"


def events_sql(where: str, *views: str) -> str:
    return with_views("event", *views) + f"SELECT {EVENT} FROM v_event e WHERE {where}"


# Distinct pairs, as an EXISTS over the link tables.
COURSE_OF_EVENT = "EXISTS (SELECT 1 FROM v_course_event l JOIN v_course c ON c.id = l.course_id WHERE l.event_id = e.id AND {})"
MODULE_OF_EVENT = """EXISTS (SELECT 1 FROM v_course_event l JOIN v_module_course mc ON mc.course_id = l.course_id
    JOIN v_module m ON m.id = mc.module_id WHERE l.event_id = e.id AND {})"""
CM = ("course_event", "module_course", "module")

# ---- scans and single rows ---------------------------------------------------------------------------
on_star("scan_table", lambda s: s["event"], events_sql("TRUE"))
on_star("get_by_id", lambda s: relations.by_id(s, "event", 42), events_sql("e.id = 42"))

# ---- predicates --------------------------------------------------------------------------------------
on_star("f_in", lambda s: E.where(s, "event", {"location_id": ["L3", "L7", "L11"]}), events_sql("e.location_id IN ('L3', 'L7', 'L11')"))
on_star(
    "f_ilike_any", lambda s: E.where(s, "course", {"name": ["RED", "_old w"]}),
    with_views("course") + "SELECT * FROM v_course WHERE name ILIKE '%RED%' OR name ILIKE '%_old w%'",
)
on_star(
    "f_range", lambda s: E.where(s, "module", {"credits_min": 3, "credits_max": 5}),
    with_views("module") + "SELECT * FROM v_module WHERE credits BETWEEN 3 AND 5",
)
on_star(
    "f_range_nullguard", lambda s: E.where(s, "achievement", {"weight_min": 0.05, "weight_max": 0.07}),
    with_views("achievement") + "SELECT * FROM v_achievement WHERE weight IS NOT NULL AND weight >= 0.05 AND weight <= 0.07",
)
on_star(
    "f_date_in", lambda s: E.where(s, "event", {"date": ["2024-01-03", "2024-01-17"]}),
    events_sql("e.event_date IN (DATE '2024-01-03', DATE '2024-01-17')"),
)
on_star(
    "f_date_range", lambda s: E.where(s, "event", {"date_from": "2024-01-10", "date_to": "2024-01-12"}),
    events_sql("e.event_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'"),
)
on_star(
    "f_time_range", lambda s: E.where(s, "event", {"start_time_from": "09:00", "end_time_to": "13:30"}),
    events_sql("e.start_min >= 540 AND e.end_min <= 810"),
)
on_star(
    "f_time_overlap", lambda s: E.where(s, "event", {"time_overlap": ["10:15", "18:00"]}),
    events_sql("(615 BETWEEN e.start_min AND e.end_min) OR (1080 BETWEEN e.start_min AND e.end_min)"),
)
on_star("f_weekday", lambda s: E.where(s, "event", {"weekday": [0, 4]}), events_sql("isodow(e.event_date) - 1 IN (0, 4)"))
on_star("f_day", lambda s: E.events_in(s, "day", "2024-01-15"), events_sql("e.event_date = DATE '2024-01-15'"))
on_star(
    "f_week", lambda s: E.events_in(s, "week", "2024-01-17"),
    events_sql("e.event_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-21'"),
)
on_star(
    "f_month", lambda s: E.events_in(s, "month", year=2024, month=1),
    events_sql("e.event_date >= DATE '2024-01-01' AND e.event_date < DATE '2024-02-01'"),
)
on_star(
    "f_bool", lambda s: E.where(s, "exam", {"required": True}).select("id", "module_id", "name"),
    with_views("exam") + "SELECT id, module_id, name FROM v_exam WHERE required",
)
on_star(
    "f_accessible", lambda s: E.where(s, "location", {"accessible": True}).select("id", "name", "accessibility"),
    with_views("location") + """SELECT id, name, accessibility FROM v_location
        WHERE lower(trim(accessibility)) = 'ja'
           OR (lower(accessibility) LIKE '%barrierefrei%' AND lower(accessibility) NOT LIKE '%nicht%')""",
)
on_star(
    "f_accessible_false", lambda s: E.where(s, "location", {"accessible": False}).select("id", "name", "accessibility"),
    with_views("location") + """SELECT id, name, accessibility FROM v_location
        WHERE NOT (lower(trim(accessibility)) = 'ja'
           OR (lower(accessibility) LIKE '%barrierefrei%' AND lower(accessibility) NOT LIKE '%nicht%'))""",
)
on_table(
    "f_path_segment", "pages", lambda d: d.where(paths.has_segment(F.split("url", "/"), "en")).select("page_id", "url"),
    "SELECT page_id, url FROM pages WHERE list_contains(string_split(url, '/'), 'en')",
)
on_table(
    "f_path_prefix", "part", lambda d: d.where(paths.has_prefix(F.split("p_name", " "), "red/widget")).select("p_partkey", "p_name"),
    "SELECT p_partkey, p_name FROM part WHERE p_name = 'red widget' OR starts_with(p_name, 'red widget ')",
)
on_table(
    "f_page_kind", "pages",
    lambda d: d.withColumn("lang", F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1)).where("lang = 'en'").select("page_id", "url"),
    "SELECT page_id, url FROM pages WHERE regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) = 'en'",
)


def _snapshot(spark, sf_dir):
    """Documents as crawl snapshot rows: name, url and one path of source and language."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("10-"), F.col("doc_id") % 50, F.lit(" "), F.col("text"))
    return docs.select(name.alias("name"), F.concat(F.lit("d/"), "doc_id").alias("url"), F.array(F.array(F.lit("WiSe 2024"), "source", "lang")).alias("path"))


add(
    "f_snapshot",
    lambda spark, d: filter_snapshot(_snapshot(spark, d), name="^10-1. (the|un)", path="SRC", semester="wise").select("name", "url"),
    """SELECT name, url FROM (
           SELECT concat('10-', doc_id % 50, ' ', text) AS name, concat('d/', doc_id) AS url FROM documents)
       WHERE regexp_matches(name, '^10-1. (the|un)', 'i')""",
)
add(
    "f_resume",
    lambda spark, d: resume(
        table(spark, d, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("url")),
        table(spark, d, "labels").select(F.concat(F.lit("d/"), "doc_id").alias("url")),
    ),
    "SELECT concat('d/', doc_id) AS url FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)

# ---- related-row conditions --------------------------------------------------------------------------
on_star(
    "f_exists_1hop", lambda s: E.where(s, "event", {"course_name": "red"}),
    events_sql(COURSE_OF_EVENT.format("c.name ILIKE '%red%'"), "course_event", "course"),
)
on_star(
    "f_exists_nhop", lambda s: E.where(s, "event", {"module_number": "10-", "building": ["asia", "africa"]}),
    events_sql(
        MODULE_OF_EVENT.format("m.number ILIKE '%10-%'") + """ AND EXISTS (SELECT 1 FROM v_location l JOIN v_building b
            ON b.id = l.building_id WHERE l.id = e.location_id AND b.name IN ('ASIA', 'AFRICA'))""",
        *CM, "location", "building",
    ),
)
on_star(
    "f_exists_3hop",
    lambda s: relations.where_related(s, s["event"], "event", "courses.modules.faculty", lambda t: t["name"] == "EUROPE"),
    events_sql(MODULE_OF_EVENT.format("m.faculty_id = (SELECT id FROM v_faculty WHERE name = 'EUROPE')"), *CM, "faculty"),
)
on_star(
    "f_has", lambda s: E.where(s, "module", {"has_courses": False}),
    with_views("module", "module_course")
    + "SELECT * FROM v_module m WHERE NOT EXISTS (SELECT 1 FROM v_module_course l WHERE l.module_id = m.id)",
)
on_star(
    "f_has_2hop", lambda s: E.where(s, "module", {"has_events": True, "has_achievements": True}).select("id", "name"),
    with_views("module", "module_course", "course_event", "achievement")
    + """SELECT m.id, m.name FROM v_module m WHERE EXISTS (SELECT 1 FROM v_module_course l JOIN v_course_event e
         ON e.course_id = l.course_id WHERE l.module_id = m.id)
         AND EXISTS (SELECT 1 FROM v_achievement a WHERE a.module_id = m.id)""",
)
on_star(
    "f_in_subquery", lambda s: E.where(s, "course", {"type": ["economy", "small"]}),
    with_views("course", "event_type")
    + "SELECT * FROM v_course WHERE type IN (SELECT id FROM v_event_type WHERE name ILIKE '%economy%' OR name ILIKE '%small%')",
)

# ---- list queries with every kind of parameter -------------------------------------------------------
on_star(
    "list_modules",
    lambda s: E.list_rows(s, "module", {"faculty_id": [1, 2], "name": ["urgent", "low"], "credits_min": 2, "staff_id": list(range(0, 40)), "has_courses": True}, sort="credits", order="desc"),
    with_views("module", "module_staff", "module_course")
    + """SELECT * FROM v_module m WHERE faculty_id IN (1, 2) AND (name ILIKE '%urgent%' OR name ILIKE '%low%') AND credits >= 2
         AND EXISTS (SELECT 1 FROM v_module_staff l WHERE l.module_id = m.id AND l.staff_id BETWEEN 0 AND 39)
         AND EXISTS (SELECT 1 FROM v_module_course l WHERE l.module_id = m.id)""",
)
on_star(
    "list_courses",
    lambda s: E.list_rows(s, "course", {"name": "ring", "type_id": ["PROMO", "LARGE"], "weekly_hours_min": 10, "weekly_hours_max": 30, "has_events": True, "module_name": "machinery"}, sort="name"),
    with_views("course", "course_event", "module_course", "module")
    + """SELECT * FROM v_course c WHERE name ILIKE '%ring%' AND type IN ('PROMO', 'LARGE') AND weekly_hours BETWEEN 10 AND 30
         AND EXISTS (SELECT 1 FROM v_course_event l WHERE l.course_id = c.id)
         AND EXISTS (SELECT 1 FROM v_module_course l JOIN v_module m ON m.id = l.module_id
                     WHERE l.course_id = c.id AND m.name ILIKE '%machinery%')""",
)
on_star(
    "list_events",
    lambda s: E.list_rows(s, "event", {"date_from": "2024-01-05", "weekday": [0, 1, 2, 3, 4], "start_time_from": "08:00", "building_id": [1, 2, 3], "course_type": "promo", "staff": "0001"}, sort="event_date"),
    events_sql(
        """e.event_date >= DATE '2024-01-05' AND isodow(e.event_date) <= 5 AND e.start_min >= 480
           AND e.location_id IN (SELECT id FROM v_location WHERE building_id IN (1, 2, 3)) AND """
        + COURSE_OF_EVENT.format("c.type IN (SELECT id FROM v_event_type WHERE name ILIKE '%promo%')")
        + " AND EXISTS (SELECT 1 FROM v_event_staff l JOIN v_staff s ON s.id = l.staff_id WHERE l.event_id = e.id AND s.name ILIKE '%0001%')",
        "location", "course_event", "course", "event_type", "event_staff", "staff",
    ),
)
EXAM = "x.id, x.module_id, x.name, CAST(x.exam_date AS VARCHAR) AS exam_date, x.start_min, x.end_min, x.required, x.staff_id"
on_star(
    "list_exams",
    lambda s: E.list_rows(s, "exam", {"exam_date_from": "1996-01-01", "exam_date_to": "1997-12-31", "start_time_to": "03:00", "required": False, "module_name": "furniture", "staff": "00000007"}),
    with_views("exam", "module", "exam_staff", "staff")
    + f"""SELECT {EXAM} FROM v_exam x JOIN v_module m ON m.id = x.module_id
          WHERE x.exam_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND x.start_min <= 180 AND NOT x.required
          AND m.name ILIKE '%furniture%' AND EXISTS (SELECT 1 FROM v_exam_staff l JOIN v_staff s ON s.id = l.staff_id
              WHERE l.exam_id = x.id AND s.name ILIKE '%00000007%')""",
)
on_star(
    "list_achievements",
    lambda s: E.list_rows(s, "achievement", {"name": "o", "required": True, "weight_max": 0.02, "module_number": "14-"}),
    with_views("achievement", "module")
    + """SELECT a.* FROM v_achievement a JOIN v_module m ON m.id = a.module_id
         WHERE a.name ILIKE '%o%' AND a.required AND a.weight <= 0.02 AND m.number ILIKE '%14-%'""",
)
on_star(
    "list_staff", lambda s: E.list_rows(s, "staff", {"name": "5", "has_events": True, "course_id": list(range(200))}),
    with_views("staff", "event_staff", "course_staff")
    + """SELECT * FROM v_staff s WHERE name ILIKE '%5%' AND EXISTS (SELECT 1 FROM v_event_staff l WHERE l.staff_id = s.id)
         AND EXISTS (SELECT 1 FROM v_course_staff l WHERE l.staff_id = s.id AND l.course_id < 200)""",
)
LOCATION = "id, name, external_id, accessibility, seats, building_id, url"
on_star(
    "list_locations",
    lambda s: E.list_rows(s, "location", {"seats_min": 50, "seats_max": 200, "name": "1", "has_events": True}).select(*LOCATION.split(", ")),
    with_views("location", "event")
    + f"""SELECT {LOCATION} FROM v_location WHERE seats BETWEEN 50 AND 200 AND name ILIKE '%1%'
          AND id IN (SELECT location_id FROM v_event)""",
)
on_star(
    "list_buildings", lambda s: E.list_rows(s, "building", {"location_id": ["L0", "L1", "L5", "L6", "L10"]}),
    with_views("building", "location")
    + "SELECT b.* FROM v_building b JOIN v_location l ON l.building_id = b.id WHERE l.id IN ('L0', 'L1', 'L5', 'L6', 'L10')",
)
on_star(
    "list_faculties", lambda s: E.list_rows(s, "faculty", {"name": ["asia", "euro"]}),
    with_views("faculty") + "SELECT * FROM v_faculty WHERE name ILIKE '%asia%' OR name ILIKE '%euro%'",
)
on_star(
    "list_semesters", lambda s: E.list_rows(s, "semester", {"term": "sose", "year": [1996, 1998]}),
    with_views("semester") + "SELECT * FROM v_semester WHERE term ILIKE '%sose%' AND year IN (1996, 1998)",
)
on_star(
    "list_event_types", lambda s: E.list_rows(s, "event_type", {"name": "m"}),
    with_views("event_type") + "SELECT * FROM v_event_type WHERE name ILIKE '%m%'",
)
on_star(
    "list_statuses", lambda s: E.list_rows(s, "status", {"name": "state"}),
    with_views("status") + "SELECT * FROM v_status WHERE name ILIKE '%state%'",
)
on_star(
    "list_degrees", lambda s: E.list_rows(s, "degree", {"name": "b", "subject": "u"}),
    with_views("degree") + "SELECT * FROM v_degree WHERE name ILIKE '%b%' AND subject ILIKE '%u%'",
)

# ---- date windows ------------------------------------------------------------------------------------
for _key, _window, _where in (
    ("events_today", "today", "e.event_date = DATE '2024-01-17'"),
    ("events_tomorrow", "tomorrow", "e.event_date = DATE '2024-01-18'"),
    ("events_this_week", "this_week", "e.event_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-21'"),
):
    on_star(_key, lambda s, w=_window: E.events_in(s, w, today="2024-01-17"), events_sql(_where))
on_star("events_day", lambda s: E.events_in(s, "day", day="2024-01-09"), events_sql("e.event_date = DATE '2024-01-09'"))
on_star("events_week", lambda s: E.events_in(s, "week", day="2024-01-10"), events_sql("e.event_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'"))
on_star("events_month", lambda s: E.events_in(s, "month", year=2024, month=1), events_sql("e.event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'"))

# ---- rows related to one parent ----------------------------------------------------------------------
on_star(
    "related_rows", lambda s: relations.related_rows(s, "course", "events", 17),
    events_sql("e.id IN (SELECT event_id FROM v_course_event WHERE course_id = 17)", "course_event"),
)
on_star(
    "related_rows_2hop", lambda s: relations.related_rows(s, "staff", "courses.modules", 3).select("id", "name"),
    with_views("module", "module_course", "course_staff")
    + """SELECT id, name FROM v_module WHERE id IN (SELECT mc.module_id FROM v_module_course mc JOIN v_course_staff cs
         ON cs.course_id = mc.course_id WHERE cs.staff_id = 3)""",
)
on_star(
    "related_rows_building", lambda s: relations.related_rows(s, "building", "locations.events", 2),
    events_sql("e.location_id IN (SELECT id FROM v_location WHERE building_id = 2)", "location"),
)

# ---- joins -------------------------------------------------------------------------------------------
on_star(
    "join_semi", lambda s: relations.where_related(s, s["staff"], "staff", "events.location", lambda t: t["building_id"] == 4),
    with_views("staff", "event_staff", "event", "location")
    + """SELECT * FROM v_staff s WHERE EXISTS (SELECT 1 FROM v_event_staff l JOIN v_event e ON e.id = l.event_id
         JOIN v_location o ON o.id = e.location_id WHERE l.staff_id = s.id AND o.building_id = 4)""",
)
add(
    "join_anti",
    lambda spark, d: relations.without_links(
        table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey",
        [(table(spark, d, "lineitem").where("l_shipdate >= '2001-10-01'"), "l_partkey")],
    ),
    """SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey
       AND l_shipdate >= TIMESTAMP '2001-10-01')""",
)
on_star(
    "join_inner_to_one",
    lambda s: relations.inner_to_one(s, s["achievement"], "achievement", "module", lambda t: t["credits"] > 8).select("id", "module_id", "weight"),
    with_views("achievement", "module")
    + "SELECT a.id, a.module_id, a.weight FROM v_achievement a JOIN v_module m ON m.id = a.module_id WHERE m.credits > 8",
)
on_star(
    "join_inner_fanout",
    lambda s: relations.fan_out(s, s["building"], "building", "locations", lambda t: t["seats"] > 100),
    with_views("building", "location") + "SELECT b.* FROM v_building b JOIN v_location l ON l.building_id = b.id WHERE l.seats > 100",
)
SHARED = """SELECT l.{g}, l.{m}, n_members, n_members * (n_members - 1) // 2 AS n_pairs FROM {t} l
    JOIN (SELECT {g}, count(*) AS n_members FROM {t} GROUP BY {g} HAVING count(*) > 1) s ON s.{g} = l.{g}"""
on_star(
    "join_self_pair_1", lambda s: relations.shared_groups(s["course_event"], "event_id", "course_id"),
    with_views("course_event") + SHARED.format(t="v_course_event", g="event_id", m="course_id"),
)
on_star(
    "join_self_pair_2", lambda s: relations.shared_groups(s["module_course"], "course_id", "module_id"),
    with_views("module_course") + SHARED.format(t="v_module_course", g="course_id", m="module_id"),
)


def _shared_through_course(s):
    """Modules that share a course, on each event of that course: the factored form of the third pair query."""
    groups = relations.shared_groups(s["module_course"], "course_id", "module_id")
    events = s["course_event"].groupBy("course_id").agg(F.count(F.lit(1)).alias("n_events"))
    return groups.join(events, "course_id")


on_star(
    "join_self_pair_3", _shared_through_course,
    with_views("module_course", "course_event") + "SELECT p.*, n_events FROM (" + SHARED.format(t="v_module_course", g="course_id", m="module_id")
    + ") p JOIN (SELECT course_id, count(*) AS n_events FROM v_course_event GROUP BY course_id) e ON e.course_id = p.course_id",
)
on_star(
    "pair_partners",
    lambda s: relations.partners(s["course_event"], "event_id", "course_id", E.where(s, "course", {"number": "Brand#7", "name": "red"}).select(F.col("id").alias("course_id"))),
    with_views("course_event", "course")
    + """SELECT a.course_id, b.course_id AS partner, a.event_id FROM v_course_event a JOIN v_course_event b ON b.event_id = a.event_id
         AND b.course_id <> a.course_id JOIN v_course c ON c.id = a.course_id WHERE c.number ILIKE '%Brand#7%' AND c.name ILIKE '%red%'""",
)
on_star(
    "join_m2m", lambda s: relations.linked(s, "module_course", "module", "course").select("module_id", "module_name", "course_id", "course_name"),
    with_views("module_course", "module", "course")
    + """SELECT m.id AS module_id, m.name AS module_name, c.id AS course_id, c.name AS course_name FROM v_module_course l
         JOIN v_module m ON m.id = l.module_id JOIN v_course c ON c.id = l.course_id""",
)
on_star(
    "join_lookup_name",
    lambda s: s["event"].join(s["location"].select(F.col("id").alias("lid"), F.col("name").alias("title")), F.col("location_id") == F.col("lid"), "left").select("id", F.coalesce("title", "name").alias("title")),
    with_views("event", "location") + "SELECT e.id, coalesce(l.name, e.name) AS title FROM v_event e LEFT JOIN v_location l ON l.id = e.location_id",
)

# ---- projection --------------------------------------------------------------------------------------
on_star("project_all", lambda s: E.list_rows(s, "course", sort="name"), with_views("course") + "SELECT * FROM v_course")
on_star(
    "project_fields",
    lambda s: E.list_rows(s, "event", {"weekday": 5}, fields=["name", "event_date", "location.building.name"]).select("event_date", "name", F.col("location.building.name").alias("building")),
    with_views("event", "location", "building")
    + """SELECT CAST(e.event_date AS VARCHAR) AS event_date, e.name, b.name AS building FROM v_event e LEFT JOIN v_location l ON l.id = e.location_id
         LEFT JOIN v_building b ON b.id = l.building_id WHERE isodow(e.event_date) = 6""",
)


def _included(rows):
    """One row per event, from the parts of its list of courses and of their lists of staff."""
    own = F.filter("courses", lambda c: c["part"] == 0)
    parts = rows.select(
        "id", F.col("location.name").alias("location"), F.transform(own, lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"))).alias("_own"),
        F.aggregate(F.transform("courses", lambda c: F.size(c["staff"])), F.lit(0), lambda a, x: a + x).alias("_staff"),
    )
    whole = parts.groupBy("id", "location").agg(F.array_sort(F.flatten(F.collect_list("_own"))).alias("_all"), F.sum("_staff").alias("n_staff"))
    names = F.array_join(F.transform("_all", lambda c: c["name"]), "|")
    return whole.select("id", F.size("_all").alias("n_courses"), names.alias("courses"), "n_staff", "location")


on_star(
    "include_relations",
    lambda s: _included(E.list_rows(s, "event", include=["courses.staff", "location"])),
    with_views("event", "course_event", "course", "course_staff", "location")
    + """, cs AS (SELECT course_id, count(*) AS n FROM v_course_staff GROUP BY course_id),
         ec AS (SELECT l.event_id, CAST(count(*) AS INT) AS n_courses, string_agg(c.name, '|' ORDER BY c.id) AS courses,
                       CAST(sum(coalesce(cs.n, 0)) AS BIGINT) AS n_staff
                FROM v_course_event l JOIN v_course c ON c.id = l.course_id LEFT JOIN cs ON cs.course_id = c.id GROUP BY l.event_id)
         SELECT e.id, coalesce(n_courses, 0) AS n_courses, coalesce(courses, '') AS courses, coalesce(n_staff, 0) AS n_staff, o.name AS location
         FROM v_event e LEFT JOIN ec ON ec.event_id = e.id LEFT JOIN v_location o ON o.id = e.location_id""",
)
on_star(
    "include_fk_only",
    lambda s: E.list_rows(s, "course", include=["type"]).select("id", "name", F.col("type.name").alias("type_name")),
    with_views("course", "event_type") + "SELECT c.id, c.name, t.name AS type_name FROM v_course c LEFT JOIN v_event_type t ON t.id = c.type",
)
on_star(
    "computed_weekday", lambda s: E.with_weekday(s["event"]).select("id", "weekday"),
    with_views("event") + "SELECT id, CAST(coalesce(isodow(event_date) - 1, 0) AS INT) AS weekday FROM v_event",
)

# ---- sort, paging, distinct --------------------------------------------------------------------------
on_star("sort_one", lambda s: E.list_rows(s, "event", {"weekday": 6}, sort="location_id", order="desc"), events_sql("isodow(e.event_date) = 7"))
on_star(
    "page", lambda s: E.list_rows(s, "event", sort="location_id", page=5, page_size=50),
    events_sql("TRUE") + " ORDER BY e.location_id NULLS FIRST, e.id LIMIT 50 OFFSET 200",
)
on_star(
    "page_indexed", lambda s: E.indexed_page(s, "event", E.page_index(s, "event", sort="location_id", order="desc"), 9, 50),
    events_sql("TRUE") + " ORDER BY e.location_id DESC NULLS LAST, e.id LIMIT 50 OFFSET 400",
)
on_star(
    "page_after", lambda s: E.indexed_after(s, "event", E.page_index(s, "event", sort="location_id"), ("L20", 100), 50),
    events_sql("e.location_id > 'L20' OR e.location_id = 'L20' AND e.id > 100") + " ORDER BY e.location_id NULLS FIRST, e.id LIMIT 50",
)
on_star(
    "agg_page_count", lambda s: E.count_rows(s, "event", {"weekday": [1]}, page=2, page_size=50),
    with_views("event") + """SELECT count(*) AS count, 2 AS page, CAST(50 AS BIGINT) AS "limit", CAST(ceil(count(*) / 50.0) AS INT) AS total_pages
        FROM v_event WHERE isodow(event_date) = 2""",
)
on_star(
    "m_ceil_pages", lambda s: E.count_rows(s, "building", {"location_id": [f"L{i}" for i in range(25)]}, page=1, page_size=7),
    with_views("building", "location")
    + """SELECT count(*) AS count, 1 AS page, CAST(7 AS BIGINT) AS "limit", CAST(ceil(count(*) / 7.0) AS INT) AS total_pages
         FROM v_building b JOIN v_location l ON l.building_id = b.id""",
)
on_star(
    "distinct_field", lambda s: E.distinct_field(s, "event", "location_id", "desc"),
    with_views("event") + "SELECT DISTINCT location_id FROM v_event",
)
on_star(
    "limit_sample", lambda s: ordering.sample_rows(E.where(s, "module", {"has_courses": False}), 10),
    with_views("module", "module_course")
    + "SELECT * FROM v_module m WHERE NOT EXISTS (SELECT 1 FROM v_module_course l WHERE l.module_id = m.id) ORDER BY id LIMIT 10",
)
on_star(
    "sort_by_size",
    lambda s: ordering.largest(s["course_event"].groupBy("course_id").agg(F.count(F.lit(1)).alias("n")), "n", 15, "course_id"),
    with_views("course_event") + "SELECT course_id, count(*) AS n FROM v_course_event GROUP BY course_id ORDER BY n DESC, course_id LIMIT 15",
)
on_star(
    "sort_modules", lambda s: s["module"].orderBy("name", "id").select("id", "name"),
    with_views("module") + "SELECT id, name FROM v_module",
)
on_table(
    "export_csv", "events", lambda d: flat_columns(d.select("event_id", F.struct("event_type", "user_id").alias("who"), F.array("event_type").alias("tags"))),
    """SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS who, '["' || event_type || '"]' AS tags FROM events""",
)

# ---- totals ------------------------------------------------------------------------------------------
STAT = (
    "module", "course", "event", "location", "building", "staff", "exam", "achievement", "semester", "faculty", "degree",
    "status", "event_type", "module_course", "course_event", "event_staff", "module_staff", "course_staff", "exam_staff",
    "module_semester", "event_semester", "module_start_semester", "module_degree", "module_path",
)
on_star(
    "agg_stats", lambda s: stats_record({n: s[n] for n in STAT}),
    with_views(*STAT) + "SELECT " + ", ".join(f"(SELECT count(*) FROM v_{n}) AS {n}" for n in STAT),
)
on_star(
    "agg_totals", lambda s: table_counts({n: s[n] for n in STAT[:11]}),
    with_views(*STAT[:11]) + " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n FROM v_{n}" for n in STAT[:11]),
)

# ---- schedule ----------------------------------------------------------------------------------------
SLOTS = """SELECT isodow(e.event_date) - 1 AS w, start_min, end_min, location_id, min(id) AS id FROM v_event e WHERE {} GROUP BY ALL"""
SLOT_ROWS = f"SELECT {EVENT}, CAST(isodow(e.event_date) - 1 AS INT) AS weekday FROM v_event e WHERE e.id IN (SELECT id FROM slots)"
on_star(
    "weekly_slots",
    lambda s: E.weekly_schedule(s, {"building_ids": [0, 1], "semester_id": ["SoSe 1996", "WiSe 1996", "SoSe 1997", "WiSe 1997"]}, split_by_day=True),
    with_views("event", "location", "event_semester") + ", slots AS ("
    + SLOTS.format("""e.location_id IN (SELECT id FROM v_location WHERE building_id IN (0, 1)) AND e.id IN (SELECT event_id FROM v_event_semester
        WHERE semester_id IN ('SoSe 1996', 'WiSe 1996', 'SoSe 1997', 'WiSe 1997'))""") + ") " + SLOT_ROWS,
)
on_star(
    "weekly_slots_all", lambda s: E.weekly_schedule(s, split_by_day=True, sort="start_min"),
    with_views("event") + ", slots AS (" + SLOTS.format("TRUE") + ") " + SLOT_ROWS,
)
on_star(
    "weekly_slots_curriculum", lambda s: E.weekly_schedule(s, {"faculty_ids": [2, 3], "staff_ids": list(range(50)), "weekdays": [0, 1, 2]}, sort="name"),
    with_views("event", "course_event", "module_course", "module", "event_staff") + ", slots AS ("
    + SLOTS.format(MODULE_OF_EVENT.format("m.faculty_id IN (2, 3)")
                   + " AND e.id IN (SELECT event_id FROM v_event_staff WHERE staff_id < 50) AND isodow(e.event_date) <= 3")
    + ") " + SLOT_ROWS,
)
on_star(
    "slot_representatives", lambda s: slot_representatives(s["event"]),
    with_views("event") + "SELECT CAST(isodow(event_date) - 1 AS INT) AS weekday, start_min, end_min, location_id, min(id) AS id FROM v_event GROUP BY ALL",
)
