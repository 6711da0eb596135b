"""Page extraction: on the given pages, and on catalogue pages that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabary.functions import text
from syllabary.plans import reconcile as R
from syllabary.registry.base import add
from syllabary.registry.scalars import _german
from syllabary.registry.star import dealt, star_store, table
from syllabary.sources import pages as P


def given(spark: SparkSession, sf_dir: str, *uses) -> DataFrame:
    return P.elements(table(spark, sf_dir, "pages"), *uses)


def _german_sql(column: str) -> str:
    """The day of a column as the pages write it."""
    names = ", ".join(f"'{m}'" for m in P.dates.MONTHS)
    return f"concat(day({column}), '. ', [{names}][month({column})], '. ', year({column}))"


def _decoded(sql: str) -> str:
    """SQL for the character references that the given pages hold."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        sql = f"replace({sql}, '{name}', '{char}')"
    return sql


def _html(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def course_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per event: a header, a staff field and a session table with one row."""
    e = dealt(table(spark, sf_dir, "events"), "event_id")  # pages are costly to make and read
    room = F.when(F.col("event_type") == "error", F.lit("")).otherwise(
        _html('<a name="appointmentRooms" href="r"><span>Room ', F.col("user_id") % 25, "</span></a>",
              F.when(F.col("user_id") % 4 == 0, _html("<span>Annex ", F.col("user_id") % 3, "</span>")).otherwise("")))
    end = F.when(F.col("event_type") == "view", F.lit("25:10")).otherwise(F.lit("24:00"))
    html = _html(
        "<h1>K", F.col("event_id"), " Course ", F.col("event_type"), '</h1><form><div id="contentlayoutleft"><div class="tbdata"><b>Lehrende:</b> <span>P',
        F.col("user_id"), '; Q</span></div><div class="tbdata"><b>Veranstaltungsart:</b><div>', F.col("event_type"),
        '</div></div></div><div id="contentlayoutright"><div>Termine</div><table><tbody><tr><td>1</td><td name="appointmentDate"><span class="lg:hidden">Datum</span><span>Mo, ',
        _german(), '</span></td><td name="appointmentTimeFrom">', F.date_format("ts", "HH:mm"), '</td><td name="appointmentDateTo">', end,
        '</td><td class="rw-course-room">', room, '</td><td name="appointmentInstructors"><span>P', F.col("user_id"),
        '</span><span>P', F.col("user_id") + 1, '</span></td></tr></tbody></table><table><tbody><tr><td name="examName">Test</td><td name="examDate">Datum ',
        _german(), "</td></tr></tbody></table></div></form>",
    )
    return e.select(F.col("event_id").alias("page_id"), F.concat(F.lit("https://c.example.org/x?PRGNAME=COURSEDETAILS&ARGUMENTS=-N"), "event_id").alias("url"), html.alias("html"))


def module_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per order: fields, requirement lines, an exam row and an achievement row."""
    o = dealt(table(spark, sf_dir, "orders"), "o_orderkey")

    def field(label: str, value: Column) -> Column:
        return _html(f'<div><span class="font-semibold break-all">{label}:</span> <div>', value, "</div></div>")

    wanted = _html("A: ", F.col("o_custkey"), "<br>B (x: y): z<br>free ", F.col("o_orderstatus"))
    slot = F.when(F.col("o_orderstatus") == "P", F.lit("k.Terminbuchung")).when(F.col("o_orderstatus") == "F", _html("am ", _german("o_orderdate"))).otherwise(
        _html("Mi, ", _german("o_orderdate"), ", 08:30 - 10:00"))
    html = _html(
        "<h1>10-", F.col("o_orderkey"), "  Module <b>", F.col("o_orderpriority"), '</b></h1><form><div id="contentlayoutleft">',
        field("Leistungspunkte", _html(F.col("o_custkey") % 30, ",5 LP")), field("Dauer", _html(F.col("o_custkey") % 3, " Semester")),
        field("Teilnahmevoraussetzungen", wanted), field("Neues Feld", F.col("o_orderstatus")),
        '</div><a name="eventLink" href="/x?PRGNAME=COURSEDETAILS&n=', F.col("o_custkey"), '">a</a><a name="eventLink" href="/x?PRGNAME=COURSEDETAILS&n=', F.col("o_custkey"),
        '">b</a><div><div>Modulabschlussprüfungen</div><table><tbody><tr><td class="rw-detail-compulsory"><span class="lg:hidden">Pflicht</span><span>Ja</span></td><td class="rw-detail-exam"><span>Exam  ',
        F.col("o_orderstatus"), '</span></td><td class="rw-detail-date"><span class="lg:hidden">Datum</span><span>', slot,
        '</span></td><td class="rw-detail-instructors"><span>P</span></td></tr></tbody></table></div><table summary="Leistungen"><tbody><tr><td class="rw-detail-reqachieve">Paper ',
        F.col("o_orderstatus"), '</td><td class="rw-detail-compulsory">', F.when(F.col("o_orderstatus") == "O", "Ja").otherwise("Nein"),
        '</td><td class="rw-detail-weight">', F.col("o_custkey") % 5, ",5</td></tr></tbody></table></form>",
    )
    return o.select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("https://c.example.org/x?PRGNAME=MODULEDETAILS&ARGUMENTS=-N"), "o_orderkey").alias("url"), html.alias("html"))


def room_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per supplier: a room with its building."""
    s = table(spark, sf_dir, "supplier")
    html = _html(
        "<h1>Raum</h1><dl><div><dt>Name</dt><dd>", F.col("s_name"), "</dd></div><div><dt>Plätze</dt><dd>", F.col("s_suppkey"),
        '</dd></div><div><dt>Größe (qm)</dt><dd>', F.col("s_nationkey"), ',5</dd></div><div class="py-3"><div class="font-bold">Gebäude</div><div class="sm:grid"><dt>Name</dt><dd>House ',
        F.col("s_nationkey"), '</dd></div><div class="sm:grid"><dt>Adresse</dt><dd>Street ', F.col("s_nationkey"), "<br>City</dd></div></div></dl>",
    )
    return s.select(F.col("s_suppkey").alias("page_id"), F.concat(F.lit("https://c.example.org/x?PRGNAME=ACTION&ARGUMENTS=-A"), "s_suppkey").alias("url"), html.alias("html"))


def _courses(run, *uses):
    return lambda spark, d: run(P.elements(course_pages(spark, d), *uses))


def _modules(run, *uses):
    return lambda spark, d: run(P.elements(module_pages(spark, d), *uses))


def _id() -> Column:
    return F.col("page_id").cast("long").alias("page_id")


add(
    "pages_classify", lambda spark, d: P.kinds(course_pages(spark, d).unionByName(module_pages(spark, d))),
    "SELECT 'COURSEDETAILS' AS kind, count(*) AS n FROM events UNION ALL SELECT 'MODULEDETAILS', count(*) FROM orders",
)
add(
    "pages_header_given", lambda spark, d: P.headers(given(spark, d, P.headers)).select(_id(), "header"),
    # The text of the first h1, each piece between tags trimmed of white space, character references read.
    rf"""WITH h AS (SELECT page_id, regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's') AS inside FROM pages WHERE regexp_matches(html, '<h1[ >]'))
    SELECT page_id, {_decoded("list_reduce(list_transform(regexp_split_to_array(inside, '<[^>]*>'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x, y: x || y)")} AS header FROM h""",
)
add(
    "pages_header", _modules(lambda e: P.headers(e).select(_id(), "number", "name", "malformed"), P.headers),
    "SELECT o_orderkey AS page_id, concat('10-', o_orderkey) AS number, concat('Module', o_orderpriority) AS name, FALSE AS malformed FROM orders",
)
add("pages_links_given", lambda spark, d: P.links(given(spark, d, P.links)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).select(_id(), "n"),
    rf"""SELECT page_id, count(DISTINCT href) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'gs'),
             '<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""")
add(
    "pages_links", _modules(lambda e: P.course_links(e).select(_id(), "href", "text"), P.course_links),
    "SELECT o_orderkey AS page_id, concat('/x?PRGNAME=COURSEDETAILS&n=', o_custkey) AS href, 'a' AS text FROM orders",
)
add(
    "pages_labels", _modules(lambda e: P.module_rows(e).select(_id(), "number", "credits", "duration_semesters", F.element_at("prerequisites", F.lit("A")).alias("a"), F.element_at("prerequisites", F.lit("B (x: y)")).alias("b"), F.element_at("prerequisites", F.lit("allgemein")).alias("general")), P.module_rows),
    """SELECT o_orderkey AS page_id, concat('10-', o_orderkey) AS number, o_custkey % 30 + 0.5 AS credits, CAST(o_custkey % 3 AS INT) AS duration_semesters,
              CAST(o_custkey AS VARCHAR) AS a, 'z' AS b, concat('free ', o_orderstatus) AS general FROM orders""",
)
add(
    "pages_course_labels", _courses(lambda e: P.course_rows(e).select(_id(), "number", "name", "type", F.array_join("staff", "|").alias("staff")), P.course_rows),
    "SELECT event_id AS page_id, concat('K', event_id) AS number, concat('Course ', event_type) AS name, event_type AS type, concat('P', user_id, '|Q') AS staff FROM events",
)
add(
    "pages_sessions", _courses(lambda e: P.sessions(e).select(_id(), "number", "event_date", "start_min", F.coalesce("end_min", F.lit(-1)).alias("end_min"), "room", F.array_join("rooms", "|").alias("rooms"), F.array_join("staff", "|").alias("staff")), P.sessions),
    """SELECT event_id AS page_id, '1' AS number, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, CAST(hour(ts) * 60 + minute(ts) AS INT) AS start_min,
              CASE WHEN event_type = 'view' THEN -1 ELSE 1439 END AS end_min, CASE WHEN event_type = 'error' THEN '' ELSE concat('Room ', user_id % 25) END AS room,
              CASE WHEN event_type = 'error' THEN '' WHEN user_id % 4 = 0 THEN concat('Room ', user_id % 25, '|Annex ', user_id % 3) ELSE concat('Room ', user_id % 25) END AS rooms,
              concat('P', user_id, '|P', user_id + 1) AS staff FROM events""",
)
add(
    "pages_cells", _courses(lambda e: e.where("tag = 'td' and name = 'appointmentInstructors'").select(_id(), F.array_join("cell_values", "|").alias("cell")), P.sessions),
    "SELECT event_id AS page_id, concat('P', user_id, '|P', user_id + 1) AS cell FROM events",
)
add(
    "pages_course_exams", _courses(lambda e: P.course_exams(e).select(_id(), "name", P.dates.german_date(F.col("date_text")).alias("day")), P.course_exams),
    "SELECT event_id AS page_id, 'Test' AS name, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events",
)
add(
    "pages_exams", _modules(lambda e: P.exams(e).select(_id(), "name", "date", F.coalesce("start_min", F.lit(-1)).alias("start_min"), "required"), P.exams),
    """SELECT o_orderkey AS page_id, concat('Exam ', o_orderstatus) AS name, CASE WHEN o_orderstatus = 'O' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date,
              CASE WHEN o_orderstatus = 'O' THEN 510 ELSE -1 END AS start_min, TRUE AS required FROM orders""",
)
add(
    "pages_achievements", _modules(lambda e: P.achievements(e).select(_id(), "name", "required", "weight", "combination"), P.achievements),
    """SELECT o_orderkey AS page_id, concat('Paper ', o_orderstatus) AS name, o_orderstatus = 'O' AS required, o_custkey % 5 + 0.5 AS weight,
              CASE WHEN o_orderstatus = 'O' THEN 'Ja' ELSE 'Nein' END AS combination FROM orders""",
)
add(
    "pages_rooms", lambda spark, d: P.rooms(P.elements(room_pages(spark, d), P.rooms)).select(_id(), "name", "seats", "size", F.col("building.name").alias("building"), F.col("building.address").alias("address")),
    """SELECT s_suppkey AS page_id, s_name AS name, CAST(s_suppkey AS INT) AS seats, s_nationkey + 0.5 AS size, concat('House ', s_nationkey) AS building,
              concat('Street ', s_nationkey, ', City') AS address FROM supplier""",
)


def _room_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").where("s_nationkey < 5").select(text.room_key(F.col("s_name")).alias("key"))
    return P.room_index(P.rooms(P.elements(room_pages(spark, sf_dir), P.rooms)), known).select(_id(), "key")


add("room_page_index", _room_index, "SELECT s_suppkey AS page_id, sha1(lower(s_name)) AS key FROM supplier WHERE s_nationkey >= 5")
add(
    "warning_sink", _modules(lambda e: P.unknown_labels(P.module_labels(e), P.MODULE_LABELS).select("kind", "message", F.col("context")["page_id"].cast("long").alias("page_id")), P.unknown_labels),
    "SELECT 'unknown_label' AS kind, 'Neues Feld' AS message, o_orderkey AS page_id FROM orders",
)

# ---- scans -------------------------------------------------------------------------------------------
add(
    "rec_event_detection", _courses(lambda e: R.event_detection(e).groupBy("verdict").agg(F.sum("raw_rows").alias("raw_rows"), F.sum("kept").alias("kept"), F.sum("null_end").alias("null_end"))),
    "SELECT 'ok' AS verdict, count(*) AS raw_rows, count(*) AS kept, count(*) FILTER (WHERE event_type = 'view') AS null_end FROM events",
)
add(
    "rec_module_capture", _modules(R.module_capture, R.module_capture),
    """SELECT what, CAST(n AS BIGINT) AS n FROM (SELECT 'duplicate_labels' AS what, 0 AS n UNION ALL SELECT 'exam_rows', count(*) FROM orders UNION ALL SELECT 'achievement_rows', count(*) FROM orders
       UNION ALL SELECT 'unreadable_exam_dates', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'exam_raw_rows', count(*) FROM orders
       UNION ALL SELECT 'achievement_raw_rows', count(*) FROM orders UNION ALL SELECT 'changed_fields', 0
       UNION ALL SELECT 'exam_count_mismatches', 0 UNION ALL SELECT 'achievement_count_mismatches', 0)""",
)
add(
    "rec_course_capture", _courses(R.course_capture),
    """SELECT what, CAST(n AS BIGINT) AS n FROM (SELECT 'session_rows' AS what, count(*) AS n FROM events UNION ALL SELECT 'multi_room_rows', count(*) FROM events WHERE event_type <> 'error' AND user_id % 4 = 0 UNION ALL SELECT 'unreadable_dates', 0
       UNION ALL SELECT 'unreadable_times', count(*) FROM events WHERE event_type = 'view' UNION ALL SELECT 'suspect_staff', 0
       UNION ALL SELECT 'changed_fields', 0 UNION ALL SELECT 'course_pages', count(*) FROM events)""",
)
add(
    "rec_room_coverage", _courses(R.room_cells, R.room_cells),
    "SELECT count(*) FILTER (WHERE event_type <> 'error') AS anchored, CAST(0 AS BIGINT) AS free_text FROM events",
)
add(
    "rec_recoverable_rooms",
    lambda spark, d: R.recoverable_locations(
        star_store(spark, d).with_tables(location=table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(" ")).alias("name"), F.when(F.col("s_nationkey") < 10, "").otherwise("x").alias("external_id"))),
        P.rooms(P.elements(room_pages(spark, d), P.rooms))).select("id"),
    "SELECT s_suppkey AS id FROM supplier WHERE s_nationkey < 10",
)
add(
    "rec_prerequisites", _modules(lambda e: R.prerequisite_loss(P.module_labels(e).where("label = 'Teilnahmevoraussetzungen'")).agg(F.count(F.lit(1)).alias("pages"), F.sum("n_lines").alias("lines"), F.sum("colon_lines").alias("colon_lines"), F.sum(F.size("lost_keys")).alias("lost"), F.count_if("swallowed").alias("swallowed")), R.prerequisite_loss),
    "SELECT count(*) AS pages, 3 * count(*) AS lines, 2 * count(*) AS colon_lines, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS swallowed FROM orders",
)
add(
    "rec_text_separators", _modules(lambda e: R.separator_verdicts(P.module_labels(e), F.col("flat")), R.separator_verdicts),
    """SELECT label, verdict, count(*) AS n FROM (SELECT unnest(['Leistungspunkte', 'Dauer', 'Teilnahmevoraussetzungen', 'Neues Feld']) AS label FROM orders) x,
       (SELECT 1) y, LATERAL (SELECT CASE WHEN label = 'Teilnahmevoraussetzungen' THEN 'FLATTENED' ELSE 'OK' END AS verdict) GROUP BY 1, 2""",
)
add(
    "rec_time_values", _courses(lambda e: R.impossible_times(e).select(_id(), "kind", "value", "n"), R.impossible_times),
    "SELECT event_id AS page_id, 'time' AS kind, CASE WHEN event_type = 'view' THEN '25:10' ELSE '24:00' END AS value, CAST(1 AS BIGINT) AS n FROM events",
)
add(
    "rec_anomalies", _modules(lambda e: R.anomalies(e)["exam_dates"].select("n", "value"), R.anomalies),
    rf"""SELECT n, value FROM (SELECT count(*) AS n, concat('am ', {_german_sql("o_orderdate")}) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY value)
         ORDER BY n DESC, value LIMIT 20""",
)
add(
    "rec_fields", _modules(lambda e: R.label_frequencies(P.module_labels(e), P.MODULE_LABELS).select("label", "n", "mapped"), R.label_frequencies),
    """SELECT label, count(*) AS n, label <> 'Neues Feld' AS mapped FROM (SELECT unnest(['Leistungspunkte', 'Dauer', 'Teilnahmevoraussetzungen', 'Neues Feld']) AS label FROM orders) GROUP BY 1""",
)
add(
    "rec_table_shapes", _modules(R.table_shapes, R.table_shapes),
    """SELECT heading, class, count(*) AS n FROM (SELECT unnest([{'h': 'Modulabschlussprüfungen', 'c': 'rw-detail-compulsory'}, {'h': 'Modulabschlussprüfungen', 'c': 'rw-detail-exam'},
           {'h': 'Modulabschlussprüfungen', 'c': 'rw-detail-date'}, {'h': 'Modulabschlussprüfungen', 'c': 'rw-detail-instructors'}, {'h': NULL, 'c': 'rw-detail-reqachieve'},
           {'h': NULL, 'c': 'rw-detail-compulsory'}, {'h': NULL, 'c': 'rw-detail-weight'}]) AS s FROM orders), LATERAL (SELECT s.h AS heading, s.c AS class) GROUP BY 1, 2""",
)
add(
    "rec_course_exams", _courses(lambda e: R.course_exam_dates(e).select("date_text", "n", "pages"), P.course_exams),
    f"SELECT {_german_sql('ts')} AS date_text, count(*) AS n, count(*) AS pages FROM events GROUP BY date_text",
)
