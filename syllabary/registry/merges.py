"""Load merges, aggregations, set operations.

The load runs on one nested record per line item: the order is the module, the part its course, the
shipment its session, exam and achievement. Orders share customers and parts, so keys repeat and merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syllabary.functions import dates
from syllabary.operators import aggregates as A
from syllabary.operators import relations
from syllabary.operators.concat import joined_in_parts
from syllabary.operators.schedule import are_weekly
from syllabary.plans import load as L
from syllabary.registry.base import add, on_star, on_table
from syllabary.registry.star import dealt, table, with_views
from syllabary.session import checkpointed
from syllabary.store import Store

SEMESTER = "concat(CASE WHEN month({0}) BETWEEN 4 AND 9 THEN 'SoSe ' ELSE 'WiSe ' END, year({0}))"

# The flat content of the records, in SQL that Spark and DuckDB read alike.
FLAT = f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           concat(o_orderpriority, ' ', o_orderstatus) AS m_name, concat('1', o_custkey % 10, '-', o_custkey) AS m_number,
           concat('1', o_custkey % 10, ' - ', o_orderstatus, o_custkey % 10) AS m_faculty,
           {SEMESTER.format('o_orderdate')} AS m_semester, {SEMESTER.format('l_shipdate')} AS m_start,
           CASE WHEN l_returnflag = 'N' THEN '' ELSE concat(l_returnflag, l_linenumber) END AS m_frequency,
           CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_quantity END AS m_credits,
           s_name AS person, p_name AS c_name, p_brand AS c_number, p_type AS c_type,
           CASE WHEN l_linestatus = 'O' THEN '' ELSE concat('lang', l_suppkey % 3) END AS c_language,
           CAST(p_size % 4 AS INT) AS c_hours, CAST(l_shipdate AS DATE) AS e_date,
           CAST(480 + (l_suppkey % 5) * 120 AS INT) AS e_start, CAST(570 + (l_suppkey % 5) * 120 AS INT) AS e_end,
           CASE WHEN l_returnflag = 'A' THEN NULL ELSE concat('Room ', l_suppkey % 40) END AS e_room,
           concat('House ', l_suppkey % 4) AS e_house, CAST(l_linenumber * 10 AS INT) AS e_seats,
           l_linestatus = 'F' AS x_required, l_returnflag AS x_name, l_discount AS a_weight
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
    JOIN supplier ON s_suppkey = l_suppkey"""

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
WITH_SEQ = f"WITH f AS (SELECT *, row_number() OVER (ORDER BY {', '.join(ORDER)}) AS seq FROM ({FLAT})) "


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from syllabary.registry.star import _bind

    names = ("lineitem", "orders", "part", "supplier")
    tables = {n: table(spark, sf_dir, n) for n in names}
    # Dealt by the key of the first join, whatever the size: the records are made row by row.
    tables["lineitem"] = dealt(tables["lineitem"], "l_orderkey")
    return spark.sql(_bind(FLAT), **tables)


def _typed(fields: dict[str, Column], schema: T.StructType) -> Column:
    """A struct of the schema; fields without a value are null, as if absent from a JSON line."""
    return F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records as JSON lines would give them: fields without a value are null. They are made as typed columns, so
    that a merge makes and reads only the fields that it asks for."""
    module = T.StructType.fromDDL(L.MODULE_DDL)
    course, exam, achievement = (module[n].dataType.elementType for n in ("courses", "exams", "achievements"))
    event = course["events"].dataType.elementType
    place = event["location"].dataType
    f, staff = F.col, F.array("person")
    house = _typed({"name": f("e_house")}, place["building"].dataType)
    room = F.when(f("e_room").isNotNull(), _typed({"name": f("e_room"), "seats": f("e_seats"), "building": house}, place))
    slot = {"start_min": f("e_start"), "end_min": f("e_end"), "staff": staff}
    session = _typed({"number": f("l_linenumber"), "event_date": f("e_date"), **slot, "location": room}, event)
    taught = {
        "name": f("c_name"), "number": f("c_number"), "staff": staff, "type": f("c_type"), "weekly_hours": f("c_hours"),
        "language": f("c_language"), "events": F.array(session),
    }
    written = {"name": f("x_name"), "required": f("x_required")}
    fields = {
        "name": f("m_name"), "number": f("m_number"),
        "path": F.array(F.array(F.lit("Root"), f("m_semester"), f("m_faculty"), f("c_type"))),
        "responsible_person": F.concat("person", F.lit("; Prof. "), f("person")),
        "credits": f("m_credits"), "start_semester": f("m_start"), "frequency": f("m_frequency"),
        "prerequisites": F.create_map(F.lit("p"), f("person")), "courses": F.array(_typed(taught, course)),
        "exams": F.array(_typed({**written, "date": f("e_date"), **slot}, exam)),
        "achievements": F.array(_typed({**written, "weight": f("a_weight"), "combination": f("c_type")}, achievement)),
        "url": F.concat(F.lit("m/"), f("l_orderkey")),
    }
    lines = flat(spark, sf_dir)
    return lines.select(F.struct(*ORDER).alias("seq"), *[fields.get(c.name, F.lit(None)).cast(c.dataType).alias(c.name) for c in module])


def loaded(spark: SparkSession, sf_dir: str) -> Store:
    # The records come from columns and each query asks for few tables, so a written copy of all fields would cost more.
    return L.load(records(spark, sf_dir), once=False)[0]


def _load(key: str, run, sql: str) -> None:
    add(key, lambda spark, d: run(loaded(spark, d)), WITH_SEQ + sql)


def _named(store: Store, df: DataFrame, column: str, entity: str, *names: str) -> DataFrame:
    """Replace a digest key by readable columns of its row. Keys travel as bytes."""
    target = store[entity].select(F.unhex("id").alias("_t"), *[F.col(n).alias(f"{entity}_{n}") for n in names])
    keyed = df if dict(df.dtypes)[column] == "binary" else df.withColumn(column, F.unhex(column))
    return keyed.join(target, F.col(column) == F.col("_t"), "left").drop("_t", column)


def _bytes(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unhex(c) for c in columns})


FIRST = "arg_min({0}, seq) FILTER (WHERE {0} IS NOT NULL AND {0} <> {1})"
MODE = """(SELECT {k}, arg_min({v}, rank) AS {v} FROM (SELECT {k}, {v}, row_number() OVER (PARTITION BY {k}
    ORDER BY count(*) DESC, min(seq)) AS rank FROM {src} GROUP BY {k}, {v}) GROUP BY {k})"""

_load(
    "er_lookup_dim",
    lambda s: s["staff"].select(F.lit("staff").alias("kind"), "name").unionByName(s["event_type"].select(F.lit("event_type").alias("kind"), "name")).unionByName(
        s["status"].select(F.lit("status").alias("kind"), "name")),
    """SELECT 'staff' AS kind, person AS name FROM f UNION SELECT 'staff', concat('Prof. ', person) FROM f
       UNION SELECT 'event_type', c_type FROM f UNION SELECT 'status', '' FROM f""",
)
_load("er_faculty", lambda s: s["faculty"].select("name", "prefix"), "SELECT DISTINCT m_faculty AS name, CAST(substring(m_faculty, 1, 2) AS INT) AS prefix FROM f")
_load(
    "er_semester", lambda s: s["semester"].select("name", "year", "term"),
    """SELECT name, CAST(substring(name, 6) AS INT) AS year, substring(name, 1, 4) AS term
       FROM (SELECT m_semester AS name FROM f UNION SELECT m_start FROM f)""",
)
_load("er_building", lambda s: s["building"].select("name", "short_name", "address"), "SELECT DISTINCT e_house AS name, '' AS short_name, '' AS address FROM f WHERE e_room IS NOT NULL")
_load(
    "er_location", lambda s: _named(s, s["location"].drop("id"), "building_id", "building", "name").select("name", "external_id", "seats", "building_name"),
    "SELECT e_room AS name, '' AS external_id, arg_min(e_seats, seq) AS seats, e_house AS building_name FROM f WHERE e_room IS NOT NULL GROUP BY e_room, e_house",
)
_load(
    "er_module",
    lambda s: _named(s, s["module"], "faculty_id", "faculty", "prefix").select("number", "name", "frequency", "credits", "url", "language", F.col("faculty_prefix").alias("prefix"), F.col("prerequisites")["p"].alias("prerequisite")),
    f"""SELECT g.number, g.name, frequency, credits, url, coalesce(language, '') AS language, CAST(substring(g.number, 1, 2) AS INT) AS prefix, prerequisite
        FROM (SELECT m_number AS number, m_name AS name, coalesce({FIRST.format("m_frequency", "''")}, '') AS frequency,
                     coalesce({FIRST.format("m_credits", "0")}, 0) AS credits, concat('m/', arg_min(l_orderkey, seq)) AS url,
                     arg_min(person, seq) AS prerequisite FROM f GROUP BY ALL) g
        LEFT JOIN (SELECT m_number, m_name, arg_min(c_language, rank) AS language FROM (
            SELECT m_number, m_name, c_language, row_number() OVER (PARTITION BY m_number, m_name ORDER BY count(*) DESC, min(seq)) AS rank
            FROM f WHERE c_language <> '' GROUP BY m_number, m_name, c_language) GROUP BY m_number, m_name) lang
          ON lang.m_number = g.number AND lang.m_name = g.name""",
)
_load(
    "er_module_faculty", lambda s: _named(s, s["module"], "faculty_id", "faculty", "prefix").select("number", "name", F.col("faculty_prefix").alias("prefix")),
    "SELECT DISTINCT m_number AS number, m_name AS name, CAST(substring(m_number, 1, 2) AS INT) AS prefix FROM f",
)
_load(
    "set_path_union",
    lambda s: _named(s, s["module_path"], "module_id", "module", "number", "name").select("module_number", "module_name", F.array_join("path", "/").alias("path")),
    "SELECT DISTINCT m_number AS module_number, m_name AS module_name, concat('Root/', m_semester, '/', m_faculty, '/', c_type) AS path FROM f",
)
_load(
    "er_course",
    lambda s: _named(s, s["course"], "type", "event_type", "name").select("name", "number", F.col("event_type_name").alias("type"), "language", "weekly_hours", "weekday"),
    f"""SELECT g.name, g.number, g.type, language, weekly_hours, weekday FROM (
            SELECT c_name AS name, c_number AS number, c_type AS type, coalesce({FIRST.format("c_language", "''")}, '') AS language,
                   coalesce({FIRST.format("c_hours", "0")}, 0) AS weekly_hours FROM f GROUP BY ALL) g
        JOIN (SELECT c_name, c_number, c_type, CAST(arg_min(w, rank) AS INT) AS weekday FROM (
            SELECT c_name, c_number, c_type, isodow(e_date) AS w, row_number() OVER (PARTITION BY c_name, c_number, c_type
                   ORDER BY count(*) DESC, min(seq)) AS rank FROM f GROUP BY c_name, c_number, c_type, isodow(e_date))
            GROUP BY c_name, c_number, c_type) d ON d.c_name = g.name AND d.c_number = g.number AND d.c_type = g.type""",
)
EVENT_KEY = "e_date, e_start, e_end, e_room, e_house, CASE WHEN e_room IS NULL THEN concat(c_name, '|', c_number, '|', c_type) END"
_load(
    "er_event",
    lambda s: _named(s, s["event"], "location_id", "location", "name").select("event_date", "start_min", "end_min", "location_name", "number"),
    f"""SELECT CAST(e_date AS VARCHAR) AS event_date, e_start AS start_min, e_end AS end_min, e_room AS location_name,
               CAST(arg_min(l_linenumber, seq) AS VARCHAR) AS number
        FROM (SELECT * REPLACE (CASE WHEN e_room IS NULL THEN NULL ELSE e_house END AS e_house) FROM f) GROUP BY {EVENT_KEY}""",
)
_load(
    "er_exam",
    lambda s: _named(s, s["exam"], "module_id", "module", "number", "name").select("module_number", "module_name", "name", "exam_date", "required", "start_min", "end_min"),
    """SELECT m_number AS module_number, m_name AS module_name, x_name AS name, CAST(e_date AS VARCHAR) AS exam_date, x_required AS required,
              arg_min(e_start, seq) AS start_min, arg_min(e_end, seq) AS end_min FROM f GROUP BY m_number, m_name, x_name, e_date, x_required""",
)
_load(
    "er_achievement",
    lambda s: _named(s, s["achievement"], "module_id", "module", "number", "name").select("module_number", "module_name", "name", "required", "weight", "combination"),
    """SELECT m_number AS module_number, m_name AS module_name, x_name AS name, x_required AS required, a_weight AS weight,
              arg_min(c_type, seq) AS combination FROM f GROUP BY m_number, m_name, x_name, x_required, a_weight""",
)
_load(
    "er_responsible",
    lambda s: _named(s, _named(s, _bytes(s["module_staff"], "module_id", "staff_id"), "module_id", "module", "number", "name"), "staff_id", "staff", "name"),
    """SELECT DISTINCT m_number AS module_number, m_name AS module_name, person AS staff_name FROM f
       UNION SELECT DISTINCT m_number, m_name, concat('Prof. ', person) FROM f""",
)


def _key(*parts: str) -> str:
    """The digest of a natural key in SQL."""
    return "md5(concat_ws(chr(31), " + ", ".join(f"coalesce('=' || CAST({p} AS VARCHAR), '-')" for p in parts) + "))"


M_KEY, C_KEY, P_KEY = _key("m_number", "m_name"), _key("c_name", "c_number", "c_type"), _key("person")
ROOM_KEY = f"CASE WHEN e_room IS NOT NULL THEN {_key('e_room', repr(''), _key('e_house', repr(''), repr('')))} END"
E_KEY = _key("e_date", "e_start", "e_end", f"({ROOM_KEY})", f"(CASE WHEN e_room IS NULL THEN {C_KEY} END)")
X_KEY = _key(M_KEY, "x_name", "x_required", "e_date")
LINK_ENDS = {
    "module_staff": (M_KEY, P_KEY), "module_course": (M_KEY, C_KEY), "course_staff": (C_KEY, P_KEY), "course_event": (C_KEY, E_KEY),
    "event_staff": (E_KEY, P_KEY), "exam_staff": (X_KEY, P_KEY), "module_semester": (M_KEY, _key("m_semester")),
    "module_start_semester": (M_KEY, _key("m_start")), "course_semester": (C_KEY, _key("m_semester")),
    "event_semester": (E_KEY, _key("m_semester")), "exam_semester": (X_KEY, _key("m_semester")),
}
SEMESTER_LINKS = ("module_semester", "course_semester", "event_semester", "exam_semester")


def _links_sql(*names: str) -> str:
    parts = [f"SELECT DISTINCT '{n}' AS link, {LINK_ENDS[n][0]} AS near, {LINK_ENDS[n][1]} AS far FROM f" for n in names]
    if "module_staff" in names:
        parts.append(f"SELECT DISTINCT 'module_staff', {M_KEY}, {_key("concat('Prof. ', person)")} FROM f")
    return " UNION ALL ".join(parts)


add("er_links", lambda spark, d: L.linked(L.stage(records(spark, d)), *LINK_ENDS), WITH_SEQ + _links_sql(*LINK_ENDS))
add("er_semester_links", lambda spark, d: L.linked(L.stage(records(spark, d)), *SEMESTER_LINKS), WITH_SEQ + _links_sql(*SEMESTER_LINKS))
_load(
    "er_derived",
    lambda s: s["course"].select("id", F.lit("weekday").alias("what"), F.col("weekday").cast("string").alias("value")).unionByName(
        s["module"].select("id", F.lit("language").alias("what"), F.col("language").alias("value"))),
    f"""SELECT id, 'weekday' AS what, CAST(arg_min(w, rank) AS VARCHAR) AS value FROM (
           SELECT {C_KEY} AS id, CAST(isodow(e_date) AS INT) AS w, row_number() OVER (PARTITION BY {C_KEY} ORDER BY count(*) DESC, min(seq)) AS rank
           FROM f GROUP BY {C_KEY}, isodow(e_date)) GROUP BY id
       UNION ALL
       SELECT m.id, 'language', coalesce(v, '') FROM (SELECT DISTINCT {M_KEY} AS id FROM f) m LEFT JOIN (
           SELECT id, arg_min(c_language, rank) AS v FROM (
               SELECT {M_KEY} AS id, c_language, row_number() OVER (PARTITION BY {M_KEY} ORDER BY count(*) DESC, min(seq)) AS rank
               FROM f WHERE c_language <> '' GROUP BY {M_KEY}, c_language) GROUP BY id) l ON l.id = m.id""",
)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second load of everything adds to a first load of the first half of the years."""
    rows = checkpointed(records(spark, sf_dir))  # both loads read them from there
    first = rows.where(F.col("courses")[0]["events"][0]["event_date"] < F.lit("1998-01-01").cast("date"))
    return L.insert_counts(L.load(rows, once=False)[0], L.load(first, once=False)[0])


add(
    "er_insert_counts", _counts,
    WITH_SEQ + """, g AS (SELECT * REPLACE (CASE WHEN e_room IS NULL THEN NULL ELSE e_house END AS e_house) FROM f), """
    + ", ".join(
        f"n{i} AS (SELECT count(*) AS n FROM (SELECT DISTINCT {k} FROM g EXCEPT SELECT DISTINCT {k} FROM g WHERE e_date < DATE '1998-01-01'))"
        for i, k in enumerate(("m_number, m_name", "c_name, c_number, c_type", EVENT_KEY, "m_number, m_name, x_name, e_date, x_required"))
    )
    + """ SELECT (SELECT n FROM n0) AS modules, (SELECT n FROM n1) AS courses,
                 CAST((SELECT n FROM n2) + (SELECT n FROM n3) AS BIGINT) AS events""",
)


def _rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose time is unknown (every shipment of one supplier group) go to the reject table."""
    rows = records(spark, sf_dir)
    cut = F.transform("courses", lambda c: c.withField("events", F.transform(c["events"], lambda e: e.withField(
        "start_min", F.when(e["start_min"] != 480, e["start_min"])))))
    return L.stage(rows.withColumn("courses", cut))["rejects"].select("kind", F.col("context")["event_date"].alias("event_date"))


add("er_reject", _rejects, WITH_SEQ + "SELECT 'event_incomplete' AS kind, CAST(e_date AS VARCHAR) AS event_date FROM f WHERE e_start = 480")
add(
    "er_module_set",
    lambda spark, d: L.module_set(records(spark, d).select("name", F.col("number").alias("url"), "path")).select("name", "url", F.array_join("group", "/").alias("path")),
    WITH_SEQ + "SELECT DISTINCT m_name AS name, m_number AS url, concat('Root/', m_semester, '/', m_faculty, '/', c_type) AS path FROM f",
)


# ---- aggregations and order-dependent picks ----------------------------------------------------------
on_table(
    "agg_having_distinct", "part", lambda d: A.having_several(d, ["p_name"], "p_brand"),
    "SELECT p_name, count(DISTINCT p_brand) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1",
)
on_table(
    "agg_dup_groups", "lineitem", lambda d: A.duplicate_groups(d, ["l_orderkey", "l_partkey"]),
    "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
on_table(
    "agg_distinct_or", "lineitem", lambda d: A.having_several(d, ["l_orderkey", "l_linenumber"], "l_suppkey", "l_returnflag").select("l_orderkey", "l_linenumber"),
    """SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2
       HAVING count(DISTINCT l_suppkey) > 1 OR count(DISTINCT l_returnflag) > 1""",
)
on_table(
    "agg_group_concat", "part", lambda d: d.groupBy("p_name").agg(A.joined_values("p_type").alias("kinds")),
    "SELECT p_name, string_agg(p_type, ' | ' ORDER BY p_type) AS kinds FROM (SELECT DISTINCT p_name, p_type FROM part) GROUP BY p_name",
)
on_table(
    "agg_group_concat_parts", "lineitem",
    lambda d: joined_in_parts(d.withColumn("day", F.col("l_shipdate").cast("date").cast("string")), ["l_returnflag"], "day", limit=4000, name="days"),
    """SELECT l_returnflag, CAST(floor(ahead / 4000) AS BIGINT) + 1 AS part, string_agg(day, ' | ' ORDER BY day) AS days FROM (
           SELECT l_returnflag, day, coalesce(sum(length(day) + 3) OVER (PARTITION BY l_returnflag ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
           FROM (SELECT DISTINCT l_returnflag, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day FROM lineitem)) GROUP BY 1, 2""",
)
on_table(
    "agg_group_sample", "events", lambda d: A.counter(d.where("event_type = 'error'"), "user_id"),
    "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id",
)
on_table(
    "agg_mode", "events", lambda d: A.mode_per_key(d, ["user_id"], "event_type", ["ts", "event_id"]),
    """SELECT user_id, arg_min(event_type, rank) AS event_type FROM (SELECT user_id, event_type, row_number() OVER (
           PARTITION BY user_id ORDER BY count(*) DESC, min(struct_pack(t := ts, i := event_id))) AS rank FROM events GROUP BY user_id, event_type) GROUP BY user_id""",
)
on_table("agg_counter", "documents", lambda d: A.counter(d, "source", "lang"), "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
on_table(
    "agg_topk_counter", "lineitem", lambda d: A.top_counter(d, "l_partkey", 15),
    "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 15",
)
on_table(
    "agg_distinct_count", "lineitem", lambda d: d.agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers")),
    "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem",
)
on_table(
    "win_first_per_key", "lineitem",
    lambda d: A.first_per_key(d.select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_extendedprice"), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]).drop("l_shipdate"),
    """SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (
           PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1""",
)
on_star(
    "win_gap_check",
    lambda s: are_weekly(s["event"], ["start_min", "location_id"], "event_date"),
    with_views("event")
    + """SELECT start_min, location_id, count(DISTINCT isodow(event_date)) = 1 AS weekly, CAST(min(event_date) AS VARCHAR) AS first_day,
         CAST(max(event_date) AS VARCHAR) AS last_day FROM v_event GROUP BY 1, 2""",
)
on_star(
    "win_preferred_first",
    lambda s: s["course_event"].join(s["course"].select(F.col("id").alias("course_id"), "number"), "course_id").groupBy("event_id").agg(
        F.min_by("course_id", F.struct(~F.col("number").startswith("Brand#1"), F.col("course_id"))).alias("course_id")),
    with_views("course_event", "course")
    + """SELECT event_id, course_id FROM (SELECT event_id, course_id, row_number() OVER (PARTITION BY event_id
         ORDER BY CASE WHEN starts_with(number, 'Brand#1') THEN 0 ELSE 1 END, course_id) AS r FROM v_course_event JOIN v_course ON id = course_id) WHERE r = 1""",
)
add(
    "set_difference",
    lambda spark, d: relations.missing_from(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"]),
    "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
)
on_table(
    "set_dedup_ordered", "documents", lambda d: d.select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words")),
    """SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM (
           SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w,
               generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) GROUP BY doc_id, w) GROUP BY doc_id""",
)


def _dates_missing(d: DataFrame) -> DataFrame:
    """Per user and weekday: weeks between the first and last event in which there was none."""
    days = d.select("user_id", F.to_date("ts").alias("day")).withColumn("weekday", F.weekday("day"))
    spans = days.groupBy("user_id", "weekday").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.collect_set("day").alias("seen"))
    missing: Column = F.array_except(dates.weekly_dates(F.col("a"), F.col("b")), "seen")
    return spans.select("user_id", "weekday", F.size(missing).cast("long").alias("n_missing"))


on_table(
    "set_dates_missing", "events", _dates_missing,
    """SELECT user_id, CAST(isodow(d) - 1 AS INT) AS weekday, CAST(date_diff('day', min(d), max(d)) / 7 + 1 - count(DISTINCT d) AS BIGINT) AS n_missing
       FROM (SELECT user_id, CAST(ts AS DATE) AS d FROM events) GROUP BY 1, 2""",
)
