"""Scalar functions over the driver's text, address and date columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from syllabary.functions import dates, paths, text, urls
from syllabary.registry.base import on_star, on_table
from syllabary.registry.star import with_views

on_table(
    "s_single_line", "documents", lambda d: d.select("doc_id", text.single_line(F.col("text")).alias("line")),
    r"SELECT doc_id, trim(regexp_replace(replace(text, chr(160), ' '), '\s+', ' ', 'g')) AS line FROM documents",
)
on_table(
    "s_text_structure", "pages", lambda d: d.select("page_id", F.size(F.split(text.html_lines(F.col("html")), "\n")).cast("long").alias("n_lines"), (F.length(text.html_lines(F.col("html"))) > 0).alias("has_text")),
)
on_table(
    "s_parse_int", "lineitem",
    lambda d: d.select("l_orderkey", text.parse_int(F.concat(F.lit("n "), F.col("l_linenumber") - 4, F.lit(" LP"))).alias("n"), text.parse_int(F.col("l_returnflag")).alias("none")),
    "SELECT l_orderkey, CAST(l_linenumber - 4 AS INT) AS n, 0 AS none FROM lineitem",
)
on_table(
    "s_parse_float", "lineitem",
    lambda d: d.select("l_orderkey", text.parse_float(F.replace(F.concat(F.col("l_discount").cast("string"), F.lit(" LP")), F.lit("."), F.lit(","))).alias("x")),
    "SELECT l_orderkey, l_discount AS x FROM lineitem",
)
on_table(
    "s_header_split", "part", lambda d: d.select("p_partkey", text.split_header(F.col("p_name")).alias("h")).select("p_partkey", "h.number", "h.name"),
    "SELECT p_partkey, split_part(p_name, ' ', 1) AS number, split_part(p_name, ' ', 2) AS name FROM part",
)


def _german(column: str = "ts"):
    name = F.coalesce(*[F.when(F.month(column) == n, F.lit(m)) for m, n in dates.MONTHS.items()])
    return F.concat(F.dayofmonth(column).cast("string"), F.lit(". "), name, F.lit(". "), F.year(column).cast("string"))


on_table(
    "d_german_date", "orders", lambda d: d.select("o_orderkey", dates.german_date(_german("o_orderdate")).alias("day"), dates.german_date(F.concat(F.lit("31. "), F.substring_index(_german("o_orderdate"), " ", -2))).alias("last")),
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
              CASE WHEN month(o_orderdate) IN (1, 3, 5, 7, 8, 10, 12)
                   THEN CAST(make_date(year(o_orderdate), month(o_orderdate), 31) AS VARCHAR) END AS last FROM orders""",
)
on_table(
    "d_time", "lineitem",
    lambda d: d.select("l_orderkey", F.coalesce(dates.clock_minutes(F.concat(F.col("l_linenumber") + 19, F.lit(":"), F.lpad((F.col("l_suppkey") % 60).cast("string"), 2, "0"))), F.lit(-1)).alias("minutes")),
    """SELECT l_orderkey, CAST(CASE WHEN l_linenumber + 19 = 24 THEN 1439 WHEN l_linenumber + 19 > 24 THEN -1
                           ELSE (l_linenumber + 19) * 60 + l_suppkey % 60 END AS INT) AS minutes FROM lineitem""",
)


def _exam(d):
    slot = dates.exam_slot(F.concat(F.lit("Mi, "), F.when(F.col("event_type") == "error", "k.Terminbuchung").otherwise(_german()), F.lit(", "), F.date_format("ts", "HH:mm"), F.lit(" - 23:30")))
    return d.select("event_id", slot.alias("s")).select("event_id", F.col("s.exam_date").alias("exam_date"), F.coalesce("s.start_min", F.lit(-1)).alias("start_min"), F.coalesce("s.end_min", F.lit(-1)).alias("end_min"))


on_table(
    "d_exam_datetime", "events", _exam,
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS exam_date,
              CAST(CASE WHEN event_type = 'error' THEN -1 ELSE hour(ts) * 60 + minute(ts) END AS INT) AS start_min,
              CASE WHEN event_type = 'error' THEN -1 ELSE 1410 END AS end_min FROM events""",
)
on_star(
    "d_semester", lambda s: s["semester"].select("id", dates.semester(F.col("name")).alias("s")).select("id", F.col("s.year").alias("year"), F.col("s.term").alias("term")),
    with_views("semester")
    + r"SELECT id, CAST(regexp_extract(name, '\d{2,4}') AS INT) AS year, substring(name, 1, 4) AS term FROM v_semester",
)
on_table(
    "d_local_ts", "events",
    lambda d: d.select("event_id", F.date_format(dates.utc_stamp(F.to_date("ts"), F.hour("ts") * 60, "Europe/Berlin"), "yyyy-MM-dd HH:mm").alias("utc"), dates.local_stamp(F.to_date("ts"), F.hour("ts") * 60).alias("local")),
    """SELECT event_id, strftime(date_trunc('hour', ts) - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS utc,
              strftime(date_trunc('hour', ts), '%Y%m%dT%H%M%S') AS local FROM events""",
)
on_star(
    "s_faculty_prefix", lambda s: s["module"].select("id", paths.number_prefix(F.col("number")).alias("prefix")),
    with_views("module") + r"SELECT id, CAST(regexp_extract(number, '^A?(\d{2})', 1) AS INT) AS prefix FROM v_module",
)
on_table(
    "s_clean_staff", "documents",
    lambda d: d.select("doc_id", F.array_join(text.clean_staff(F.concat_ws(", ", "source", "lang", "source", F.lit("10:00 - 11:30"), F.lit("ohne Termin"), F.lit("12. Jan. 2024"))), "|").alias("names")),
    "SELECT doc_id, concat(source, '|', lang) AS names FROM documents",
)
on_table(
    "s_split_people", "documents", lambda d: d.select("doc_id", F.array_join(text.split_people(F.concat("source", F.lit(" ;; "), "lang", F.lit(", "))), "|").alias("names")),
    "SELECT doc_id, concat(source, '|', lang) AS names FROM documents",
)
REQUIREMENTS = "concat('A (x: ', lang, '): ', source, chr(10), 'free ', lang, chr(10), 'B: ', doc_id, chr(10), 'A (x: ', lang, '): again')"
on_table(
    "m_prerequisites", "documents",
    lambda d: d.select("doc_id", text.parse_requirements(F.expr(REQUIREMENTS.replace("chr(10)", "'\\n'"))).alias("m"), "lang").select(
        "doc_id", F.element_at("m", F.concat(F.lit("A (x: "), "lang", F.lit(")"))).alias("a"), F.element_at("m", F.lit("B")).alias("b"), F.element_at("m", F.lit("allgemein")).alias("general"), F.size("m").alias("n")),
    "SELECT doc_id, concat(source, ' again') AS a, CAST(doc_id AS VARCHAR) AS b, concat('free ', lang) AS general, 3 AS n FROM documents",
)
on_table(
    "a_normalise_path", "documents",
    lambda d: d.select("doc_id", paths.parse_paths(F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array("lang", "source"))).otherwise(F.to_json(F.array(F.array("lang"), F.array("source"))))).alias("p")).select(
        "doc_id", F.size("p").alias("n_paths"), F.array_join(F.flatten("p"), "/").alias("nodes")),
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS n_paths, concat(lang, '/', source) AS nodes FROM documents",
)
on_table(
    "j_json_type", "documents",
    lambda d: d.select("doc_id", paths.is_flat(F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array("lang", "source"))).otherwise(F.to_json(F.array(F.array("lang"))))).alias("flat")),
    "SELECT doc_id, doc_id % 2 = 0 AS flat FROM documents",
)
on_table(
    "j_json_each", "events", lambda d: d.select("event_id", F.explode(F.from_json("props", "map<string,int>")).alias("key", "value")),
    "SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS INT) AS value FROM events",
)
on_table(
    "a_semesters_of", "orders",
    lambda d: d.select("o_orderkey", F.array_join(paths.semester_nodes(F.array(F.array(F.lit("Root"), F.concat(F.lit("WiSe "), F.year("o_orderdate"))), F.array(F.lit("Root"), F.lit("SoSe 1996")), F.array(F.concat(F.lit("WiSe "), F.year("o_orderdate"))))), ",").alias("semesters")),
    "SELECT o_orderkey, concat('WiSe ', year(o_orderdate), ',SoSe 1996') AS semesters FROM orders",
)
on_table(
    "s_normalise_name", "part", lambda d: d.select("p_partkey", text.normalise_name(F.concat(F.lit(" 12-A-"), "p_size", F.lit("  "), F.upper("p_name"))).alias("a"), text.normalise_name(F.concat(F.lit("P1 "), "p_name")).alias("b")),
    "SELECT p_partkey, p_name AS a, concat('p1 ', p_name) AS b FROM part",
)
on_table(
    "s_normalise_url", "pages",
    lambda d: d.select("page_id", urls.normalise_url(F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("?z=1&ARGUMENTS=-N7&a="), F.col("page_id").cast("string")), "query-sorted").alias("sorted"), urls.normalise_url(F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("?z=1&ARGUMENTS=-N7&a=2")), "ignore-arguments").alias("ignoring")),
    r"""SELECT page_id, concat(regexp_replace(url, '[?#].*$', ''), '?ARGUMENTS=-N7&a=', page_id, '&z=1') AS sorted,
               concat(regexp_replace(url, '[?#].*$', ''), '?z=1&a=2') AS ignoring FROM pages""",
)
on_table("page_key", "pages", lambda d: d.select("page_id", urls.page_key(F.col("url")).alias("key")), "SELECT page_id, sha1(url) AS key FROM pages")
on_table(
    "room_page_key", "part", lambda d: d.select("p_partkey", text.room_key(F.concat(F.lit("  "), F.upper("p_name"), F.lit("  1"))).alias("key")),
    "SELECT p_partkey, sha1(concat(p_name, ' 1')) AS key FROM part",
)
on_table(
    "s_template", "part", lambda d: d.select("p_partkey", text.template("{p_name} – {p_size}{nothing}!", lambda n: F.col(n) if n in d.columns else None).alias("t")),
    "SELECT p_partkey, concat(p_name, ' – ', p_size, '!') AS t FROM part",
)
on_table(
    "s_join_names", "part", lambda d: d.select("p_partkey", text.join_names(F.array("p_name", F.lit(""), "p_type"), " / ").alias("names")),
    "SELECT p_partkey, concat(p_name, ' / ', p_type) AS names FROM part",
)
on_table(
    "j_title_map", "events", lambda d: d.select("event_id", F.element_at(F.from_json("props", "map<string,int>"), "k").alias("k"), F.from_json(F.lit("not json"), "map<string,int>").isNull().alias("bad")),
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, TRUE AS bad FROM events",
)
