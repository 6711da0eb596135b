"""The driver's tables read as a catalogue, in Spark and (as a WITH prefix) in plain SQL.

orders are modules, parts are courses, suppliers are staff, nations are locations, regions are
buildings and faculties, line items are links, exams and achievements, and events are events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabary.session import configure
from syllabary.store import Store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` by a key, for work in Python or JSON on each row: in a number of parts that the session gives and no
    adaptive plan merges, as it only sees few bytes."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, key)


# The tables themselves are without faults, so some of their rows come a second time under ids above FAULTY: as modules,
# courses, events, rooms, people and terms that break a rule each. They are added, and no row is left out.
FAULTY = 100_000_000

# name -> SELECT over the driver's tables, in SQL that Spark and DuckDB read alike.
VIEWS: dict[str, str] = {
    "event": f"""
        SELECT event_id AS id,
               CASE WHEN event_id % 9 = 0 THEN concat('Brand#', event_id % 25, '-', event_type) ELSE event_type END AS number, concat(event_type, ' ', user_id % 7) AS name,
               CAST(hour(ts) * 60 AS INT) AS start_min, CAST(hour(ts) * 60 + 90 AS INT) AS end_min,
               CAST(ts AS DATE) AS event_date,
               CASE WHEN event_type = 'error' THEN NULL ELSE concat('L', user_id % 25) END AS location_id,
               '' AS url
        FROM events
        UNION ALL
        SELECT event_id + {FAULTY} AS id, event_type AS number, 'backwards' AS name, CAST(600 AS INT) AS start_min,
               CAST(540 AS INT) AS end_min,
               CASE WHEN event_id % 2 = 0 THEN DATE '1999-12-31' ELSE CAST(ts AS DATE) END AS event_date,
               CAST(NULL AS STRING) AS location_id, '' AS url
        FROM events WHERE event_id % 199 = 0""",
    "location": """
        SELECT concat('L', n_nationkey) AS id, n_name AS name,
               CASE WHEN n_regionkey < 2 THEN '' ELSE concat('R', n_nationkey) END AS external_id,
               CASE WHEN n_regionkey = 0 THEN 'Ja' WHEN n_regionkey = 1 THEN 'nicht barrierefrei'
                    WHEN n_regionkey = 2 THEN 'barrierefrei' ELSE '' END AS accessibility,
               CAST(n_nationkey * 10 AS INT) AS seats, n_regionkey AS building_id, '' AS url
        FROM nation
        UNION ALL
        SELECT concat('X', n_nationkey) AS id, n_name AS name, '' AS external_id, '' AS accessibility,
               CAST(0 AS INT) AS seats, CAST(NULL AS INT) AS building_id, '' AS url
        FROM nation WHERE n_nationkey < 3
        UNION ALL
        SELECT concat('Y', n_nationkey) AS id, '' AS name, '' AS external_id, '' AS accessibility,
               CAST(0 AS INT) AS seats, CAST(NULL AS INT) AS building_id, '' AS url
        FROM nation WHERE n_nationkey < 2""",
    "building": """
        SELECT r_regionkey AS id, r_name AS name, '' AS short_name, lower(r_name) AS address FROM region
        UNION ALL
        SELECT CAST(r_regionkey + 100 AS INT) AS id, '' AS name, '' AS short_name, '' AS address FROM region WHERE r_regionkey = 0""",
    "faculty": "SELECT r_regionkey AS id, r_name AS name, CAST(r_regionkey AS INT) AS prefix FROM region",
    "module": f"""
        SELECT o_orderkey AS id, concat(c_mktsegment, ' ', o_orderpriority) AS name,
               concat('1', n_regionkey, '-', o_custkey) AS number,
               CAST(floor(o_totalprice / 50000) AS DOUBLE) AS credits, n_regionkey AS faculty_id,
               CAST(1 + o_orderkey % 3 AS INT) AS duration_semesters
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
        UNION ALL
        SELECT o_orderkey + {FAULTY} AS id, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'Draft' END AS name,
               concat('99-', o_custkey) AS number, CAST(0 AS DOUBLE) AS credits, CAST(NULL AS INT) AS faculty_id,
               CAST(0 AS INT) AS duration_semesters
        FROM orders WHERE o_orderkey % 307 = 0""",
    "course": f"""
        SELECT p_partkey AS id, p_name AS name, p_brand AS number, p_type AS type, p_size AS weekly_hours,
               'Unit' AS org_unit
        FROM part
        UNION ALL
        SELECT p_partkey + {FAULTY} AS id, p_name AS name, p_brand AS number, p_type AS type, CAST(0 AS INT) AS weekly_hours,
               '' AS org_unit
        FROM part WHERE p_partkey % 101 = 0""",
    "event_type": "SELECT DISTINCT p_type AS id, lower(p_type) AS name FROM part",
    "staff": f"""
        SELECT s_suppkey AS id, s_name AS name FROM supplier
        UNION ALL
        SELECT s_suppkey + {FAULTY} AS id, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'N. N.' END AS name
        FROM supplier WHERE s_suppkey % 3 = 0""",
    "status": "SELECT DISTINCT o_orderstatus AS id, concat('state ', o_orderstatus) AS name FROM orders",
    "degree": f"""
        SELECT DISTINCT concat('D-', c_mktsegment) AS id, concat(c_mktsegment, ' (B.A.)') AS name, c_mktsegment AS subject,
               'B.A.' AS degree, 'high' AS confidence FROM customer
        UNION ALL
        SELECT concat('X-', r_regionkey) AS id, '' AS name, '' AS subject, '' AS degree, 'low' AS confidence FROM region""",
    "semester": """
        SELECT DISTINCT concat(CASE WHEN month(o_orderdate) BETWEEN 4 AND 9 THEN 'SoSe ' ELSE 'WiSe ' END,
                               year(o_orderdate)) AS id,
               concat(CASE WHEN month(o_orderdate) BETWEEN 4 AND 9 THEN 'SoSe ' ELSE 'WiSe ' END,
                      year(o_orderdate)) AS name,
               CAST(year(o_orderdate) AS INT) AS year,
               CASE WHEN month(o_orderdate) BETWEEN 4 AND 9 THEN 'SoSe' ELSE 'WiSe' END AS term
        FROM orders
        UNION ALL
        SELECT DISTINCT concat('short ', year(o_orderdate)) AS id, concat('SoSe ', CAST(floor(year(o_orderdate) / 10) AS INT)) AS name,
               CAST(year(o_orderdate) % 100 AS INT) AS year, 'SoSe' AS term
        FROM orders WHERE year(o_orderdate) < 2000""",
    "exam": """
        SELECT concat(l_orderkey, '-', l_partkey, '-', l_linenumber) AS id, l_orderkey AS module_id,
               l_returnflag AS name, CAST(l_shipdate AS DATE) AS exam_date,
               CAST(l_linenumber * 60 AS INT) AS start_min, CAST(l_linenumber * 60 + 90 AS INT) AS end_min,
               l_linestatus = 'F' AS required, l_suppkey AS staff_id
        FROM lineitem""",
    "achievement": """
        SELECT concat(l_orderkey, '-', l_partkey, '-', l_linenumber) AS id, l_orderkey AS module_id,
               l_linestatus AS name, l_tax > 0.04 AS required, l_discount AS weight,
               l_returnflag AS combination
        FROM lineitem""",
    "module_course": "SELECT DISTINCT l_orderkey AS module_id, l_partkey AS course_id FROM lineitem",
    "module_staff": "SELECT DISTINCT l_orderkey AS module_id, l_suppkey AS staff_id FROM lineitem",
    "course_staff": "SELECT DISTINCT l_partkey AS course_id, l_suppkey AS staff_id FROM lineitem",
    "course_event": "SELECT DISTINCT l_partkey AS course_id, l_orderkey AS event_id FROM lineitem",
    "event_staff": "SELECT DISTINCT l_orderkey AS event_id, l_suppkey AS staff_id FROM lineitem",
    "module_semester": """
        SELECT o_orderkey AS module_id,
               concat(CASE WHEN month(o_orderdate) BETWEEN 4 AND 9 THEN 'SoSe ' ELSE 'WiSe ' END,
                      year(o_orderdate)) AS semester_id
        FROM orders""",
    "module_start_semester": """
        SELECT o_orderkey AS module_id,
               concat(CASE WHEN month(o_orderdate) BETWEEN 4 AND 9 THEN 'SoSe ' ELSE 'WiSe ' END,
                      year(o_orderdate)) AS semester_id
        FROM orders""",
    "module_path": """
        SELECT o_orderkey AS module_id, split(concat('Root/WiSe ', year(o_orderdate), '/', o_orderpriority), '/') AS path,
               CAST(1 AS INT) AS position
        FROM orders""",
    "module_degree": """
        SELECT o_orderkey AS module_id, concat('D-', c_mktsegment) AS degree_id
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "event_semester": """
        SELECT o_orderkey AS event_id,
               concat(CASE WHEN month(o_orderdate) BETWEEN 4 AND 9 THEN 'SoSe ' ELSE 'WiSe ' END,
                      year(o_orderdate)) AS semester_id
        FROM orders""",
    "exam_staff": """
        SELECT DISTINCT concat(l_orderkey, '-', l_partkey, '-', l_linenumber) AS exam_id, l_suppkey AS staff_id
        FROM lineitem""",
}

# The views that are distinct pairs of line item columns.
PAIRS = {
    "module_course": {"module_id": "l_orderkey", "course_id": "l_partkey"},
    "module_staff": {"module_id": "l_orderkey", "staff_id": "l_suppkey"},
    "course_staff": {"course_id": "l_partkey", "staff_id": "l_suppkey"},
    "course_event": {"course_id": "l_partkey", "event_id": "l_orderkey"},
    "event_staff": {"event_id": "l_orderkey", "staff_id": "l_suppkey"},
}

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def star_store(spark: SparkSession, sf_dir: str) -> Store:
    configure(spark)
    sources = {name: table(spark, sf_dir, name) for name in SOURCES}
    tables = {name: spark.sql(_bind(sql), **sources) for name, sql in VIEWS.items()}
    return Store(tables | {name: _pairs(sources["lineitem"], **ends) for name, ends in PAIRS.items()})


def _pairs(lines: DataFrame, **ends: str) -> DataFrame:
    """The distinct pairs of a link view. They are sent by pair before they are told apart: nearly all differ, so a reading task
    would only gather all pairs of its part of the file, which can be the whole file."""
    named = lines.select(*[F.col(c).alias(name) for name, c in ends.items()])
    return named.repartition(*ends).distinct()


def _bind(sql: str) -> str:
    """Name the tables as parameters, so no temporary view is left in the session."""
    import re

    return re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}", sql)


def with_views(*names: str) -> str:
    """``WITH v_<name> AS (…)`` for the oracle side."""
    return "WITH " + ", ".join(f"v_{name} AS ({VIEWS[name]})" for name in names) + " "
