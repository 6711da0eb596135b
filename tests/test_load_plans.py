"""Load: paths are read once per merge, and fields without a value are as absent."""

import datetime as dt

from pyspark.sql import functions as F

from syllabary.plans import load as L

ROW = '{"name": "M", "number": "10-1", "path": [["Root", "SoSe 2024", "10 - A", "11 - B"], ["WiSe 2025"], []], "start_semester": "x", "courses": [{"name": "C", "events": [{"event_date": "2024-05-01", "start_min": 1, "end_min": 2}]}]}'
BARE = '{"name": "N", "number": null, "path": [["x"]], "courses": [{"name": "D"}]}'


def staged(spark):
    lines = spark.createDataFrame([(ROW,), (BARE,)], "line string")
    return L.stage(lines.select(F.explode(F.array(F.from_json("line", L.MODULE_DDL))).alias("r")).select("r.*"))


def test_first_semester_and_faculty(spark):
    store = L.resolve(staged(spark))
    named = store["semester"].select("id", "name")
    assert {r["name"] for r in store["course_semester"].join(named, F.col("semester_id") == named["id"]).collect()} == {"SoSe 2024"}
    assert store["event_semester"].count() == 1 and store["exam_semester"].count() == 0 and store["module_start_semester"].count() == 0
    assert [(r["name"], r["prefix"]) for r in store["faculty"].collect()] == [("10 - A", 10)]
    assert store["event"].first()["event_date"] == dt.date(2024, 5, 1)


def test_conditions_do_not_read_the_paths_again(spark):
    store = L.resolve(staged(spark))
    for table in ("course_semester", "event_semester", "exam_semester"):
        plan = store[table]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("(SoSe|WiSe)(?s:") == 1, table
    assert store["faculty"]._jdf.queryExecution().optimizedPlan().toString().count("flatten") == 1


def test_paths_of_a_module_are_made_once(spark):
    paths = L.resolve(staged(spark))["module_path"]
    plan = paths._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(") == 1
    assert {tuple(r["path"]) for r in paths.collect()} == {("Root", "SoSe 2024", "10 - A", "11 - B"), ("WiSe 2025",), ("x",)}


def test_links_read_each_level_once_and_travel_as_bytes(spark):
    levels = staged(spark)
    names = [n for n in L.resolve(levels).tables if n in L._link_ends()]
    whole = L.linked(levels, *names)
    one = {n: {(r["near"], r["far"]) for r in L.linked(levels, n).collect()} for n in names}
    found = [tuple(r) for r in whole.collect()]
    assert len(found) == len(set(found)) and {(n, *pair) for n in names for pair in one[n]} == set(found)
    assert len(one["module_course"]) == 2 and len(one["course_event"]) == 1 and len(one["module_semester"]) == 2 and not one["exam_staff"]
    assert all(len(end) == 32 for _, near, far in found for end in (near, far))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [link") == 4  # modules, courses, events, exams
    assert plan.count("lower(hex(near") == 4 and plan.rindex("unhex(") > plan.rindex("Aggregate [link")


def test_rows_are_grouped_by_their_digest_alone(spark):
    store = L.resolve(staged(spark))
    for table, key in (("module", "module_id"), ("course", "course_id"), ("event", "event_id"), ("exam", "exam_id")):
        plan = store[table].select("id")._jdf.queryExecution().optimizedPlan().toString()
        assert f"Aggregate [{key}#" in plan and ", name#" not in plan[plan.index(f"Aggregate [{key}#") :].split("\n")[0], table
    assert {(r["number"], r["name"]) for r in store["module"].collect()} == {("10-1", "M"), (None, "N")}
