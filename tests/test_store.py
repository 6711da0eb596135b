"""Load, projection, calendar and streaming on small hand-made catalogues."""

import datetime as dt
import functools
import json
import re

from pyspark.sql import functions as F

from syllabary.operators import calendar, projection
from syllabary.operators.schedule import recurring_series
from syllabary.plans import audit, entities, load
from syllabary.registry import calendars, lists, star  # noqa: F401
from syllabary.registry.base import QUERIES
from syllabary.store import empty_store
from syllabary.streaming import incremental

ROOM = {"name": "HS 1", "external_id": "", "building": {"name": "", "short_name": "", "address": ""}}


def event(day, room=None, staff=("S",), start=600):
    return {"number": "1", "event_date": day, "start_min": start, "end_min": start + 90, "location": room, "staff": list(staff), "url": ""}


def course(name, events, **more):
    return {"name": name, "number": name, "type": "V", "staff": ["S"], "language": "de", "events": events, **more}


RECORDS = [
    {"name": "A", "number": "10-1", "path": [["SoSe 25", "10 - Math", "x"], ["WiSe 26", "10 - Math"]], "frequency": "", "credits": 0.0,
     "responsible_person": "P; Q", "url": "1", "courses": [course("C1", [event("2026-04-06", ROOM), event("2026-04-13"), event(None)])],
     "exams": [{"name": "E", "date": None, "required": True, "staff": []}, {"name": "E", "date": None, "required": True, "staff": ["P"]}],
     "achievements": [{"name": "L", "required": False, "weight": None, "combination": "x"}] * 2},
    {"name": "A", "number": "10-1", "path": [["SoSe 25", "10 - Math", "y"]], "frequency": "yearly", "credits": 5.0, "url": "2",
     "responsible_person": "", "courses": [course("C2", [event("2026-04-06", ROOM, ("T",)), event("2026-04-13")])], "exams": [], "achievements": []},
]


def as_records(spark, rows, tmp_path):
    path = tmp_path / "records"
    path.mkdir(exist_ok=True)
    (path / f"{len(list(path.iterdir()))}.json").write_text("\n".join(json.dumps(r) for r in rows))
    return spark.read.schema(load.MODULE_DDL).json(str(path))


def contents(store):
    return {n: sorted(map(str, df.drop("seq").collect())) for n, df in store.tables.items()}


def test_load_merges(spark, tmp_path):
    store, rejects = load.load(as_records(spark, RECORDS, tmp_path))
    module = store["module"].collect()
    assert len(module) == 1 and module[0]["frequency"] == "yearly" and module[0]["credits"] == 5.0 and module[0]["url"] == "1"
    assert store["module_path"].count() == 3
    assert store["event"].count() == 3 and store["course_event"].count() == 4
    assert store["exam"].count() == 1 and store["achievement"].count() == 1
    assert rejects.count() == 1 and store["building"].count() == 1
    assert store["module_semester"].count() == 2 and store["course_semester"].count() == 2
    assert {r["weekday"] for r in store["course"].collect()} == {1}
    assert store["faculty"].select("prefix").collect()[0][0] == 10 and module[0]["faculty_id"] is not None


def test_load_twice_is_load_once(spark, tmp_path):
    once = as_records(spark, RECORDS, tmp_path)
    assert contents(load.load(once)[0]) == contents(load.load(once.union(once).repartition(7))[0])
    counts = load.insert_counts(load.load(once)[0], load.load(once)[0]).first()
    assert list(counts) == [0, 0, 0]


def test_streamed_load_equals_batch(spark, tmp_path):
    as_records(spark, RECORDS[:1], tmp_path)
    stream = incremental.read_records(spark, str(tmp_path / "records"), files_per_trigger=1)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    incremental.start_load(stream, out, mark).awaitTermination(120)
    whole = as_records(spark, RECORDS[1:], tmp_path)
    incremental.start_load(incremental.read_records(spark, str(tmp_path / "records")), out, mark).awaitTermination(120)
    assert contents(incremental.read_loaded(spark, out)[0]) == contents(load.load(whole)[0])


def test_long_lists_are_split_and_whole(spark, tmp_path):
    days = [(dt.date(2026, 1, 5) + dt.timedelta(days=i)).isoformat() for i in range(20)]
    store, _ = load.load(as_records(spark, [{**RECORDS[0], "courses": [course("C", [event(d) for d in days])]}], tmp_path))
    whole = projection.include(store, store["course"], "course", ["events"]).collect()
    assert len(whole) == 1 and len(whole[0]["events"]) == 20
    parts = projection.include(store, store["course"], "course", ["events"], max_list=6).collect()
    assert len(parts) == 4 and sorted(e["id"] for p in parts for e in p["events"]) == sorted(e["id"] for e in whole[0]["events"])


def test_lists_and_checks(spark, tmp_path):
    store, _ = load.load(as_records(spark, RECORDS, tmp_path))
    assert entities.where(store, "module", {"path": "y", "path_prefix": "SoSe 25/10 - Math"}).count() == 1
    assert entities.where(store, "module", {"path": "nope"}).count() == 0
    assert entities.where(store, "event", {"time_overlap": "10:30", "location": "hs"}).count() == 1
    got = {r["check"]: r["n"] for r in audit.summary(store, tuple(c for c in audit.CHECKS if "degree" not in c.key)).collect()}
    assert got["events_without_location"] == 2 and got["events_without_location_mixed"] == 2 and got["modules_without_courses"] == 0


def test_weekly_series_skip_one_week(spark):
    days = ["2026-04-06", "2026-04-13", "2026-04-27"]
    events = spark.createDataFrame(
        [(str(i), "1", "n", 600, 690, dt.date.fromisoformat(d), "L", "") for i, d in enumerate(days)],
        "id string, number string, name string, start_min int, end_min int, event_date date, location_id string, url string",
    )
    row = recurring_series(events).first()
    assert row["id"] == "0" and row["weeks"] == 4 and row["skipped"] == [dt.date(2026, 4, 20)]


def test_calendar_lines_are_folded_and_escaped(spark):
    long = "Ä" * 60
    df = spark.createDataFrame([(long, "a,b;c\\d\ne")], "l string, t string")
    folded, escaped = df.select(calendar.fold(F.col("l")), calendar.escape(F.col("t"))).first()
    assert all(len(line.encode()) <= 75 for line in folded.split("\r\n")) and folded.replace("\r\n ", "") == long
    assert escaped == "a\\,b\\;c\\\\d\\ne"


def linked(spark, sizes):
    """Events E<n> that begin with the number of their last course and have n courses, each with one module and two people."""
    events = spark.createDataFrame([(f"E{n}", f"C{n - 1:06d}-1", "n", n) for n in sizes], "id string, number string, name string, n int")
    pairs = events.select("id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    courses = spark.range(max(sizes)).select(F.format_string("C%06d", "id").alias("key"))
    return empty_store(spark).with_tables(
        event=events.selectExpr("id", "number", "name", "600 as start_min", "690 as end_min", "date'2026-04-06' as event_date", "'L' as location_id", "'' as url"),
        course=courses.selectExpr("key as id", "concat('name ', key) as name", "key as number", "'V' as type"),
        course_event=pairs.select(F.format_string("C%06d", F.col("k").cast("long")).alias("course_id"), F.col("id").alias("event_id")),
        module=courses.selectExpr("concat('M', key) as id", "concat('mod ', key) as name", "key as number"),
        module_course=courses.selectExpr("concat('M', key) as module_id", "key as course_id"),
        staff=spark.createDataFrame([("S1", "Ann"), ("S2", "Bo")], "id string, name string"),
        course_staff=courses.selectExpr("explode(array('S1', 'S2')) as staff_id", "key as course_id"),
    )


def test_events_of_any_number_of_links_are_one_row(spark):
    sizes = (5, 50_000)
    store = linked(spark, sizes)
    rows = calendar.with_placeholders(store, store["event"]).collect()
    assert sorted(r["id"] for r in rows) == sorted(f"E{n}" for n in sizes)
    for r in rows:
        n = int(r["id"][1:])
        order = [n - 1, *range(n - 1)]
        assert r["p_course_name"] == " / ".join(f"name C{k:06d}" for k in order)
        assert r["p_module_name"] == " / ".join(f"mod C{k:06d}" for k in order)
        assert (r["p_course_number"], r["p_module_number"], r["p_course_type"], r["p_staff_names"]) == (f"C{n - 1:06d}", f"C{n - 1:06d}", "V", "Ann, Bo")
    assert calendar.calendar_events(store, store["event"]).count() == len(sizes)


def test_relations_have_one_shape_at_any_size(spark):
    store = linked(spark, (5, 50_000))
    rows = entities.list_rows(store, "event", include=["courses.staff", "location"])
    assert "part" in rows.columns
    got = rows.groupBy("id").agg(F.count(F.when(F.col("part") == 0, 1)).alias("once"), F.sum(F.size("courses")).alias("n"), F.max("part").alias("last"))
    assert {tuple(r) for r in got.collect()} == {("E5", 1, 5, 0), ("E50000", 1, 50_000, 4)}
    whole = {r["id"]: r for r in lists._included(rows).collect()}
    for n in (5, 50_000):
        assert (whole[f"E{n}"]["n_courses"], whole[f"E{n}"]["n_staff"]) == (n, 2 * n)
        assert whole[f"E{n}"]["courses"] == "|".join(f"name C{k:06d}" for k in range(n))
    paged = entities.list_rows(store, "event", page=1, page_size=2, include=["courses"]).select("id").distinct()
    assert paged.count() == 2


def exchanged(df):
    """The columns that each exchange of the plan takes in."""
    text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]$", text, re.M)


def test_nested_values_are_sent_once(spark):
    store = linked(spark, (2, 5))
    for sort, order in ((None, "asc"), ("number", "desc")):
        rows = entities.list_rows(store, "event", sort=sort, order=order, include=["courses.staff", "location"])
        taken = exchanged(rows)
        assert len([columns for columns in taken if "_value_courses#" in columns]) == 1
        assert not [columns for columns in taken if re.search(r"\bcourses#", columns)]
        got = rows.collect()
        assert [r["id"] for r in got] == (["E2", "E5"] if order == "asc" else ["E5", "E2"])
        assert [[(s["id"], s["name"]) for s in c["staff"]] for r in got for c in r["courses"]] == 7 * [[("S1", "Ann"), ("S2", "Bo")]]


def test_lists_meet_their_rows_by_ranges_as_by_key(spark):
    """Keys that repeat, more often than a list is long, that are missing, without links, and links of rows that are not there."""
    store = linked(spark, (1, 5))
    other = store["event"].where("id = 'E1'")
    events = [store["event"], *[other.withColumn("number", F.lit(f"x{i}")) for i in range(9)], other, other.withColumn("id", F.lit("E9"))]
    events += 2 * [other.withColumn("id", F.lit(None).cast("string"))]
    events = functools.reduce(lambda a, b: a.union(b), events).withColumn("_sort_id", F.col("id")).withColumn("_sort_number", F.col("number"))
    store = store.with_tables(course_event=store["course_event"].union(spark.createDataFrame([("C000000", "E7"), ("C000001", None)], "course_id string, event_id string")))
    tree = projection.projection(store, "event", include=["courses.staff", "courses.modules", "location", "staff"])
    keep = ["_sort_number", "_sort_id"]
    plain = projection.project(store, events, "event", tree, keep, max_list=3)
    by = {"_sort_number": F.col("_sort_number").desc_nulls_last(), "_sort_id": F.col("_sort_id").asc_nulls_first()}
    dealt = projection.project(store, events, "event", tree, keep, max_list=3, by=by)
    assert dealt.columns == plain.columns and dealt.schema.simpleString() == plain.schema.simpleString()
    whole = sorted(map(repr, plain.collect()))
    assert sorted(map(repr, dealt.collect())) == whole and len(whole) == 2 + 11 + 1 + 2


def test_whole_export_text(spark, monkeypatch):
    days = ["2026-04-06", "2026-04-13", "2026-04-27"]
    events = [(f"e{i}", "10-2 x", "Algebra; part, one", 600, 690, dt.date.fromisoformat(d), "L1") for i, d in enumerate(days)]
    events += [("e7", "77", "Übung " + "ä" * 50, 480, 565, dt.date(2026, 4, 7), "L2"), ("e8", "", "alone", 5, 65, dt.date(2026, 4, 8), None)]
    courses = {"c1": ("First, of two", "10-3", "V"), "c2": ("Owner\\ course", "10-2", "S"), "c3": ("", "7", "S")}
    modules = {"m1": ("Module A", "99"), "m2": ("Module B\nnext", "10"), "m3": ("Module C", "7")}
    people = {"s1": "Ann", "s2": "Bo; Co", "s3": " "}
    rooms, houses = {"L1": ("HS 1, left", "B1"), "L2": ("", None)}, {"B1": "Main"}
    course_event = [("c1", e) for e in ("e0", "e1", "e2")] + [("c2", e) for e in ("e0", "e1", "e2")] + [("c3", "e7")]
    module_course = [("m1", "c1"), ("m1", "c2"), ("m2", "c2"), ("m3", "c3")]
    course_staff, event_staff = [("c2", "s2"), ("c2", "s1"), ("c3", "s3")], [("e7", "s2")]

    def df(rows, ddl):
        return spark.createDataFrame(rows, ddl)

    store = empty_store(spark).with_tables(
        event=df([(*e, "") for e in events], "id string, number string, name string, start_min int, end_min int, event_date date, location_id string, url string"),
        course=df([(k, *v) for k, v in courses.items()], "id string, name string, number string, type string"),
        module=df([(k, *v) for k, v in modules.items()], "id string, name string, number string"),
        staff=df(list(people.items()), "id string, name string"),
        location=df([(k, *v) for k, v in rooms.items()], "id string, name string, building_id string"),
        building=df(list(houses.items()), "id string, name string"),
        course_event=df(course_event, "course_id string, event_id string"), module_course=df(module_course, "module_id string, course_id string"),
        course_staff=df(course_staff, "course_id string, staff_id string"), event_staff=df(event_staff, "event_id string, staff_id string"),
    )

    def fold(line):
        out, width = "", 0
        for ch in line:
            size = len(ch.encode())
            if width + size > 75:
                out, width = out + "\r\n ", 1
            out, width = out + ch, width + size
        return out

    def escape(value):
        return value.replace("\\", "\\\\").replace(";", "\\;").replace(",", "\\,").replace("\n", "\\n")

    def ahead(keys, whole, number):
        own = [k for k in sorted(keys) if number(k) and whole.startswith(number(k))][:1]
        return own, own + [k for k in sorted(keys) if k not in own]

    def text(group):
        event = min(group, key=lambda e: (e[5], e[0]))
        id_, number, name, start, end, first, room = event
        own, cs = ahead([c for c, e in course_event if e == id_], number, lambda k: courses[k][1])
        ms = []
        for c in cs:
            mine = [m for m, x in module_course if x == c]
            ms += ahead(mine, courses[c][1], lambda k: modules[k][1])[1] if c in own else sorted(mine)
        staff = sorted(s for e, s in event_staff if e == id_) or sorted(s for c, s in course_staff if c in cs[:1])
        joined = [" / ".join(x for x in xs if x.strip()) for xs in ([modules[m][0] for m in dict.fromkeys(ms)], [courses[c][0] for c in cs])]
        names = ", ".join(people[s] for s in staff if people[s].strip())
        lines = ["BEGIN:VEVENT", f"UID:event-{id_}@syllabary", "SUMMARY:" + escape(f"{joined[0]} – {joined[1]}")]
        lines += [f"{k};TZID=Europe/Berlin:{first:%Y%m%d}T{m // 60:02d}{m % 60:02d}00" for k, m in (("DTSTART", start), ("DTEND", end))]
        held = sorted(e[5] for e in group)
        if len(held) > 1:
            weeks = (held[-1] - held[0]).days // 7 + 1
            gone = [d for d in (held[0] + dt.timedelta(days=7 * k) for k in range(weeks)) if d not in held]
            lines.append(f"RRULE:FREQ=WEEKLY;COUNT={weeks}")
            lines += ["EXDATE;TZID=Europe/Berlin:" + ",".join(f"{d:%Y%m%d}T{start // 60:02d}{start % 60:02d}00" for d in gone)] if gone else []
        place = rooms[room][0] if room else ""
        lines += [f"LOCATION:{escape(place)}"] if place else []
        lines += [f"DESCRIPTION:{escape(name + chr(10) + names)}", "END:VEVENT"]
        return 1, id_, "\r\n".join(map(fold, lines))

    head = "\r\n".join(["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//Syllabary//EN", "X-WR-TIMEZONE:Europe/Berlin"])
    want = {(0, None, head), (2, None, "END:VCALENDAR"), text(events[:3]), text(events[3:4]), text(events[4:])}
    monkeypatch.setattr("syllabary.registry.base.star_store", lambda spark, sf_dir: store)
    got = QUERIES["export_ical"](spark, "unused")
    assert got.columns == ["position", "id", "ics"]
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_modules_of_events_are_sent_once(spark):
    """Both aggregates over (event, module) rows find them by event, so the names are not sent a second time."""
    tables = {
        "course_event": spark.createDataFrame([("c1", "e"), ("c2", "e"), ("c2", "f"), (None, "f"), ("c1", "e")], "course_id string, event_id string"),
        "course": spark.createDataFrame([("c1", "C1", "9", "V"), ("c2", "C2", "10-2", "V")], "id string, name string, number string, type string"),
        "module_course": spark.createDataFrame([("m1", "c1"), ("m2", "c2"), ("m3", "c2"), ("m1", "c2"), ("m1", "c1")], "module_id string, course_id string"),
        "module": spark.createDataFrame([("m1", "M1", "7"), ("m2", "M2", "2"), ("m3", "M3", "10")], "id string, name string, number string"),
        "event": spark.createDataFrame([("e", "10-2-x", None), ("f", "", None), ("g", "1", None)], "id string, number string, location_id string"),
    }
    shown = calendar.with_placeholders(empty_store(spark).with_tables(**tables), tables["event"])
    got = {r["id"]: (r["p_course_name"], r["p_module_name"], r["p_module_number"]) for r in shown.collect()}
    assert got == {"e": ("C2 / C1", "M3 / M1 / M2", "10"), "f": ("C2", "M1 / M2 / M3", "7"), "g": ("", "", "")}
    plan = shown._jdf.queryExecution().sparkPlan().toString() + shown._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(_event#\d+, _module#\d+", plan)


def test_link_pairs_are_sent_before_they_are_told_apart(spark):
    rows = [(1, 2), (1, 2), (None, 2), (None, 2), (1, None), (3, 4)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long")
    pairs = star._pairs(lines, course_id="l_partkey", event_id="l_orderkey")
    assert pairs.columns == ["course_id", "event_id"]
    assert sorted(map(str, pairs.collect())) == sorted(map(str, lines.select(F.col("l_partkey").alias("course_id"), F.col("l_orderkey").alias("event_id")).distinct().collect()))
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan.split("Exchange")[1]
    assert set(star.PAIRS) == {k for k, sql in star.VIEWS.items() if sql.startswith("SELECT DISTINCT l_")}
