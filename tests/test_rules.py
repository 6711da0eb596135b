"""Golden cases of the column functions, the degree rules and the page extraction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from syllabary.functions import dates, paths, text, urls
from syllabary.operators import filters
from syllabary.plans import degrees
from syllabary.sources import pages

# Own paths, one per rule: a degree before and after its subject, spelt wrong, without dots, on a node of its own, with a
# version, with points, an exchange, a free choice, a service unit, and nodes that say nothing.
GOLDEN = [
    (["Institut A", "B.Sc. Meteorologie"], "Meteorologie (B.Sc.)", "studiengang"),
    (["Institut A", "Meteorologie (Master of Science)", "3. Semester"], "Meteorologie (M.Sc.)", "studiengang"),
    (["Institut B", "M.A.Klassische Archäologie"], "Klassische Archäologie (M.A.)", "studiengang"),
    (["Master", "Sinologie", "4. Semester"], "Sinologie (Master)", "studiengang"),
    (["Seminar C", "Chemie, Lehramt", "Staatsexamen Lehramt an Grundschulen"], "Chemie (Lehramt, Grundschule)", "studiengang"),
    (["Master", "Sinologie", "Sinologie (neue Prüfungsordnung)"], "Sinologie (Master, neue Prüfungsordnung)", "studiengang"),
    (["Wahlfächer 30 LP", "Wahlfach Byzantinistik 30 LP"], "Byzantinistik (Wahlfach, 30 LP)", "studiengang"),
    (["Institut D"], "", "unklar"),
]


def test_degree_rules(spark):
    rows = [(["Root", "SoSe 2025", "07 - Fakultät T", *p], n, k) for p, n, k in GOLDEN]
    df = degrees.extract(spark.createDataFrame(rows, "path array<string>, name string, kind string"))
    got = {(r["name"], r["kind"], r["programme"]["name"], r["programme"]["kind"]) for r in df.collect()}
    assert all(name == found and kind == found_kind for name, kind, found, found_kind in got)


def test_similar_subjects_join_the_most_frequent(spark):
    counts = spark.createDataFrame(
        [("F", "Bachelor", "Geographie", 5), ("F", "Bachelor", "Geopgraphie", 1), ("F", "Bachelor", "Physik", 2)],
        "faculty string, category string, subject string, n long",
    )
    got = {r["subject"]: r["canonical"] for r in degrees.canonical_subjects(counts).collect()}
    assert got == {"Geographie": "Geographie", "Geopgraphie": "Geographie", "Physik": "Physik"}


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("A: x\nB: y", {"A": "x", "B": "y"}),
        ("A (k: v): y", {"A (k: v)": "y"}),
        ("A ((k: v): w): y", {"A ((k: v): w)": "y"}),
        ("free one\nA: x\nfree two", {"A": "x", "allgemein": "free one free two"}),
        ("A: x\nA: y", {"A": "x y"}),
        ("nothing", {"allgemein": "nothing"}),
        ("", {}),
    ],
)
def test_requirements(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(text.parse_requirements(F.col("v"))).first()[0] == want


def test_dates_and_times(spark):
    values = ["15. Jul. 2026", "1 Mai 2026", "1. Mai 2026", "31. Feb. 2026", "3. Xyz. 2026", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r[0]: r[1] for r in df.select("v", dates.german_date(F.col("v"))).collect()}
    assert got["15. Jul. 2026"] == dt.date(2026, 7, 15) and got["1. Mai 2026"] == dt.date(2026, 5, 1)
    assert [got[v] for v in ("1 Mai 2026", "31. Feb. 2026", "3. Xyz. 2026", "")] == [None] * 4
    clock = spark.createDataFrame([("9:05",), ("24:00",), ("25:10",), ("x",)], "v string")
    assert [r[0] for r in clock.select(dates.clock_minutes(F.col("v"))).collect()] == [545, 1439, None, None]
    with pytest.raises(ValueError):
        dates.parse_clock("24:00")


def test_paths_and_urls(spark):
    df = spark.createDataFrame([('["a","b"]', '[["a"],[],["SoSe 25"]]')], "flat string, nested string")
    row = df.select(paths.parse_paths(F.col("flat")), paths.parse_paths(F.col("nested")), paths.is_flat(F.col("flat"))).first()
    assert row[0] == [["a", "b"]] and row[1] == [["a"], ["SoSe 25"]] and row[2]
    url = F.lit("http://x/y?b=2&a=%20z&ARGUMENTS=k#f")
    got = spark.range(1).select(urls.normalise_url(url, "query-sorted"), urls.normalise_url(url, "ignore-arguments")).first()
    assert got[0] == "http://x/y?ARGUMENTS=k&a=+z&b=2#f" and got[1] == "http://x/y?b=2&a=+z#f"


def test_accessible(spark):
    values = ["Ja", " ja ", "barrierefrei", "nicht barrierefrei", "Nein", "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    yes = df.where(filters.accessible(F.col("v"), True)).count()
    assert yes == 3 and df.where(filters.accessible(F.col("v"), False)).count() == 4


def test_html_lines(spark):
    df = spark.createDataFrame([("<p>a<br>b</p>",), ("<span>a</span><span>b</span>",), ("plain",)], "v string")
    assert [r[0] for r in df.select(text.html_lines(F.col("v"))).collect()] == ["a\nb", "a b", "plain"]


COURSE = """<h1>K1 Vorlesung</h1><form><div id="contentlayoutleft"><div class="tbdata"><b>Lehrende:</b> <span>Dr. A; Dr. B</span></div></div>
<div id="contentlayoutright"><div>Termine</div><table><tbody>
<tr><td>1</td><td name="appointmentDate"><span class="lg:hidden">Datum</span><span>Fr, 10. Apr. 2026</span></td><td name="appointmentTimeFrom">14:00</td>
<td name="appointmentDateTo">24:00</td><td class="rw-course-room"><a name="appointmentRooms" href="#"><span>HS 1</span></a><span>HS 2</span></td>
<td name="appointmentInstructors"><span>Dr. A</span><span>Dr. B</span></td></tr>
<tr><td>2</td><td>Sa, 31. Feb. 2026</td><td>09:00</td><td>10:00</td><td>R2</td><td>Dr. C</td></tr></tbody></table></div></form>"""


def test_session_rows_by_name_and_by_position(spark):
    els = pages.elements(spark.createDataFrame([("c", "u", COURSE)], "page_id string, url string, html string"))
    rows = sorted(pages.sessions(els).collect(), key=lambda r: r["number"])
    assert rows[0]["event_date"] == dt.date(2026, 4, 10) and rows[0]["end_min"] == 1439
    assert rows[0]["room"] == "HS 1" and rows[0]["n_rooms"] == 2 and rows[0]["staff"] == ["Dr. A", "Dr. B"]
    assert rows[1]["event_date"] is None and rows[1]["room"] == "R2" and rows[1]["staff"] == ["Dr. C"]
    assert pages.course_rows(els).first()["staff"] == ["Dr. A", "Dr. B"]


def test_modules_of_a_course_are_sent_together(spark):
    from syllabary.operators import calendar as C
    from syllabary.store import Store

    def rows(values, ddl):
        return spark.createDataFrame(values, ddl)

    store = Store({
        "course": rows([(1, "Bee", "B", "x"), (2, "Ay", "A", "y")], "id int, name string, number string, type string"),
        "course_event": rows([(1, 7), (2, 7), (2, 7), (1, 8), (None, 9)], "course_id int, event_id int"),
        "module": rows([(4, "M4", "A"), (5, "M5", "Z"), (6, "M6", "B"), (3, None, "Q")], "id int, name string, number string"),
        "module_course": rows([(4, 2), (3, 2), (5, 2), (4, 1), (6, 1), (6, 1)], "module_id int, course_id int"),
        "staff": rows([(1, "P"), (2, "Q")], "id int, name string"),
        "event_staff": rows([(8, 2)], "event_id int, staff_id int"),
        "course_staff": rows([(2, 1), (2, 2)], "course_id int, staff_id int"),
        "location": rows([(1, "Room", 1)], "id int, name string, building_id int"),
        "building": rows([(1, "House")], "id int, name string"),
    })
    events = rows([(7, "A1", 1), (8, "x", None), (9, "B", 2)], "id int, number string, location_id int")
    found = C.with_placeholders(store, events)
    told = {r["id"]: tuple(r[c] for c in found.columns[3:]) for r in found.collect()}
    assert told == {
        7: ("Ay / Bee", "A", "y", "M4 / M5 / M6", "A", "P, Q", "Room", "House"), 8: ("Bee", "B", "x", "M4 / M6", "A", "Q", "", ""),
        9: ("", "", "", "", "", "", "", ""),
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    sent = plan[: plan.index("RepartitionByExpression [_event")]
    assert "Generate explode(_taught" in sent  # names travel in one row for each event and course
