"""The table of paths that were read: equal results with and without it, and no path read twice."""

import glob

from syllabary.plans import degrees, path_dictionary
from syllabary.store import Store

DDL = "module_id string, path array<string>, position int"


def path(*nodes):
    return ["Root", "WiSe 2025", "06 - Faculty of Words", *nodes]


FIRST = [
    ("m1", path("Institut X", "B.A. Soziologie"), 1), ("m1", path("Bachelor", "Soziologie"), 2),
    ("m2", path("Institut X", "B.A. Soziologie"), 1), ("m2", path("Seminar Y", "Philosophie, Lehramt"), 2),
    ("m3", ["Root"], 1), ("m3", [], 2), ("m4", None, 1), ("m4", path(None, "M.Sc. Physik"), 2),
]
LATER = [("m5", path("Bachelor", "Soziologie"), 1), ("m5", path("Institut Z", "M.Sc. Physics"), 2), ("m6", path("Erasmus Programm"), 1)]


def rows(df):
    return sorted(map(str, df.collect()))


def files(folder):
    return sorted(glob.glob(f"{folder}/*/*.parquet"))


def test_a_second_run_reads_nothing_and_new_paths_only_are_added(spark, tmp_path):
    folder = str(tmp_path / "paths")
    first, both = spark.createDataFrame(FIRST, DDL), spark.createDataFrame(FIRST + LATER, DDL)
    known = path_dictionary.refreshed(first, folder)
    assert known.count() == 6 == known.select("path_id").distinct().count()
    written = files(folder)
    path_dictionary.refreshed(first, folder)
    assert files(folder) == written
    known = path_dictionary.refreshed(both, folder)
    assert known.count() == 8 and set(written) < set(files(folder))
    added = spark.read.parquet(*(set(files(folder)) - set(written)))
    assert sorted(r.programme.kind for r in added.collect()) == ["austausch", "studiengang"]
    assert rows(degrees.programmes(both, dictionary=known)) == rows(degrees.programmes(both))


def test_paths_that_the_table_lacks_are_read_all_the_same(spark, tmp_path):
    known = path_dictionary.refreshed(spark.createDataFrame(FIRST, DDL), str(tmp_path / "paths"))
    both = spark.createDataFrame(FIRST + LATER, DDL)
    assert rows(degrees.programmes(both, dictionary=known)) == rows(degrees.programmes(both))


def test_rows_of_other_rules_are_not_read(spark, tmp_path, monkeypatch):
    folder, paths = str(tmp_path / "paths"), spark.createDataFrame(FIRST, DDL)
    path_dictionary.refreshed(paths, folder)
    monkeypatch.setattr(path_dictionary, "REVISION", -1)
    assert path_dictionary.read(spark, folder).isEmpty()
    assert path_dictionary.refreshed(paths, folder).count() == 6


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], DDL)
    known = path_dictionary.refreshed(none, str(tmp_path / "paths"))
    assert known.isEmpty() and degrees.programmes(none, dictionary=known).isEmpty()


def test_degrees_and_links_by_the_table(spark, tmp_path):
    paths = spark.createDataFrame(FIRST + LATER, DDL)
    module = paths.selectExpr("module_id as id", "'06-A-1' as number").distinct()
    faculty = spark.createDataFrame([("f6", "06 - Faculty of Words", 6), ("f7", "Other", None)], "id string, name string, prefix int")
    store = Store({"module": module, "faculty": faculty, "module_path": paths})
    known = path_dictionary.refreshed(paths, str(tmp_path / "paths"))
    plain, by_table = degrees.derive_degrees(store), degrees.derive_degrees(store, known)
    assert [rows(df) for df in plain] == [rows(df) for df in by_table]
    links = by_table[1]
    assert links.where("module_id = 'm5'").count() == 2 and links.where("module_id = 'm6'").isEmpty()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") < 15, plan
