"""Readers, writers and the stream: what is written comes back, also in several part files."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from syllabary.plans import degrees, load
from syllabary.sources import readers, writers
from syllabary.store import entity_schema, read_store, write_store
from syllabary.streaming import incremental

from .test_store import RECORDS, as_records, contents


def links(spark, n=10):
    rows = [(f"10-{i} Name", f"u{i}", [["SoSe 25", f"x{i}"], ["WiSe 25"]]) for i in range(n)]
    return spark.createDataFrame(rows, "name string, url string, path array<array<string>>")


def test_snapshot_round_trip(spark, tmp_path):
    faculties = spark.createDataFrame([(10, "Math"), (6, "Law")], "prefix int, name string")
    root = str(tmp_path / "s")
    writers.write_snapshot(links(spark).repartition(4), root, "1", faculties)
    dated = writers.write_snapshot(links(spark, 12).repartition(3), root, "2")
    want = {(r["name"], r["url"], str(r["path"])) for r in links(spark).collect()}
    assert {(r["name"], r["url"], str(r["path"])) for r in readers.read_snapshot(spark, f"{root}/modules_1").collect()} == want
    assert readers.read_snapshot(spark, f"{root}/modules_latest").count() == 12 == readers.read_snapshot(spark, dated).count()
    meta = readers.read_snapshot_meta(spark, f"{root}/modules_1").first()
    assert meta["count"] == 10 and [(f["prefix"], f["name"]) for f in meta["faculties"]] == [(6, "Law"), (10, "Math")]
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_snapshot(links(spark), root, "1")


def test_pretty_snapshots_are_imported(spark, tmp_path):
    modules = [{"name": "a", "url": "u", "path": [["x", "y"]]}, {"name": "b", "url": "v", "path": ["flat", "node"]}]
    (tmp_path / "wrapped.json").write_text(json.dumps({"created_at": "t", "count": 2, "faculties": [{"prefix": 1, "name": "F"}], "modules": modules}, indent=2))
    (tmp_path / "bare.json").write_text(json.dumps(modules, indent=2))
    for name in ("wrapped.json", "bare.json"):
        got = {(r["name"], str(r["path"])) for r in readers.import_snapshot(spark, str(tmp_path / name)).collect()}
        assert got == {("a", "[['x', 'y']]"), ("b", "[['flat', 'node']]")}
    assert readers.import_snapshot_faculties(spark, str(tmp_path / "wrapped.json")).first()["prefix"] == 1


def read_csv(path):
    parts = [p.read_text() for folder in ("header", "rows") for p in sorted((path / folder).glob("part-*"))]
    return list(csv.reader(io.StringIO("".join(parts))))


def test_csv_quotes_and_empty_results(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you', ["a", "b"]), (2, "line\nfeed", None), (3, None, [])], "id int, `a,b` string, tags array<string>")
    writers.write_csv(df.repartition(3), str(tmp_path / "c"))
    rows = read_csv(tmp_path / "c")
    assert rows[0] == ["id", "a,b", "tags"]
    assert sorted(rows[1:]) == [["1", 'say "hi", you', '["a","b"]'], ["2", "line\nfeed", ""], ["3", "", "[]"]]
    writers.write_csv(df.limit(0), str(tmp_path / "e"))
    assert read_csv(tmp_path / "e") == []


def test_results_are_listed_per_item(spark, tmp_path):
    found = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3)], "idx int, name string, ects int")
    writers.write_modules_json(found.repartition(3), str(tmp_path / "m"))
    got = {r["idx"]: [x["name"] for x in r["results"]] for r in spark.read.json(str(tmp_path / "m")).collect()}
    assert got == {1: ["a", "b"], 2: ["c"]}


def test_page_store_and_broken_lines(spark, tmp_path):
    store = tmp_path / "pages"
    store.mkdir()
    for key, side in (("a", '{"url": "http://x/a", "status": 200}'), ("b", "{broken"), ("c", None)):
        (store / f"{key}.html").write_text(f"<p>{key}</p>\n<p>2</p>")
        if side:
            (store / f"{key}.json").write_text(side)
    assert [tuple(r) for r in readers.read_page_store(spark, str(store)).collect()] == [("a", "http://x/a", "<p>a</p>\n<p>2</p>")]
    (tmp_path / "l.json").write_text('{"name": "a", "url": "u", "path": "[[\\"x\\"]]"}\n{oops\n{"name": "b", "url": "v", "path": "[]"}\n')
    assert {r["name"] for r in readers.read_module_links(spark, str(tmp_path / "l.json")).collect()} == {"a", "b"}


def test_arrival_order_is_unique(spark, tmp_path):
    two = [dict(RECORDS[0], credits=5.0, url="1"), dict(RECORDS[0], credits=6.0, url="1")]
    seen = set()
    for k, rows in enumerate((two, two[::-1])):
        folder = tmp_path / str(k)
        folder.mkdir()
        records = as_records(spark, rows, folder)
        for parts in (1, 7):
            seen.add(load.load(records.repartition(parts))[0]["module"].first()["credits"])
        as_records(spark, [], folder)
    assert len(seen) == 1


def test_batches_of_a_new_query_keep_the_old_ones(spark, tmp_path):
    out = str(tmp_path / "out")
    for k, rows in enumerate(([dict(RECORDS[0], credits=5.0, url="1")], [dict(RECORDS[0], credits=6.0, url="1")])):
        (tmp_path / f"in{k}" / "records").mkdir(parents=True)
        as_records(spark, rows, tmp_path / f"in{k}")
        stream = incremental.read_records(spark, str(tmp_path / f"in{k}" / "records"))
        incremental.start_load(stream, out, str(tmp_path / f"mark{k}")).awaitTermination(120)
    both = spark.read.schema(load.MODULE_DDL).json([str(tmp_path / f"in{k}" / "records") for k in (0, 1)])
    store, _ = incremental.read_loaded(spark, out)
    assert contents(store) == contents(load.load(both)[0])
    incremental.publish(spark, out, str(tmp_path / "ready"))
    ready = read_store(spark, str(tmp_path / "ready"))
    assert ready["module"].count() == 1 and ready["event"].count() == store["event"].count()


def test_links_unite_their_paths(spark, tmp_path):
    for k, path in enumerate(("p1", "p2", "p1")):
        spark.createDataFrame([("n", "u", path)], incremental.LINK_DDL).coalesce(1).write.mode("append").json(str(tmp_path / "links"))
    stream = spark.readStream.schema(incremental.LINK_DDL).option("maxFilesPerTrigger", 1).json(str(tmp_path / "links"))
    query = incremental.united_links(stream).writeStream.outputMode("complete").format("memory").queryName("united").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.table("united").collect()] == [("n", "u", ["p1", "p2"])]


def test_terms_and_faculties_of_odd_nodes(spark, tmp_path):
    record = dict(RECORDS[0], path=[["Root", "SoSe: 2025", "06-Law"], ["WiSe 2026", "11 - Arts"], ["SoSe x"]], courses=[], exams=[], achievements=[])
    store, _ = load.load(as_records(spark, [record], tmp_path))
    assert {(r["name"], r["year"], r["term"]) for r in store["semester"].collect()} == {("SoSe: 2025", 2025, "SoSe"), ("WiSe 2026", 2026, "WiSe")}
    assert store["module_semester"].count() == 2
    assert [r["path"][0] for r in store["module_path"].orderBy("position").collect()] == ["Root", "WiSe 2026", "SoSe x"]
    assert degrees.module_prefixes(store).first()["prefix"] == 6


def test_store_round_trip(spark, tmp_path):
    store, _ = load.load(as_records(spark, RECORDS, tmp_path))
    write_store(store.with_tables(degree=spark.createDataFrame([], entity_schema("degree")), status=store["status"]), str(tmp_path / "st"))
    back = spark.read.parquet(str(tmp_path / "st" / "event"))
    assert back.count() == store["event"].count() and "event_month" in back.columns
    assert back.where(F.col("event_month") == "2026-04-01").count() == 3
