"""Links of a crawl in keyed state: united paths, expiry after the last crawl, late rows, and a restart in between."""

import json
import os
from datetime import datetime, timedelta

from syllabary.streaming import link_state

START = datetime(2025, 1, 1)


def day(n):
    return START + timedelta(days=n)


def crawl(folder, number, rows):
    """One file per micro-batch, in the order of their times of change."""
    os.makedirs(folder, exist_ok=True)
    name = f"{folder}/{number}.json"
    with open(name, "w") as f:
        for link, url, path, n in rows:
            f.write(json.dumps({"name": link, "url": url, "path": path, "crawled_at": n is not None and day(n).isoformat() or None}) + "\n")
    os.utime(name, (1_700_000_000 + number, 1_700_000_000 + number))


def test_paths_are_united_and_links_expire(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("crawl", "changes", "mark"))

    def run():
        stream = spark.readStream.schema(link_state.CRAWL_DDL).option("maxFilesPerTrigger", 1).json(source)
        query = link_state.start_link_changes(stream, out, mark, late_hours=48, keep_hours=240)
        assert query.awaitTermination(150)
        return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])

    crawl(source, 1, [("a", "u1", "p1", 0), ("a", "u1", "p2", 0), ("a", "u1", "p1", 0), ("b", "u2", "p1", 0), ("x", "u9", "p1", None)])
    crawl(source, 2, [("a", "u1", "p1", 5), ("a", "u1", "p3", 4), (None, None, "p1", 4), (None, None, "p1", 5)])
    crawl(source, 3, [("c", "u3", None, 11)])  # a crawl without path
    crawl(source, 4, [("c", "u3", "p9", 14)])
    crawl(source, 5, [("a", "u1", "p1", 13)])  # older than the newest crawl, but in time: keeps its link
    assert run() == 0
    crawl(source, 6, [("b", "u2", "p1", 16)])  # expired on day 10, so new again
    crawl(source, 7, [("a", "u1", "p4", 1)])  # too late
    assert run() == 1
    got = {(r.name, r.url, r.path, r.change, r["at"]) for r in spark.read.parquet(out).collect()}
    new = [("a", "u1", "p1", 0), ("a", "u1", "p2", 0), ("a", "u1", "p3", 4), ("b", "u2", "p1", 0), ("b", "u2", "p1", 16), ("c", "u3", "p9", 14), (None, None, "p1", 4)]
    expired = [("b", "u2", 10)]
    want = {(n, u, p, "new", day(d)) for n, u, p, d in new} | {(n, u, None, "expired", day(d)) for n, u, d in expired}
    assert got == want
    assert spark.read.parquet(out).count() == len(want)
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
