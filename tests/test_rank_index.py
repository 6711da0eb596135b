"""The rank index against sorting in plain Python."""

import random

import pytest

from syllabary.operators import ordering, rank_index

DDL = "id long, v string, n int"


def made(seed, count):
    """Rows of which a third has one sort value and some have none."""
    rng = random.Random(seed)
    values = [None, "hot", "hot", "a", "zz", "Ä", *map(str, range(40))]
    return [(i, rng.choice(values[:3] if rng.random() < 0.4 else values), rng.randrange(9)) for i in rng.sample(range(10 * count), count)]


def in_order(rows, order):
    by_id = sorted(rows, key=lambda r: r[0])
    if order == "desc":
        return sorted((r for r in by_id if r[1] is not None), key=lambda r: r[1].encode(), reverse=True) + [r for r in by_id if r[1] is None]
    return sorted(by_id, key=lambda r: (r[1] is not None, (r[1] or "").encode()))


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_and_tokens_equal_the_sorted_rows(spark, order):
    rows = made(1, 900)
    index = rank_index.rank_index(spark.createDataFrame(rows, DDL).repartition(5), "v", order, ranges=7)
    want = in_order(rows, order)
    assert index.total == 900 and len(index.counts) > 4
    for page, size in ((1, 7), (3, 100), (9, 100), (10, 100), (5, 250), (1, 2000)):
        got = [tuple(r) for r in index.page(page, size).collect()]
        assert got == want[(page - 1) * size : page * size], (page, size)
    for at in (0, 10, 448, 449, 450, 700, 895, 899):
        got = [tuple(r) for r in index.after((want[at][1], want[at][0]), 120).collect()]
        assert got == want[at + 1 : at + 121], at
    gone = index.after(("hot", -1), 10)  # no such row
    first = next(i for i, r in enumerate(want) if r[1] == "hot")
    assert [tuple(r) for r in gone.collect()] == want[first : first + 10]


def test_a_page_reads_the_ranges_it_touches(spark):
    rows = [(i, None, 0) for i in range(4000)]
    index = rank_index.rank_index(spark.createDataFrame(rows, DDL).repartition(4), None, ranges=6)
    assert index.keys == ["id"] and len(index.counts) > 4
    deep = index.page(3900, 1)
    assert [r["id"] for r in deep.collect()] == [3899]
    assert len(deep.inputFiles()) >= 1 and len(index.touched(3899, 1)[0]) == 1
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    begin = index.counts[0][1]
    assert [len(index.touched(begin - 1, 2)[0]), len(index.touched(begin, 1)[0]), index.touched(4000, 5)] == [2, 1, ([], 0)]


def test_odd_indexes(spark):
    empty = rank_index.rank_index(spark.createDataFrame([], DDL), "v")
    assert empty.total == 0 and empty.page(1, 5).count() == 0 and empty.after(("a", 1), 5).count() == 0
    assert empty.page(1, 5).columns == ["id", "v", "n"]
    with pytest.raises(ValueError):
        rank_index.rank_index(spark.createDataFrame([], "x int"), "v")
    with pytest.raises(ValueError):
        empty.page(0, 5)
    with pytest.raises(ValueError):
        empty.after(("a",), 5)
    clash = spark.createDataFrame([(i, i % 3, i, i, i) for i in range(9)], "id int, n int, _range int, last int, `key` int")
    for order in ("asc", "desc"):
        index = rank_index.rank_index(clash, "n", order, ranges=3)
        want = sorted(range(9), key=lambda i: (i % 3 if order == "asc" else -(i % 3), i))
        assert index.page(1, 9).columns == clash.columns and [r["_range"] for r in index.page(2, 4).collect()] == want[4:8]
        assert [r["id"] for r in index.after((want[4] % 3, want[4]), 9).collect()] == want[5:]
    twice = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (None, "a", 2), (None, None, 3)], DDL)
    index = rank_index.rank_index(twice, "v")
    assert [r["n"] for r in index.page(1, 9).collect()] == [3, 2, 1, 1]
    assert [r["n"] for r in index.page(2, 2).collect()] == [1, 1] and [r["n"] for r in index.after(("a", None), 9).collect()] == [1, 1]
    assert [r["n"] for r in ordering.page(twice, 2, 2, "v").collect()] == [1, 1]
