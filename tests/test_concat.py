"""Concatenation in parts against plain Python."""

import random

import pytest

from syllabary.operators.concat import joined_in_parts

DDL = "k string, part string, v string"


def wanted(rows, separator, limit):
    groups = {}
    for k, _, v in rows:
        if v is not None:
            groups.setdefault(k, set()).add(v)
    out = {}
    for k, values in groups.items():
        at = 0
        for v in sorted(values, key=lambda v: v.encode()):
            out.setdefault((k, at // limit + 1), []).append(v)
            at += len(v) + len(separator)
    return {at: separator.join(values) for at, values in out.items()}


@pytest.mark.parametrize("limit,ranges", [(40, 7), (10**6, 7), (1000, 1)])
def test_parts_do_not_depend_on_ranges(spark, limit, ranges):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", "", None]), "x", rng.choice([None, "", "Ä", "z" * 90, str(rng.randrange(300))])) for _ in range(900)]
    df = spark.createDataFrame(rows, DDL).repartition(5)
    got = joined_in_parts(df, ["k"], "v", limit=limit, ranges=ranges).collect()
    assert {(r.k, r.part): r.joined for r in got} == wanted(rows, " | ", limit)
    assert len(got) == len({(r.k, r.part) for r in got})


def test_empty_table_and_no_values(spark):
    assert joined_in_parts(spark.createDataFrame([], DDL), ["k"], "v").isEmpty()
    assert joined_in_parts(spark.createDataFrame([("a", "x", None)], DDL), ["k"], "v").isEmpty()
