from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sitewright.operators.periods import periods_and_gaps, prefix_combine

SHAPE = "who string, a bigint, b bigint"


def plain(rows):
    found, by = set(), {}
    for who, a, b in rows:
        if None not in (who, a, b):
            by.setdefault(who, []).append((min(a, b), max(a, b)))
    for who, some in by.items():
        some.sort()
        start, end = some[0]
        for a, b in some[1:]:
            if a > end + 1:
                found |= {(who, "covered", start, end), (who, "gap", end + 1, a - 1)}
                start, end = a, b
            else:
                end = max(end, b)
        found.add((who, "covered", start, end))
    return found


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_random_intervals(spark, partitions):
    r = random.Random(partitions)
    rows = []
    for _ in range(600):
        a = r.randrange(3000)
        rows.append((r.choice("xxxxxyz"), a, a + r.choice([0, 1, 5, 40]) * r.choice([1, -1])))
    rows += [("long", 0, 10_000), *(("long", 20 * i, 20 * i + 3) for i in range(300))]
    assert got(periods_and_gaps(spark.createDataFrame(rows, SHAPE), "who", "a", "b", partitions=partitions)) == plain(rows)


def test_one_key_over_many_partitions(spark):
    rows = [("hot", 10 * i, 10 * i + (9 if i % 7 else 4)) for i in range(2000)]
    assert got(periods_and_gaps(spark.createDataFrame(rows, SHAPE), "who", "a", "b", partitions=8)) == plain(rows)


def test_nulls_ties_and_clashing_names(spark):
    rows = [("x", 1, 5), ("x", 1, 5), ("x", 6, 6), ("x", 9, 8), (None, 1, 2), ("x", None, 3), ("x", 4, None), ("", 3, 3)]
    df = spark.createDataFrame(rows, SHAPE).withColumns({"entity": F.lit("q"), "start": F.lit(0), "part": F.lit(None)})
    assert got(periods_and_gaps(df, "who", "a", "b")) == {("x", "covered", 1, 6), ("x", "gap", 7, 7), ("x", "covered", 8, 9), ("", "covered", 3, 3)}


def test_empty(spark):
    df = periods_and_gaps(spark.createDataFrame([], SHAPE), "who", "a", "b")
    assert df.collect() == [] and df.columns == ["entity", "kind", "start", "stop"]


def test_prefix_combination_skips_nothing():
    rows = [(0, "a", "a", 50, 0), (1, "a", "a", 20, 15), (2, "a", "b", 9, 5), (3, "b", "b", 30, 12)]
    assert prefix_combine(rows, 1) == {1: ("a", 50, 0), 2: ("a", 50, 0), 3: ("b", 9, 5)}
