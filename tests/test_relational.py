"""Exact medians and facets against plain versions."""

import math
import re
import statistics

import pytest

from millrace.operators.relational import facets, medians, spreads, value_counts

ROWS = [("a", v) for v in (5.0, 1.0, 3.0)] + [("b", v) for v in (1.0, 1.0, 1.0, 9.0)] + [("c", None)] + [(None, v) for v in (2.0, 4.0)] + [("d", -1e300), ("d", 1e300), ("d", 7.0)] + [("e", float(k % 97) ** 3) for k in range(1000)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k string, v double")


def test_medians_by_key(rows):
    want = {}
    for k, v in ROWS:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert {r.k: r.m for r in medians(rows, ["k"], "v", "m").collect()} == {k: statistics.median(v) for k, v in want.items()}


def test_median_of_all_and_of_none(rows):
    assert [r.median for r in medians(rows, [], "v").collect()] == [statistics.median(v for _, v in ROWS if v is not None)]
    assert medians(rows.where("v > 1e301"), [], "v").collect() == [] and medians(rows.where("k = 'c'"), ["k"], "v").collect() == []


def test_medians_with_infinite_values_and_nan(spark):
    inf, nan = math.inf, math.nan
    df = spark.createDataFrame([("i", -inf), ("i", 2.0), ("i", inf), ("n", 1.0), ("n", 2.0), ("n", nan), ("n", nan), ("n", 3.0)], "k string, v double")
    assert {r.k: r.median for r in medians(df, ["k"], "v").collect()} == {"i": 2.0, "n": 3.0}


def test_medians_gather_no_group(rows):
    text = medians(rows, ["k"], "v", "m")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"median|percentile|collect_", text)


def test_facets_read_once(spark):
    df = spark.createDataFrame([(1, ["x", "y"]), (2, ["x", None]), (None, None), (1, [])], "n int, tags array<string>")
    got = facets(df, ["n"], ["tags"])
    assert sorted((r.facet, r.value, r.n) for r in got.collect()) == [("n", "1", 2), ("n", "2", 1), ("tags", "x", 2), ("tags", "y", 1)]
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("far", [1e12, -1e300, math.inf])
def test_medians_of_crowded_values_beside_one_far_away(spark, far):
    values = [100.0 + k * 1e-9 for k in range(2000)] + [far] + [100.0] * 300
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    n, low, median, high = spreads(value_counts(df, ["k"], "v"), ["k"], "v").select("n", "low", "median", "high").first()
    assert (n, low, median, high) == (len(values), min(values), statistics.median(values), max(values))


def test_counts_add_up(spark, rows):
    a, b = rows.where("v > 2"), rows.where("v <= 2")
    parts = value_counts(a, ["k"], "v").unionByName(value_counts(b, ["k"], "v"))
    got = spreads(parts.groupBy("k", "v").sum("n").withColumnRenamed("sum(n)", "n"), ["k"], "v")
    assert sorted(got.collect(), key=str) == sorted(spreads(value_counts(rows, ["k"], "v"), ["k"], "v").collect(), key=str)
