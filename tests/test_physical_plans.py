"""Plans are what they should be: pruned scans, pushed filters, take-ordered top-k, no nested loops over large inputs, no Python."""

import re

import pytest

import __spark_entry__ as entry
from millrace import queries as q

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_filters_pushed(spark):
    text = plan(q.inner_joins(spark, SF))
    assert "EqualTo(o_orderstatus,F)" in text and "GreaterThan(c_acctbal,0.0)" in text
    assert "o_totalprice" not in text and "c_mktsegment" not in text


@pytest.mark.parametrize("name", ["topk_customers", "topk_segments", "topk_parts", "top50_rank", "top_paying_groups"])
def test_top_k_is_a_take_ordered(spark, name):
    assert "TakeOrderedAndProject" in plan(q.QUERIES[name](spark, SF))


#: Queries with a nested-loop join: one side is an aggregate of one row (a maximum, a total, a median).
ONE_ROW = {"bar_share", "ingest_counters", "median_of_nothing", "rolling_7d_flag", "moved_countries", "moved_headline", "moved_top_paying", "stats_countries", "stats_headline", "stats_ranks",
           "stats_seniority", "stats_top_hiring", "stats_top_paid_skills", "stats_top_paying", "stats_top_skills"}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - {"theta_self"} - {n for n in entry.queries() if re.match(r"op\d+_|pipeline|crawl_", n)}))
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert not re.search(r"EvalPython|pythonUDF|Pandas|InArrow|ArrowEval|CartesianProduct", text)
    assert ("NestedLoop" in text) == (name in ONE_ROW)


@pytest.mark.parametrize("name", ["facet_counts", "conditional_counts", "keep_first_dedupe", "keep_last_dedupe", "price_summary", "nest_collect"])
def test_aggregates_combine_before_the_shuffle(spark, name):
    assert "partial_" in plan(q.QUERIES[name](spark, SF))


def test_every_query_has_sql_or_is_learned():
    missing = set(entry.queries()) - set(entry.oracle_sql())
    assert all(re.match(r"op\d+_|pipeline", n) for n in missing)
