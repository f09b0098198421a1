"""The operators marked native run no Python on the executors, and none joins without keys."""

import re

import pytest

from millrace.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_mixing", "op8_chat_pairs", "op9_quality_rules"])
def test_no_python(spark, name):
    text = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Pandas|MapInArrow|ArrowEval|CartesianProduct|BroadcastNestedLoop", text)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_one_row_per_row(spark, name):
    df = queries.QUERIES[name](spark, SF)
    n = {"op6_url_filter": "pages", "op3_mixing": None, "op8_chat_pairs": None, "op13_spelling": None}.get(name, "documents")
    assert n is None or df.count() == spark.read.parquet(f"{SF}/{n}.parquet").count()
