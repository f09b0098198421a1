"""Versions are published whole or not at all, once a run, and stay readable."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import tables
from millrace.plans import ingest
from millrace.sources.schemas import JOB_SKILLS, JOBS, RAW_POSTING, flat
from millrace.sources.scorer import MEMO, client

ROWS = flat("id string, n bigint")


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), ROWS)


def got(store, version=None, table="t"):
    return sorted(map(tuple, store.read(table, ROWS, version).collect()))


def test_versions(spark, tmp_path):
    store = tables.Versions(spark, f"file://{tmp_path}/s")
    assert store.latest() == 0 and got(store) == []
    assert store.commit("a", {"t": rows(spark, ("x", 1)), "u": rows(spark, ("y", 2))}, 0) == 1
    assert store.commit("b", {"t": rows(spark, ("x", 3))}, 1) == 2
    assert (got(store), got(store, 1), got(store, table="u")) == ([("x", 3)], [("x", 1)], [("y", 2)])
    assert store.commit("a", {"t": rows(spark, ("z", 9))}, 2) == 1 and store.latest() == 2  # that run was committed


def test_a_failing_task_publishes_nothing(spark, tmp_path):
    store = tables.Versions(spark, f"file://{tmp_path}/s")
    store.commit("a", {"t": rows(spark, ("x", 1))}, 0)
    bad = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("id"), F.lit(1).cast("long").alias("n"))
    with pytest.raises(Exception, match="lost"):
        store.commit("b", {"t": rows(spark, ("x", 2)), "u": bad}, 1)
    assert store.latest() == 1 and got(store) == [("x", 1)]
    assert store.commit("b", {"t": rows(spark, ("x", 2))}, 1) == 2 and got(store) == [("x", 2)]
    assert len(store.vacuum(keep=1)) == 2 and store.numbers() == [2] and got(store) == [("x", 2)]


def test_two_runs_from_one_version(spark, tmp_path):
    store = tables.Versions(spark, f"file://{tmp_path}/s")
    store.commit("a", {"t": rows(spark, ("x", 1))}, 0)
    store.commit("b", {"t": rows(spark, ("x", 2))}, 1)
    with pytest.raises(tables.NotCommitted):
        store.commit("c", {"t": rows(spark, ("x", 3))}, 1)
    assert got(store) == [("x", 2)] and store.commit("c", {"t": rows(spark, ("x", 3))}, 2) == 3
    assert len(tables.Folder(spark, f"file://{tmp_path}/s/data").names()) == 3


def posted(spark, *says):
    has = lambda k, t: {"external_id": k, "title": t, "description_text": "Python", "apply_url": "u"}
    names = [f.name for f in RAW_POSTING]
    df = spark.createDataFrame([tuple(has(k, t).get(n) for n in names) for k, t in says], RAW_POSTING)
    return df.select(F.lit("acme").alias("slug"), F.lit("lever").alias("ats_provider"), "*")


def test_a_run_is_committed_once(spark, tmp_path):
    store = tables.Versions(spark, f"file://{tmp_path}/s")
    targets = spark.createDataFrame([("acme", "lever", "c", "s", "acme")], "ats_token string, ats_provider string, company_id string, source_id string, slug string")
    polled, at = targets.select("source_id"), lambda d: F.lit(dt.datetime(2025, 1, d))
    assert ingest.commit(store, "r1", posted(spark, ("1", "AI Engineer"), ("2", "AI Engineer II")), targets, polled, at(1)) == 1
    for _ in range(2):
        assert ingest.commit(store, "r2", posted(spark, ("2", "AI Engineer II"), ("3", "AI Engineer III"), ("4", "")), targets, polled, at(2)) == 2
    now = {r.external_id: (r.title, r.is_closed, r.ingested_at.day) for r in store.read("jobs", JOBS).collect()}
    assert now == {"1": ("AI Engineer", True, 1), "2": ("AI Engineer II", False, 1), "3": ("AI Engineer III", False, 2)}
    assert {r.is_closed for r in store.read("jobs", JOBS, 1).collect()} == {False}
    assert store.read("job_skills", JOB_SKILLS).count() == 3
    assert store.read("skills", flat("id string, name string, cluster string")).collect()[0].name == "Python"
    c = store.read("run_counters", flat("fetched bigint, processed bigint, unchanged bigint, in_scope bigint, closed bigint, feeds_failed bigint")).first()
    assert tuple(c) == (3, 1, 1, 1, 1, 0)


def _yes(rows):
    if any("Platform" in r["title"] for r in rows):
        raise OSError
    return ['{"inScope": true, "confidence": 0.9, "city": "Bonn"}'] * len(rows)


def test_answers_of_the_scorer_are_kept(spark, tmp_path):
    store = tables.Versions(spark, f"file://{tmp_path}/s")
    targets = spark.createDataFrame([("acme", "lever", "c", "s", "acme")], "ats_token string, ats_provider string, company_id string, source_id string, slug string")
    says, at = [("1", "Tools Engineer"), ("2", "Tools Engineer"), ("3", "Platform Engineer")], lambda d: F.lit(dt.datetime(2025, 1, d))
    ingest.commit(store, "r1", posted(spark, *says), targets, targets.select("source_id"), at(1), client(_yes, 1, 1))
    memo = store.read("scorer_memo", flat(MEMO)).collect()
    assert len(memo) == 1 and {r.external_id: r.city for r in store.read("jobs", JOBS).collect()} == {"1": "Bonn", "2": "Bonn", "3": None}
    never = lambda rows: ["no"] * len(rows)
    ingest.commit(store, "r2", posted(spark, *says, ("4", "Tools Engineer")), targets, targets.select("source_id"), at(2), client(never, 1, 1))
    assert store.read("scorer_memo", flat(MEMO)).collect() == memo
    assert {r.external_id: r.city for r in store.read("jobs", JOBS).collect()} == {"1": "Bonn", "2": "Bonn", "3": None, "4": "Bonn"}


def test_a_run_reads_each_input_once(spark, tmp_path):
    posted(spark, ("1", "AI Engineer")).write.parquet(f"{tmp_path}/postings")
    spark.createDataFrame([], JOBS).write.parquet(f"{tmp_path}/jobs")
    targets = spark.createDataFrame([("acme", "lever", "c", "s", "acme")], "ats_token string, ats_provider string, company_id string, source_id string, slug string")
    postings, jobs = spark.read.parquet(f"{tmp_path}/postings"), spark.read.parquet(f"{tmp_path}/jobs")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"^[^A-Za-z]*FileScan", plan(ingest.gated(postings, jobs, targets)), re.M)) == 2
    after, links, counters = ingest.run(jobs, spark.createDataFrame([], JOB_SKILLS), postings, targets, targets.select("source_id"), F.lit(dt.datetime(2025, 1, 1)))
    for df in (after, links, counters):
        assert f"{tmp_path}/postings" not in plan(df) and "rlike" not in plan(df).lower()
