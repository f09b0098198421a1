"""Tallies moved by what runs change equal tallies of all that is open after them."""

import random

from pyspark.sql import functions as F

from millrace.plans import stats

SCHEMA = "id string, ord int, company_slug string, company_name string, salary_min double, salary_max double, salary_currency string, salary_period string, remote_type string, country string, seniority string, posted_at timestamp, skills array<string>, content_hash string, is_closed boolean, classification string"


def _job(rng, k, closed=False):
    pick = lambda *x: rng.choice(x)
    pay = pick(None, 0.0, 90000.0, 120000.0, 5.0)
    return (str(k), k, pick("a", "b", None), "n", pay, pick(None, 150000.0), pick("USD", None), pick("year", "hour", None), pick("remote", "hybrid", "onsite", None), pick("DE", None), pick("senior", None), None, pick(None, [], ["RAG"], ["RAG", None, "Go"]), str(rng.random()), closed, "in")


def _set(df):
    return sorted(map(tuple, df.select("board", "key", "value", "n").collect()), key=str)


def test_three_runs(spark):
    rng = random.Random(5)
    now = {k: _job(rng, k) for k in range(60)}
    frame = lambda jobs: spark.createDataFrame(list(jobs.values()), SCHEMA).withColumn("posted_at", F.timestamp_micros(F.col("ord").cast("long") % 7))
    open_ = lambda df: df.where("NOT is_closed")
    state = stats.tallies(open_(frame(now)))
    for run in range(3):
        before, now = now, dict(now)
        for k in rng.sample(sorted(now), 12):
            now[k] = (*now[k][:-2], True, "in") if rng.random() < 0.5 else _job(rng, k)
        now |= {k: _job(rng, k) for k in range(100 * (run + 1), 100 * (run + 1) + 5)}
        was, after = frame(before), frame(now)
        ids = stats.touched(was, after)
        assert {r.id for r in ids.collect()} == {str(k) for k in now if now[k] != before.get(k)}
        state = spark.createDataFrame(stats.moved(state, open_(was), open_(after), ids).collect(), state.schema)
        assert _set(state) == _set(stats.tallies(open_(frame(now)))) and state.where("n <= 0").count() == 0


def test_tallies_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert _set(stats.tallies(none)) == []
    got = stats.boards(stats.tallies(none), stats.company_names(none), F.current_timestamp())
    assert got["headline"].first().asDict() == {"roles": 0, "companies": 0, "remote": 0, "hybrid": 0, "onsite": 0, "remote_percent": stats.stats(none, F.current_timestamp())["headline"].first().remote_percent, "posted_this_week": 0, "median_pay": 0.0}
    assert all(got[k].count() == 0 for k in got if k != "headline")


def test_jobs_are_read_once(spark, tmp_path):
    rng = random.Random(6)
    spark.createDataFrame([_job(rng, k) for k in range(20)], SCHEMA).write.parquet(str(tmp_path / "j"))
    plan = stats.tallies(spark.read.parquet(str(tmp_path / "j")))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("FileScan parquet") == 1 and "partial_count" in plan
