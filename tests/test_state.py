"""State scenarios: new, unchanged, changed, returned, vanished, failed feed, direct; runs and streams."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import relational as rel
from millrace.operators import state
from millrace.plans import ingest
from millrace.sources.schemas import JOB_SKILLS, JOBS, RAW_POSTING
from millrace.streaming.state import latest, stateful

T = lambda d: dt.datetime(2025, 1, d)


def postings(spark, *rows):
    """(external id, title, text) rows of the board "acme"."""
    base = {f.name: None for f in RAW_POSTING}
    data = [tuple((base | {"external_id": i, "title": t, "description_text": x, "apply_url": "u" if t != "no url" else "", "location_raw": "London"})[f.name] for f in RAW_POSTING) for i, t, x in rows]
    return spark.createDataFrame(data, RAW_POSTING).withColumns({"slug": F.lit("acme"), "ats_provider": F.lit("lever")})


def targets(spark):
    return spark.createDataFrame([("acme", "lever", "c_acme", "c_acme_lever", "acme")], "ats_token string, ats_provider string, company_id string, source_id string, slug string")


def run(spark, jobs, bridge, rows, day, polled=("c_acme_lever",), scorer=None):
    p = spark.createDataFrame([(s,) for s in polled], "source_id string")
    jobs, bridge, counters = ingest.run(jobs, bridge, postings(spark, *rows), targets(spark), p, F.lit(T(day)), scorer)
    jobs = spark.createDataFrame(jobs.collect(), JOBS)
    return jobs, spark.createDataFrame(bridge.collect(), JOB_SKILLS), counters.first()


def test_runs(spark):
    jobs, bridge = spark.createDataFrame([], JOBS), spark.createDataFrame([], JOB_SKILLS)
    first = [("1", "LLM Engineer", "RAG and Python"), ("2", "Data Analyst", "Python"), ("3", "Agents dev", "Go"), ("4", "no url", "x")]
    jobs, bridge, n = run(spark, jobs, bridge, first, 1)
    rows = {r.external_id: r for r in jobs.collect()}
    assert set(rows) == {"1", "2", "3"} and (n.processed, n.unchanged, n.in_scope) == (3, 0, 2)
    assert rows["1"].is_new and not rows["1"].is_closed and rows["1"].ingested_at == T(1) and rows["1"].country == "GB" and rows["2"].classification == "out"
    assert sorted(r.skill_id for r in bridge.collect()) == ["sk_go", "sk_python", "sk_rag"]

    twice = [*first, ("1", "LLM Engineer", "RAG and Python"), ("2", "Data Analyst", "Zig")]  # repeated as it was; with another text
    other, _, n = run(spark, spark.createDataFrame([], JOBS), spark.createDataFrame([], JOB_SKILLS), twice, 1, polled=("c_acme_lever", "x"))
    assert (n.fetched, n.processed, n.unchanged, n.in_scope, n.closed, n.feeds_failed) == (6, 4, 1, 2, 0, 0)
    assert other.count() == 3

    again, same, n = run(spark, jobs, bridge, first, 2)  # the same batch: only last_seen_at moves
    assert (n.processed, n.unchanged) == (0, 3) and all(r.last_seen_at == T(2) and r.ingested_at == T(1) for r in again.collect())
    assert sorted(same.collect()) == sorted(bridge.collect())

    jobs, bridge, n = run(spark, again, same, [("1", "LLM Engineer", "now Rust"), ("2", "Data Analyst", "Python")], 3)  # changed; vanished
    rows = {r.external_id: r for r in jobs.collect()}
    assert (n.processed, n.unchanged) == (1, 1) and rows["3"].is_closed and not rows["1"].is_closed and rows["1"].ingested_at == T(1) and rows["1"].description_text == "now Rust"
    assert sorted(r.skill_id for r in bridge.collect()) == ["sk_go", "sk_rust"]

    jobs, bridge, n = run(spark, jobs, bridge, [("3", "Agents dev", "Go")], 4)  # returned with the same text: processed again and open
    rows = {r.external_id: r for r in jobs.collect()}
    assert n.processed == 1 and not rows["3"].is_closed and rows["1"].is_closed and rows["2"].is_closed

    after, _, _ = run(spark, jobs, bridge, [], 5, polled=())  # a failed feed closes nothing
    assert {r.external_id: r.is_closed for r in after.collect()} == {"1": True, "2": True, "3": False}


def test_scorer_sees_only_what_is_undecided(spark):
    asked = []

    def scorer(df):
        asked.extend(r.title for r in df.collect())
        return df.select("id", F.when(F.col("title") == "LLM Engineer", F.lit('{"inScope": false, "confidence": 0.9}')).otherwise(F.lit('{"inScope": true, "skills": ["gpu"], "city": "Bonn", "salaryMin": 5}')).alias("record"))

    jobs, bridge, _ = run(spark, spark.createDataFrame([], JOBS), spark.createDataFrame([], JOB_SKILLS), [("1", "LLM Engineer", "x"), ("2", "Sales", "x"), ("3", "Tools Engineer", "x")], 1, scorer=scorer)
    rows = {r.external_id: r for r in jobs.collect()}
    assert "Sales" not in asked and rows["1"].classification == "out" and rows["3"].classification == "in" and rows["3"].salary_min == 5.0 and rows["3"].city == "London"
    assert [r.skill_id for r in bridge.collect()] == ["sk_gpu"]


def test_close_stale_spares_direct_and_unpolled(spark):
    old = spark.createDataFrame([("a", "s1", False, False, T(1)), ("b", "s1", True, False, T(1)), ("c", "s2", False, False, T(1)), ("d", "s1", False, False, None), ("e", "s1", False, False, T(3)), ("f", "s1", False, True, T(1))], "id string, source_id string, is_direct boolean, is_closed boolean, last_seen_at timestamp")
    got = state.close_stale(old, spark.createDataFrame([("s1",), ("s1",)], "source_id string"), F.lit(T(2))).collect()
    assert {r.id: r.is_closed for r in got} == {"a": True, "b": False, "c": False, "d": True, "e": False, "f": True}


def test_upserts_of_companies_and_sources(spark):
    c = "id string, name string, slug string, domain string, ats_provider string, ats_token string, stage string, size string"
    old = spark.createDataFrame([("1", "A", "a", "d", "p", "t", "s", "big")], c)
    new = spark.createDataFrame([("1", "B", "z", None, "q", "u", None), ("2", "C", "c", None, "p", "t", None)], c.replace(", size string", ""))
    got = {r.id: tuple(r) for r in state.upsert_companies(old, new).collect()}
    assert got == {"1": ("1", "B", "a", None, "q", "u", None, "big"), "2": ("2", "C", "c", None, "p", "t", None, None)}
    s = "id string, company_id string, ats_provider string, endpoint_url string, status string"
    got = state.upsert_sources(spark.createDataFrame([("1", "c", "p", "u", "off")], s), spark.createDataFrame([("1", "c", "p", "v", "active")], s)).first()
    assert (got.endpoint_url, got.status) == ("v", "active")


def test_relational_blocks(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "c", 2), (1, "d", 2)], "k int, v string, o int")
    assert sorted(tuple(r) for r in rel.keep_first(df, ["k"], [F.col("o")]).collect()) == [(1, "b", 1), (2, "c", 2)]
    assert sorted(tuple(r) for r in rel.keep_last_in_first_place(df, ["k"], F.col("o")).collect()) == [(1, "a", 3, 1), (2, "c", 2, 2)]
    assert [tuple(r) for r in rel.share_of_max(df.select("o"), "o").orderBy("o").collect()] == [(1, 1 / 3), (2, 2 / 3), (2, 2 / 3), (3, 1.0)]


def test_stream_equals_batches(spark, tmp_path):
    schema = "id string, title string"
    for k, rows in enumerate(([("1", "a"), ("2", "b")], [("2", "c"), ("3", "d")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"in{k}"))
    empty = spark.createDataFrame([], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in*"))
    q = stateful(stream, str(tmp_path / "state"), empty, lambda old, batch: state.upsert(old, batch, "id", ["title"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id: r.title for r in latest(spark, str(tmp_path / "state"), 10**6, empty).collect()}
    assert set(got) == {"1", "2", "3"} and got["2"] in "bc"
