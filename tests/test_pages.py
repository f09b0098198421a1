"""Pages as files, in versions; topics with their first jobs."""

import os

import pytest

from millrace.operators.tables import Versions
from millrace.plans import pages

PAGES_SCHEMA = "slug string, payload string"
SLUGS = ["plain", "a b", "a/b", "../up", ".hidden", "_under", "é+%25=x", "a%20b", "ж" * 20]


@pytest.fixture
def store(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/site")


def read(store, version=None):
    return sorted((r.slug, r.payload) for r in pages.read_pages(store, version).collect())


def test_round_trip_of_any_slug(spark, store, tmp_path):
    rows = [(s, f'{{"n": "{s}\\n"}}') for s in SLUGS] + [(None, "x"), ("", "x"), ("none", None), ("twice", "b"), ("twice", "a")]
    assert read(store) == []
    assert pages.publish_pages(store, "r1", spark.createDataFrame(rows, "slug string, payload string")) == 1
    assert read(store) == sorted([*rows[: len(SLUGS)], ("twice", "a")])
    files = [os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "site" / "data") for f in fs if f.endswith(".json") and not f.startswith(".")]
    assert len(files) == len(SLUGS) + 1


def test_versions_switch_whole(spark, store):
    of = lambda *rows: spark.createDataFrame(list(rows), "slug string, payload string")
    pages.publish_pages(store, "r1", of(("a", "1"), ("b", "1")))
    assert pages.publish_pages(store, "r1", of(("a", "other"))) == 1
    pages.publish_pages(store, "r2", of(("a", "2"), ("c", "2")))
    assert read(store) == [("a", "2"), ("c", "2")] and read(store, 1) == [("a", "1"), ("b", "1")]
    failing = of(("a", "3")).selectExpr("slug", "CAST(raise_error('stop') AS STRING) AS payload")
    with pytest.raises(Exception, match="stop"):
        pages.publish_pages(store, "r3", failing)
    assert store.latest() == 2 and read(store) == [("a", "2"), ("c", "2")]
    pages.publish_pages(store, "r4", of())
    assert read(store) == []


def test_a_task_that_runs_twice_leaves_the_same_files(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"slug": ["a", "b"], "payload": ["1", "2"]})
    for _ in range(2):
        assert [b.to_pylist() for b in pages._write_files(f"file://{tmp_path}", iter([batch]))] == [[{"slug": "a", "bytes": 1}, {"slug": "b", "bytes": 1}]]
    assert sorted(f for _, _, fs in os.walk(tmp_path) for f in fs) == ["a.json", "b.json"]


def test_topic_heads_keep_k_rows_before_the_shuffle(spark):
    jobs = spark.range(200).selectExpr("CAST(id AS STRING) AS id", "id AS ord", "IF(id % 2 = 0, array('rag', 'llm', 'rag'), array('rag')) AS clusters", "'s' AS slug", "'t' AS title", "'c' AS company_name")
    got = pages.topic_heads(pages.topics(spark), jobs)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and ", Partial" in text
    rows = got.collect()
    assert {(r.id, r.n) for r in rows} == {("rag", 200), ("llm", 100), ("agents", 0), ("evals", 0), ("inference", 0), ("finetuning", 0)}
    assert sorted((r.position, int(r.job_id)) for r in rows if r.id == "llm") == [(k + 1, 2 * k) for k in range(50)]
    lists = {r.id: r.json for r in pages.topic_json(got, "https://s").collect()}
    full = {r.id: r.json for r in pages.topic_json(pages.topic_pages(pages.topics(spark), jobs), "https://s").collect()}
    assert lists == full and '"numberOfItems":200' in lists["rag"]


def test_the_driver_lists_no_pages(spark, store, monkeypatch):
    """What is planned and scanned is the table of the files, whose number doesn't grow with the pages; a page that is gone isn't passed over."""
    rows = [(f"p{k}/é", f"{k}\n") for k in range(300)]
    pages.publish_pages(store, "r1", spark.createDataFrame(rows, PAGES_SCHEMA).repartition(3))
    got = pages.read_pages(store)
    assert len(got.inputFiles()) < 20 and all("/files/" in f for f in got.inputFiles())
    monkeypatch.setattr(pages, "READ_ROWS", 7)
    assert sorted((r.slug, r.payload) for r in pages.read_pages(store).collect()) == sorted(rows)
    folder = store.root.removeprefix("file://") + "/" + store.manifest(1)["tables"]["pages"]
    batch = [pages.pa.RecordBatch.from_pydict({"slug": [s for s, _ in rows]})]
    assert [b.num_rows for b in pages._read_files(f"file://{folder}", iter(batch))] == [7] * 42 + [6]
    os.remove(f"{folder}/{pages.page_file('p7/é')}")
    with pytest.raises(Exception, match="FileNotFound"):
        pages.read_pages(store).collect()
