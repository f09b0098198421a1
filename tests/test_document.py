"""The document in slices: valid JSON in order, read back in splits, replaced whole."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.plans import snapshot
from millrace.sources.schemas import flat

NOW = dt.datetime(2025, 1, 1)


def jobs(spark, n):
    df = spark.range(n, numPartitions=5).select(F.col("id").cast("string").alias("id"), F.concat(F.lit(',{"\n é'), F.col("id").cast("string")).alias("title"), F.array(F.lit("rag"), F.lit("cloud")).alias("clusters"), F.lit("senior").alias("seniority"), F.lit(None).cast("string").alias("remote_type"))
    return df.withColumn("ord", F.struct(-F.col("id").cast("long")))


def test_a_document_is_json_in_order(spark, tmp_path):
    companies = spark.createDataFrame([("c2", "B"), ("c1", "A")], flat("id string, name string"))
    path = f"file://{tmp_path}/snapshot.json"
    for n in (200, 7):
        open_ = jobs(spark, n)
        snapshot.write_slices(open_, companies, {"GBP": 1.25}, F.lit(NOW), path)
        whole = json.loads((tmp_path / "snapshot.json").read_text())
        assert (tmp_path / "snapshot.json").read_text().endswith("}\n")
        assert list(whole) == ["generatedAt", "fxRates", "jobs", "companies", "facets"] and whole["fxRates"] == {"GBP": 1.25}
        assert [j["id"] for j in whole["jobs"]] == [str(k) for k in reversed(range(n))] and "remote_type" not in whole["jobs"][0]
        assert [c["id"] for c in whole["companies"]] == ["c1", "c2"]
        assert [(c["id"], c["count"]) for c in whole["facets"]["clusters"]] == [("rag", n), ("cloud", n)] and whole["facets"]["remoteType"] == []
        schema = open_.drop("ord").schema
        assert sorted(map(str, snapshot.read_slices(spark, path, "jobs", schema).collect())) == sorted(map(str, open_.drop("ord").collect()))
        assert snapshot.read_slices(spark, path, "companies", companies.schema).count() == 2
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["snapshot.json"]


def test_a_failed_writer_leaves_the_old_document(spark, tmp_path):
    companies = spark.createDataFrame([], flat("id string, name string"))
    path = f"file://{tmp_path}/snapshot.json"
    snapshot.write_slices(jobs(spark, 3), companies, {}, F.lit(NOW), path)
    old = (tmp_path / "snapshot.json").read_text()
    assert json.loads(old)["companies"] == [] and len(json.loads(old)["jobs"]) == 3
    bad = jobs(spark, 50).withColumn("title", F.when(F.col("id") == "31", F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        snapshot.write_slices(bad, companies, {}, F.lit(NOW), path)
    assert (tmp_path / "snapshot.json").read_text() == old
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["snapshot.json"]
