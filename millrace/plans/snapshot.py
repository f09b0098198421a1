"""The read path: open jobs in scope with their companies and skills, facets, and the nested document."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions import enrich
from ..functions import vocabulary as v
from ..functions.text import present, strip_html
from ..operators.relational import counts, with_default_lists
from ..operators.tables import Folder

NEW = "INTERVAL 7 DAYS"


def skill_lists(bridge: DataFrame, skills: DataFrame) -> DataFrame:
    """(job_id, skills, clusters) in taxonomy order."""
    order = F.array_position(F.array(*map(F.lit, enrich.SKILLS)), F.col("name"))
    named = bridge.join(skills.select(F.col("id").alias("skill_id"), "name", "cluster"), "skill_id").select("job_id", F.struct(order.alias("o"), "name", "cluster").alias("s"))
    got = named.groupBy("job_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return got.select("job_id", F.transform("s", lambda x: x["name"]).alias("skills"), F.array_distinct(F.transform("s", lambda x: x["cluster"])).alias("clusters"))


def open_jobs(jobs: DataFrame, companies: DataFrame, bridge: DataFrame, skills: DataFrame, now: Column) -> DataFrame:
    """Snapshot jobs with ``ord``, their place: featured first, then latest, then id."""
    own = jobs.where("classification = 'in' AND NOT is_closed").join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"), F.col("slug").alias("company_slug")), "company_id")
    own = with_default_lists(own, skill_lists(bridge, skills).withColumnRenamed("job_id", "id"), "id", "skills", "clusters")
    text = F.when(present(F.col("description_html")).isNotNull(), strip_html(F.col("description_html"))).otherwise(F.col("description_text"))
    own = own.withColumns({"description_text": text, "is_new": F.col("ingested_at") > now - F.expr(NEW)}).drop("description_html", "source_id", "external_id", "dedup_key", "last_seen_at")
    return own.withColumn("ord", F.struct(~F.col("is_featured"), (-F.unix_micros(F.col("ingested_at").cast("timestamp"))), "id"))


def facet_counts(open_: DataFrame) -> dict[str, DataFrame]:
    """Clusters with labels, most frequent first, then in taxonomy order; seniority; remote type."""
    label = F.create_map(*(F.lit(x) for c, text, _ in v.CLUSTERS for x in (c, text)))
    rank = F.array_position(F.array(*(F.lit(c) for c, _, _ in v.CLUSTERS)), F.col("id"))
    clusters = counts(open_.select(F.explode("clusters").alias("id")), "id", "count").withColumn("label", F.try_element_at(label, "id")).orderBy(F.desc("count"), rank)
    plain = {c: counts(open_, c, "count").withColumnRenamed(c, "id") for c in ("seniority", "remote_type")}
    return {"clusters": clusters, **plain}


def document(open_: DataFrame, companies: DataFrame, rates: dict[str, float], generated_at: Column) -> DataFrame:
    """One row with the JSON document of the whole snapshot. For snapshots of a site's size; larger ones are written as the tables above."""
    keyed = lambda df, order: df.agg(F.array_sort(F.collect_list(F.struct(order.alias("_o"), F.struct(*[c for c in df.columns if c != "ord"]).alias("r")))).alias("x")).select(F.transform("x", lambda e: e["r"]).alias("x"))
    parts = {"jobs": keyed(open_, F.col("ord")), "companies": keyed(companies, F.col("id"))}
    facets = facet_counts(open_)
    names = {"clusters": keyed(facets["clusters"], F.struct(-F.col("count"), "id")), "seniority": keyed(facets["seniority"], F.col("id")), "remoteType": keyed(facets["remote_type"], F.col("id"))}
    base = open_.sparkSession.range(1).select(generated_at.alias("generatedAt"), F.create_map(*(F.lit(x) for kv in rates.items() for x in kv)).alias("fxRates"))
    for k, df in {**parts, **names}.items():
        base = base.crossJoin(df.withColumnRenamed("x", k))
    doc = F.struct("generatedAt", "fxRates", "jobs", "companies", F.struct("clusters", "seniority", "remoteType").alias("facets"))
    return base.select(F.to_json(doc, {"pretty": "true"}).alias("value"))


def write_document(doc: DataFrame, path: str) -> None:
    doc.coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, jobs: StructType, companies: StructType) -> tuple[DataFrame, DataFrame]:
    """(jobs, companies) of a snapshot document, with the schemas given and ``ord`` the place in the document."""
    one = spark.read.schema(StructType([StructField("jobs", ArrayType(jobs)), StructField("companies", ArrayType(companies))])).option("multiLine", True).json(path)
    return tuple(one.select(F.posexplode(c).alias("ord", "r")).select("ord", "r.*") for c in ("jobs", "companies"))


#: The arrays of a document written in slices; an element's line begins with as many blanks as its array's place, so that lines can be told apart wherever a split begins.
ARRAYS = ["jobs", "companies", "clusters", "seniority", "remoteType"]


def write_slices(open_: DataFrame, companies: DataFrame, rates: dict[str, float], generated_at: Column, path: str) -> None:
    """The document of ``document`` as one file at ``path``, one element a line: each array is sorted by ranges and its tasks write slices of it; the driver then joins the slices,
    a stream at a time, and puts the file in place by a rename, so that readers see the old document or the new one. Nothing is gathered in a task or the driver."""
    spark = open_.sparkSession
    facets = facet_counts(open_)
    parts = [(open_, "ord"), (companies, "id"), (facets["clusters"], None), (facets["seniority"], "id"), (facets["remote_type"], "id")]
    drafts = Folder(spark, f"{path}.{uuid.uuid4().hex}")
    head = spark.range(1).select(F.to_json(F.struct(generated_at.alias("generatedAt"), F.create_map(*(F.lit(x) for kv in rates.items() for x in kv)).alias("fxRates"))).alias("h")).first()["h"]
    try:
        for name, (df, order) in zip(ARRAYS, parts, strict=True):
            rows = df.orderBy(order) if order else df
            row = F.to_json(F.struct(*[c for c in df.columns if c != "ord"]))
            rows.select(F.concat(F.lit("," + " " * (1 + ARRAYS.index(name))), row).alias("value")).write.text(f"{drafts.path}/{name}")
        own = drafts.child("document")
        out = drafts.fs.create(own, False)
        say = lambda text: out.write(bytearray(text.encode()))
        say(head[:-1])
        for name in ARRAYS:
            say((',\n"facets":{\n' if name == "clusters" else ",\n") + f'"{name}":[\n')
            first = True
            folder = Folder(spark, f"{drafts.path}/{name}")
            for slice_ in (n for n in folder.names() if n.startswith("part-")):
                if folder.fs.getFileStatus(folder.child(slice_)).getLen():
                    stream = folder.fs.open(folder.child(slice_))
                    if first:
                        stream.seek(1)  # the comma before the first element
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, folder.conf, False)
                    stream.close()
                    first = False
            say("]")
        say("}}\n")
        out.close()
        drafts.move(own, spark._jvm.org.apache.hadoop.fs.Path(path), True)
    finally:
        drafts.delete()


def read_slices(spark: SparkSession, path: str, array: str, schema: StructType) -> DataFrame:
    """The elements of one array of a document that ``write_slices`` made, read in splits of the file."""
    line = F.regexp_replace("value", "^,", "")
    blanks = " " * (1 + ARRAYS.index(array))
    return spark.read.text(path).select(line.alias("value")).where(F.startswith("value", F.lit(blanks + "{"))).select(F.from_json("value", schema).alias("r")).select("r.*")
