"""Payloads of pages: cards, facts, description blocks, company and topic pages, search, sitemap, structured data."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..functions import enrich
from ..functions import vocabulary as v
from ..functions.text import SPACE, display_text, joined, present, site_url, trim
from ..operators.relational import containing, counts, ranked
from ..operators.tables import Versions

#: Topic pages: cluster id, path, heading.
TOPICS = [
    ("llm", "llm-engineer-jobs", "LLM Engineer"), ("rag", "rag-engineer-jobs", "RAG / Retrieval"), ("agents", "ai-agent-jobs", "AI Agents"),
    ("evals", "ai-eval-jobs", "Evals & Quality"), ("inference", "inference-engineer-jobs", "Inference / Serving"), ("finetuning", "fine-tuning-jobs", "Fine-tuning"),
]
FILES, PAGE = "slug string, bytes long", "slug string, payload string"
HOME, LISTED, STACK, SKILL_WALL, CARD_SKILLS = 50, 50, 14, 16, 4
_PAY = ("salary_min", "salary_max", "salary_currency", "salary_period")


def topics(spark) -> DataFrame:
    return spark.createDataFrame(TOPICS, "id string, path string, label string")


def _role() -> Column:
    return enrich.role(F.coalesce(present(F.col("normalized_title")), F.col("title")))


def cards(jobs: DataFrame) -> DataFrame:
    """Jobs with search text, role, pay label and the first skills."""
    blob = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("company_name", F.lit("")), F.array_join("skills", " "), F.coalesce("location_raw", F.lit(""))))
    return jobs.withColumns({"search": blob, "role": _role(), "pay_label": enrich.format_pay(*map(F.col, _PAY)), "card_skills": F.slice("skills", 1, CARD_SKILLS)})


def home(jobs: DataFrame) -> DataFrame:
    """The best-paid jobs and their rank from 0; ties in snapshot order."""
    return ranked(jobs.withColumn("_pay", enrich.pay_rank(*map(F.col, _PAY))), HOME, F.desc("_pay"), F.asc("ord"), name="home_rank").drop("_pay")


def with_home_rank(jobs: DataFrame) -> DataFrame:
    return jobs.join(home(jobs).select("id", "home_rank"), "id", "left")


def search(jobs: DataFrame, text: str = "", role: str = "", country: str = "", seniority: str = "") -> DataFrame:
    """With any criterion, the matching jobs in snapshot order; with none, the home set by rank."""
    text = text.strip().lower()
    if not (text or role or country or seniority):
        return home(jobs).orderBy("home_rank")
    df = cards(jobs)
    if text:
        df = df.where(F.contains("search", F.lit(text)))
    for c, want in (("role", role), ("country", country), ("seniority", seniority)):
        if want:
            df = df.where(F.col(c) == want)
    return df.orderBy("ord")


def filter_options(jobs: DataFrame, names: DataFrame | None = None) -> dict[str, DataFrame]:
    """Countries by count, with names where known; roles by count, ``Other`` last."""
    country = counts(jobs, "country")
    country = country.join(names, "country", "left").withColumn("label", F.coalesce("label", "country")) if names is not None else country.withColumn("label", F.col("country"))
    roles = counts(jobs.withColumn("role", _role()), "role")
    return {"countries": country.orderBy(F.desc("n"), "country"), "roles": roles.orderBy(F.col("role") == "Other", F.desc("n"), "role")}


BULLET = r"^\s*(?:[•·▪◦‣*]|[-–—](?=\s))\s*".replace(r"\s", f"[{SPACE}]")


def blocks(jobs: DataFrame, key: str = "id", text: str = "description_text") -> DataFrame:
    """(key, block, type, text, items): paragraphs and bullet lists. Consecutive bullets form one list; blank lines and empty bullets
    don't end it, a paragraph does."""
    lines = jobs.select(key, F.posexplode(F.split(display_text(F.coalesce(text, F.lit(""))), "\n")).alias("pos", "line")).withColumn("line", trim(F.col("line"))).where("line <> ''")
    bullet = F.col("line").rlike(BULLET)
    lines = lines.select(key, "pos", bullet.alias("bullet"), F.when(bullet, trim(F.regexp_replace("line", BULLET, ""))).otherwise(F.col("line")).alias("line")).where("line <> ''")
    w = W.partitionBy(key).orderBy("pos")
    starts = ~F.col("bullet") | ~F.coalesce(F.lag("bullet").over(w), F.lit(False))
    runs = lines.withColumn("block", F.sum(starts.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    got = runs.groupBy(key, "block").agg(F.bool_and("bullet").alias("list"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))
    return got.select(key, "block", F.when(F.col("list"), "ul").otherwise("p").alias("type"), F.when(~F.col("list"), F.get("lines", 0)).alias("text"), F.when(F.col("list"), F.col("lines")).alias("items"))


def facts(jobs: DataFrame, country_name: Column | None = None) -> DataFrame:
    """Jobs with facts (label and value, absent ones left out), the capped skill wall and how many more there are."""
    place = F.coalesce(display_text(present(F.col("location_raw"))), joined(", ", F.col("city"), country_name if country_name is not None else F.col("country")))
    role = _role()
    entry = lambda k, c: F.when(present(c).isNotNull(), F.struct(F.lit(k).alias("label"), c.alias("value")))
    every = F.array(
        entry("Salary", enrich.format_pay(*map(F.col, _PAY))), entry("Location", place), entry("Work type", enrich.label(F.col("remote_type"), v.REMOTE_LABELS)),
        entry("Level", enrich.label(F.col("seniority"), v.SENIORITY_LABELS)), entry("Role", F.when(role != "Other", role)),
    )
    return jobs.withColumns({"facts": F.filter(every, lambda x: x.isNotNull()), "skill_wall": F.slice("skills", 1, SKILL_WALL), "more_skills": F.greatest(F.size("skills") - SKILL_WALL, F.lit(0))})


def company_pages(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Companies with open jobs: how many, how many with pay, and their stack: distinct skills in order of first appearance, capped."""
    of = jobs.groupBy(F.col("company_slug").alias("slug")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("salary_min", F.lit(0)) != 0).alias("with_pay"))
    first = jobs.select(F.col("company_slug").alias("slug"), "ord", F.posexplode("skills").alias("pos", "skill")).groupBy("slug", "skill").agg(F.min(F.struct("ord", "pos")).alias("at"))
    kept = first.withColumn("_n", F.row_number().over(W.partitionBy("slug").orderBy("at"))).where(F.col("_n") <= STACK)
    stack = kept.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "skill"))), lambda x: x["skill"]).alias("stack"))
    return companies.join(of, "slug").join(stack, "slug", "left").withColumn("stack", F.coalesce("stack", F.array().cast("array<string>")))


def topic_pages(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every topic page with its jobs and their position from 1; pages without jobs stay."""
    got = containing(pages, jobs, "id", "clusters") if "id" not in jobs.columns else containing(pages, jobs.withColumnRenamed("id", "job_id"), "id", "clusters")
    return got.withColumn("position", F.when(F.col("job_id").isNotNull(), F.row_number().over(W.partitionBy("id").orderBy(F.col("ord").asc_nulls_last())).cast("long")))


def topic_heads(pages: DataFrame, jobs: DataFrame, k: int = LISTED) -> DataFrame:
    """Every topic page with the number of its jobs (``n``) and its first ``k`` jobs with their position from 1; pages without jobs stay, with 0.

    Each task keeps ``k`` jobs a topic before the shuffle, so a topic that holds most jobs sends no more than others."""
    job = jobs.withColumnRenamed("id", "job_id") if "job_id" not in jobs.columns else jobs
    every = job.withColumn("id", F.explode(F.array_distinct("clusters")))
    first = every.withColumn("position", F.row_number().over(W.partitionBy("id").orderBy(F.col("ord").asc_nulls_last())).cast("long")).where(F.col("position") <= k)
    sized = pages.join(every.groupBy("id").agg(F.count("*").alias("n")), "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return sized.join(first, "id", "left")


def job_json(jobs: DataFrame) -> Column:
    """A job's structured-data object; absent fields are left out."""
    pay = F.struct(F.lit("MonetaryAmount").alias("@type"), F.coalesce("salary_currency", F.lit("USD")).alias("currency"),
                   F.struct(F.lit("QuantitativeValue").alias("@type"), F.col("salary_min").alias("minValue"), F.coalesce("salary_max", "salary_min").alias("maxValue"), F.lit("YEAR").alias("unitText")).alias("value"))
    return F.to_json(F.struct(
        F.lit("https://schema.org/").alias("@context"), F.lit("JobPosting").alias("@type"), "title", F.struct(F.lit("Organization").alias("@type"), F.col("company_name").alias("name")).alias("hiringOrganization"),
        F.lit("FULL_TIME").alias("employmentType"), F.coalesce("posted_at", "ingested_at").alias("datePosted"), F.lit(False).alias("directApply"),
        F.when(F.col("remote_type") == "remote", "TELECOMMUTE").alias("jobLocationType"),
        F.when(F.col("country").isNotNull(), F.struct(F.lit("Country").alias("@type"), F.col("country").alias("name"))).alias("applicantLocationRequirements"),
        F.when(F.coalesce("salary_min", F.lit(0)) != 0, pay).alias("baseSalary"),
    ))


def company_json() -> Column:
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Organization").alias("@type"), "name", F.when(present(F.col("domain")).isNotNull(), F.concat(F.lit("https://"), "domain")).alias("url")))


def topic_json(pages: DataFrame, site: str) -> DataFrame:
    """(id, json): the item list of each topic page (of ``topic_heads``, or ``topic_pages``): all jobs counted, the first listed."""
    item = F.struct(F.lit("ListItem").alias("@type"), "position", site_url(F.lit(site), F.concat(F.lit("/jobs/"), "slug")).alias("url"), F.concat("title", F.lit(" — "), "company_name").alias("name"))
    got = pages.groupBy("id", "label").agg((F.max("n") if "n" in pages.columns else F.count("job_id")).alias("n"), F.array_sort(F.collect_list(F.when(F.col("position") <= LISTED, F.struct("position", item.alias("i"))))).alias("items"))
    doc = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ItemList").alias("@type"), F.col("label").alias("name"), F.col("n").alias("numberOfItems"), F.transform("items", lambda x: x["i"]).alias("itemListElement"))
    return got.select("id", F.to_json(doc).alias("json"))


def sitemap_paths(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """(ord, path): home, topics with their salary pages, companies once each, jobs."""
    spark = jobs.sparkSession
    one = spark.range(1).select(F.lit(0).alias("part"), F.lit("").alias("k"), F.lit("/").alias("path"))
    topic = pages.select(F.lit(1), F.col("id"), F.explode(F.array(F.concat(F.lit("/"), "path"), F.concat(F.lit("/salaries/"), "id"))))
    company = jobs.select("company_slug").distinct().select(F.lit(2), "company_slug", F.concat(F.lit("/companies/"), "company_slug"))
    job = jobs.select(F.lit(3), "id", F.concat(F.lit("/jobs/"), "slug"))
    return one.union(topic).union(company).union(job).select(F.struct("part", "k", "path").alias("ord"), "path")


def sitemap(paths: DataFrame, site: str) -> DataFrame:
    """Lines of the sitemap in order; one text file when written from one partition."""
    line = F.concat(F.lit("  <url><loc>"), site_url(F.lit(site), F.col("path")), F.lit("</loc></url>"))
    head = paths.sparkSession.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?>'), (1, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), (3, "</urlset>")], "n int, value string")
    body = paths.select(F.lit(2).alias("n"), "ord", line.alias("value"))
    return head.withColumn("ord", F.lit(None).cast(paths.schema["ord"].dataType)).select("n", "ord", "value").union(body).orderBy("n", "ord").select("value")


ROBOTS = "User-agent: *\nAllow: /\n\nSitemap: {site}/sitemap.xml\n"


def page_file(slug: str) -> str:
    """Where a page lies: one of 256 folders by its slug's crc32, so that no folder holds them all; signs other than letters, digits and ``_.-~`` are escaped as
    in URLs, with ``=`` for ``%``, and so is a first ``.`` or ``_``, which would hide the file."""
    name = quote(slug, safe="").replace("%", "=")
    return f"{zlib.crc32(slug.encode()) & 0xFF:02x}/{f'={ord(name[0]):X}{name[1:]}' if name[:1] in ('.', '_') else name}.json"


def _write_files(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One file a row, each put in place whole: a task that runs twice writes the same files again."""
    store, base = fs.FileSystem.from_uri(folder)
    made: set[str] = set()
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            path = f"{base}/{page_file(r['slug'])}"
            above = path.rsplit("/", 1)[0]
            if above not in made:
                store.create_dir(above, recursive=True)
                made.add(above)
            draft = f"{above}/.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(r["payload"].encode())
            store.move(draft, path)
        yield pa.RecordBatch.from_pydict({"slug": pa.array([r["slug"] for r in rows], pa.string()), "bytes": pa.array([len(r["payload"].encode()) for r in rows], pa.int64())})


def publish_pages(store: Versions, run: str, pages: DataFrame) -> int:
    """Write (slug, payload) as one file a page and publish them as a version of ``store``; its number.

    Tasks write many pages each. Until the manifest is in place readers see the version before; after it, pages that are gone are gone. A run that was published isn't written again.
    Of several payloads of a slug the least is taken; pages without slug or payload are left out; a name too long for
    the file system fails the run, and nothing is published. ``files`` lists every page with its size."""
    done = store.of_run(run)
    if done is not None:
        return done
    base, folder = store.latest(), f"data/{uuid.uuid4().hex}"
    one = pages.where("slug <> '' AND payload IS NOT NULL").groupBy("slug").agg(F.min("payload").alias("payload"))
    one.mapInArrow(partial(_write_files, f"{store.root}/{folder}/pages"), FILES).write.parquet(f"{store.root}/{folder}/files")
    return store.publish(run, folder, {"pages": f"{folder}/pages", "files": f"{folder}/files"}, base)


READ_BYTES, READ_ROWS = 4 << 20, 1000  # handed on at once


def _read_files(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The file of every listed slug; one that is missing fails the task."""
    store, base = fs.FileSystem.from_uri(folder)
    slugs: list[str] = []
    payloads: list[str] = []
    held = 0

    def handed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"slug": pa.array(slugs, pa.string()), "payload": pa.array(payloads, pa.string())})

    for batch in batches:
        for slug in batch.column("slug").to_pylist():
            with store.open_input_stream(f"{base}/{page_file(slug)}", compression=None) as page:
                body = page.read()
            slugs.append(slug)
            payloads.append(body.decode())
            held += len(body)
            if held >= READ_BYTES or len(slugs) == READ_ROWS:
                yield handed()
                slugs, payloads, held = [], [], 0
    if slugs:
        yield handed()


def read_pages(store: Versions, version: int | None = None) -> DataFrame:
    """(slug, payload) of a version, the latest by default; none before the first.

    Tasks open the pages that ``files`` lists: the driver lists no folder of pages, so what it holds doesn't grow with them."""
    version = store.latest() if version is None else version
    if not version:
        return store.spark.createDataFrame([], PAGE)
    tables = store.manifest(version)["tables"]
    listed = store.read("files", StructType.fromDDL(FILES), version).select("slug")
    tasks = int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(tasks, "slug").mapInArrow(partial(_read_files, f"{store.root}/{tables['pages']}"), PAGE)


def write_pages(df: DataFrame, slug: str, path: str) -> None:
    """One folder a page, JSON payloads: for a few pages. ``publish_pages`` writes many."""
    df.write.mode("overwrite").partitionBy(slug).json(path)
