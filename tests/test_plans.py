"""Snapshot, statistics and pages on a small site."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.enrich import SKILLS
from millrace.functions.text import slugify
from millrace.functions.vocabulary import CLUSTERS
from millrace.plans import pages, snapshot, stats
from millrace.sources.schemas import COMPANIES, JOB_SKILLS, JOBS

NOW = dt.datetime(2025, 6, 10)


def row(schema, **kw):
    return tuple(kw.get(f.name) for f in schema)


@pytest.fixture(scope="module")
def site(spark):
    def job(k, company, title, skills, **kw):
        base = {"id": f"j{k}", "slug": f"{company}-{k}", "company_id": company, "title": title, "normalized_title": title.lower(), "classification": "in", "is_featured": False, "is_direct": False, "is_closed": False, "is_new": True, "ingested_at": NOW - dt.timedelta(days=k)}
        return base | kw, skills

    made = [
        job(1, "a", "LLM Engineer", ["RAG", "Python"], salary_min=100000.0, salary_max=200000.0, country="GB", remote_type="remote", seniority="senior", location_raw="London", posted_at=NOW - dt.timedelta(days=2)),
        job(2, "a", "Agent dev", ["Python"], salary_min=100.0, salary_period="hour", country="US", remote_type="onsite", description_html="<p>hi</p><ul><li>x</li></ul>"),
        job(3, "a", "Prompt engineer", ["Python", "RAG", "GPU"], salary_max=120000.0, salary_currency="GBP", country="US", posted_at=NOW + dt.timedelta(days=1)),
        job(9, "b", "Tools", [], is_featured=True, seniority="intern", salary_min=5e9),
        job(10, "b", "Closed", ["RAG"], is_closed=True),
        job(11, "b", "Out", [], classification="out"),
    ]
    jobs = spark.createDataFrame([row(JOBS, **j) for j, _ in made], JOBS)
    companies = spark.createDataFrame([row(COMPANIES, id=c, name=c.upper(), slug=c, domain=d) for c, d in (("a", "a.com"), ("b", None), ("c", None))], COMPANIES)
    names = spark.createDataFrame([(s, c) for c, _, ss in CLUSTERS for s in ss], "name string, cluster string")
    skills = names.select(F.concat(F.lit("sk_"), slugify(F.col("name"))).alias("id"), "name", "cluster")
    bridge = spark.createDataFrame([(j["id"], "sk_" + s.lower()) for j, ss in made for s in ss], JOB_SKILLS)
    open_ = snapshot.open_jobs(jobs, companies, bridge, skills, F.lit(NOW))
    return open_.cache(), companies


def test_open_jobs(site):
    rows = site[0].orderBy("ord").collect()
    assert [r.id for r in rows] == ["j9", "j1", "j2", "j3"]
    got = {r.id: r for r in rows}
    assert got["j1"].skills == ["RAG", "Python"] and got["j1"].clusters == ["rag", "language"] and got["j9"].skills == []
    assert got["j2"].description_text == "hi\n\n• x" and got["j1"].is_new and not got["j9"].is_new
    assert len(SKILLS) == len(set(SKILLS))


def test_facets_and_document(site, spark, tmp_path):
    facets = {k: [(r.id, r["count"]) for r in v.collect()] for k, v in snapshot.facet_counts(site[0]).items()}
    assert facets["clusters"] == [("language", 3), ("rag", 2), ("inference", 1)] and sorted(facets["seniority"]) == [("intern", 1), ("senior", 1)]
    doc = snapshot.document(site[0], site[1], {"USD": 1.0}, F.lit("now"))
    snapshot.write_document(doc, str(tmp_path / "s"))
    got = json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "s"), wholetext=True).collect()))
    jobs, companies = snapshot.read_document(spark, str(tmp_path / "s"), StructType.fromDDL("id string, skills array<string>"), StructType.fromDDL("id string, domain string"))
    assert [(r.ord, r.id) for r in jobs.orderBy("ord").collect()] == [(0, "j9"), (1, "j1"), (2, "j2"), (3, "j3")] and companies.where("ord = 0").first().domain == "a.com"
    assert [j["id"] for j in got["jobs"]] == ["j9", "j1", "j2", "j3"] and "country" not in got["jobs"][0] and len(got["companies"]) == 3 and got["facets"]["clusters"][0]["label"] == "Languages"


def test_statistics(site):
    got = {k: v.collect() for k, v in stats.stats(site[0], F.lit(NOW), {"GBP": 1.5}).items()}
    (h,) = got["headline"]
    assert (h.roles, h.companies, h.remote, h.hybrid, h.onsite, h.remote_percent, h.posted_this_week) == (4, 2, 1, 0, 1, 25, 2)
    assert h.median_pay == 180000.0  # 150000, 100 * 2080 = 208000, 120000 * 1.5
    (top,) = got["top_paying"]
    assert (top.company_slug, top.value, top.n, top.share, top.company_name) == ("a", 180000.0, 3, 1.0, "A")
    assert [(r.skill, r.n, round(r.share, 2)) for r in sorted(got["top_skills"], key=lambda r: (-r.n, r.skill))] == [("Python", 3, 1.0), ("RAG", 2, 0.67), ("GPU", 1, 0.33)]
    assert got["top_paid_skills"] == [] and [(r.seniority, r.label) for r in got["seniority"]] == [("intern", "Intern"), ("senior", "Senior")]
    assert [(r.country, r.n) for r in sorted(got["countries"], key=lambda r: -r.n)] == [("US", 2), ("GB", 1)]


def test_salary_pages(site, spark):
    got = {r.id: r for r in stats.salary_json(stats.salary_pages(pages.topics(spark), site[0])).collect()}
    assert (got["rag"].n, got["rag"].median) == (1, 150000.0) and got["llm"].n == 0 and got["llm"].json is None
    assert json.loads(got["rag"].json)["name"] == "RAG (AI engineering)"


def test_search_and_home(site):
    jobs = site[0]
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(pages.search(jobs)) == ["j2", "j1", "j3", "j9"]
    assert ids(pages.search(jobs, text=" PYTHON ")) == ["j1", "j2", "j3"] and ids(pages.search(jobs, text="python", country="US", role="AI Engineer")) == ["j2", "j3"] and ids(pages.search(jobs, seniority="x")) == []
    assert {r.id: r.home_rank for r in pages.with_home_rank(jobs).collect()} == {"j2": 0, "j1": 1, "j3": 2, "j9": 3}
    options = pages.filter_options(jobs)
    assert [(r.role, r.n) for r in options["roles"].collect()] == [("AI Engineer", 3), ("Other", 1)]


def test_blocks(spark):
    df = spark.createDataFrame([("1", "intro\n\n• a\n\n- b\n•\n–c\n* d\nend\n• e"), ("2", None), ("3", "-x &amp; y\n‣ z")], "id string, description_text string")
    got = {}
    for r in pages.blocks(df).orderBy("id", "block").collect():
        got.setdefault(r.id, []).append((r.type, r.text, r["items"]))
    assert got == {"1": [("p", "intro", None), ("ul", None, ["a", "b"]), ("p", "–c", None), ("ul", None, ["d"]), ("p", "end", None), ("ul", None, ["e"])], "3": [("p", "-x & y", None), ("ul", None, ["z"])]}


def test_pages(site, spark, tmp_path):
    jobs, companies = site
    got = {r.slug: r for r in pages.company_pages(companies, jobs).withColumn("json", pages.company_json()).collect()}
    assert set(got) == {"a", "b"} and got["a"].stack == ["RAG", "Python", "GPU"] and got["a"].with_pay == 2 and got["b"].stack == []
    assert json.loads(got["a"].json)["url"] == "https://a.com" and "url" not in json.loads(got["b"].json)
    topic = pages.topic_pages(pages.topics(spark), jobs)
    assert sorted((r.id, r.job_id, r.position) for r in topic.where("job_id IS NOT NULL").collect()) == [("inference", "j3", 1), ("rag", "j1", 1), ("rag", "j3", 2)]
    lists = {r.id: json.loads(r.json) for r in pages.topic_json(topic, "https://s/").collect()}
    assert lists["rag"]["numberOfItems"] == 2 and lists["rag"]["itemListElement"][1]["url"] == "https://s/jobs/a-3" and lists["llm"]["itemListElement"] == []
    facts = {r.id: r for r in pages.facts(jobs).collect()}
    assert [(f.label, f.value) for f in facts["j1"].facts] == [("Salary", "$100k–200k/yr"), ("Location", "London"), ("Work type", "Remote"), ("Level", "Senior"), ("Role", "AI Engineer")] and facts["j1"].more_skills == 0
    posting = {r.id: json.loads(r.j) for r in jobs.select("id", pages.job_json(jobs).alias("j")).collect()}
    assert posting["j1"]["baseSalary"]["value"]["unitText"] == "YEAR" and posting["j1"]["jobLocationType"] == "TELECOMMUTE" and "baseSalary" not in posting["j3"]
    lines = [r.value for r in pages.sitemap(pages.sitemap_paths(jobs, pages.topics(spark)), "https://s").collect()]
    assert lines[2] == "  <url><loc>https://s/</loc></url>" and lines[-1] == "</urlset>" and len(lines) == 3 + 1 + 12 + 2 + 4
    pages.write_pages(pages.cards(jobs).select("slug", "search"), "slug", str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 4
