"""Queries over the read path, each with the same query as SQL: seeds, upserts, open jobs with their companies and skills, the document, facts, structured data and boards, built from
orders and customers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .feed_queries import _JOBS, _stats, is_, orders, text
from .functions import enrich
from .operators import relational as rel
from .operators import state
from .operators.tables import Versions, shared_folder
from .plans import ingest, pages, snapshot, stats
from .sources import scorer, seeds
from .sources.schemas import COMPANIES, JOBS, SOURCES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


def shaped(df: DataFrame, schema, **has) -> DataFrame:
    """All columns of a schema, null where nothing is given."""
    return df.select(*(has.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def customers(spark, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").withColumn("c", F.col("c_custkey").cast("string"))


# ---- seeds: a file of one line a customer, some without a provider, some of an unknown one


def _seed_file(spark, sf: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "lever").when(F.col("c_mktsegment") == "AUTOMOBILE", "workday").when(F.col("c_mktsegment") == "MACHINERY", "nowhere").when(F.col("c_mktsegment") == "FURNITURE", "")
    line = F.concat(F.lit(" "), "c_name", F.lit(" ,"), F.coalesce(kind, F.lit("greenhouse")), F.lit(","), F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.concat(F.lit("T:"), "c", F.lit(":S"))).otherwise(F.concat(F.lit("B "), "c")), F.lit(","), F.lit("d.com"), F.lit(","))
    path = f"{shared_folder(spark)}/millrace-seeds-{uuid.uuid4().hex}"
    customers(spark, sf).select(F.explode(F.array(line, F.lit("# a comment"), F.lit("  "))).alias("value")).write.text(path)
    return seeds.read_seeds(spark, path)


_SEEDS = """
s AS (SELECT *, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'T:' || c_custkey || ':S' ELSE 'B ' || c_custkey END AS token, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 't-' || c_custkey || '-s' ELSE 'b-' || c_custkey END AS slug,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'lever' WHEN 'AUTOMOBILE' THEN 'workday' ELSE 'greenhouse' END AS provider FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'FURNITURE'))
"""


@query(f"WITH {_SEEDS} SELECT 'c_' || slug AS id, c_name AS name, slug, 'd.com' AS domain, provider AS ats_provider, token AS ats_token, CAST(NULL AS VARCHAR) AS stage FROM s")
def seed_companies(spark, sf):
    return seeds.seeded(_seed_file(spark, sf))[0]


@query(f"""
WITH {_SEEDS} SELECT 'c_' || slug || '_' || provider AS id, 'c_' || slug AS company_id, provider AS ats_provider, 'active' AS status,
  CASE provider WHEN 'lever' THEN 'https://api.lever.co/v0/postings/' || token || '?mode=json' WHEN 'workday' THEN 'https://T.' || c_custkey || '.myworkdayjobs.com/wday/cxs/T/S/jobs' ELSE 'https://boards-api.greenhouse.io/v1/boards/' || token || '/jobs?content=true' END AS endpoint_url FROM s
""")
def seed_sources(spark, sf):
    return seeds.seeded(_seed_file(spark, sf))[1]


# ---- upserts of companies and sources


@query("""
WITH o AS (SELECT c_custkey, c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AS old, c_mktsegment <> 'BUILDING' AS new, c_name FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN new THEN c_name || ' II' ELSE c_name END AS name, CASE WHEN old THEN 'old' ELSE 'new' END AS slug, CASE WHEN old THEN 'kept' END AS size, CASE WHEN new THEN 'late' ELSE 'early' END AS stage FROM o
""")
def companies_upserted(spark, sf):
    c, seg = customers(spark, sf), F.col("c_mktsegment")
    old = shaped(c.where(seg.isin("BUILDING", "AUTOMOBILE")), COMPANIES, id=F.col("c"), name=F.col("c_name"), slug=F.lit("old"), size=F.lit("kept"), stage=F.lit("early"))
    new = shaped(c.where(seg != "BUILDING"), COMPANIES, id=F.col("c"), name=F.concat("c_name", F.lit(" II")), slug=F.lit("new"), size=F.lit(None), stage=F.lit("late"))
    return state.upsert_companies(old, new.drop("size")).select("id", "name", "slug", "size", "stage")


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'old' ELSE 'new' END AS endpoint_url, CASE WHEN c_mktsegment = 'BUILDING' THEN 'paused' ELSE 'active' END AS status,
  c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AS polled FROM customer
""")
def sources_upserted(spark, sf):
    c, seg = customers(spark, sf), F.col("c_mktsegment")
    old = shaped(c.where(seg.isin("BUILDING", "AUTOMOBILE")), SOURCES, id=F.col("c"), endpoint_url=F.lit("old"), status=F.lit("paused"), last_polled_at=F.to_timestamp(F.lit("2025-01-01")))
    new = shaped(c.where(seg != "BUILDING"), SOURCES, id=F.col("c"), endpoint_url=F.lit("new"), status=F.lit("active"))
    return state.upsert_sources(old, new).select("id", "endpoint_url", "status", F.col("last_polled_at").isNotNull().alias("polled"))


# ---- open jobs: an order is a job of its customer; some are closed, some out of scope, some without skills


def _tables(spark, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    o = orders(spark, sf)
    kind = F.col("o_orderpriority")
    jobs = shaped(
        o, JOBS, id=F.col("k"), company_id=text("=c", "c"), slug=text("=j", "k"), title=text("=AI Engineer ", "o_orderpriority"), normalized_title=F.lower(text("=ai engineer ", "o_orderpriority")), classification=F.when(is_("P"), "out").otherwise("in"), is_closed=kind == "5-LOW",
        is_featured=kind == "1-URGENT", description_html=F.when(is_("F"), "<p>a &amp; b</p>"), description_text=F.lit("as it came"), location_raw=F.when(is_("F"), F.col("o_orderpriority")), city=F.lit("Town"), country=F.lit("DE"),
        remote_type=F.when(is_("F"), "remote").when(is_("O"), "onsite"), seniority=F.when(kind == "2-HIGH", "senior"), salary_min=F.when(kind < "3", F.col("o_totalprice")), ingested_at=F.col("o_orderdate"), posted_at=F.col("o_orderdate"), company_name=F.lit(None),
    )
    companies = customers(spark, sf).select(text("=c", "c").alias("id"), F.col("c_name").alias("name"), text("=s", "c").alias("slug"), F.when(F.col("c_mktsegment") == "BUILDING", "b.com").alias("domain"))
    names = F.when(is_("F"), F.array(F.lit("Rust"), F.lit("RAG"), F.lit("Python"))).otherwise(F.when(kind < "4", F.array(F.lit("Docker"))))
    bridge = o.select(F.col("k").alias("job_id"), F.explode(names).alias("s")).select("job_id", ingest.skill_id(F.col("s")).alias("skill_id"))
    return jobs, companies, bridge, ingest.skills(spark)


def _open(spark, sf: str) -> DataFrame:
    return snapshot.open_jobs(*_tables(spark, sf), F.to_timestamp(F.lit("1998-01-01 00:00:00")))


_IS_OPEN = "o AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW')"


@query(f"""
WITH {_IS_OPEN} SELECT CAST(o_orderkey AS VARCHAR) AS id, c_name AS company_name, 's' || o_custkey AS company_slug, CASE WHEN o_orderstatus = 'F' THEN 'RAG,Python,Rust' WHEN o_orderpriority < '4' THEN 'Docker' ELSE '' END AS skills,
  CASE WHEN o_orderstatus = 'F' THEN 'rag,language' WHEN o_orderpriority < '4' THEN 'mlops' ELSE '' END AS clusters, CASE o_orderstatus WHEN 'F' THEN 'a & b' ELSE 'as it came' END AS description_text,
  o_orderdate > TIMESTAMP '1998-01-01' - INTERVAL 7 DAY AS is_new FROM o
""")
def snapshot_jobs(spark, sf):
    return _open(spark, sf).select("id", "company_name", "company_slug", F.array_join("skills", ",").alias("skills"), F.array_join("clusters", ",").alias("clusters"), "description_text", "is_new")


@query(f"WITH {_IS_OPEN} SELECT CAST(o_orderkey AS VARCHAR) AS id, row_number() OVER (ORDER BY o_orderpriority <> '1-URGENT', o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS place FROM o ORDER BY o_orderpriority <> '1-URGENT', o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 100")
def snapshot_order(spark, sf):
    """The first hundred of the snapshot's order: featured first, then the latest, then by id."""
    return rel.ranked(_open(spark, sf).select("id", "ord"), 100, F.asc("ord"), name="place", start=1).select("id", "place")


@query(f"""
WITH {_IS_OPEN}, c AS (SELECT unnest(CASE WHEN o_orderstatus = 'F' THEN ['rag', 'language'] WHEN o_orderpriority < '4' THEN ['mlops'] ELSE [] END) AS id FROM o)
SELECT 'clusters' AS facet, id, CASE id WHEN 'rag' THEN 'Retrieval / RAG' WHEN 'language' THEN 'Languages' ELSE 'MLOps / infra' END AS label, count(*) AS n FROM c GROUP BY id
UNION ALL SELECT 'seniority', 'senior', NULL, count(*) FROM o WHERE o_orderpriority = '2-HIGH' HAVING count(*) > 0 UNION ALL SELECT 'remote_type', CASE o_orderstatus WHEN 'F' THEN 'remote' ELSE 'onsite' END, NULL, count(*) FROM o GROUP BY 2
""")
def snapshot_facets(spark, sf):
    found = snapshot.facet_counts(_open(spark, sf))
    out = None
    for name, df in found.items():
        own = df.select(F.lit(name).alias("facet"), "id", (F.col("label") if "label" in df.columns else F.lit(None).cast("string")).alias("label"), F.col("count").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""
WITH {_IS_OPEN} SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Location=' || CASE o_orderstatus WHEN 'F' THEN o_orderpriority ELSE 'Town, Germany' END || ';Work type=' || CASE o_orderstatus WHEN 'F' THEN 'Remote' ELSE 'On-site' END
  || CASE o_orderpriority WHEN '2-HIGH' THEN ';Level=Senior' ELSE '' END AS facts FROM o
""")
def job_facts(spark, sf):
    """Facts but the pay, whose label has a query of its own (format_pay); roles aren't told where they are Other."""
    jobs = _open(spark, sf).withColumns({"title": F.lit("x"), "normalized_title": F.lit("x"), "salary_min": F.lit(None).cast("double")})
    got = pages.facts(jobs, F.when(F.col("country") == "DE", "Germany").otherwise(F.col("country")))
    return got.select("id", F.array_join(F.transform("facts", lambda x: F.concat(x["label"], F.lit("="), x["value"])), ";").alias("facts"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, least(10 + day(o_orderdate), 16) AS shown, greatest(day(o_orderdate) - 6, 0) AS more_skills, 's16' AS last FROM orders WHERE day(o_orderdate) >= 6 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 10 + day(o_orderdate), 0, 's' || (10 + day(o_orderdate)) FROM orders WHERE day(o_orderdate) < 6")
def skill_walls(spark, sf):
    n = 10 + F.dayofmonth("o_orderdate")
    o = orders(spark, sf).select(F.col("k").alias("id"), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("s"), i.cast("string"))).alias("skills"), *(F.lit(None).cast("string").alias(c) for c in ("title", "normalized_title", "location_raw", "city", "country", "remote_type", "seniority", "salary_currency", "salary_period")), *(F.lit(None).cast("double").alias(c) for c in ("salary_min", "salary_max")))
    return pages.facts(o).select("id", F.size("skill_wall").cast("long").alias("shown"), F.col("more_skills").cast("long").alias("more_skills"), F.element_at("skill_wall", -1).alias("last"))


# ---- structured data


@query("""SELECT 'c' || c_custkey AS id, '{"@context":"https://schema.org","@type":"Organization","name":"' || c_name || '"' || CASE c_mktsegment WHEN 'BUILDING' THEN ',"url":"https://b.com"' ELSE '' END || '}' AS json FROM customer""")
def company_objects(spark, sf):
    return _tables(spark, sf)[1].select("id", pages.company_json().alias("json"))


@query(f"""
WITH {_IS_OPEN} SELECT CAST(o_orderkey AS VARCHAR) AS id, '{{"@context":"https://schema.org/","@type":"JobPosting","title":"AI Engineer ' || o_orderpriority || '","hiringOrganization":{{"@type":"Organization","name":"' || c_name || '"}},"employmentType":"FULL_TIME","datePosted":"'
  || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') || '","directApply":false' || CASE o_orderstatus WHEN 'F' THEN ',"jobLocationType":"TELECOMMUTE"' ELSE '' END || ',"applicantLocationRequirements":{{"@type":"Country","name":"DE"}}'
  || CASE WHEN o_orderpriority < '3' THEN ',"baseSalary":{{"@type":"MonetaryAmount","currency":"USD","value":{{"@type":"QuantitativeValue","minValue":' || o_totalprice || ',"maxValue":' || o_totalprice || ',"unitText":"YEAR"}}}}' ELSE '' END || '}}' AS json FROM o
""")
def job_objects(spark, sf):
    jobs = _open(spark, sf)
    return jobs.select("id", pages.job_json(jobs).alias("json"))


# ---- leaderboards with ranks; unions of heuristic and scored skills


@query(f"""
WITH {_JOBS}, g AS (SELECT company, median(pay) AS value, count(pay) AS n FROM w WHERE pay IS NOT NULL GROUP BY 1 HAVING count(pay) >= 3 ORDER BY 2 DESC, 1 LIMIT 5)
SELECT company AS company_slug, value, row_number() OVER (ORDER BY value DESC, company) AS rank FROM g
""")
def stats_ranks(spark, sf):
    return stats.leaders(_stats(spark, sf)["top_paying"], F.desc("value"), F.asc("company_slug")).select("company_slug", "value", "rank")


# ---- the document, written in slices and read back


@query(f"WITH {_IS_OPEN} SELECT CAST(o_orderkey AS VARCHAR) AS id, 'AI Engineer ' || o_orderpriority AS title, CASE WHEN o_orderstatus = 'F' THEN 'RAG,Python,Rust' WHEN o_orderpriority < '4' THEN 'Docker' ELSE '' END AS skills, o_orderdate AS posted_at, CASE WHEN o_orderpriority < '3' THEN o_totalprice END AS salary_min FROM o")
def document_jobs(spark, sf):
    jobs, companies, bridge, skills = _tables(spark, sf)
    open_ = snapshot.open_jobs(jobs, companies, bridge, skills, F.to_timestamp(F.lit("1998-01-01 00:00:00"))).select("id", "title", "skills", "clusters", "seniority", "remote_type", "posted_at", "salary_min", "ord")
    path = f"{shared_folder(spark)}/millrace-document-{uuid.uuid4().hex}.json"
    snapshot.write_slices(open_, companies, {"GBP": 1.25}, F.to_timestamp(F.lit("1998-01-01 00:00:00")), path)
    got = snapshot.read_slices(spark, path, "jobs", open_.drop("ord").schema)
    return got.select("id", "title", F.array_join("skills", ",").alias("skills"), F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "salary_min")


# ---- pages as files, published twice; topics with their first jobs; a second scorer that fails at times


@query("SELECT 'a page/' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '+é' ELSE '' END AS slug, '{\"name\":\"' || c_name || '\"}' AS payload FROM customer WHERE c_custkey % 3 <> 0")
def published_pages(spark, sf):
    """The second run has no pages of every third customer, and other payloads."""
    store = Versions(spark, f"{shared_folder(spark)}/millrace-pages-{uuid.uuid4().hex}")
    c, k = customers(spark, sf), F.col("c_custkey")
    slug = F.concat(F.lit("a page/"), "c", F.when(k % 2 == 0, "+é").otherwise(""))
    pages.publish_pages(store, "first", c.select(slug.alias("slug"), F.lit("{}").alias("payload")))
    pages.publish_pages(store, "second", c.where(k % 3 != 0).select(slug.alias("slug"), F.to_json(F.struct(F.col("c_name").alias("name"))).alias("payload")))
    return pages.read_pages(store)


@query("""
WITH j AS (SELECT o_orderkey, unnest(list_distinct(string_split(o_orderpriority, '-'))) AS id FROM orders), p AS (SELECT id, o_orderkey, row_number() OVER (PARTITION BY id ORDER BY o_orderkey) AS position, count(*) OVER (PARTITION BY id) AS n FROM j)
SELECT t.id, coalesce(n, 0) AS n, o_orderkey AS job_id, position FROM (VALUES ('URGENT'), ('LOW'), ('NEVER')) t(id) LEFT JOIN p ON p.id = t.id AND position <= 50
""")
def topic_heads(spark, sf):
    jobs = orders(spark, sf).select(F.col("o_orderkey").alias("job_id"), F.col("o_orderkey").alias("ord"), F.split("o_orderpriority", "-").alias("clusters"))
    return pages.topic_heads(spark.createDataFrame([("URGENT",), ("LOW",), ("NEVER",)], "id string"), jobs).select("id", "n", "job_id", "position")


def _model(rows: list[dict]) -> list[str]:
    """A stand-in for a model: says yes to sizes that divide by 3; where 1 remains its confidence can't be, where 2 does it says something else; a batch with a size of 50 fails."""
    if any(r["text"] == "50" for r in rows):
        raise TimeoutError
    said = ('{"inScope": true, "confidence": 0.75, "country": "de"}', '{"inScope": true, "confidence": 7}', "sorry")
    return [said[int(r["text"]) % 3] for r in rows]


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN true END AS in_scope, CASE WHEN p_size % 3 = 0 THEN 0.75 END AS confidence, CASE WHEN p_size % 3 = 0 THEN 'DE' END AS country FROM part")
def scorer_answers(spark, sf):
    """Two runs: the second asks what the first had no answer to."""
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("title"), F.col("p_size").cast("string").alias("text"), F.lit("x").alias("location_raw"))
    first = scorer.Remembered(scorer.client(_model, 1), spark.createDataFrame([], scorer.MEMO))
    first(rows.where("p_partkey % 2 = 0"))
    second = scorer.Remembered(scorer.client(_model, 1), first.after)
    got = second(rows).select("id", enrich.scorer_record(F.col("record")).alias("x"))
    return got.select(F.col("id").cast(rows.schema["p_partkey"].dataType).alias("id"), "x.in_scope", "x.confidence", "x.country")
