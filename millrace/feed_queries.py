"""Queries over feeds and open jobs, each with the same query as SQL: payloads of every provider and job rows are built from the orders.

Every order is one entry of a board; a customer is a board where a feed caps or dedupes by board. Pages are numbered by the order's key, so that ties can't arise.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import content_hash, job_id
from .operators.tables import Versions, settled, shared_folder
from .plans import ingest, pages, stats
from .sources import feeds
from .sources.schemas import JOB_SKILLS, JOBS, RAW_POSTING

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put



def orders(spark, sf: str) -> DataFrame:
    """Orders with their key and customer as text (k, c) and their date in two spellings."""
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return spark.read.parquet(f"{sf}/orders.parquet").withColumns({"k": F.col("o_orderkey").cast("string"), "c": F.col("o_custkey").cast("string"), "iso": F.concat(F.replace(day, F.lit(" "), F.lit("T")), F.lit("Z")), "utc": F.concat(day, F.lit(" UTC"))})


def text(*parts) -> Column:
    """Columns (by name) and literals (after ``=``) joined."""
    return F.concat(*(F.lit(p[1:]) if isinstance(p, str) and p.startswith("=") else p if isinstance(p, Column) else F.col(p) for p in parts))


def page(df: DataFrame, body: Column, slug: Column | None = None) -> DataFrame:
    return df.select((F.lit("board") if slug is None else slug).alias("slug"), F.lit(0).alias("query"), F.col("o_orderkey").cast("int").alias("page"), text("=u", "k").alias("url"), body.alias("body"))


def detail(df: DataFrame, key: Column, body: Column, slug: Column | None = None) -> DataFrame:
    return df.select((F.lit("board") if slug is None else slug).alias("slug"), key.alias("key"), F.lit("").alias("url"), body.alias("body"))


def shown(df: DataFrame, *cols: str) -> DataFrame:
    """The columns, dates without a zone as the tables have them."""
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if c.endswith("_at") else c for c in cols))


def struct(**cols: Column) -> Column:
    return F.struct(*(c.alias(k) for k, c in cols.items()))


def is_(status: str) -> Column:
    return F.col("o_orderstatus") == status


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS title, 'u' || o_orderkey AS apply_url, o_orderstatus AS location_raw, CASE o_orderstatus WHEN 'P' THEN 'hybrid' WHEN 'F' THEN 'remote' END AS remote_type, o_orderstatus = 'F' AS remote_hint,
  floor(o_totalprice / 1000) * 1000 AS salary_min, CASE WHEN o_totalprice >= 1000 THEN floor(o_totalprice / 500) * 1000 END AS salary_max, 'GBP' AS salary_currency, 'year' AS salary_period, CAST(o_orderdate AS TIMESTAMP) AS posted_at FROM orders WHERE o_totalprice > 50000
""")
def feed_ashby(spark, sf):
    n = lambda d: F.floor(F.col("o_totalprice") / d).cast("string")
    job = struct(
        id=F.col("k"), title=text("= ", "o_orderpriority"), location=F.col("o_orderstatus"), isRemote=is_("F"), workplaceType=F.when(is_("P"), "Hybrid"), jobUrl=text("=u", "k"), publishedAt=F.col("iso"), isListed=F.col("o_totalprice") > 50000,
        compensation=struct(compensationTierSummary=text("=£", n(1000), "=K – £", n(500), "=K")),
    )
    o = orders(spark, sf)
    return shown(feeds.ashby(page(o, F.to_json(struct(jobs=F.array(job))))), "external_id", "title", "apply_url", "location_raw", "remote_type", "remote_hint", "salary_min", "salary_max", "salary_currency", "salary_period", "posted_at")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS title, 's' || o_orderkey AS apply_url, CASE WHEN o_totalprice > 100000 THEN 'F, X' ELSE o_orderpriority || ', ' || o_orderstatus END AS location_raw,
  CASE WHEN o_totalprice > 100000 THEN 'onsite' WHEN o_orderstatus = 'F' THEN 'remote' END AS remote_type, CASE WHEN o_totalprice > 100000 THEN 'd' || chr(10) || chr(10) || 'r' END AS description_text FROM orders WHERE o_orderstatus <> 'P'
""")
def feed_workable(spark, sf):
    job = struct(shortcode=F.col("k"), title=F.col("o_orderpriority"), shortlink=F.when(~is_("P"), text("=s", "k")), telecommuting=is_("F"), country=F.col("o_orderstatus"), city=F.col("o_orderpriority"), state=F.lit(""))
    own = struct(description=F.lit("<p>d</p>"), requirements=F.lit("r"), benefits=F.lit(""), workplace=F.lit("on_site"), location=struct(city=F.lit("F"), country=F.lit("X")))
    o = orders(spark, sf)
    got = feeds.workable(page(o, F.to_json(struct(jobs=F.array(job)))), detail(o.where("o_totalprice > 100000"), F.col("k"), F.to_json(own)))
    return shown(got, "external_id", "title", "apply_url", "location_raw", "remote_type", "description_text")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS title, 'c' || o_orderkey AS apply_url, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || ', F' ELSE 'place' END AS location_raw, CASE o_orderstatus WHEN 'F' THEN 'remote' ELSE 'hybrid' END AS remote_type,
  'a & b' AS description_text, CAST(o_orderdate AS TIMESTAMP) AS posted_at FROM orders WHERE o_orderstatus <> 'P'
""")
def feed_recruitee(spark, sf):
    job = struct(
        id=F.col("o_orderkey"), title=text("o_orderpriority", "= "), status=F.when(is_("P"), "draft").when(is_("F"), "published"), description=F.lit("<p>a &amp; b</p>"), careers_url=text("=c", "k"), location=F.when(~is_("F"), "place"),
        city=F.col("o_orderpriority"), country=F.col("o_orderstatus"), remote=is_("F"), hybrid=is_("O"), created_at=F.col("utc"),
    )
    return shown(feeds.recruitee(page(orders(spark, sf), F.to_json(struct(offers=F.array(job))))), "external_id", "title", "apply_url", "location_raw", "remote_type", "description_text", "posted_at")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS title, 'u' || o_orderkey AS apply_url, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority || ', P' ELSE o_orderpriority || ', R, ' || o_orderstatus END AS location_raw,
  '• ' || o_orderstatus AS description_text, CAST(o_orderdate AS TIMESTAMP) AS posted_at FROM orders
""")
def feed_teamtailor(spark, sf):
    place = struct(address=struct(addressLocality=F.col("o_orderpriority"), addressRegion=F.when(~is_("P"), "R"), addressCountry=F.col("o_orderstatus")))
    job = struct(id=F.col("k"), title=F.col("o_orderpriority"), url=text("=u", "k"), date_published=F.col("iso"), content_html=text("=<ul><li>", "o_orderstatus", "=</ul>"), _jobposting=struct(jobLocation=F.array(place)))
    return shown(feeds.teamtailor(page(orders(spark, sf), F.to_json(struct(items=F.array(job))))), "external_id", "title", "apply_url", "location_raw", "description_text", "posted_at")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS title, CASE WHEN o_totalprice > 100000 THEN 'p' || o_orderkey ELSE 'https://jobs.smartrecruiters.com/board/' || o_orderkey END AS apply_url,
  CASE WHEN o_totalprice > 100000 THEN 'A, B' ELSE o_orderpriority || ', ' || o_orderstatus END AS location_raw, CASE WHEN o_totalprice > 100000 THEN NULL WHEN o_orderstatus = 'F' THEN 'remote' WHEN o_orderstatus = 'O' THEN 'hybrid' ELSE 'onsite' END AS remote_type,
  CASE WHEN o_totalprice > 100000 THEN 'x' || chr(10) || 'y' END AS description_text, CAST(o_orderdate AS TIMESTAMP) AS posted_at FROM orders
""")
def feed_smartrecruiters(spark, sf):
    job = struct(id=F.col("k"), name=F.col("o_orderpriority"), releasedDate=F.col("iso"), location=struct(city=F.col("o_orderpriority"), country=F.lower("o_orderstatus"), remote=is_("F"), hybrid=is_("O")))
    section = lambda t: struct(title=F.lit("t"), text=F.lit(t))
    own = struct(postingUrl=text("=p", "k"), location=struct(fullLocation=F.lit("A, , B")), jobAd=struct(sections=struct(qualifications=section("y"), jobDescription=section("<b>x</b>"))))
    o = orders(spark, sf)
    got = feeds.smartrecruiters(page(o, F.to_json(struct(content=F.array(job)))), detail(o.where("o_totalprice > 100000"), F.col("k"), F.to_json(own)))
    return shown(got, "external_id", "title", "apply_url", "location_raw", "remote_type", "description_text", "posted_at")


@query("""
WITH l AS (SELECT o_custkey, o_orderpriority AS p, arg_max(o_orderkey, o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS s, bool_or(o_orderstatus = 'F') AS d FROM orders GROUP BY 1, 2)
SELECT 't:dc:' || o_custkey AS slug, CAST(k AS VARCHAR) AS external_id, 'Data Engineer ' || s AS title, 'https://t.dc.myworkdayjobs.com/' || o_custkey || '/job/' || p AS apply_url, CASE WHEN d THEN 'D' ELSE s END AS location_raw, CASE WHEN d THEN 'full' END AS employment_type FROM l WHERE s <> 'P'
""")
def feed_workday(spark, sf):
    """Boards are customers; entries of one path are one, the last in the place of the first."""
    o, slug, path = orders(spark, sf), text("=t:dc:", "c"), text("=/job/", "o_orderpriority")
    job = struct(title=F.when(is_("P"), "Cook").otherwise(text("=Data Engineer ", "o_orderstatus")), externalPath=path, locationsText=F.col("o_orderstatus"), bulletFields=F.array("k"))
    own = struct(jobPostingInfo=struct(location=F.lit("D"), timeType=F.lit("full")))
    got = feeds.workday(page(o, F.to_json(struct(jobPostings=F.array(job))), slug), detail(o.where(is_("F")), path, F.to_json(own), slug))
    return shown(got, "slug", "external_id", "title", "apply_url", "location_raw", "employment_type")


@query("""
SELECT 'host:' || o_custkey AS slug, CAST(o_orderkey AS VARCHAR) AS external_id, 'ML ' || o_orderpriority AS title, 'https://host/hcmUI/CandidateExperience/en/sites/' || o_custkey || '/job/' || o_orderkey AS apply_url,
  CASE WHEN o_orderstatus = 'F' THEN 'F' WHEN o_totalprice > 100000 THEN 'D' ELSE 'a; b' END AS location_raw, CASE WHEN o_totalprice > 100000 THEN 'x' || chr(10) || 'q' END AS description_text FROM orders WHERE o_orderpriority < '4'
""")
def feed_oracle(spark, sf):
    o, slug = orders(spark, sf), text("=host:", "c")
    more = F.array(struct(Name=F.lit("a")), struct(Name=F.lit("")), struct(Name=F.lit("b")))
    job = struct(Id=F.col("k"), Title=F.when(F.col("o_orderpriority") < "4", text("=ML ", "o_orderpriority")).otherwise("Cook"), PrimaryLocation=F.when(is_("F"), "F"), secondaryLocations=more)
    own = struct(items=F.array(struct(ExternalDescriptionStr=F.lit("<i>x</i>"), ExternalQualificationsStr=F.lit("q"), PrimaryLocation=F.lit("D"))))
    got = feeds.oracle(page(o, F.to_json(struct(items=F.array(struct(requisitionList=F.array(job))))), slug), detail(o.where("o_totalprice > 100000"), F.col("k"), F.to_json(own), slug))
    return shown(got, "slug", "external_id", "title", "apply_url", "location_raw", "description_text")


@query("""
WITH l AS (SELECT o_custkey, o_orderpriority AS p, arg_max(o_orderstatus, o_orderkey) AS s, arg_max(o_orderdate, o_orderkey) AS d FROM orders GROUP BY 1, 2)
SELECT 'h:' || o_custkey AS slug, p AS external_id, 'AI Scientist ' || s AS title, 'https://h/careers/job/' || p AS apply_url, s || '; X' AS location_raw, CASE s WHEN 'F' THEN 'onsite' WHEN 'O' THEN 'remote' END AS remote_type, CAST(d AS TIMESTAMP) AS posted_at FROM l
""")
def feed_eightfold(spark, sf):
    o = orders(spark, sf)
    job = struct(
        id=F.col("o_orderpriority"), name=text("=AI Scientist ", "o_orderstatus"), locations=F.array(F.col("o_orderstatus"), F.lit("X")), t_create=F.unix_timestamp(F.col("o_orderdate").cast("timestamp")),
        work_location_option=F.when(is_("F"), "On-Site").when(is_("O"), "REMOTE").otherwise("elsewhere"),
    )
    return shown(feeds.eightfold(page(o, F.to_json(struct(positions=F.array(job))), text("=h:", "c"))), "slug", "external_id", "title", "apply_url", "location_raw", "remote_type", "posted_at")


def _ld(node: Column) -> Column:
    return text('=<html><script type="application/ld+json">', F.to_json(node), "=</script></html>")


def _posting(title: Column, **cols: Column) -> Column:
    return F.struct(F.lit("JobPosting").alias("@type"), title.alias("title"), *(c.alias(k) for k, c in cols.items()))


@query("""
SELECT 'b' || o_custkey AS slug, CAST(o_orderkey AS VARCHAR) AS external_id, 'Data ' || o_orderpriority AS title, 'https://b' || o_custkey || '.icims.com/jobs/' || o_orderkey || '/x-y/job' AS apply_url FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000
""")
def feed_icims(spark, sf):
    """A search page names its path twice; details exist above a price, and only some are technical."""
    o, slug, path = orders(spark, sf), text("=b", "c"), text("=/jobs/", "k", "=/x-y/job")
    title = F.when(is_("F"), text("=Data ", "o_orderpriority")).otherwise("Cook")
    got = feeds.icims(page(o, text("=<a href='", path, "='></a><a href='https://h", path, "=?a=b'>"), slug), detail(o.where("o_totalprice > 50000"), path, _ld(_posting(title)), slug))
    return shown(got, "slug", "external_id", "title", "apply_url")


@query("""
WITH f AS (SELECT o_custkey, o_orderpriority AS p, arg_min(o_orderkey, o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2)
SELECT 'b' || o_custkey AS slug, p AS external_id, 'Software ' || k AS title, 'u' || k AS apply_url FROM f
""")
def feed_successfactors(spark, sf):
    """Postings of one identifier on a board: the first stays."""
    node = _posting(F.when(is_("P"), "Cook").otherwise(text("=Software ", "k")), identifier=F.col("o_orderpriority"))
    return shown(feeds.successfactors(page(orders(spark, sf), _ld(node), text("=b", "c"))), "slug", "external_id", "title", "apply_url")


# ---- open jobs: an order is a job of its customer, its price the pay

_JOBS = """
j AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS company, o_orderkey AS ord, o_totalprice AS lo, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 1.5 END AS hi, CASE o_orderstatus WHEN 'F' THEN 'GBP' WHEN 'O' THEN 'usd' END AS cur,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'month' WHEN '2-HIGH' THEN 'year' END AS per, CASE o_orderstatus WHEN 'F' THEN 'remote' WHEN 'O' THEN 'hybrid' ELSE 'onsite' END AS remote, substr(o_orderpriority, 3) AS country,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'senior' WHEN '2-HIGH' THEN 'junior' WHEN '3-MEDIUM' THEN 'mid' END AS seniority, CAST(o_orderdate AS TIMESTAMP) AS posted FROM orders),
p AS (SELECT *, (lo + coalesce(hi, lo)) / 2 * CASE per WHEN 'month' THEN 12.0 ELSE 1.0 END * CASE cur WHEN 'GBP' THEN 1.5 ELSE 1.0 END AS raw FROM j),
w AS (SELECT *, CASE WHEN raw BETWEEN 10000 AND 2000000 THEN raw END AS pay FROM p)
"""
RATES = {"GBP": 1.5}


def jobs(spark, sf: str, of: DataFrame | None = None) -> DataFrame:
    price, status, kind = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority")
    return (orders(spark, sf) if of is None else of).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), F.col("c").alias("company_slug"), text("=Customer ", "c").alias("company_name"), price.alias("salary_min"), F.when(~is_("P"), price * 1.5).alias("salary_max"),
        F.when(is_("F"), "GBP").when(is_("O"), "usd").alias("salary_currency"), F.when(kind == "1-URGENT", "month").when(kind == "2-HIGH", "year").alias("salary_period"),
        F.when(is_("F"), "remote").when(is_("O"), "hybrid").otherwise("onsite").alias("remote_type"), F.substring(kind, 3, 100).alias("country"),
        F.when(kind == "1-URGENT", "senior").when(kind == "2-HIGH", "junior").when(kind == "3-MEDIUM", "mid").alias("seniority"), F.col("o_orderdate").cast("timestamp").alias("posted_at"),
        F.split(kind, "[- ]").alias("skills"), text("o_orderstatus", "= engineer").alias("title"), F.lower(kind).alias("normalized_title"),
    )


def _stats(spark, sf: str) -> dict[str, DataFrame]:
    return stats.stats(jobs(spark, sf), F.to_timestamp(F.lit("1998-01-01 00:00:00")), RATES)


@query(f"""
WITH {_JOBS} SELECT count(*) AS roles, count(DISTINCT company) AS companies, count(*) FILTER (remote = 'remote') AS remote, count(*) FILTER (remote = 'hybrid') AS hybrid, count(*) FILTER (remote = 'onsite') AS onsite,
  CAST(floor(count(*) FILTER (remote = 'remote') * 100.0 / count(*) + 0.5) AS BIGINT) AS remote_percent, median(pay) AS median_pay, count(*) FILTER (TIMESTAMP '1998-01-01' - posted <= INTERVAL 7 DAY) AS posted_this_week FROM w
""")
def stats_headline(spark, sf):
    return _stats(spark, sf)["headline"].withColumn("remote_percent", F.col("remote_percent").cast("long"))


@query(f"""
WITH {_JOBS}, g AS (SELECT company, median(pay) AS value, count(pay) AS n FROM w WHERE pay IS NOT NULL GROUP BY 1 HAVING count(pay) >= 3 ORDER BY 2 DESC, 1 LIMIT 5)
SELECT company AS company_slug, 'Customer ' || company AS company_name, value, n, value / greatest(1, max(value) OVER ()) AS share FROM g
""")
def stats_top_paying(spark, sf):
    return _stats(spark, sf)["top_paying"]


@query("WITH g AS (SELECT CAST(o_custkey AS VARCHAR) AS company_slug, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) SELECT company_slug, 'Customer ' || company_slug AS company_name, n, n / greatest(1, max(n) OVER ()) AS share FROM g")
def stats_top_hiring(spark, sf):
    return _stats(spark, sf)["top_hiring"]


_SKILLS = "SELECT pay, unnest(regexp_split_to_array(o_orderpriority, '[- ]')) AS skill FROM w JOIN orders ON o_orderkey = id"


@query(f"WITH {_JOBS}, s AS ({_SKILLS}), g AS (SELECT skill, count(*) AS n FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12) SELECT skill, n, n / greatest(1, max(n) OVER ()) AS share FROM g")
def stats_top_skills(spark, sf):
    return _stats(spark, sf)["top_skills"]


@query(f"WITH {_JOBS}, s AS ({_SKILLS}), g AS (SELECT skill, median(pay) AS value, count(pay) AS n FROM s GROUP BY 1 HAVING count(pay) >= 5 ORDER BY 2 DESC, 1 LIMIT 6) SELECT skill, value, n, value / greatest(1, max(value) OVER ()) AS share FROM g")
def stats_top_paid_skills(spark, sf):
    return _stats(spark, sf)["top_paid_skills"]


@query(f"WITH {_JOBS}, g AS (SELECT seniority, count(*) AS n FROM j WHERE seniority IS NOT NULL GROUP BY 1) SELECT seniority, upper(substr(seniority, 1, 1)) || substr(seniority, 2) AS label, n, n / greatest(1, max(n) OVER ()) AS share FROM g")
def stats_seniority(spark, sf):
    return _stats(spark, sf)["seniority"].drop("place")


@query(f"WITH {_JOBS}, g AS (SELECT country, count(*) AS n FROM j GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6) SELECT country, n, n / greatest(1, max(n) OVER ()) AS share FROM g")
def stats_countries(spark, sf):
    return _stats(spark, sf)["countries"]


# ---- statistics moved by a run: some orders come with it, some close, some change their price; the SQL counts all of what is open after it

_AFTER = "open AS (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey % 7 <> 0), " + _JOBS.replace("FROM orders", "FROM open")


def _moved(spark, sf: str) -> DataFrame:
    old = orders(spark, sf)
    new = old.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))
    state = lambda o, closed: o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("string").alias("content_hash"), closed.alias("is_closed"), F.lit("in").alias("classification"))
    first, gone = old.where("o_orderkey % 5 <> 0"), F.col("o_orderkey") % 7 == 0
    ids = stats.touched(state(first, F.lit(False)), state(new, gone))
    return stats.moved(stats.tallies(jobs(spark, sf, first), RATES), jobs(spark, sf, first), jobs(spark, sf, new.where(~gone)), ids, RATES)


def _moved_boards(spark, sf: str) -> dict[str, DataFrame]:
    return stats.boards(settled(_moved(spark, sf), "tallies"), stats.company_names(jobs(spark, sf)), F.to_timestamp(F.lit("1998-01-01 00:00:00")))


@query(f"""
WITH {_AFTER}, s AS (SELECT pay, unnest(regexp_split_to_array(o_orderpriority, '[- ]')) AS skill FROM w JOIN orders ON o_orderkey = id)
SELECT 'jobs' AS board, '' AS key, CAST(NULL AS DOUBLE) AS value, count(*) AS n FROM w UNION ALL SELECT 'company', company, NULL, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'remote', remote, NULL, count(*) FROM w GROUP BY 2
UNION ALL SELECT 'seniority', seniority, NULL, count(*) FROM w WHERE seniority IS NOT NULL GROUP BY 2 UNION ALL SELECT 'country', country, NULL, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'skill', skill, NULL, count(*) FROM s GROUP BY 2
UNION ALL SELECT 'posted', '', CAST(epoch_us(posted) AS DOUBLE), count(*) FROM w GROUP BY 3 UNION ALL SELECT 'pay', '', pay, count(*) FROM w WHERE pay IS NOT NULL GROUP BY 3
UNION ALL SELECT 'company_pay', company, pay, count(*) FROM w WHERE pay IS NOT NULL GROUP BY 2, 3 UNION ALL SELECT 'skill_pay', skill, pay, count(*) FROM s WHERE pay IS NOT NULL GROUP BY 2, 3
""")
def moved_tallies(spark, sf):
    return _moved(spark, sf)


@query(f"""
WITH {_AFTER} SELECT count(*) AS roles, count(DISTINCT company) AS companies, count(*) FILTER (remote = 'remote') AS remote, count(*) FILTER (remote = 'hybrid') AS hybrid, count(*) FILTER (remote = 'onsite') AS onsite,
  CAST(floor(count(*) FILTER (remote = 'remote') * 100.0 / count(*) + 0.5) AS BIGINT) AS remote_percent, median(pay) AS median_pay, count(*) FILTER (TIMESTAMP '1998-01-01' - posted <= INTERVAL 7 DAY) AS posted_this_week FROM w
""")
def moved_headline(spark, sf):
    return _moved_boards(spark, sf)["headline"].withColumn("remote_percent", F.col("remote_percent").cast("long"))


@query(f"""
WITH {_AFTER}, g AS (SELECT company, median(pay) AS value, count(pay) AS n FROM w WHERE pay IS NOT NULL GROUP BY 1 HAVING count(pay) >= 3 ORDER BY 2 DESC, 1 LIMIT 5)
SELECT company AS company_slug, 'Customer ' || company AS company_name, value, n, value / greatest(1, max(value) OVER ()) AS share FROM g
""")
def moved_top_paying(spark, sf):
    return _moved_boards(spark, sf)["top_paying"]


@query(f"WITH {_AFTER}, g AS (SELECT country, count(*) AS n FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6) SELECT country, n, n / greatest(1, max(n) OVER ()) AS share FROM g")
def moved_countries(spark, sf):
    return _moved_boards(spark, sf)["countries"]


@query(f"""
WITH {_JOBS}, r AS (SELECT *, coalesce(hi, lo) * CASE per WHEN 'month' THEN 12.0 ELSE 1.0 END * CASE cur WHEN 'GBP' THEN 1.27 ELSE 1.0 END AS top FROM j), t AS (SELECT *, CASE WHEN top > 2000000 THEN 0.0 ELSE top END AS rank_pay FROM r)
SELECT id, row_number() OVER (ORDER BY rank_pay DESC, ord) - 1 AS home_rank FROM t ORDER BY rank_pay DESC, ord LIMIT 50
""")
def home_jobs(spark, sf):
    return pages.home(jobs(spark, sf)).select("id", "home_rank")


@query("SELECT substr(o_orderpriority, 3) AS country, count(*) AS n FROM orders GROUP BY 1")
def filter_countries(spark, sf):
    return pages.filter_options(jobs(spark, sf))["countries"].select("country", "n")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
d AS (SELECT doc_id, pos, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(line, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), chr(160), ' '), '^\\s+|\\s+$', '', 'g') AS line FROM l),
t AS (SELECT doc_id, pos, line, regexp_matches(line, '^([•·▪◦‣*]|[-–—]\\s)') AS bullet FROM d WHERE NOT regexp_matches(line, '^([•·▪◦‣*]\\s*)?$')),
s AS (SELECT *, CASE WHEN bullet AND lag(bullet) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS b FROM t), r AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM s)
SELECT doc_id, CAST(block AS BIGINT) AS block, CASE WHEN bool_and(bullet) THEN 'ul' ELSE 'p' END AS type, count(*) AS lines FROM r GROUP BY 1, 2
""".replace("\\\\", "\\"))
def description_blocks(spark, sf):
    got = pages.blocks(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id", "text")
    return got.select("doc_id", F.col("block").cast("long"), "type", F.when(F.col("type") == "ul", F.size("items")).otherwise(1).cast("long").alias("lines"))


# ---- one run of ingest: orders above a price are postings, orders not in process are old jobs, some changed, closed or not posted again

_RUN = """
o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'Sales LLM ' WHEN 'O' THEN 'AI Engineer ' ELSE 'Cook ' END || o_orderpriority AS t, 'j_' || substr(sha1(o_custkey || '|' || o_orderkey), 1, 16) AS id, o_totalprice > 50000 AS posted, o_orderstatus <> 'P' AS was,
  o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT' AS closed, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') AS polled FROM orders),
g AS (SELECT *, posted AND NOT (was AND o_orderpriority < '4' AND NOT closed) AS changed FROM o)
"""


def _run(spark, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = orders(spark, sf)
    title = text(F.when(is_("F"), "Sales LLM ").when(is_("O"), "AI Engineer ").otherwise("Cook "), "o_orderpriority")
    at, before = F.to_timestamp(F.lit("2025-06-10 00:00:00")), F.to_timestamp(F.lit("2025-06-01 00:00:00"))
    digest = content_hash(title, F.lit("Python"), F.col("o_orderpriority"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    has = {
        "id": job_id(F.col("c"), F.col("k")), "source_id": text("=s", "c"), "title": F.lit("old"), "is_closed": F.col("o_orderpriority") == "1-URGENT", "is_direct": F.lit(False), "is_new": F.lit(False), "is_featured": F.lit(False),
        "last_seen_at": before, "ingested_at": before, "content_hash": F.when(F.col("o_orderpriority") < "4", digest).otherwise("x"),
    }
    jobs_ = o.where(~is_("P")).select(*(has.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in JOBS))
    says = {"external_id": F.col("k"), "title": title, "description_text": F.lit("Python"), "apply_url": text("=u", "k"), "location_raw": F.col("o_orderpriority")}
    postings = o.where("o_totalprice > 50000").select(F.col("c").alias("slug"), F.lit("lever").alias("ats_provider"), *(says.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_POSTING))
    customers = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("string").alias("c"), "c_mktsegment")
    targets = customers.select(F.col("c").alias("ats_token"), F.lit("lever").alias("ats_provider"), text("=c", "c").alias("company_id"), text("=s", "c").alias("source_id"), F.col("c").alias("slug"))
    polled = customers.where("c_mktsegment <> 'BUILDING'").select(text("=s", "c").alias("source_id"))
    return ingest.run(jobs_, spark.createDataFrame([], JOB_SKILLS), postings, targets, polled, at)


@query(f"""
WITH {_RUN} SELECT id, CASE WHEN changed THEN t ELSE 'old' END AS title, CASE WHEN posted THEN false ELSE closed OR polled END AS is_closed, NOT was AS is_new, CASE WHEN posted THEN 10 ELSE 1 END AS seen_day,
  CASE WHEN changed THEN CASE o_orderstatus WHEN 'F' THEN 'out' WHEN 'O' THEN 'in' ELSE 'out' END END AS classification FROM g WHERE was OR posted
""")
def ingest_jobs(spark, sf):
    return _run(spark, sf)[0].select("id", "title", "is_closed", "is_new", F.dayofmonth("last_seen_at").alias("seen_day"), "classification")


@query(f"WITH {_RUN} SELECT id AS job_id, 'sk_python' AS skill_id FROM g WHERE changed AND o_orderstatus = 'O'")
def ingest_skills(spark, sf):
    return _run(spark, sf)[1]


@query(f"""
WITH {_RUN} SELECT count(*) FILTER (posted) AS fetched, count(*) FILTER (changed) AS processed, count(*) FILTER (posted AND NOT changed) AS unchanged, count(*) FILTER (changed AND o_orderstatus = 'O') AS in_scope,
  count(*) FILTER (was AND NOT posted AND NOT closed AND polled) AS closed, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS feeds_failed FROM g
""")
def ingest_counters(spark, sf):
    return _run(spark, sf)[2]


@query("""
WITH o AS (SELECT 'j_' || substr(sha1(o_custkey || '|' || o_orderkey), 1, 16) AS id, o_orderstatus <> 'P' AS first, o_totalprice > 50000 AS second, 'AI Engineer ' || o_orderpriority AS t, o_orderpriority < '3' AS changes FROM orders)
SELECT id, CASE WHEN second AND changes THEN t || ' II' ELSE t END AS title, NOT second AS is_closed, CAST(CASE WHEN NOT first THEN 2 ELSE 1 END AS INTEGER) AS ingested_day FROM o WHERE first OR second
""")
def committed_runs(spark, sf):
    """Two runs published as versions one after the other, the second made twice; the latest version's jobs."""
    o = orders(spark, sf)
    store = Versions(spark, f"{shared_folder(spark)}/millrace-store-{uuid.uuid4().hex}")
    title = text("=AI Engineer ", "o_orderpriority")
    targets = o.select(F.col("c").alias("ats_token"), F.lit("lever").alias("ats_provider"), text("=c", "c").alias("company_id"), text("=s", "c").alias("source_id"), F.col("c").alias("slug")).distinct()

    def postings(df: DataFrame, says: Column) -> DataFrame:
        has = {"external_id": F.col("k"), "title": says, "description_text": F.lit("Python"), "apply_url": text("=u", "k")}
        return df.select(F.col("c").alias("slug"), F.lit("lever").alias("ats_provider"), *(has.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_POSTING))

    at = lambda day: F.to_timestamp(F.lit(f"2025-06-0{day} 00:00:00"))
    second = postings(o.where("o_totalprice > 50000"), F.when(F.col("o_orderpriority") < "3", F.concat(title, F.lit(" II"))).otherwise(title))
    ingest.commit(store, "first", postings(o.where(~is_("P")), title), targets, targets.select("source_id"), at(1))
    for _ in range(2):
        version = ingest.commit(store, "second", second, targets, targets.select("source_id"), at(2))
    return store.read("jobs", JOBS, version).select("id", "title", "is_closed", F.dayofmonth("ingested_at").alias("ingested_day"))
