"""Queries over crawls, each with the same query as SQL: boards are customers or months, their recorded answers are built from the orders, and the crawl is replayed.

How a board answers follows from its customer's segment, or its month: pages that end short, totals that are wrong or missing, a second host, refusals, pages with nothing new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .feed_queries import _ld, _posting, is_, orders, struct, text
from .operators.tables import settled
from .sources import crawl, feeds

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


def with_segment(spark, sf: str) -> DataFrame:
    """Orders with their customer's segment (seg)."""
    customers = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("seg"))
    return orders(spark, sf).join(customers, "o_custkey")


def in_pages(o: DataFrame, keys: list[str], job: Column, size: int, most: int) -> DataFrame:
    """(keys, page, jobs, n): each board's jobs by order key in ``most`` pages of ``size``, empty ones included, with the board's number of jobs."""
    first = o.withColumn("_job", job).withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("o_orderkey"))).where(F.col("_r") <= size * most)
    every = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "_job"))).alias("_all"))
    n = o.groupBy(*keys).agg(F.count("*").alias("n"))
    paged = every.join(n, keys).select(*keys, "n", "_all", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("page"))
    return paged.select(*keys, "n", "page", F.transform(F.slice("_all", F.col("page") * size + 1, F.lit(size)), lambda x: x["_job"]).alias("jobs"))


def answer(df: DataFrame, provider: str, slug: Column, address: Column, status: Column | int, body: Column, turn: int = 0) -> DataFrame:
    """Recorded answers; those whose status is null aren't recorded."""
    status = F.lit(status) if isinstance(status, int) else status
    return df.select(F.lit(provider).alias("provider"), slug.alias("slug"), address.alias("address"), F.lit(turn).alias("turn"), status.alias("status"), body.alias("body")).where("status IS NOT NULL")


def is_seg(*names: str) -> Column:
    return F.col("seg").isin(*names)


# ---- a board in one answer; one at the second host, one that is broken


def _greenhouse(spark, sf: str) -> DataFrame:
    job = struct(id=F.col("o_orderkey"), title=text("=Engineer ", "o_orderpriority"), absolute_url=text("=u", "k"))
    boards = with_segment(spark, sf).groupBy("c", "seg").agg(F.to_json(struct(jobs=F.collect_list(job))).alias("body"))
    at = lambda region: text(f"=https://boards-api.{region}greenhouse.io/v1/boards/", "c", "=/jobs?content=true")
    near = answer(boards, "greenhouse", F.col("c"), at(""), F.when(is_seg("AUTOMOBILE", "MACHINERY"), 404).when(is_seg("HOUSEHOLD"), 500).otherwise(200), F.col("body"))
    far = answer(boards, "greenhouse", F.col("c"), at("eu."), F.when(is_seg("MACHINERY"), 404).otherwise(200), F.col("body"))
    return crawl.archived(near.unionByName(far))


_SEGMENT = "s AS (SELECT o.*, c_mktsegment AS seg FROM orders o JOIN customer ON c_custkey = o_custkey)"


@query(f"WITH {_SEGMENT} SELECT CAST(o_custkey AS VARCHAR) AS slug, CAST(o_orderkey AS VARCHAR) AS external_id, 'Engineer ' || o_orderpriority AS title, 'u' || o_orderkey AS apply_url FROM s WHERE seg NOT IN ('MACHINERY', 'HOUSEHOLD')")
def crawl_greenhouse(spark, sf):
    got = crawl.lists(_greenhouse(spark, sf))
    return feeds.greenhouse(crawl.pages(got, "greenhouse")).select("slug", "external_id", "title", "apply_url")


# ---- pages until one is short, the total is met or the limit is reached; 429 once; details that are missing or refused

SMALL = {**crawl.PAGED, "smartrecruiters": crawl.Paged(crawl._ask_smartrecruiters, "content", 3, 9, "totalFound")}


def _smartrecruiters(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """Boards with their archives, and the recorded details."""
    o = with_segment(spark, sf)
    job = struct(id=F.col("k"), name=text("=Engineer ", "o_orderpriority"), location=struct(city=F.col("o_orderstatus")))
    p = in_pages(o, ["c", "seg"], job, 3, 3)
    total = F.when(is_seg("MACHINERY"), 4).when(~is_seg("AUTOMOBILE"), F.col("n"))
    jobs = F.when(is_seg("HOUSEHOLD") & (F.col("page") == 1), F.slice("jobs", 1, 2)).otherwise(F.col("jobs"))
    address = text("=https://api.smartrecruiters.com/v1/companies/", "c", "=/postings?limit=3&offset=", (F.col("page") * 3).cast("string"))
    body = F.to_json(struct(content=jobs, totalFound=total.cast("long")))
    status = F.when(is_seg("FURNITURE") & (F.col("page") == 1), 500).otherwise(200)
    listed = answer(p, "smartrecruiters", F.col("c"), address, status, body, 1)
    slow = answer(p.where(is_seg("AUTOMOBILE")), "smartrecruiters", F.col("c"), address, 429, F.lit(None).cast("string"))
    one = text("=https://api.smartrecruiters.com/v1/companies/", "c", "=/postings/", "k")
    own = F.to_json(struct(postingUrl=text("=p", "k"), jobAd=struct(sections=struct(jobDescription=struct(text=F.lit("<b>x</b>"))))))
    detail = answer(o, "smartrecruiters", F.col("c"), one, F.when(F.col("o_orderpriority") == "1-URGENT", 200).when(F.col("o_orderpriority") == "2-HIGH", 404), own)
    return crawl.archived(listed.unionByName(slow)), detail


_RANKED = f"""
{_SEGMENT}, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM s),
m AS (SELECT * FROM r WHERE CASE seg WHEN 'BUILDING' THEN r < 9 WHEN 'AUTOMOBILE' THEN r < 3 WHEN 'MACHINERY' THEN r < 6 WHEN 'HOUSEHOLD' THEN r < 5 ELSE n <= 3 END)
"""


@query(f"""
WITH {_RANKED} SELECT CAST(o_custkey AS VARCHAR) AS slug, CAST(o_orderkey AS VARCHAR) AS external_id, 'Engineer ' || o_orderpriority AS title, CASE WHEN o_orderpriority = '1-URGENT' THEN 'p' || o_orderkey ELSE 'https://jobs.smartrecruiters.com/' || o_custkey || '/' || o_orderkey END AS apply_url,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'x' END AS description_text FROM m
""")
def crawl_smartrecruiters(spark, sf):
    boards, recorded = _smartrecruiters(spark, sf)
    pages = crawl.pages(crawl.lists(boards, paged=SMALL), "smartrecruiters")
    got = crawl.details(crawl.detail_requests(pages, "smartrecruiters"), recorded=recorded)
    return feeds.smartrecruiters(pages, crawl.detail_rows(got, "smartrecruiters")).select("slug", "external_id", "title", "apply_url", "description_text")


@query(f"""
WITH {_SEGMENT}, b AS (SELECT o_custkey, seg, count(*) AS n FROM s GROUP BY 1, 2),
g AS (SELECT CASE seg WHEN 'HOUSEHOLD' THEN 'failed' WHEN 'MACHINERY' THEN 'failed' ELSE 'done' END AS outcome, CASE seg WHEN 'HOUSEHOLD' THEN 'HTTP 500' WHEN 'MACHINERY' THEN 'HTTP 404' ELSE 'whole' END AS reason FROM b),
q AS (SELECT CASE WHEN seg = 'FURNITURE' AND n > 3 THEN 'failed' ELSE 'done' END AS outcome, CASE WHEN n < 3 THEN 'short page' WHEN n = 3 THEN CASE seg WHEN 'MACHINERY' THEN 'short page' ELSE 'total met' END WHEN seg = 'AUTOMOBILE' THEN 'total met'
  WHEN seg = 'FURNITURE' THEN 'HTTP 500' WHEN seg = 'HOUSEHOLD' THEN 'short page' WHEN seg = 'MACHINERY' THEN CASE WHEN n < 6 THEN 'short page' ELSE 'total met' END WHEN n > 9 THEN 'limit' WHEN n IN (6, 9) THEN 'total met' ELSE 'short page' END AS reason FROM b),
a AS (SELECT 'greenhouse' AS provider, 'end' AS kind, outcome, reason, 1 AS n FROM g UNION ALL SELECT 'smartrecruiters', 'end', outcome, reason, 1 FROM q
  UNION ALL SELECT 'greenhouse', 'list', 'ok', NULL, count(*) FROM b WHERE seg NOT IN ('MACHINERY', 'HOUSEHOLD') UNION ALL SELECT 'greenhouse', 'list', 'refused', NULL, count(*) FROM b WHERE seg = 'HOUSEHOLD'
  UNION ALL SELECT 'greenhouse', 'list', 'missing', NULL, sum(CASE seg WHEN 'MACHINERY' THEN 2 ELSE 1 END) FROM b WHERE seg IN ('MACHINERY', 'AUTOMOBILE')
  UNION ALL SELECT 'smartrecruiters', 'list', 'wait', NULL, count(*) FROM b WHERE seg = 'AUTOMOBILE' UNION ALL SELECT 'smartrecruiters', 'list', 'refused', NULL, count(*) FROM b WHERE seg = 'FURNITURE' AND n > 3
  UNION ALL SELECT 'smartrecruiters', 'list', 'ok', NULL, sum(CASE WHEN n < 3 OR seg IN ('AUTOMOBILE', 'FURNITURE') THEN 1 WHEN seg = 'MACHINERY' THEN 2 WHEN n = 3 THEN 1 WHEN seg = 'HOUSEHOLD' THEN 2 ELSE least(ceil(n / 3), 3) END) FROM b)
SELECT provider, kind, outcome, reason, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY 1, 2, 3, 4 HAVING sum(n) > 0
""")
def crawl_outcomes(spark, sf):
    got = crawl.lists(_greenhouse(spark, sf).unionByName(_smartrecruiters(spark, sf)[0]), paged=SMALL)
    return got.groupBy("provider", "kind", "outcome", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {_SEGMENT} SELECT 'src' || o_custkey AS source_id FROM s WHERE seg NOT IN ('MACHINERY', 'HOUSEHOLD') GROUP BY o_custkey")
def crawl_polled(spark, sf):
    """Which sources a crawl polled: those whose boards failed aren't, nor are targets that it didn't ask."""
    targets = spark.read.parquet(f"{sf}/customer.parquet").select(F.lit("greenhouse").alias("ats_provider"), F.col("c_custkey").cast("string").alias("ats_token"), F.concat(F.lit("src"), "c_custkey").alias("source_id"))
    return crawl.polled(crawl.lists(_greenhouse(spark, sf)), targets)


# ---- keyword searches: boards are months, the first search finds all their orders, the others some of them


def searched(spark, sf: str) -> DataFrame:
    """Each order once for every search that finds it: word number (q) and month (m)."""
    found = F.when(is_("F"), F.array(F.lit(0), F.lit(1))).when(is_("O"), F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    return orders(spark, sf).withColumns({"m": F.date_format("o_orderdate", "yyyy-MM"), "q": F.explode(found)})


def word(q: Column, encoded: bool) -> Column:
    out = F.lit(None).cast("string")
    for k, w in enumerate(crawl.KEYWORDS):
        out = F.when(q == k, w.replace(" ", "%20") if encoded else w).otherwise(out)
    return out


_SEARCHED = """
o AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS m FROM orders),
f AS (SELECT *, 0 AS q FROM o UNION ALL SELECT *, 1 FROM o WHERE o_orderstatus = 'F' UNION ALL SELECT *, 2 FROM o WHERE o_orderstatus = 'O'),
k AS (SELECT *, row_number() OVER (PARTITION BY m, q ORDER BY o_orderkey) - 1 AS r FROM f)
"""


@query(f"""
WITH {_SEARCHED}, u AS (SELECT m, o_orderkey, any_value(o_orderpriority) AS p, any_value(o_orderstatus) AS s, min(q * 1000 + r) AS place FROM k WHERE r < 80 AND m NOT LIKE '%-07' GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY place) AS n FROM u WHERE p <> '5-LOW')
SELECT 't:dc:' || m AS slug, CAST(o_orderkey AS VARCHAR) AS external_id, 'Data Engineer ' || p AS title, 'https://t.dc.myworkdayjobs.com/' || m || '/job/' || o_orderkey AS apply_url, CASE s WHEN 'P' THEN 'D' ELSE s END AS location_raw FROM c WHERE n <= 50
""")
def crawl_workday(spark, sf):
    """Twenty a page, eighty a search, fifty details a board; boards of July refuse the last search, so they have failed."""
    o, slug = searched(spark, sf), text("=t:dc:", "m")
    job = struct(title=F.when(F.col("o_orderpriority") == "5-LOW", "Cook").otherwise(text("=Data Engineer ", "o_orderpriority")), externalPath=text("=/job/", "k"), locationsText=F.col("o_orderstatus"), bulletFields=F.array("k"))
    p = in_pages(o, ["m", "q"], job, 20, 4)
    asked = text("=https://t.dc.myworkdayjobs.com/wday/cxs/t/", "m", '=/jobs {"appliedFacets":{},"limit":20,"offset":', (F.col("page") * 20).cast("string"), '=,"searchText":"', word(F.col("q"), False), '="}')
    listed = answer(p, "workday", slug, asked, F.when(F.endswith("m", F.lit("-07")) & (F.col("q") == 2), 503).otherwise(200), F.to_json(struct(jobPostings=F.col("jobs"))))
    own = F.to_json(struct(jobPostingInfo=struct(location=F.lit("D"))))
    detail = answer(o.where(is_("P")), "workday", slug, text("=https://t.dc.myworkdayjobs.com/wday/cxs/t/", "m", "=/job/", "k"), 200, own)
    nothing = answer(p.select("m").distinct().crossJoin(F.broadcast(spark.range(3).select(F.col("id").alias("q")))), "workday", slug, text("=https://t.dc.myworkdayjobs.com/wday/cxs/t/", "m", '=/jobs {"appliedFacets":{},"limit":20,"offset":0,"searchText":"', word(F.col("q"), False), '="}'), 200, F.lit("{}"), 1)
    pages = crawl.pages(settled(crawl.lists(crawl.archived(listed.unionByName(nothing))), "answers"), "workday")
    got = crawl.details(crawl.detail_requests(pages, "workday"), recorded=detail)
    return feeds.workday(pages, crawl.detail_rows(got, "workday")).select("slug", "external_id", "title", "apply_url", "location_raw")


@query(f"""
WITH {_SEARCHED} SELECT 'h:' || m AS slug, CAST(o_orderkey AS VARCHAR) AS external_id, 'AI Scientist ' || any_value(o_orderstatus) AS title, 'https://h/careers/job/' || o_orderkey AS apply_url FROM k WHERE r < 150 GROUP BY m, o_orderkey
""")
def crawl_eightfold(spark, sf):
    """Fifty a page, a hundred and fifty a search; what several searches find is one posting."""
    o, slug = searched(spark, sf), text("=h:", "m")
    job = struct(id=F.col("o_orderkey"), name=text("=AI Scientist ", "o_orderstatus"))
    every = in_pages(o, ["m", "q"], job, 50, 3)
    at = lambda q, page: text("=https://h/api/apply/v2/jobs?domain=", "m", "=&query=", word(q, True), "=&start=", (page * 50).cast("string"), "=&num=50&sort_by=relevance")
    listed = answer(every, "eightfold", slug, at(F.col("q"), F.col("page")), 200, F.to_json(struct(positions=F.col("jobs"))))
    nothing = answer(every.select("m").distinct().crossJoin(F.broadcast(spark.range(3).select(F.col("id").alias("q")))), "eightfold", slug, at(F.col("q"), F.lit(0)), 200, F.lit("{}"), 1)
    return feeds.eightfold(crawl.pages(crawl.lists(crawl.archived(listed.unionByName(nothing))), "eightfold")).select("slug", "external_id", "title", "apply_url")


# ---- searches that stop where a page names nothing new; shapes of a search


@query("""
WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS m FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY m) AS n FROM o)
SELECT m || '.jobs' AS slug, CAST(o_orderkey AS VARCHAR) AS external_id, 'Data ' || o_orderpriority AS title, 'https://' || m || '.jobs/jobs/' || o_orderkey || '/x-y/job' AS apply_url FROM k WHERE o_orderstatus <> 'P' AND (r < 20 OR n > 20 AND (r >= n - 10 OR r < 30))
""")
def crawl_icims(spark, sf):
    """The first search names twenty links; the second begins with known ones, so its next page isn't asked for; the last begins with a board's latest ones and goes on only where those are new."""
    o = orders(spark, sf).withColumn("m", F.date_format("o_orderdate", "yyyy-MM"))
    rank = lambda name, order, most: o.select("m", "k", "o_orderkey", F.row_number().over(W.partitionBy("m").orderBy(order)).alias(name)).where(F.col(name) <= most).withColumn(name, F.col(name) - 1)
    link = text("=<a href='/jobs/", "k", "=/x-y/job'>")
    near = lambda c, a, b: F.concat_ws("", F.array_sort(F.collect_list(F.when((F.col(c) >= a) & (F.col(c) < b), link))))
    told = [(0, 0, near("first", 0, 10)), (0, 1, near("first", 10, 20)), (1, 0, near("first", 0, 10)), (1, 1, near("last", 0, 10)), (2, 0, near("last", 0, 10)), (2, 1, near("first", 20, 30))]
    edge = rank("first", F.asc("o_orderkey"), 30).unionByName(rank("last", F.desc("o_orderkey"), 10), allowMissingColumns=True)
    page = F.array(*(struct(q=F.lit(q), p=F.lit(p), html=F.col(f"p{q}{p}")) for q, p, _ in told))
    pages = edge.groupBy("m").agg(*(html.alias(f"p{q}{p}") for q, p, html in told)).select("m", F.inline(page))
    slug = text("m", "=.jobs")
    address = text("=https://", "m", "=.jobs/jobs/search?ss=1&searchRelation=keyword_all&searchKeyword=", word(F.col("q"), True), "=&pr=", F.col("p").cast("string"))
    out = answer(pages, "icims", slug, address, F.when((F.col("html") == "") & (F.col("p") == 1), 404).otherwise(200), F.col("html"))
    page = _ld(_posting(text("=Data ", "o_orderpriority")))
    detail = answer(o, "icims", slug, text("=https://", "m", "=.jobs/jobs/", "k", "=/x-y/job"), F.when(is_("P"), 404).otherwise(200), page)
    listed = crawl.pages(settled(crawl.lists(crawl.archived(out)), "answers"), "icims")
    got = crawl.details(crawl.detail_requests(listed, "icims"), recorded=detail)
    return feeds.icims(listed, crawl.detail_rows(got, "icims")).select("slug", "external_id", "title", "apply_url")


@query(f"""
WITH {_SEGMENT}, w AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS q FROM s), f AS (SELECT *, min(q) OVER (PARTITION BY o_custkey) AS first FROM w)
SELECT 'host:' || o_custkey AS slug, CAST(o_orderkey AS VARCHAR) AS external_id, 'Software ' || o_orderpriority AS title FROM f WHERE seg IN ('BUILDING', 'MACHINERY') OR seg = 'AUTOMOBILE' AND q = first
""")
def crawl_successfactors(spark, sf):
    """BUILDING answers at the first shape of a search, MACHINERY refuses it; AUTOMOBILE answers there without postings, so its second shape is asked for until one was found; HOUSEHOLD answers nothing."""
    o = with_segment(spark, sf).withColumn("q", F.when(is_("F"), 0).when(is_("O"), 1).otherwise(2))
    node = _posting(text("=Software ", "o_orderpriority"), identifier=F.col("k"))
    has = o.groupBy("c", "seg", "q").agg(_ld(F.collect_list(node)).alias("body"))
    every = o.select("c", "seg").distinct().crossJoin(F.broadcast(spark.range(3).select(F.col("id").cast("int").alias("q")))).join(has, ["c", "seg", "q"], "left").withColumn("body", F.coalesce("body", F.lit("<html></html>")))
    empty, w = F.lit("<html></html>"), word(F.col("q"), True)
    first = answer(every, "successfactors", text("=host:", "c"), text("=https://host/search/?q=", w, "=&company=", "c"), F.when(is_seg("BUILDING", "AUTOMOBILE"), 200).when(is_seg("MACHINERY"), 404).when(is_seg("FURNITURE"), 500), F.when(is_seg("BUILDING"), F.col("body")).otherwise(empty))
    second = answer(every, "successfactors", text("=host:", "c"), text("=https://host/careersection/2/jobsearch.ftl?company=", "c", "=&searchText=", w), F.when(~is_seg("HOUSEHOLD"), 200), F.when(is_seg("FURNITURE"), empty).otherwise(F.col("body")))
    boards = crawl.archived(first.unionByName(second))
    return feeds.successfactors(crawl.pages(crawl.lists(boards), "successfactors")).select("slug", "external_id", "title")
