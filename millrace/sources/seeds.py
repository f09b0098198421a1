"""The seed list of companies, and exchange rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import company_id, present, slugify, source_id, trim
from .feeds import PARSERS

COLUMNS = ["name", "ats_provider", "ats_slug", "domain", "stage"]


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Lines of five comma-separated fields without quoting, trimmed; blank lines and ``#`` comments dropped."""
    lines = spark.read.text(path).select(trim(F.col("value")).alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    parts = F.split("line", ",")
    return lines.select(*(present(trim(F.get(parts, k))).alias(c) for k, c in enumerate(COLUMNS)))


def endpoint(provider: Column, slug: Column) -> Column:
    """Where a board is listed."""
    part = lambda k: F.get(F.split(slug, ":"), k)
    made = {
        "greenhouse": F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), slug, F.lit("/jobs?content=true")),
        "lever": F.concat(F.lit("https://api.lever.co/v0/postings/"), slug, F.lit("?mode=json")),
        "ashby": F.concat(F.lit("https://api.ashbyhq.com/posting-api/job-board/"), slug, F.lit("?includeCompensation=true")),
        "workable": F.concat(F.lit("https://www.workable.com/api/accounts/"), slug),
        "recruitee": F.concat(F.lit("https://"), slug, F.lit(".recruitee.com/api/offers/")),
        "teamtailor": F.concat(F.lit("https://"), slug, F.lit(".teamtailor.com/jobs.json")),
        "smartrecruiters": F.concat(F.lit("https://api.smartrecruiters.com/v1/companies/"), slug, F.lit("/postings?limit=100")),
        "workday": F.concat(F.lit("https://"), part(0), F.lit("."), part(1), F.lit(".myworkdayjobs.com/wday/cxs/"), part(0), F.lit("/"), part(2), F.lit("/jobs")),
        "oracle": F.concat(F.lit("https://"), part(0), F.lit("/hcmRestApi/resources/latest/recruitingCEJobRequisitions?onlyData=true&finder=findReqs;siteNumber="), part(1), F.lit(",limit=100,sortBy=POSTING_DATES_DESC")),
        "eightfold": F.concat(F.lit("https://"), part(0), F.lit("/api/apply/v2/jobs?domain="), F.url_encode(part(1)), F.lit("&start=0&num=50")),
        "icims": F.concat(F.lit("https://"), F.when(F.contains(slug, F.lit(".")), slug).otherwise(F.concat(slug, F.lit(".icims.com"))), F.lit("/jobs/search")),
        "successfactors": F.concat(F.lit("https://"), part(0), F.lit("/search/?company="), F.url_encode(part(1))),
    }
    out = F.lit(None).cast("string")
    for name, url in made.items():
        out = F.when(provider == name, url).otherwise(out)
    return out


def seeded(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(companies, sources) of valid seeds: three fields required, a known provider; of one slug the last line counts."""
    ok = seeds.where("name IS NOT NULL AND ats_provider IS NOT NULL AND ats_slug IS NOT NULL").where(F.col("ats_provider").isin(list(PARSERS)))
    rows = ok.select(company_id(F.col("ats_slug")).alias("id"), "name", slugify(F.col("ats_slug")).alias("slug"), "domain", "ats_provider", F.col("ats_slug").alias("ats_token"), "stage", F.monotonically_increasing_id().alias("_n"))
    last = rows.groupBy("id").agg(F.max_by(F.struct("name", "slug", "domain", "ats_provider", "ats_token", "stage"), "_n").alias("r")).select("id", "r.*")
    sources = rows.select(source_id(F.col("id"), F.col("ats_provider")).alias("id"), F.col("id").alias("company_id"), "ats_provider", endpoint(F.col("ats_provider"), F.col("ats_token")).alias("endpoint_url"), "_n")
    one = sources.groupBy("id").agg(F.max_by(F.struct("company_id", "ats_provider", "endpoint_url"), "_n").alias("r")).select("id", "r.*", F.lit("active").alias("status"))
    return last, one


def fx_rates(spark: SparkSession, body: str | None) -> dict[str, float]:
    """US dollars per unit from a feed of units per dollar, 4 decimals; a missing currency, or a failed feed (None), falls back."""
    row = spark.range(1).select(F.from_json(F.lit(body).cast("string"), "result string, rates map<string,double>").alias("r")).first()["r"] if body else None
    if row is None or row["result"] != "success" or not row["rates"]:
        return dict(v.FEED_FX)
    return {c: 1.0 if c == "USD" else round(1 / row["rates"][c], 4) if row["rates"].get(c) else fallback for c, fallback in v.FEED_FX.items()}
