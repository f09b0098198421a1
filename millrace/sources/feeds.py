"""Board feeds: one parser per provider from landed answers (sources.schemas.PAGES, DETAILS) to slug and RAW_POSTING columns.

Fetching is apart (sources.crawl); a feed that failed has no rows here and isn't among the polled sources, so its jobs don't close.
Lists keep the order they were met in, as ``ord``: query, page, position (and place in a list within). Of postings with one id the last one counts (plans.ingest).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vocabulary as v
from ..functions.enrich import parse_salary
from ..functions.text import decode_entities, joined, matches, present, strip_html, trim
from ..operators.relational import keep_first, keep_last_in_first_place
from .jsonld import job_postings, timestamp
from .schemas import DETAIL, LIST, RAW_POSTING

DETAIL_CAP = 50


def postings(df: DataFrame, place: Column | None = None, **cols: Column) -> DataFrame:
    """slug, ord (from ``place``, by default the entry's own) and every RAW_POSTING column in its type, null where a feed hasn't it."""
    place = F.col("ord") if place is None else place
    return df.select("slug", F.array(place["query"], place["page"], place["pos"]).alias("ord"), *((cols.get(f.name) if f.name in cols else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_POSTING))


def entries(pages: DataFrame, provider: str, field: str | None) -> DataFrame:
    """(slug, ord, j): the elements of a list answer; an answer of another shape gives none."""
    schema = LIST[provider]
    parsed = F.from_json("body", schema)
    items = parsed if field is None else parsed[field]
    return pages.select("slug", "query", "page", F.posexplode(items)).select("slug", F.struct("query", "page", "pos").alias("ord"), F.col("col").alias("j"))


def with_details(df: DataFrame, details: DataFrame, provider: str) -> DataFrame:
    """Each listed entry with its detail (by ``key``) as ``d``; one that failed leaves it null."""
    d = details.select("slug", "key", F.from_json("body", DETAIL[provider]).alias("d"))
    return df.join(keep_first(d, ["slug", "key"], [F.col("d").isNull()]), ["slug", "key"], "left")


def capped(df: DataFrame, cap: int = DETAIL_CAP, order: str = "place") -> DataFrame:
    """The first ``cap`` entries of each board."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy("slug").orderBy(order))).where(F.col("_n") <= cap).drop("_n")


def tech(title: Column) -> Column:
    return matches(title, v.TECH_TITLE, True)


def text_of(html: Column) -> Column:
    return F.when(present(html).isNotNull(), strip_html(html))


def mode(c: Column, **names: str) -> Column:
    """A remote type by a provider's word for it, in any case."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(None).cast("string")
    for word, kind in names.items():
        out = F.when(low.isin(word, word.replace("_", "-")), F.lit(kind)).otherwise(out)
    return out


PLAIN_MODES = {"remote": "remote", "hybrid": "hybrid", "on_site": "onsite", "onsite": "onsite"}


def required(df: DataFrame) -> DataFrame:
    return df.where(present(F.col("apply_url")).isNotNull())


def greenhouse(pages: DataFrame, details: DataFrame | None = None) -> DataFrame:
    e = entries(pages, "greenhouse", "jobs").withColumn("html", F.when(present(F.col("j.content")).isNotNull(), decode_entities(F.col("j.content"))))
    return postings(
        e, external_id=F.col("j.id"), title=trim(F.col("j.title")), description_html=F.col("html"), description_text=text_of(F.col("html")), apply_url=F.col("j.absolute_url"),
        location_raw=F.col("j.location.name"), posted_at=timestamp(F.col("j.first_published")), updated_at=timestamp(F.col("j.updated_at")),
    )


def lever(pages: DataFrame, details: DataFrame | None = None) -> DataFrame:
    e = entries(pages, "lever", None)
    return required(postings(
        e, external_id=F.col("j.id"), title=trim(F.col("j.text")), description_html=F.col("j.description"), description_text=F.coalesce("j.descriptionPlain", text_of(F.col("j.description"))),
        apply_url=F.coalesce("j.applyUrl", "j.hostedUrl"), location_raw=F.col("j.categories.location"), employment_type=F.col("j.categories.commitment"),
        posted_at=F.when(F.col("j.createdAt") != 0, F.timestamp_millis("j.createdAt")), remote_type=mode(F.col("j.workplaceType"), **PLAIN_MODES),
    ))


def ashby(pages: DataFrame, details: DataFrame | None = None) -> DataFrame:
    e = entries(pages, "ashby", "jobs").where(F.coalesce("j.isListed", F.lit(True)))
    e = e.withColumn("pay", parse_salary(F.coalesce("j.compensation.scrapeableCompensationSalarySummary", "j.compensation.compensationTierSummary")))
    return required(postings(
        e, external_id=F.col("j.id"), title=trim(F.col("j.title")), description_html=F.col("j.descriptionHtml"), description_text=F.coalesce("j.descriptionPlain", text_of(F.col("j.descriptionHtml"))),
        apply_url=F.coalesce("j.applyUrl", "j.jobUrl"), location_raw=F.col("j.location"), remote_type=F.coalesce(mode(F.col("j.workplaceType"), **PLAIN_MODES), F.when(F.col("j.isRemote"), "remote")),
        remote_hint=F.col("j.isRemote"), employment_type=F.col("j.employmentType"), posted_at=timestamp(F.col("j.publishedAt")), updated_at=timestamp(F.col("j.updatedAt")),
        **{c: F.col(f"pay.{c}") for c in ("salary_min", "salary_max", "salary_currency", "salary_period")},
    ))


def workable_listed(pages: DataFrame) -> DataFrame:
    url = F.coalesce("j.application_url", "j.shortlink", "j.url")
    return entries(pages, "workable", "jobs").where(present(url).isNotNull()).withColumns({"url": url, "place": F.col("ord"), "key": F.col("j.shortcode")})


def workable(pages: DataFrame, details: DataFrame) -> DataFrame:
    e = with_details(workable_listed(pages), details, "workable")
    html = joined("\n", F.col("d.description"), F.col("d.requirements"), F.col("d.benefits"))
    place = F.when(F.col("d.location").isNotNull(), joined(", ", *(F.col(f"d.location.{c}") for c in ("city", "region", "country")))).otherwise(joined(", ", *(F.col(f"j.{c}") for c in ("city", "state", "country"))))
    flag = F.coalesce("d.remote", "j.telecommuting")
    return postings(
        e.withColumn("html", html), external_id=F.col("j.shortcode"), title=trim(F.col("j.title")), description_html=F.col("html"), description_text=text_of(F.col("html")), apply_url=F.col("url"), location_raw=place,
        remote_type=F.coalesce(mode(F.col("d.workplace"), **PLAIN_MODES), F.when(flag, "remote")), remote_hint=flag, employment_type=F.col("j.employment_type"), posted_at=timestamp(F.col("j.published_on")),
    )


def offer_date(c: Column) -> Column:
    """``2025-12-16 22:33:14 UTC`` as a point in time."""
    return timestamp(F.replace(c, F.lit(" UTC"), F.lit("Z")))


def recruitee(pages: DataFrame, details: DataFrame | None = None) -> DataFrame:
    e = entries(pages, "recruitee", "offers").where(F.coalesce("j.status", F.lit("published")) == "published")
    e = e.withColumn("html", joined("\n", F.col("j.description"), F.col("j.requirements")))
    kind = F.when(F.col("j.remote"), "remote").when(F.col("j.hybrid"), "hybrid").when(F.col("j.on_site"), "onsite")
    return required(postings(
        e, external_id=F.col("j.id"), title=trim(F.col("j.title")), description_html=F.col("html"), description_text=text_of(F.col("html")), apply_url=F.coalesce("j.careers_apply_url", "j.careers_url"),
        location_raw=F.coalesce(F.col("j.location"), joined(", ", F.col("j.city"), F.col("j.country")), F.lit("")), remote_type=kind, remote_hint=F.col("j.remote"), employment_type=F.col("j.employment_type_code"),
        posted_at=offer_date(F.coalesce("j.published_at", "j.created_at")), updated_at=offer_date(F.col("j.updated_at")),
    ))


def teamtailor(pages: DataFrame, details: DataFrame | None = None) -> DataFrame:
    e = entries(pages, "teamtailor", "items")
    a = F.get(F.col("j._jobposting.jobLocation"), 0)["address"]
    return required(postings(
        e, external_id=F.col("j.id"), title=trim(F.col("j.title")), description_html=F.col("j.content_html"), description_text=text_of(F.col("j.content_html")), apply_url=F.col("j.url"),
        location_raw=joined(", ", a["addressLocality"], a["addressRegion"], a["addressCountry"]), posted_at=timestamp(F.col("j.date_published")),
    ))


#: The sections of a posting, in the order they are joined.
SECTIONS = ["companyDescription", "jobDescription", "qualifications", "additionalInformation"]


def smartrecruiters_listed(pages: DataFrame) -> DataFrame:
    return entries(pages, "smartrecruiters", "content").withColumns({"place": F.col("ord"), "key": F.col("j.id")})


def smartrecruiters(pages: DataFrame, details: DataFrame) -> DataFrame:
    e = with_details(smartrecruiters_listed(pages), details, "smartrecruiters")
    e = e.withColumns({"html": joined("\n", *(F.try_element_at("d.jobAd.sections", F.lit(s))["text"] for s in SECTIONS)), "loc": F.coalesce("d.location", "j.location")})
    whole = present(F.array_join(F.filter(F.transform(F.split(F.coalesce("loc.fullLocation", F.lit("")), ","), trim), lambda x: x != ""), ", "))
    place = F.coalesce(whole, joined(", ", F.col("loc.city"), F.col("loc.region"), F.upper("loc.country")))
    known = (present(F.col("loc.city")).isNotNull()) | (present(F.col("loc.country")).isNotNull())
    kind = F.when(F.col("loc.remote"), "remote").when(F.col("loc.hybrid"), "hybrid").when(known, "onsite")
    return postings(
        e, external_id=F.col("j.id"), title=trim(F.col("j.name")), description_html=F.col("html"), description_text=text_of(F.col("html")),
        apply_url=F.coalesce(F.col("d.postingUrl"), F.col("d.applyUrl"), F.concat(F.lit("https://jobs.smartrecruiters.com/"), "slug", F.lit("/"), "j.id")), location_raw=place, remote_type=kind,
        remote_hint=F.when(kind.isNotNull(), kind == "remote"), employment_type=F.coalesce("d.typeOfEmployment", "j.typeOfEmployment")["label"], posted_at=timestamp(F.col("j.releasedDate")),
    )


def slug_part(k: int, parts: int, what: str) -> Column:
    """Part k of a slug of ``parts`` parts joined by colons; fails where one is empty."""
    own = F.split("slug", ":")
    ok = F.size(own) >= parts
    for i in range(parts):
        ok = ok & (F.coalesce(F.get(own, i), F.lit("")) != "")
    return F.when(ok, F.get(own, k)).otherwise(F.raise_error(F.concat(F.lit(f"slug must be {what}, got "), "slug")).cast("string"))


def workday_listed(pages: DataFrame) -> DataFrame:
    e = entries(pages, "workday", "jobPostings").withColumn("key", F.col("j.externalPath")).where(present(F.col("key")).isNotNull())
    return capped(keep_last_in_first_place(e, ["slug", "key"], F.col("ord")).where(tech(F.col("j.title"))))


def workday(pages: DataFrame, details: DataFrame) -> DataFrame:
    tenant, dc, site = (slug_part(k, 3, "tenant:dc:site") for k in range(3))
    e = with_details(workday_listed(pages), details, "workday").withColumns({"d": F.col("d.jobPostingInfo"), "path": F.col("key")})
    base = F.concat(F.lit("https://"), tenant, F.lit("."), dc, F.lit(".myworkdayjobs.com/"), site)
    return postings(
        e, F.col("place"), external_id=F.coalesce(F.get("j.bulletFields", 0), F.col("d.jobReqId"), F.col("path")), title=trim(F.coalesce("d.title", "j.title")), description_html=present(F.col("d.jobDescription")),
        description_text=text_of(F.col("d.jobDescription")), apply_url=F.coalesce(F.col("d.externalUrl"), F.concat(base, "path")), location_raw=F.coalesce("d.location", "j.locationsText"),
        employment_type=F.col("d.timeType"), posted_at=timestamp(F.col("d.startDate")),
    )


def oracle_listed(pages: DataFrame) -> DataFrame:
    outer = entries(pages, "oracle", "items").select("slug", "ord", F.posexplode("j.requisitionList").alias("n", "r"))
    place = F.struct("ord.query", "ord.page", F.struct("ord.pos", "n").alias("pos")).alias("ord")
    e = outer.select("slug", place, F.col("r").alias("j"), F.col("r.Id").alias("key")).where(present(F.col("key")).isNotNull())
    return capped(keep_last_in_first_place(e, ["slug", "key"], F.col("ord")).where((present(F.col("j.Title")).isNotNull()) & tech(F.col("j.Title"))))


def oracle(pages: DataFrame, details: DataFrame) -> DataFrame:
    host, site = (slug_part(k, 2, "host:site") for k in range(2))
    e = with_details(oracle_listed(pages), details, "oracle").withColumns({"d": F.get("d.items", 0), "id": F.col("key")})
    e = e.withColumn("html", joined("\n", F.col("d.ExternalDescriptionStr"), F.col("d.ExternalResponsibilitiesStr"), F.col("d.ExternalQualificationsStr")))
    more = F.array_join(F.filter(F.transform("j.secondaryLocations", lambda s: present(s["Name"])), lambda x: x.isNotNull()), "; ")
    return postings(
        e, F.struct("place.query", "place.page", F.col("place.pos.n").alias("pos")), external_id=F.col("id"), title=trim(F.col("j.Title")), description_html=F.col("html"), description_text=text_of(F.col("html")),
        apply_url=F.concat(F.lit("https://"), host, F.lit("/hcmUI/CandidateExperience/en/sites/"), site, F.lit("/job/"), "id"),
        location_raw=present(F.coalesce(F.col("j.PrimaryLocation"), F.col("d.PrimaryLocation"), more)), posted_at=timestamp(F.coalesce("j.PostedDate", "d.PostedDate")),
    )


def eightfold(pages: DataFrame, details: DataFrame | None = None) -> DataFrame:
    host = slug_part(0, 2, "host:domain")
    e = entries(pages, "eightfold", "positions").withColumn("id", F.col("j.id")).where(F.col("id").isNotNull())
    e = keep_last_in_first_place(e, ["slug", "id"], F.col("ord")).where((present(F.col("j.name")).isNotNull()) & tech(F.col("j.name")))
    when = lambda c: F.when(F.col(c) > 0, F.timestamp_seconds(c))
    return postings(
        e, F.col("place"), external_id=F.col("id"), title=trim(F.col("j.name")), description_html=present(F.col("j.job_description")), description_text=text_of(F.col("j.job_description")),
        apply_url=F.coalesce(F.col("j.canonicalPositionUrl"), F.concat(F.lit("https://"), host, F.lit("/careers/job/"), "id")), location_raw=F.coalesce(F.col("j.location"), F.array_join("j.locations", "; ")),
        posted_at=when("j.t_create"), updated_at=when("j.t_update"), remote_type=mode(F.col("j.work_location_option"), remote="remote", hybrid="hybrid", on_site="onsite", onsite="onsite"),
    )


LINK = r"/jobs/([0-9]+)/[A-Za-z0-9._~%-]+/job"


def icims_host() -> Column:
    return F.when(F.contains("slug", F.lit(".")), F.col("slug")).otherwise(F.concat("slug", F.lit(".icims.com")))


def icims_listed(pages: DataFrame) -> DataFrame:
    found = pages.select("slug", "query", "page", F.posexplode(F.regexp_extract_all("body", F.lit(LINK), F.lit(0))).alias("pos", "key"))
    return capped(found.groupBy("slug", "key").agg(F.min(F.struct("query", "page", "pos")).alias("place")))


def icims(pages: DataFrame, details: DataFrame) -> DataFrame:
    """Search pages name detail paths; a detail page that is missing or whose first posting isn't technical drops its row."""
    host = icims_host()
    d = details.select("slug", "key", F.get(job_postings(F.col("body")), 0).alias("j"))
    e = icims_listed(pages).join(d, ["slug", "key"]).withColumn("path", F.col("key")).where((present(F.col("j.title")).isNotNull()) & tech(F.col("j.title")))
    return postings(
        e, F.col("place"), external_id=F.coalesce(F.col("j.identifier"), F.split("path", "/")[2]), title=trim(F.col("j.title")), description_html=F.col("j.description_html"), description_text=text_of(F.col("j.description_html")),
        apply_url=F.coalesce(F.col("j.url"), F.concat(F.lit("https://"), host, "path")), location_raw=F.col("j.location"), posted_at=F.col("j.date_posted"),
    )


def successfactors(pages: DataFrame, details: DataFrame | None = None) -> DataFrame:
    e = pages.select("slug", "query", "page", "url", F.posexplode(job_postings(F.col("body"))).alias("pos", "j")).where((present(F.col("j.title")).isNotNull()) & tech(F.col("j.title")))
    e = e.withColumn("key", F.coalesce("j.url", "j.identifier", "j.title"))
    e = keep_first(e, ["slug", "key"], [F.col("query"), F.col("page"), F.col("pos")])
    return postings(
        e, F.struct("query", "page", "pos"), external_id=F.coalesce("j.identifier", "key"), title=trim(F.col("j.title")), description_html=F.col("j.description_html"), description_text=text_of(F.col("j.description_html")),
        apply_url=F.coalesce("j.url", "url"), location_raw=F.col("j.location"), posted_at=F.col("j.date_posted"),
    )


Parser = Callable[..., DataFrame]
#: What a provider's list pages name, as (slug, key, place, ...): the postings that need a detail request.
LISTED: dict[str, Callable[[DataFrame], DataFrame]] = {"workable": workable_listed, "smartrecruiters": smartrecruiters_listed, "workday": workday_listed, "oracle": oracle_listed, "icims": icims_listed}
#: Providers with a parser; a company of any other is skipped.
PARSERS: dict[str, Parser] = {f.__name__: f for f in (greenhouse, lever, ashby, workable, recruitee, teamtailor, smartrecruiters, workday, oracle, eightfold, icims, successfactors)}


def all_postings(pages: dict[str, DataFrame], details: dict[str, DataFrame]) -> DataFrame:
    """The union of every provider's postings, with provider; unknown providers are skipped."""
    out = None
    for name, df in pages.items():
        if name in PARSERS:
            own = PARSERS[name](df, details.get(name)).withColumn("ats_provider", F.lit(name))
            out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no known provider among " + ", ".join(pages))
    return out
