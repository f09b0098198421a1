"""Feed parsers on small landed answers."""

import datetime as dt
import json

import pytest

from millrace.sources import boards, feeds, jsonld, seeds
from millrace.sources.schemas import DETAILS, PAGES

UTC = dt.datetime


def pages(spark, *bodies, slug="acme"):
    return spark.createDataFrame([(slug, k, 0, f"https://s/{k}", b if isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)], PAGES)


def details(spark, *rows, slug="acme"):
    return spark.createDataFrame([(slug, k, None, b if isinstance(b, str) else json.dumps(b)) for k, b in rows], DETAILS)


def test_greenhouse(spark):
    jobs = {"jobs": [{"id": 7, "title": " A ", "location": {"name": "Paris"}, "absolute_url": "u", "content": "&lt;p&gt;x&amp;amp;y&lt;/p&gt;", "first_published": "2025-01-02T03:04:05Z"}, {"id": 8, "title": "B", "absolute_url": "v"}]}
    a, b = feeds.greenhouse(pages(spark, jobs)).orderBy("external_id").collect()
    assert (a.external_id, a.title, a.description_html, a.description_text, a.location_raw, a.posted_at) == ("7", "A", "<p>x&amp;y</p>", "x&y", "Paris", UTC(2025, 1, 2, 3, 4, 5))
    assert (b.description_html, b.description_text, b.location_raw) == (None, None, None)


def test_lever(spark):
    jobs = [{"id": "1", "text": "T", "hostedUrl": "h", "description": "<b>d</b>", "createdAt": 1700000000000, "workplaceType": "On-Site", "categories": {"location": "L", "commitment": "FT"}}, {"id": "2", "text": "no url"}]
    (r,) = feeds.lever(pages(spark, jobs)).collect()
    assert (r.apply_url, r.description_text, r.remote_type, r.employment_type, r.posted_at) == ("h", "d", "onsite", "FT", UTC(2023, 11, 14, 22, 13, 20))
    assert feeds.lever(pages(spark, {"ok": False})).collect() == []


def test_ashby(spark):
    jobs = {"jobs": [{"id": "1", "title": "T", "jobUrl": "j", "isRemote": True, "compensation": {"compensationTierSummary": "$100K - $120K"}}, {"id": "2", "title": "T", "jobUrl": "j", "isListed": False}, {"id": "3", "title": "T", "applyUrl": "a", "isListed": None, "workplaceType": "Hybrid"}]}
    a, b = feeds.ashby(pages(spark, jobs)).orderBy("external_id").collect()
    assert (a.remote_type, a.remote_hint, a.salary_min, a.salary_max, a.salary_period) == ("remote", True, 100000.0, 120000.0, "year")
    assert (b.external_id, b.remote_type, b.salary_min) == ("3", "hybrid", None)


def test_workable(spark):
    jobs = {"jobs": [{"shortcode": "X", "title": "T", "url": "u", "city": "C", "country": "", "telecommuting": True, "published_on": "2025-03-04"}, {"shortcode": "Y", "title": "T2", "shortlink": "s", "city": "C", "state": "S"}, {"shortcode": "Z", "title": "none"}]}
    d = details(spark, ("Y", {"description": "<p>a</p>", "benefits": "b", "workplace": "on_site", "location": {"city": "D", "country": "E"}}))
    x, y = feeds.workable(pages(spark, jobs), d).orderBy("external_id").collect()
    assert (x.location_raw, x.remote_type, x.description_html, x.posted_at) == ("C", "remote", None, UTC(2025, 3, 4))
    assert (y.location_raw, y.remote_type, y.description_html, y.description_text) == ("D, E", "onsite", "<p>a</p>\nb", "a\n\nb")


def test_recruitee_and_teamtailor(spark):
    offers = {"offers": [{"id": 1, "title": "T", "careers_url": "c", "city": "A", "country": "B", "hybrid": True, "published_at": "2025-12-16 22:33:14 UTC", "description": "x", "requirements": "y"}, {"id": 2, "title": "T", "careers_url": "c", "status": "draft"}]}
    (r,) = feeds.recruitee(pages(spark, offers)).collect()
    assert (r.location_raw, r.remote_type, r.posted_at, r.description_html) == ("A, B", "hybrid", UTC(2025, 12, 16, 22, 33, 14), "x\ny")
    items = {"items": [{"id": "i", "title": "T", "url": "u", "date_published": "2025-01-01T02:00:00+02:00", "_jobposting": {"jobLocation": [{"address": {"addressLocality": "L", "addressCountry": "SE"}}]}}, {"id": "j", "title": "T", "url": ""}]}
    (r,) = feeds.teamtailor(pages(spark, items)).collect()
    assert (r.location_raw, r.posted_at) == ("L, SE", UTC(2025, 1, 1))


def test_smartrecruiters(spark):
    lst = {"content": [{"id": "1", "name": "T", "location": {"city": "c", "country": "de", "fullLocation": " , Berlin,, DE"}}, {"id": "2", "name": "U", "location": {"city": "c", "country": "de"}}], "totalFound": 2}
    d = details(spark, ("1", {"jobAd": {"sections": {"qualifications": {"text": "q"}, "jobDescription": {"text": "j"}}}, "location": {"remote": True, "fullLocation": " , Berlin,, DE"}}))
    a, b = feeds.smartrecruiters(pages(spark, lst), d).orderBy("external_id").collect()
    assert (a.description_html, a.location_raw, a.remote_type, a.remote_hint) == ("j\nq", "Berlin, DE", "remote", True)
    assert (b.location_raw, b.remote_type, b.remote_hint, b.apply_url) == ("c, DE", "onsite", False, "https://jobs.smartrecruiters.com/acme/2")


def test_workday(spark):
    one = {"jobPostings": [{"title": "Data Engineer", "externalPath": "/a", "locationsText": "first"}, {"title": "Cook", "externalPath": "/b"}, {"title": "no path"}]}
    two = {"jobPostings": [{"title": "ML Engineer", "externalPath": "/a", "locationsText": "last"}, {"title": "AI Dev", "externalPath": "/c", "bulletFields": ["R1"]}]}
    d = details(spark, ("/c", {"jobPostingInfo": {"jobDescription": "<p>x</p>", "startDate": "2025-02-03", "jobReqId": "Q"}}), slug="t:wd1:site")
    a, c = feeds.workday(pages(spark, one, two, slug="t:wd1:site"), d).orderBy("external_id").collect()
    assert (a.external_id, a.title, a.location_raw, a.apply_url) == ("/a", "ML Engineer", "last", "https://t.wd1.myworkdayjobs.com/site/a")
    assert (c.external_id, c.description_text, c.posted_at) == ("R1", "x", UTC(2025, 2, 3))
    with pytest.raises(Exception, match="slug must be"):
        feeds.workday(pages(spark, one, slug="bad"), d).collect()


def test_oracle_and_eightfold(spark):
    reqs = {"items": [{"requisitionList": [{"Id": "9", "Title": "Data Scientist", "secondaryLocations": [{"Name": "A"}, {"Name": ""}, {"Name": "B"}]}, {"Id": "8", "Title": "Cook"}]}]}
    d = details(spark, ("9", {"items": [{"ExternalDescriptionStr": "<b>d</b>", "ExternalQualificationsStr": "q", "PostedDate": "2025-01-05"}]}), slug="h:s")
    (r,) = feeds.oracle(pages(spark, reqs, reqs, slug="h:s"), d).collect()
    assert (r.location_raw, r.description_html, r.posted_at, r.apply_url) == ("A; B", "<b>d</b>\nq", UTC(2025, 1, 5), "https://h/hcmUI/CandidateExperience/en/sites/s/job/9")
    pos = {"positions": [{"id": 5, "name": "ML Engineer", "locations": ["A", "B"], "t_create": 1700000000, "t_update": 0, "work_location_option": "OnSite"}, {"id": "6", "name": "Chef"}]}
    (r,) = feeds.eightfold(pages(spark, pos, slug="h:d"), None).collect()
    assert (r.external_id, r.location_raw, r.updated_at, r.remote_type, r.apply_url) == ("5", "A; B", None, "onsite", "https://h/careers/job/5")


LD = '<script type="application/ld+json">{}</script>'


def test_json_ld(spark):
    page = LD.format("{bad") + LD.format(json.dumps([{"@type": "Thing"}, {"@type": ["X", "JobPosting"], "title": " T ", "datePosted": "2025-01-01", "jobLocation": [{"address": {"addressLocality": "L", "addressRegion": "L", "addressCountry": "DE"}}], "identifier": {"value": 12}}]))
    page += LD.format(json.dumps({"@graph": [{"@type": "JobPosting", "title": 5, "jobLocation": {"address": "Somewhere"}, "identifier": "id", "url": "u", "datePosted": "soon"}]}))
    rows = spark.createDataFrame([(page,), (None,), ("<p>",)], "h string")
    got = [r.x for r in rows.select(jsonld.job_postings(rows.h).alias("x")).collect()]
    assert got[1:] == [[], []]
    a, b = got[0]
    assert (a.title, a.location, a.identifier, a.date_posted) == ("T", "L, DE", "12", UTC(2025, 1, 1))
    assert (b.title, b.location, b.identifier, b.url, b.date_posted) == (None, "Somewhere", "id", "u", None)


def test_icims_and_successfactors(spark):
    listing = '<a href="/jobs/12/data-engineer/job">x</a><a href="/jobs/13/cook/job">y</a><a href="/jobs/12/data-engineer/job">z</a><a href="/jobs/14/gone/job">'
    post = lambda t, **k: LD.format(json.dumps({"@type": "JobPosting", "title": t, "description": "<p>d</p>", **k}))
    d = details(spark, ("/jobs/12/data-engineer/job", post("Data Engineer")), ("/jobs/13/cook/job", post("Cook")))
    (r,) = feeds.icims(pages(spark, listing), d).collect()
    assert (r.external_id, r.apply_url, r.description_text) == ("12", "https://acme.icims.com/jobs/12/data-engineer/job", "d")
    first, again = post("ML Engineer", url="u", identifier="a"), post("ML Engineer II", url="u", identifier="b")
    (r,) = feeds.successfactors(pages(spark, first, again, slug="h:c")).collect()
    assert (r.external_id, r.title, r.apply_url) == ("a", "ML Engineer", "u")


def test_union_skips_unknown_providers(spark):
    jobs = {"jobs": [{"id": 7, "title": "A", "absolute_url": "u"}]}
    got = feeds.all_postings({"greenhouse": pages(spark, jobs), "personio": pages(spark, jobs)}, {}).collect()
    assert [r.ats_provider for r in got] == ["greenhouse"]


def test_seeds(spark, tmp_path):
    (tmp_path / "s.csv").write_text("# list\n\n A , greenhouse, acme ,a.com,late\r\nB,nowhere,b\nC,workday,T:wd1:S,,early\nD,lever\n")
    companies, sources = seeds.seeded(seeds.read_seeds(spark, str(tmp_path / "s.csv")))
    got = {r.id: r for r in companies.collect()}
    assert set(got) == {"c_acme", "c_t-wd1-s"} and got["c_acme"].domain == "a.com" and got["c_t-wd1-s"].domain is None and got["c_t-wd1-s"].ats_token == "T:wd1:S"
    urls = {r.id: r.endpoint_url for r in sources.collect()}
    assert urls["c_t-wd1-s_workday"] == "https://T.wd1.myworkdayjobs.com/wday/cxs/T/S/jobs"


def test_fx(spark):
    good = seeds.fx_rates(spark, '{"result": "success", "rates": {"GBP": 0.8, "EUR": 0}}')
    assert good["GBP"] == 1.25 and good["EUR"] == 1.08 and good["USD"] == 1.0 and len(good) == 9
    assert seeds.fx_rates(spark, None)["SEK"] == 0.095 and seeds.fx_rates(spark, '{"result": "no"}')["INR"] == 0.012


def test_board_source_reads_through_spark(spark):
    spark.dataSource.register(boards.BoardSource)
    body = json.dumps({"jobs": [{"id": 7, "title": "A", "absolute_url": "u"}]})

    def fetch(slug):
        yield slug, 0, 0, f"https://{slug}", body

    read = spark.read.format("boards").option("slugs", "acme,beta").option("pause", "0").option("fetcher", boards.pickled(fetch)).load()
    assert sorted((r.slug, r.url) for r in read.collect()) == [("acme", "https://acme"), ("beta", "https://beta")]
    assert sorted(r.slug for r in feeds.greenhouse(read).collect()) == ["acme", "beta"]
    assert boards.fetcher("json:dumps") is json.dumps


def test_board_source_retries():
    calls = []

    def fetch(slug):
        calls.append(slug)
        if len(calls) < 3:
            raise boards.TooManyRequests
        yield (slug, 0, 0, "u", "{}")

    assert boards.retried(fetch, "a", pause=0) == [("a", 0, 0, "u", "{}")] and len(calls) == 3
    reader = boards.BoardReader(["a", "b"], lambda s: iter([(s, 0, 0, "u", "{}")]), 0)
    assert [r for p in reader.partitions() for r in reader.read(p)] == [("a", 0, 0, "u", "{}"), ("b", 0, 0, "u", "{}")]
