"""Cursors, retries, bounded details and replayed crawls on small boards."""

import datetime as dt
import json
import threading
import time

import pytest

from millrace.plans import ingest
from millrace.sources import boards, crawl, feeds
from millrace.sources.schemas import JOB_SKILLS, JOBS, PAGES

CALM = crawl.Manners(pause=0, wait=0)


def transport_of(answers):
    """Answers by address, in turn; also what was asked."""
    asked = []
    play = crawl.replay({a: [{"status": s, "body": b if b is None or isinstance(b, str) else json.dumps(b)} for s, b in own] for a, own in answers.items()})

    def transport(method, url, body):
        asked.append(f"{url} {body}" if body else url)
        return play(method, url, body)

    return transport, asked


def drive(provider, slug, answers, k=0, paged=crawl.PAGED, manners=CALM):
    transport, asked = transport_of(answers)
    rows = list(crawl.driven(provider, slug, k, transport, manners, paged, sleep=lambda s: None))
    return [(r[9], r[8]) for r in rows if r[2] == "list"], rows[-1][9:11], asked


SR = "https://api.smartrecruiters.com/v1/companies/b/postings?limit=100&offset={}"


def content(n, total=None):
    return {"content": [{"id": str(k)} for k in range(n)], **({} if total is None else {"totalFound": total})}


def test_paged_cursors_stop_for_their_reasons():
    at = SR.format
    assert drive("smartrecruiters", "b", {at(0): [(200, content(99, 500))]})[1] == ("done", "short page")
    assert drive("smartrecruiters", "b", {at(0): [(200, content(100, 200))], at(100): [(200, content(100, 200))]})[1] == ("done", "total met")
    assert drive("smartrecruiters", "b", {at(0): [(200, content(100))]})[1] == ("done", "total met")
    tries, end, asked = drive("smartrecruiters", "b", {at(k): [(200, content(100, 10**6))] for k in range(0, 3100, 100)})
    assert end == ("done", "limit") and len(asked) == 30 and asked[-1] == at(2900)
    tries, end, asked = drive("smartrecruiters", "b", {at(0): [(200, content(100, 300))], at(100): [(500, None)]})
    assert tries == [("ok", 200), ("refused", 500)] and end == ("failed", "HTTP 500")
    assert drive("smartrecruiters", "b", {at(0): [(200, "<html>")]})[1] == ("failed", "the answer is no JSON")
    assert drive("smartrecruiters", "b", {})[1] == ("failed", "no answer")
    assert drive("workday", "no parts", {})[1][0] == "failed"


def test_keyword_searches_post_their_offsets():
    post = lambda off, word: f'https://t.dc.myworkdayjobs.com/wday/cxs/t/s/jobs {{"appliedFacets":{{}},"limit":20,"offset":{off},"searchText":"{word}"}}'
    jobs = {"jobPostings": [{"externalPath": "/x"}] * 20}
    tries, end, asked = drive("workday", "t:dc:s", {post(o, "llm"): [(200, jobs)] for o in (0, 20, 40, 60, 80)}, k=2)
    assert end == ("done", "limit") and asked == [post(o, "llm") for o in (0, 20, 40, 60)]
    assert drive("workday", "t:dc:s", {post(0, "machine learning"): [(200, {})]})[1] == ("done", "short page")


def test_second_host_on_404_only():
    us, eu = ("https://boards-api.{}greenhouse.io/v1/boards/b/jobs?content=true".format(r) for r in ("", "eu."))
    assert drive("greenhouse", "b", {us: [(404, None)], eu: [(200, {})]})[:2] == ([("missing", 404), ("ok", 200)], ("done", "whole"))
    assert drive("greenhouse", "b", {us: [(500, None)], eu: [(200, {})]})[1:] == (("failed", "HTTP 500"), [us])
    assert drive("greenhouse", "b", {us: [(404, None)], eu: [(404, None)]})[1] == ("failed", "HTTP 404")


def test_told_to_slow_down():
    tries, end, _ = drive("smartrecruiters", "b", {SR.format(0): [(429, None), (429, None), (200, content(1))]})
    assert tries == [("wait", 429), ("wait", 429), ("ok", 200)] and end[0] == "done"
    assert drive("smartrecruiters", "b", {SR.format(0): [(429, None)]})[:2] == ([("wait", 429), ("wait", 429), ("refused", 429)], ("failed", "HTTP 429"))
    assert drive("lever", "b", {"https://api.lever.co/v0/postings/b?mode=json": [(429, None), (200, [])]})[1] == ("failed", "HTTP 429")
    waits = []
    transport, asked = transport_of({SR.format(0): [(429, None), (200, content(100, 300))], SR.format(100): [(429, None), (429, None), (200, content(1))]})
    rows = list(crawl.driven("smartrecruiters", "b", 0, transport, crawl.Manners(pause=0, wait=1, patience=1.5), sleep=waits.append))
    assert waits == [1] and rows[-1][9:11] == ("failed", "HTTP 429")  # the second pause would outlast what is left of the budget


def test_searches_end_where_nothing_is_new():
    at = lambda w, p: f"https://b.icims.com/jobs/search?ss=1&searchRelation=keyword_all&searchKeyword={w}&pr={p}"
    page = lambda *ids: (200, "".join(f'<a href="/jobs/{i}/x/job">' for i in ids))
    ml, gen, llm = "machine%20learning", "generative%20ai", "llm"
    answers = {at(ml, 0): [page(1, 2)], at(ml, 1): [page(3)], at(gen, 0): [page(2, 1)], at(llm, 0): [page(4)], at(llm, 1): [(404, None)]}
    tries, end, asked = drive("icims", "b", answers)
    assert end == ("done", "searched") and asked == [at(ml, 0), at(ml, 1), at(gen, 0), at(llm, 0), at(llm, 1)]
    assert drive("icims", "b", {**answers, at(gen, 0): [(503, None)]})[1] == ("failed", "HTTP 503")
    assert drive("icims", "b", {k: a for k, a in answers.items() if k != at(ml, 1)})[1] == ("failed", "no answer")


def test_a_board_fails_only_if_no_shape_answered():
    at = lambda w: (f"https://h/search/?q={w}&company=c", f"https://h/careersection/2/jobsearch.ftl?company=c&searchText={w}")
    words = ("machine%20learning", "generative%20ai", "llm")
    found = '<script type="application/ld+json">{"@graph": [{"@type": ["JobPosting"], "title": "Data Engineer"}]}</script>'
    assert drive("successfactors", "h:c", {})[1] == ("failed", "no request was answered")
    tries, end, asked = drive("successfactors", "h:c", {at(words[0])[0]: [(200, "")], at(words[0])[1]: [(200, found)], at(words[1])[0]: [(200, "")], at(words[2])[0]: [(404, None)]})
    assert end == ("done", "searched") and asked == [*at(words[0]), at(words[1])[0], *at(words[2])]
    assert not crawl.names_technical(found.replace("Data Engineer", "Cook")) and not crawl.names_technical('<script type="application/ld+json">{bad</script>')


def test_pooled_keeps_order_and_bounds_what_is_under_way():
    lock, now, most, begun = threading.Lock(), [0], [0], []

    def do(k):
        with lock:
            begun.append(k)
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02 if k % 3 else 0.05)
        with lock:
            now[0] -= 1
        return k * 10

    taken = []
    for x in crawl.pooled(iter(range(20)), do, 4):
        taken.append(x)
        assert len(begun) <= len(taken) + 4
    assert taken == [k * 10 for k in range(20)] and most[0] == 4


def test_details_are_capped_across_partitions_and_fail_alone(spark):
    pages = spark.createDataFrame(
        [("t:dc:s", q, p, "u", json.dumps({"jobPostings": [{"title": "Data Engineer", "externalPath": f"/job/{q}-{p}-{k}"} for k in range(20)]})) for q in range(3) for p in range(2)], PAGES
    ).repartition(7)
    wanted = crawl.detail_requests(pages, "workday")
    assert wanted.count() == feeds.DETAIL_CAP and {r.key for r in wanted.collect()} == {f"/job/{n // 40}-{n // 20 % 2}-{n % 20}" for n in range(50)}

    def transport(method, url, body):
        if url.endswith("7"):
            raise OSError
        return (404, None) if url.endswith("8") else (200, json.dumps({"jobPostingInfo": {"location": url[-1]}}))

    got = crawl.details(wanted, transport, CALM).collect()
    assert len(got) == 50 and {r.outcome for r in got if r.key.endswith("7")} == {"silent"} and {r.outcome for r in got if r.key.endswith("8")} == {"missing"}
    rows = feeds.workday(pages, crawl.detail_rows(crawl.details(wanted, transport, CALM), "workday")).collect()
    assert len(rows) == 50 and {r.location_raw for r in rows if r.external_id.endswith("7")} == {None} and {r.location_raw for r in rows if r.external_id.endswith("-3")} == {"3"}


def test_replay_in_tasks_and_what_was_polled(spark, tmp_path):
    a, b = "https://api.lever.co/v0/postings/{}?mode=json".format("a"), "https://api.lever.co/v0/postings/b?mode=json"
    recorded = spark.createDataFrame([("lever", "a", a, 0, 200, "[]"), ("lever", "b", b, 0, 500, None), ("other", "c", "x", 0, 200, "[]")], "provider string, slug string, address string, turn int, status int, body string")
    got = crawl.landed(crawl.lists(crawl.archived(recorded)), str(tmp_path / "answers"))
    assert sorted((r.slug, r.failed) for r in crawl.ended(got).collect()) == [("a", False), ("b", True)]
    assert [r.slug for r in crawl.pages(got, "lever").collect()] == ["a"]
    targets = spark.createDataFrame([("lever", "a", "s1"), ("lever", "b", "s2"), ("lever", "z", "s3")], "ats_provider string, ats_token string, source_id string")
    assert [r.source_id for r in crawl.polled(got, targets).collect()] == ["s1"]
    empty = crawl.lists(spark.createDataFrame([], f"provider string, slug string, archive {crawl.ARCHIVE}"))
    assert empty.collect() == [] and empty.schema == crawl.ANSWERS


def test_recorded_details_stay_rows(spark):
    """A board's recorded details are never gathered: only those asked for pass an aggregate, and their turns hold."""
    url = "https://b.icims.com/jobs/{}/x/job"
    recorded = spark.range(3000).selectExpr("'icims' AS provider", "'b' AS slug", "concat('https://b.icims.com/jobs/', id, '/x/job') AS address", "0 AS turn", "200 AS status", "concat('body ', id) AS body")
    recorded = recorded.union(spark.createDataFrame([("icims", "b", url.format(7), 1, 200, "later"), ("icims", "c", url.format(8), 0, 500, None)], "provider string, slug string, address string, turn int, status int, body string"))
    wanted = spark.createDataFrame([("icims", "b", f"/jobs/{k}/x/job", url.format(k), k) for k in (7, 2999, 4000)] + [("icims", "c", "/jobs/8/x/job", url.format(8), 1)], "provider string, slug string, key string, url string, place int")
    got = crawl.details(wanted, manners=CALM, recorded=recorded)
    assert sorted((r.slug, r.key, r.outcome, r.body) for r in got.collect()) == [
        ("b", "/jobs/2999/x/job", "ok", "body 2999"), ("b", "/jobs/4000/x/job", "silent", None), ("b", "/jobs/7/x/job", "ok", "body 7"), ("c", "/jobs/8/x/job", "refused", None)
    ]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("collect_list") < plan.index("LeftSemi") and "map_from_entries" not in plan and "mapfromentries" not in plan


def test_crawl_source_reads_through_spark(spark):
    spark.dataSource.register(boards.CrawlSource)

    def transport(method, url, body):
        return 200, json.dumps({"positions": [{"id": url, "name": "Data Engineer"}]})

    asked = json.dumps([["eightfold", "h:a"], ["eightfold", "h:b"], ["lever", "x"], ["nobody", "y"]])
    df = spark.read.format("crawl").option("boards", asked).option("pause", "0").option("transport", boards.pickled(transport)).load()
    assert df.rdd.getNumPartitions() == 7
    assert crawl.ended(df).where("NOT failed").count() == 3
    assert feeds.eightfold(crawl.pages(df, "eightfold")).count() == 6


@pytest.mark.parametrize("titles", [("AI Engineer A", "AI Engineer B"), ("AI Engineer B", "AI Engineer A")])
def test_of_postings_with_one_id_the_last_in_the_answer_stays(spark, titles):
    body = json.dumps([{"id": "1", "text": t, "hostedUrl": "u", "createdAt": 1700000000000} for t in titles])
    postings = feeds.lever(spark.createDataFrame([("acme", 0, 0, "u", body)], PAGES)).withColumn("ats_provider", feeds.F.lit("lever"))
    targets = spark.createDataFrame([("acme", "lever", "c", "s", "acme")], "ats_token string, ats_provider string, company_id string, source_id string, slug string")
    polled = spark.createDataFrame([("s",)], "source_id string")
    jobs, _, counters = ingest.run(spark.createDataFrame([], JOBS), spark.createDataFrame([], JOB_SKILLS), postings, targets, polled, feeds.F.lit(dt.datetime(2025, 1, 1)))
    assert [r.title for r in jobs.collect()] == [titles[1]]
    assert counters.first()["processed"] == 2
