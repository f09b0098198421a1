"""Requests of boards: which pages a provider is asked for, when that ends, what a refused answer means, and details with bounded concurrency.

A cursor is a small state machine, one for each board and, where searches don't depend on one another, each search: it yields requests, takes answers and
ends with a reason, or fails its board. ``lists`` runs one row a cursor, so that Spark spreads boards and searches over tasks; ``boards.BoardSource`` runs
one partition a cursor. Every attempt is a row of ANSWERS, and which boards were polled follows from these rows: a board with a failed cursor gives
no pages and isn't polled, so its jobs don't close. Details are asked for by what the pages list, at most a board's cap, and a refused one is a row without a body.

The transport is the caller's: ``transport(method, url, body) -> (status, text)``, which workers have to be able to import or unpickle; nothing here opens a
connection by itself. Without one, each row of the boards brings ``archive``, the recorded answers of its board, and the crawl is replayed. Answers are requests made: write
them (``landed``) before they are read twice. A lost executor's cursors are asked again, none of the others.
"""

from __future__ import annotations

import json
import re
import sys
import time
from collections import deque
from collections.abc import Callable, Generator, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vocabulary as v
from ..operators.relational import keep_first
from . import feeds
from .schemas import flat

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have the package

#: One row an attempt (kind list or detail), and one (kind end) when a cursor is over. outcome: ok; wait (told to slow down, asked again); missing (404), refused
#: (any other status), silent (no answer); of an end done or failed, with the reason.
ANSWERS = flat("provider string, slug string, kind string, query int, page int, key string, url string, attempt int, status int, outcome string, reason string, body string")
ARCHIVE = "map<string,array<struct<status:int,body:string>>>"
KEYWORDS = v.BOARD_QUERIES
SLOW_DOWN = 429


class Answer(NamedTuple):
    """status 0: nothing came back."""

    status: int
    body: str | None

    @property
    def ok(self) -> bool:
        return 200 <= self.status < 300


class Request(NamedTuple):
    query: int
    page: int
    url: str
    method: str = "GET"
    body: str | None = None

    @property
    def address(self) -> str:
        """What an archive knows it by."""
        return f"{self.url} {self.body}" if self.body else self.url


class Failed(Exception):
    """The board can't be told from an empty one, so it isn't read at all."""


Transport = Callable[[str, str, "str | None"], tuple[int, "str | None"]]
Cursor = Generator[Request, Answer, str]


@dataclass(frozen=True)
class Manners:
    """How a task asks: seconds between requests, attempts where a provider is known to say 429, the first pause after it (doubled each time), and the
    seconds of such pauses that the requests of one cursor, or the details of one task, share."""

    pause: float = 0.15
    attempts: int = 3
    wait: float = 0.5
    patience: float = 60.0
    workers: int = 4


#: Providers that say 429 under load and are asked again.
PATIENT = {"workable", "smartrecruiters", "workday"}


def expect(answer: Answer) -> Answer:
    if not answer.ok:
        raise Failed(f"HTTP {answer.status}" if answer.status else "no answer")
    return answer


def parsed(answer: Answer) -> dict:
    try:
        found = json.loads(expect(answer).body or "")
    except ValueError:
        raise Failed("the answer is no JSON") from None
    return found if isinstance(found, dict) else {}


def parts(slug: str, n: int, what: str) -> list[str]:
    own = slug.split(":")
    if len(own) < n or not all(own[:n]):
        raise Failed(f"slug must be {what}, got {slug}")
    return own


@dataclass(frozen=True)
class Paged:
    """A list in pages of ``size`` entries under ``field``, ``limit`` entries deep. ``ask(slug, word, offset, size)`` gives method, url and body."""

    ask: Callable[[str, str, int, int], tuple[str, str, str | None]]
    field: str
    size: int
    limit: int
    total: str | None = None
    words: tuple[str, ...] = ("",)

    def cursor(self, slug: str, k: int) -> Cursor:
        """Over when a page is short, when as many entries as the board says it has were met (a board that doesn't say has no more), or at the limit."""
        met = 0
        for page, offset in enumerate(range(0, self.limit, self.size)):
            method, url, body = self.ask(slug, self.words[k], offset, self.size)
            found = parsed((yield Request(k, page, url, method, body)))
            n = len(found.get(self.field) or [])
            met += n
            if n < self.size:
                return "short page"
            if self.total and met >= (met if found.get(self.total) is None else found[self.total]):
                return "total met"
        return "limit"


def whole(urls: Callable[[str], list[str]]) -> Callable[[str, int], Cursor]:
    """A board in one answer; where it isn't at the first address (404), the next is tried."""

    def cursor(slug: str, k: int) -> Cursor:
        answer = Answer(0, None)
        for page, url in enumerate(urls(slug)):
            answer = yield Request(0, page, url)
            if answer.status != 404:
                break
        expect(answer)
        return "whole"

    return cursor


def linked(slug: str, k: int) -> Cursor:
    """Search pages, until one names no link that wasn't met in this or an earlier search. A later page that is refused is past the end."""
    host = slug if "." in slug else f"{slug}.icims.com"
    met: set[str] = set()
    for query, word in enumerate(KEYWORDS):
        for page in range(2):
            answer = yield Request(query, page, f"https://{host}/jobs/search?ss=1&searchRelation=keyword_all&searchKeyword={quote(word)}&pr={page}")
            if page and answer.status and not answer.ok:
                break
            before = len(met)
            met.update(m[0] for m in re.finditer(feeds.LINK, expect(answer).body or ""))
            if len(met) == before:
                break
    return "searched"


_BLOCK = re.compile(r"""<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""", re.I | re.S)
_TECH = re.compile(v.TECH_TITLE, re.I | re.A)


def names_technical(html: str) -> bool:
    """Whether a page holds a job posting with a technical title."""
    for block in _BLOCK.findall(html):
        try:
            found = json.loads(block.strip())
        except ValueError:
            continue
        graph = found.get("@graph") if isinstance(found, dict) else None
        for node in found if isinstance(found, list) else graph if isinstance(graph, list) else [found]:
            if not isinstance(node, dict):
                continue
            kind = node.get("@type")
            kinds = kind if isinstance(kind, list) else [kind]
            title = node.get("title")
            if any(isinstance(t, str) and "JobPosting" in t for t in kinds) and isinstance(title, str) and _TECH.search(title):
                return True
    return False


def shaped(slug: str, k: int) -> Cursor:
    """Two shapes of one search: the second is tried while nothing technical was met at all. A board fails only if no request of it was answered."""
    host, company = parts(slug, 2, "host:company")[:2]
    answered = met = False
    for query, word in enumerate(KEYWORDS):
        shapes = (f"search/?q={quote(word)}&company={quote(company)}", f"careersection/2/jobsearch.ftl?company={quote(company)}&searchText={quote(word)}")
        for page, shape in enumerate(shapes):
            answer = yield Request(query, page, f"https://{host}/{shape}")
            if answer.ok:
                answered = True
                met = met or names_technical(answer.body or "")
                if met:
                    break
    if not answered:
        raise Failed("no request was answered")
    return "searched"


def _ask_smartrecruiters(slug: str, word: str, offset: int, size: int):
    return "GET", f"https://api.smartrecruiters.com/v1/companies/{slug}/postings?limit={size}&offset={offset}", None


def _ask_workday(slug: str, word: str, offset: int, size: int):
    tenant, dc, site = parts(slug, 3, "tenant:dc:site")[:3]
    body = json.dumps({"appliedFacets": {}, "limit": size, "offset": offset, "searchText": word}, separators=(",", ":"))
    return "POST", f"https://{tenant}.{dc}.myworkdayjobs.com/wday/cxs/{tenant}/{site}/jobs", body


def _ask_oracle(slug: str, word: str, offset: int, size: int):
    host, site = parts(slug, 2, "host:site")[:2]
    finder = f"findReqs;siteNumber={site},limit={size},sortBy=POSTING_DATES_DESC,keyword={quote(word)}"
    return "GET", f"https://{host}/hcmRestApi/resources/latest/recruitingCEJobRequisitions?onlyData=true&expand=requisitionList.secondaryLocations&finder={finder}", None


def _ask_eightfold(slug: str, word: str, offset: int, size: int):
    host, domain = parts(slug, 2, "host:domain")[:2]
    return "GET", f"https://{host}/api/apply/v2/jobs?domain={quote(domain)}&query={quote(word)}&start={offset}&num={size}&sort_by=relevance", None


#: Sizes and depths of pages are the providers'.
PAGED = {
    "smartrecruiters": Paged(_ask_smartrecruiters, "content", 100, 3000, "totalFound"),
    "workday": Paged(_ask_workday, "jobPostings", 20, 80, words=tuple(KEYWORDS)),
    "oracle": Paged(_ask_oracle, "items", 100, 100, words=tuple(KEYWORDS)),
    "eightfold": Paged(_ask_eightfold, "positions", 50, 150, words=tuple(KEYWORDS)),
}
WHOLE: dict[str, Callable[[str, int], Cursor]] = {
    "greenhouse": whole(lambda s: [f"https://boards-api.{region}greenhouse.io/v1/boards/{s}/jobs?content=true" for region in ("", "eu.")]),
    "lever": whole(lambda s: [f"https://api.lever.co/v0/postings/{s}?mode=json"]),
    "ashby": whole(lambda s: [f"https://api.ashbyhq.com/posting-api/job-board/{s}?includeCompensation=true"]),
    "workable": whole(lambda s: [f"https://www.workable.com/api/accounts/{s}"]),
    "recruitee": whole(lambda s: [f"https://{s}.recruitee.com/api/offers/"]),
    "teamtailor": whole(lambda s: [f"https://{s}.teamtailor.com/jobs.json"]),
    "icims": linked,
    "successfactors": shaped,
}


def cursor_of(provider: str, slug: str, k: int, paged: dict[str, Paged]) -> Cursor:
    return paged[provider].cursor(slug, k) if provider in paged else WHOLE[provider](slug, k)


def attempts(request: Request, transport: Transport, tries: int, manners: Manners, budget: list[float], sleep: Callable[[float], None]) -> Iterator[tuple[int, Answer, str]]:
    """(attempt, answer, outcome) until an answer stands. Told to slow down it waits, twice as long each time, as long as tries and the shared budget of seconds last."""
    for n in range(tries):
        try:
            answer = Answer(*transport(request.method, request.url, request.body))
        except Exception:  # whatever a transport raises: nothing came back
            answer = Answer(0, None)
        wait = manners.wait * 2**n
        if answer.status == SLOW_DOWN and n + 1 < tries and budget[0] >= wait:
            budget[0] -= wait
            yield n, answer, "wait"
            sleep(wait)
            continue
        yield n, answer, "ok" if answer.ok else "missing" if answer.status == 404 else "refused" if answer.status else "silent"
        return


def driven(provider: str, slug: str, k: int, transport: Transport, manners: Manners, paged: dict[str, Paged] = PAGED, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """The rows of ANSWERS of one cursor, its end last."""
    row = lambda kind, q, page, url, n, status, outcome, reason, body: (provider, slug, kind, q, page, None, url, n, status, outcome, reason, body)
    budget, answer, cursor = [manners.patience], None, cursor_of(provider, slug, k, paged)
    try:
        while True:
            if answer is not None and manners.pause:
                sleep(manners.pause)
            request = cursor.send(answer)
            for n, answer, outcome in attempts(request, transport, manners.attempts if provider in PATIENT else 1, manners, budget, sleep):
                yield row("list", request.query, request.page, request.url, n, answer.status, outcome, None, answer.body if answer.ok else None)
    except StopIteration as end:
        yield row("end", k, None, None, None, None, "done", end.value, None)
    except Failed as why:
        yield row("end", k, None, None, None, None, "failed", str(why), None)


def replay(archive: list | dict | None) -> Transport:
    """A transport that answers from recorded answers: an address gives its answers in turn, the last one again; an unknown one none."""
    known = dict(archive or {})
    asked: dict[str, int] = {}

    def transport(method: str, url: str, body: str | None) -> tuple[int, str | None]:
        address = Request(0, 0, url, method, body).address
        own = known.get(address)
        if not own:
            return 0, None
        n = asked[address] = asked.get(address, -1) + 1
        got = own[min(n, len(own) - 1)]
        return got["status"], got["body"]

    return transport


def pooled(items: Iterable, do: Callable, workers: int) -> Iterator:
    """``do`` of each item, in the order of the items, with at most ``workers`` under way and none begun before one of them was taken."""
    with ThreadPoolExecutor(workers) as pool:
        under_way: deque = deque()
        for item in items:
            if len(under_way) == workers:
                yield under_way.popleft().result()
            under_way.append(pool.submit(do, item))
        while under_way:
            yield under_way.popleft().result()


_ARROW = pa.schema([(f.name, pa.int32() if f.dataType.typeName() == "integer" else pa.string()) for f in ANSWERS])
ROWS = 200  # handed on at once


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def cursors(boards: DataFrame, paged: dict[str, Paged] = PAGED) -> DataFrame:
    """One row a cursor, its number as ``k``; boards of unknown providers are skipped."""
    n = F.lit(None).cast("int")
    for name in WHOLE:
        n = F.when(F.col("provider") == name, 1).otherwise(n)
    for name, spec in paged.items():
        n = F.when(F.col("provider") == name, len(spec.words)).otherwise(n)
    return boards.where(n.isNotNull()).withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))


def lists(boards: DataFrame, transport: Transport | None = None, manners: Manners = Manners(), paged: dict[str, Paged] = PAGED, tasks: int | None = None) -> DataFrame:  # noqa: B008
    """ANSWERS of the boards (provider, slug), each once; without a transport from their ``archive``. Boards and searches are dealt to ``tasks`` tasks, each of which asks one thing at a time."""
    cols = ["provider", "slug", "k"] + (["archive"] if transport is None else [])
    tasks = tasks or int(boards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    calm = manners if transport else Manners(0, manners.attempts, 0, manners.patience, manners.workers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield from driven(r["provider"], r["slug"], r["k"], transport or replay(r["archive"]), calm, paged)

        yield from _batches(rows())

    return cursors(boards, paged).repartition(tasks, "provider", "slug", "k").select(cols).mapInArrow(run, ANSWERS)


def by_address(recorded: DataFrame) -> DataFrame:
    """(provider, slug, address, a): an address's answers in the order of their turns."""
    each = recorded.groupBy("provider", "slug", "address").agg(F.array_sort(F.collect_list(F.struct("turn", "status", "body"))).alias("a"))
    return each.withColumn("a", F.transform("a", lambda x: F.struct(x["status"].cast("int").alias("status"), x["body"].alias("body"))))


def archived(recorded: DataFrame) -> DataFrame:
    """(provider, slug, archive) from recorded answers (provider, slug, address, turn, status, body) to the requests of ``lists``, whose number a provider's
    pages bound; recorded details stay rows, for ``details``."""
    return by_address(recorded).groupBy("provider", "slug").agg(F.map_from_entries(F.collect_list(F.struct("address", "a"))).alias("archive"))


def landed(answers: DataFrame, path: str) -> DataFrame:
    """The answers, written once: what reads them makes no request."""
    answers.write.parquet(path)
    return answers.sparkSession.read.schema(ANSWERS).parquet(path)


def ended(answers: DataFrame) -> DataFrame:
    """(provider, slug, failed): every board whose cursors are over; one failed cursor fails it."""
    return answers.where("kind = 'end'").groupBy("provider", "slug").agg(F.bool_or(F.col("outcome") == "failed").alias("failed"))


def pages(answers: DataFrame, provider: str) -> DataFrame:
    """The list pages (PAGES) of a provider's boards that didn't fail; the answers are read once, a board's together."""
    own = answers.where((F.col("provider") == provider) & F.col("kind").isin("list", "end"))
    failed = F.max(F.col("outcome") == "failed").over(W.partitionBy("slug"))
    return own.withColumn("_failed", failed).where("kind = 'list' AND outcome = 'ok' AND NOT _failed").select("slug", "query", "page", "url", "body")


def polled(answers: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_id) of the poll targets whose boards were read to their ends."""
    done = ended(answers).where("NOT failed").select(F.col("provider").alias("ats_provider"), F.col("slug").alias("ats_token"))
    return targets.join(done, ["ats_provider", "ats_token"], "left_semi").select("source_id").distinct()


def _detail_url(provider: str) -> Column:
    part = lambda k: F.get(F.split("slug", ":"), F.lit(k))
    lit = lambda x: F.lit(x)
    return {
        "workable": lambda: F.concat(lit("https://apply.workable.com/api/v2/accounts/"), "slug", lit("/jobs/"), "key"),
        "smartrecruiters": lambda: F.coalesce(F.col("j.ref"), F.concat(lit("https://api.smartrecruiters.com/v1/companies/"), "slug", lit("/postings/"), "key")),
        "workday": lambda: F.concat(lit("https://"), part(0), lit("."), part(1), lit(".myworkdayjobs.com/wday/cxs/"), part(0), lit("/"), part(2), "key"),
        "oracle": lambda: F.concat(
            lit("https://"), part(0), lit("/hcmRestApi/resources/latest/recruitingCEJobRequisitionDetails?onlyData=true&expand=all&finder=ById;Id=%22"), F.url_encode("key"), lit("%22,siteNumber="), part(1)
        ),
        "icims": lambda: F.concat(lit("https://"), feeds.icims_host(), "key"),
    }[provider]()


def detail_requests(list_pages: DataFrame, provider: str) -> DataFrame:
    """(provider, slug, key, url, place): the details that a provider's pages call for, each once, within the cap of a board."""
    listed = feeds.LISTED[provider](list_pages).withColumn("_url", _detail_url(provider))
    return keep_first(listed.select("slug", "key", F.col("_url").alias("url"), "place"), ["slug", "key"], [F.col("place")]).withColumn("provider", F.lit(provider))


def details(requests: DataFrame, transport: Transport | None = None, manners: Manners = Manners(), recorded: DataFrame | None = None, tasks: int | None = None) -> DataFrame:  # noqa: B008
    """ANSWERS (kind detail) of requested details: a board's in one task, in their order, ``workers`` of them under way at once. One that is refused or silent is a row
    without a body and stops no other. recorded: (provider, slug, address, turn, status, body) to answer from instead of a transport; they stay rows, of which only
    those asked for are brought together, however many a board has."""
    tasks = tasks or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = requests
    if transport is None:
        asked = own.select("provider", "slug", F.col("url").alias("address")).distinct()
        held = recorded.join(asked, ["provider", "slug", "address"], "left_semi")
        answers = by_address(held).withColumnsRenamed({"address": "url", "a": "answers"})
        own = own.join(answers, ["provider", "slug", "url"], "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<struct<status:int,body:string>>")))
    own = own.repartition(tasks, "provider", "slug").sortWithinPartitions("provider", "slug", "place", "key").select("provider", "slug", "key", "url", *([] if transport else ["answers"]))
    calm = manners if transport else Manners(0, manners.attempts, 0, manners.patience, manners.workers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        budget = [calm.patience]

        def ask(r: dict) -> list[tuple]:
            own = transport or replay({r["url"]: r["answers"]})
            tries = calm.attempts if r["provider"] in PATIENT else 1
            got = attempts(Request(0, 0, r["url"]), own, tries, calm, budget, time.sleep)
            return [(r["provider"], r["slug"], "detail", None, None, r["key"], r["url"], n, a.status, outcome, None, a.body if a.ok else None) for n, a, outcome in got]

        every = (r for batch in batches for r in batch.to_pylist())
        yield from _batches(row for rows in pooled(every, ask, calm.workers) for row in rows)

    return own.mapInArrow(run, ANSWERS)


def detail_rows(answers: DataFrame, provider: str) -> DataFrame:
    """The details (DETAILS) of a provider that were answered."""
    return answers.where((F.col("provider") == provider) & (F.col("kind") == "detail") & (F.col("outcome") == "ok")).select("slug", "key", "url", "body")
