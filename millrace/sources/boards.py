"""Python data sources over boards. ``BoardSource``: one partition a board, fetched by a function of the caller's; ``CrawlSource``: one partition a cursor of
sources.crawl, with a transport of the caller's.

``fetch(slug)`` yields the rows of sources.schemas.PAGES; what it raises fails the board's task after retries, so a board that
can't be read never looks empty. A crawl never fails a task: a board that can't be read is a row that says so. Nothing here opens a network connection by itself.
"""

from __future__ import annotations

import base64
import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .crawl import ANSWERS, PAGED, WHOLE, Manners, Transport, driven

Fetch = Callable[[str], Iterator[tuple]]
PICKLED = "pickle:"


def pickled(fetch: Fetch) -> str:
    """The option ``fetcher`` for a function that workers can't import, such as a closure."""
    return PICKLED + base64.b64encode(cloudpickle.dumps(fetch)).decode()


def fetcher(option: str) -> Fetch:
    """The function that an option ``fetcher`` names; the source is made in a Python worker, which shares no memory with the driver."""
    if option.startswith(PICKLED):
        return cloudpickle.loads(base64.b64decode(option[len(PICKLED) :]))
    module, _, name = option.partition(":")
    return getattr(importlib.import_module(module), name)


class TooManyRequests(Exception):
    """Raised by a fetcher that was told to slow down."""


def retried(fetch: Fetch, slug: str, attempts: int = 3, pause: float = 0.5) -> list[tuple]:
    """The rows of a board; after ``TooManyRequests`` again, with doubling pauses."""
    for k in range(attempts):
        try:
            return list(fetch(slug))
        except TooManyRequests:
            if k == attempts - 1:
                raise
            time.sleep(pause * 2**k)
    return []


class Board(InputPartition):
    def __init__(self, slug: str) -> None:
        self.slug = slug


class BoardReader(DataSourceReader):
    def __init__(self, slugs: list[str], fetch: Fetch, pause: float) -> None:
        self.slugs, self.fetch, self.pause = slugs, fetch, pause

    def partitions(self) -> list[Board]:
        return [Board(s) for s in self.slugs]

    def read(self, partition: Board) -> Iterator[tuple]:
        yield from retried(self.fetch, partition.slug, pause=self.pause)


class BoardSource(DataSource):
    """Options: slugs (comma-separated), fetcher (``module:function`` that workers can import, or what ``pickled`` returns), pause (seconds, default 0.5)."""

    @classmethod
    def name(cls) -> str:
        return "boards"

    def schema(self) -> str:
        return "slug string, query int, page int, url string, body string"

    def reader(self, schema) -> BoardReader:
        return BoardReader([s for s in self.options.get("slugs", "").split(",") if s], fetcher(self.options["fetcher"]), float(self.options.get("pause", 0.5)))


class Search(InputPartition):
    def __init__(self, provider: str, slug: str, k: int) -> None:
        self.provider, self.slug, self.k = provider, slug, k


class CrawlReader(DataSourceReader):
    def __init__(self, boards: list[list[str]], transport: Transport, manners: Manners) -> None:
        self.boards, self.transport, self.manners = boards, transport, manners

    def partitions(self) -> list[Search]:
        """One partition a cursor: boards of unknown providers have none, those whose searches stand alone one for each search."""
        return [Search(p, s, k) for p, s in self.boards if p in PAGED or p in WHOLE for k in range(len(PAGED[p].words) if p in PAGED else 1)]

    def read(self, partition: Search) -> Iterator[tuple]:
        yield from driven(partition.provider, partition.slug, partition.k, self.transport, self.manners)


class CrawlSource(DataSource):
    """Rows of crawl.ANSWERS. Options: boards (a JSON list of [provider, slug]), transport (``module:function`` that workers can import, or what ``pickled`` returns),
    pause, wait, patience (seconds) and attempts, as in crawl.Manners."""

    @classmethod
    def name(cls) -> str:
        return "crawl"

    def schema(self) -> StructType:
        return ANSWERS

    def reader(self, schema) -> CrawlReader:
        own = {k: kind(self.options[k]) for k, kind in (("pause", float), ("wait", float), ("patience", float), ("attempts", int)) if k in self.options}
        return CrawlReader(json.loads(self.options.get("boards", "[]")), fetcher(self.options["transport"]), Manners(**own))
