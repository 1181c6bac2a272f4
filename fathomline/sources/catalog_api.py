"""A catalog's paged Atom interface as a Spark source, batch and stream.

``spark.dataSource.register(AtomCatalog)``, then ``spark.read.format("atom_catalog")`` with the options ``endpoint``, ``category``, ``from``, ``to`` (days, both included) and, if wanted,
``pageSize`` (250) and ``delay`` (3.1 seconds). A row is one entry, whole, as its feed has it: (segment, nth, total, value); :func:`fathomline.sources.files.catalog_entries` takes it apart.

Each calendar month of the range is a partition and is paged by itself in ascending order of submission. The source asks for ``delay`` seconds between requests, whoever makes them: with n
partitions each keeps n times that distance and begins by its number, so that all together keep to it however Spark places them. Answers 429 and 5xx are asked for again, three times in all, after
a pause that grows or that the answer names.

As a stream every micro-batch takes one page; the offset is (segment, start), so that a query goes on where its checkpoint says, and a batch that is run again reads the same page."""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.parse
import urllib.request
from calendar import monthrange
from collections.abc import Callable, Iterator
from datetime import date

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "segment string, nth long, total long, value string"
# Answers that are asked for again, and how often.
RETRIED = (429, 500, 502, 503, 504)
TRIES = 3
LONGEST_PAUSE = 60.0


def segments(start: date, end: date) -> list[tuple[date, date]]:
    """The calendar months of a range, cut at its ends."""
    out, at = [], start
    while at <= end:
        last = date(at.year, at.month, monthrange(at.year, at.month)[1])
        out.append((at, min(last, end)))
        at = date.fromordinal(last.toordinal() + 1)
    return out


class Paced:
    """Requests that keep a distance in time and are repeated where the service asks for patience."""

    def __init__(self, delay: float, first_after: float = 0.0, *, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.delay, self.now, self.sleep = delay, now, sleep
        self.next = now() + first_after

    def _wait(self, seconds: float | None = None) -> None:
        pause = self.next - self.now() if seconds is None else seconds
        if pause > 0:
            self.sleep(pause)
        self.next = self.now() + self.delay

    def get(self, url: str, timeout: float = 60.0) -> bytes:
        for attempt in range(1, TRIES + 1):
            self._wait()
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "fathomline"}), timeout=timeout) as answer:
                    return answer.read()
            except urllib.error.HTTPError as error:
                if error.code not in RETRIED or attempt == TRIES:
                    raise
                told = error.headers.get("Retry-After", "")
                self.next = self.now() + max(self.delay * attempt, min(float(told), LONGEST_PAUSE) if re.fullmatch(r"[0-9.]+", told) else 0.0)
            except urllib.error.URLError:
                if attempt == TRIES:
                    raise
                self.next = self.now() + self.delay * attempt
        raise AssertionError("a last attempt returns or raises")


def page_url(endpoint: str, category: str, start: date, end: date, at: int, size: int) -> str:
    search = f"cat:{category} AND submittedDate:[{start:%Y%m%d}0000 TO {end:%Y%m%d}2359]"
    return f"{endpoint}?{urllib.parse.urlencode({'search_query': search, 'start': at, 'max_results': size, 'sortBy': 'submittedDate', 'sortOrder': 'ascending'})}"


def entries(feed: str) -> tuple[list[str], int]:
    """The entries of a page as they stand there, and how many the whole search has."""
    total = re.search(r"<(?:\w+:)?totalResults\b[^>]*>\s*(\d+)\s*<", feed)
    own = re.findall(r"<entry\b.*?</entry>", feed, re.S)
    return own, int(total[1]) if total else len(own)


class _Settings:
    def __init__(self, options) -> None:
        self.endpoint, self.category = options["endpoint"], options["category"]
        self.segments = segments(date.fromisoformat(options["from"]), date.fromisoformat(options["to"]))
        self.size, self.delay = int(options.get("pageSize", 250)), float(options.get("delay", 3.1))
        if not 1 <= self.size <= 1000:
            raise ValueError("page size must be between 1 and 1000")

    def page(self, paced: Paced, segment: int, at: int) -> tuple[list[tuple], int]:
        """Rows of a page, and the total of its segment."""
        start, end = self.segments[segment]
        own, total = entries(paced.get(page_url(self.endpoint, self.category, start, end, at, self.size)).decode("utf-8", "replace"))
        return [(f"{start}", at + k, total, x) for k, x in enumerate(own)], total


class _Month(InputPartition):
    def __init__(self, number: int, count: int) -> None:
        super().__init__(number)
        self.number, self.count = number, count


class _Reader(DataSourceReader):
    def __init__(self, settings: _Settings) -> None:
        self.settings = settings

    def partitions(self) -> list[_Month]:
        return [_Month(k, len(self.settings.segments)) for k in range(len(self.settings.segments))]

    def read(self, partition: _Month) -> Iterator[tuple]:
        own = self.settings
        paced = Paced(own.delay * partition.count, own.delay * partition.number)
        at, total = 0, None
        while total is None or at < total:
            rows, total = own.page(paced, partition.number, at)
            yield from rows
            if not rows:  # fewer than were promised
                return
            at += len(rows)


class _StreamReader(SimpleDataSourceStreamReader):
    def __init__(self, settings: _Settings) -> None:
        self.settings, self.paced = settings, Paced(settings.delay)

    def initialOffset(self) -> dict:
        return {"segment": 0, "start": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        segment, at = start["segment"], start["start"]
        while segment < len(self.settings.segments):
            rows, total = self.settings.page(self.paced, segment, at)
            if rows:
                at += len(rows)
                return iter(rows), {"segment": segment, "start": at} if at < total else {"segment": segment + 1, "start": 0}
            segment, at = segment + 1, 0
        return iter([]), {"segment": segment, "start": 0}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The page again; what the service holds by now beyond ``end`` is left for the next batch."""
        rows, _ = self.settings.page(self.paced, start["segment"], start["start"])
        return iter(rows if end["segment"] != start["segment"] else rows[: end["start"] - start["start"]])

    def commit(self, end: dict) -> None:
        pass


class AtomCatalog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "atom_catalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(_Settings(self.options))

    def simpleStreamReader(self, schema) -> _StreamReader:
        return _StreamReader(_Settings(self.options))


class AtomClient:
    """``page(config, cursor, size)`` for :class:`fathomline.plans.ingestion.Ingestion`: one page of catalog rows at the configured pace."""

    def __init__(self, spark, endpoint: str) -> None:
        self.spark, self.endpoint, self.paced = spark, endpoint, None

    def page(self, config, cursor: int, size: int) -> tuple[list[dict], int]:
        from fathomline.sources.files import catalog_entries

        if self.paced is None or self.paced.delay != config.delay:
            self.paced = Paced(config.delay)
        url = page_url(self.endpoint, config.category, date.fromisoformat(config.start), date.fromisoformat(config.end), cursor, size)
        own, total = entries(self.paced.get(url).decode("utf-8", "replace"))
        # a page is at most a thousand entries
        rows = catalog_entries(self.spark.createDataFrame([(x,) for x in own], "value string")).collect() if own else []
        return [r.asDict() for r in rows], total

    def download(self, url: str) -> bytes:
        """A PDF; where a version isn't there, the paper without one."""
        paced = self.paced or Paced(3.1)
        try:
            content = paced.get(url, timeout=120)
        except urllib.error.HTTPError as error:
            bare = re.sub(r"v\d+(?=(?:\.pdf)?$)", "", url)
            if error.code != 404 or bare == url:
                raise
            content = paced.get(bare, timeout=120)
        if not content.startswith(b"%PDF"):
            raise RuntimeError("the source returned something that is no PDF")
        return content
