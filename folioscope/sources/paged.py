"""Paged sources as Python data sources: pages of a feed by category, pages of notes by year and status.

One partition per host by default, because a rate limit is global; ``partitions`` splits the groups where
the host allows it. Pages come through a transport: ``file:DIR`` reads saved pages (tests, replays),
``http`` fetches with the pauses of :mod:`folioscope.schemas`. A page is one row; parsing it is left to
Spark's XML and VARIANT expressions.
"""

from __future__ import annotations

import json
import re
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..schemas import BACKOFF_S, CATEGORIES, FEED_PAGE, FEED_PAUSE_S, NOTES_PAGE, NOTES_PAUSE_S, QUERY_TYPES, ROW_CAP

PAGE = "group string, start int, url string, n_items int, page string"


def feed_url(base: str, category: str, start_date: str, end_date: str, start: int = 0, size: int = FEED_PAGE) -> str:
    """A feed query of one category and date range, newest first."""
    span = f"[{start_date.replace('-', '')} TO {end_date.replace('-', '')}]"
    query = {"search_query": f"cat:{category} AND submittedDate:{span}", "start": start, "max_results": size, "sortBy": "submittedDate", "sortOrder": "descending"}
    return f"{base}?{urllib.parse.urlencode(query)}"


def feed_query_column(category: Column, start_date: Column, end_date: Column) -> Column:
    """The encoded search query as a native expression."""
    compact = [F.replace(d, F.lit("-"), F.lit("")) for d in (start_date, end_date)]
    return F.url_encode(F.concat(F.lit("cat:"), category, F.lit(" AND submittedDate:["), compact[0], F.lit(" TO "), compact[1], F.lit("]")))


def notes_url_column(flat: str, wrapped: str, host: str, year: Column, query_type: Column, offset: Column, track: Column | None = None) -> Column:
    """The notes query of a year: three address forms by year; null for an empty status before the last form."""
    y, o = year.cast("string"), offset.cast("string")

    def old(word: str) -> Column:
        return F.when(query_type != "", F.concat(F.lit(f"{flat}?invitation={host}.cc%2F"), y, F.lit(f"%2F{word}%2F-%2F"), query_type, F.lit("&offset="), o))

    tail = F.concat(F.lit("Conference"), F.when(query_type != "", F.concat(F.lit("/"), query_type)).otherwise(""))
    place = tail if track is None else F.coalesce(track, tail)
    new = F.concat(F.lit(f"{wrapped}?content.venueid={host}.cc/"), y, F.lit("/"), place, F.lit("&offset="), o)
    return F.when(year <= 2017, old("conference")).when(year <= 2023, old("Conference")).otherwise(new)


def notes_url(flat: str, wrapped: str, host: str, year: int, query_type: str = "", offset: int = 0, track: str = "") -> str | None:
    """The address that :func:`notes_url_column` gives, for one request."""
    if year >= 2024:
        return f"{wrapped}?content.venueid={host}.cc/{year}/{track or 'Conference' + ('/' + query_type if query_type else '')}&offset={offset}"
    word = "conference" if year <= 2017 else "Conference"
    return f"{flat}?invitation={host}.cc%2F{year}%2F{word}%2F-%2F{query_type}&offset={offset}" if query_type else None


def forum_url(flat: str, wrapped: str, year: int, forum: str) -> str:
    """The address of all replies to a paper."""
    return f"{wrapped if year >= 2024 else flat}?forum={urllib.parse.quote(forum, safe='')}"


class FileTransport:
    """Pages saved as ``GROUP-START`` below a folder; a missing file is an empty page. Counts what it serves."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def path(self, group: str, start: int) -> Path:
        return self.folder / f"{re.sub(r'[^A-Za-z0-9.]+', '_', group)}-{start}"

    def fetch(self, group: str, start: int, url: str) -> str | None:
        path = self.path(group, start)
        return path.read_text(encoding="utf-8") if path.exists() else None


def rate_limited(text: str | None) -> bool:
    """Whether an answer is the notice that requests came too fast, which arrives as an ordinary page."""
    if not text or "RateLimitError" not in text:
        return False
    try:
        found = json.loads(text)
    except ValueError:
        return False
    return isinstance(found, dict) and found.get("name") == "RateLimitError"


class HttpTransport:
    """GET, once more after a back-off if the host asks for one, then a pause; any other failure ends the group."""

    def __init__(self, pause: float, backoff: float = BACKOFF_S, get: Callable[[str], str] | None = None):
        self.pause, self.backoff, self.get = pause, backoff, get or self._get

    @staticmethod
    def _get(url: str) -> str:
        with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310 - the address is an option
            return r.read().decode()

    def fetch(self, group: str, start: int, url: str) -> str | None:
        try:
            text = self.get(url)
            if rate_limited(text):
                time.sleep(self.backoff)
                text = self.get(url)
            return None if rate_limited(text) else text
        except Exception:  # noqa: BLE001
            return None
        finally:
            time.sleep(self.pause)


class ArchiveTransport(FileTransport):
    """Pages are kept in a folder as they come and read from there afterwards, so a replay gives the same."""

    def __init__(self, folder: str, inner: HttpTransport):
        super().__init__(folder)
        self.inner = inner

    def fetch(self, group: str, start: int, url: str) -> str | None:
        text = super().fetch(group, start, url)
        if text is None and (text := self.inner.fetch(group, start, url)) is not None:
            path = self.path(group, start)
            path.parent.mkdir(parents=True, exist_ok=True)
            part = path.with_name(f"{path.name}.{uuid.uuid4().hex}")
            part.write_text(text, encoding="utf-8")
            part.rename(path)
        return text


def _transport(spec: str, pause: float, archive: str = "") -> FileTransport | HttpTransport:
    if spec.startswith("file:"):
        return FileTransport(spec.removeprefix("file:"))
    return ArchiveTransport(archive, HttpTransport(pause)) if archive else HttpTransport(pause)


def count_entries(page: str) -> int:
    return len(re.findall(r"<entry[\s>]", page))


def count_notes(page: str) -> int:
    try:
        return len(json.loads(page).get("notes", []))
    except ValueError:
        return -1


def oldest_published(page: str) -> str:
    return min(re.findall(r"<published>\s*(\d{4}-\d{2}-\d{2})", page), default="9999")


class _Groups(InputPartition):
    def __init__(self, groups: list[str]):
        super().__init__(groups)


class _Pages:
    """Paging of one kind of source, from its options."""

    def __init__(self, options: dict[str, str], feed: bool):
        self.feed = feed
        self.base = options.get("base", "")
        self.size = int(options.get("pageSize", FEED_PAGE if feed else NOTES_PAGE))
        self.cap = int(options.get("rowCap", ROW_CAP))
        self.first, self.last = options.get("startDate", "0001-01-01"), options.get("endDate", "9999-12-31")
        self.spec, self.parts, self.archive = options.get("transport", "http"), int(options.get("partitions", 1)), options.get("archive", "")
        self.flat, self.wrapped, self.host = (options.get(k, "") for k in ("flat", "wrapped", "host"))
        if feed:
            self.groups = options.get("categories", ",".join(CATEGORIES)).split(",")
        else:
            years = range(int(options.get("fromYear", 2017)), int(options.get("toYear", 2025)) + 1)
            kinds = [k for k in options["statuses"].split(",")] if "statuses" in options else QUERY_TYPES
            tracks = [t for t in options.get("tracks", "").split(",") if t]
            # a track is asked for by itself, without the statuses, and from the last address form on
            self.groups = [f"{y}@{t}" for y in years for t in tracks if y >= 2024] if tracks else [f"{y}/{k}" for y in years for k in kinds if k or y >= 2024]

    def url(self, group: str, start: int) -> str:
        if self.feed:
            return feed_url(self.base, group, self.first, self.last, start, self.size)
        year, mark, rest = re.fullmatch(r"(\d+)([/@])(.*)", group).groups()
        return notes_url(self.flat, self.wrapped, self.host, int(year), "" if mark == "@" else rest, start, rest if mark == "@" else "") or ""

    def page(self, group: str, start: int) -> tuple[str, int, str, int, str] | None:
        """The page, or None where the group ends: nothing came, it can't be read, or it is empty."""
        url = self.url(group, start)
        text = _transport(self.spec, FEED_PAUSE_S if self.feed else NOTES_PAUSE_S, self.archive).fetch(group, start, url)
        n = 0 if text is None else count_entries(text) if self.feed else count_notes(text)
        return (group, start, url, n, text) if text is not None and n > 0 else None

    def ends_after(self, row: tuple) -> bool:
        """A feed ends where pages grow older than the range; notes end at a page that isn't full."""
        return oldest_published(row[4]) < self.first if self.feed else row[3] < self.size

    def read(self, groups: list[str]) -> Iterator[tuple]:
        total = 0
        for g in groups:
            start = 0
            while total < self.cap and (row := self.page(g, start)):
                yield row
                total += row[3]
                start += row[3] if self.feed else self.size
                if self.ends_after(row):
                    break


class _Reader(DataSourceReader):
    def __init__(self, pages: _Pages):
        self.pages = pages

    def partitions(self) -> list[InputPartition]:
        # each partition stops at the cap by itself; capped() holds it over all
        n = max(1, min(self.pages.parts, len(self.pages.groups)))
        return [_Groups(self.pages.groups[i::n]) for i in range(n)]

    def read(self, partition: _Groups) -> Iterator[tuple]:
        yield from self.pages.read(partition.value)


class _Stream(SimpleDataSourceStreamReader):
    """``pagesPerTrigger`` pages a batch, all that are there by default; the offset is the group and the place
    in it, so a restart goes on where it was."""

    def __init__(self, pages: _Pages, most: int = 0):
        self.pages, self.most = pages, most

    def initialOffset(self) -> dict:
        return {"group": 0, "start": 0, "total": 0}

    def _next(self, at: dict) -> tuple[tuple | None, dict]:
        g, start, total = at["group"], at["start"], at["total"]
        while g < len(self.pages.groups) and total < self.pages.cap:
            row = self.pages.page(self.pages.groups[g], start)
            if row:
                total += row[3]
                if self.pages.ends_after(row):
                    return row, {"group": g + 1, "start": 0, "total": total}
                return row, {"group": g, "start": start + (row[3] if self.pages.feed else self.pages.size), "total": total}
            g, start = g + 1, 0
        return None, {"group": g, "start": start, "total": total}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], start
        while not self.most or len(rows) < self.most:
            row, at = self._next(at)
            if row is None:
                break
            rows.append(row)
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start
        while (at["group"], at["start"]) < (end["group"], end["start"]):
            row, at = self._next(at)
            if row is None:
                break
            yield row


class FeedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Pages(self.options, True))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(_Pages(self.options, True), int(self.options.get("pagesPerTrigger", 0)))


class NotePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "note_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Pages(self.options, False))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(_Pages(self.options, False), int(self.options.get("pagesPerTrigger", 0)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedPages)
    spark.dataSource.register(NotePages)


def capped(rows: DataFrame, cap: int = ROW_CAP) -> DataFrame:
    """At most ``cap`` accepted rows over all partitions, as a crawl is bounded: a limit that is the feature."""
    return rows.limit(cap)


def crawl_totals(pages: DataFrame) -> DataFrame:
    """(pages, items, groups): what a scan has fetched, from its own rows."""
    return pages.agg(F.count("*").alias("pages"), F.coalesce(F.sum("n_items"), F.lit(0)).cast("long").alias("items"), F.countDistinct("group").alias("groups"))


def distinct_requests(requests: DataFrame, key: list[str]) -> DataFrame:
    """Each planned request once: of several for one key (a fingerprint of address and headers) any one is sent."""
    return requests.dropDuplicates(key)


def forum_replies(papers: DataFrame, flat: str = "", wrapped: str = "", transport: str = "http", archive: str = "", partitions: int = 1) -> DataFrame:
    """(forum, year, notes) of the papers of (id, year): one request a paper, the replies as a JSON list in their order.

    A paper whose request fails has no row. One partition by default, because the host's limit is global.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = _transport(transport, NOTES_PAUSE_S, archive)
        for b in batches:
            rows = []
            for forum, year in zip(b["id"], b["year"], strict=True):
                text = get.fetch(f"forum {forum}", 0, forum_url(flat, wrapped, int(year), forum))
                if text is not None and count_notes(text) >= 0:
                    rows.append((forum, year, json.dumps(json.loads(text).get("notes", []), ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=["forum", "year", "notes"])

    asked = distinct_requests(papers.where("id IS NOT NULL AND year IS NOT NULL").select("id", F.col("year").cast("int").alias("year")), ["id"])
    return asked.repartition(partitions).mapInPandas(run, "forum string, year int, notes string")


def notes_of_pages(pages: DataFrame) -> DataFrame:
    """(year, query_type, note): one row a note of the pages of ``note_pages``; a track's notes have no status."""
    year = F.regexp_extract("group", r"^(\d+)", 1).cast("int")
    kind = F.when(F.col("group").contains("/"), F.regexp_replace("group", r"^\d+/", "")).otherwise("")
    notes = F.from_json(F.get_json_object("page", "$.notes"), "array<string>")
    return pages.select(year.alias("year"), kind.alias("query_type"), F.explode(notes).alias("note"))
