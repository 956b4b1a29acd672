"""Pages as a source: a table stands in for the network, or a fetch function is mapped over urls."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from weft.functions.urls import page_links


class FetchError(RuntimeError):
    """A page that could not be fetched."""


def _tried(get: Callable[[str], str | None], url: str, tries: int) -> tuple[str | None, str | None, int]:
    """(page, last error, tries made). A page that is None is a failure as well."""
    error = None
    for n in range(1, tries + 1):
        try:
            page = get(url)
            if page is not None:
                return page, None, n
            error = "no page"
        except Exception as e:  # noqa: BLE001  whatever the fetcher raises is a failed try
            error = f"{type(e).__name__}: {e}"
    return None, error, tries


def fetch_rows(urls: DataFrame, get: Callable[[str], str | None], tries: int = 3) -> DataFrame:
    """(url, html, error, tries): each url once, those of a host one after another in one task; a failure has no html but an error."""

    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            done = [(u, *_tried(get, u, tries)) for u in pdf["url"]]
            yield pd.DataFrame(done, columns=["url", "html", "error", "tries"])

    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    by_host = urls.select("url").where("url IS NOT NULL").distinct().repartition(host).sortWithinPartitions(host, "url")
    return by_host.mapInPandas(run, "url string, html string, error string, tries int")


def fetch(urls: DataFrame, get: Callable[[str], str | None], tries: int = 3) -> DataFrame:
    """(url, html) of all urls; a failure gives an empty page."""
    return fetch_rows(urls, get, tries).select("url", F.coalesce("html", F.lit("")).alias("html"))


def fetch_or_fail(urls: DataFrame, get: Callable[[str], str | None], tries: int = 3) -> DataFrame:
    """(url, html); a page that fails all tries fails the job, by name."""
    found = fetch_rows(urls, get, tries)
    failed = F.raise_error(F.concat(F.lit("could not fetch "), "url", F.lit(": "), F.coalesce("error", F.lit(""))))
    return found.select("url", F.when(F.col("html").isNull(), failed.cast("string")).otherwise(F.col("html")).alias("html"))


@dataclass
class _Host(InputPartition):
    urls: list[str]


class PageSource(DataSource):
    """spark.read.format("weft_pages"): pages of a list of urls, one partition a host.

    Options: urls, the list, one a line; fetcher, "module:function" that the tasks
    import; tries; failures, "rows" (with the error) or "raise". As a stream, the urls
    come `batch` at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "weft_pages"

    def schema(self) -> str:
        return "url string, html string, error string, tries int"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = list(dict.fromkeys(u.strip() for u in options["urls"].splitlines() if u.strip()))
        self.fetcher, self.tries, self.failures = options["fetcher"], int(options.get("tries", 3)), options.get("failures", "rows")
        if self.failures not in ("rows", "raise"):
            raise ValueError("failures must be rows or raise")

    def _by_host(self, urls: list[str]) -> list[_Host]:
        by: dict[str, list[str]] = {}
        for u in urls:
            by.setdefault(urlsplit(u).netloc.lower(), []).append(u)
        return [_Host(own) for _, own in sorted(by.items())]

    def partitions(self) -> list[_Host]:
        return self._by_host(self.urls)

    def read(self, partition: _Host):
        module, _, function = self.fetcher.partition(":")
        get = getattr(importlib.import_module(module), function)
        for url in partition.urls:
            page, error, tries = _tried(get, url, self.tries)
            if page is None and self.failures == "raise":
                raise FetchError(f"could not fetch {url}: {error}")
            yield url, page, error, tries


class PageStream(PageReader, DataSourceStreamReader):
    """The same, with the place in the list as the offset."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.batch, self.at = int(options.get("batch", 100)), 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        self.at = min(len(self.urls), self.at + self.batch)
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[_Host]:
        self.at = max(self.at, end["at"])
        return self._by_host(self.urls[start["at"] : end["at"]])

    def commit(self, end: dict) -> None:
        pass


def linked(pages: DataFrame) -> DataFrame:
    """(url, links) for weft.operators.crawl; empty pages, failed fetches, are left out."""
    return pages.where(F.coalesce(F.length("html"), F.lit(0)) > 0).select("url", page_links(F.col("url"), F.col("html")).alias("links"))
