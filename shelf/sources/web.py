"""Live pages over HTTP as a DataFrame source. Tables of pages (url, html) need no network and are the usual input.

    spark.dataSource.register(PageSource)
    spark.read.format("shelf_pages").option("urls", "https://a.example/\\nhttps://b.example/x").load()

has a partition for each host, whose pages it fetches one after the other, delay seconds apart, and again after a failure that
may pass; fetch_pages() does the same for a table of URLs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from time import sleep
from urllib.error import HTTPError, URLError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.urls import origin_of

AGENT = "shelf/0.1"
#: Seconds between two fetches of a crawl.
DELAY = 0.25
PAGES = "url string, final_url string, html string, error string"
_SCHEMA = pa.schema([(n, pa.string()) for n in ("url", "final_url", "html", "error")])


#: Times that a fetch is tried again, and answers that may pass: too many requests, and the server's own failures.
RETRIES, PASSING = 2, frozenset({408, 425, 429, 500, 502, 503, 504})


def fetch(url: str, timeout: float = 30.0) -> dict:
    """A page after redirects; error instead of html if the answer isn't a success, passes: whether it may be one later."""
    try:
        request = Request(url, headers={"user-agent": AGENT, "accept": "text/html,application/xhtml+xml"})
        with urlopen(request, timeout=timeout) as r:
            return {"url": url, "final_url": r.url or url, "html": r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), "error": None, "passes": False}
    except HTTPError as e:
        return {"url": url, "final_url": url, "html": None, "error": f"The server answered {e.code} {e.reason}", "passes": e.code in PASSING}
    except (URLError, OSError, ValueError) as e:
        return {"url": url, "final_url": url, "html": None, "error": str(e), "passes": not isinstance(e, ValueError)}


def politely(urls: Iterable[str], delay: float = DELAY, retries: int = RETRIES, timeout: float = 30.0) -> Iterator[tuple]:
    """Rows of PAGES: pages of one host after the other, delay seconds apart; a fetch that fails but may pass is tried again,
    after twice the delay, then four times."""
    waits = False
    for url in urls:
        for k in range(retries + 1):
            if waits:
                sleep(delay * 2**k)
            waits = True
            page = fetch(url, timeout)
            if not page.get("passes"):
                break
        yield tuple(page[n] for n in _SCHEMA.names)


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        super().__init__(urls)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        urls = dict.fromkeys(u.strip() for u in options.get("urls", "").splitlines() if u.strip())
        self.hosts: dict[str, list[str]] = {}
        for u in urls:
            self.hosts.setdefault(urlsplit(u).netloc.lower(), []).append(u)
        self.how = {"delay": float(options.get("delay", DELAY)), "retries": int(options.get("retries", RETRIES)), "timeout": float(options.get("timeout", 30))}

    def partitions(self) -> list[InputPartition]:
        return [_Host(urls) for urls in self.hosts.values()] or [_Host([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from politely(partition.value, **self.how)


class PageSource(DataSource):
    """Pages of given URLs. Options: urls (one a line; each is fetched once), delay, retries, timeout."""

    @classmethod
    def name(cls) -> str:
        return "shelf_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fetch_in_turn(urls: list[str], delay: float = DELAY, waits: bool = False) -> list[tuple]:
    """Pages one after the other, delay seconds apart; waits: before the first, too. Rows of PAGES."""
    out = []
    for k, url in enumerate(urls):
        if k or waits:
            sleep(delay)
        page = fetch(url)
        out.append(tuple(page[n] for n in _SCHEMA.names))
    return out


def fetch_pages(urls: DataFrame, parallelism: int | None = None, delay: float = DELAY, retries: int = RETRIES) -> DataFrame:
    """Fetches each url of a table on the executors, those of one host in one task, as politeness asks."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: str | None = None
        for b in batches:
            out = []
            for url in b.column(0).to_pylist():
                host = urlsplit(url).netloc.lower()
                if host == held:
                    sleep(delay)
                held = host
                out.extend(politely([url], delay, retries))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], schema=_SCHEMA)

    host = F.lower(origin_of("url"))
    dealt = urls.select("url").repartition(parallelism, host) if parallelism else urls.select("url").repartition(host)
    return dealt.sortWithinPartitions(host, "url").mapInArrow(run, PAGES)


def fetch_given(spark: SparkSession, urls: list[str], delay: float = DELAY) -> DataFrame:
    """The few URLs of a command, through the data source."""
    spark.dataSource.register(PageSource)
    return spark.read.format(PageSource.name()).option("urls", "\n".join(urls)).option("delay", str(delay)).load()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A table of pages: url, html and, if it has them, final_url and error."""
    return spark.read.parquet(path)
