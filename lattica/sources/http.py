"""Forge sources over HTTP: a conditional poll, a paginated listing, and both as Spark data sources."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urljoin

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from lattica.schema import VerbError

MAX_PAGES = 1000


class Reply(NamedTuple):
    status: int
    headers: dict[str, str]  # names in lower case
    body: bytes


def get(url: str, headers: dict[str, str] | None = None, timeout: float = 30) -> Reply:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as r:  # noqa: S310
            return Reply(r.status, {k.lower(): v for k, v in r.headers.items()}, r.read())
    except urllib.error.HTTPError as e:
        return Reply(e.code, {k.lower(): v for k, v in e.headers.items()}, e.read())


class Poll(NamedTuple):
    changed: bool
    body: bytes | None
    validators: dict[str, str]  # etag, last_modified: what the next poll sends
    free: bool  # a 304 costs no budget


def poll(url: str, validators: dict[str, str], fetch=get) -> Poll:
    """One conditional request: 304 keeps the validators, 200 replaces them."""
    names = {"etag": "If-None-Match", "last_modified": "If-Modified-Since"}
    r = fetch(url, {names[k]: v for k, v in validators.items() if v})
    if r.status == 304:
        return Poll(False, None, validators, True)
    if r.status != 200:
        raise VerbError("unavailable", f"{url} answered {r.status}")
    new = {"etag": r.headers.get("etag", ""), "last_modified": r.headers.get("last-modified", "")}
    return Poll(True, r.body, {k: v for k, v in new.items() if v}, False)


def next_link(header: str | None) -> str | None:
    for part in re.split(r",\s*(?=<)", header or ""):
        m = re.match(r'<([^>]*)>(.*)', part)
        if m and re.search(r'rel="?next"?', m[2]):
            return m[1]
    return None


def listing(url: str, fetch=get) -> Iterator[dict]:
    """The items of a paginated list, page by page, as long as there is a next link; a link seen before or too many pages are errors."""
    seen: set[str] = set()
    while url:
        if url in seen or len(seen) >= MAX_PAGES:
            raise VerbError("unavailable", "the pages of the listing don't end")
        seen.add(url)
        r = fetch(url, {})
        if r.status != 200:
            raise VerbError("unavailable", f"{url} answered {r.status}")
        yield from json.loads(r.body)
        link = next_link(r.headers.get("link"))
        url = urljoin(url, link) if link else None


def visibility_of(item: dict) -> str:
    """internal and private as told, else by the private flag."""
    told = item.get("visibility")
    return told if told in ("internal", "private", "public") else "private" if item.get("private") else "public"


class ListingSource(DataSource):
    """spark.read.format("forge_listing").option("urls", "u1 u2"): slug, visibility, a partition per list."""

    @classmethod
    def name(cls) -> str:
        return "forge_listing"

    def schema(self) -> str:
        return "slug string, visibility string"

    def reader(self, schema) -> DataSourceReader:
        urls = self.options["urls"].split()

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return [InputPartition(u) for u in urls]

            def read(self, partition: InputPartition) -> Iterator[tuple]:
                for item in listing(partition.value):
                    yield item["full_name"], visibility_of(item)

        return Reader()


class PollSource(DataSource):
    """spark.readStream.format("forge_poll").option("url", u): url, body of each change; the validators and the last body are the stream's offset."""

    @classmethod
    def name(cls) -> str:
        return "forge_poll"

    def schema(self) -> str:
        return "url string, body string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802  the interface's name
        url = self.options["url"]

        class Reader(SimpleDataSourceStreamReader):
            def initialOffset(self) -> dict:  # noqa: N802
                return {}

            def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
                p = poll(url, {k: start[k] for k in ("etag", "last_modified") if k in start})
                if not p.changed:
                    return iter([]), start
                body = p.body.decode("utf-8", "replace")
                return iter([(url, body)]), {**p.validators, "body": body, "polls": start.get("polls", 0) + 1}

            def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
                """From the offset itself, so that a batch that is run again has the body it had."""
                return iter([(url, end["body"])] if end.get("polls", 0) > start.get("polls", 0) else [])

        return Reader()
