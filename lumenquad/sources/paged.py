"""A REST table read page by page: format("paged_rows") with url, and page, rows, token, retries, wait, timeout at will.

The first page tells how many rows there are (num_rows_total, num_rows or total); where it doesn't, the end is searched
for with doubled offsets and then by halves, a row a request. Each page is a partition. A server that hands out fewer
rows a request than asked for is asked on from where it stopped; one that has no row before the told end is an error, as
rows would be lost. Requests that fail for a reason that passes (no connection, time out, 429, 5xx, half a body) are
repeated after doubled waits, or after the time that the server names.
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TOTALS = ("num_rows_total", "num_rows", "total")
LONGEST_WAIT = 60.0


class PagesError(OSError):
    pass


class Pages:
    """Requests for rows of one url."""

    def __init__(self, options: dict, sleep: Callable[[float], None] = time.sleep):
        self.url, self.token, self.sleep = options["url"], options.get("token"), sleep
        self.retries, self.wait, self.timeout = int(options.get("retries", 5)), float(options.get("wait", 0.5)), float(options.get("timeout", 60))

    def page(self, at: int, n: int) -> dict:
        mark = "&" if urllib.parse.urlparse(self.url).query else "?"
        request = urllib.request.Request(f"{self.url}{mark}{urllib.parse.urlencode({'offset': at, 'length': n})}")
        if self.token:
            request.add_header("Authorization", f"Bearer {self.token}")
        for attempt in range(self.retries + 1):
            asked = None
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500:
                    raise PagesError(f"rows from {at}: {e}") from e
                asked, why = e.headers.get("Retry-After"), e
            except (OSError, ValueError, http.client.HTTPException) as e:
                why = e
            if attempt == self.retries:
                raise PagesError(f"rows from {at}, asked {attempt + 1} times: {why}") from why
            self.sleep(min(LONGEST_WAIT, float(asked) if asked and asked.replace(".", "", 1).isdigit() else self.wait * 2**attempt))
        raise AssertionError

    def rows(self, at: int, n: int) -> list:
        return self.page(at, n).get("rows") or []

    def total(self) -> tuple[int, bool]:
        """Number of rows, and whether the server told it."""
        first = self.page(0, 1)
        told = next((int(first[k]) for k in TOTALS if isinstance(first.get(k), int)), None)
        if told is not None:
            return told, True
        if not first.get("rows"):
            return 0, False
        low, high = 0, 1  # there is a row at low; is there one at high?
        while self.rows(high, 1):
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.rows(middle, 1) else (low, middle)
        return high, False


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.size = dict(options), int(options.get("page", 100))
        self.told = options.get("rows")

    def partitions(self) -> list[InputPartition]:
        n = int(self.told) if self.told else Pages(self.options).total()[0]
        # An empty table is one partition without rows: Spark would read None as a partition instead.
        return [InputPartition((at, min(at + self.size, n))) for at in range(0, n, self.size)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        at, end = partition.value
        pages = Pages(self.options)
        while at < end:
            found = pages.rows(at, end - at)[: end - at]
            if not found:
                raise PagesError(f"no row at {at}, though there should be {end}")
            for row in found:
                yield (json.dumps(row.get("row", row) if isinstance(row, dict) else row, ensure_ascii=False),)
            at += len(found)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedReader(self.options)
