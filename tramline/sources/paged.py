"""A paged JSON service over HTTP as a Spark data source: one task per range of pages.

Options: url with {start} and {end} (and {date}), rows (path to the list in the answer), total (path to the count; without
one, pages are read in one task until one is not full), page (rows a page, 1000), dates (comma-separated, put into the address), retries, pause, schema given by the reader.
sorted (the service orders its rows by the date column: a filter on it then prunes pages, found by halving; where the rows
asked for show another order, all pages are read, or with strict an error is raised).
A filter on the date column is pushed into the addresses. Keys belong into the environment: {env:NAME} is replaced by it.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType


class ServiceError(Exception):
    """The service answered with an error of its own; asking again is no use."""


def _dig(obj, path: str):
    for k in filter(None, path.split(".")):
        obj = obj.get(k) if isinstance(obj, dict) else None
    return obj


def _fill(url: str, start: int, end: int, date: str | None) -> str:
    url = re.sub(r"\{env:(\w+)\}", lambda m: os.environ.get(m[1], ""), url)
    return url.replace("{start}", str(start)).replace("{end}", str(end)).replace("{date}", date or "")


def fetch(options: dict, start: int, end: int, date: str | None) -> tuple[list[dict], int | None]:
    """(rows, total if told) of one page; transport errors are tried again with growing pauses, an empty answer has no rows."""
    retries, pause = int(options.get("retries", 5)), float(options.get("pause", 0.1))
    for attempt in range(retries):
        try:
            with urllib.request.urlopen(_fill(options["url"], start, end, date), timeout=30) as answer:
                body = json.load(answer)
            break
        except (OSError, ValueError):
            if attempt == retries - 1:
                raise
            time.sleep(min(30.0, pause * 2**attempt))
    code = _dig(body, options.get("code", "RESULT.CODE"))
    if code == options.get("empty", "INFO-200"):
        return [], 0
    if code not in (None, options.get("ok", "INFO-000")):
        raise ServiceError(str(code))
    rows = _dig(body, options.get("rows", "rows")) or []
    total = _dig(body, options.get("total", "total"))
    return rows, None if total in (None, "") else int(total)


class Pages(InputPartition):
    def __init__(self, start: int, end: int | None, date: str | None):
        self.start, self.end, self.date = start, end, date


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.dates = [d.strip() for d in options.get("dates", "").split(",") if d.strip()] or [None]
        self.least: str | None = None
        self.most: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Dates asked for narrow the addresses, or the pages of a sorted service; every filter is still applied to the rows."""
        column = self.options.get("date_column", "date")
        for f in filters:
            if f.attribute == (column,) if hasattr(f, "attribute") else False:
                wanted = {str(f.value)} if isinstance(f, EqualTo) else set(map(str, f.value)) if isinstance(f, In) else None
                if wanted is not None and self.dates != [None]:
                    self.dates = [d for d in self.dates if d in wanted]
                lo, hi = (min(wanted), max(wanted)) if wanted else (str(f.value), None) if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else (None, str(f.value)) if isinstance(f, (LessThan, LessThanOrEqual)) else (None, None)
                self.least = max(filter(None, [self.least, lo]), default=None)
                self.most = min(filter(None, [self.most, hi]), default=None)
            yield f

    def _pruned(self, total: int, page: int, date: str | None) -> range:
        """Numbers of the pages that may hold the dates asked for, by the first date of some of them."""
        pages, column, seen = -(-total // page), self.options.get("date_column", "date"), {}

        def first(k: int) -> str:
            if k not in seen:
                rows, _ = fetch(self.options, k * page + 1, k * page + 1, date)
                seen[k] = str(rows[0].get(column)) if rows else ""
            return seen[k]

        def least(ok: Callable[[int], bool]) -> int:
            a, z = 0, pages
            while a < z:
                m = (a + z) // 2
                a, z = (a, m) if ok(m) else (m + 1, z)
            return a

        # A date may begin on the page before the first one that starts with it.
        begin = max(0, least(lambda k: first(k) >= self.least) - 1) if self.least else 0
        end = least(lambda k: first(k) > self.most) if self.most else pages
        first(0), first(pages - 1)
        known = [seen[k] for k in sorted(seen)]
        if known != sorted(known):
            if self.options.get("strict", "false").lower() == "true":
                raise ServiceError(f"rows are not sorted by {column}")
            return range(pages)
        return range(begin, end)

    def partitions(self) -> list[Pages]:
        page, out = int(self.options.get("page", 1000)), []
        prune = self.options.get("sorted", "false").lower() == "true" and (self.least or self.most)
        for d in self.dates:
            rows, total = fetch(self.options, 1, 1, d)
            if total is None:
                out += [Pages(1, None, d)] if rows else []
                continue
            pages = self._pruned(total, page, d) if prune and total else range(-(-total // page))
            out += [Pages(k * page + 1, min((k + 1) * page, total), d) for k in pages]
        return out or [Pages(1, 0, None)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        page, start = int(self.options.get("page", 1000)), partition.start
        names = self.schema.fieldNames()
        while partition.end is None or start <= partition.end:
            rows, _ = fetch(self.options, start, start + page - 1 if partition.end is None else partition.end, partition.date)
            for r in rows:
                yield tuple(None if r.get(f) is None else str(r.get(f)) for f in names)
            if partition.end is not None or len(rows) < page:
                return
            start += page


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> StructType | str:
        """All fields that rows of the service's first page have, as text, unless the reader gives a schema."""
        for d in [x.strip() for x in (self.options.get("dates") or "").split(",")]:
            rows, _ = fetch(self.options, 1, int(self.options.get("page", 1000)), d or None)
            if rows:
                return ", ".join(f"`{k}` string" for k in dict.fromkeys(k for r in rows for k in r))
        raise ValueError("the service has no row to take a schema from")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options)


def register(spark: SparkSession) -> None:
    # The reader pushes dates into its addresses only with this setting.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
