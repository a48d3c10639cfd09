"""Searches of a remote literature index: retries, date ranges bisected until they fit, and a Spark data source over them."""

from __future__ import annotations

import time
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from datetime import date, timedelta
from itertools import accumulate
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

import termloom.session  # noqa: F401

RETRIED = frozenset({429, 500, 502, 503, 504})


class SearchError(Exception):
    """A failed call; ``status`` is the HTTP code, or None when the connection itself failed."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class Search(Protocol):
    """A remote index: how many ids a date range holds, and the ids."""

    def count(self, term: str, first: date, last: date) -> int: ...

    def ids(self, term: str, first: date, last: date, limit: int) -> list[int]: ...


class PagedSearch(Search, Protocol):
    """A :class:`Search` that can also give the ids of a range from a place on."""

    def page(self, term: str, first: date, last: date, start: int, limit: int) -> list[int]: ...


def with_retries(call: Callable, tries: int = 5, wait: Callable[[float], None] = time.sleep):
    """``call()`` again after 1, 2, 4, ... seconds on transient failures; other codes, and the last failure, are raised."""
    for k in range(tries):
        try:
            return call()
        except SearchError as e:
            if (e.status is not None and e.status not in RETRIED) or k == tries - 1:
                raise
            wait(2.0**k)


def bisect_range(count: Callable[[date, date], int], first: date, last: date, limit: int) -> list[tuple[date, date, int, bool]]:
    """Ranges (first, last, n, over) covering ``[first, last]`` that hold at most ``limit``; a single day may be over it."""
    todo, out = [(first, last)], []
    while todo:
        a, b = todo.pop()
        n = count(a, b)
        if n <= limit or a == b:
            out.append((a, b, n, n > limit))
        else:
            mid = a + timedelta(days=(b - a).days // 2)
            todo += [(mid + timedelta(days=1), b), (a, mid)]
    return sorted(out)


def bisect_days(days: Iterable[tuple[date, int]], limit: int) -> list[tuple[date, date, int, bool]]:
    """:func:`bisect_range` over counts per day; no days give no range."""
    known = sorted((d, n) for d, n in days if d is not None)
    if not known:
        return []
    at, upto = [d for d, _ in known], [0, *accumulate(n for _, n in known)]
    return bisect_range(lambda a, b: upto[bisect_right(at, b)] - upto[bisect_left(at, a)], at[0], at[-1], limit)


def fetch_in_batches(ids: DataFrame, key: str, make: Callable[[], Callable[[list[int]], dict[int, str | None]]], size: int = 9999) -> DataFrame:
    """``key, status, val`` for every non-null id: one remote call per ``size`` ids, made inside the tasks.

    ``make()`` gives the call, from ids to values by id. ``status`` is ``ok``, ``empty`` (answered without value, val ''), or
    ``failed`` (the call gave up after its retries, or left the id out; val null), so a failure never looks like an empty
    answer. Ids must be distinct.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, held = make(), []

        def ask(chunk: list[int]) -> pd.DataFrame:
            try:
                got = with_retries(lambda: call(chunk))
            except SearchError:
                got = {}
            status = ["failed" if i not in got else "ok" if got[i] else "empty" for i in chunk]
            return pd.DataFrame({key: chunk, "status": status, "val": [None if i not in got else got[i] or "" for i in chunk]})

        for batch in batches:
            held += batch[key].tolist()
            while len(held) >= size:
                yield ask(held[:size])
                held = held[size:]
        if held:
            yield ask(held)

    return ids.select(F.col(key).cast("bigint").alias(key)).where(F.col(key).isNotNull()).mapInPandas(run, f"{key} bigint, status string, val string")


class _Range(InputPartition):
    def __init__(self, first: date, last: date, n: int, start: int | None = None):
        super().__init__((first, last, n, start))


class SearchSource(DataSource):
    """``spark.read.format("literature_search")`` with options term, first, last (ISO days), limit, and ``factory``.

    ``factory`` names a callable (``module:name``) that makes the :class:`Search`. The ranges are found on the driver, each is
    read by its own task, ids come as numbers. No id is lost: a single day with more than ``limit`` ids is read page by page, each
    its own task, where the search has ``page``; else planning raises :class:`SearchError` naming the days. Register with ``spark.dataSource.register(SearchSource)``.
    """

    @classmethod
    def name(cls) -> str:
        return "literature_search"

    def schema(self) -> str:
        return "pmid bigint, first date, last date"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options

    def _search(self) -> Search:
        import importlib

        module, name = self.o["factory"].split(":")
        return getattr(importlib.import_module(module), name)()

    def partitions(self) -> list[InputPartition]:
        s, limit = self._search(), int(self.o.get("limit", 9999))
        found = bisect_range(lambda a, b: with_retries(lambda: s.count(self.o["term"], a, b)), date.fromisoformat(self.o["first"]), date.fromisoformat(self.o["last"]), limit)
        over = [(a, n) for a, _, n, o in found if o]
        if over and not hasattr(s, "page"):
            raise SearchError(f"more than {limit} ids on " + ", ".join(f"{a} ({n})" for a, n in over))
        whole = [_Range(a, b, n) for a, b, n, o in found if n and not o]
        return whole + [_Range(a, a, n, at) for a, n in over for at in range(0, n, limit)] or [_Range(date.fromisoformat(self.o["first"]), date.fromisoformat(self.o["first"]), 0)]

    def read(self, partition: InputPartition):
        a, b, n, start = partition.value
        if not n:
            return
        s, limit = self._search(), int(self.o.get("limit", 9999))
        ask = (lambda: s.ids(self.o["term"], a, b, limit)) if start is None else (lambda: s.page(self.o["term"], a, b, start, limit))
        for pmid in sorted({int(x) for x in with_retries(ask)}):
            yield pmid, a, b
