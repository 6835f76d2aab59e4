"""Lookups in a literature service.

A lookup is a table of requests mapped to responses by a pluggable fetch function; what has
been fetched is kept as a table, and only missing keys are asked for. `replay` answers from
a table, for tests and for work without a network. `http_get` retries and paces itself.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T


class Pace:
    """At least `gap` seconds between calls of one worker; the number of lookup partitions
    times 1 / gap is the rate over the whole cluster (S41)."""

    def __init__(self, gap: float):
        self.gap, self.last = gap, 0.0

    def wait(self) -> None:
        time.sleep(max(0.0, self.last + self.gap - time.monotonic()))
        self.last = time.monotonic()


def http_get(url: str, params: dict, tries: int = 4, pause: float = 0.5, timeout: float = 30.0) -> str:
    """GET with exponential waits on 429, server errors and broken connections."""
    for i in range(tries):
        try:
            with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=timeout) as r:
                return r.read().decode()
        except urllib.error.HTTPError as e:
            if i == tries - 1 or (e.code != 429 and e.code < 500):
                raise
        except urllib.error.URLError:
            if i == tries - 1:
                raise
        time.sleep(pause * 2**i)
    raise AssertionError


def search_result(body: str) -> tuple[list[str], int]:
    """Ids and hit count of a search response; the count is read as a number whatever its type."""
    r = json.loads(body).get("esearchresult", {})
    ids = [str(x) for x in r.get("idlist", [])]
    try:
        return ids, int(r.get("count", len(ids)))
    except (TypeError, ValueError):
        return ids, len(ids)


def fetch(keys: DataFrame, key: str, ask: Callable[[list[str]], dict[str, str]], batch: int = 200, gap: float = 0.34, workers: int = 1) -> DataFrame:
    """(key, body, error) of each distinct key; `ask` gets up to `batch` keys at once. If it
    fails, the keys are asked one by one, so that one bad key spoils only itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(gap)

        def call(some: list[str]) -> dict[str, tuple]:
            pace.wait()
            try:
                got = ask(some)
                return {k: (got.get(k), None if k in got else "missing") for k in some}
            except Exception as e:  # the service's own errors are data here
                return {some[0]: (None, repr(e)[:300])} if len(some) == 1 else {k: v for x in some for k, v in call([x]).items()}

        for b in batches:
            each, found, since = b["key"].tolist(), [], time.monotonic()
            for i in range(0, len(each), batch):
                found += [(k, *v) for k, v in call(each[i : i + batch]).items()]
                # a table for every few keys costs more than a fast lookup; a slow one hands on what it has
                if i + batch >= len(each) or time.monotonic() - since > 1:
                    yield pd.DataFrame(found, columns=["key", "body", "error"])
                    found, since = [], time.monotonic()

    asked = keys.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct().repartition(workers)
    return asked.mapInPandas(run, "key string, body string, error string")


def missing(keys: DataFrame, key: str, cache: DataFrame) -> DataFrame:
    """Keys the cache table has no body for."""
    return keys.select(F.col(key).cast("string").alias("key")).distinct().join(cache.where("body is not null").select("key"), "key", "left_anti")


def replay(table: dict[str, str]) -> Callable[[list[str]], dict[str, str]]:
    return lambda keys: {k: table[k] for k in keys if k in table}


def linked(links: DataFrame, source: str, target: str) -> DataFrame:
    """source → distinct targets in the order met, normalised (S26, S27, J05); links has pos."""
    rows = links.select(source, T.pmcid(target).alias("t"), "pos").where("t is not null")
    first = rows.groupBy(source, "t").agg(F.min("pos").alias("pos"))
    return first.groupBy(source).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"]).alias("pmcids"))


class ReplaySource(DataSource):
    """spark.read.format("replay").option("path", file): recorded responses, JSON {key: body},
    one partition per thousand keys."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return "key string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _ReplayReader(self.options["path"])


class _ReplayReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        with open(self.path, encoding="utf-8") as f:
            n = len(json.load(f))
        return [InputPartition((i, i + 1000)) for i in range(0, max(n, 1), 1000)]

    def read(self, partition):
        with open(self.path, encoding="utf-8") as f:
            items = sorted(json.load(f).items())
        lo, hi = partition.value
        yield from ((k, v) for k, v in items[lo:hi])
