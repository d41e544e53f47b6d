"""Price bars from paged web services, as a Spark data source.

Two shapes are known: pages of candles from a start time on ("klines"), and one document a period ("chart").
`url` may be any address that urllib opens, file:// included, so folders of saved pages can stand in for
the service. Each partition fetches a range of time by itself; a page shorter than asked ends the range.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.bars import seconds

SCHEMA = "source string, symbol string, timeframe string, ts_sec bigint, open double, high double, low double, close double, volume double"
#: The service's page size and pause, and the answers that ask for patience.
PAGE, PAUSE, TRIES = 1000, 0.12, 5
RETRY = (418, 429, 500, 502, 503, 504)
#: How far back the chart service gives each timeframe.
PERIODS = {"15m": "60d", "1h": "730d", "1d": "max", "1w": "max"}
#: What the chart service calls a timeframe where that differs.
INTERVALS = {"1w": "1wk"}


def fetch(url: str, tries: int = TRIES, base: float = 1.0, grow: float = 2.0) -> object:
    """The JSON at url; waits longer and longer while the service asks for it."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=30) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code not in RETRY or k == tries - 1:
                raise
        except urllib.error.URLError:
            if k == tries - 1:
                raise
        time.sleep(base * grow**k)
    raise AssertionError("unreachable")


class _Range(InputPartition):
    def __init__(self, symbol: str, start: int, end: int):
        self.symbol, self.start, self.end = symbol, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options
        self.step = seconds(options["timeframe"])

    def partitions(self) -> list[InputPartition]:
        """Ranges of whole pages, for each symbol; the chart service gives a symbol in one piece."""
        symbols = [s.strip() for s in self.o["symbols"].split(",")]
        start, end, span = int(self.o["start"]), int(self.o["end"]), PAGE * self.step * int(self.o.get("pages", 10))
        if self.o.get("kind", "klines") == "chart":
            return [_Range(s, start, end) for s in symbols]
        return [_Range(s, at, min(at + span, end)) for s in symbols for at in range(start, end, span)]

    def read(self, part: _Range) -> Iterator[tuple]:
        rows = self._chart(part) if self.o.get("kind", "klines") == "chart" else self._klines(part)
        for ts, *prices in rows:
            # only bars that are over at `end`, which stands for now
            if part.start <= ts < part.end and ts + self.step <= int(self.o["end"]):
                yield (self.o["source"], part.symbol, self.o["timeframe"], ts, *map(float, prices))

    def _klines(self, part: _Range) -> Iterator[tuple]:
        at = part.start
        while at < part.end:
            page = fetch(self.o["url"].format(symbol=part.symbol, timeframe=self.o["timeframe"], start_ms=at * 1000, limit=PAGE), base=float(self.o.get("wait", 1)))
            yield from ((r[0] // 1000, *r[1:6]) for r in page)
            if len(page) < PAGE:
                return
            at = page[-1][0] // 1000 + self.step
            time.sleep(PAUSE)

    def _chart(self, part: _Range) -> Iterator[tuple]:
        page = fetch(self.o["url"].format(symbol=part.symbol, timeframe=self.o["timeframe"], interval=INTERVALS.get(self.o["timeframe"], self.o["timeframe"]), period=PERIODS.get(self.o["timeframe"], "max")), base=float(self.o.get("wait", 45)), grow=1.6)
        quotes = page["indicators"]["quote"][0]
        for row in zip(page["timestamp"], *(quotes[c] for c in ("open", "high", "low", "close", "volume")), strict=True):
            if None not in row[:5]:
                yield (*row[:5], row[5] or 0)


class RestBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """After this, spark.read.format("rest_bars") takes the options source, url, symbols, timeframe, start, end, kind."""
    spark.dataSource.register(RestBars)
