"""Paged market history as a Spark data source.

`spark.read.format("market_history")` has one partition per symbol and time
chunk; each reads its pages with retries and advances past the last row. The
transport is a function `module:name` (option `fetch`) taking (symbol, start_ms,
end_ms, limit) and returning rows, so tests and offline runs need no network.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Interval names in milliseconds.
INTERVAL_MS = {"5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "4h": 14_400_000, "12h": 43_200_000, "1d": 86_400_000}

#: Columns of each kind of history after ts.
KINDS = {
    "futures": ("open", "high", "low", "close", "volume"),
    "spot": ("close", "volume", "high", "low"),
    "open_interest": ("open_interest",),
    "funding": ("funding_rate",),
    "ls_ratio": ("ls_ratio",),
}


class RateLimited(Exception):
    """The service asks to wait."""


class BadRange(Exception):
    """The service has nothing for this range."""


def with_retry(call, tries: int = 3, wait: float = 60.0, sleep=time.sleep):
    """call(), again after a wait while it is rate limited; the last refusal is
    raised, so that no page is lost silently."""
    for k in range(tries):
        try:
            return call()
        except RateLimited:
            if k == tries - 1:
                raise
            sleep(wait)


def pages(fetch, symbol: str, start: int, end: int, limit: int, step: int, wait: float = 60.0) -> Iterator[tuple]:
    """Rows (ts, ...) from start to end: pages until one is short. A range that the
    service does not have is left out, and the next one asked for."""
    at = start
    while at <= end:
        try:
            rows = with_retry(lambda a=at: fetch(symbol, a, end, limit), wait=wait)
        except BadRange:
            at += step * limit
            continue
        if not rows:
            return
        yield from rows
        if len(rows) < limit:
            return
        at = rows[-1][0] + step


class Chunk(InputPartition):
    def __init__(self, symbol: str, start: int, end: int):
        self.symbol, self.start, self.end = symbol, start, end


class MarketReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self) -> list[Chunk]:
        step = INTERVAL_MS[self.o.get("interval", "1d")]
        limit, start, end = int(self.o.get("limit", 500)), int(self.o["start"]), int(self.o["end"])
        span = step * limit * int(self.o.get("pages", 10))
        return [Chunk(s, a, min(a + span, end + 1) - 1) for s in self.o["symbols"].split(",") for a in range(start, end + 1, span)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        module, _, name = self.o["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        step = INTERVAL_MS[self.o.get("interval", "1d")]
        width = len(KINDS[self.o.get("kind", "futures")])
        for row in pages(fetch, partition.symbol, partition.start, partition.end, int(self.o.get("limit", 500)), step, float(self.o.get("wait", 60))):
            yield (partition.symbol, int(row[0]), *[None if x is None else str(x) for x in row[1 : 1 + width]])


class MarketHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "market_history"

    def schema(self) -> str:
        return "symbol string, ts long, " + ", ".join(f"{c} string" for c in KINDS[self.options.get("kind", "futures")])

    def reader(self, schema) -> MarketReader:
        return MarketReader(dict(self.options))

    def streamReader(self, schema) -> MarketStream:
        return MarketStream(dict(self.options))


class MarketStream(DataSourceStreamReader):
    """The same history as a stream of closed bars. An offset holds for each symbol
    the time after its last bar; the driver only reads the clock. A micro-batch has
    one partition per symbol and time chunk, read page by page on the executors, and
    is read again alike after a failure, as its ends are in the checkpoint. With
    `bars` a batch takes at most so many bars of a symbol."""

    def __init__(self, options: dict):
        self.o = options
        self.step = INTERVAL_MS[options.get("interval", "1d")]
        self.after: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {s: int(self.o["start"]) for s in self.o["symbols"].split(",")}

    def latestOffset(self) -> dict:
        now = int(self.o.get("end", time.time() * 1000))
        out = {}
        for symbol, at in (self.after or self.initialOffset()).items():
            closed = max(0, (now - at) // self.step)  # bars from `at` on that are over
            out[symbol] = at + self.step * min(closed, int(self.o.get("bars", closed)))
        return out

    def partitions(self, start: dict, end: dict) -> list[Chunk]:
        self.after = dict(end)  # where a stream goes on, also after a restart
        span = self.step * int(self.o.get("limit", 500)) * int(self.o.get("pages", 10))
        first = self.initialOffset()
        return [Chunk(s, a, min(a + span, to) - 1) for s, to in end.items() for a in range(start.get(s, first.get(s, to)), to, span)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        return MarketReader(self.o).read(partition)


def bar_stream(spark, kind: str = "futures", **options: str) -> DataFrame:
    """Closed bars as a stream, typed as history() does."""
    spark.dataSource.register(MarketHistory)
    df = spark.readStream.format("market_history").options(kind=kind, **options).load()
    return df.select("symbol", F.timestamp_millis("ts").alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in KINDS[kind]])


def history(spark, kind: str, **options: str) -> DataFrame:
    """Typed history: values that are no numbers become NULL, doubled rows go."""
    spark.dataSource.register(MarketHistory)
    df = spark.read.format("market_history").options(kind=kind, **options).load()
    typed = df.select("symbol", F.timestamp_millis("ts").alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in KINDS[kind]])
    return typed.dropDuplicates(["symbol", "ts"])
