"""A Spark data source for market data services: format "bars", a partition for each symbol and page, by a fetcher of one's own.

    spark.dataSource.register(BarsSource)
    spark.read.format("bars").options(kind="klines", symbols="BTC_USD,ETH_USD", timeframe="H1", start="2024-01-01", end="2024-02-01", fetcher="my_package.fetch").load()

The fetcher, a function named by module and name, takes (kind, symbol, timeframe, start, stop), and base where that option is
set, and returns a payload; it runs in tasks, is tried again on a ConnectionError with growing pauses, and the payload is
parsed by DataFrame functions.

Of kind "rows" the fetcher returns bars themselves, (ts, open, high, low, close, volume) each, and the source gives rows of
bars. Then predicates reach it: equality and IN on symbol and timeframe leave out pages of others, comparisons of ts narrow
the pages' range, so that no call is made for what a query doesn't ask for; all other predicates stay with Spark. That takes the option
pushdown=true in a session with spark.sql.python.filterPushdown.enabled. As a stream it follows the service: an offset is the time up to which bars are read, a batch
has a partition a symbol and page, and with `again` a batch reads that many bars before its offset once more, for bars that a
service completes late; a store by which the last one wins (streaming.bars.into_store) takes these in. The clock, another
function by name, tells how far the service is.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .bars import fetch_checked
from .payloads import PARSERS, last_of

#: Seconds of a bar, and bars of a page, by service.
SECONDS = {"M1": 60, "M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H2": 7200, "H4": 14400, "H6": 21600, "H8": 28800, "H12": 43200, "D": 86400, "W": 604800}
PAGE = {"klines": 1000, "ohlc": 720, "candles": 5000, "series": 1_000_000, "rows": 1000}
BARS = "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def retried(tries: int = 3, pause: float = 1.0, errors: tuple[type[Exception], ...] = (Exception,)):
    """Calls a function up to that many times, pausing twice as long each time, with up to a quarter added."""

    def around(f: Callable) -> Callable:
        @wraps(f)
        def called(*a, **k):
            for i in range(tries):
                try:
                    return f(*a, **k)
                except errors:
                    if i + 1 == tries:
                        raise
                    time.sleep(pause * 2**i * (1 + random.random() / 4))
            raise ValueError("no tries")

        return called

    return around


_called: dict[str, float] = {}


def spaced(gap: float):
    """Calls a function no sooner than gap seconds after its last call in this worker, so that so many workers keep a service's rate."""

    def around(f: Callable) -> Callable:
        @wraps(f)
        def called(*a, **k):
            wait = _called.get(f.__qualname__, -gap) + gap - time.monotonic()
            if wait > 0:
                time.sleep(min(wait, gap))
            _called[f.__qualname__] = time.monotonic()
            return f(*a, **k)

        return called

    return around


def page_ranges(start: datetime, stop: datetime, timeframe: str, most: int) -> list[tuple[datetime, datetime]]:
    out, at, width = [], start, timedelta(seconds=SECONDS[timeframe] * most)
    while at <= stop:
        out.append((at, min(at + width, stop)))
        at = at + width + timedelta(seconds=1)
    return out


class Page(InputPartition):
    def __init__(self, symbol: str, start: datetime, stop: datetime):
        self.symbol, self.start, self.stop = symbol, start, stop


class BarsSource(DataSource):
    """Options: kind, symbols, timeframe, start, end, fetcher, base, tries, pause, page (bars), calls_per_minute (of all tasks together, at most `readers` at a time); of a stream also clock, again, most (bars of a symbol in a batch)."""

    @classmethod
    def name(cls) -> str:
        return "bars"

    def schema(self) -> str:
        return BARS if self.options.get("kind") == "rows" else "symbol string, timeframe string, payload string"

    def reader(self, schema) -> BarsReader:
        return (PushedReader if self.options.get("pushdown", "false") == "true" else BarsReader)(self.options)

    def streamReader(self, schema) -> BarsStreamReader:  # noqa: N802
        return BarsStreamReader(self.options)


def _named(path: str) -> Callable:
    module, _, name = path.rpartition(".")
    return getattr(import_module(module), name)


class _Service:
    """What batches and streams share: symbols, pages, calls."""

    def __init__(self, options: dict, end: str):
        self.kind, self.timeframe = options.get("kind", "klines"), options.get("timeframe", "")
        self.symbols = [s for s in options.get("symbols", "").split(",") if s]
        self.start, self.stop = datetime.fromisoformat(options["start"]), datetime.fromisoformat(end)
        fetch_checked(",".join(self.symbols), self.timeframe, self.start, self.stop)
        if self.kind != "rows" and self.kind not in PARSERS:
            raise ValueError(f"unknown kind {self.kind!r}")
        self.fetcher, self.base, self.tries, self.pause = options["fetcher"], options.get("base"), int(options.get("tries", 3)), float(options.get("pause", 1.0))
        self.most = int(options.get("page", PAGE[self.kind]))
        self.gap = 60.0 * int(options.get("readers", 1)) / float(options["calls_per_minute"]) if "calls_per_minute" in options else 0.0

    def pages(self, start: datetime, stop: datetime) -> list[Page]:
        return [Page(s, a, b) for s in self.symbols for a, b in page_ranges(start, stop, self.timeframe, self.most)]

    def read(self, page: Page) -> Iterator[tuple]:
        fetch = retried(self.tries, self.pause, (ConnectionError,))(spaced(self.gap)(_named(self.fetcher)))
        got = fetch(self.kind, page.symbol, self.timeframe, page.start, page.stop, **({"base": self.base} if self.base else {}))
        if self.kind != "rows":
            yield page.symbol, self.timeframe, got
            return
        for ts, *values in got:
            if page.start <= ts <= page.stop:
                yield page.symbol, self.timeframe, ts, *values


class BarsReader(_Service, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options, options["end"])
        self.timeframes = [self.timeframe]

    def partitions(self) -> list[Page]:
        # Spark wants a partition; one that ends before it starts makes no call.
        return (self.pages(self.start, self.stop) if self.timeframes else []) or [Page("", self.stop, self.stop - timedelta(days=1))]

    def read(self, page: Page) -> Iterator[tuple]:
        if page.start <= page.stop:
            yield from super().read(page)


class PushedReader(BarsReader):
    """Spark doesn't let a reader have pushFilters where the session has it off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes what pages can follow; what is yielded is left to Spark."""
        step = timedelta(microseconds=1)
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else None
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name == "symbol" and asked is not None:
                self.symbols = [s for s in self.symbols if s in asked]
            elif name == "timeframe" and asked is not None:
                self.timeframes = [t for t in self.timeframes if t in asked]
            elif self.kind == "rows" and name == "ts" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                at = f.value.replace(tzinfo=None)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.start = max(self.start, at + step if isinstance(f, GreaterThan) else at)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.stop = min(self.stop, at - step if isinstance(f, LessThan) else at)
            else:
                yield f


class BarsStreamReader(_Service, DataSourceStreamReader):
    """Offsets are {"until": time}: bars that start before it are read."""

    def __init__(self, options: dict):
        super().__init__(options, options.get("end", "9999-01-01"))
        self.clock, self.again, self.batch = options["clock"], int(options.get("again", 0)), int(options.get("most", 0))
        self.width = timedelta(seconds=SECONDS[self.timeframe])
        self.reached: datetime | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": self.start.isoformat()}

    def latestOffset(self) -> dict:  # noqa: N802
        """The time of the service's clock, in whole bars since the start; with `most`, that many bars further than the last batch at most."""
        now = _named(self.clock)(**({"base": self.base} if self.base else {}))
        until = self.start + (min(now, self.stop) - self.start) // self.width * self.width
        if self.batch and self.reached is not None:
            until = min(until, self.reached + self.batch * self.width)
        return {"until": max(until, self.start).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        a, b = (datetime.fromisoformat(o["until"]) for o in (start, end))
        self.reached = b
        return self.pages(max(self.start, a - self.again * self.width), b - timedelta(microseconds=1)) if a < b else []

    def commit(self, end: dict) -> None:
        self.reached = datetime.fromisoformat(end["until"])


def fetched(spark: SparkSession, kind: str, symbols: list[str], timeframe: str, start: str, end: str, fetcher: str, limit: int | None = None, **more: str) -> DataFrame:
    """Bars of symbols between start and end, the last `limit` of each; pages that overlap give a bar once."""
    fetch_checked(",".join(symbols), timeframe, start, end, limit)
    spark.dataSource.register(BarsSource)
    raw = spark.read.format("bars").options(kind=kind, symbols=",".join(symbols), timeframe=timeframe, start=start, end=end, fetcher=fetcher, **more).load()
    bars = (raw if kind == "rows" else PARSERS[kind](raw)).where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return last_of(bars.dropDuplicates(["symbol", "timeframe", "ts"]), limit)
