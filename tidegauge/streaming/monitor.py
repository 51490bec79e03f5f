"""A monitor of regimes that works bar by bar: features from state of bounded size, labels by a rule, alerts, and symbols that fall silent.

State of a symbol, each kind on its own: the bars that wait for the watermark, the returns of the rolling window, the
exponential averages, the conditional variance, and the last bar with its label. A batch's bars continue the recursions from
there, so that features equal those of one pass over the whole series (batch()), whatever the batches were.

By event time, bars wait until the watermark has passed them and are then worked off in order of time, so that bars which
come out of order within the watermark change nothing; later ones are dropped by Spark. A timer fires for the earliest bar
that waits, another when a symbol had no bar for `silent`: that gives a last row and its state goes. By processing time
(with ttl) bars are worked off as they come, those older than the last one are passed over, and state goes when it hasn't
been written to for ttl; such a stream runs batch after batch, so it has no end by the trigger availableNow.

Bars without ts or close are passed over; of bars of one symbol and ts the one with the least close counts. A symbol that is
null is a symbol. A symbol that comes back after its state has gone begins anew.

Spark keeps such state in RocksDB: the session needs the setting in STATE_STORE (own_session()).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegauge.functions.recursive import garch_path

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
FEATURES = ["returns", "vol", "fast", "slow", "macd", "garch_vol"]
OUT = "symbol string, ts timestamp, close double, returns double, vol double, fast double, slow double, macd double, garch_vol double, regime int, confidence double, before int, event string"

#: Labels and confidences of rows of features.
Rule = Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]


def own_session(spark: SparkSession) -> SparkSession:
    """A session beside spark that keeps the state of streams in RocksDB, with spark's own settings otherwise."""
    other = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        other.conf.set(k, spark.conf.get(k))
    for k, v in STATE_STORE.items():
        other.conf.set(k, v)
    return other


@dataclass(frozen=True)
class Settings:
    """Bars of the rolling window, spans of the averages, and the variance's recursion with what it begins at."""

    n: int = 20
    fast: int = 12
    slow: int = 26
    omega: float = 1e-5
    alpha: float = 0.1
    beta: float = 0.85
    first_variance: float = 1e-4


def by_cuts(column: str, cuts: tuple[float, ...]) -> Rule:
    """The regime is how many cuts the column is above (0 where it is null); the confidence how far it is from the nearest one, as a share of that cut, 1 at most."""

    def rule(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x, at = f[column].to_numpy(float), np.array(cuts)
        far = np.abs(x[:, None] - at) / np.abs(at)
        return (x[:, None] > at).sum(1), np.where(np.isfinite(x), np.minimum(far.min(1), 1.0), 0.0)

    return rule


def by_centres(columns: list[str], centres: np.ndarray) -> Rule:
    """The regime is the nearest centre (-1 where a column is null); the confidence 1 - d1 / (d1 + d2) by the two least distances."""

    def rule(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = f[columns].to_numpy(float)
        d = np.sqrt(((x[:, None, :] - np.asarray(centres)[None]) ** 2).sum(2))
        known, near = np.isfinite(x).all(1), np.sort(d, 1)
        both = near[:, 0] + near[:, 1]
        share = np.divide(near[:, 1], both, out=np.full(len(x), 0.5), where=both > 0)
        return np.where(known, np.where(np.isnan(d), np.inf, d).argmin(1), -1), np.where(known, share, 0.0)

    return rule


def _recursion(x: np.ndarray, before: float | None, alpha: float) -> np.ndarray:
    """An exponential average that goes on from before, or begins with the first value."""
    whole = x if before is None else np.r_[before, x]
    return pd.Series(whole).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(whole) - len(x) :]


@dataclass
class Past:
    """What the features of the next bar hang on."""

    returns: list[float]
    averages: tuple[float, float] | None = None
    #: The variance of the last return, and that return.
    variance: tuple[float, float] | None = None
    close: float | None = None
    regime: int | None = None


def advanced(bars: pd.DataFrame, past: Past, s: Settings, rule: Rule) -> tuple[pd.DataFrame, Past]:
    """Rows of OUT but for the symbol of bars (ts, close; in order of time, one at least) that come after past, and the past after them."""
    close = bars["close"].to_numpy(float)
    prior = np.r_[np.nan if past.close is None else past.close, close[:-1]]
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(prior != 0, close / prior - 1, np.nan)
    vol = pd.Series(np.r_[past.returns, r]).rolling(s.n, min_periods=s.n).std().to_numpy()[len(past.returns) :]
    before = past.averages or (None, None)
    fast, slow = (_recursion(close, b, 2 / (n + 1)) for b, n in zip(before, (s.fast, s.slow)))
    known, garch, variance = np.isfinite(r), np.full(len(r), np.nan), past.variance
    if known.any():
        own = r[known]
        path = garch_path(own, s.omega, s.alpha, s.beta, s.first_variance) if variance is None else garch_path(np.r_[variance[1], own], s.omega, s.alpha, s.beta, variance[0])[1:]
        garch[known], variance = np.sqrt(path), (float(path[-1]), float(own[-1]))
    out = pd.DataFrame({"ts": bars["ts"].to_numpy(), "close": close, "returns": r, "vol": vol, "fast": fast, "slow": slow, "macd": fast - slow, "garch_vol": garch})
    regime, confidence = rule(out)
    out["regime"], out["confidence"] = np.asarray(regime, int), np.asarray(confidence, float)
    out["before"] = pd.array([past.regime, *out["regime"].tolist()[:-1]], "Int64")
    out["event"] = np.where(out["before"].isna() | (out["before"] == out["regime"]).fillna(False).to_numpy(bool), "bar", "change")
    kept = [*past.returns, *r.tolist()][-s.n :]
    return out, Past(kept, (float(fast[-1]), float(slow[-1])), variance, float(close[-1]), int(out["regime"].iloc[-1]))


def _tidy(frames: Iterable[pd.DataFrame]) -> pd.DataFrame:
    frames = [f[["ts", "close"]] for f in frames]
    rows = pd.concat(frames) if frames else pd.DataFrame({"ts": pd.Series(dtype="datetime64[ns]"), "close": pd.Series(dtype=float)})
    return rows.dropna().sort_values(["ts", "close"], kind="stable").drop_duplicates("ts")


def _rows(symbol, out: pd.DataFrame) -> pd.DataFrame:
    out.insert(0, "symbol", symbol)
    return out


class _Monitor(StatefulProcessor):
    def __init__(self, s: Settings, rule: Rule, silent_ms: int, ttl_ms: int | None):
        self.s, self.rule, self.silent_ms, self.ttl_ms = s, rule, silent_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts timestamp, close double", self.ttl_ms)
        self.returns = handle.getListState("returns", "r double", self.ttl_ms)
        self.averages = handle.getValueState("averages", "fast double, slow double", self.ttl_ms)
        self.variance = handle.getValueState("variance", "v double, r double", self.ttl_ms)
        self.last = handle.getValueState("last", "ts timestamp, close double, regime int", self.ttl_ms)

    def close(self) -> None:
        pass

    def _past(self) -> Past:
        last = self.last.get() if self.last.exists() else (None, None, None)
        got = [float("nan") if r[0] is None else r[0] for r in self.returns.get()] if self.returns.exists() else []
        return Past(got, tuple(self.averages.get()) if self.averages.exists() else None, tuple(self.variance.get()) if self.variance.exists() else None, last[1], last[2])

    def _advance(self, key: tuple, bars: pd.DataFrame) -> pd.DataFrame:
        out, past = advanced(bars, self._past(), self.s, self.rule)
        self.returns.put([(r,) for r in past.returns])
        self.averages.update(past.averages)
        if past.variance:
            self.variance.update(past.variance)
        self.last.update((bars["ts"].iloc[-1].to_pydatetime(), past.close, past.regime))
        return _rows(key[0], out)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bars = _tidy(rows)
        if self.ttl_ms is not None:
            if self.last.exists():
                bars = bars[bars["ts"] > pd.Timestamp(self.last.get()[0])]
            if len(bars):
                yield self._advance(key, bars)
            return
        if not len(bars):
            return
        self.waiting.appendList([(t.to_pydatetime(), float(c)) for t, c in zip(bars["ts"], bars["close"])])
        at = _ms(bars["ts"].iloc[0])
        timers = list(self.handle.listTimers())
        if not any(t <= at for t in timers):
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = [b for b in held if _ms(pd.Timestamp(b[0])) <= now]
        later = [b for b in held if _ms(pd.Timestamp(b[0])) > now]
        if due:
            bars = _tidy([pd.DataFrame(due, columns=["ts", "close"])])
            if self.last.exists():
                bars = bars[bars["ts"] > pd.Timestamp(self.last.get()[0])]
            if len(bars):
                yield self._advance(key, bars)
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        last = self.last.get() if self.last.exists() else None
        if later:
            self._timer(min(_ms(pd.Timestamp(b[0])) for b in later), now)
        if last is None:
            return
        until = _ms(pd.Timestamp(last[0])) + self.silent_ms
        if until > now:
            self._timer(until, now)
        elif not later:
            yield pd.DataFrame([{"symbol": key[0], "ts": pd.Timestamp(last[0]), "close": last[1], "regime": last[2], "before": last[2], "event": "silent"}]).reindex(columns=[c.split()[0] for c in OUT.split(", ")])
            for state in (self.returns, self.averages, self.variance, self.last):
                state.clear()

    def _timer(self, at: int, now: int) -> None:
        at = max(at, now + 1)
        if at not in list(self.handle.listTimers()):
            self.handle.registerTimer(at)


def _ms(t: pd.Timestamp) -> int:
    """Milliseconds, rounded up: a bar is passed when the watermark, in whole milliseconds, is."""
    return -(-int(t.tz_localize(None).value if t.tzinfo else t.value) // 1_000_000)


def monitor(bars: DataFrame, rule: Rule, settings: Settings = Settings(), silent: str = "30 days", late: str | None = "10 minutes", ttl: str | None = None) -> DataFrame:
    """A row of OUT for each bar of a stream with symbol, ts and close: features, regime, confidence, the label before, and event, which is bar, change (an alert) or silent (the last row of a symbol whose state goes)."""
    ms = lambda x: int(pd.Timedelta(x).total_seconds() * 1000)
    rows = bars.select(F.col("symbol").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("close").cast("double").alias("close"))
    if ttl is None:
        rows = rows.withWatermark("ts", late)
    step = _Monitor(settings, rule, ms(silent), ms(ttl) if ttl else None)
    return rows.groupBy("symbol").transformWithStateInPandas(step, OUT, "Append", "ProcessingTime" if ttl else "EventTime")


def batch(bars: DataFrame, rule: Rule, settings: Settings = Settings()) -> DataFrame:
    """The same rows of a table of bars, without those of silence: a series is worked off in one pass."""

    def one(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = _tidy([own])
        if not len(own):
            return pd.DataFrame(columns=[c.split()[0] for c in OUT.split(", ")])
        return _rows(key[0], advanced(own, Past([]), settings, rule)[0])

    rows = bars.select(F.col("symbol").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("close").cast("double").alias("close"))
    return rows.groupBy("symbol").applyInPandas(one, OUT)


def alerts(rows: DataFrame) -> DataFrame:
    """symbol, ts, before, after and confidence of each change of regime."""
    return rows.where("event = 'change'").select("symbol", "ts", "before", F.col("regime").alias("after"), "confidence")
