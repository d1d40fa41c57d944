"""Structured Streaming over bars and ticks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Fixed value: the fields of a kline message.
MESSAGE = "s string, k struct<t: bigint, o: string, h: string, l: string, c: string, v: string, x: boolean>"


def closed_bars(messages: DataFrame, value: str = "value") -> DataFrame:
    """Bars of kline messages (JSON text), only those that are final."""
    m = messages.select(F.from_json(F.col(value).cast("string"), MESSAGE).alias("m")).where("m.k.x")
    number = lambda c: F.col(f"m.k.{c}").try_cast("double")
    return m.select(F.col("m.s").alias("symbol"), F.timestamp_millis("m.k.t").alias("ts"), number("o").alias("open"), number("h").alias("high"), number("l").alias("low"), number("c").alias("close"), number("v").alias("volume"))


def deduplicated(bars: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """One bar per symbol and time; state goes with the watermark."""
    return bars.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["symbol", "ts"])


def replay(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Stored files as a stream, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ohlcv(ticks: DataFrame, width: str = "1 hour", slide: str | None = None, lateness: str = "2 hours", key: str = "symbol", value: str = "value", tie: str = "event_id") -> DataFrame:
    """Bars from ticks in tumbling or sliding windows; late ticks within the
    watermark count. Works on streams and on tables alike."""
    at = F.struct("ts", tie)
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy(win.alias("w"), key)
        .agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").cast("double").alias("volume"))
        .select(F.col("w.start").alias("ts"), F.col(key).alias("symbol"), "open", "high", "low", "close", "volume")
    )


def sessions(ticks: DataFrame, gap: str = "30 minutes", lateness: str = "2 hours", key: str = "user_id") -> DataFrame:
    return ticks.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


_ORDERS = "symbol string, ts timestamp, qty double, price double, position double"
_STATE = "position double, cash double, closes array<double>"


def orders(bars: DataFrame, target, history: int = 30, equity: float = 10_000.0, cap: float = 0.25, band: float = 1e-9) -> DataFrame:
    """Orders from a per-bar strategy: target(closes) is a weight of the symbol's
    account (cash and position at the bar's close), clamped to [0, 1]; the order is
    the difference to the position held, unless it lies in the dead band or the new
    position would exceed cap of the account (risk gate). Each symbol's account
    starts with `equity`; fills are at the close."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        position, cash, closes = state.get if state.exists else (0.0, equity, [])
        closes, rows = list(closes), []
        for bar in pd.concat(list(batches)).sort_values("ts").itertuples():
            closes = [*closes, bar.close][-history:]
            weight = min(1.0, max(0.0, float(target(closes))))
            worth = cash + position * bar.close
            notional = weight * worth
            if notional > cap * worth:
                continue
            qty = notional / bar.close - position
            if abs(qty) > band:
                position += qty
                cash -= qty * bar.close
                rows.append((key[0], bar.ts, qty, bar.close, position))
        state.update((position, cash, closes))
        yield pd.DataFrame(rows, columns=["symbol", "ts", "qty", "price", "position"])

    return bars.groupBy("symbol").applyInPandasWithState(step, _ORDERS, _STATE, "append", GroupStateTimeout.NoTimeout)


_FILLS = "account string, symbol string, ts timestamp, qty double, price double, position double, cash double"


class Account(StatefulProcessor):
    """An account over all its symbols, rebalanced by event-time timers.

    Bars only update what is known of their symbol; at each multiple of `every` that
    the watermark passes, target(closes by symbol) gives the weights of the account
    from bars before that time, and the differences to the positions held become
    orders at the last close, unless they lie in the dead band or the position would
    exceed `cap` of the account (risk gate). A symbol without bars for `idle` is
    forgotten once it isn't held. State is a row a symbol, and a timer an account."""

    def __init__(self, target, every_ms: int, equity: float, history: int, cap: float, band: float, idle_ms: int):
        self.target, self.every, self.equity = target, every_ms, equity
        self.history, self.cap, self.band, self.idle = history, cap, band, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "symbol string", "ts array<bigint>, closes array<double>")
        self.positions = handle.getMapState("positions", "symbol string", "qty double")
        self.cash = handle.getValueState("cash", "cash double")
        self.next = handle.getValueState("next", "ms bigint")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for pdf in rows:
            for symbol, own in pdf.sort_values("ts").groupby("symbol"):
                name = (symbol,)
                held = self.bars.getValue(name) if self.bars.containsKey(name) else ([], [])
                new = {int(t.timestamp() * 1000): float(c) for t, c in zip(own["ts"], own["close"], strict=True)}
                known = dict(zip(held[0], held[1], strict=True)) | new
                times = sorted(known)[-self.history :]
                self.bars.updateValue(name, (times, [known[t] for t in times]))
                first = min(new) if first is None else min(first, *new)
        if first is not None and not self.next.exists():
            self._wait(first)
        yield pd.DataFrame()

    def _wait(self, after_ms: int) -> None:
        at = (after_ms // self.every + 1) * self.every
        self.next.update((at,))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        bars = {name[0]: held for name, held in self.bars.iterator()}
        seen = max(t[-1] for t, _ in bars.values())
        cash = self.cash.get()[0] if self.cash.exists() else self.equity
        position = {name[0]: qty[0] for name, qty in self.positions.iterator()}
        rows = []
        while True:  # a late watermark passes several times at once
            cash = self._rebalance(key[0], now, bars, position, cash, rows)
            if seen < now or now + self.every > passed:
                break
            now += self.every
        for symbol in {r[1] for r in rows}:
            self.positions.updateValue((symbol,), (position[symbol],))
        for symbol, (times, _) in bars.items():
            if times[-1] < now - self.idle and not position.get(symbol):
                self.bars.removeKey((symbol,))
        self.cash.update((cash,))
        if seen >= now:  # bars that this time didn't use ask for another
            self._wait(now)
        else:
            self.next.clear()
        yield pd.DataFrame(rows, columns=["account", "symbol", "ts", "qty", "price", "position", "cash"])

    def _rebalance(self, account: str, now: int, bars: dict, position: dict, cash: float, rows: list) -> float:
        """Appends the orders of one time; the cash after them."""
        before = {s: [c for t, c in zip(times, values, strict=True) if t < now] for s, (times, values) in sorted(bars.items())}
        closes = {s: c for s, c in before.items() if c}
        worth = cash + sum(q * closes[s][-1] for s, q in position.items())
        weights = self.target(closes)
        for symbol, values in closes.items():
            price, held = values[-1], position.get(symbol, 0.0)
            notional = float(weights.get(symbol, 0.0)) * worth
            qty = notional / price - held
            if abs(notional) <= self.cap * worth and abs(qty) > self.band:
                cash -= qty * price
                position[symbol] = held + qty
                rows.append((account, symbol, pd.Timestamp(now, unit="ms"), qty, price, held + qty, cash))
        return cash


def accounts(bars: DataFrame, target, every_ms: int = 60_000, equity: float = 10_000.0, history: int = 30, cap: float = 0.25, band: float = 1e-9, idle_ms: int = 86_400_000, lateness: str = "0 seconds") -> DataFrame:
    """Orders of accounts from a stream bars(account, symbol, ts, close): see Account.
    It needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    rows = bars.select("account", "symbol", "ts", "close").withWatermark("ts", lateness)
    return rows.groupBy("account").transformWithStateInPandas(Account(target, every_ms, equity, history, cap, band, idle_ms), _FILLS, "Append", "EventTime")


def rebalance(bars: DataFrame, act, every: str = "60 seconds", checkpoint: str | None = None):
    """Run act(batch, batch_id) on each micro-batch at a fixed interval."""
    w = bars.writeStream.foreachBatch(act).trigger(processingTime=every)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
