"""Accounts over all symbols, rebalanced by timers."""

import datetime as dt
import random

import pytest
from tessera.streaming import market

DAY = dt.datetime(2024, 1, 1)
HOUR = 3_600_000


def momentum(closes):
    """Equal weights on the names that rose."""
    up = [s for s, c in closes.items() if len(c) > 1 and c[-1] > c[0]]
    return {s: 0.2 for s in up}


def brute(rows, every, cap, history):
    """All bars in order of time, a rebalance at each multiple of `every` hours."""
    out = []
    for account in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == account), key=lambda r: r[2])
        cash, position = 10_000.0, {}
        end = max(r[2] for r in own)
        at = DAY + dt.timedelta(hours=every * (int((own[0][2] - DAY).total_seconds() // 3600) // every + 1))
        while at <= end:
            closes = {}
            for _, s, t, c in own:
                if t < at:
                    closes[s] = [*closes.get(s, []), c][-history:]
            worth = cash + sum(q * closes[s][-1] for s, q in position.items())
            weights = momentum({s: closes[s] for s in sorted(closes)})
            for s in sorted(closes):
                notional = weights.get(s, 0.0) * worth
                qty = notional / closes[s][-1] - position.get(s, 0.0)
                if notional <= cap * worth and abs(qty) > 1e-9:
                    cash -= qty * closes[s][-1]
                    position[s] = position.get(s, 0.0) + qty
                    out.append((account, s, at, qty))
            at += dt.timedelta(hours=every)
    return out


def test_accounts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(a, s, DAY + dt.timedelta(hours=h), 100 + rng.random() * 10) for a in ("one", "two") for h in range(30) for s in "ABC" if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "account string, symbol string, ts timestamp, close double")
    for k in range(6):  # a file for each five hours, read one by one
        part = [r for r in rows if k * 5 <= (r[2] - DAY).total_seconds() / 3600 < k * 5 + 5]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/bars")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        bars = market.replay(spark, f"{tmp_path}/bars", df.schema)
        got = market.accounts(bars, momentum, every_ms=4 * HOUR, history=100)
        q = got.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    out = sorted(((r["account"], r["symbol"], r["ts"], r["qty"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=lambda r: (r[0], r[2], r[1]))
    want = [r for r in brute(rows, 4, 0.25, 100) if r[2] <= DAY + dt.timedelta(hours=28)]
    want = sorted(want, key=lambda r: (r[0], r[2], r[1]))
    assert [r[:3] for r in out] == [r[:3] for r in want]
    assert [r[3] for r in out] == pytest.approx([r[3] for r in want])
