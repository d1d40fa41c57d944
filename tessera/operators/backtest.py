"""Cost-aware backtests and performance figures."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cs, ts


def vectorised(weights: DataFrame, prices: DataFrame, cost_bps: float = 0.0007, cash: float = 10_000.0, lags: tuple[int, ...] = (1, 2, 3), charge_first: bool = False) -> DataFrame:
    """(ts, gross_k, turnover, net_k, equity_k) for each execution lag k. Weights
    of row t act k rows later; costs are not lagged. weights(ts, symbol, weight)
    and prices(ts, symbol, close) share a dense grid."""
    x = prices.select("ts", "symbol", "close").join(weights.select("ts", "symbol", "weight"), ["ts", "symbol"], "left")
    x = x.withColumns({"close": ts.ffill("close"), "weight": F.coalesce("weight", F.lit(0.0))})
    before = ts.lag("weight")
    x = x.withColumns({"_r": F.coalesce(ts.pct_change("close"), F.lit(0.0)), "_t": F.abs(F.col("weight") - (F.coalesce(before, F.lit(0.0)) if charge_first else before)), **{f"_w{k}": F.coalesce(ts.lag("weight", k), F.lit(0.0)) for k in lags}})
    day = x.groupBy("ts").agg(F.coalesce(F.sum("_t"), F.lit(0.0)).alias("turnover"), *[F.sum(F.col(f"_w{k}") * F.col("_r")).alias(f"gross_{k}") for k in lags])
    day = day.withColumns({f"net_{k}": F.col(f"gross_{k}") - F.col("turnover") * cost_bps for k in lags})
    return day.withColumns({f"equity_{k}": cash * ts.cumulative_product(f"net_{k}", None) for k in lags})


def summary(day: DataFrame, k: int = 1, periods: int = 365) -> DataFrame:
    """One row: final equity, return in percent, Sharpe ratio, win rate, turnover.
    The first day's return counts as 0, as the equity curve starts there."""
    w = W.partitionBy(F.lit(1)).orderBy("ts")
    x = day.withColumn("_r", F.coalesce(F.try_divide(F.col(f"equity_{k}"), F.lag(f"equity_{k}").over(w)) - 1, F.lit(0.0)))
    r = F.stddev_samp("_r")
    return x.agg(
        F.max_by(f"equity_{k}", "ts").alias("final_equity"),
        ((F.max_by(f"equity_{k}", "ts") / F.min_by(f"equity_{k}", "ts") - 1) * 100).alias("return_pct"),
        F.coalesce(F.try_divide(F.avg("_r"), F.nullif(r, F.lit(0.0))) * math.sqrt(periods), F.lit(0.0)).alias("sharpe"),
        F.avg((F.col("_r") > 0).cast("double")).alias("win_rate"),
        F.avg("turnover").alias("turnover_avg"),
    )


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def probabilistic_sharpe(returns: DataFrame, column: str, benchmark: float = 1.0) -> float | None:
    """Probability that the true Sharpe ratio exceeds the benchmark; None for
    fewer than 3 rows. Spark makes the moments; the CDF is one driver call."""
    n, m, s, g1, g2 = returns.agg(F.count(column), F.avg(column), F.stddev_samp(column), F.skewness(column), F.kurtosis(column)).first()
    if n < 4:
        return None
    skew = (g1 or 0.0) * math.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (g2 or 0.0) + 6)
    sr = m / (s + 1e-12)
    under = (1 - skew * sr + kurt / 4 * sr**2) / (n - 1)
    return normal_cdf((sr - benchmark) / math.sqrt(under)) if under > 1e-24 else None


def lag_decay(weights: DataFrame, prices: DataFrame, lags=(0, 1, 2, 3), cost_bps: float = 0.0007) -> DataFrame:
    """(lag, total, mean, std) with costs shifted along with the lag."""
    x = prices.select("ts", "symbol", "close").join(weights.select("ts", "symbol", "weight"), ["ts", "symbol"], "left")
    x = x.withColumns({"close": ts.ffill("close"), "weight": F.coalesce("weight", F.lit(0.0))})
    x = x.withColumns({"_r": F.coalesce(ts.pct_change("close"), F.lit(0.0)), "_t": F.coalesce(F.abs(ts.diff("weight")), F.lit(0.0))})
    x = x.withColumns({f"_w{k}": F.coalesce(ts.lag("weight", k), F.lit(0.0)) for k in lags} | {f"_c{k}": F.coalesce(ts.lag("_t", k), F.lit(0.0)) for k in lags})
    day = x.groupBy("ts").agg(*[(F.sum(F.col(f"_w{k}") * F.col("_r")) - cost_bps * F.sum(f"_c{k}")).alias(f"n{k}") for k in lags])
    stack = ", ".join(f"{k}, n{k}" for k in lags)
    return day.selectExpr(f"stack({len(lags)}, {stack}) AS (lag, net)").groupBy("lag").agg(F.sum("net").alias("total"), F.avg("net").alias("mean"), F.stddev_samp("net").alias("std"))


def trimmed(day: DataFrame, start: str, k: int = 1, cash: float = 10_000.0) -> DataFrame:
    """The curve from a date on, rebased to cash."""
    w = W.partitionBy(F.lit(1)).orderBy("ts").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = day.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    return x.withColumn(f"equity_{k}", F.col(f"equity_{k}") * cash / F.first(f"equity_{k}").over(w))


def strategy_returns(weights: DataFrame, prices: DataFrame) -> DataFrame:
    """(strategy, ts, ret): lagged weights times returns, summed."""
    w = W.partitionBy("strategy", "symbol").orderBy("ts")
    r = prices.select("ts", "symbol", F.coalesce("ret", F.lit(0.0)).alias("_r"))
    x = weights.withColumn("_w", F.lag("weight").over(w)).join(r, ["ts", "symbol"])
    return x.groupBy("strategy", "ts").agg(F.coalesce(F.sum(F.col("_w") * F.col("_r")), F.lit(0.0)).alias("ret"))


def quantile_forward(panel: DataFrame, factor: str, q: int = 5, signed: bool = True, demean: bool = False) -> DataFrame:
    """(ts, bucket, ret, cumulative): mean next return of each factor bucket."""
    x = panel.withColumn("_f", ts.lead("ret")).where(F.col(factor).isNotNull())
    if demean:
        x = x.withColumn("_f", cs.demean("_f"))
    x = x.withColumn("_x", F.col(factor) if signed else F.abs(factor)).withColumn("bucket", cs.bucket("_x", q))
    day = x.groupBy("ts", "bucket").agg(F.coalesce(F.avg("_f"), F.lit(0.0)).alias("ret"))
    return day.withColumn("cumulative", F.sum("ret").over(W.partitionBy("bucket").orderBy("ts")))


def long_short_spread(buckets: DataFrame, q: int = 5) -> DataFrame:
    """quantile_forward's table -> (ts, spread, cumulative): top less bottom bucket."""
    day = buckets.groupBy("ts").agg(F.sum(F.when(F.col("bucket") == q, F.col("ret"))).alias("_t"), F.sum(F.when(F.col("bucket") == 1, F.col("ret"))).alias("_b"))
    day = day.select("ts", (F.coalesce("_t", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))).alias("spread"))
    return day.withColumn("cumulative", F.sum("spread").over(W.partitionBy(F.lit(1)).orderBy("ts")))


def traded_contribution(panel: DataFrame, factor: str, q: int = 3, qty: str = "position_qty", as_weights: bool | None = None) -> DataFrame:
    """(ts, bucket, pnl): summed contribution of names held, by rank of |factor|.
    Weights count times return, holdings times price change; if not told, all
    quantities below 5 are weights, which one aggregate decides."""
    if as_weights is None:
        as_weights = (panel.agg(F.max(F.abs(qty))).first()[0] or 0.0) < 5
    gain = ts.lead("ret") if as_weights else ts.lead("close") - F.col("close")
    x = panel.withColumn("_g", gain).withColumn("_x", F.when(F.col(qty) != 0, F.abs(factor))).where("_x IS NOT NULL")
    return x.withColumn("bucket", cs.bucket("_x", q)).groupBy("ts", "bucket").agg(F.coalesce(F.sum(F.col(qty) * F.col("_g")), F.lit(0.0)).alias("pnl"))


class Ledger:
    """Paper account: slippage multiplies buys and divides sells, fees on
    notional, average price, profit on reduction, regimes of the entry."""

    def __init__(self, cash: float, fee_bps: float = 5.0, slippage_bps: float = 2.0):
        self.cash, self.fee, self.slip, self.pos = cash, fee_bps / 1e4, 1 + slippage_bps / 1e4, {}

    def trade(self, symbol: str, qty: float, price: float, regimes: tuple = ()) -> dict:
        """A signed quantity at a price; the fill."""
        fill = price * self.slip if qty > 0 else price / self.slip
        held, avg, entry = self.pos.get(symbol, (0.0, 0.0, regimes))
        if abs(held) < 1e-9:
            entry = regimes
        fee = abs(qty) * fill * self.fee
        pnl = 0.0
        if held == 0 or held * qty > 0:
            avg = (avg * abs(held) + fill * abs(qty)) / (abs(held) + abs(qty))
        else:
            pnl = (fill - avg) * min(abs(qty), abs(held)) * (1 if held > 0 else -1)
        self.cash += pnl - fee
        left = held + qty
        self.pos[symbol] = (left, avg, entry) if abs(left) >= 1e-9 else (0.0, 0.0, ())
        return {"symbol": symbol, "side": "BUY" if qty > 0 else "SELL", "qty": abs(qty), "price": fill, "fee": fee, "pnl": pnl, "regimes": entry}

    def equity(self, prices: dict[str, float]) -> float:
        return self.cash + sum(q * prices[s] for s, (q, _, _) in self.pos.items() if s in prices)


def event_driven(weights: DataFrame, prices: DataFrame, cash: float = 10_000.0, every: int = 1, fee_bps: float = 5.0, slippage_bps: float = 2.0) -> DataFrame:
    """(strategy, ts, equity, n_fills): dates in order through one ledger per
    strategy. Cash couples all symbols, so a strategy is one group."""
    x = weights.join(prices.select("ts", "symbol", "close"), ["ts", "symbol"]).where("close IS NOT NULL").select("strategy", "ts", "symbol", "weight", "close")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        book, rows = Ledger(cash, fee_bps, slippage_bps), []
        last: dict[str, float] = {}
        for i, (at, day) in enumerate(pdf.sort_values(["ts", "symbol"]).groupby("ts")):
            last |= dict(zip(day["symbol"], day["close"], strict=True))
            equity, fills = book.equity(last), 0
            if i % every == 0:
                for sym, weight, price in zip(day["symbol"], day["weight"], day["close"], strict=True):
                    delta = weight * equity / price - book.pos.get(sym, (0.0,))[0]
                    if abs(delta) > 1e-9:
                        book.trade(sym, delta, price)
                        fills += 1
            rows.append((pdf["strategy"].iloc[0], at, equity, fills))
        return pd.DataFrame(rows, columns=["strategy", "ts", "equity", "n_fills"])

    return x.groupBy("strategy").applyInPandas(run, "strategy string, ts timestamp, equity double, n_fills long")


def grid_search(panel: DataFrame, strategy, parameters: list[dict], run) -> list[tuple[dict, dict]]:
    """(parameters, summary) of run(strategy(panel, **p)) for each set; one that
    fails has {"error": why} in place of its summary. The sets are Spark jobs of
    their own, a few at a time from driver threads, so they share the cluster."""

    def one(p: dict) -> tuple[dict, dict]:
        try:
            return p, run(strategy(panel, **p)).first().asDict()
        except (ValueError, ArithmeticError, PySparkException) as e:
            return p, {"error": str(e)[:200]}

    with ThreadPoolExecutor(4) as pool:
        return list(pool.map(one, parameters))
