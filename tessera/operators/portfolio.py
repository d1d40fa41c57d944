"""Allocators that solve a small problem per date: one grouped call each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cs, scans, ts


def shrunk(sample: np.ndarray, how: str = "diagonal", alpha: float = 0.5, returns: np.ndarray | None = None) -> np.ndarray:
    """Sample covariance shrunk to its diagonal, or to the mean variance with the
    intensity of Ledoit and Wolf (2004); a ridge of 1e-8."""
    n = len(sample)
    if how == "diagonal":
        out = (1 - alpha) * sample + alpha * np.diag(np.diag(sample))
    elif how == "mean":
        out = 0.9 * sample + 0.1 * np.trace(sample) / n * np.eye(n)
    elif how == "ledoit_wolf" and returns is not None:
        x = returns - returns.mean(axis=0)
        s = x.T @ x / len(x)
        target = np.trace(s) / n * np.eye(n)
        d2 = ((s - target) ** 2).sum()
        b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / len(x) ** 2, d2)
        k = b2 / d2 if d2 else 1.0
        out = k * target + (1 - k) * s
    else:
        out = sample
    return out + 1e-8 * np.eye(n)


def mean_variance(alpha: np.ndarray, cov: np.ndarray, risk: float = 1.0, leverage: float = 1.0, cap: float = 0.1, rounds: int = 400) -> np.ndarray:
    """max a'w - risk w'Sw with sum w = 0, |w|_1 <= leverage, |w| <= cap, by ADMM:
    a quadratic step on the balanced plane, a projection on the ball and box."""
    n, rho = len(alpha), max(float(np.trace(cov)) / len(alpha), 1e-6)
    k = np.zeros((n + 1, n + 1))
    k[:n, :n] = 2 * risk * cov + rho * np.eye(n)
    k[:n, n] = k[n, :n] = 1
    inv = np.linalg.inv(k)[:n, :n]
    z, u = np.zeros(n), np.zeros(n)
    for _ in range(rounds):
        w = inv @ (alpha + rho * (z - u))
        v, old = w + u, z
        z = _ball_box(v, leverage, cap)
        u = v - z
        if np.abs(z - old).max() < 1e-9 and np.abs(w - z).max() < 1e-7:
            break
    long, short = np.maximum(z, 0), np.maximum(-z, 0)
    side = min(long.sum(), short.sum())
    z = (long / long.sum() - short / short.sum()) * side if side > 0 else np.zeros(n)
    return np.where(np.abs(z) < 1e-4, 0.0, z)


def _ball_box(v: np.ndarray, leverage: float, cap: float) -> np.ndarray:
    a = np.abs(v)
    if np.minimum(a, cap).sum() <= leverage:
        return np.clip(v, -cap, cap)
    lo, hi = 0.0, float(a.max())
    for _ in range(60):
        t = (lo + hi) / 2
        lo, hi = (t, hi) if np.clip(a - t, 0, cap).sum() > leverage else (lo, t)
    return np.sign(v) * np.clip(a - hi, 0, cap)


def simplex_mean_variance(mu: np.ndarray, cov: np.ndarray, risk: float = 1.0, steps: int = 10_000) -> np.ndarray:
    """max mu'x - risk x'Sx on the simplex, by active sets: the free shares solve
    their equations; a share that would turn negative leaves on the way, the bound
    whose release gains most joins. Equal weights if the problem isn't finite."""
    n = len(mu)
    if not (np.isfinite(mu).all() and np.isfinite(cov).all()):
        return np.full(n, 1 / n)
    x = np.zeros(n)
    x[int(np.argmax(mu - risk * np.diag(cov)))] = 1.0
    free = x > 0
    scale = max(1e-300, np.abs(mu).max() + risk * np.abs(cov).max())
    for _ in range(steps):
        idx = np.flatnonzero(free)
        k = np.ones((len(idx) + 1, len(idx) + 1))
        k[:-1, :-1], k[-1, -1] = 2 * risk * cov[np.ix_(idx, idx)], 0
        want = np.linalg.lstsq(k, np.append(mu[idx], 1), rcond=None)[0][:-1]
        move = want - x[idx]
        stop = np.flatnonzero(move < -1e-15)
        room = x[idx[stop]] / -move[stop]
        if len(stop) and room.min() < 1:
            out = stop[int(np.argmin(room))]
            x[idx] = np.maximum(x[idx] + room.min() * move, 0)
            x[idx[out]], free[idx[out]] = 0.0, False
            continue
        x[idx] = np.maximum(want, 0)
        gain = mu - 2 * risk * cov @ x
        gain[free] = -np.inf
        best = int(np.argmax(gain))
        level = (mu - 2 * risk * cov @ x)[idx].max()
        if free.all() or gain[best] <= level + 1e-12 * scale:
            break
        free[best] = True
    return x / x.sum()


def _linear(alpha: np.ndarray, leverage: float, cap: float) -> np.ndarray:
    d = alpha - alpha.mean()
    total = np.abs(d).sum()
    w = np.clip(d / total * leverage, -cap, cap) if total else np.zeros(len(d))
    return np.where(np.abs(w) < 1e-4, 0.0, w)


def allocate(panel: DataFrame, score: str = "score", lookback: int = 30, risk: float = 1.0, leverage: float = 1.0, cap: float = 0.1) -> DataFrame:
    """(ts, symbol, weight, short) by mean-variance per date; the window of returns
    ends before the date. A short history (`short`), fewer than five active symbols
    with most of their returns, or fewer than two of these that move, fall back to
    the linear allocator; a failed solution is 0. A date with its window is one
    group, so its size is symbols x lookback."""
    w = W.partitionBy("symbol").orderBy("ts").rowsBetween(-lookback, -1)
    x = panel.withColumns({"_h": F.collect_list(F.struct("ts", F.coalesce("ret", F.lit(float("nan"))).alias("r"))).over(w)}).where(F.col(score).isNotNull())
    x = x.select("ts", "symbol", F.col(score).alias("a"), F.transform("_h", lambda v: v["r"]).alias("h"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("symbol")
        alpha = pdf["a"].to_numpy(float)
        size = max(map(len, pdf["h"]))
        hist = np.full((size, len(pdf)), np.nan)
        for j, h in enumerate(pdf["h"]):
            if len(h):
                hist[size - len(h) :, j] = h
        out, short = _linear(alpha, leverage, cap), size < max(5, lookback // 2)
        if not short:
            ok = (np.isnan(hist).mean(axis=0) < 0.2) & (alpha != 0)
            moves = ok & (np.nan_to_num(hist).var(axis=0, ddof=1) > 1e-8)
            if ok.sum() >= 5 and moves.sum() >= 2:
                cov = shrunk(np.cov(np.nan_to_num(hist[:, moves]), rowvar=False), "mean")
                out = np.zeros(len(pdf))
                try:
                    out[moves] = mean_variance(alpha[moves], cov, risk, leverage, cap)
                except np.linalg.LinAlgError:
                    pass
        return pd.DataFrame({"ts": pdf["ts"], "symbol": pdf["symbol"], "weight": out, "short": short})

    return x.groupBy("ts").applyInPandas(run, "ts timestamp, symbol string, weight double, short boolean")


def strategy_mix(returns: DataFrame, names: list[str], lookback: int = 60, risk: float = 1.0, ema: float = 1.0) -> DataFrame:
    """(ts, strategy, share): shares of strategies by simplex mean-variance over the
    returns before each date (equal with a short history), smoothed by a linear
    recursion. A date with its window is one group; the recursion is a scan."""
    wide = returns.groupBy("ts").pivot("strategy", names).agg(F.sum("ret")).fillna(0.0)
    past = W.partitionBy(F.lit(1)).orderBy("ts").rowsBetween(-lookback, -1)
    x = wide.select("ts", F.collect_list(F.array(*[F.col(f"`{n}`") for n in names])).over(past).alias("h"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for at, h in zip(pdf["ts"], pdf["h"], strict=True):
            share = np.full(len(names), 1 / len(names))
            if len(h) >= max(5, lookback // 2):
                r = np.array([list(v) for v in h], float)
                share = simplex_mean_variance(r.mean(axis=0), shrunk(np.cov(r, rowvar=False).reshape(len(names), -1), "diagonal"), risk)
            rows += [(at, n, float(v)) for n, v in zip(names, share, strict=True)]
        return pd.DataFrame(rows, columns=["ts", "strategy", "_raw"])

    raw = x.groupBy("ts").applyInPandas(run, "ts timestamp, strategy string, _raw double")
    if ema >= 1.0:
        return raw.withColumnRenamed("_raw", "share")
    return scans.exponential_means(raw, {"_raw": "share"}, ema, adjust=False, keys=["strategy"]).select("ts", "strategy", "share")


def blended(weights: DataFrame, shares: DataFrame) -> DataFrame:
    """(ts, symbol, score): z-scores of the strategies' non-zero weights, summed with
    their share(strategy, ts, share) of the date; NULL where no strategy has one."""
    z = cs.zscore(F.nullif(F.col("weight"), F.lit(0.0)), "strategy", "ts")
    return weights.withColumn("_z", z).join(F.broadcast(shares), ["strategy", "ts"]).groupBy("ts", "symbol").agg(F.sum(F.col("_z") * F.col("share")).alias("score"))


def equal_weight(weights: DataFrame, leverage: float = 1.0, cap: float = 0.1) -> DataFrame:
    """Mean over strategies, clipped, scaled down where gross exceeds leverage."""
    x = weights.groupBy("ts", "symbol").agg(F.avg("weight").alias("_w")).withColumn("_w", ts.clip("_w", -cap, cap))
    gross = F.sum(F.abs("_w")).over(cs.section())
    return x.select("ts", "symbol", (F.col("_w") * F.when(gross > leverage, leverage / gross).otherwise(1.0)).alias("weight"))


def combine(weights: DataFrame, panel: DataFrame, method: str = "linear", leverage: float = 1.0, cap: float = 0.1, risk: float = 1.0, lookback: int = 60, share_ema: float = 1.0, weight_ema: float = 1.0) -> DataFrame:
    """(ts, symbol, weight) from the weights(strategy, ts, symbol, weight) of several
    strategies, on the panel's grid. linear and mean_variance allocate the composite
    alpha, equal_weight scales it, cross_signal_mv first blends the strategies'
    z-scores by simplex mean-variance of their past returns. A date without any
    signal is flat. weight_ema smooths the outcome; flat dates, and those whose
    history is too short for the method, neither take part in it nor change it."""
    from . import backtest
    from . import weights as wt

    composite = wt.composite_alpha(weights)
    active = composite.groupBy("ts").agg(F.max(F.coalesce("score", F.lit(0.0)) != 0).alias("_on"))
    aside = active.where("NOT _on").select("ts")  # nothing to trade: flat, whatever the method
    if method == "equal_weight":
        out = equal_weight(composite.withColumnRenamed("score", "weight"), leverage, cap)
    elif method == "mean_variance":
        out = allocate(panel.select("ts", "symbol", "ret").join(composite, ["ts", "symbol"], "left"), "score", lookback, risk, leverage, cap)
        aside = aside.unionByName(out.where("short").select("ts").distinct())
    elif method == "linear":
        out = wt.linear(composite.where("score IS NOT NULL"), leverage, cap)
    elif method == "cross_signal_mv":
        names = [r[0] for r in weights.select("strategy").distinct().orderBy("strategy").collect()]  # a few strategies
        on = active.where("_on").select("ts")
        mix = strategy_mix(backtest.strategy_returns(weights, panel), names, lookback, risk)
        if share_ema < 1.0:  # flat dates leave the shares as they are
            mix = scans.exponential_means(mix.join(on, "ts", "left_semi"), {"share": "_s"}, share_ema, adjust=False, keys=["strategy"]).select("ts", "strategy", F.col("_s").alias("share"))
        out = wt.linear(blended(weights, mix).where("score IS NOT NULL"), leverage, cap)
    else:
        raise ValueError(f"unknown method {method}")
    flat = active.where("NOT _on").select("ts", F.lit(True).alias("_flat"))
    grid = panel.select("ts", "symbol").join(out.select("ts", "symbol", "weight"), ["ts", "symbol"], "left").join(F.broadcast(flat), "ts", "left")
    grid = grid.select("ts", "symbol", F.when(F.col("_flat"), 0.0).otherwise(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    if weight_ema >= 1.0:
        return grid
    aside = aside.unionByName(grid.select("ts").distinct().join(active, "ts", "left_anti"))  # dates without signals at all
    tagged = grid.withColumn("strategy", F.lit(method))
    return wt.smoothed(tagged, weight_ema, leverage, aside.withColumn("strategy", F.lit(method))).select("ts", "symbol", "weight")


def floor_to_step(qty, step: float):
    """Lots rounded towards zero to a step."""
    return F.signum(qty) * F.floor(F.abs(qty) / step + 1e-9) * step


def round_to_precision(qty, digits: int):
    return F.round(qty, digits)


def account_equity(positions: DataFrame, prices: DataFrame, cash: float = 0.0) -> DataFrame:
    """Cash plus quantities at the last price of each symbol."""
    last = prices.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    return positions.join(last, "symbol").agg((F.coalesce(F.sum(F.col("qty") * F.col("price")), F.lit(0.0)) + cash).alias("equity"))
