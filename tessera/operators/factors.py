"""Factors, regimes and the full factor panel.

The panel is staged so that each change of window key is one exchange: all
per-symbol windows on the bars, then per-date ones, then per-symbol windows on
those results, then per-date ones again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cs, scans, ts


@dataclass(frozen=True)
class Lookbacks:
    mom: int = 30
    smooth: int = 10
    vol: int = 30
    funding: int = 120
    funding_limit: float = 1.5
    beta: int = 60
    rev_ts: int = 80
    rev_sentiment: int = 40
    regime: int = 5
    threshold: float = 0.6
    halflife: float = 12
    skew: int = 45
    liquidity: int = 30


def ewms(df: DataFrame, columns: dict[str, str], halflife: float | None = None, alpha: float | None = None, adjust: bool = True, min_periods: int = 0, key: str = "symbol") -> DataFrame:
    """df with exponentially weighted means (column -> name of its mean) per
    symbol; weights decay over NULL rows too. (key, ts) is unique."""
    alpha = 1 - math.exp(math.log(0.5) / halflife) if alpha is None else alpha
    return scans.exponential_means(df, columns, alpha, adjust, min_periods, [key])


def ewm(df: DataFrame, column: str, out: str, halflife: float | None = None, alpha: float | None = None, adjust: bool = True, min_periods: int = 0, key: str = "symbol") -> DataFrame:
    return ewms(df, {column: out}, halflife, alpha, adjust, min_periods, key)


def beta(df: DataFrame, n: int = 60, out: str = "beta_60", ret: str = "ret", market: str = "mkt", limit: float = 3.0) -> DataFrame:
    """Rolling cov / var against the market; NULL is the date's mean; clipped."""
    b = F.try_divide(ts.cov(ret, market, n), F.nullif(ts.var(market, n), F.lit(0.0)))
    with_b = df.withColumn("_b", b)
    return with_b.withColumn(out, ts.clip(F.coalesce("_b", F.avg("_b").over(cs.section())), -limit, limit)).drop("_b")


def market_table(df: DataFrame) -> DataFrame:
    """One row per date: mean close return, mean volatility, dispersion."""
    return df.groupBy("ts").agg(
        F.avg("ret").alias("mkt_ret"), F.stddev_samp("ret").alias("dispersion"), F.avg("close").alias("close"), F.avg("high").alias("high"), F.avg("low").alias("low")
    )


def macro_candidates(df: DataFrame) -> DataFrame:
    """Per date: mean volatility, weekly liquidity, dispersion of returns."""
    daily = df.groupBy("ts").agg(F.avg("volatility_30").alias("mean_volatility"), F.sum(F.expm1("liquidity_log")).alias("_liq"), F.stddev_samp("ret").alias("dispersion"))
    return daily.withColumn("liquidity_7", ts.mean("_liq", 7, None, None)).drop("_liq")


def adx(bars: DataFrame, n: int = 14, key: str = "symbol") -> DataFrame:
    """bars with plus_di, minus_di and adx (Wilder averages, alpha 1/n)."""
    up, down = ts.diff("high", 1, key), -ts.diff("low", 1, key)
    pc = ts.lag("close", 1, key)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    x = bars.withColumns({"_tr": tr, "_up": up, "_dn": down})
    x = x.withColumns(
        {
            "_p": F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0),
            "_m": F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(0.0),
        }
    )
    x = ewms(x, {c: c + "e" for c in ("_tr", "_p", "_m")}, alpha=1 / n, adjust=False, key=key)
    di = lambda c: 100 * F.try_divide(F.col(c), F.nullif(F.col("_tre"), F.lit(0.0)))
    x = x.withColumns({"plus_di": di("_pe"), "minus_di": di("_me")})
    total = F.nullif(F.col("plus_di") + F.col("minus_di"), F.lit(0.0))
    x = x.withColumn("_dx", 100 * F.try_divide(F.abs(F.col("plus_di") - F.col("minus_di")), total))
    x = ewm(x, "_dx", "adx", alpha=1 / n, adjust=False, key=key)
    return x.drop("_tr", "_up", "_dn", "_p", "_m", "_tre", "_pe", "_me", "_dx")


#: Regime labels and their codes.
VOLATILITY_CODES = {"Low Volatility": 0, "Medium Volatility": 1, "High Volatility": 2}
TREND_CODES = {"Ranging": 0, "Weak Trend": 1, "Strong Trend": 2}
SKEW_CODES = {"Negative Skew": -1, "Neutral Skew": 0, "Positive Skew": 1}


def market_regimes(market: DataFrame, window: int | None = None, warmup: int = 120) -> DataFrame:
    """Volatility, trend and skew labels per date. The volatility is held against
    quartiles of the dates before (all, or `window`), from `warmup` values on; a
    date without a measure or threshold has the middle label."""
    m = market.withColumns({"volatility": ts.std("mkt_ret", 30, None, None), "skewness": ts.skew("mkt_ret", 90, None, None)})
    if window is None:
        m = m.join(scans.expanding_quantiles(m, "volatility", {"_lo": 0.25, "_hi": 0.75}, warmup), "ts", "left")
    else:
        m = m.withColumns({"_lo": ts.quantile_before("volatility", 0.25, window, warmup, None), "_hi": ts.quantile_before("volatility", 0.75, window, warmup, None)})
    m = adx(m.withColumn("_k", F.lit("market")), key="_k").drop("_k")
    return m.withColumns(
        {
            "volatility_regime": F.when(F.col("volatility") < F.col("_lo"), "Low Volatility").when(F.col("volatility") > F.col("_hi"), "High Volatility").otherwise("Medium Volatility"),
            "trend_regime": F.when(F.col("adx") > 25, "Strong Trend").when(F.col("adx") < 20, "Ranging").otherwise("Weak Trend"),
            "skew_regime": F.when(F.col("skewness") < -0.5, "Negative Skew").when(F.col("skewness") > 0.5, "Positive Skew").otherwise("Neutral Skew"),
        }
    ).drop("_lo", "_hi")


def encoded(df: DataFrame) -> DataFrame:
    """Ordinal codes of the regime labels, as FLOAT."""
    codes = {"volatility_regime": VOLATILITY_CODES, "trend_regime": TREND_CODES, "skew_regime": SKEW_CODES}

    def code(c: str) -> Column:
        out = F.lit(None).cast("float")
        for label, value in codes[c].items():
            out = F.when(F.col(c) == label, F.lit(value).cast("float")).otherwise(out)
        return out

    return df.withColumns({c.replace("_regime", "_regime_enc"): code(c) for c in codes})


#: The factors that get a *_delta companion.
DELTAS = (
    "volatility_30 vol_rank_cs price_roc oi_roc basis_norm basis_mom vol_ratio_sig trend_score sentiment_score combined_score mom_final_score ls_ratio rev_final_score liquidity_rank_cs"
).split()


def factor_panel(df: DataFrame, p: Lookbacks = Lookbacks()) -> DataFrame:
    """All base factors and deltas of a dense panel(ts, symbol, close, ret, mkt,
    volume, basis, volume_ratio, open_interest, funding_rate, ls_ratio)."""

    # 1. per symbol
    x = df.withColumns(
        {
            "ret_1d": F.col("ret"),
            "ret_5d": ts.pct_change("close", 5),
            "ret_20d": ts.pct_change("close", 20),
            "volatility_30": ts.std("ret", p.vol),
            "skewness_45": ts.skew("ret", p.skew, 30),
            "_dollar": F.col("close") * F.col("volume"),
            "_roc": ts.pct_change("close", p.mom),
            "_oroc": ts.pct_change("open_interest", p.mom),
            "basis_norm": F.when(F.col("close") > 0, F.col("basis") / F.col("close")),
            "_b0": F.coalesce("basis", F.lit(0.0)) / F.when(F.col("close") == 0, 1e-12).otherwise(F.col("close")),
            "_vr": ts.mean("volume_ratio", p.mom, max(p.mom // 2, 5)),
            "oi_pct_chg_1d": ts.pct_change("open_interest"),
            "ls_ratio": F.coalesce("ls_ratio", F.lit(1.0)),
            "_beta": F.try_divide(ts.cov("ret", "mkt", p.beta), F.nullif(ts.var("mkt", p.beta), F.lit(0.0))),
            "_ma5": ts.mean("close", p.regime),
            "_ma40": ts.mean("close", p.rev_sentiment, max(p.rev_sentiment // 2, 10)),
            "_sd40": ts.std("close", p.rev_sentiment, max(p.rev_sentiment // 2, 10)),
            "funding_z": F.try_divide(F.col("funding_rate") - ts.mean("funding_rate", p.funding, 20), F.nullif(ts.std("funding_rate", p.funding, 20), F.lit(0.0))),
        }
    )
    x = x.withColumns(
        {
            "_dv": ts.mean("_dollar", p.liquidity, 15),
            "price_roc": ts.mean("_roc", p.smooth),
            "oi_roc": ts.mean("_oroc", p.smooth),
            "basis_norm_smooth3": ts.mean("basis_norm", 3, 2),
            "_bd": ts.diff("_b0", p.mom),
            "vol_ratio_sig": F.tanh(ts.diff("_vr", p.mom)),
            "oi_pct_chg_smooth3": ts.mean("oi_pct_chg_1d", 3, 2),
            "ls_chg_1d": ts.diff("ls_ratio"),
        }
    )
    x = x.withColumns({"basis_mom": F.coalesce(ts.mean("_bd", p.smooth, 1), F.lit(0.0)), "ls_chg_smooth3": ts.mean("ls_chg_1d", 3, 2), "liquidity_log": F.log1p(F.greatest(F.lit(0.0), F.col("_dv")))})
    x = x.withColumn("liquidity_log", F.when(F.col("_dv").isNotNull(), F.col("liquidity_log")))
    x = x.withColumns({"trend_score": F.col("price_roc") * (1 + 2 * F.col("oi_roc")), "_sent": F.col("basis_mom") * F.col("vol_ratio_sig") * 5, "_reg": ts.clip(F.try_divide(F.col("_ma5") - F.col("_ma40"), F.nullif(F.col("_sd40"), F.lit(0.0))), -3.0, 3.0)})
    # 2. per date
    x = x.withColumns(
        {
            "vol_rank_cs": cs.rank_pct("volatility_30"),
            "liquidity_rank_cs": cs.rank_pct("_dv"),
            "beta_60": ts.clip(F.coalesce("_beta", F.avg("_beta").over(cs.section())), -3.0, 3.0),
            "sentiment_score": cs.residual("_sent", "trend_score"),
            "cs_z_oi_chg": cs.zscore("oi_pct_chg_1d"),
            "_regz": cs.zscore("_reg"),
        }
    )
    x = x.withColumns(
        {
            "combined_score": F.col("trend_score") + F.col("sentiment_score"),
            "regime_score": F.col("_reg") * F.tanh(F.col("_regz") / p.threshold),
        }
    )
    side = F.signum("combined_score") * F.col("funding_z")
    x = x.withColumn("funding_penalty", F.when(side < -2 * p.funding_limit, 0.5).when(side > p.funding_limit, 1.5).otherwise(1.0))
    x = x.withColumn("mom_final_score", cs.residual("combined_score", "beta_60"))
    # 3. per symbol, on the results of 2
    x = x.withColumn("ts_z_oi_chg", ts.zscore("cs_z_oi_chg", p.rev_ts))
    shock = F.when(F.col("ts_z_oi_chg").isNotNull(), F.greatest(F.lit(0.0), -F.col("ts_z_oi_chg") - 0.5))
    x = x.withColumn("liquidation_shock", shock).withColumn("interaction_alpha", F.col("liquidation_shock") * F.col("regime_score"))
    x = ewm(x.drop(*[c for c in x.columns if c.startswith("_")]), "interaction_alpha", "reversal_hawkes", halflife=p.halflife)
    # 4. per date, then the deltas of all per symbol
    x = x.withColumn("rev_final_score", cs.residual("reversal_hawkes", "beta_60"))
    return x.withColumns({f"{c}_delta": ts.delta(c) for c in DELTAS})


def with_regimes(panel: DataFrame, market: DataFrame) -> DataFrame:
    """The whole panel: factors with the regime labels of their date, market_adx,
    market_volatility and the codes. The market is one row per date, which a date
    without one takes from the last before it."""
    names = ["volatility_regime", "trend_regime", "skew_regime", "market_adx", "market_volatility"]
    m = market.select("ts", "volatility_regime", "trend_regime", "skew_regime", F.col("adx").alias("market_adx"), F.col("volatility").alias("market_volatility"))
    m = panel.select("ts").distinct().join(m, "ts", "left").withColumns({c: F.last(c, True).over(W.partitionBy(F.lit(1)).orderBy("ts")) for c in names})
    return encoded(panel.join(m, "ts"))


def live_scores(panel: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Last row of each symbol: score x volatility adjustment x penalties; near-zero
    funding also stops a symbol here."""
    names = ["mom_final_score", "vol_rank_cs", "funding_penalty", "funding_z", "ls_ratio"]
    last = panel.groupBy("symbol").agg(F.max("ts").alias("ts"), *[F.max_by(c, "ts").alias(c) for c in names])
    dead = F.abs("funding_z") < 0.1 * threshold
    crowd = F.when(F.col("ls_ratio") > 2, 0.5).otherwise(1.0)
    return last.withColumn("score", F.when(dead, 0.0).otherwise(F.col("mom_final_score") * (1 - 0.5 * F.coalesce("vol_rank_cs", F.lit(0.5))) * F.col("funding_penalty") * crowd))


def attach_quantile_regime(df: DataFrame, market: DataFrame, column: str, q: int = 3) -> DataFrame:
    """df with the quantile bin of a market series at its date (middle bin if the
    series has no spread). The edges are one row, the market one row per date."""
    e = market.agg(cs.edges(column, q).alias("_e"))
    lab = market.join(F.broadcast(e)).select("ts", F.when(F.size("_e") < 3, q // 2).otherwise(cs.cut(column, "_e")).alias(f"{column}_bin"))
    return df.join(lab, "ts", "left")


def column_normalised(df: DataFrame, columns: list[str], how: str = "cs", window: int = 60) -> DataFrame:
    """Columns as cross-sectional or time-series z-scores or centred ranks. A
    column without cross-sectional spread on over 80 % of dates is market-wide
    and gets a time-series z-score instead (decided by one aggregate)."""
    if how == "none":
        return df
    flat = set()
    if how in ("cs", "rank"):
        spread = df.groupBy("ts").agg(*[F.stddev_samp(c).alias(c) for c in columns])
        row = spread.agg(*[F.avg((F.coalesce(F.col(c), F.lit(0.0)) < 1e-8).cast("double")).alias(c) for c in columns]).first()
        flat = {c for c in columns if (row[c] or 0) > 0.8}
    pick = {"cs": cs.zscore, "rank": cs.rank_centred}
    return df.withColumns({c: ts.zscore(c, window, window // 4) if how == "ts" or c in flat else pick[how](c) for c in columns})


def last_rows(df: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("symbol").orderBy(F.col("ts").desc())
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
