"""More panel queries: reports, health of factors, grids, combinations, training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import cs, ts
from .ml import training as ml
from .operators import backtest as bt
from .operators import calendar as cal
from .operators import factors as fac
from .operators import joins, portfolio, reports
from .operators import weights as wt
from .plans import bars as B
from .registry import _ALL, _ALPHA, _CODES, _COV, _IC, _LW, _MIX, _SRET, _TWO, BARS, BT, DAILY, FACTORS, IMP, PANEL, REGIMES, WDENSE, _calendar, _daily, _epochs, _factors, _importance, _regimes, _scores, _smooth_sql, _two, _w, _weights_sql, g, over, pct_sql, query, resid_sql, zs

ONE = "one AS (SELECT 1)"

# ---- filters and reshapes ---------------------------------------------------------


@query("symbol_names", "symbol name", "n", "a AS (SELECT CASE WHEN p_size % 2 = 0 THEN '1000' || p_brand ELSE p_brand END AS symbol FROM part), final AS (SELECT symbol, CASE WHEN starts_with(symbol, '1000') THEN substr(symbol, 5) ELSE symbol END AS name, count(*) AS n FROM a GROUP BY ALL)", base=ONE)
def _(spark, d):
    x = B.read(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("1000"), "p_brand")).otherwise(F.col("p_brand")).alias("symbol"))
    return x.withColumn("name", cal.normalized_symbol("symbol")).groupBy("symbol", "name").agg(F.count("*").alias("n"))


@query("date_range", "ts symbol", "close", "final AS (SELECT * FROM bars WHERE ts BETWEEN TIMESTAMP '1995-01-02' AND TIMESTAMP '1996-12-30')", base=BARS)
def _(spark, d):
    return B.weekly_bars(spark, d).where(F.col("ts").between(F.lit("1995-01-02").cast("timestamp"), F.lit("1996-12-30").cast("timestamp")))


@query("dates_in", "ts symbol", "close", "final AS (SELECT * FROM bars WHERE ts IN (SELECT max(ts) FROM bars GROUP BY date_trunc('quarter', ts)))", base=BARS)
def _(spark, d):
    x = B.weekly_bars(spark, d)
    ends = x.groupBy(F.date_trunc("quarter", "ts")).agg(F.max("ts").alias("ts")).select("ts")
    return x.join(ends, "ts", "left_semi")


@query("infinite_to_null", "ts symbol", "a b", "final AS (SELECT ts, symbol, CASE WHEN volume > 100 THEN NULL ELSE volume END AS a, CASE WHEN close < 1500 THEN NULL ELSE close END AS b FROM bars)", base=BARS)
def _(spark, d):
    x = B.weekly_bars(spark, d).select("ts", "symbol", F.when(F.col("volume") > 100, float("inf")).otherwise(F.col("volume")).alias("a"), F.when(F.col("close") < 1500, float("nan")).otherwise(F.col("close")).alias("b"))
    return cal.clean(x)


@query("last_rows", "ts symbol", "close", "final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) WHERE k <= 30)", base=BARS)
def _(spark, d):
    return fac.last_rows(B.weekly_bars(spark, d), 30)


_PART = "SELECT CAST(ts AS TIMESTAMP) AS ts, event_type AS symbol, max(value) AS {} FROM events WHERE event_id % 4 = {} GROUP BY ALL"


@query("asof_chain", "ts symbol", "futures_close close_spot open_interest funding_rate basis volume_ratio", f"""a AS ({_PART.format("futures_close", 0)}), s AS ({_PART.format("close_spot", 1)}), o AS ({_PART.format("open_interest", 2)}), f AS ({_PART.format("funding_rate", 3)}),
  a1 AS (SELECT a.*, s.close_spot FROM a ASOF LEFT JOIN s ON a.symbol = s.symbol AND a.ts >= s.ts), a2 AS (SELECT a1.*, o.open_interest FROM a1 ASOF LEFT JOIN o ON a1.symbol = o.symbol AND a1.ts >= o.ts), a3 AS (SELECT a2.*, f.funding_rate FROM a2 ASOF LEFT JOIN f ON a2.symbol = f.symbol AND a2.ts >= f.ts),
  final AS (SELECT *, futures_close - close_spot AS basis, futures_close / (CASE WHEN close_spot = 0 THEN 1e-12 ELSE close_spot END) AS volume_ratio FROM a3)""", base=ONE)  # fmt: skip
def _(spark, d):
    ev = B.read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), "value")
    part = lambda k, *names: ev.where(F.col("event_id") % 4 == k).groupBy("ts", "symbol").agg(*[F.max("value").alias(n) for n in names])
    return joins.merged_market(part(0, "futures_close", "futures_volume"), part(1, "close_spot", "volume_spot"), part(2, "open_interest"), part(3, "funding_rate"))


# ---- factors ------------------------------------------------------------------------


@query("residual_variants", "ts symbol", "all_rows nonzero neutral", f"""r1 AS (SELECT *, CASE WHEN symbol < 'Brand#3' THEN ret ELSE nullif(ret, ret) END AS y FROM p), r2 AS (SELECT *, CASE WHEN y IS NOT NULL AND basis IS NOT NULL THEN y END AS a, CASE WHEN y IS NOT NULL THEN basis END AS b FROM r1),
  final AS (SELECT ts, symbol, CASE WHEN count(a) OVER (PARTITION BY ts) >= 2 AND var_pop(b) OVER (PARTITION BY ts) >= 1e-8 AND a IS NOT NULL THEN y - (regr_slope(a, b) OVER (PARTITION BY ts) * basis + regr_intercept(a, b) OVER (PARTITION BY ts)) ELSE y END AS all_rows,
  CASE WHEN y IS NOT NULL THEN {resid_sql("y", "basis")} END AS nonzero, {resid_sql("y", "funding_rate")} AS neutral FROM r2)""")  # fmt: skip
def _(spark, d):
    x = B.panel(spark, d).withColumn("y", F.when(F.col("symbol") < "Brand#3", F.col("ret")))
    return x.withColumns({"all_rows": cs.residual("y", "basis", active="all", fill_zero=False), "nonzero": cs.residual("y", "basis", fill_zero=False), "neutral": cs.residual("y", "funding_rate")})


@query("quantile_regime", "ts symbol", "label", "m AS (SELECT ts, avg(volume) AS v FROM p GROUP BY ts), e AS (SELECT quantile_cont(v, 1 / 3.0) AS lo, quantile_cont(v, 2 / 3.0) AS hi FROM m), final AS (SELECT p.ts, p.symbol, CASE WHEN v IS NULL THEN -1 WHEN v > hi THEN 2 WHEN v > lo THEN 1 ELSE 0 END AS label FROM p JOIN m USING (ts), e)")
def _(spark, d):
    x = B.panel(spark, d)
    return fac.attach_quantile_regime(x, x.groupBy("ts").agg(F.avg("volume").alias("v")), "v").withColumnRenamed("v_bin", "label")


_Z = "(ret - avg(ret) OVER (PARTITION BY ts)) / nullif(stddev_samp(ret) OVER (PARTITION BY ts), 0)"


@query("normalised_features", "ts symbol", "ret mkt vol", f"final AS (SELECT ts, symbol, {_Z} AS ret, {zs('mkt', 60, 15)} AS mkt, (volume - avg(volume) OVER (PARTITION BY ts)) / nullif(stddev_samp(volume) OVER (PARTITION BY ts), 0) AS vol FROM p)")
def _(spark, d):
    return fac.column_normalised(B.panel(spark, d).withColumn("vol", F.col("volume")), ["ret", "mkt", "vol"])


@query("normalised_ranks", "ts symbol", "ret basis", f"final AS (SELECT ts, symbol, {pct_sql('ret')} - 0.5 AS ret, {pct_sql('basis')} - 0.5 AS basis FROM p)")
def _(spark, d):
    return fac.column_normalised(B.panel(spark, d), ["ret", "basis"], "rank")


@query("ls_factors", "ts symbol", "ls_ratio ls_chg_1d ls_chg_smooth3", f"l AS (SELECT ts, symbol, coalesce(ls_ratio, 1) AS ls_ratio FROM p), l2 AS (SELECT *, ls_ratio - lag(ls_ratio) {_LW} AS ls_chg_1d FROM l), final AS (SELECT *, {g('avg', 'ls_chg_1d', 3, 2)} AS ls_chg_smooth3 FROM l2)")
def _(spark, d):
    return _factors(spark, d)


_PROXY = ("Brand#11", "Brand#22", "Brand#33")
_PROXY_SQL = PANEL.replace("avg(ret) OVER (PARTITION BY ts) AS mkt", "avg(CASE WHEN symbol IN ('Brand#11', 'Brand#22', 'Brand#33') THEN ret END) OVER (PARTITION BY ts) AS mkt")


@query("beta_three_symbols", "ts symbol", "mkt beta_60", f"b AS (SELECT ts, symbol, mkt, ({_COV}) / nullif({g('var_samp', 'mkt', 60)}, 0) AS beta FROM p), final AS (SELECT *, CASE WHEN coalesce(beta, avg(beta) OVER (PARTITION BY ts)) IS NOT NULL THEN greatest(-3, least(3, coalesce(beta, avg(beta) OVER (PARTITION BY ts)))) END AS beta_60 FROM b)", base=_PROXY_SQL)
def _(spark, d):
    return fac.beta(B.panel(spark, d, _PROXY))


@query("full_panel", "ts symbol volatility_regime trend_regime skew_regime", "mom_final_score rev_final_score market_adx market_volatility volatility_regime_enc trend_regime_enc skew_regime_enc", f"{FACTORS}, {REGIMES}, final AS (SELECT x9.ts, x9.symbol, mom_final_score, rev_final_score, volatility_regime, trend_regime, skew_regime, last_value(adx IGNORE NULLS) OVER (PARTITION BY x9.symbol ORDER BY x9.ts) AS market_adx, last_value(volatility IGNORE NULLS) OVER (PARTITION BY x9.symbol ORDER BY x9.ts) AS market_volatility, {_CODES} FROM x9 JOIN reg ON x9.ts = reg.ts)")
def _(spark, d):
    return fac.with_regimes(_factors(spark, d), _regimes(spark, d))


# ---- weights, combination, risk ----------------------------------------------------------


@query("combine_linear", "ts symbol", "weight", f"{_TWO}, {_ALPHA}, q1 AS (SELECT ts, symbol, score - avg(score) OVER (PARTITION BY ts) AS d FROM al WHERE score IS NOT NULL), q2 AS (SELECT *, coalesce(d / nullif(sum(abs(d)) OVER (PARTITION BY ts), 0), 0) AS w FROM q1), q3 AS (SELECT ts, symbol, CASE WHEN abs(greatest(-0.1, least(0.1, w))) < 1e-4 THEN 0 ELSE greatest(-0.1, least(0.1, w)) END AS weight FROM q2), final AS (SELECT p.ts, p.symbol, coalesce(weight, 0) AS weight FROM p LEFT JOIN q3 USING (ts, symbol))")
def _(spark, d):
    return portfolio.combine(_two(spark, d), B.panel(spark, d), "linear")


@query("combine_equal_weight", "ts symbol", "weight", f"{_TWO}, {_ALPHA}, e1 AS (SELECT ts, symbol, greatest(-0.1, least(0.1, score)) AS w FROM al WHERE score IS NOT NULL), e2 AS (SELECT ts, symbol, w * CASE WHEN sum(abs(w)) OVER (PARTITION BY ts) > 1 THEN 1 / sum(abs(w)) OVER (PARTITION BY ts) ELSE 1 END AS weight FROM e1), final AS (SELECT p.ts, p.symbol, coalesce(weight, 0) AS weight FROM p LEFT JOIN e2 USING (ts, symbol))")
def _(spark, d):
    return portfolio.combine(_two(spark, d), B.panel(spark, d), "equal_weight")


@query("combine_mean_variance", "ts symbol", "weight")
def _(spark, d):
    return portfolio.combine(_two(spark, d), B.panel(spark, d), "mean_variance", lookback=30)


_LINEAR = """bl1 AS (SELECT ts, symbol, score - avg(score) OVER (PARTITION BY ts) AS d FROM bl WHERE score IS NOT NULL),
  bl2 AS (SELECT ts, symbol, greatest(-0.1, least(0.1, coalesce(d / nullif(sum(abs(d)) OVER (PARTITION BY ts), 0), 0))) AS w FROM bl1)"""


@query(
    "cross_signal_blend",
    "ts symbol",
    "score weight",
    f"""{_TWO}, {_ALPHA}, bl AS (SELECT ts, symbol, sum(z * CASE strategy WHEN 'ret' THEN 0.7 ELSE 0.3 END) AS score FROM tz GROUP BY ALL), {_LINEAR},
  final AS (SELECT ts, symbol, score, CASE WHEN abs(w) < 1e-4 THEN 0 ELSE w END AS weight FROM bl2 JOIN bl USING (ts, symbol))""",
)
def _(spark, d):
    two = _two(spark, d)
    shares = two.select("strategy", "ts").distinct().withColumn("share", F.when(F.col("strategy") == "ret", 0.7).otherwise(0.3))
    score = portfolio.blended(two, shares).where("score IS NOT NULL")
    return score.join(wt.linear(score), ["ts", "symbol"])


# Shares are smoothed over the dates with a signal; flat dates stand aside.
@query(
    "combine_cross_signal",
    "ts symbol",
    "weight",
    f"""{_TWO}, {_SRET}, {_ALPHA}, {_MIX},
  ac AS (SELECT ts, max(coalesce(score, 0) <> 0) AS live FROM al GROUP BY ts),
  mo AS (SELECT ts, x, row_number() OVER (ORDER BY ts) AS i FROM m3 JOIN ac USING (ts) WHERE live),
  mx AS (
    SELECT p.ts, sum(q.x * CASE WHEN q.i = 1 THEN power(0.7, p.i - 1) ELSE 0.3 * power(0.7, p.i - q.i) END) AS s
    FROM mo p JOIN mo q ON q.i <= p.i GROUP BY p.ts),
  bl AS (SELECT ts, symbol, sum(z * CASE strategy WHEN 'ret' THEN s ELSE 1 - s END) AS score FROM tz JOIN mx USING (ts) GROUP BY ALL), {_LINEAR},
  so AS (
    SELECT 'x' AS strategy, p.ts, p.symbol, CASE WHEN NOT coalesce(live, false) OR abs(w) < 1e-4 THEN 0 ELSE coalesce(w, 0) END::DOUBLE AS weight, NOT coalesce(live, false) AS aside
    FROM p LEFT JOIN bl2 USING (ts, symbol) LEFT JOIN ac USING (ts)), {_smooth_sql('so', 0.5, 1.0)},
  final AS (SELECT ts, symbol, weight FROM sw)""",
    recursive=True,
)
def _(spark, d):
    return portfolio.combine(_two(spark, d), B.panel(spark, d), "cross_signal_mv", share_ema=0.3, weight_ema=0.5)


@query("over_cap", "ts symbol", "target", f"{WDENSE}, final AS (SELECT ts, symbol, weight * 1000 AS target FROM wd WHERE abs(weight * 1000) > 1000 * 0.08)")
def _(spark, d):
    x = _w(spark, d).select("ts", "symbol", (F.col("weight") * 1000).alias("target"), F.lit(1000.0).alias("equity"))
    return wt.over_cap(x, 0.08)


@query("covariance_matrix", "a b", "cov", "r1 AS (SELECT * FROM p WHERE ret IS NOT NULL), c1 AS (SELECT x.symbol AS a, y.symbol AS b, covar_samp(x.ret, y.ret) AS cov FROM r1 x JOIN r1 y USING (ts) GROUP BY ALL), final AS (SELECT a, b, 0.9 * cov + 0.1 * CASE WHEN a = b THEN (SELECT avg(cov) FROM c1 WHERE a = b) ELSE 0 END AS cov FROM c1)")
def _(spark, d):
    return reports.covariance(B.panel(spark, d), shrink=0.1)


@query("trimmed_curve", "ts", "equity_1", f"{BT}, t AS (SELECT * FROM kb WHERE ts >= TIMESTAMP '1995-01-01'), final AS (SELECT ts, equity_1 * 10000 / (SELECT arg_min(equity_1, ts) FROM t) AS equity_1 FROM t)")
def _(spark, d):
    return bt.trimmed(bt.vectorised(_w(spark, d), B.panel(spark, d)), "1995-01-01")


@query("factor_spread", "ts", "spread cumulative", f"""a AS (SELECT *, lead(ret) {_LW} AS fw FROM p), b AS (SELECT ts, greatest(ceil({pct_sql("basis")} * 5), 1) AS bucket, fw - avg(fw) OVER (PARTITION BY ts) AS fw FROM a WHERE basis IS NOT NULL), c AS (SELECT ts, bucket, coalesce(avg(fw), 0) AS ret FROM b GROUP BY ALL),
  s AS (SELECT ts, coalesce(sum(ret) FILTER (WHERE bucket = 5), 0) - coalesce(sum(ret) FILTER (WHERE bucket = 1), 0) AS spread FROM c GROUP BY ts), final AS (SELECT *, sum(spread) OVER (ORDER BY ts) AS cumulative FROM s)""")  # fmt: skip
def _(spark, d):
    return bt.long_short_spread(bt.quantile_forward(B.panel(spark, d), "basis", demean=True))


@query("out_of_sample", "", "total sharpe", f"{_weights_sql('rank')}, y1 AS (SELECT ts, symbol, lead(close) {_LW} / nullif(close, 0) - 1 AS y_raw FROM p), d1 AS (SELECT ts, coalesce(sum(weight * y_raw), 0) AS r FROM wf JOIN y1 USING (ts, symbol) GROUP BY ts), final AS (SELECT sum(r) AS total, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS sharpe FROM d1)")
def _(spark, d):
    return ml.forward_performance(wt.predictions_to_weights(_scores(spark, d)), ml.build_target(B.panel(spark, d)))


@query("fold_performance", "fold", "sharpe total_return n_days", f"""y1 AS (SELECT year(ts) AS fold, ts, symbol, ret AS score, funding_rate AS beta, lead(close) {_LW} / nullif(close, 0) - 1 AS y_raw FROM p), y2 AS (SELECT * FROM y1 WHERE y_raw IS NOT NULL),
  y3 AS (SELECT *, CASE WHEN score IS NOT NULL AND beta IS NOT NULL THEN score END AS a, CASE WHEN score IS NOT NULL THEN beta END AS b FROM y2),
  y4 AS (SELECT *, CASE WHEN count(a) OVER (PARTITION BY ts) >= 3 AND var_pop(b) OVER (PARTITION BY ts) >= 1e-8 AND a IS NOT NULL THEN score - (regr_slope(a, b) OVER (PARTITION BY ts) * beta + regr_intercept(a, b) OVER (PARTITION BY ts)) ELSE score END AS s FROM y3),
  y5 AS (SELECT *, count(*) OVER (PARTITION BY ts) AS n, CASE WHEN s IS NOT NULL THEN row_number() OVER (PARTITION BY ts ORDER BY s NULLS LAST, symbol) END AS r FROM y4),
  y6 AS (SELECT *, CASE WHEN r > n * (1 - 0.2::DOUBLE) THEN 1 WHEN r <= n * 0.2::DOUBLE THEN -1 END AS side FROM y5 WHERE n >= 4), y7 AS (SELECT *, CAST(CASE side WHEN 1 THEN r ELSE n + 1 - r END AS DOUBLE) AS v FROM y6 WHERE side IS NOT NULL),
  y8 AS (SELECT *, v / sum(v) OVER (PARTITION BY ts, side) * 0.5 * side AS w FROM y7), y9 AS (SELECT fold, ts, sum(w * y_raw) AS r FROM y8 GROUP BY ALL HAVING count(DISTINCT side) = 2),
  final AS (SELECT fold, CASE WHEN count(*) >= 5 THEN avg(r) / (stddev_samp(r) + 1e-12) * sqrt(252) END AS sharpe, CASE WHEN count(*) >= 5 THEN product(1 + r) - 1 END AS total_return, count(*) AS n_days FROM y9 GROUP BY fold)""")  # fmt: skip
def _(spark, d):
    x = ml.build_target(B.panel(spark, d)).select(F.year("ts").alias("fold"), "ts", "symbol", F.col("ret").alias("score"), F.col("funding_rate").alias("beta"), "y_raw")
    return ml.fold_performance(x, beta="beta")


# ---- reports ------------------------------------------------------------------------


_SKEW = "CASE event_id % 5 WHEN 0 THEN 'Positive Skew' WHEN 1 THEN 'Negative Skew' WHEN 2 THEN 'Unknown' ELSE 'other' END"


@query("skew_report", "skew_regime", "pnl trades win_rate", f"a AS (SELECT {_SKEW} AS skew_regime, value - 50 AS pnl FROM events), b AS (SELECT skew_regime, sum(pnl) AS pnl, count(*) AS trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS win_rate FROM a GROUP BY 1), final AS (SELECT l.skew_regime, coalesce(pnl, 0) AS pnl, coalesce(trades, 0) AS trades, coalesce(win_rate, 0) AS win_rate FROM (SELECT unnest(['Positive Skew', 'Neutral Skew', 'Negative Skew', 'Unknown']) AS skew_regime) l LEFT JOIN b USING (skew_regime))", base=ONE)
def _(spark, d):
    return reports.by_regime(B.read(spark, d, "events").selectExpr(f"{_SKEW} AS skew_regime", "value - 50 AS pnl"), "skew_regime", reports.SKEW_LABELS)


@query("same_day_regime", "regime", "pnl mean days", "final AS (SELECT regime, sum(pnl) AS pnl, avg(pnl) AS mean, count(*) AS days FROM y GROUP BY regime)", base=DAILY)
def _(spark, d):
    return reports.regime_attribution(_daily(spark, d), "regime")


@query("cumulative_regime", "ts", "pnl_click pnl_view", "final AS (SELECT ts, sum(CASE WHEN regime = 'click' THEN pnl ELSE 0 END) OVER (ORDER BY ts) AS pnl_click, sum(CASE WHEN regime = 'view' THEN pnl ELSE 0 END) OVER (ORDER BY ts) AS pnl_view FROM y)", base=DAILY)
def _(spark, d):
    return reports.cumulative_by_regime(_daily(spark, d), "regime", ("click", "view"))


@query("score_by_regime", "ts", "low high", "a AS (SELECT ts, ret, CASE WHEN volume < 100 THEN 'low' ELSE 'high' END AS k FROM p), final AS (SELECT ts, avg(ret) FILTER (WHERE k = 'low') AS low, avg(ret) FILTER (WHERE k = 'high') AS high FROM a GROUP BY ts)")
def _(spark, d):
    x = B.panel(spark, d).select("ts", F.col("ret").alias("score"), F.when(F.col("volume") < 100, "low").otherwise("high").alias("k"))
    return reports.mean_score_by_regime(x, "k", ["low", "high"])


@query("pooled_moments", "", "n mean std skew kurtosis", "m AS (SELECT avg(ret) AS m, var_pop(ret) AS v FROM p), final AS (SELECT count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, avg(power(ret - m, 3)) / power(any_value(v), 1.5) AS skew, avg(power(ret - m, 4)) / power(any_value(v), 2) - 3 AS kurtosis FROM p, m)")
def _(spark, d):
    return reports.pooled_moments(B.panel(spark, d), "ret")


@query("universe_health", "ts", "active total ratio", "final AS (SELECT ts, count(*) FILTER (WHERE coalesce(ret, 0) <> 0) AS active, count(*) AS total, count(*) FILTER (WHERE coalesce(ret, 0) <> 0) / count(*) AS ratio FROM p GROUP BY ts)")
def _(spark, d):
    return reports.universe_health(_scores(spark, d))


@query("coverage", "ts", "active ever max_weight", f"{WDENSE}, f1 AS (SELECT symbol, min(ts) AS t0 FROM wd WHERE weight <> 0 GROUP BY symbol), d1 AS (SELECT ts, count(*) FILTER (WHERE weight <> 0) AS active, max(abs(weight)) AS max_weight FROM wd GROUP BY ts), final AS (SELECT ts, active, (SELECT count(*) FROM f1 WHERE t0 <= d1.ts) AS ever, max_weight FROM d1)")
def _(spark, d):
    return reports.coverage(_w(spark, d))


@query("score_heat", "ts symbol", "z", f"""n1 AS (SELECT symbol, count(ret) AS n FROM p GROUP BY symbol ORDER BY n DESC, symbol LIMIT 5), d1 AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM p)), s AS (SELECT greatest(1, CAST(ceil(max(n) / 100.0) AS BIGINT)) AS k FROM d1), z AS (SELECT ts, symbol, {_Z} AS z FROM p),
  final AS (SELECT z.ts, z.symbol, CASE WHEN z IS NOT NULL THEN greatest(-2.5, least(2.5, z)) END AS z FROM z JOIN n1 USING (symbol) JOIN d1 ON z.ts = d1.ts, s WHERE i % k = 1 % k)""")  # fmt: skip
def _(spark, d):
    return reports.score_heat(_scores(spark, d), 5, 100)


RESULTS = "res AS (SELECT l_linenumber AS a, CAST(l_quantity AS INTEGER) % 5 AS b, avg(l_discount) AS sharpe, avg(l_tax) AS total FROM lineitem GROUP BY ALL)"


def _results(spark, d) -> DataFrame:
    x = B.read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("a"), (F.col("l_quantity").cast("int") % 5).alias("b"))
    return x.agg(F.avg("l_discount").alias("sharpe"), F.avg("l_tax").alias("total"))


@query("parameter_correlation", "parameter metric", "corr", "final AS (SELECT 'a' AS parameter, 'sharpe' AS metric, corr(a, sharpe) AS corr FROM res UNION ALL SELECT 'a', 'total', corr(a, total) FROM res UNION ALL SELECT 'b', 'sharpe', corr(b, sharpe) FROM res UNION ALL SELECT 'b', 'total', corr(b, total) FROM res)", base=RESULTS)
def _(spark, d):
    return reports.parameter_correlation(_results(spark, d), ["a", "b"], ["sharpe", "total"])


@query("parameter_means", "a", "sharpe total", "final AS (SELECT a, avg(sharpe) AS sharpe, avg(total) AS total FROM res GROUP BY a)", base=RESULTS)
def _(spark, d):
    return reports.group_means(_results(spark, d), ["a"], ["sharpe", "total"])


@query("top_results", "a b", "sharpe", "final AS (SELECT * FROM res WHERE sharpe >= (SELECT quantile_cont(sharpe, 0.8) FROM res) ORDER BY sharpe DESC LIMIT 5)", base=RESULTS)
def _(spark, d):
    return reports.top_share(_results(spark, d), "sharpe", 0.2, 5)


@query("grid_heat", "a", "b0 b1 b4", "final AS (SELECT a, avg(sharpe) FILTER (WHERE b = 0) AS b0, avg(sharpe) FILTER (WHERE b = 1) AS b1, avg(sharpe) FILTER (WHERE b = 4) AS b4 FROM res GROUP BY a)", base=RESULTS)
def _(spark, d):
    x = reports.grid_results(_results(spark, d), "a", "b", [0, 1, 4])
    return x.select("a", *[F.col(str(k)).alias(f"b{k}") for k in (0, 1, 4)])


# The event types stand in for winners, the skew labels for regimes.
LABELS = f"lab AS (SELECT CAST(ts AS TIMESTAMP) AS ts, event_type AS winner, {_SKEW} AS regime, event_id % 7 AS fold FROM events)"


def _labels(spark, d) -> DataFrame:
    return B.read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("winner"), F.expr(_SKEW).alias("regime"), (F.col("event_id") % 7).alias("fold"))


@query("regime_usage", "winner regime", "days share share_of_winner", "k AS (SELECT winner, regime, count(*) AS days FROM lab GROUP BY ALL), final AS (SELECT *, days / sum(days) OVER () AS share, days / sum(days) OVER (PARTITION BY winner) AS share_of_winner FROM k)", base=LABELS)
def _(spark, d):
    return reports.usage(_labels(spark, d), "winner", "regime")


@query("expert_availability", "winner regime", "folds of_folds share", "a AS (SELECT * FROM lab WHERE NOT (regime = 'Unknown' AND fold < 3) AND NOT (winner = 'click' AND fold = 6)), w AS (SELECT winner, count(DISTINCT fold) AS of_folds FROM a GROUP BY winner), final AS (SELECT winner, regime, count(DISTINCT fold) AS folds, any_value(of_folds) AS of_folds, count(DISTINCT fold) / any_value(of_folds) AS share FROM a JOIN w USING (winner) GROUP BY winner, regime)", base=LABELS)
def _(spark, d):
    x = _labels(spark, d).where("NOT (regime = 'Unknown' AND fold < 3) AND NOT (winner = 'click' AND fold = 6)")
    return reports.expert_availability(x, [r[0] for r in x.select("winner").distinct().collect()])  # a few event types


@query("winners_by_quarter", "quarter", "click view", "final AS (SELECT year(ts) || 'Q' || quarter(ts) AS quarter, count(*) FILTER (WHERE winner = 'click') AS click, count(*) FILTER (WHERE winner = 'view') AS view FROM lab GROUP BY 1)", base=LABELS)
def _(spark, d):
    return reports.winners_by_quarter(_labels(spark, d), "winner", ["click", "view"])


@query("search_profile", "term rank", "importance std folds of_top", "a AS (SELECT term, avg(importance) AS importance, stddev_samp(importance) AS std, count(*) AS folds FROM imp GROUP BY term), b AS (SELECT *, rank() OVER (ORDER BY importance DESC) AS rank, importance / max(importance) OVER () AS of_top FROM a), final AS (SELECT * FROM b WHERE contains(lower(term), '3'))", base=IMP)
def _(spark, d):
    return reports.search_profile(_importance(spark, d), "3")


@query("interaction_partners", "partner", "max mean", "a AS (SELECT CASE WHEN split_part(term, ' & ', 1) = '3' THEN split_part(term, ' & ', 2) ELSE split_part(term, ' & ', 1) END AS partner, importance FROM imp WHERE contains(term, ' & ') AND list_contains(string_split(term, ' & '), '3') AND term <> '3 & 3'), final AS (SELECT partner, max(importance) AS max, avg(importance) AS mean FROM a GROUP BY partner ORDER BY max DESC, mean DESC, partner LIMIT 10)", base=IMP)
def _(spark, d):
    return reports.partners(_importance(spark, d).where("term <> '3 & 3'"), "3")


@query("partners_by_model", "partner", "A N R max mean", "a AS (SELECT CASE WHEN split_part(term, ' & ', 1) = '3' THEN split_part(term, ' & ', 2) ELSE split_part(term, ' & ', 1) END AS partner, model, importance FROM imp WHERE contains(term, ' & ') AND list_contains(string_split(term, ' & '), '3') AND term <> '3 & 3'), b AS (SELECT partner, coalesce(avg(importance) FILTER (WHERE model = 'A'), 0) AS \"A\", coalesce(avg(importance) FILTER (WHERE model = 'N'), 0) AS \"N\", coalesce(avg(importance) FILTER (WHERE model = 'R'), 0) AS \"R\" FROM a GROUP BY partner), final AS (SELECT *, greatest(\"A\", \"N\", \"R\") AS max, (\"A\" + \"N\" + \"R\") / 3 AS mean FROM b ORDER BY max DESC, mean DESC, partner LIMIT 10)", base=IMP)
def _(spark, d):
    return reports.partner_models(_importance(spark, d).where("term <> '3 & 3'"), "3", ["A", "N", "R"])


@query("rank_shifts", "list place term dominant", "dispersion rank_shift", """a AS (SELECT model, term, avg(importance) AS v FROM imp GROUP BY ALL), b AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY v DESC) AS r FROM a), c AS (SELECT term, arg_max(model, (v, model)) AS dominant, stddev_samp(v) AS dispersion, max(r) - min(r) AS rank_shift FROM b GROUP BY term),
  final AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY rank_shift DESC, term) AS place, 'largest_shift' AS list FROM c UNION ALL SELECT *, row_number() OVER (ORDER BY rank_shift, term), 'smallest_shift' FROM c UNION ALL SELECT *, row_number() OVER (ORDER BY dispersion DESC NULLS LAST, term), 'dispersion' FROM c) WHERE place <= 5)""", base=IMP)  # fmt: skip
def _(spark, d):
    return reports.rank_shifts(_importance(spark, d), 5)


# ---- shapes of factors and their health -----------------------------------------------------

SHAPES = """sh AS (SELECT year(l_shipdate) AS fold, substr(p_brand, 7, 1) AS feature, l_linenumber AS bag, CAST(floor(l_quantity / 10) AS INTEGER) AS bin, floor(l_quantity / 10) * 10 + 5 AS x, avg(l_discount) - 0.05 AS score, avg(p_size) / 500 AS density FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 3 GROUP BY ALL)"""
HEALTH = f"""hb AS (SELECT fold, feature, bin, avg(score) AS s, var_pop(score) AS v, arg_min(x, bag) AS x, arg_min(density, bag) AS d FROM sh GROUP BY ALL),
  hr AS (SELECT *, rank() OVER (PARTITION BY fold, feature ORDER BY x) + (count(*) OVER (PARTITION BY fold, feature, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY fold, feature ORDER BY s) + (count(*) OVER (PARTITION BY fold, feature, s) - 1) / 2.0 AS rs, s - 2 * lag(s) OVER (PARTITION BY fold, feature ORDER BY bin) + lag(s, 2) OVER (PARTITION BY fold, feature ORDER BY bin) AS d2, d / sum(d) OVER (PARTITION BY fold, feature) AS w FROM hb),
  hm AS (SELECT *, sum(w * rx) OVER (PARTITION BY fold, feature) AS mx, sum(w * rs) OVER (PARTITION BY fold, feature) AS ms FROM hr),
  health AS (SELECT fold, feature, CASE WHEN count(*) >= 3 THEN sum(w * (rx - mx) * (rs - ms)) / nullif(sqrt(sum(w * (rx - mx) ** 2) * sum(w * (rs - ms) ** 2)), 0) END AS monotonicity,
    CASE WHEN max(abs(s)) FILTER (WHERE d >= 0.05) > 0 AND count(*) FILTER (WHERE d < 0.05) > 0 THEN max(abs(s)) FILTER (WHERE d < 0.05) / (max(abs(s)) FILTER (WHERE d >= 0.05) + 1e-6) ELSE 0 END AS tail_core_ratio,
    CASE WHEN count(*) >= 3 THEN sum(abs(d2)) END AS curvature, sum(d * v) AS cross_bag_variance, count(*) AS n_bins FROM hm GROUP BY ALL)"""
FOLDED = f"""{HEALTH}, hf AS (SELECT feature, avg(monotonicity) AS monotonicity_mean, stddev_samp(monotonicity) AS monotonicity_std, avg(tail_core_ratio) AS tail_core_ratio_mean, max(tail_core_ratio) AS tail_core_ratio_max, avg(curvature) AS curvature_mean, avg(cross_bag_variance) AS cross_bag_variance_mean, median(n_bins) AS n_bins_median, count(DISTINCT fold) AS n_folds FROM health GROUP BY feature),
  hi AS (SELECT feature, sum(abs(score) * density) AS importance FROM sh GROUP BY ALL), ha AS (SELECT *, rank() OVER (ORDER BY importance DESC) AS importance_rank FROM hf JOIN hi USING (feature)),
  ht AS (SELECT *, (SELECT greatest(quantile_cont(cross_bag_variance_mean, 0.8), 1e-4) FROM ha) AS cut FROM ha),
  hroute AS (SELECT *, CASE WHEN tail_core_ratio_max > 1.5 AND cross_bag_variance_mean > cut THEN 'DROP_tail_and_unstable' WHEN tail_core_ratio_max > 1.5 THEN 'DROP_tail' WHEN cross_bag_variance_mean > cut THEN 'DROP_unstable' WHEN importance_rank <= 4 AND abs(monotonicity_mean) < 0.3 THEN 'EXPERT' ELSE 'GLOBAL' END AS route FROM ht)"""


def _shapes(spark, d) -> DataFrame:
    x = B.read(spark, d, "lineitem").where("l_linenumber <= 3").join(B.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    bin_ = F.floor(F.col("l_quantity") / 10).cast("int")
    return x.groupBy(F.year("l_shipdate").alias("fold"), F.substring("p_brand", 7, 1).alias("feature"), F.col("l_linenumber").alias("bag"), bin_.alias("bin")).agg((F.first(bin_) * 10 + 5).cast("double").alias("x"), (F.avg("l_discount") - 0.05).alias("score"), (F.avg("p_size") / 500).alias("density"))


def _health(spark, d) -> DataFrame:
    s = _shapes(spark, d)
    imp = s.groupBy(F.lit(0).alias("fold"), F.col("feature").alias("term")).agg(F.sum(F.abs("score") * F.col("density")).alias("importance"))
    return ml.shape_health(s), imp


@query("shape_health", "fold feature", "monotonicity tail_core_ratio curvature cross_bag_variance n_bins", f"{HEALTH}, final AS (SELECT * FROM health)", base=SHAPES)
def _(spark, d):
    return _health(spark, d)[0]


@query("health_over_folds", "feature", "monotonicity_mean monotonicity_std tail_core_ratio_mean tail_core_ratio_max curvature_mean cross_bag_variance_mean n_bins_median n_folds importance_mean importance_rank", f"{FOLDED}, final AS (SELECT *, importance AS importance_mean FROM ha)", base=SHAPES)
def _(spark, d):
    return reports.health_over_folds(*_health(spark, d))


@query("health_routing", "feature route", "cross_bag_var_thresh", f"{FOLDED}, final AS (SELECT feature, route, cut AS cross_bag_var_thresh FROM hroute)", base=SHAPES)
def _(spark, d):
    return reports.health_routing(reports.health_over_folds(*_health(spark, d)), top=4, max_ratio=1.5)


@query("health_consensus", "feature strict_drop soft_drop", "experts mean_rank", f"""{FOLDED}, r3 AS (SELECT feature, route, importance_rank FROM hroute UNION ALL SELECT feature, 'EXPERT', importance_rank + 1 FROM hroute WHERE importance_rank % 2 = 0 UNION ALL SELECT feature, 'DROP_tail', 9 FROM hroute WHERE importance_rank = 3),
  final AS (SELECT feature, bool_and(starts_with(route, 'DROP')) AS strict_drop, bool_or(starts_with(route, 'DROP')) AS soft_drop, count(*) FILTER (WHERE route = 'EXPERT') AS experts, avg(importance_rank) AS mean_rank FROM r3 GROUP BY feature HAVING bool_or(starts_with(route, 'DROP')))""", base=SHAPES)  # fmt: skip
def _(spark, d):
    one = reports.health_routing(reports.health_over_folds(*_health(spark, d)), top=4, max_ratio=1.5).select("feature", "route", F.col("importance_rank").cast("long").alias("importance_rank"))
    two = one.where("importance_rank % 2 = 0").selectExpr("feature", "'EXPERT' AS route", "importance_rank + 1 AS importance_rank")
    three = one.where("importance_rank = 3").selectExpr("feature", "'DROP_tail' AS route", "9L AS importance_rank")
    return reports.drop_lists(one.unionByName(two).unionByName(three))


# ---- training -------------------------------------------------------------------------------


def _train(spark, d) -> tuple[DataFrame, list[dict]]:
    x = ml.build_target(B.panel(spark, d)).withColumn("vol", ts.std("ret", 10))
    return x, _calendar(x)


_FEATURES = ["ret", "basis", "vol"]


_STEPS = ", ".join(f"{k} / 16.0" for k in range(1, 16))


def _step_sql(k: int) -> str:
    """A step of the booster on feature k: the residual that it meets, and what it adds to the bin's score."""
    left = f"r{k - 1} - v{k - 1}" if k else "y - base"
    by = f"OVER (PARTITION BY fold, c{k})"
    return f"t{k} AS (SELECT *, 0.1 * sum(r{k}) {by} / (count(*) {by} + 1) AS v{k} FROM (SELECT *, {left} AS r{k} FROM {f't{k - 1}' if k else 'co'}))"


@query(
    "training_first_round",
    "fold feature bin",
    "score",
    f"""a AS (SELECT *, lead(close, 1) {_LW} / nullif(close, 0) - 1 AS y_raw, {g('stddev_samp', 'ret', 10)} AS vol FROM p),
  b AS (SELECT ts, {pct_sql('y_raw')} - 0.5 AS y, coalesce(round(ret, 9), 0) AS f0, coalesce(round(basis, 9), 0) AS f1, coalesce(round(vol, 9), 0) AS f2 FROM a),
  dd AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM b)),
  fo AS (SELECT k AS fold, n // 2 + 40 * k AS i FROM (SELECT DISTINCT n FROM dd), range(1000) t(k) WHERE n // 2 + 40 * k < n),
  tr AS (SELECT fold, b.* FROM fo JOIN dd ON dd.i < fo.i - 1 JOIN b USING (ts) WHERE y IS NOT NULL),
  ed AS (SELECT fold, avg(y) AS base, {', '.join(f'list_distinct(quantile_cont(f{k}, [{_STEPS}])) AS e{k}' for k in range(3))} FROM tr GROUP BY fold),
  co AS (SELECT fold, y, base, {', '.join(f'len(list_filter(e{k}, lambda e: e <= f{k})) AS c{k}' for k in range(3))} FROM tr JOIN ed USING (fold)),
  {', '.join(_step_sql(k) for k in range(3))},
  final AS ({' UNION '.join(f"SELECT fold, '{n}' AS feature, c{k} AS bin, round(v{k}, 12) AS score FROM t2 WHERE v{k} <> 0" for k, n in enumerate(('ret', 'basis', 'vol')))})""",
)
def _(spark, d):
    x, c = _train(spark, d)
    x = x.withColumns({f: F.round(f, 9) for f in _FEATURES})  # a value that rounding puts on either side of an edge is on neither
    return ml.shape_table(ml.trained(x, _FEATURES, c, rounds=1)).where("score <> 0").select("fold", "feature", "bin", "score")


@query("trained_shapes", "fold feature bag bin", "x score density")
def _(spark, d):
    x, c = _train(spark, d)
    return ml.shape_table(ml.trained(x, _FEATURES, c, bags=3, pairs=2))


@query("ensemble_importance", "fold term", "importance")
def _(spark, d):
    x, c = _train(spark, d)
    return ml.walk_forward(x, _FEATURES, c, bags=3, pairs=2)[1]


@query("regime_experts", "fold ts symbol", "score")
def _(spark, d):
    x, c = _train(spark, d)
    lab = _regimes(spark, d).select("ts", "trend_regime")
    lab = lab.join(ml.hysteresis(lab, "trend_regime"), "ts")
    return ml.walk_forward(x.join(F.broadcast(lab), "ts"), _FEATURES, c, expert="trend_regime", state="state")[0]


@query("tournament_log", "fold winner", "")
def _(spark, d):
    x, c = _train(spark, d)
    x = x.join(F.broadcast(fac.market_table(x).select("ts", "mkt_ret", "dispersion")), "ts")
    _, log = ml.tournament_walk_forward(x, _FEATURES, ["mkt_ret", "dispersion"], c)
    return spark.createDataFrame([(r["fold"], r["winner"]) for r in log], "fold long, winner string")


@query("tournament_scores", "fold ts symbol", "score")
def _(spark, d):
    x, c = _train(spark, d)
    x = x.join(F.broadcast(fac.market_table(x).select("ts", "mkt_ret", "dispersion")), "ts")
    return ml.tournament_walk_forward(x, _FEATURES, ["mkt_ret", "dispersion"], c)[0]


@query("epoch_training", "epoch fold ts symbol", "score")
def _(spark, d):
    x, c = _train(spark, d)
    return ml.per_epoch(x, _epochs(spark, d), _FEATURES, c)


__all__ = ["_ALL", "_IC", "over"]
