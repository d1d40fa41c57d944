"""Query name -> Spark function and DuckDB SQL of the panel operators.

Doubles are rounded to six places on both sides; times are text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import cs, ts
from .ml import training as ml
from .operators import backtest as bt
from .operators import calendar as cal
from .operators import factors as fac
from .operators import joins, portfolio, reports
from .operators import weights as wt
from .plans import bars as B

_Q: dict[str, tuple[Callable, str | None]] = {}

BARS = """bars AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS ts, p_brand AS symbol, sum(l_extendedprice) / sum(l_quantity) AS close,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume,
    sum(l_extendedprice * (1 - l_discount)) AS open_interest, avg(l_discount) - avg(l_tax) AS funding_rate,
    (count(*) FILTER (WHERE l_linestatus = 'O') + 1) / (count(*) FILTER (WHERE l_linestatus = 'F') + 1) AS ls_ratio,
    avg(p_retailprice) AS close_spot, CAST(count(*) AS DOUBLE) AS volume_spot
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
bars2 AS (SELECT *, close - close_spot AS basis, volume / (CASE WHEN volume_spot = 0 THEN 1e-12 ELSE volume_spot END) AS volume_ratio FROM bars),
grid AS (SELECT ts, symbol, b.* EXCLUDE (ts, symbol) FROM (SELECT DISTINCT ts FROM bars) CROSS JOIN (SELECT DISTINCT symbol FROM bars) LEFT JOIN bars2 b USING (ts, symbol))"""
PANEL = (
    BARS
    + """,
f AS (SELECT * REPLACE (last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close) FROM grid),
r AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM f),
p AS (SELECT *, avg(ret) OVER (PARTITION BY ts) AS mkt FROM r)"""
)


def over(n: int | None, key: str = "symbol") -> str:
    part = f"PARTITION BY {key} " if key else ""
    return f"OVER ({part}ORDER BY ts ROWS BETWEEN {'UNBOUNDED' if n is None else n - 1} PRECEDING AND CURRENT ROW)"


def g(agg: str, x: str, n: int | None, m: int | None = None, key: str = "symbol") -> str:
    """SQL of ts.gate."""
    return f"CASE WHEN count({x}) {over(n, key)} >= {n if m is None else m} THEN {agg}({x}) {over(n, key)} END"


def zs(x: str, n: int, m: int, key: str = "symbol") -> str:
    return f"({x} - {g('avg', x, n, m, key)}) / nullif({g('stddev_samp', x, n, m, key)}, 0)"


def rank_sql(x: str, by: str = "ts") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END"


def pct_sql(x: str, by: str = "ts") -> str:
    return f"({rank_sql(x, by)}) / count({x}) OVER (PARTITION BY {by})"


def resid_sql(y: str, x: str, by: str = "ts") -> str:
    a, b = f"CASE WHEN {y} <> 0 AND {x} IS NOT NULL THEN {y} END", f"CASE WHEN {y} <> 0 THEN {x} END"
    ok = f"count({a}) OVER (PARTITION BY {by}) >= 2 AND var_pop({b}) OVER (PARTITION BY {by}) >= 1e-8 AND {y} <> 0 AND {x} IS NOT NULL"
    return f"coalesce(CASE WHEN {ok} THEN {y} - (regr_slope({a}, {b}) OVER (PARTITION BY {by}) * {x} + regr_intercept({a}, {b}) OVER (PARTITION BY {by})) ELSE {y} END, 0)"


#: Numbers are rounded to six places for comparison. Quotients of small powers of two
#: lie just on a half there; both sides are moved off it by the same amount.
OFF_HALF = 1.3e-8


def _out(df: DataFrame, keys: list[str], nums: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    cols = [F.date_format(k, "yyyy-MM-dd HH:mm:ss").alias(k) if kinds[k].startswith("timestamp") else F.col(k).cast("string").alias(k) if kinds[k] == "date" else F.col(k) for k in keys]
    return df.select(*cols, *[(F.round(F.col(n).cast("double") + OFF_HALF, 6) + 0.0).alias(n) for n in nums])


def query(name: str, keys: str, nums: str, sql: str | None = None, times: str = "ts", base: str = PANEL, recursive: bool = False):
    """Register fn(spark, sf_dir); sql: CTEs that end in one called `final`."""
    ks, ns = keys.split(), nums.split()

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        oracle = None
        if sql is not None:
            sel = ", ".join([f"strftime({k}, '%Y-%m-%d %H:%M:%S') AS {k}" if k in times.split() else k for k in ks] + [f"round(CAST(\"{n}\" AS DOUBLE) + {OFF_HALF}, 6) + 0.0 AS \"{n}\"" for n in ns])
            oracle = f"WITH {'RECURSIVE ' if recursive else ''}{base}, {sql} SELECT {sel} FROM final"
        _Q[name] = (lambda spark, sf_dir: _out(fn(spark, sf_dir), ks, ns), oracle)
        return fn

    return add


# ---- bars, calendar, fills --------------------------------------------------

HOURLY = """u AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, event_type AS symbol, arg_min(value, (e.ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (e.ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events e GROUP BY ALL)"""


@query("bars_ohlcv", "ts symbol", "open high low close volume", "final AS (SELECT * FROM u)", base=HOURLY)
def _(spark, d):
    return B.hourly_bars(spark, d)


@query("calendar_dense", "ts symbol", "close volume", "final AS (SELECT * FROM grid)", base=BARS)
def _(spark, d):
    return cal.densify(B.weekly_bars(spark, d))


@query("weekly_market", "ts symbol", "close volume open_interest funding_rate ls_ratio basis volume_ratio", "final AS (SELECT * FROM bars2)", base=BARS)
def _(spark, d):
    return B.weekly_bars(spark, d)


_ALL = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("fills", "ts symbol", "limited forward backward zero", f"""final AS (SELECT ts, symbol, last_value(volume IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS limited,
  last_value(volume IGNORE NULLS) {_ALL} AS forward, first_value(volume IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward, coalesce(volume, 0) AS zero FROM grid)""", base=BARS)  # fmt: skip
def _(spark, d):
    x = cal.densify(B.weekly_bars(spark, d))
    return x.withColumns({"limited": ts.ffill("volume", 5), "forward": ts.ffill("volume"), "backward": ts.bfill("volume"), "zero": F.coalesce("volume", F.lit(0.0))})


@query("wide_long", "ts symbol", "close", "final AS (SELECT ts, symbol, avg(close) AS close FROM bars GROUP BY ALL)", base=BARS)
def _(spark, d):
    bars = B.weekly_bars(spark, d)
    names = [r[0] for r in B.read(spark, d, "part").select("p_brand").distinct().orderBy("p_brand").collect()]  # a dimension of 25 names
    return cal.to_long(cal.to_wide(bars, "close", names), "close")


@query("keep_first_last", "symbol", "first_close last_close", "final AS (SELECT symbol, arg_min(close, ts) AS first_close, arg_max(close, ts) AS last_close FROM bars GROUP BY symbol)", base=BARS)
def _(spark, d):
    bars = B.weekly_bars(spark, d).select("symbol", "ts", "close")
    a = cal.keep_one(bars, ["symbol"], ["ts"]).select("symbol", F.col("close").alias("first_close"))
    return a.join(cal.keep_one(bars, ["symbol"], ["ts"], last=True).select("symbol", F.col("close").alias("last_close")), "symbol")


# ---- per-symbol windows -------------------------------------------------------


def _ret(k: int) -> str:
    return f"close / nullif(lag(close, {k}) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1"


@query("returns", "ts symbol", "ret_1d ret_5d ret_20d fwd padded", f"""pad AS (SELECT *, last_value(c0 IGNORE NULLS) {_ALL} AS c1 FROM (SELECT p.*, g.close AS c0 FROM p JOIN grid g USING (ts, symbol))),
  final AS (SELECT ts, symbol, {_ret(1)} AS ret_1d, {_ret(5)} AS ret_5d, {_ret(20)} AS ret_20d, lead(ret) OVER (PARTITION BY symbol ORDER BY ts) AS fwd, c1 / nullif(lag(c1) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS padded FROM pad)""")  # fmt: skip
def _(spark, d):
    x = B.panel(spark, d)
    raw = cal.densify(B.weekly_bars(spark, d)).select("ts", "symbol", F.col("close").alias("c0"))
    x = x.join(raw, ["ts", "symbol"])
    return x.withColumns({"ret_1d": ts.pct_change("close"), "ret_5d": ts.pct_change("close", 5), "ret_20d": ts.pct_change("close", 20), "fwd": ts.lead("ret"), "padded": ts.pct_change("c0", pad_gaps=True)})


@query("rolling_stats", "ts symbol", "mean std var total med", f"final AS (SELECT ts, symbol, {g('avg', 'ret', 20, 10)} AS mean, {g('stddev_samp', 'ret', 30)} AS std, {g('var_samp', 'ret', 30, 15)} AS var, {g('sum', 'ret', 5, 1)} AS total, {g('median', 'ret', 10, 5)} AS med FROM p)")
def _(spark, d):
    return B.panel(spark, d).withColumns({"mean": ts.mean("ret", 20, 10), "std": ts.std("ret", 30), "var": ts.var("ret", 30, 15), "total": ts.total("ret", 5, 1), "med": ts.median("ret", 10, 5)})


@query("rolling_skew_kurt", "ts symbol", "skew45 kurt45", f"final AS (SELECT ts, symbol, {g('skewness', 'ret', 45, 30)} AS skew45, {g('kurtosis', 'ret', 45, 30)} AS kurt45 FROM p)")
def _(spark, d):
    return B.panel(spark, d).withColumns({"skew45": ts.skew("ret", 45, 30), "kurt45": ts.kurt("ret", 45, 30)})


_COV = f"CASE WHEN count(CASE WHEN mkt IS NOT NULL THEN ret END) {over(60)} >= 60 THEN covar_samp(ret, mkt) {over(60)} END"


@query("rolling_beta", "ts symbol", "cov_60 beta_60", f"b AS (SELECT ts, symbol, {_COV} AS cov_60, ({_COV}) / nullif({g('var_samp', 'mkt', 60)}, 0) AS beta FROM p), final AS (SELECT *, CASE WHEN coalesce(beta, avg(beta) OVER (PARTITION BY ts)) IS NOT NULL THEN greatest(-3, least(3, coalesce(beta, avg(beta) OVER (PARTITION BY ts)))) END AS beta_60 FROM b)")
def _(spark, d):
    return fac.beta(B.panel(spark, d).withColumn("cov_60", ts.cov("ret", "mkt", 60)))


@query("ts_zscores", "ts symbol", "z capped twice", f"""a AS (SELECT *, ({zs('ret', 40, 20)}) AS z, (ret - {g('avg', 'ret', 40, 20)}) / nullif(greatest(-2, least(2, {g('stddev_samp', 'ret', 40, 20)})), 0) AS capped FROM p),
  final AS (SELECT *, (capped - {g('avg', 'capped', 40, 20)}) / nullif(greatest(-2, least(2, {g('stddev_samp', 'capped', 40, 20)})), 0) AS twice FROM a)""")  # fmt: skip
def _(spark, d):
    x = B.panel(spark, d).withColumns({"z": ts.zscore("ret", 40), "capped": ts.zscore_capped("ret", 40)})
    return x.withColumn("twice", ts.zscore_capped("capped", 40))


@query("delta_5_10", "ts symbol", "delta", f"a AS (SELECT *, {g('avg', 'close', 5, 1)} AS m FROM p), final AS (SELECT *, m - lag(m, 10) OVER (PARTITION BY symbol ORDER BY ts) AS delta FROM a)")
def _(spark, d):
    return B.panel(spark, d).withColumn("delta", ts.delta("close"))


@query("ts_neutralize", "ts symbol", "residual", f"""a AS (SELECT *, CASE WHEN mkt IS NOT NULL THEN ret END AS x, CASE WHEN ret IS NOT NULL THEN mkt END AS y FROM p),
  b AS (SELECT *, {g('avg', 'x', 60, 15)} AS mx, {g('avg', 'y', 60, 15)} AS my, {g('avg', '(x * y)', 60, 15)} AS mxy, {g('var_samp', 'y', 60, 15)} AS vy FROM a),
  final AS (SELECT *, ret - (mx + (mxy - mx * my) / nullif(vy, 0) * (mkt - my)) AS residual FROM b)""")  # fmt: skip
def _(spark, d):
    return B.panel(spark, d).withColumn("residual", ts.residual_on_market("ret", "mkt", 60))


_EWM = """w AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM p),
  e AS (SELECT a.ts, a.symbol, a.i, sum(CASE WHEN b.ret IS NOT NULL THEN power(0.5, (a.i - b.i) / 12.0) * b.ret END) / nullif(sum(CASE WHEN b.ret IS NOT NULL THEN power(0.5, (a.i - b.i) / 12.0) END), 0) AS ewm12
        FROM w a JOIN w b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY ALL)"""


@query("ewm_halflife", "ts symbol", "ewm12", f"{_EWM}, final AS (SELECT * FROM e)")
def _(spark, d):
    return fac.ewm(B.panel(spark, d).select("ts", "symbol", "ret"), "ret", "ewm12", halflife=12)


_LAST = "last_value(mkt_ret IGNORE NULLS) OVER (ORDER BY ts)"
MARKET = "m AS (SELECT ts, avg(ret) AS mkt_ret, stddev_samp(ret) AS dispersion, avg(close) AS close, avg(high) AS high, avg(low) AS low FROM p GROUP BY ts)"


def _wilder(x: str, src: str) -> str:
    """Adjust-free EWM in closed form from the first value on (no gaps inside)."""
    return f"(SELECT a.i, sum(CASE WHEN b.i = s.i0 THEN power(13 / 14.0, a.i - b.i) ELSE power(13 / 14.0, a.i - b.i) / 14.0 END * b.{x}) AS v FROM {src} a, {src} b, (SELECT min(i) AS i0 FROM {src} WHERE {x} IS NOT NULL) s WHERE b.i <= a.i AND b.{x} IS NOT NULL GROUP BY a.i)"


_ADX = f"""{MARKET}, n AS (SELECT *, row_number() OVER (ORDER BY ts) AS i, lag(close) OVER (ORDER BY ts) AS pc, high - lag(high) OVER (ORDER BY ts) AS up, lag(low) OVER (ORDER BY ts) - low AS dn FROM m),
  o AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM n),
  tre AS {_wilder('tr', 'o')}, pe AS {_wilder('pdm', 'o')}, me AS {_wilder('mdm', 'o')},
  di AS (SELECT o.*, 100 * pe.v / nullif(tre.v, 0) AS plus_di, 100 * me.v / nullif(tre.v, 0) AS minus_di FROM o LEFT JOIN tre USING (i) LEFT JOIN pe USING (i) LEFT JOIN me USING (i)),
  dx AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM di), ax AS {_wilder('dx', 'dx')},
  adx AS (SELECT dx.*, ax.v AS adx FROM dx LEFT JOIN ax USING (i))"""


@query("adx_market", "ts", "plus_di minus_di adx", f"{_ADX}, final AS (SELECT * FROM adx)")
def _(spark, d):
    return fac.adx(fac.market_table(B.panel(spark, d)).withColumn("k", F.lit("market")), key="k")


_BEFORE = "OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
REGIMES = f"""{_ADX}, v AS (SELECT *, {g('stddev_samp', 'mkt_ret', 30, None, '')} AS volatility, {g('skewness', 'mkt_ret', 90, None, '')} AS skewness FROM adx),
  qv AS (SELECT *, CASE WHEN count(volatility) {_BEFORE} >= 120 THEN quantile_cont(volatility, 0.25) {_BEFORE} END AS lo, CASE WHEN count(volatility) {_BEFORE} >= 120 THEN quantile_cont(volatility, 0.75) {_BEFORE} END AS hi FROM v),
  reg AS (SELECT *, CASE WHEN volatility < lo THEN 'Low Volatility' WHEN volatility > hi THEN 'High Volatility' ELSE 'Medium Volatility' END AS volatility_regime,
    CASE WHEN adx > 25 THEN 'Strong Trend' WHEN adx < 20 THEN 'Ranging' ELSE 'Weak Trend' END AS trend_regime,
    CASE WHEN skewness < -0.5 THEN 'Negative Skew' WHEN skewness > 0.5 THEN 'Positive Skew' ELSE 'Neutral Skew' END AS skew_regime FROM qv)"""
_CODES = """CASE volatility_regime WHEN 'Low Volatility' THEN 0 WHEN 'Medium Volatility' THEN 1 WHEN 'High Volatility' THEN 2 END AS volatility_regime_enc,
  CASE trend_regime WHEN 'Ranging' THEN 0 WHEN 'Weak Trend' THEN 1 WHEN 'Strong Trend' THEN 2 END AS trend_regime_enc, CASE skew_regime WHEN 'Negative Skew' THEN -1 WHEN 'Neutral Skew' THEN 0 WHEN 'Positive Skew' THEN 1 END AS skew_regime_enc"""


def _regimes(spark, d) -> DataFrame:
    return fac.market_regimes(fac.market_table(B.panel(spark, d)))


@query("market_regimes", "ts volatility_regime trend_regime skew_regime", "volatility skewness", f"{REGIMES}, final AS (SELECT * FROM reg)")
def _(spark, d):
    return _regimes(spark, d)


@query("regime_encoding", "ts", "volatility_regime_enc trend_regime_enc skew_regime_enc", f"{REGIMES}, final AS (SELECT ts, {_CODES} FROM reg)")
def _(spark, d):
    return fac.encoded(_regimes(spark, d))


@query("regime_streaks", "label start", "length", f"""{REGIMES}, c AS (SELECT ts, trend_regime, sum(CASE WHEN trend_regime IS NOT DISTINCT FROM prev AND i > 1 THEN 0 ELSE 1 END) OVER (ORDER BY ts) AS run FROM (SELECT *, lag(trend_regime) OVER (ORDER BY ts) AS prev FROM reg)),
  final AS (SELECT arg_min(trend_regime, ts) FILTER (WHERE true) AS label, min(ts) AS start, count(*) AS length FROM c GROUP BY run)""", times="start")  # fmt: skip
def _(spark, d):
    return reports.streaks(_regimes(spark, d), "trend_regime")


HOLD = """hl AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, lag(trend_regime) OVER (ORDER BY ts) AS l FROM reg),
  hs(i, ts, now, want, n) AS (SELECT i, ts, l, CAST(NULL AS VARCHAR), 0 FROM hl WHERE i = 1 UNION ALL
    SELECT b.i, b.ts, CASE WHEN b.l IS NULL THEN a.now WHEN a.now IS NULL OR b.l = a.now THEN b.l WHEN (CASE WHEN b.l IS NOT DISTINCT FROM a.want THEN a.n + 1 ELSE 1 END) >= 3 THEN b.l ELSE a.now END,
      CASE WHEN b.l IS NULL THEN a.want WHEN a.now IS NULL OR b.l = a.now OR (CASE WHEN b.l IS NOT DISTINCT FROM a.want THEN a.n + 1 ELSE 1 END) >= 3 THEN NULL ELSE b.l END,
      CASE WHEN b.l IS NULL THEN a.n WHEN a.now IS NULL OR b.l = a.now OR (CASE WHEN b.l IS NOT DISTINCT FROM a.want THEN a.n + 1 ELSE 1 END) >= 3 THEN 0 WHEN b.l IS NOT DISTINCT FROM a.want THEN a.n + 1 ELSE 1 END
    FROM hs a JOIN hl b ON b.i = a.i + 1)"""


@query("hysteresis", "ts state", "", f"{REGIMES}, {HOLD}, final AS (SELECT ts, now AS state FROM hs)", recursive=True)
def _(spark, d):
    return ml.hysteresis(_regimes(spark, d), "trend_regime")


# ---- cross sections -----------------------------------------------------------


@query("cs_scores", "ts symbol", "z pct centred first demeaned", f"""final AS (SELECT ts, symbol, (ret - avg(ret) OVER (PARTITION BY ts)) / nullif(stddev_samp(ret) OVER (PARTITION BY ts), 0) AS z, {pct_sql('ret')} AS pct, {pct_sql('ret')} - 0.5 AS centred,
  CASE WHEN ret IS NOT NULL THEN row_number() OVER (PARTITION BY ts ORDER BY ret NULLS LAST, symbol) END AS first, ret - avg(ret) OVER (PARTITION BY ts) AS demeaned FROM p)""")  # fmt: skip
def _(spark, d):
    return B.panel(spark, d).withColumns({"z": cs.zscore("ret"), "pct": cs.rank_pct("ret"), "centred": cs.rank_centred("ret"), "first": cs.rank_first("ret"), "demeaned": cs.demean("ret")})


@query("cs_residual", "ts symbol", "residual", f"final AS (SELECT ts, symbol, {resid_sql('ret', 'basis')} AS residual FROM p)")
def _(spark, d):
    return B.panel(spark, d).withColumn("residual", cs.residual("ret", "basis"))


@query("cs_buckets", "ts symbol", "bucket label", f"""final AS (SELECT ts, symbol, greatest(ceil({pct_sql('ret')} * 5), 1) AS bucket, ceil(CAST(row_number() OVER (PARTITION BY ts ORDER BY ret NULLS LAST, symbol) AS DOUBLE) / count(ret) OVER (PARTITION BY ts) * 3) AS label FROM p WHERE ret IS NOT NULL)""")
def _(spark, d):
    return B.panel(spark, d).where("ret IS NOT NULL").withColumns({"bucket": cs.bucket("ret", 5), "label": cs.label_first("ret", 3)})


@query("qcut_digitize", "ts symbol", "cut digit", """e AS (SELECT list_sort(list_distinct(quantile_cont(ret, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM p),
  final AS (SELECT ts, symbol, CASE WHEN ret IS NULL THEN -1 ELSE len(list_filter(e[2:len(e) - 1], lambda v: ret > v)) END AS cut, CASE WHEN ret IS NOT NULL THEN len(list_filter(e, lambda v: ret >= v)) END AS digit FROM p, e)""")  # fmt: skip
def _(spark, d):
    x = B.panel(spark, d)
    e = x.agg(cs.edges("ret", 5).alias("e"))
    return x.join(F.broadcast(e)).withColumns({"cut": cs.cut("ret", "e"), "digit": cs.digitize("ret", "e")})


# ---- joins, masks, universes -----------------------------------------------------


@query("asof_join", "ts symbol", "value last_ts_value", """t AS (SELECT CAST(ts AS TIMESTAMP) AS ts, event_type AS symbol, arg_max(value, (value)) AS value FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
  q AS (SELECT CAST(ts AS TIMESTAMP) AS ts, event_type AS symbol, max(value) AS right_value FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
  final AS (SELECT t.ts, t.symbol, t.value, q.right_value AS last_ts_value FROM t ASOF LEFT JOIN q ON t.symbol = q.symbol AND t.ts >= q.ts)""", base="one AS (SELECT 1)")  # fmt: skip
def _(spark, d):
    ev = B.read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), "value")
    left = ev.where("event_id % 2 = 0").groupBy("ts", "symbol").agg(F.max("value").alias("value"))
    right = ev.where("event_id % 2 = 1").groupBy("ts", "symbol").agg(F.max("value").alias("last_ts_value"))
    return joins.asof_join(left, right)


@query(
    "asof_market",
    "ts symbol",
    "close last_value",
    """r AS (SELECT CAST(ts AS TIMESTAMP) AS ts, max(value) AS last_value FROM events WHERE event_id % 3 = 0 GROUP BY ALL),
  final AS (SELECT u.ts, u.symbol, u.close, r.last_value FROM u ASOF LEFT JOIN r ON u.ts >= r.ts)""",
    base=HOURLY,
)
def _(spark, d):
    right = B.read(spark, d, "events").where("event_id % 3 = 0").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("last_value"))
    return joins.asof_join(B.hourly_bars(spark, d).select("ts", "symbol", "close"), right, by=None)


EPOCHS = """vq AS (SELECT date_trunc('quarter', ts) AS q, symbol, sum(volume) AS v FROM bars GROUP BY ALL),
  ep AS (SELECT CAST(q AS DATE) AS snapshot_date, CAST(CAST(q AS DATE) + INTERVAL 3 MONTH AS DATE) AS epoch_start, CAST(CAST(q AS DATE) + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE) AS epoch_end, symbol
         FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY v DESC, symbol) AS k FROM vq) WHERE k <= 15)"""


def _epochs(spark, d) -> DataFrame:
    return cal.quarterly_epochs(B.weekly_bars(spark, d), 15)


@query("universe_epochs", "snapshot_date epoch_start epoch_end symbol", "", f"{EPOCHS}, final AS (SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, CAST(epoch_start AS VARCHAR) AS epoch_start, CAST(epoch_end AS VARCHAR) AS epoch_end, symbol FROM ep)", base=BARS)
def _(spark, d):
    return _epochs(spark, d)


@query("epoch_mask", "ts symbol", "close", f"{EPOCHS}, final AS (SELECT p.ts, p.symbol, CASE WHEN ep.symbol IS NOT NULL THEN p.close ELSE 0 END AS close FROM p LEFT JOIN ep ON p.symbol = ep.symbol AND CAST(p.ts AS DATE) BETWEEN epoch_start AND epoch_end)")
def _(spark, d):
    return cal.epoch_mask(B.panel(spark, d), _epochs(spark, d), ["close"])


@query("epoch_route", "ts snapshot_date", "n", f"{EPOCHS}, final AS (SELECT ts, CAST(snapshot_date AS VARCHAR) AS snapshot_date, count(*) AS n FROM bars JOIN (SELECT DISTINCT snapshot_date, epoch_start, epoch_end FROM ep) ON CAST(ts AS DATE) BETWEEN epoch_start AND epoch_end GROUP BY ALL)", base=BARS)
def _(spark, d):
    x = cal.epoch_route(B.weekly_bars(spark, d), _epochs(spark, d))
    return x.groupBy("ts", "snapshot_date").agg(F.count("*").alias("n"))


@query("jaccard_matrix", "a b", "common either jaccard", f"""{EPOCHS}, final AS (SELECT CAST(x.snapshot_date AS VARCHAR) AS a, CAST(y.snapshot_date AS VARCHAR) AS b, len(list_intersect(x.s, y.s)) AS common, len(list_distinct(x.s || y.s)) AS either, len(list_intersect(x.s, y.s)) / len(list_distinct(x.s || y.s)) AS jaccard
  FROM (SELECT snapshot_date, list(symbol) AS s FROM ep GROUP BY 1) x CROSS JOIN (SELECT snapshot_date, list(symbol) AS s FROM ep GROUP BY 1) y)""", base=BARS)  # fmt: skip
def _(spark, d):
    return joins.snapshot_overlap(_epochs(spark, d))


@query("universe_changes", "snapshot_date symbol kind", "", f"""{EPOCHS}, s AS (SELECT DISTINCT snapshot_date, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS prev FROM (SELECT DISTINCT snapshot_date FROM ep)),
  final AS (SELECT CAST(s.snapshot_date AS VARCHAR) AS snapshot_date, ep.symbol, 'added' AS kind FROM s JOIN ep USING (snapshot_date) WHERE prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ep o WHERE o.snapshot_date = prev AND o.symbol = ep.symbol)
  UNION ALL SELECT CAST(s.snapshot_date AS VARCHAR), o.symbol, 'removed' FROM s JOIN ep o ON o.snapshot_date = prev WHERE NOT EXISTS (SELECT 1 FROM ep WHERE ep.snapshot_date = s.snapshot_date AND ep.symbol = o.symbol))""", base=BARS)  # fmt: skip
def _(spark, d):
    x = joins.snapshot_changes(_epochs(spark, d))
    one = lambda k: x.select("snapshot_date", F.explode(k).alias("symbol"), F.lit(k).alias("kind"))
    return one("added").unionByName(one("removed"))


@query("symbol_lifetimes", "symbol always once", "n_epochs", f"{EPOCHS}, final AS (SELECT symbol, count(DISTINCT snapshot_date) AS n_epochs, count(DISTINCT snapshot_date) = (SELECT count(DISTINCT snapshot_date) FROM ep) AS always, count(DISTINCT snapshot_date) = 1 AS once FROM ep GROUP BY symbol)", base=BARS)
def _(spark, d):
    return joins.lifetimes(_epochs(spark, d))


def _mask_sql(frame: str) -> str:
    return f"a AS (SELECT *, sum(CASE WHEN coalesce(ret, 0) <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {frame}) AS k FROM p), final AS (SELECT ts, symbol, CASE WHEN k >= 5 THEN close END AS close, CASE WHEN k >= 5 THEN volume END AS volume FROM a)"


@query("prelaunch_mask", "ts symbol", "close volume", _mask_sql("UNBOUNDED PRECEDING AND CURRENT ROW"))
def _(spark, d):
    return cal.launch_mask(B.panel(spark, d), ["close", "volume"])


@query("postdeath_mask", "ts symbol", "close volume", _mask_sql("CURRENT ROW AND UNBOUNDED FOLLOWING"))
def _(spark, d):
    return cal.launch_mask(B.panel(spark, d), ["close", "volume"], after_death=True)


@query("active_set_epochs", "start until", "n", """s AS (SELECT ts, list_sort(list(DISTINCT symbol)) AS s FROM u GROUP BY ts),
  c AS (SELECT *, sum(CASE WHEN s = prev THEN 0 ELSE 1 END) OVER (ORDER BY ts) AS e FROM (SELECT *, lag(s) OVER (ORDER BY ts) AS prev FROM s)),
  f AS (SELECT e, min(ts) AS start, len(arg_min(s, ts)) AS n FROM c GROUP BY e), final AS (SELECT start, CAST(CAST(lead(start) OVER (ORDER BY start) AS DATE) - 1 AS VARCHAR) AS until, n FROM f)""", times="start", base=HOURLY)  # fmt: skip
def _(spark, d):
    return cal.active_sets(B.hourly_bars(spark, d)).withColumn("n", F.size("symbols")).withColumnRenamed("end", "until")


# ---- factors ------------------------------------------------------------------------

_RES_MOM = resid_sql("combined_score", "beta_60")
FACTORS = f"""x1 AS (SELECT *, {_ret(5)} AS ret_5d, {_ret(20)} AS ret_20d, {g('stddev_samp', 'ret', 30)} AS volatility_30, {g('skewness', 'ret', 45, 30)} AS skewness_45,
    {_ret(30)} AS roc, open_interest / nullif(lag(open_interest, 30) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS oroc, CASE WHEN close > 0 THEN basis / close END AS basis_norm,
    coalesce(basis, 0) / (CASE WHEN close = 0 THEN 1e-12 ELSE close END) AS b0, {g('avg', 'volume_ratio', 30, 15)} AS vr, open_interest / nullif(lag(open_interest) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS oi_pct_chg_1d,
    ({_COV}) / nullif({g('var_samp', 'mkt', 60)}, 0) AS beta, {g('avg', 'close', 5)} AS ma5, {g('avg', 'close', 40, 20)} AS ma40, {g('stddev_samp', 'close', 40, 20)} AS sd40,
    {zs('funding_rate', 120, 20)} AS funding_z, {g('avg', '(close * volume)', 30, 15)} AS dv FROM p),
  x2 AS (SELECT *, {g('avg', 'roc', 10)} AS price_roc, {g('avg', 'oroc', 10)} AS oi_roc, {g('avg', 'basis_norm', 3, 2)} AS basis_norm_smooth3, b0 - lag(b0, 30) OVER (PARTITION BY symbol ORDER BY ts) AS bd,
    tanh(vr - lag(vr, 30) OVER (PARTITION BY symbol ORDER BY ts)) AS vol_ratio_sig, {g('avg', 'oi_pct_chg_1d', 3, 2)} AS oi_pct_chg_smooth3,
    CASE WHEN (ma5 - ma40) / nullif(sd40, 0) IS NOT NULL THEN greatest(-3, least(3, (ma5 - ma40) / nullif(sd40, 0))) END AS reg FROM x1),
  x3 AS (SELECT *, coalesce({g('avg', 'bd', 10, 1)}, 0) AS basis_mom, CASE WHEN dv IS NOT NULL THEN ln(1 + greatest(0, dv)) END AS liquidity_log, price_roc * (1 + 2 * oi_roc) AS trend_score FROM x2),
  x4 AS (SELECT *, basis_mom * vol_ratio_sig * 5 AS sent, {pct_sql('volatility_30')} AS vol_rank_cs, {pct_sql('dv')} AS liquidity_rank_cs,
    CASE WHEN coalesce(beta, avg(beta) OVER (PARTITION BY ts)) IS NOT NULL THEN greatest(-3, least(3, coalesce(beta, avg(beta) OVER (PARTITION BY ts)))) END AS beta_60,
    (oi_pct_chg_1d - avg(oi_pct_chg_1d) OVER (PARTITION BY ts)) / nullif(stddev_samp(oi_pct_chg_1d) OVER (PARTITION BY ts), 0) AS cs_z_oi_chg,
    (reg - avg(reg) OVER (PARTITION BY ts)) / nullif(stddev_samp(reg) OVER (PARTITION BY ts), 0) AS regz FROM x3),
  x5 AS (SELECT *, {resid_sql('sent', 'trend_score')} AS sentiment_score, reg * tanh(regz / 0.6) AS regime_score, {zs('cs_z_oi_chg', 80, 40)} AS ts_z_oi_chg FROM x4),
  x6 AS (SELECT *, trend_score + sentiment_score AS combined_score, CASE WHEN ts_z_oi_chg IS NOT NULL THEN greatest(0, -ts_z_oi_chg - 0.5) END AS liquidation_shock FROM x5),
  x7 AS (SELECT *, {_RES_MOM} AS mom_final_score, liquidation_shock * regime_score AS interaction_alpha,
    CASE WHEN sign(combined_score) * funding_z < -3 THEN 0.5 WHEN sign(combined_score) * funding_z > 1.5 THEN 1.5 ELSE 1 END AS funding_penalty FROM x6),
  w7 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM x7),
  h7 AS (SELECT a.ts, a.symbol, sum(CASE WHEN b.interaction_alpha IS NOT NULL THEN power(0.5, (a.i - b.i) / 12.0) * b.interaction_alpha END) / nullif(sum(CASE WHEN b.interaction_alpha IS NOT NULL THEN power(0.5, (a.i - b.i) / 12.0) END), 0) AS reversal_hawkes
         FROM w7 a JOIN w7 b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY ALL),
  x8 AS (SELECT x7.*, reversal_hawkes FROM x7 JOIN h7 USING (ts, symbol)), x9 AS (SELECT *, {resid_sql('reversal_hawkes', 'beta_60')} AS rev_final_score FROM x8)"""


def _factors(spark, d) -> DataFrame:
    return fac.factor_panel(B.panel(spark, d))


@query("factor_panel", "ts symbol", "ret_5d ret_20d volatility_30 skewness_45 beta_60 liquidity_log vol_rank_cs liquidity_rank_cs price_roc oi_roc basis_norm basis_norm_smooth3 oi_pct_chg_1d oi_pct_chg_smooth3 basis_mom vol_ratio_sig funding_z trend_score sentiment_score combined_score funding_penalty mom_final_score cs_z_oi_chg ts_z_oi_chg liquidation_shock regime_score interaction_alpha reversal_hawkes rev_final_score", f"{FACTORS}, final AS (SELECT * FROM x9)")
def _(spark, d):
    return _factors(spark, d)


def _delta_sql(c: str) -> str:
    return f"m_{c} - lag(m_{c}, 10) OVER (PARTITION BY symbol ORDER BY ts) AS {c}_delta"


@query("factor_deltas", "ts symbol", " ".join(f"{c}_delta" for c in fac.DELTAS), f"{FACTORS}, dm AS (SELECT ts, symbol, {', '.join(g('avg', c, 5, 1) + ' AS m_' + c for c in fac.DELTAS)} FROM (SELECT * REPLACE (coalesce(ls_ratio, 1) AS ls_ratio) FROM x9)), final AS (SELECT ts, symbol, {', '.join(map(_delta_sql, fac.DELTAS))} FROM dm)")
def _(spark, d):
    return _factors(spark, d)


@query("macro_candidates", "ts", "mean_volatility liquidity_7 dispersion", f"{FACTORS}, mc AS (SELECT ts, avg(volatility_30) AS mean_volatility, sum(exp(liquidity_log) - 1) AS liq, stddev_samp(ret) AS dispersion FROM x9 GROUP BY ts), final AS (SELECT *, {g('avg', 'liq', 7, None, '')} AS liquidity_7 FROM mc)")
def _(spark, d):
    return fac.macro_candidates(_factors(spark, d))


@query("live_scores", "symbol", "score", f"{FACTORS}, final AS (SELECT symbol, CASE WHEN abs(funding_z) < 0.06 THEN 0 ELSE mom_final_score * (1 - 0.5 * coalesce(vol_rank_cs, 0.5)) * funding_penalty * (CASE WHEN ls_ratio > 2 THEN 0.5 ELSE 1 END) END AS score FROM (SELECT * REPLACE (coalesce(ls_ratio, 1) AS ls_ratio) FROM x9) WHERE ts = (SELECT max(ts) FROM x9))")
def _(spark, d):
    return fac.live_scores(_factors(spark, d))


# ---- weights --------------------------------------------------------------------------


def _scores(spark, d) -> DataFrame:
    """A simple score: the return, on the dense panel."""
    return B.panel(spark, d).withColumn("score", F.col("ret"))


def _weights_sql(mode: str, cap: float = 0.1) -> str:
    size = {
        "rank": "CASE WHEN side = 1 THEN r - (n - nl) ELSE ns + 1 - r END",
        "zscore": "greatest(-3, least(3, (ret - mu) / (coalesce(sd, 0) + 1e-12) * side))",
        "raw": "(ret - mu) * side",
        "equal": "1.0",
    }[mode]
    return f"""w1 AS (SELECT ts, symbol, ret, count(*) OVER (PARTITION BY ts) AS n, row_number() OVER (PARTITION BY ts ORDER BY ret, symbol) AS r, avg(ret) OVER (PARTITION BY ts) AS mu, stddev_samp(ret) OVER (PARTITION BY ts) AS sd FROM p WHERE ret IS NOT NULL),
  w2 AS (SELECT *, CASE WHEN r > n * (1 - 0.2::DOUBLE) THEN 1 WHEN r <= n * 0.2::DOUBLE THEN -1 END AS side FROM w1),
  w3 AS (SELECT *, count(*) FILTER (WHERE side = 1) OVER (PARTITION BY ts) AS nl, count(*) FILTER (WHERE side = -1) OVER (PARTITION BY ts) AS ns FROM w2),
  w4 AS (SELECT *, greatest(CAST({size} AS DOUBLE), 0) AS s FROM w3 WHERE side IS NOT NULL AND nl > 0 AND ns > 0),
  wf AS (SELECT ts, symbol, least(coalesce(s / nullif(sum(s) OVER (PARTITION BY ts, side), 0) * 0.5, 0), {cap}) * side AS weight FROM w4)"""


for _mode in ("rank", "zscore", "raw", "equal"):

    @query(f"weights_{_mode}", "ts symbol", "weight", f"{_weights_sql(_mode)}, final AS (SELECT * FROM wf)")
    def _(spark, d, mode=_mode):
        return wt.predictions_to_weights(_scores(spark, d), mode=mode)


@query("weights_linear", "ts symbol", "weight", """a AS (SELECT ts, symbol, ret - avg(ret) OVER (PARTITION BY ts) AS d FROM p WHERE ret IS NOT NULL), b AS (SELECT *, coalesce(d / nullif(sum(abs(d)) OVER (PARTITION BY ts), 0), 0) AS w FROM a),
  final AS (SELECT ts, symbol, CASE WHEN abs(greatest(-0.1, least(0.1, w))) < 1e-4 THEN 0 ELSE greatest(-0.1, least(0.1, w)) END AS weight FROM b)""")  # fmt: skip
def _(spark, d):
    return wt.linear(_scores(spark, d))


_BAL = """b1 AS (SELECT ts, symbol, coalesce(ret, 0) AS v0 FROM p), b2 AS (SELECT *, CASE WHEN least(count(*) FILTER (WHERE v0 > 0) OVER (PARTITION BY ts), count(*) FILTER (WHERE v0 < 0) OVER (PARTITION BY ts)) < 3 THEN 0 ELSE v0 END AS v FROM b1),
  b3 AS (SELECT *, sum(greatest(v, 0)) OVER (PARTITION BY ts) AS l, sum(greatest(-v, 0)) OVER (PARTITION BY ts) AS s FROM b2),
  c0 AS (SELECT ts, symbol, CASE WHEN l <= 0 OR s <= 0 THEN 0 WHEN v > 0 THEN v / l * 0.5 ELSE v / s * 0.5 END AS weight FROM b3)"""
_CAP = ", ".join(
    f"""d{k} AS (SELECT ts, symbol, greatest(-0.08, least(0.08, weight)) AS c FROM c{k - 1}), e{k} AS (SELECT *, sum(greatest(c, 0)) OVER (PARTITION BY ts) AS l, sum(greatest(-c, 0)) OVER (PARTITION BY ts) AS s FROM d{k}),
  c{k} AS (SELECT ts, symbol, coalesce(c * least(0.5, l, s) / nullif(CASE WHEN c > 0 THEN l ELSE s END, 0), 0) AS weight FROM e{k})"""
    for k in range(1, 9)
)


@query("weights_balanced", "ts symbol", "weight", f"{_BAL}, final AS (SELECT * FROM c0)")
def _(spark, d):
    return wt.balanced(_scores(spark, d), min_active=3, value="score")


@query("weights_iter_cap", "ts symbol", "weight", f"{_BAL}, {_CAP}, final AS (SELECT * FROM c8)")
def _(spark, d):
    return wt.balanced(_scores(spark, d), min_active=3, cap=0.08, value="score")


_MOM = f"""o1 AS (SELECT *, nullif(coalesce(volatility_30, 0), 0) AS vol FROM x9), o2 AS (SELECT *, coalesce({pct_sql('vol')}, 0.5) AS vrk FROM o1), o3 AS (SELECT *, combined_score * greatest(1 - vrk * 0.5, 0) AS f0 FROM o2),
  o4 AS (SELECT *, {resid_sql('f0', 'beta_60')} AS fs FROM o3), o5 AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY fs, symbol) AS rk, count(fs) OVER (PARTITION BY ts) AS nn FROM o4),
  o6 AS (SELECT *, CASE WHEN rk > nn * (1 - 0.3::DOUBLE) THEN 1 WHEN rk <= nn * 0.3::DOUBLE THEN -1 ELSE 0 END AS side FROM o5), o7 AS (SELECT *, CAST(CASE side WHEN 1 THEN rk WHEN -1 THEN nn + 1 - rk ELSE 0 END AS DOUBLE) AS s FROM o6),
  o8 AS (SELECT *, greatest(-0.1, least(0.1, coalesce(s / nullif(sum(s) OVER (PARTITION BY ts, side), 0), 0) * 0.5 * side)) AS weight_full FROM o7), o9 AS (SELECT *, CASE WHEN weight_full <> 0 THEN abs(coalesce(volatility_30, 0)) END AS tv FROM o8),
  om AS (SELECT *, CASE WHEN {pct_sql('tv')} >= 1 / 3.0::DOUBLE THEN 0 ELSE weight_full END AS weight_traded FROM o9)"""


@query("weights_momentum", "ts symbol", "weight_full weight_traded", f"{FACTORS}, {_MOM}, final AS (SELECT * FROM om)")
def _(spark, d):
    return wt.momentum(_factors(spark, d))


def _last_sql(bonus: str = "1.0") -> str:
    """Weights on the last date; bonus: the factor of a name's rank, over l1."""
    return f"""{FACTORS},
  l1 AS (
    SELECT *, mom_final_score AS f, count(mom_final_score) OVER () AS n, row_number() OVER (ORDER BY mom_final_score NULLS LAST, symbol) AS r
    FROM x9 WHERE ts = (SELECT max(ts) FROM x9)),
  l2 AS (SELECT *, floor(n * 0.3) AS k, n - floor(n * 0.7) AS m, {bonus} AS bonus FROM l1),
  l3 AS (SELECT *, CASE WHEN f IS NULL THEN 0 WHEN r > n - k THEN 1 WHEN r <= m THEN -1 ELSE 0 END AS side FROM l2),
  l4 AS (SELECT *, bonus * CAST(CASE side WHEN 1 THEN r - (n - k) WHEN -1 THEN m + 1 - r ELSE 0 END AS DOUBLE) AS s FROM l3),
  final AS (SELECT ts, symbol, greatest(-0.1, least(0.1, coalesce(s / nullif(sum(s) OVER (PARTITION BY side), 0), 0) * 0.5 * side)) AS weight FROM l4)"""


@query("weights_momentum_last", "ts symbol", "weight", _last_sql())
def _(spark, d):
    return wt.momentum_last(_factors(spark, d))


_MASKS = (("price_roc", (4, 5), 5), ("volatility_30", (1, 2), 4))


def _mask_sql(factor: str, quantiles: tuple[int, ...], parts: int) -> str:
    place = f"row_number() OVER (ORDER BY CASE WHEN f IS NOT NULL THEN {factor} END NULLS LAST, f DESC NULLS LAST, symbol)"
    label = f"ceil({place} / count(CASE WHEN f IS NOT NULL THEN {factor} END) OVER ()::DOUBLE * {parts})"
    return f"CASE WHEN f IS NOT NULL AND {factor} IS NOT NULL AND {label} IN ({', '.join(map(str, quantiles))}) THEN 1 ELSE 0 END"


_HITS = " + ".join(_mask_sql(*m) for m in _MASKS)


@query("weights_momentum_masked", "ts symbol", "weight", _last_sql(f"CASE WHEN {_HITS} > 0 THEN {_HITS} - 0.5 ELSE 1.0 END"))
def _(spark, d):
    return wt.momentum_last(_factors(spark, d), masks=_MASKS)


def _zcap(x: str, n: int) -> str:
    return f"({x} - {g('avg', x, n, n // 2)}) / nullif(greatest(-2, least(2, {g('stddev_samp', x, n, n // 2)})), 0)"


@query("reversal_signal", "ts symbol", "signal", f"""{FACTORS}, v1 AS (SELECT *, coalesce(ls_ratio, 1) - lag(coalesce(ls_ratio, 1)) OVER (PARTITION BY symbol ORDER BY ts) AS lc FROM x9), v2 AS (SELECT *, coalesce({g('avg', 'lc', 3, 2)}, 0) AS ls3 FROM v1),
  v3 AS (SELECT *, {_zcap('oi_pct_chg_smooth3', 80)} AS za, {_zcap('ls3', 80)} AS zb FROM v2), v4 AS (SELECT *, {_zcap('za', 80)} AS zaa FROM v3), v5 AS (SELECT *, -zaa * zb AS q FROM v4), v6 AS (SELECT *, {resid_sql('q', 'beta_60')} AS pp, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM v5),
  final AS (SELECT a.ts, a.symbol, CASE WHEN count(b.pp) >= 12 THEN sum(power(0.5, (a.k - b.k) / 12.0) * b.pp) / sum(power(0.5, (a.k - b.k) / 12.0)) END AS signal FROM v6 a JOIN v6 b ON a.symbol = b.symbol AND b.k <= a.k GROUP BY ALL)""")  # fmt: skip
def _(spark, d):
    x = _factors(spark, d).withColumn("ls_chg_smooth3", F.coalesce("ls_chg_smooth3", F.lit(0.0)))
    return wt.reversal_signal(x)


@query("weights_distributed", "ts symbol", "weight", """a AS (SELECT ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY ret, symbol) AS r, count(*) OVER (PARTITION BY ts) AS n FROM p WHERE ret IS NOT NULL), b AS (SELECT *, floor(n * 0.4::DOUBLE) AS k FROM a),
  final AS (SELECT ts, symbol, greatest(-0.1, least(0.1, CASE WHEN r > n - k THEN (r - (n - k)) / (k * (k + 1) / 2) * 0.5 WHEN r <= k THEN -(k + 1 - r) / (k * (k + 1) / 2) * 0.5 ELSE 0 END)) AS weight FROM b)""")  # fmt: skip
def _(spark, d):
    return wt.distributed(_scores(spark, d))


_LAGGED = f"""wl AS (SELECT *, lag(ret, 4) OVER (PARTITION BY symbol ORDER BY ts) AS s4 FROM p), w0 AS (SELECT snapshot_date AS e, epoch_start, epoch_end, ts, symbol, s4 FROM wl JOIN ep USING (symbol) WHERE s4 IS NOT NULL),
  w1 AS (SELECT *, count(*) OVER (PARTITION BY e, ts) AS n, row_number() OVER (PARTITION BY e, ts ORDER BY s4, symbol) AS r FROM w0), w2 AS (SELECT *, CASE WHEN r > n * (1 - 0.2::DOUBLE) THEN 1 WHEN r <= n * 0.2::DOUBLE THEN -1 END AS side FROM w1),
  w3 AS (SELECT *, count(*) FILTER (WHERE side = 1) OVER (PARTITION BY e, ts) AS nl, count(*) FILTER (WHERE side = -1) OVER (PARTITION BY e, ts) AS ns FROM w2),
  w4 AS (SELECT *, CAST(CASE WHEN side = 1 THEN r - (n - nl) ELSE ns + 1 - r END AS DOUBLE) AS s FROM w3 WHERE side IS NOT NULL AND nl > 0 AND ns > 0),
  w5 AS (SELECT ts, symbol, least(coalesce(s / nullif(sum(s) OVER (PARTITION BY e, ts, side), 0) * 0.5, 0), 0.1) * side AS weight, CAST(ts AS DATE) BETWEEN epoch_start AND epoch_end AS own FROM w4)"""


@query("weights_per_epoch", "ts symbol", "weight", f"{EPOCHS}, {_LAGGED}, final AS (SELECT p.ts, p.symbol, coalesce(w.weight, 0) AS weight FROM p LEFT JOIN (SELECT * FROM w5 WHERE own) w ON p.ts = w.ts AND p.symbol = w.symbol)")
def _(spark, d):
    """A strategy with a window over time: the return four rows before."""

    def lagged(df, by):
        w = W.partitionBy("epoch_id", "symbol").orderBy("ts")
        return wt.predictions_to_weights(df.withColumn("score", F.lag("ret", 4).over(w)), by=by)

    return wt.per_epoch(B.panel(spark, d), _epochs(spark, d), lagged, ["weight"])


# ---- backtests ------------------------------------------------------------------------


def _w(spark, d, mode: str = "rank") -> DataFrame:
    x = _scores(spark, d)
    return x.select("ts", "symbol").join(wt.predictions_to_weights(x, mode=mode), ["ts", "symbol"], "left").fillna(0.0, ["weight"])


WDENSE = f"{_weights_sql('rank')}, wd AS (SELECT p.ts, p.symbol, coalesce(weight, 0) AS weight FROM p LEFT JOIN wf USING (ts, symbol))"
_LW = "OVER (PARTITION BY symbol ORDER BY ts)"
BT = f"""{WDENSE}, k1 AS (SELECT p.ts, p.symbol, weight, last_value(close IGNORE NULLS) {_ALL} AS c FROM p JOIN wd USING (ts, symbol)),
  k2 AS (SELECT *, coalesce(c / nullif(lag(c) {_LW}, 0) - 1, 0) AS rr, abs(weight - lag(weight) {_LW}) AS tt, coalesce(lag(weight, 1) {_LW}, 0) AS w1, coalesce(lag(weight, 2) {_LW}, 0) AS w2, coalesce(lag(weight, 3) {_LW}, 0) AS w3 FROM k1),
  k3 AS (SELECT ts, coalesce(sum(tt), 0) AS turnover, sum(w1 * rr) AS gross_1, sum(w2 * rr) AS gross_2, sum(w3 * rr) AS gross_3 FROM k2 GROUP BY ts),
  kb AS (SELECT *, 10000 * product(1 + gross_1 - turnover * 0.0007) OVER (ORDER BY ts) AS equity_1, 10000 * product(1 + gross_2 - turnover * 0.0007) OVER (ORDER BY ts) AS equity_2, 10000 * product(1 + gross_3 - turnover * 0.0007) OVER (ORDER BY ts) AS equity_3 FROM k3)"""


@query("backtest_vectorized", "ts", "turnover gross_1 gross_2 gross_3 equity_1 equity_2 equity_3", f"{BT}, final AS (SELECT * FROM kb)")
def _(spark, d):
    return bt.vectorised(_w(spark, d), B.panel(spark, d))


@query("backtest_summary", "", "final_equity return_pct sharpe win_rate turnover_avg", f"""{BT}, z AS (SELECT *, coalesce(equity_1 / nullif(lag(equity_1) OVER (ORDER BY ts), 0) - 1, 0) AS rr FROM kb),
  final AS (SELECT arg_max(equity_1, ts) AS final_equity, (arg_max(equity_1, ts) / arg_min(equity_1, ts) - 1) * 100 AS return_pct, coalesce(avg(rr) / nullif(stddev_samp(rr), 0) * sqrt(365), 0) AS sharpe, avg(CASE WHEN rr > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(turnover) AS turnover_avg FROM z)""")  # fmt: skip
def _(spark, d):
    return bt.summary(bt.vectorised(_w(spark, d), B.panel(spark, d)))


_LAGS = ", ".join(f"coalesce(lag(weight, {k}) {_LW}, 0) AS v{k}, coalesce(lag(tt, {k}) {_LW}, 0) AS c{k}" for k in range(4))


@query("lag_decay", "lag", "total mean std", f"""{WDENSE}, l1 AS (SELECT p.ts, p.symbol, weight, last_value(close IGNORE NULLS) {_ALL} AS c FROM p JOIN wd USING (ts, symbol)),
  l2 AS (SELECT *, coalesce(c / nullif(lag(c) {_LW}, 0) - 1, 0) AS rr, coalesce(abs(weight - lag(weight) {_LW}), 0) AS tt FROM l1), l3 AS (SELECT *, {_LAGS} FROM l2),
  l4 AS (SELECT k.lag, ts, sum([v0, v1, v2, v3][k.lag + 1] * rr) - 0.0007 * sum([c0, c1, c2, c3][k.lag + 1]) AS net FROM l3, (SELECT unnest([0, 1, 2, 3]) AS lag) k GROUP BY ALL), final AS (SELECT lag, sum(net) AS total, avg(net) AS mean, stddev_samp(net) AS std FROM l4 GROUP BY lag)""")  # fmt: skip
def _(spark, d):
    return bt.lag_decay(_w(spark, d), B.panel(spark, d))


@query("weight_daily", "ts", "gross net n n_long n_short effective_n hhi turnover", f"""{WDENSE}, a AS (SELECT *, abs(weight - lag(weight) {_LW}) AS dd FROM wd),
  final AS (SELECT ts, sum(abs(weight)) AS gross, sum(weight) AS net, count(*) FILTER (WHERE weight <> 0) AS n, count(*) FILTER (WHERE weight > 0) AS n_long, count(*) FILTER (WHERE weight < 0) AS n_short, 1 / nullif(sum(weight * weight), 0) AS effective_n,
  sum(weight * weight) / nullif(sum(abs(weight)) * sum(abs(weight)), 0) AS hhi, coalesce(sum(dd), 0) AS turnover FROM a GROUP BY ts)""")  # fmt: skip
def _(spark, d):
    return reports.weight_daily(_w(spark, d))


@query("weight_assets", "symbol", "days mean_long mean_short mean_abs max_abs", f"{WDENSE}, final AS (SELECT symbol, count(*) FILTER (WHERE weight <> 0) AS days, avg(weight) FILTER (WHERE weight > 0) AS mean_long, avg(weight) FILTER (WHERE weight < 0) AS mean_short, avg(abs(weight)) AS mean_abs, max(abs(weight)) AS max_abs FROM wd GROUP BY symbol)")
def _(spark, d):
    return reports.weight_assets(_w(spark, d))


@query("weight_summary", "", "min max mean std p5 p95 n", f"{WDENSE}, final AS (SELECT min(weight) AS min, max(weight) AS max, avg(weight) AS mean, stddev_pop(weight) AS std, quantile_cont(weight, 0.05) AS p5, quantile_cont(weight, 0.95) AS p95, count(*) AS n FROM wd WHERE weight <> 0)")
def _(spark, d):
    return reports.weight_summary(_w(spark, d))


@query("gross_ratio", "ts", "ratio", f"{WDENSE}, a AS (SELECT ts, sum(greatest(weight, 0)) / nullif(sum(greatest(-weight, 0)), 0) AS q FROM wd GROUP BY ts), final AS (SELECT ts, CASE WHEN median(q) {over(10, '')} IS NOT NULL THEN greatest(0, least(5, median(q) {over(10, '')})) END AS ratio FROM a)")
def _(spark, d):
    return reports.gross_ratio(_w(spark, d))


_TWO = f"{_weights_sql('rank')}, " + _weights_sql("rank").replace("ret", "basis").replace("w1 ", "b1 ").replace("FROM w1", "FROM b1").replace("w2 ", "b2 ").replace("FROM w2", "FROM b2").replace("w3 ", "b3 ").replace("FROM w3", "FROM b3").replace("w4 ", "b4 ").replace("FROM w4", "FROM b4").replace("wf ", "bf ")
_TWO += """, tn AS (SELECT unnest(['ret', 'basis']) AS strategy), tk AS (SELECT DISTINCT ts, symbol FROM (SELECT ts, symbol FROM wf UNION ALL SELECT ts, symbol FROM bf)),
  tw AS (SELECT strategy, k.ts, k.symbol, coalesce(w.weight, 0) AS weight FROM (SELECT strategy, ts, symbol FROM tn, (SELECT DISTINCT ts FROM tk), (SELECT DISTINCT symbol FROM tk)) k LEFT JOIN (SELECT 'ret' AS strategy, * FROM wf UNION ALL SELECT 'basis', * FROM bf) w USING (strategy, ts, symbol))"""


@query("strategy_overlap", "symbol", "both only_a only_b same_sign opposite_sign", f"""{_TWO}, o AS (SELECT symbol, coalesce(a.weight, 0) AS a, coalesce(b.weight, 0) AS b FROM (SELECT p.ts, p.symbol, coalesce(weight, 0) AS weight FROM p LEFT JOIN wf USING (ts, symbol)) a FULL JOIN bf b USING (ts, symbol)),
  final AS (SELECT symbol, count(*) FILTER (WHERE a <> 0 AND b <> 0) AS "both", count(*) FILTER (WHERE a <> 0 AND b = 0) AS only_a, count(*) FILTER (WHERE a = 0 AND b <> 0) AS only_b, count(*) FILTER (WHERE a * b > 0) AS same_sign, count(*) FILTER (WHERE a * b < 0) AS opposite_sign FROM o GROUP BY symbol)""")  # fmt: skip
def _(spark, d):
    other = B.panel(spark, d).withColumn("score", F.col("basis"))
    return reports.overlap(_w(spark, d), wt.predictions_to_weights(other))


def _two(spark, d) -> DataFrame:
    x = B.panel(spark, d)
    return joins.aligned({"ret": wt.predictions_to_weights(x.withColumn("score", F.col("ret"))), "basis": wt.predictions_to_weights(x.withColumn("score", F.col("basis")))})


_ALPHA = "ta AS (SELECT *, nullif(weight, 0) AS x FROM tw), tz AS (SELECT *, (x - avg(x) OVER (PARTITION BY strategy, ts)) / nullif(stddev_samp(x) OVER (PARTITION BY strategy, ts), 0) AS z FROM ta), al AS (SELECT ts, symbol, avg(z) AS score FROM tz GROUP BY ALL)"


@query("composite_alpha", "ts symbol", "score", f"{_TWO}, {_ALPHA}, final AS (SELECT * FROM al)")
def _(spark, d):
    return wt.composite_alpha(_two(spark, d))


_SRET = "sr AS (SELECT strategy, ts, coalesce(sum(pw * coalesce(ret, 0)), 0) AS ret FROM (SELECT *, lag(weight) OVER (PARTITION BY strategy, symbol ORDER BY ts) AS pw FROM tw) JOIN (SELECT ts, symbol, ret FROM p) USING (ts, symbol) GROUP BY ALL)"


@query("strategy_returns", "strategy ts", "ret", f"{_TWO}, {_SRET}, final AS (SELECT * FROM sr)")
def _(spark, d):
    return bt.strategy_returns(_two(spark, d), B.panel(spark, d))


@query("equal_weight_mix", "ts symbol", "weight", f"{_TWO}, e1 AS (SELECT ts, symbol, greatest(-0.1, least(0.1, avg(weight))) AS w FROM tw GROUP BY ALL), final AS (SELECT ts, symbol, w * CASE WHEN sum(abs(w)) OVER (PARTITION BY ts) > 1 THEN 1 / sum(abs(w)) OVER (PARTITION BY ts) ELSE 1 END AS weight FROM e1)")
def _(spark, d):
    return portfolio.equal_weight(_two(spark, d))


def _smooth_sql(source: str, alpha: float, leverage: float) -> str:
    """Smoothed weights sw(strategy, ts, symbol, weight) of source(strategy, ts, symbol,
    weight, aside): a row a date with its symbols as a list; dates aside are passed over."""
    return f"""
  sv AS (
    SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY ts) AS i
    FROM (SELECT strategy, ts, list(weight ORDER BY symbol) AS x FROM {source} WHERE NOT aside GROUP BY ALL)),
  sm AS (
    SELECT strategy, i, x AS w FROM sv WHERE i = 1
    UNION ALL
    SELECT strategy, i, CASE WHEN g > 1e-8 AND g < {leverage} THEN list_transform(v, lambda z: z * ({leverage} / g)) ELSE v END
    FROM (
      SELECT strategy, i, v, list_sum(list_transform(v, lambda z: abs(z))) AS g
      FROM (SELECT s.strategy, s.i, list_transform(list_zip(s.x, r.w), lambda z: {alpha} * z[1] + (1 - {alpha}) * z[2]) AS v
            FROM sm r JOIN sv s ON s.strategy = r.strategy AND s.i = r.i + 1))),
  sw AS (
    SELECT sm.strategy, sv.ts, unnest(names) AS symbol, unnest(w) AS weight
    FROM sm JOIN sv USING (strategy, i), (SELECT list(DISTINCT symbol ORDER BY symbol) AS names FROM {source})
    UNION ALL SELECT strategy, ts, symbol, weight FROM {source} WHERE aside)"""


@query("smoothed_weights", "strategy ts symbol", "weight", f"{_TWO}, so AS (SELECT *, false AS aside FROM tw), {_smooth_sql('so', 0.3, 0.8)}, final AS (SELECT * FROM sw)", recursive=True)
def _(spark, d):
    return wt.smoothed(_two(spark, d), 0.3, 0.8)


@query("mean_variance_allocator", "ts symbol", "weight")
def _(spark, d):
    return portfolio.allocate(_scores(spark, d))


# Two shares: the one of `ret` is where the gain's slope is 0, or an end of [0, 1].
_MIX = """
  m1 AS (SELECT ts, coalesce(sum(ret) FILTER (strategy = 'ret'), 0) AS a, coalesce(sum(ret) FILTER (strategy = 'basis'), 0) AS b FROM sr GROUP BY ts),
  m2 AS (
    SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER w AS n, avg(a) OVER w AS ma, avg(b) OVER w AS mb,
           var_samp(a) OVER w + 1e-8 AS va, var_samp(b) OVER w + 1e-8 AS vb, covar_samp(a, b) OVER w / 2 AS c
    FROM m1 WINDOW w AS (ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
  m3 AS (SELECT ts, i, CASE WHEN n >= 30 THEN greatest(0, least(1, ((ma - mb) / 2 + vb - c) / (va - 2 * c + vb))) ELSE 0.5 END AS x FROM m2)"""


@query(
    "strategy_mix",
    "ts strategy",
    "share",
    f"""{_TWO}, {_SRET}, {_MIX},
  m4 AS (
    SELECT p.ts, sum(q.x * CASE WHEN q.i = 1 THEN power(0.7, p.i - 1) ELSE 0.3 * power(0.7, p.i - q.i) END) AS s
    FROM m3 p JOIN m3 q ON q.i <= p.i GROUP BY p.ts),
  final AS (SELECT ts, 'ret' AS strategy, s AS share FROM m4 UNION ALL SELECT ts, 'basis', 1 - s FROM m4)""",
)
def _(spark, d):
    return portfolio.strategy_mix(bt.strategy_returns(_two(spark, d), B.panel(spark, d)), ["ret", "basis"], ema=0.3)


@query("event_backtest", "strategy ts", "equity n_fills")
def _(spark, d):
    return bt.event_driven(_w(spark, d).withColumn("strategy", F.lit("rank")), B.panel(spark, d))


# ---- attribution -------------------------------------------------------------------------


@query("quantile_forward", "ts bucket", "ret cumulative", f"""a AS (SELECT *, lead(ret) {_LW} AS fw FROM p), b AS (SELECT ts, greatest(ceil({pct_sql('basis')} * 5), 1) AS bucket, fw FROM a WHERE basis IS NOT NULL), c AS (SELECT ts, CAST(bucket AS INTEGER) AS bucket, coalesce(avg(fw), 0) AS ret FROM b GROUP BY ALL),
  final AS (SELECT *, sum(ret) OVER (PARTITION BY bucket ORDER BY ts) AS cumulative FROM c)""")  # fmt: skip
def _(spark, d):
    return bt.quantile_forward(B.panel(spark, d), "basis")


@query("pure_factor_quantiles", "ts bucket", "ret cumulative", f"""a AS (SELECT *, lead(ret) {_LW} AS fw FROM p), b AS (SELECT ts, greatest(ceil({pct_sql('basis')} * 3), 1) AS bucket, fw - avg(fw) OVER (PARTITION BY ts) AS fw FROM a WHERE basis IS NOT NULL), c AS (SELECT ts, CAST(bucket AS INTEGER) AS bucket, coalesce(avg(fw), 0) AS ret FROM b GROUP BY ALL),
  final AS (SELECT *, sum(ret) OVER (PARTITION BY bucket ORDER BY ts) AS cumulative FROM c)""")  # fmt: skip
def _(spark, d):
    return bt.quantile_forward(B.panel(spark, d), "basis", 3, demean=True)


@query("traded_contribution", "ts bucket", "pnl", f"""{WDENSE}, t1 AS (SELECT *, lead(ret) {_LW} AS gain, CASE WHEN weight <> 0 THEN abs(basis) END AS x FROM p JOIN wd USING (ts, symbol)), t2 AS (SELECT * FROM t1 WHERE x IS NOT NULL),
  t3 AS (SELECT ts, CAST(greatest(ceil({pct_sql('x')} * 3), 1) AS INTEGER) AS bucket, weight * gain AS v FROM t2), final AS (SELECT ts, bucket, coalesce(sum(v), 0) AS pnl FROM t3 GROUP BY ALL)""")  # fmt: skip
def _(spark, d):
    x = B.panel(spark, d).join(_w(spark, d).withColumnRenamed("weight", "position_qty"), ["ts", "symbol"])
    return bt.traded_contribution(x, "basis")


def _daily(spark, d) -> DataFrame:
    ev = B.read(spark, d, "events")
    return ev.groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("ts")).agg((F.avg("value") - 50).alias("pnl"), F.max_by("event_type", "event_id").alias("regime"))


DAILY = "y AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, avg(value) - 50 AS pnl, arg_max(event_type, event_id) AS regime FROM events GROUP BY 1)"


@query("weekday_report", "weekday", "pnl mean std days win_rate sharpe", """a AS (SELECT dayname(ts) AS weekday, sum(pnl) AS pnl, avg(pnl) AS mean, stddev_samp(pnl) AS std, count(*) AS days, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS win_rate FROM y GROUP BY 1),
  final AS (SELECT d.weekday, coalesce(pnl, 0) AS pnl, coalesce(mean, 0) AS mean, coalesce(std, 0) AS std, coalesce(days, 0) AS days, coalesce(win_rate, 0) AS win_rate, coalesce(mean / nullif(std, 0) * sqrt(365), 0) AS sharpe FROM (SELECT unnest(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']) AS weekday) d LEFT JOIN a USING (weekday))""", base=DAILY)  # fmt: skip
def _(spark, d):
    return reports.by_weekday(_daily(spark, d))


@query("regime_report", "regime", "pnl trades win_rate", "final AS (SELECT regime, sum(pnl) AS pnl, count(*) AS trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS win_rate FROM y GROUP BY regime)", base=DAILY)
def _(spark, d):
    return reports.by_regime(_daily(spark, d), "regime")


@query("predictive_regime", "regime", "pnl mean days", "a AS (SELECT *, lead(pnl) OVER (ORDER BY ts) AS nx FROM y), final AS (SELECT regime, sum(nx) AS pnl, avg(nx) AS mean, count(*) AS days FROM a WHERE nx IS NOT NULL GROUP BY regime)", base=DAILY)
def _(spark, d):
    return reports.regime_attribution(_daily(spark, d), "regime", 1)


_IC = f"a AS (SELECT *, lead(ret) {_LW} AS fw FROM p), b AS (SELECT * FROM a WHERE basis IS NOT NULL AND fw IS NOT NULL), c AS (SELECT ts, {rank_sql('basis')} AS ra, {rank_sql('fw')} AS rb FROM b), ic AS (SELECT ts, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS ic FROM c GROUP BY ts HAVING count(*) >= 5)"


def _ic(spark, d) -> DataFrame:
    return reports.information_coefficient(B.panel(spark, d).withColumn("fw", ts.lead("ret")), "basis", "fw")


@query("ic_spearman", "ts", "ic", f"{_IC}, final AS (SELECT * FROM ic)")
def _(spark, d):
    return _ic(spark, d)


@query("ic_summary", "", "mean std ir positive days", f"{_IC}, final AS (SELECT avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / nullif(stddev_samp(ic), 0) AS ir, avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0 END) AS positive, count(*) AS days FROM ic)")
def _(spark, d):
    return reports.ic_summary(_ic(spark, d))


@query("ic_expanding", "ts", "mean ir mean_21", f"{_IC}, final AS (SELECT ts, avg(ic) OVER (ORDER BY ts) AS mean, avg(ic) OVER (ORDER BY ts) / nullif(stddev_samp(ic) OVER (ORDER BY ts), 0) AS ir, avg(ic) {over(21, '')} AS mean_21 FROM ic)")
def _(spark, d):
    return reports.expanding_ir(_ic(spark, d))


_LAB = "lab AS (SELECT l_linenumber AS x, CAST(l_quantity AS INTEGER) % 4 AS y, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS g FROM lineitem)"


@query("conditional_mi", "", "cmi", f"""{_LAB}, k AS (SELECT g, x, y, CAST(count(*) AS DOUBLE) AS n FROM lab GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY g) AS ng, sum(n) OVER (PARTITION BY g, x) AS nx, sum(n) OVER (PARTITION BY g, y) AS ny FROM k),
  m AS (SELECT g, sum(n) AS n, sum(n / ng * ln(n * ng / (nx * ny))) AS mi FROM t GROUP BY g), final AS (SELECT sum(CASE WHEN n >= 4 THEN n * mi ELSE 0 END) / sum(n) AS cmi FROM m)""", base="one AS (SELECT 1)")  # fmt: skip
def _(spark, d):
    x = B.read(spark, d, "lineitem").selectExpr("l_linenumber AS x", "CAST(l_quantity AS INT) % 4 AS y", "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS g")
    return reports.conditional_mutual_information(x, "x", "y", "g")


@query("histogram_price", "bin", "n", "e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), final AS (SELECT bin, count(*) AS n FROM (SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 60) + 1, 60) AS INTEGER) AS bin FROM lineitem, e) GROUP BY bin)", base="one AS (SELECT 1)")
def _(spark, d):
    return reports.histogram(B.read(spark, d, "lineitem"), "l_extendedprice", 60)


@query("empirical_cdf", "value", "share", "final AS (SELECT DISTINCT l_quantity AS value, cume_dist() OVER (ORDER BY l_quantity) AS share FROM lineitem)", base="one AS (SELECT 1)")
def _(spark, d):
    return reports.cdf(B.read(spark, d, "lineitem"), "l_quantity")


def _importance(spark, d) -> DataFrame:
    """An importance table of the fixtures: price by brand pair, month and type."""
    li = B.read(spark, d, "lineitem").join(B.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    term = F.when(F.col("p_size") % 3 == 0, F.concat(F.substring("p_brand", 7, 1), F.lit(" & "), F.substring("p_brand", 8, 1))).otherwise(F.substring("p_brand", 7, 1))
    return li.groupBy(F.col("l_returnflag").alias("model"), F.year("l_shipdate").alias("fold"), term.alias("term")).agg(F.avg("l_extendedprice").alias("importance"))


IMP = "imp AS (SELECT l_returnflag AS model, year(l_shipdate) AS fold, CASE WHEN p_size % 3 = 0 THEN substr(p_brand, 7, 1) || ' & ' || substr(p_brand, 8, 1) ELSE substr(p_brand, 7, 1) END AS term, avg(l_extendedprice) AS importance FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


@query("importance_split", "feature", "main main_std interaction interaction_std", """a AS (SELECT fold, unnest(string_split(term, ' & ')) AS feature, contains(term, ' & ') AS inter, importance FROM imp), b AS (SELECT fold, feature, sum(CASE WHEN inter THEN 0 ELSE importance END) AS m, sum(CASE WHEN inter THEN importance ELSE 0 END) AS i FROM a GROUP BY ALL),
  c AS (SELECT fold, feature, coalesce(m, 0) AS m, coalesce(i, 0) AS i FROM (SELECT DISTINCT fold FROM imp) CROSS JOIN (SELECT DISTINCT feature FROM b) LEFT JOIN b USING (fold, feature)), final AS (SELECT feature, avg(m) AS main, stddev_samp(m) AS main_std, avg(i) AS interaction, stddev_samp(i) AS interaction_std FROM c GROUP BY feature)""", base=IMP)  # fmt: skip
def _(spark, d):
    return reports.split_importance(_importance(spark, d))


@query("importance_models", "term dominant", "dispersion rank_shift", """a AS (SELECT model, term, avg(importance) AS v FROM imp GROUP BY ALL), b AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY v DESC) AS r FROM a),
  final AS (SELECT term, arg_max(model, (v, model)) AS dominant, stddev_samp(v) AS dispersion, max(r) - min(r) AS rank_shift FROM b GROUP BY term)""", base=IMP)  # fmt: skip
def _(spark, d):
    return reports.compare_models(_importance(spark, d))


def _one_model(spark, d) -> DataFrame:
    return _importance(spark, d).groupBy("fold", "term").agg(F.avg("importance").alias("importance"))


# The shares of the main effects on the full grid of folds, absent ones 0.
SHARES = """m1 AS (SELECT fold, term, avg(importance) AS v FROM imp WHERE NOT contains(term, ' & ') GROUP BY ALL), m2 AS (SELECT fold, term, coalesce(v, 0) AS v FROM (SELECT DISTINCT fold FROM m1) CROSS JOIN (SELECT DISTINCT term FROM m1) LEFT JOIN m1 USING (fold, term)),
  m3 AS (SELECT fold, term, coalesce(v / nullif(sum(v) OVER (PARTITION BY fold), 0), 0) AS share, dense_rank() OVER (ORDER BY fold) - 1 AS i FROM m2), m4 AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY share DESC) AS rk FROM m3), m5 AS (SELECT *, lag(rk) OVER (PARTITION BY term ORDER BY i) AS bef FROM m4)"""


@query("importance_stability", "term", "mean std cv rank_mean rank_std in_top slope rank_corr", f"""{SHARES}, final AS (SELECT term, avg(share) AS mean, stddev_samp(share) AS std, stddev_samp(share) / nullif(avg(share), 0) AS cv, avg(rk) AS rank_mean, stddev_samp(rk) AS rank_std, avg(CASE WHEN rk <= 3 THEN 1.0 ELSE 0 END) AS in_top,
  covar_pop(share, i) / nullif(var_pop(i), 0) AS slope, CASE WHEN count(*) >= 3 THEN covar_pop(CASE WHEN bef IS NOT NULL THEN rk END, bef) / nullif(stddev_pop(CASE WHEN bef IS NOT NULL THEN rk END) * stddev_pop(bef), 0) END AS rank_corr FROM m5 GROUP BY term)""", base=IMP)  # fmt: skip
def _(spark, d):
    return reports.stability(_one_model(spark, d), 3)


@query("fold_spearman", "fold", "corr", f"""a AS (SELECT fold, term, avg(importance) AS v FROM imp GROUP BY ALL), b AS (SELECT *, v / sum(v) OVER (PARTITION BY fold) AS share, dense_rank() OVER (ORDER BY fold) AS i FROM a),
  c AS (SELECT x.fold, x.share, y.share AS bef FROM b x JOIN b y ON x.term = y.term AND x.i = y.i + 1), e AS (SELECT fold, {rank_sql('share', 'fold')} AS ra, {rank_sql('bef', 'fold')} AS rb FROM c), final AS (SELECT fold, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS corr FROM e GROUP BY fold)""", base=IMP)  # fmt: skip
def _(spark, d):
    return reports.fold_spearman(_one_model(spark, d))


@query("quadrants", "term quadrant", "importance std", """a AS (SELECT term, avg(importance) AS importance, stddev_samp(importance) AS std FROM imp GROUP BY term), final AS (SELECT term, importance, std, CASE WHEN importance >= (SELECT median(importance) FROM a) THEN 'high_' ELSE 'low_' END || CASE WHEN std >= (SELECT median(std) FROM a) THEN 'high' ELSE 'low' END AS quadrant FROM a WHERE std IS NOT NULL)""", base=IMP)
def _(spark, d):
    return reports.quadrants(reports.importance_mean(_importance(spark, d)).where("std IS NOT NULL"), "importance", "std")


@query("top_per_model", "model term rank", "importance", "a AS (SELECT model, term, avg(importance) AS importance FROM imp GROUP BY ALL), final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, term) AS rank FROM a) WHERE rank <= 5)", base=IMP)
def _(spark, d):
    return reports.top_per_model(_importance(spark, d), 5)


@query("scalar_ema", "fold name", "ema", """a AS (SELECT fold, term AS name, avg(importance) AS v FROM imp GROUP BY ALL), b AS (SELECT f.fold, n.name, v, dense_rank() OVER (ORDER BY f.fold) AS i FROM (SELECT DISTINCT fold FROM a) f CROSS JOIN (SELECT DISTINCT name FROM a) n LEFT JOIN a ON a.fold = f.fold AND a.name = n.name),
  c AS (SELECT *, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY name) AS i0 FROM b), final AS (SELECT x.fold, x.name, sum(coalesce(y.v, 0) * CASE WHEN y.i = x.i0 THEN power(2 / 3.0, x.i - y.i) ELSE power(2 / 3.0, x.i - y.i) / 3.0 END) AS ema FROM c x JOIN c y ON x.name = y.name AND y.i BETWEEN x.i0 AND x.i GROUP BY x.fold, x.name)""", base=IMP)  # fmt: skip
def _(spark, d):
    x = _importance(spark, d).groupBy("fold", F.col("term").alias("name")).agg(F.avg("importance").alias("value"))
    return ml.scalar_ema(x)


# ---- training -------------------------------------------------------------------------------


@query("build_target", "ts symbol", "y_raw y", f"a AS (SELECT *, lead(close, 1) {_LW} / nullif(close, 0) - 1 AS y_raw FROM p), final AS (SELECT ts, symbol, y_raw, {pct_sql('y_raw')} - 0.5 AS y FROM a)")
def _(spark, d):
    return ml.build_target(B.panel(spark, d))


def _calendar(x: DataFrame) -> list[dict]:
    dates = [r[0] for r in x.select("ts").distinct().orderBy("ts").collect()]  # one row per date
    return ml.folds(dates, dates[len(dates) // 2], every=40) if dates else []


@query("walk_forward", "fold ts symbol", "score")
def _(spark, d):
    x = ml.build_target(B.panel(spark, d)).withColumn("vol", ts.std("ret", 10))
    return ml.walk_forward(x, ["ret", "basis", "vol"], _calendar(x))[0]


@query("bootstrap_counts", "bag ts", "n")
def _(spark, d):
    return ml.bootstrap_counts(B.weekly_bars(spark, d), 20, 4)


@query("validation_tail", "ts", "mask", "final AS (SELECT ts, CASE WHEN i > n - floor(n * 0.1) THEN -1 ELSE 1 END AS mask FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM bars)))", base=BARS)
def _(spark, d):
    return ml.validation_tail(B.weekly_bars(spark, d))


@query("in_sample_fit", "fold", "ic r2")
def _(spark, d):
    x = ml.build_target(B.panel(spark, d))
    scores, _imp = ml.walk_forward(x.withColumn("vol", ts.std("ret", 10)), ["ret", "basis", "vol"], _calendar(x))
    return ml.in_sample(scores.join(x.select("ts", "symbol", "y"), ["ts", "symbol"]))


# ---- streaming (the same plans run on tables) --------------------------------------------------


@query("stream_ohlcv", "ts symbol", "open high low close volume", "final AS (SELECT * FROM u)", base=HOURLY)
def _(spark, d):
    from .streaming import market

    ev = B.read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), "value")
    return market.ohlcv(ev)


@query("user_sessions", "user_id start", "n", """s1 AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN CAST(ts AS TIMESTAMP) - lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
  s2 AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s1), final AS (SELECT user_id, min(ts) AS start, count(*) AS n FROM s2 GROUP BY user_id, k)""", times="start", base="one AS (SELECT 1)")  # fmt: skip
def _(spark, d):
    from .streaming import market

    return market.sessions(B.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Q["factor_panel"][0](spark, sf_dir)


def _more() -> None:
    """Register the queries of registry_more, which builds on this module."""
    from . import registry_more  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _more()
    return {k: v[0] for k, v in _Q.items()}


def oracle_sql() -> dict[str, str]:
    _more()
    return {k: v[1] for k, v in _Q.items() if v[1] is not None}


__all__ = ["W", "flagship", "oracle_sql", "queries"]
