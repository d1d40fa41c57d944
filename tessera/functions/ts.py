"""Per-symbol time-series expressions over a dense (ts, symbol) grid.

Each function returns a Column. Frames are rows of the calendar, so the grid
must be dense (operators.calendar.densify). NULL is the only missing value; a
windowed result needs `min_periods` values (the window length by default).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY, TS = "symbol", "ts"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def series(key: str | None = KEY):
    """The ordered window of a symbol; key None: of a market table of one row per ts."""
    return (W.partitionBy(key) if key else W.partitionBy(F.lit(1))).orderBy(TS)


def trailing(n: int | None, key: str | None = KEY):
    return series(key).rowsBetween(W.unboundedPreceding if n is None else 1 - n, 0)


def gate(x: str | Column, n: int | None, min_periods: int | None, agg: Callable[[Column], Column], key: str | None = KEY) -> Column:
    """agg over the trailing n rows where at least min_periods values are there."""
    w = trailing(n, key)
    return F.when(F.count(col(x)).over(w) >= (n if min_periods is None else min_periods), agg(col(x)).over(w))


def mean(x, n, min_periods=None, key=KEY) -> Column:
    return gate(x, n, min_periods, F.avg, key)


def std(x, n, min_periods=None, key=KEY) -> Column:
    return gate(x, n, min_periods, F.stddev_samp, key)


def var(x, n, min_periods=None, key=KEY) -> Column:
    return gate(x, n, min_periods, F.var_samp, key)


def total(x, n, min_periods=None, key=KEY) -> Column:
    return gate(x, n, min_periods, F.sum, key)


def median(x, n, min_periods=None, key=KEY) -> Column:
    return gate(x, n, min_periods, lambda c: F.percentile(c, F.lit(0.5)), key)


def cov(x, y, n, min_periods=None, key=KEY) -> Column:
    """Sample covariance over rows where both are there."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    w = trailing(n, key)
    return F.when(F.count(a).over(w) >= (n if min_periods is None else min_periods), F.covar_samp(a, b).over(w))


def skew(x, n, min_periods=None, key=KEY) -> Column:
    """Bias-corrected skewness (G1)."""
    w = trailing(n, key)
    c = F.count(col(x)).over(w).cast("double")
    g1 = F.skewness(col(x)).over(w)
    m = max(3, n if min_periods is None else min_periods)
    return F.when(c >= m, g1 * F.sqrt(c * (c - 1)) / (c - 2))


def kurt(x, n, min_periods=None, key=KEY) -> Column:
    """Bias-corrected excess kurtosis (G2)."""
    w = trailing(n, key)
    c = F.count(col(x)).over(w).cast("double")
    m = max(4, n if min_periods is None else min_periods)
    return F.when(c >= m, (c - 1) / ((c - 2) * (c - 3)) * ((c + 1) * F.kurtosis(col(x)).over(w) + 6))


def lag(x, k=1, key=KEY) -> Column:
    return F.lag(col(x), k).over(series(key))


def lead(x, k=1, key=KEY) -> Column:
    return F.lead(col(x), k).over(series(key))


def diff(x, k=1, key=KEY) -> Column:
    return col(x) - lag(x, k, key)


def ffill(x, limit: int | None = None, key=KEY) -> Column:
    w = series(key).rowsBetween(W.unboundedPreceding if limit is None else -limit, 0)
    return F.last(col(x), ignorenulls=True).over(w)


def bfill(x, key=KEY) -> Column:
    return F.first(col(x), ignorenulls=True).over(series(key).rowsBetween(0, W.unboundedFollowing))


def pct_change(x, k=1, pad_gaps=False, key=KEY) -> Column:
    """x / x(k rows before) - 1; division by zero is NULL. pad_gaps carries the
    last value over gaps of any length first."""
    a = ffill(x, None, key) if pad_gaps else col(x)
    return F.try_divide(a, F.lag(a, k).over(series(key))) - 1


def zscore(x, n, min_periods=None, key=KEY) -> Column:
    m = n // 2 if min_periods is None else min_periods
    return F.try_divide(col(x) - mean(x, n, m, key), F.nullif(std(x, n, m, key), F.lit(0.0)))


def zscore_capped(x, n, min_periods=None, lo=-2.0, hi=2.0, key=KEY) -> Column:
    """z-score whose standard deviation is clipped to [lo, hi]."""
    m = n // 2 if min_periods is None else min_periods
    s = std(x, n, m, key)
    return F.try_divide(col(x) - mean(x, n, m, key), F.nullif(clip(s, lo, hi), F.lit(0.0)))


def delta(x, n=5, k=10, key=KEY) -> Column:
    """Change of the n-row mean over k rows."""
    m = mean(x, n, 1, key)
    return m - F.lag(m, k).over(series(key))


def clip(x, lo, hi) -> Column:
    """Clipped to [lo, hi]; NULL stays NULL."""
    c = col(x)
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def quantile_before(x, q: float, n: int | None = None, min_periods=1, key=KEY) -> Column:
    """Linear quantile of the rows before this one (of n rows, or all)."""
    w = series(key).rowsBetween(W.unboundedPreceding if n is None else -n, -1)
    return F.when(F.count(col(x)).over(w) >= min_periods, F.percentile(col(x), F.lit(q)).over(w))


def residual_on_market(x, market, n: int, min_periods: int | None = None, key=KEY) -> Column:
    """x less its rolling OLS fit on a market series. The covariance is the
    population's and the variance the sample's, as this operator defines it."""
    m = max(n // 4, 10) if min_periods is None else min_periods
    both = col(x).isNotNull() & col(market).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(market))
    ma, mb = mean(a, n, m, key), mean(b, n, m, key)
    slope = F.try_divide(mean(a * b, n, m, key) - ma * mb, F.nullif(var(b, n, m, key), F.lit(0.0)))
    return col(x) - (ma + slope * (col(market) - mb))


def cumulative_product(x, key=KEY) -> Column:
    """Product of 1 + x up to this row; NULL counts as 0."""
    return F.product(1 + F.coalesce(col(x), F.lit(0.0))).over(trailing(None, key))


def cumulative_sum(x, key=KEY) -> Column:
    return F.sum(col(x)).over(trailing(None, key))


def streak(flag: str | Column, key=KEY) -> Column:
    """Number of the row in its run of equal values (from 1)."""
    c = col(flag)
    return F.row_number().over((W.partitionBy(key, run_id(c, key)) if key else W.partitionBy(run_id(c, key))).orderBy(TS))


def run_id(flag: str | Column, key=KEY) -> Column:
    """How often the value changed up to this row."""
    c = col(flag)
    changed = F.when(c.eqNullSafe(F.lag(c).over(series(key))), 0).otherwise(1)
    return F.sum(changed).over(trailing(None, key))
