"""Cross-sectional expressions: over the symbols of one date (and one group)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ts import col


def section(*by: str):
    return W.partitionBy(*(by or ("ts",)))


def zscore(x, *by: str) -> Column:
    w = section(*by)
    return F.try_divide(col(x) - F.avg(col(x)).over(w), F.nullif(F.stddev_samp(col(x)).over(w), F.lit(0.0)))


def zscore_or_same(x, *by: str, least=1e-8) -> Column:
    """z-score, but rows of a date without spread stay as they are."""
    w = section(*by)
    s = F.stddev_samp(col(x)).over(w)
    return F.when(s >= least, (col(x) - F.avg(col(x)).over(w)) / s).otherwise(col(x))


def demean(x, *by: str) -> Column:
    return col(x) - F.avg(col(x)).over(section(*by))


def rank_average(x, *by: str) -> Column:
    """Average rank of ties from 1; NULL has none."""
    by = by or ("ts",)
    c = col(x)
    ties = F.count(F.lit(1)).over(W.partitionBy(*by, c))
    return F.when(c.isNotNull(), F.rank().over(W.partitionBy(*by).orderBy(c.asc_nulls_last())) + (ties - 1) / 2)


def rank_pct(x, *by: str) -> Column:
    return rank_average(x, *by) / F.count(col(x)).over(section(*by))


def rank_centred(x, *by: str) -> Column:
    return rank_pct(x, *by) - 0.5


def rank_first(x, *by: str, tie: str = "symbol", descending=False) -> Column:
    """Rank from 1; ties by symbol; NULL has none."""
    by = by or ("ts",)
    c = col(x)
    order = c.desc_nulls_last() if descending else c.asc_nulls_last()
    return F.when(c.isNotNull(), F.row_number().over(W.partitionBy(*by).orderBy(order, tie)))


def correlation(a, b) -> Column:
    """Aggregate: Pearson correlation over rows with both; NULL if a side has no spread."""
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = F.when(both, col(a)), F.when(both, col(b))
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def residual(y, x, *by: str, active="nonzero", min_points=2, fill_zero=True) -> Column:
    """y less its OLS fit on x over the active rows of the date: both there, and
    y not 0 unless active is "all". Rows that take no part, and dates of fewer
    points or without variance in x, keep y; fill_zero makes NULL 0."""
    w = section(*by)
    ok = col(y).isNotNull() & col(x).isNotNull()
    if active == "nonzero":
        ok = ok & (col(y) != 0)
    a, b = F.when(ok, col(y)), F.when(ok, col(x))
    fits = (F.count(a).over(w) >= min_points) & (F.var_pop(b).over(w) >= 1e-8)
    fit = F.regr_slope(a, b).over(w) * b + F.regr_intercept(a, b).over(w)
    out = F.when(fits & ok, col(y) - fit).otherwise(col(y))
    return F.coalesce(out, F.lit(0.0)) if fill_zero else out


def bucket(x, q: int, *by: str) -> Column:
    """Quantile bucket 1..q by average percentile rank, upper edges closed."""
    return F.greatest(F.ceil(rank_pct(x, *by) * q), F.lit(1)).cast("int")


def label_first(x, bins: int, *by: str) -> Column:
    """ceil(first-rank share x bins)."""
    return F.ceil(rank_first(x, *by) / F.count(col(x)).over(section(*by)) * bins).cast("int")


def edges(x, q: int) -> Column:
    """Aggregate: distinct linear quantile edges of q bins."""
    return F.array_sort(F.array_distinct(F.percentile(col(x), F.array(*[F.lit(i / q) for i in range(q + 1)]))))


def cut(x, e) -> Column:
    """Bin of x in edges, upper edges closed; NULL is -1."""
    inner = F.slice(col(e), F.lit(2), F.greatest(F.size(col(e)) - 2, F.lit(0)))
    return F.when(col(x).isNull(), -1).otherwise(F.size(F.filter(inner, lambda v: col(x) > v)))


def digitize(x, e) -> Column:
    """Number of edges at or below x, lower edges closed; NULL stays NULL."""
    return F.when(col(x).isNotNull(), F.size(F.filter(col(e), lambda v: col(x) >= v)))
