"""Attribution, distribution, importance and universe reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cs, ts
from ..functions.ordered import running_sums
from .gram import gram

#: Label orders of the reports.
SKEW_LABELS = ("Positive Skew", "Neutral Skew", "Negative Skew", "Unknown")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _complete(df: DataFrame, key: str, labels: tuple[str, ...]) -> DataFrame:
    """One row for each label, in the given set; numbers of absent ones are 0."""
    every = df.sparkSession.createDataFrame([(x,) for x in labels], f"{key} string")
    return every.join(df, key, "left").fillna(0)


def by_regime(trades: DataFrame, regime: str, labels: tuple[str, ...] | None = None) -> DataFrame:
    """(regime, pnl, trades, win_rate)."""
    out = trades.groupBy(regime).agg(F.sum("pnl").alias("pnl"), F.count("*").alias("trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))
    return _complete(out, regime, labels) if labels else out


def by_weekday(daily: DataFrame, periods: int = 365) -> DataFrame:
    """daily(ts, pnl) -> seven rows: sum, mean, std, count, win rate, Sharpe."""
    g = daily.groupBy(F.date_format("ts", "EEEE").alias("weekday")).agg(
        F.sum("pnl").alias("pnl"), F.avg("pnl").alias("mean"), F.stddev_samp("pnl").alias("std"), F.count("*").alias("days"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate")
    )
    g = g.withColumn("sharpe", F.try_divide(F.col("mean"), F.nullif(F.col("std"), F.lit(0.0))) * F.sqrt(F.lit(float(periods))))
    return _complete(g, "weekday", WEEKDAYS)


def regime_attribution(daily: DataFrame, regime: str, ahead: int = 0) -> DataFrame:
    """PnL of the day (or of the day `ahead` rows later) by regime of the day."""
    w = W.partitionBy(F.lit(1)).orderBy("ts")
    x = daily.withColumn("_p", F.lead("pnl", ahead).over(w) if ahead else F.col("pnl")).where("_p IS NOT NULL")
    return x.groupBy(regime).agg(F.sum("_p").alias("pnl"), F.avg("_p").alias("mean"), F.count("*").alias("days"))


def cumulative_by_regime(daily: DataFrame, regime: str, labels: tuple[str, ...]) -> DataFrame:
    w = W.partitionBy(F.lit(1)).orderBy("ts")
    return daily.select("ts", *[F.sum(F.when(F.col(regime) == r, F.col("pnl")).otherwise(0.0)).over(w).alias(f"pnl_{r}") for r in labels])


def mean_score_by_regime(scores: DataFrame, regime: str, labels: list[str]) -> DataFrame:
    return scores.groupBy("ts").pivot(regime, labels).agg(F.avg("score"))


def weight_daily(weights: DataFrame) -> DataFrame:
    """Per date: gross, net, names held, longs, shorts, effective number,
    normalised concentration, turnover."""
    x = weights.withColumn("_d", F.abs(ts.diff("weight")))
    gross = F.sum(F.abs("weight"))
    return x.groupBy("ts").agg(
        gross.alias("gross"),
        F.sum("weight").alias("net"),
        F.count_if(F.col("weight") != 0).alias("n"),
        F.count_if(F.col("weight") > 0).alias("n_long"),
        F.count_if(F.col("weight") < 0).alias("n_short"),
        F.try_divide(F.lit(1.0), F.nullif(F.sum(F.col("weight") * F.col("weight")), F.lit(0.0))).alias("effective_n"),
        F.try_divide(F.sum(F.col("weight") * F.col("weight")), F.nullif(gross * gross, F.lit(0.0))).alias("hhi"),
        F.coalesce(F.sum("_d"), F.lit(0.0)).alias("turnover"),
    )


def weight_assets(weights: DataFrame) -> DataFrame:
    """Per symbol: days held, mean long, mean short, mean and largest |weight|."""
    w = F.col("weight")
    return weights.groupBy("symbol").agg(
        F.count_if(w != 0).alias("days"), F.avg(F.when(w > 0, w)).alias("mean_long"), F.avg(F.when(w < 0, w)).alias("mean_short"), F.avg(F.abs(w)).alias("mean_abs"), F.max(F.abs(w)).alias("max_abs")
    )


def weight_summary(weights: DataFrame) -> DataFrame:
    """One row over non-zero weights; the deviation is the population's."""
    w = weights.where("weight <> 0")
    q = lambda p: F.percentile("weight", F.lit(p))
    return w.agg(F.min("weight").alias("min"), F.max("weight").alias("max"), F.avg("weight").alias("mean"), F.stddev_pop("weight").alias("std"), q(0.05).alias("p5"), q(0.95).alias("p95"), F.count("*").alias("n"))


def gross_ratio(weights: DataFrame, n: int = 10, hi: float = 5.0) -> DataFrame:
    """Long / short gross, its rolling median, clipped."""
    day = weights.groupBy("ts").agg(F.sum(F.greatest(F.col("weight"), F.lit(0.0))).alias("l"), F.sum(F.greatest(-F.col("weight"), F.lit(0.0))).alias("s"))
    x = day.withColumn("_r", F.try_divide(F.col("l"), F.nullif(F.col("s"), F.lit(0.0))))
    return x.select("ts", ts.clip(ts.median("_r", n, 1, None), 0.0, hi).alias("ratio"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per symbol, cells of two strategies: both, only one, same or opposite sign."""
    x = a.select("ts", "symbol", F.col("weight").alias("wa")).join(b.select("ts", "symbol", F.col("weight").alias("wb")), ["ts", "symbol"], "full_outer").fillna(0.0, ["wa", "wb"])
    both = (F.col("wa") != 0) & (F.col("wb") != 0)
    return x.groupBy("symbol").agg(
        F.count_if(both).alias("both"),
        F.count_if((F.col("wa") != 0) & (F.col("wb") == 0)).alias("only_a"),
        F.count_if((F.col("wa") == 0) & (F.col("wb") != 0)).alias("only_b"),
        F.count_if(both & (F.col("wa") * F.col("wb") > 0)).alias("same_sign"),
        F.count_if(both & (F.col("wa") * F.col("wb") < 0)).alias("opposite_sign"),
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) of equal-width bins between the extremes, the last one closed."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    x = df.where(F.col(column).isNotNull()).join(F.broadcast(ends))  # one row
    at = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.width_bucket(column, F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins)))
    return x.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def cdf(df: DataFrame, column: str) -> DataFrame:
    """(value, share at or below): counts first, then running sums over pieces of
    the sorted values; the largest one is the total."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    x = running_sums(n, ["value"], {"n": "upto"}, "cdf")
    return x.join(F.broadcast(x.agg(F.max("upto").alias("total")))).select("value", (F.col("upto") / F.col("total")).alias("share"))


def score_heat(scores: DataFrame, top: int = 20, limit: int = 500) -> DataFrame:
    """(ts, symbol, z): the symbols with most scores, z clipped, dates thinned."""
    best = scores.groupBy("symbol").agg(F.count("score").alias("n")).orderBy(F.desc("n"), "symbol").limit(top)
    dates = scores.select("ts").distinct().withColumn("_i", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("ts")))
    n = dates.count()
    step = max(1, -(-n // limit))
    x = scores.withColumn("z", ts.clip(cs.zscore("score"), -2.5, 2.5))
    return x.join(F.broadcast(best.select("symbol")), "symbol", "left_semi").join(F.broadcast(dates.where(F.col("_i") % step == 1 % step)), "ts").select("ts", "symbol", "z")


def universe_health(scores: DataFrame) -> DataFrame:
    x = scores.groupBy("ts").agg(F.count_if(F.coalesce("score", F.lit(0.0)) != 0).alias("active"), F.count("*").alias("total"))
    return x.withColumn("ratio", F.col("active") / F.col("total"))


def coverage(weights: DataFrame) -> DataFrame:
    """Per date: names held, names ever held so far, largest weight."""
    first = weights.where("weight <> 0").groupBy("symbol").agg(F.min("ts").alias("ts")).groupBy("ts").agg(F.count("*").alias("_new"))
    day = weights.groupBy("ts").agg(F.count_if(F.col("weight") != 0).alias("active"), F.max(F.abs("weight")).alias("max_weight")).join(first, "ts", "left")
    return day.select("ts", "active", F.sum(F.coalesce("_new", F.lit(0))).over(W.partitionBy(F.lit(1)).orderBy("ts")).alias("ever"), "max_weight")


def information_coefficient(df: DataFrame, score: str, target: str, least: int = 5) -> DataFrame:
    """(ts, ic): Spearman correlation per date over rows that have both."""
    x = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    x = x.withColumns({"_a": cs.rank_average(score), "_b": cs.rank_average(target)})
    return x.groupBy("ts").agg(F.count("*").alias("_n"), cs.correlation("_a", "_b").alias("ic")).where(F.col("_n") >= least).select("ts", "ic")


def ic_summary(ic: DataFrame, *by: str) -> DataFrame:
    """Mean, deviation, their ratio, the share of positive ones and the days. A
    correlation within 1e-12 of 0, whose sign is a matter of rounding, is not positive."""
    s = F.stddev_samp("ic")
    return ic.groupBy(*by).agg(F.avg("ic").alias("mean"), s.alias("std"), F.try_divide(F.avg("ic"), F.nullif(s, F.lit(0.0))).alias("ir"), F.avg(F.coalesce(F.col("ic") > 1e-12, F.lit(False)).cast("double")).alias("positive"), F.count("*").alias("days"))


def expanding_ir(ic: DataFrame) -> DataFrame:
    w = W.partitionBy(F.lit(1)).orderBy("ts")
    return ic.select("ts", F.avg("ic").over(w).alias("mean"), F.try_divide(F.avg("ic").over(w), F.nullif(F.stddev_samp("ic").over(w), F.lit(0.0))).alias("ir"), F.avg("ic").over(w.rowsBetween(-20, 0)).alias("mean_21"))


def mutual_information(labels: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by, mi, n): plug-in mutual information in nats; codes below 0 are left out."""
    k = labels.where((F.col(x) >= 0) & (F.col(y) >= 0)).groupBy(*by, x, y).agg(F.count("*").cast("double").alias("n"))
    tot = lambda *c: F.sum("n").over(W.partitionBy(*by, *c) if (by or c) else W.partitionBy(F.lit(1)))
    k = k.withColumns({"_t": tot(), "_x": tot(x), "_y": tot(y)})
    return k.groupBy(*by).agg(F.sum(F.col("n") / F.col("_t") * F.ln(F.col("n") * F.col("_t") / (F.col("_x") * F.col("_y")))).alias("mi"), F.sum("n").alias("n"))


def conditional_mutual_information(labels: DataFrame, x: str, y: str, regime: str, least: int = 4) -> DataFrame:
    """One row: sum over regimes of their share times MI; small regimes add 0 but count."""
    mi = mutual_information(labels.where(F.col(regime) >= 0), x, y, regime)
    return mi.agg((F.sum(F.when(F.col("n") >= least, F.col("n") * F.col("mi")).otherwise(0.0)) / F.sum("n")).alias("cmi"))


def streaks(labels: DataFrame, column: str) -> DataFrame:
    """(run, label, start, end, length) of a market table's runs."""
    x = labels.withColumn("run", ts.run_id(column, None))
    return x.groupBy("run").agg(F.min_by(column, "ts").alias("label"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("length"))


def usage(labels: DataFrame, winner: str, regime: str) -> DataFrame:
    """(winner, regime, days, share, share_of_winner)."""
    k = labels.groupBy(winner, regime).agg(F.count("*").alias("days"))
    return k.select(winner, regime, "days", (F.col("days") / F.sum("days").over(W.partitionBy(F.lit(1)))).alias("share"), (F.col("days") / F.sum("days").over(W.partitionBy(winner))).alias("share_of_winner"))


def winners_by_quarter(labels: DataFrame, winner: str, names: list[str]) -> DataFrame:
    q = F.concat(F.year("ts"), F.lit("Q"), F.quarter("ts")).alias("quarter")
    return labels.groupBy(q).pivot(winner, names).count().fillna(0)


# Importance tables are long: (model, fold, term, importance); `a & b` is an interaction.


def importance_mean(imp: DataFrame) -> DataFrame:
    return imp.groupBy("term").agg(F.avg("importance").alias("importance"), F.stddev_samp("importance").alias("std"), F.count("*").alias("folds"))


def split_importance(imp: DataFrame) -> DataFrame:
    """Per feature over folds: mean and deviation of main and interaction parts, absent as 0."""
    parts = F.split("term", " & ")
    x = imp.select("fold", F.explode(parts).alias("feature"), (F.size(parts) > 1).alias("inter"), "importance")
    x = x.groupBy("fold", "feature").agg(F.sum(F.when(~F.col("inter"), F.col("importance")).otherwise(0.0)).alias("m"), F.sum(F.when(F.col("inter"), F.col("importance")).otherwise(0.0)).alias("i"))
    grid = imp.select("fold").distinct().crossJoin(x.select("feature").distinct())
    x = grid.join(x, ["fold", "feature"], "left").fillna(0.0)
    return x.groupBy("feature").agg(F.avg("m").alias("main"), F.stddev_samp("m").alias("main_std"), F.avg("i").alias("interaction"), F.stddev_samp("i").alias("interaction_std"))


def quadrants(df: DataFrame, x: str, y: str) -> DataFrame:
    """df with the quadrant against the medians of both columns."""
    med = df.agg(F.percentile(x, F.lit(0.5)).alias("_mx"), F.percentile(y, F.lit(0.5)).alias("_my"))
    name: Column = F.concat(F.when(F.col(x) >= F.col("_mx"), "high_").otherwise("low_"), F.when(F.col(y) >= F.col("_my"), "high").otherwise("low"))
    return df.join(F.broadcast(med)).withColumn("quadrant", name).drop("_mx", "_my")


def compare_models(imp: DataFrame) -> DataFrame:
    """Per feature: best model, spread of importance, largest shift of rank."""
    x = imp.groupBy("model", "term").agg(F.avg("importance").alias("v"))
    x = x.withColumn("r", F.rank().over(W.partitionBy("model").orderBy(F.desc("v"))))
    return x.groupBy("term").agg(F.max_by("model", F.struct("v", "model")).alias("dominant"), F.stddev_samp("v").alias("dispersion"), (F.max("r") - F.min("r")).alias("rank_shift"))


def main_effect_shares(imp: DataFrame, skip: int = 0) -> DataFrame:
    """(fold, i, term, share) of the main effects on the full grid of folds and
    terms: absent ones are 0, and a fold without importance has shares of 0. The
    first `skip` folds are left out; i counts the others from 0."""
    main = imp.where(~F.contains("term", F.lit(" & ")))
    fold = main.select("fold").distinct().withColumn("i", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("fold")) - 1 - skip).where("i >= 0")
    x = fold.crossJoin(main.select("term").distinct()).join(main.select("fold", "term", "importance"), ["fold", "term"], "left").fillna(0.0, ["importance"])
    share = F.try_divide(F.col("importance"), F.nullif(F.sum("importance").over(W.partitionBy("fold")), F.lit(0.0)))
    return x.select("fold", "i", "term", F.coalesce(share, F.lit(0.0)).alias("share"))


def stability(imp: DataFrame, top: int = 10, skip: int = 0) -> DataFrame:
    """Per main effect over folds: mean and deviation of its share, cv, mean and
    deviation of its rank (ties take the smaller), share of folds in the top, OLS
    slope over the folds, correlation of its rank with that of the fold before
    (from three folds on)."""
    x = main_effect_shares(imp, skip)
    x = x.withColumn("rank", F.rank().over(W.partitionBy("fold").orderBy(F.desc("share"))))
    x = x.withColumn("before", F.lag("rank").over(W.partitionBy("term").orderBy("i")))
    m, s = F.avg("share"), F.stddev_samp("share")
    slope = F.try_divide(F.covar_pop("share", "i"), F.nullif(F.var_pop("i"), F.lit(0.0)))
    return x.groupBy("term").agg(
        m.alias("mean"), s.alias("std"), F.try_divide(s, F.nullif(m, F.lit(0.0))).alias("cv"), F.avg("rank").alias("rank_mean"), F.stddev_samp("rank").alias("rank_std"),
        F.avg((F.col("rank") <= top).cast("double")).alias("in_top"), F.when(F.stddev_pop("share") == 0, 0.0).otherwise(slope).alias("slope"),
        F.when(F.count("*") >= 3, cs.correlation("rank", "before")).alias("rank_corr"),
    )


def fold_spearman(imp: DataFrame, min_share: float = 0.0) -> DataFrame:
    """(fold, corr): rank correlation with the fold before over terms of both."""
    x = imp.withColumn("share", F.try_divide(F.col("importance"), F.sum("importance").over(W.partitionBy("fold")))).where(F.col("share") >= min_share)
    order = imp.select("fold").distinct().withColumn("i", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("fold")))
    x = x.join(F.broadcast(order), "fold")
    pairs = x.select("fold", "i", "term", "share").join(x.select((F.col("i") + 1).alias("i"), "term", F.col("share").alias("before")), ["i", "term"])
    pairs = pairs.withColumns({"a": cs.rank_average("share", "fold"), "b": cs.rank_average("before", "fold")})
    return pairs.groupBy("fold").agg(cs.correlation("a", "b").alias("corr"))


def health_over_folds(health: DataFrame, importance: DataFrame | None = None) -> DataFrame:
    """Per feature over folds of shape_health: means, deviations and maxima, the
    number of folds, and with importance(fold, term, importance) its mean over
    the folds and its rank (1 is the largest, ties take the smaller)."""
    x = health.groupBy("feature").agg(
        F.avg("monotonicity").alias("monotonicity_mean"), F.stddev_samp("monotonicity").alias("monotonicity_std"), F.avg("tail_core_ratio").alias("tail_core_ratio_mean"), F.max("tail_core_ratio").alias("tail_core_ratio_max"),
        F.avg("curvature").alias("curvature_mean"), F.avg("cross_bag_variance").alias("cross_bag_variance_mean"), F.percentile("n_bins", F.lit(0.5)).alias("n_bins_median"), F.count_distinct("fold").alias("n_folds"),
    )
    if importance is None:
        return x
    x = x.join(importance.groupBy(F.col("term").alias("feature")).agg(F.avg("importance").alias("importance_mean")), "feature", "left")
    rank = F.rank().over(W.partitionBy(F.lit(1)).orderBy(F.col("importance_mean").desc_nulls_last()))
    return x.withColumn("importance_rank", F.when(F.col("importance_mean").isNotNull(), rank))


def health_routing(health: DataFrame, top: int = 20, max_ratio: float = 3.0, share: float = 0.8, min_variance: float = 1e-4, monotonic: float = 0.30) -> DataFrame:
    """health_over_folds with cross_bag_var_thresh and a route, the first that
    holds: DROP_tail_and_unstable, DROP_tail or DROP_unstable for a large effect in
    sparse bins or a variance between bags above the threshold; EXPERT for one of
    the `top` by importance that is not monotonic; else GLOBAL."""
    cut = health.agg(F.greatest(F.percentile("cross_bag_variance_mean", F.lit(share)), F.lit(min_variance)).alias("cross_bag_var_thresh"))
    tail = F.coalesce(F.col("tail_core_ratio_max") > max_ratio, F.lit(False))
    loose = F.coalesce(F.col("cross_bag_variance_mean") > F.col("cross_bag_var_thresh"), F.lit(False))
    route = F.when(tail & loose, "DROP_tail_and_unstable").when(tail, "DROP_tail").when(loose, "DROP_unstable")
    if "importance_rank" in health.columns:
        route = route.when((F.col("importance_rank") <= top) & (F.abs("monotonicity_mean") < monotonic), "EXPERT")
    return health.join(F.broadcast(cut)).withColumn("route", route.otherwise("GLOBAL"))


def consensus(routes: DataFrame) -> DataFrame:
    """Per feature over models: dropped by all, by any, number of experts."""
    drop = F.startswith("route", F.lit("DROP"))
    return routes.groupBy("feature").agg(F.bool_and(drop).alias("strict_drop"), F.bool_or(drop).alias("soft_drop"), F.count_if(F.col("route") == "EXPERT").alias("experts"))


def drop_lists(routes: DataFrame) -> DataFrame:
    """consensus of routes(model, feature, route, importance_rank) with the mean
    rank: features dropped by any model, in the order of that rank."""
    rank = routes.groupBy("feature").agg(F.avg("importance_rank").alias("mean_rank"))
    return consensus(routes).join(rank, "feature").where("soft_drop").orderBy(F.col("mean_rank").asc_nulls_last(), "feature")


def partner_models(imp: DataFrame, feature: str, models: list[str], top: int = 10) -> DataFrame:
    """Interaction partners of a feature with a column of mean importance for
    each model (0 if absent), ordered by the largest, then the mean."""
    p = F.split("term", " & ")
    x = imp.where(F.size(p) == 2).where(F.array_contains(p, feature)).select(F.element_at(F.array_remove(p, feature), 1).alias("partner"), "model", "importance")
    x = x.groupBy("partner").pivot("model", models).agg(F.avg("importance")).fillna(0.0)
    cols = [F.col(f"`{m}`") for m in models]
    x = x.withColumns({"max": F.greatest(*cols) if len(cols) > 1 else cols[0], "mean": sum(cols, F.lit(0.0)) / len(cols)})
    return x.orderBy(F.desc("max"), F.desc("mean"), "partner").limit(top)


def rank_shifts(imp: DataFrame, n: int = 10) -> DataFrame:
    """compare_models with lists: the n largest and smallest shifts of rank and
    the n largest dispersions."""
    x = compare_models(imp)
    pick = lambda name, *order: x.withColumn("place", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order, "term"))).where(F.col("place") <= n).withColumn("list", F.lit(name))
    return pick("largest_shift", F.desc("rank_shift")).unionByName(pick("smallest_shift", F.asc("rank_shift"))).unionByName(pick("dispersion", F.desc_nulls_last("dispersion")))


def pooled_moments(scores: DataFrame, column: str = "score") -> DataFrame:
    """One row: n, mean, std, and the population skewness and excess kurtosis."""
    return scores.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.skewness(column).alias("skew"), F.kurtosis(column).alias("kurtosis"))


def covariance(returns: DataFrame, column: str = "ret", shrink: float = 0.0) -> DataFrame:
    """(a, b, cov) of all symbols over the dates that both have; shrink blends the
    diagonal with the mean variance. Sums of products come by blocks of symbols, of
    values less their symbol's mean, so that nothing cancels."""
    x = returns.where(F.col(column).isNotNull()).select("ts", "symbol", F.col(column).cast("double").alias("r"))
    means = x.groupBy("symbol").agg(F.avg("r").alias("m"))
    centred = x.join(means, "symbol").select("ts", "symbol", (F.col("r") - F.col("m")).alias("r"))
    n = F.col("n")
    sums = gram(centred, "ts", "symbol", "r")
    out = sums.select("a", "b", F.when(n > 1, (F.col("sab") - F.col("sa") * F.col("sb") / n) / (n - 1)).alias("cov"))
    if not shrink:
        return out
    mean = out.where("a = b").agg(F.avg("cov").alias("_m"))
    return out.join(F.broadcast(mean)).select("a", "b", ((1 - shrink) * F.col("cov") + shrink * F.when(F.col("a") == F.col("b"), F.col("_m")).otherwise(0.0)).alias("cov"))


def expert_availability(log: DataFrame, separators: list[str]) -> DataFrame:
    """log(fold, winner, regime) -> (winner, regime, folds, of_folds, share): in how
    many of a winner's folds a regime had an expert."""
    folds = log.where(F.col("winner").isin(separators)).groupBy("winner").agg(F.count_distinct("fold").alias("of_folds"))
    own = log.groupBy("winner", "regime").agg(F.count_distinct("fold").alias("folds"))
    return own.join(folds, "winner").withColumn("share", F.col("folds") / F.col("of_folds"))


def group_means(results: DataFrame, parameters: list[str], metrics: list[str]) -> DataFrame:
    """Mean metrics by one or two parameters."""
    return results.groupBy(*parameters).agg(*[F.avg(m).alias(m) for m in metrics])


def partners(imp: DataFrame, feature: str, top: int = 10) -> DataFrame:
    """Interaction partners of a feature by largest then mean importance."""
    p = F.split("term", " & ")
    x = imp.where(F.size(p) == 2).where(F.array_contains(p, feature)).select(F.element_at(F.array_remove(p, feature), 1).alias("partner"), "model", "importance")
    return x.groupBy("partner").agg(F.max("importance").alias("max"), F.avg("importance").alias("mean")).orderBy(F.desc("max"), F.desc("mean"), "partner").limit(top)


def search_profile(imp: DataFrame, text: str) -> DataFrame:
    """Terms that contain text (any case): mean, deviation, rank, active folds, share of the top."""
    x = importance_mean(imp.withColumn("importance", F.coalesce("importance", F.lit(0.0))))
    w = W.partitionBy(F.lit(1))
    x = x.withColumns({"rank": F.rank().over(w.orderBy(F.desc("importance"))), "of_top": F.col("importance") / F.max("importance").over(w)})
    return x.where(F.lower("term").contains(text.lower()))


def top_per_model(imp: DataFrame, n: int = 10) -> DataFrame:
    x = imp.groupBy("model", "term").agg(F.avg("importance").alias("importance"))
    return x.withColumn("rank", F.row_number().over(W.partitionBy("model").orderBy(F.desc("importance"), "term"))).where(F.col("rank") <= n)


def grid_results(results: DataFrame, a: str, b: str, values: list, metric: str = "sharpe") -> DataFrame:
    """Heat table of the mean metric by two parameters."""
    return results.groupBy(a).pivot(b, values).agg(F.avg(metric))


def parameter_correlation(results: DataFrame, parameters: list[str], metrics: list[str]) -> DataFrame:
    row = results.agg(*[cs.correlation(p, m).alias(f"{p}|{m}") for p in parameters for m in metrics])
    stack = ", ".join(f"'{p}', '{m}', `{p}|{m}`" for p in parameters for m in metrics)
    return row.selectExpr(f"stack({len(parameters) * len(metrics)}, {stack}) AS (parameter, metric, corr)")


def top_share(results: DataFrame, metric: str, share: float = 0.2, n: int = 10) -> DataFrame:
    cut = results.agg(F.percentile(metric, F.lit(1 - share)).alias("_c"))
    return results.join(F.broadcast(cut)).where(F.col(metric) >= F.col("_c")).drop("_c").orderBy(F.desc(metric)).limit(n)
