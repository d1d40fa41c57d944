"""Scores to balanced long/short weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cs, ts


def _side_sum(x, *by: str):
    return F.sum(x).over(cs.section(*by))


def predictions_to_weights(pred: DataFrame, quantile: float = 0.2, mode: str = "rank", cap: float = 0.1, score: str = "score", by: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(keys, symbol, weight): top quantile long, bottom short; each side is
    scaled to 0.5 and clipped once; dates without one of the sides have none."""
    x = pred.where(F.col(score).isNotNull())
    w = cs.section(*by)
    x = x.withColumns({"_n": F.count("*").over(w), "_r": cs.rank_first(score, *by)})
    x = x.withColumn("_side", F.when(F.col("_r") > F.col("_n") * (1 - quantile), 1).when(F.col("_r") <= F.col("_n") * quantile, -1))
    x = x.withColumns({"_nl": F.count_if(F.col("_side") == 1).over(w), "_ns": F.count_if(F.col("_side") == -1).over(w), "_mu": F.avg(score).over(w), "_sd": F.coalesce(F.stddev_samp(score).over(w), F.lit(0.0))})
    z = (F.col(score) - F.col("_mu")) / (F.col("_sd") + 1e-12)
    size = {
        "rank": F.when(F.col("_side") == 1, F.col("_r") - (F.col("_n") - F.col("_nl"))).otherwise(F.col("_ns") + 1 - F.col("_r")).cast("double"),
        "zscore": ts.clip(z * F.col("_side"), -3.0, 3.0),
        "raw": (F.col(score) - F.col("_mu")) * F.col("_side"),
        "equal": F.lit(1.0),
    }[mode]
    x = x.where("_side IS NOT NULL AND _nl > 0 AND _ns > 0").withColumn("_s", F.greatest(size, F.lit(0.0)))
    share = F.try_divide(F.col("_s"), _side_sum("_s", *by, "_side")) * 0.5
    return x.withColumn("weight", F.least(F.coalesce(share, F.lit(0.0)), F.lit(cap)) * F.col("_side")).select(*by, "symbol", "weight")


def linear(scores: DataFrame, leverage: float = 1.0, cap: float = 0.1, score: str = "score", by: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Demeaned scores scaled to the leverage, clipped, dust below 1e-4 dropped."""
    x = scores.where(F.col(score).isNotNull()).withColumn("_d", cs.demean(score, *by))
    raw = F.coalesce(F.try_divide(F.col("_d"), F.nullif(_side_sum(F.abs("_d"), *by), F.lit(0.0))) * leverage, F.lit(0.0))
    clipped = ts.clip(raw, -cap, cap)
    return x.withColumn("weight", F.when(F.abs(clipped) < 1e-4, 0.0).otherwise(clipped)).select(*by, "symbol", "weight")


def balanced(signal: DataFrame, leverage: float = 1.0, cap: float | None = None, side_balance: bool = True, min_active: int = 0, value: str = "signal", by: tuple[str, ...] = ("ts",), rounds: int = 8) -> DataFrame:
    """Each side scaled to leverage / 2; dates with too few names or one side are 0."""
    w = cs.section(*by)
    x = signal.withColumn("_v", F.coalesce(F.col(value), F.lit(0.0)))
    nl, ns = F.count_if(F.col("_v") > 0).over(w), F.count_if(F.col("_v") < 0).over(w)
    thin = (F.least(nl, ns) if side_balance else nl + ns) < min_active
    x = x.withColumn("_v", F.when(thin, 0.0).otherwise(F.col("_v")))
    if side_balance:
        x = x.withColumns({"_l": F.sum(F.greatest("_v", F.lit(0.0))).over(w), "_s": F.sum(F.greatest(-F.col("_v"), F.lit(0.0))).over(w)})
        out = F.when((F.col("_l") <= 0) | (F.col("_s") <= 0), 0.0).when(F.col("_v") > 0, F.try_divide(F.col("_v"), F.col("_l")) * leverage / 2).otherwise(F.try_divide(F.col("_v"), F.col("_s")) * leverage / 2)
    else:
        out = F.coalesce(F.try_divide(F.col("_v"), F.nullif(F.sum(F.abs("_v")).over(w), F.lit(0.0))), F.lit(0.0)) * leverage
    x = x.withColumn("weight", F.coalesce(out, F.lit(0.0))).select(*by, "symbol", "weight")
    return x if cap is None else iterative_cap(x, leverage, cap, by, rounds)


def iterative_cap(weights: DataFrame, leverage: float, cap: float, by: tuple[str, ...] = ("ts",), rounds: int = 8) -> DataFrame:
    """Clip and rescale each side to the smaller of leverage / 2 and both sides,
    in rounds; all share one partitioning, so there is a single exchange."""
    w = cs.section(*by)
    x = weights
    for _ in range(rounds):
        c = ts.clip("weight", -cap, cap)
        x = x.withColumn("_c", c).withColumns({"_l": F.sum(F.greatest("_c", F.lit(0.0))).over(w), "_s": F.sum(F.greatest(-F.col("_c"), F.lit(0.0))).over(w)})
        target = F.least(F.lit(leverage / 2), "_l", "_s")
        side = F.when(F.col("_c") > 0, F.col("_l")).otherwise(F.col("_s"))
        x = x.withColumn("weight", F.coalesce(F.col("_c") * F.try_divide(target, F.nullif(side, F.lit(0.0))), F.lit(0.0))).drop("_c", "_l", "_s")
    return x


def momentum(panel: DataFrame, quantile: float = 0.3, vol_factor: float = 0.5, cap: float = 0.1, conviction: float | None = None, by: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(keys, symbol, weight_full, weight_traded): score x volatility adjustment,
    beta-neutral, rank-proportional on both tails. The traded weights leave out
    the names whose volatility ranks in the upper two thirds of those held."""
    w = cs.section(*by)
    vol = F.nullif(F.coalesce("volatility_30", F.lit(0.0)), F.lit(0.0))
    x = panel.withColumn("_vol", vol).withColumn("_vr", F.coalesce(cs.rank_pct("_vol", *by), F.lit(0.5)))
    x = x.withColumn("_f", F.col("combined_score") * F.greatest(1 - F.col("_vr") * vol_factor, F.lit(0.0)))
    x = x.withColumn("_f", cs.residual("_f", "beta_60", *by))
    x = x.withColumns({"_r": cs.rank_first("_f", *by), "_n": F.count("_f").over(w)})
    x = x.withColumn("_side", F.when(F.col("_r") > F.col("_n") * (1 - quantile), 1).when(F.col("_r") <= F.col("_n") * quantile, -1).otherwise(0))
    if conviction is not None:
        x = x.withColumn("_t", F.when(F.col("_side") != 0, F.abs("trend_score"))).withColumn("_side", F.when(cs.rank_pct("_t", *by) > 1 - conviction, F.col("_side")).otherwise(0))
    x = x.withColumn("_s", F.when(F.col("_side") == 1, F.col("_r")).when(F.col("_side") == -1, F.col("_n") + 1 - F.col("_r")).otherwise(0).cast("double"))
    full = ts.clip(F.coalesce(F.try_divide(F.col("_s"), F.nullif(F.sum("_s").over(cs.section(*by, "_side")), F.lit(0.0))), F.lit(0.0)) * 0.5 * F.col("_side"), -cap, cap)
    x = x.withColumn("weight_full", full).withColumn("_tv", F.when(F.col("weight_full") != 0, F.abs(F.coalesce("volatility_30", F.lit(0.0)))))
    traded = F.when(cs.rank_pct("_tv", *by) >= 1 / 3, 0.0).otherwise(F.col("weight_full"))
    return x.withColumn("weight_traded", traded).select(*by, "symbol", "weight_full", "weight_traded")


def momentum_last(panel: DataFrame, quantile: float = 0.3, cap: float = 0.1, masks: tuple[tuple[str, tuple[int, ...], int], ...] = ()) -> DataFrame:
    """Weights on the last date only, with whole-number cut-offs; 0 for the rest.
    masks: (factor, quantiles, number of quantiles); a name that lies in the given
    quantiles of so many factors counts (number - 1/2) times its rank, one that lies
    in none of them once. NULL lies in no quantile; ties go by score, then name."""
    last = panel.join(F.broadcast(panel.agg(F.max("ts").alias("ts"))), "ts", "left_semi")
    x = last.withColumns({"_r": cs.rank_first("mom_final_score"), "_n": F.count("mom_final_score").over(cs.section())})
    longs, shorts = F.floor(F.col("_n") * quantile), F.col("_n") - F.floor(F.col("_n") * (1 - quantile))
    x = x.withColumn("_side", F.when(F.col("_r") > F.col("_n") - longs, 1).when(F.col("_r") <= shorts, -1).otherwise(0))
    x = x.withColumn("_s", F.when(F.col("_side") == 1, F.col("_r") - (F.col("_n") - longs)).when(F.col("_side") == -1, shorts + 1 - F.col("_r")).otherwise(0).cast("double"))
    hits = F.lit(0)
    for factor, quantiles, parts in masks:
        value = F.when(F.col("mom_final_score").isNotNull(), F.col(factor))
        place = F.row_number().over(W.partitionBy("ts").orderBy(value.asc_nulls_last(), F.col("mom_final_score").desc(), "symbol"))
        label = F.ceil(place / F.count(value).over(cs.section()) * parts)
        hits = hits + F.when(value.isNotNull() & label.isin(*quantiles), 1).otherwise(0)
    x = x.withColumn("_hits", hits).withColumn("_s", F.col("_s") * F.when(F.col("_hits") > 0, F.col("_hits") - 0.5).otherwise(1.0))
    share = F.coalesce(F.try_divide(F.col("_s"), F.nullif(F.sum("_s").over(cs.section("ts", "_side")), F.lit(0.0))), F.lit(0.0))
    return x.select("ts", "symbol", ts.clip(share * 0.5 * F.col("_side"), -cap, cap).alias("weight"))


def reversal_signal(panel: DataFrame, n: int = 80, halflife: float = 12) -> DataFrame:
    """(ts, symbol, signal): double z-score of smoothed open-interest change times
    that of the long/short ratio, beta-neutral, smoothed; the z-scores here run
    over time with their deviation clipped to [-2, 2]."""
    from .factors import ewm

    x = panel.withColumn("_a", ts.zscore_capped("oi_pct_chg_smooth3", n)).withColumn("_b", ts.zscore_capped("ls_chg_smooth3", n))
    x = x.withColumn("_a", ts.zscore_capped("_a", n)).withColumn("_p", -F.col("_a") * F.col("_b"))
    x = x.withColumn("_p", cs.residual("_p", "beta_60"))
    return ewm(x.select("ts", "symbol", "_p"), "_p", "signal", halflife=halflife, min_periods=int(halflife)).select("ts", "symbol", "signal")


def distributed(scores: DataFrame, share: float = 0.4, cap: float = 0.1, score: str = "score") -> DataFrame:
    """Top and bottom share by rank weights i / (n (n + 1) / 2)."""
    x = scores.where(F.col(score).isNotNull()).withColumns({"_r": cs.rank_first(score), "_n": F.count(score).over(cs.section())})
    k = F.floor(F.col("_n") * share).cast("double")
    unit = F.try_divide(F.lit(1.0), k * (k + 1) / 2)
    out = F.when(F.col("_r") > F.col("_n") - k, (F.col("_r") - (F.col("_n") - k)) * unit * 0.5).when(F.col("_r") <= k, -(k + 1 - F.col("_r")) * unit * 0.5).otherwise(0.0)
    return x.select("ts", "symbol", ts.clip(out, -cap, cap).alias("weight"))


def per_epoch(panel: DataFrame, epochs: DataFrame, strategy, columns: list[str]) -> DataFrame:
    """strategy over each epoch's own symbols on all dates (windows over time see
    full history), then cut to the epoch's dates; outside every epoch 0. The
    strategy is given the keys of its cross sections, (epoch_id, ts), and keeps
    them; its windows over time run within (epoch_id, symbol)."""
    members = epochs.select(F.col("snapshot_date").alias("epoch_id"), "epoch_start", "epoch_end", "symbol").distinct()
    spread = panel.join(members, "symbol")
    days = members.select("epoch_id", "epoch_start", "epoch_end").distinct()
    found = strategy(spread.drop("epoch_start", "epoch_end"), ("epoch_id", "ts")).join(F.broadcast(days), "epoch_id")
    found = found.where(F.col("ts").cast("date").between(F.col("epoch_start"), F.col("epoch_end"))).select("ts", "symbol", *columns)
    out = panel.select("ts", "symbol").join(found, ["ts", "symbol"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})


def composite_alpha(weights: DataFrame) -> DataFrame:
    """(ts, symbol, score): mean over strategies of z-scores of their non-zero weights."""
    active = F.nullif(F.col("weight"), F.lit(0.0))
    return weights.withColumn("_z", cs.zscore(active, "strategy", "ts")).groupBy("ts", "symbol").agg(F.avg("_z").alias("score"))


def smoothed(weights: DataFrame, alpha: float, leverage: float, aside: DataFrame | None = None) -> DataFrame:
    """Weight EMA that, from the second date on, scales a gross below the leverage
    up to it; absent cells are 0. Dates in `aside` (strategy, ts) keep their weights
    and leave the mean as it is. The step is not linear and couples all symbols of a
    date, so a strategy's dates pass through one task in order; it holds one date."""
    w = weights.select("strategy", "ts", "symbol", "weight")
    cells = w.select("strategy", "ts").distinct().join(w.select("strategy", "symbol").distinct(), "strategy")
    rows = cells.join(w, ["strategy", "ts", "symbol"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    if aside is None:
        rows = rows.withColumn("_aside", F.lit(False))
    else:
        rows = rows.join(F.broadcast(aside.select("strategy", "ts", F.lit(True).alias("_aside")).distinct()), ["strategy", "ts"], "left").withColumn("_aside", F.coalesce("_aside", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev: dict[str, dict] = {}  # strategy -> symbol -> weight
        held: list[pa.RecordBatch] = []
        now = None

        def date_done() -> pa.RecordBatch:
            block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            strategy = block.column("strategy")[0].as_py()
            names, x = block.column("symbol").to_pylist(), block.column("weight").to_numpy()
            if not block.column("_aside")[0].as_py():
                if strategy in prev:
                    old = prev[strategy]
                    x = alpha * x + (1 - alpha) * np.array([old.get(n, 0.0) for n in names])
                    gross = np.abs(x).sum()
                    if 1e-8 < gross < leverage:
                        x = x * (leverage / gross)
                prev.clear()
                prev[strategy] = dict(zip(names, x, strict=True))
            return pa.RecordBatch.from_arrays([block.column("strategy"), block.column("ts"), block.column("symbol"), pa.array(x)], ["strategy", "ts", "symbol", "weight"])

        for batch in batches:
            cuts = [0]
            keys = list(zip(batch.column("strategy").to_pylist(), batch.column("ts").to_pylist(), strict=True))
            cuts += [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if now is not None and keys[lo] != now:
                    yield date_done()
                    held = []
                now = keys[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield date_done()

    return rows.repartition("strategy").sortWithinPartitions("strategy", "ts", "symbol").mapInArrow(run, w.schema)


def over_cap(targets: DataFrame, cap: float) -> DataFrame:
    """Risk events: target notionals above the share of equity."""
    return targets.where(F.abs("target") > F.col("equity") * cap)
