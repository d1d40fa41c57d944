"""As-of joins, strategy alignment and set comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import last_known
from .gram import gram


def asof_join(left: DataFrame, right: DataFrame, by: str | None = "symbol", on: str = "ts", columns: list[str] | None = None, spread: bool | None = None) -> DataFrame:
    """left with the last right row at or before its time. Both sides are sorted
    together once: one shuffle on the key, no range join. A key of NULL time on
    the right never matches; of equal right times the last by value is taken.

    spread: rows are dealt by key and time together, and pieces hand on their last
    value, so that one key may have most of the rows; the default without a key."""
    take = columns or [c for c in right.columns if c not in (by, on)]
    keys = [by] if by else []
    lcols = [c for c in left.columns if c not in (*keys, on)]
    l_side = left.select(*keys, on, F.lit(1).alias("_side"), F.struct(*lcols).alias("_l") if lcols else F.lit(None).alias("_l"), F.lit(None).cast(_struct(right, take)).alias("_r"))
    r_side = right.where(F.col(on).isNotNull()).select(*keys, on, F.lit(0).alias("_side"), F.lit(None).cast(l_side.schema["_l"].dataType).alias("_l"), F.struct(*take).alias("_r"))
    order, both = [F.col(on).asc_nulls_first(), "_side", "_r"], l_side.unionByName(r_side)
    if not keys if spread is None else spread:
        both = last_known(both, keys, order, ["_r"], "asof").where("_side = 1")
    else:
        w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        both = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*keys, on, *[F.col(f"_l.{c}").alias(c) for c in lcols], *[F.col(f"_r.{c}").alias(c) for c in take])


def _struct(df: DataFrame, columns: list[str]):
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType


def merged_market(futures: DataFrame, spot: DataFrame, oi: DataFrame, funding: DataFrame) -> DataFrame:
    """futures with the last spot, open interest and funding row; basis and volume ratio."""
    out = futures
    for side in (spot, oi, funding):
        out = asof_join(out, side)
    return out.withColumns(
        {
            "basis": F.col("futures_close") - F.col("close_spot"),
            "volume_ratio": F.col("futures_volume") / F.when(F.col("volume_spot") == 0, 1e-12).otherwise(F.col("volume_spot")),
        }
    )


def aligned(strategies: dict[str, DataFrame]) -> DataFrame:
    """Weights of several strategies (ts, symbol, weight) on the union of their
    dates and symbols: (strategy, ts, symbol, weight), 0 where one has none."""
    rows = None
    for name, df in strategies.items():
        one = df.select(F.lit(name).alias("strategy"), "ts", "symbol", "weight")
        rows = one if rows is None else rows.unionByName(one)
    cells = rows.select("ts").distinct().crossJoin(rows.select("symbol").distinct()).crossJoin(rows.select("strategy").distinct())
    return cells.join(rows, ["strategy", "ts", "symbol"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def snapshot_overlap(members: DataFrame) -> DataFrame:
    """For each pair of snapshots of (snapshot_date, symbol): common, in either,
    Jaccard. Common symbols are counted by blocks of snapshots; pairs without one
    are filled in from the list of snapshots."""
    one = members.select("snapshot_date", "symbol").distinct()
    sizes = one.groupBy("snapshot_date").agg(F.count("*").alias("n"))
    common = gram(one.withColumn("v", F.lit(1.0)), "symbol", "snapshot_date", "v").select("a", "b", F.col("n").alias("common"))
    pairs = sizes.selectExpr("snapshot_date AS a", "n AS na").crossJoin(sizes.selectExpr("snapshot_date AS b", "n AS nb"))  # a row per pair of snapshots is the result
    out = pairs.join(common, ["a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    either = F.col("na") + F.col("nb") - F.col("common")
    return out.select("a", "b", "common", either.alias("either"), (F.col("common") / either).alias("jaccard"))


def snapshot_changes(members: DataFrame) -> DataFrame:
    """(snapshot_date, added, removed) against the snapshot before."""
    w = W.partitionBy(F.lit(1)).orderBy("snapshot_date")
    s = members.groupBy("snapshot_date").agg(F.collect_set("symbol").alias("s")).withColumn("p", F.lag("s").over(w))
    minus = lambda x, y: F.array_sort(F.array_except(x, y))
    return s.where("p IS NOT NULL").select("snapshot_date", minus("s", "p").alias("added"), minus("p", "s").alias("removed"))


def lifetimes(members: DataFrame) -> DataFrame:
    """(symbol, n_epochs, always, once)."""
    one = members.select("snapshot_date", "symbol").distinct()
    total = one.select("snapshot_date").distinct().agg(F.count("*").alias("total"))
    return one.groupBy("symbol").agg(F.count("*").alias("n_epochs")).join(F.broadcast(total)).selectExpr("symbol", "n_epochs", "n_epochs = total AS always", "n_epochs = 1 AS once")
