"""Calendars, fills, reshapes, masks and universe epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ts
from ..tables import written


def densify(bars: DataFrame) -> DataFrame:
    """Every date of the table for every symbol; missing cells are NULL. The
    grid is dates x symbols by definition; both sides are distinct keys only. Bars
    are needed three times and are far fewer than the facts they come from: they are
    written once, so that the facts are read once."""
    bars = written(bars, "bars")
    dates, symbols = bars.select("ts").distinct(), bars.select("symbol").distinct()
    return dates.crossJoin(symbols).join(bars, ["ts", "symbol"], "left")


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every double and float column."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error that names the missing columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def numeric_features(df: DataFrame, exclude: tuple[str, ...] = (), include: tuple[str, ...] | None = None) -> list[str]:
    """Numeric columns that are neither keys, targets nor excluded."""
    meta = {"ts", "symbol", "y", "y_raw", "epoch_id", "fold", *exclude}
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    found = [c for c, t in df.dtypes if t in kinds and c not in meta and not c.startswith("signal_")]
    return [c for c in found if include is None or c in include]


def normalized_symbol(symbol: str | Column) -> Column:
    """Without a leading 1000."""
    c = ts.col(symbol)
    return F.when(c.startswith("1000"), F.substring(c, 5, 1 << 20)).otherwise(c)


def keep_one(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in the given order."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    if last:
        order = [o.desc_nulls_last() for o in order]
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def to_wide(df: DataFrame, value: str, symbols: list[str]) -> DataFrame:
    """Dates by symbols; doubled cells are averaged."""
    return df.groupBy("ts").pivot("symbol", symbols).agg(F.avg(value))


def to_long(wide: DataFrame, name: str, keep_null: bool = False) -> DataFrame:
    out = wide.unpivot("ts", [c for c in wide.columns if c != "ts"], "symbol", name)
    return out if keep_null else out.where(F.col(name).isNotNull())


def launch_mask(df: DataFrame, columns: list[str], ret: str = "ret", k: int = 5, after_death: bool = False) -> DataFrame:
    """NULL in columns until the symbol has had k returns that aren't 0; with
    after_death, once fewer than k of them are still to come."""
    moved = F.when(F.coalesce(F.col(ret), F.lit(0.0)) != 0, 1).otherwise(0)
    frame = ts.series().rowsBetween(0, W.unboundedFollowing) if after_death else ts.trailing(None)
    alive = F.sum(moved).over(frame) >= k
    return df.withColumn("_alive", alive).withColumns({c: F.when(F.col("_alive"), F.col(c)) for c in columns}).drop("_alive")


def quarterly_epochs(bars: DataFrame, top: int) -> DataFrame:
    """(snapshot_date, epoch_start, epoch_end, symbol): for each calendar quarter
    the top symbols by volume of the quarter before."""
    q = F.date_trunc("quarter", "ts").cast("timestamp")
    vol = bars.groupBy(q.alias("q"), "symbol").agg(F.sum("volume").alias("v"))
    ranked = vol.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.col("v").desc(), "symbol"))).where(F.col("r") <= top)
    start = F.add_months(F.col("q").cast("date"), 3)
    return ranked.select(F.col("q").cast("date").alias("snapshot_date"), start.alias("epoch_start"), F.date_sub(F.add_months(start, 3), 1).alias("epoch_end"), "symbol")


def epoch_mask(df: DataFrame, epochs: DataFrame, columns: list[str]) -> DataFrame:
    """0 in columns where the symbol is outside the universe of the date. Epochs
    become one row per member and quarter, an equi-join instead of a range."""
    members = epochs.select(F.col("epoch_start").alias("_e"), "symbol", F.lit(True).alias("_active")).distinct()
    keyed = df.withColumn("_e", F.date_trunc("quarter", "ts").cast("date"))
    out = keyed.join(members, ["_e", "symbol"], "left")
    return out.withColumns({c: F.when(F.col("_active"), F.col(c)).otherwise(0.0) for c in columns}).drop("_e", "_active")


def epoch_route(df: DataFrame, epochs: DataFrame) -> DataFrame:
    """Rows with the epoch whose days hold their date, the end day included. An
    epoch becomes a row for each of its days, so rows meet it by equality."""
    e = epochs.select("snapshot_date", "epoch_start", "epoch_end").distinct()
    days = e.where("epoch_start <= epoch_end").select("*", F.explode(F.sequence(F.col("epoch_start").cast("date"), F.col("epoch_end").cast("date"))).alias("_day"))
    return df.withColumn("_day", F.col("ts").cast("date")).join(days, "_day").drop("_day")


def active_sets(df: DataFrame) -> DataFrame:
    """Epochs by change of the active set: (epoch_id, start, end, symbols)."""
    sets = df.groupBy("ts").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))
    ids = sets.withColumn("epoch_id", ts.run_id("symbols", None))
    out = ids.groupBy("epoch_id").agg(F.min("ts").alias("start"), F.min_by("symbols", "ts").alias("symbols"))
    end = F.lead("start").over(W.partitionBy(F.lit(1)).orderBy("start"))
    return out.select("epoch_id", "start", F.date_sub(end.cast("date"), 1).alias("end"), "symbols")
