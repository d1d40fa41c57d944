"""Global orders without a single task: rows are range-partitioned, worked on
piece by piece, and what a piece hands on (a count, a sum, a last value) is
scanned over the few pieces.

The sorted rows are written once to the shared folder: a piece and a row's
place in it are then facts of the table, whatever task reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import written

PART, ROW = "_part", "_row"


def pieces(df: DataFrame, order: list[str | Column], tag: str = "ordered", parts: int | None = None) -> DataFrame:
    """df sorted by `order`, with _part (pieces in ascending order, not without
    gaps) and _row (from 0 in the piece)."""
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    placed = ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = F.col("_at")
    return written(placed.select("*", F.shiftright(at, 33).cast("int").alias(PART), at.bitwiseAND((1 << 33) - 1).alias(ROW)).drop("_at"), tag)


def _before() -> W:
    """Pieces before this one; there are as many rows as pieces."""
    return W.partitionBy(F.lit(1)).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)


def numbered(df: DataFrame, order: list[str | Column], name: str = "position", tag: str = "numbered") -> DataFrame:
    """df with each row's place from 1 in the order; `order` should name a key,
    else equal rows are numbered in any order."""
    rows = pieces(df, order, tag)
    sizes = rows.groupBy(PART).agg(F.count("*").alias("_n"))
    before = sizes.select(PART, F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), PART).withColumn(name, F.col(ROW) + F.col("_before") + 1).drop(PART, ROW, "_before")


def running_sums(df: DataFrame, order: list[str | Column], sums: dict[str, str], tag: str = "running") -> DataFrame:
    """df with, for each column of `sums`, its sum over all rows up to this one
    (NULL counts as 0) under the given name."""
    rows = pieces(df, order, tag)
    here = W.partitionBy(PART).orderBy(ROW).rowsBetween(W.unboundedPreceding, 0)
    totals = rows.groupBy(PART).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_s{i}") for i, c in enumerate(sums)])
    before = totals.select(PART, *[F.coalesce(F.sum(f"_s{i}").over(_before()), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    out = rows.withColumns({name: F.coalesce(F.sum(c).over(here), F.lit(0)) for c, name in sums.items()}).join(F.broadcast(before), PART)
    out = out.withColumns({name: F.col(name) + F.col(f"_b{i}") for i, name in enumerate(sums.values())})
    return out.drop(PART, ROW, *[f"_b{i}" for i in range(len(sums))])


def last_known(df: DataFrame, keys: list[str], order: list[str | Column], columns: list[str], tag: str = "known") -> DataFrame:
    """df with each of `columns` replaced by its last value that isn't NULL, up
    to this row, of the same key. Rows are dealt by key and order together, so a
    key with most of the rows is spread over many tasks; a piece hands the last
    values of its last key on, which is all that can go on in later pieces."""
    rows = pieces(df, [*keys, *order], tag)
    here = W.partitionBy(PART, *keys).orderBy(ROW).rowsBetween(W.unboundedPreceding, 0)
    ends = rows.groupBy(PART, *keys).agg(F.max(ROW).alias("_end"), *[F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), F.col(ROW))).alias(f"_e{i}") for i, c in enumerate(columns)])
    most = W.partitionBy(PART).orderBy(F.col("_end").desc())
    ends = ends.withColumn("_i", F.row_number().over(most)).where("_i = 1")
    handed = W.partitionBy(*keys).orderBy(PART) if keys else W.partitionBy(F.lit(1)).orderBy(PART)
    # The last key of a piece: what it has to hand on is the newest value of this and all earlier pieces that end with that key.
    given = ends.select(PART, *keys, *[F.last(f"_e{i}", ignorenulls=True).over(handed).alias(f"_g{i}") for i in range(len(columns))])
    # The receiver is any later piece with rows of that key: the newest giver before it.
    wanted = rows.groupBy(PART, *keys).agg(F.min(ROW).alias("_first")).where("_first = 0").drop("_first")
    both = wanted.select(PART, *keys, F.lit(0).alias("_side"), *[F.lit(None).cast(given.schema[f"_g{i}"].dataType).alias(f"_g{i}") for i in range(len(columns))]).unionByName(given.withColumn("_side", F.lit(1)))
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy(PART, "_side").rowsBetween(W.unboundedPreceding, -1)
    got = both.withColumns({f"_g{i}": F.last(f"_g{i}", ignorenulls=True).over(w) for i in range(len(columns))}).where("_side = 0").drop("_side")
    same = rows.alias("r").join(F.broadcast(got).alias("g"), (F.col(f"r.{PART}") == F.col(f"g.{PART}")) & _all_same(keys), "left")
    out = same.select(*[F.col(f"r.`{c}`").alias(c) for c in rows.columns], *[F.col(f"g._g{i}.v").alias(f"_g{i}") for i in range(len(columns))])
    out = out.withColumns({c: F.coalesce(F.last(F.col(c), ignorenulls=True).over(here), F.col(f"_g{i}")) for i, c in enumerate(columns)})
    return out.drop(PART, ROW, *[f"_g{i}" for i in range(len(columns))])


def _all_same(keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"r.`{k}`").eqNullSafe(F.col(f"g.`{k}`"))
    return same
