"""Sums of products of each two columns of a long table, by blocks.

A self join makes columns^2 rows for each row of the matrix. Here columns are
dealt to blocks of BLOCK and rows to slabs of SLAB: a task holds one slab of two
blocks as a matrix and gives out its products once. A cell is shuffled once for
each block of columns, and a pair of columns once for each slab.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from ..tables import written

BLOCK, SLAB = 256, 4096


def gram(cells: DataFrame, row: str, column: str, value: str, block: int = BLOCK, slab: int = SLAB) -> DataFrame:
    """(a, b, n, sa, sb, sab) of each two columns that have a row in common: over
    these rows, their number and the sums of the one's values, the other's and of
    the products. (row, column) is unique; NULL cells and keys are absent."""
    kind = dict(cells.dtypes)[column]
    x = cells.where(f"`{row}` IS NOT NULL AND `{column}` IS NOT NULL AND `{value}` IS NOT NULL").select(F.col(row).alias("r"), F.col(column).alias("c"), F.col(value).cast("double").alias("v"))
    x = written(x, "gram-cells")
    place = numbered(x.select("c").distinct(), ["c"], "at", "gram-columns")
    top = place.agg(F.max("at").alias("m")).first()["m"] or 0
    blocks = -(-int(top) // block)
    x = x.join(place, "c").withColumns({"block": ((F.col("at") - 1) / block).cast("int"), "slab": F.pmod(F.xxhash64("r"), F.lit(max(1, -(-x.select("r").distinct().count() // slab)))).cast("int")})
    # A block meets each block from its own on: (i, j) with i <= j.
    meets = F.expr(f"transform(sequence(0, {max(blocks - 1, 0)}), k -> struct(least(k, block) AS i, greatest(k, block) AS j))")
    dealt = x.withColumn("m", F.explode(meets)).select("r", "c", "v", "slab", "block", F.col("m.i").alias("i"), F.col("m.j").alias("j"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key[0], key[1]
        rows = pd.factorize(pdf["r"])[0]
        sides = []
        for b in (i, j):
            own = (pdf["block"] == b).to_numpy()
            names, at = np.unique(pdf["c"].to_numpy()[own], return_inverse=True)
            v, there = np.zeros((rows.max() + 1, len(names))), np.zeros((rows.max() + 1, len(names)))
            v[rows[own], at] = pdf["v"].to_numpy()[own]
            there[rows[own], at] = 1.0
            sides.append((names, v, there))
        (na, va, ta), (nb, vb, tb) = sides
        if not len(na) or not len(nb):
            return pd.DataFrame(columns=["a", "b", "n", "sa", "sb", "sab"])
        n, sa, sb, sab = ta.T @ tb, va.T @ tb, ta.T @ vb, va.T @ vb
        p, q = np.nonzero(n)
        out = pd.DataFrame({"a": na[p], "b": nb[q], "n": n[p, q], "sa": sa[p, q], "sb": sb[p, q], "sab": sab[p, q]})
        return out if i == j else pd.concat([out, out.rename(columns={"a": "b", "b": "a", "sa": "sb", "sb": "sa"})[out.columns]])

    parts = dealt.groupBy("i", "j", "slab").applyInPandas(run, f"a {kind}, b {kind}, n double, sa double, sb double, sab double")
    return parts.groupBy("a", "b").agg(F.sum("n").cast("long").alias("n"), *[F.sum(c).alias(c) for c in ("sa", "sb", "sab")])
