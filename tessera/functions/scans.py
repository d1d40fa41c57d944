"""Recursions and growing frames without a loop over rows.

* A linear recursion y = a y + b is a sum of b times products of a. Its running
  sums stay in range when the exponents are cut into bins of SPAN: what lies two
  bins back weighs less than exp(-SPAN). So a mean with exponential weights is a
  few windows over one exchange of its key.
* The quantile of all rows before is an order statistic of a growing set. Ranks
  are read digit by digit, largest first: how many earlier rows have each next
  digit is a running count within the rows that share the digits so far.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN, STEP = 300.0, 100.0


def _by(keys: list[str], *more: str):
    return W.partitionBy(*keys, *more) if keys or more else W.partitionBy(F.lit(1))


def exponential_means(df: DataFrame, columns: dict[str, str], alpha: float, adjust: bool = True, min_periods: int = 0, keys: list[str] | None = None, order: str = "ts") -> DataFrame:
    """df with exponentially weighted means (column -> name of its mean) along
    `order` within `keys`. Weights decay over NULL rows too, and a NULL row has the
    mean so far. adjust: weighted mean of all values; else the recursion from the
    first value on, in which a gap of g rows gives the old mean the weight
    (1 - alpha)^g against alpha. (keys, order) is unique."""
    keys = keys or []
    decay = -math.log1p(-alpha) if alpha < 1 else STEP
    row = _by(keys).orderBy(order)
    before, upto = row.rowsBetween(W.unboundedPreceding, -1), row.rowsBetween(W.unboundedPreceding, 0)
    x = df.withColumn("_i", F.row_number().over(row).cast("double"))
    names = list(columns)
    known = {c: F.col(c).isNotNull() for c in names}
    if adjust:
        x = x.withColumn("_cum0", F.col("_i") * min(decay, STEP))
        cum = dict.fromkeys(names, "_cum0")
        weight = {c: F.lit(1.0) for c in names}
    else:
        x = x.withColumns({f"_last{k}": F.last(F.when(known[c], F.col("_i")), ignorenulls=True).over(before) for k, c in enumerate(names)})
        kept = {c: F.exp(-F.least((F.col("_i") - F.col(f"_last{k}")) * decay, F.lit(STEP))) for k, c in enumerate(names)}
        first = {c: F.col(f"_last{k}").isNull() for k, c in enumerate(names)}
        weight = {c: F.when(first[c], 1.0).otherwise(alpha / (kept[c] + alpha)) for c in names}
        steps = {c: F.when(known[c] & ~first[c], F.least(-F.ln(kept[c] / (kept[c] + alpha)), F.lit(STEP))).otherwise(0.0) for c in names}
        x = x.withColumns({f"_cum{k}": F.sum(steps[c]).over(upto) for k, c in enumerate(names)})
        cum = {c: f"_cum{k}" for k, c in enumerate(names)}
    out = {}
    for k, c in enumerate(names):
        bin_, at = F.floor(F.col(cum[c]) / SPAN), F.exp(F.pmod(F.col(cum[c]), F.lit(SPAN)))
        grown = F.when(known[c], F.col(c).cast("double") * weight[c] * at).otherwise(0.0)
        x = x.withColumns({f"_bin{k}": bin_, f"_at{k}": at, f"_num{k}": grown, **({f"_den{k}": F.when(known[c], at).otherwise(0.0)} if adjust else {})})
        here = _by(keys, f"_bin{k}").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        bin_before = _by(keys).orderBy(f"_bin{k}").rangeBetween(-1, -1)
        full = lambda v, here=here, bin_before=bin_before: F.sum(v).over(here) + math.exp(-SPAN) * F.coalesce(F.sum(v).over(bin_before), F.lit(0.0))
        mean = full(f"_num{k}") / (full(f"_den{k}") if adjust else F.col(f"_at{k}"))
        out[f"_y{k}"] = F.when(known[c], mean)
    x = x.withColumns(out)
    enough = {c: F.count(c).over(upto) >= max(1, min_periods) for c in names}
    x = x.withColumns({name: F.when(enough[c], F.last(f"_y{k}", ignorenulls=True).over(upto)) for k, (c, name) in enumerate(columns.items())})
    return x.drop("_i", *{*cum.values()}, *[f"_{n}{k}" for k in range(len(names)) for n in ("last", "bin", "at", "num", "den", "y")])


def held(labels: DataFrame, column: str, k: int, order: str = "ts") -> DataFrame:
    """(order, state): the label of the rows before, where a change counts once k
    rows in a row ask for it. NULL asks for nothing and breaks no row of asks. So
    the state is the last label whose run has reached k rows, or the first label."""
    w = W.partitionBy(F.lit(1)).orderBy(order)
    before, upto = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    x = labels.select(order, F.col(column).cast("string").alias("_l"))
    x = x.withColumn("_p", F.last("_l", ignorenulls=True).over(before))
    x = x.withColumn("_run", F.sum(F.when(F.col("_l").isNotNull() & ~F.col("_l").eqNullSafe(F.col("_p")), 1).otherwise(0)).over(upto))
    x = x.withColumn("_n", F.count("_l").over(W.partitionBy("_run").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    settled = F.when((F.col("_n") >= k) | F.col("_p").isNull(), F.col("_l"))
    return x.withColumn("_s", settled).select(order, F.last("_s", ignorenulls=True).over(before).alias("state"))


DIGIT = 4


def expanding_quantiles(df: DataFrame, column: str, probs: dict[str, float], min_periods: int = 1, keys: list[str] | None = None, order: str = "ts") -> DataFrame:
    """(keys, order, a column per name of probs): linear quantiles of the values of
    the rows before; NULL below min_periods of them. Work grows with the length
    times its logarithm to the base 16. (keys, order) is unique."""
    keys = keys or []
    rows = df.select(*keys, order, F.col(column).cast("double").alias("_v"))
    row = _by(keys).orderBy(order)
    rows = rows.withColumns({"_i": F.row_number().over(row), "_n": F.count("_v").over(row.rowsBetween(W.unboundedPreceding, -1))})
    ranked = rows.where("_v IS NOT NULL").withColumn("_rank", F.row_number().over(_by(keys).orderBy("_v", "_i")) - 1)
    longest = ranked.agg(F.max("_rank").alias("m")).first()["m"] or 0
    levels = max(1, -(-int(longest).bit_length() // DIGIT))
    places = [(f"{name}", p, up) for name, p in probs.items() for up in (0, 1)]
    asked = rows.where(F.col("_n") >= max(1, min_periods))
    want = F.array(*[F.struct(F.lit(j).alias("q"), F.least(F.floor((F.col("_n") - 1) * p) + up, F.col("_n") - 1).cast("long").alias("k")) for j, (_, p, up) in enumerate(places)])
    asked = asked.select(*keys, order, "_i", "_n", F.explode(want).alias("w")).select(*keys, order, "_i", "_n", F.col("w.q").alias("_q"), F.col("w.k").alias("_k"), F.lit(0).cast("long").alias("_node"))
    points = ranked.select(*keys, "_i", F.col("_rank").cast("long").alias("_rank"), "_v")
    for level in range(levels):
        shift = DIGIT * (levels - level - 1)
        digit = F.shiftright("_rank", shift).bitwiseAND((1 << DIGIT) - 1)
        p = points.select(*keys, "_i", F.shiftright("_rank", shift + DIGIT).alias("_node"), digit.cast("int").alias("_d"), F.lit(0).alias("_side"))
        both = p.unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True)
        w = _by(keys, "_node").orderBy("_i", F.col("_side").desc()).rowsBetween(W.unboundedPreceding, 0)  # a row's own value comes after its question
        both = both.withColumn("_c", F.array(*[F.count(F.when(F.col("_d") == d, 1)).over(w) for d in range(1 << DIGIT)])).where("_side = 1")
        # The digit is the first whose running total exceeds k; what lies below it is taken off.
        found = F.expr("aggregate(_c, named_struct('d', 0, 'k', _k, 'on', true), (s, c) -> IF(s.on AND s.k >= c, named_struct('d', s.d + 1, 'k', s.k - c, 'on', true), named_struct('d', s.d, 'k', s.k, 'on', false)))")
        asked = both.withColumn("_f", found).select(*keys, order, "_i", "_n", "_q", F.col("_f.k").alias("_k"), (F.col("_node") * (1 << DIGIT) + F.col("_f.d")).alias("_node"))
    value = points.select(*keys, F.col("_rank").alias("_node"), "_v")
    got = asked.join(value, [*keys, "_node"]).groupBy(*keys, order).agg(F.first("_n").alias("_n"), *[F.max(F.when(F.col("_q") == j, F.col("_v"))).alias(f"_q{j}") for j in range(len(places))])

    def between(j: int, p: float) -> Column:
        part = (F.col("_n") - 1) * p - F.floor((F.col("_n") - 1) * p)
        return F.col(f"_q{j}") + (F.col(f"_q{j + 1}") - F.col(f"_q{j}")) * part

    return got.select(*keys, order, *[between(2 * j, p).alias(name) for j, (name, p) in enumerate(probs.items())])
