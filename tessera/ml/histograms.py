"""Additive models from mergeable histograms.

Boosting on binned features needs nothing of a row but its bins: the sums of
weighted residuals per bin follow from sums of the target per bin and from the
joint counts of each two features' bins, whatever the scores are. So

1. edges of the bins are exact quantiles, by ranks in one global order;
2. one pass adds joint counts and target sums to arrays, per segment of dates:
   a range that a fold holds whole or not at all. A row is binned once for all
   folds that share edges, and a fold's statistics are the sum of its segments';
3. all rounds run on a fold's statistics, (features x bins)^2 numbers at most;
4. residuals that need a model (pairs, experts) take one more pass each.

No group holds rows of a history: groups are cells of statistics, and what goes
to the driver (edges, scores, date ranges) has the size of the models.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import numbered

CHUNK = 200_000


class Span(NamedTuple):
    """Rows of dates lo to hi, of one epoch and label if these aren't None."""

    unit: int
    lo: int
    hi: int
    epoch: int | None = None
    label: int | None = None


class Days:
    """The dates of a panel in order; ranges are pairs of places."""

    def __init__(self, panel: DataFrame):
        rows = sorted(tuple(r) for r in panel.groupBy("ts", "_at").agg(F.max(~F.isnan("y"))).collect())  # a row per date
        self.days, self.at = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
        self.known = np.array([r[2] for r in rows], bool)  # dates with a target

    def span(self, first, last) -> tuple[int, int]:
        return bisect_left(self.days, first), bisect_right(self.days, last) - 1


def segments(folds: dict[int, tuple[int, int]]) -> tuple[list[tuple[int, int]], dict[int, list[int]]]:
    """Date ranges that every fold holds whole or not at all, and each fold's."""
    cuts = sorted({x for lo, hi in folds.values() for x in (lo, hi + 1)})
    ranges = [(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False) if any(lo <= a and b - 1 <= hi for lo, hi in folds.values())]
    return ranges, {f: [i for i, (a, b) in enumerate(ranges) if lo <= a and b <= hi] for f, (lo, hi) in folds.items()}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Columns(dict):
    """The columns of a chunk as arrays, when first asked for."""

    def __init__(self, chunk: pa.RecordBatch):
        super().__init__()
        self.chunk = chunk

    def __missing__(self, name: str) -> np.ndarray:
        self[name] = self.chunk.column(name).to_numpy(zero_copy_only=False)
        return self[name]


class Rows:
    """A chunk of panel rows as arrays."""

    def __init__(self, chunk: pa.RecordBatch, days: np.ndarray):
        self.chunk = chunk
        self.day = np.searchsorted(days, chunk.column("_at").to_numpy(zero_copy_only=False))
        self.y = chunk.column("y").to_numpy(zero_copy_only=False).astype(float)
        self.there = ~np.isnan(self.y)
        self.x = _Columns(chunk)
        self.epoch, self.label, self.state = (self.x[c] for c in ("_epoch", "_label", "_state"))

    def inside(self, s: Span, label: np.ndarray | None = None) -> np.ndarray:
        m = (self.day >= s.lo) & (self.day <= s.hi)
        if s.epoch is not None:
            m &= self.epoch == s.epoch
        return m if s.label is None else m & ((self.label if label is None else label) == s.label)


def prepared(panel: DataFrame, features: list[str], expert: str | None = None, state: str | None = None, labels: list[str] = ()) -> DataFrame:
    """The columns that the passes read: numbers without NULL or NaN, labels as
    places in `labels` (0: none)."""
    names = F.array(*[F.lit(x) for x in labels]) if labels else None
    place = lambda c: F.coalesce(F.array_position(names, F.col(c).cast("string")), F.lit(0)).cast("long") if c and labels else F.lit(0).cast("long")
    epoch = F.col("epoch_no").cast("long") if "epoch_no" in panel.columns else F.lit(0).cast("long")
    number = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
    y = F.coalesce(F.col("y").cast("double"), F.lit(float("nan"))).alias("y")
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("_at")
    return panel.select("ts", "symbol", at, y, *[number(c) for c in features], epoch.alias("_epoch"), place(expert).alias("_label"), place(state).alias("_state"))


def quantiles(panel: DataFrame, days: Days, spans: list[Span], features: list[str], probs: list[float]) -> dict[int, list[np.ndarray]]:
    """For each span and feature the linear quantiles of its training rows: ranks
    in one global order of (span, feature, value), then interpolation. Spans are
    as many as models, so ranks and results are few."""
    if not spans:
        return {}
    spark = panel.sparkSession
    by: dict[tuple[int, int, int], list[int]] = {}
    for s in spans:
        for d in range(s.lo, s.hi + 1):
            by.setdefault((int(days.at[d]), -1 if s.epoch is None else s.epoch, -1 if s.label is None else s.label), []).append(s.unit)
    own = {"_at": F.col("_at")}
    own["_e"] = F.lit(-1).cast("long") if spans[0].epoch is None else F.col("_epoch")
    own["_l"] = F.lit(-1).cast("long") if spans[0].label is None else F.col("_label")
    units = spark.createDataFrame([(*k, v) for k, v in by.items()], "_at long, _e long, _l long, units array<long>")  # a row per date
    rows = panel.where(~F.isnan("y")).withColumns({"_e": own["_e"], "_l": own["_l"]}).join(F.broadcast(units), ["_at", "_e", "_l"])
    rows = rows.select(F.explode("units").alias("unit"), F.array(*features).alias("v")).select("unit", F.posexplode("v").alias("feature", "v"))
    ranked = numbered(rows, ["unit", "feature", "v"], "place", "quantiles")
    counts = sorted(tuple(r) for r in ranked.groupBy("unit", "feature").agg(F.count("*").alias("n")).collect())
    wanted, at = [], 0
    for unit, feature, n in counts:
        for q in probs:
            low = int((n - 1) * q)
            wanted += [(at + low + 1, unit, feature), (at + min(low + 1, n - 1) + 1, unit, feature)]
        at += n
    picked = ranked.join(F.broadcast(spark.createDataFrame(sorted({(w[0],) for w in wanted}), "place long")), "place") if wanted else ranked.limit(0)
    value = {r["place"]: r["v"] for r in picked.select("place", "v").collect()}
    out: dict[int, list[np.ndarray]] = {}
    at = 0
    for unit, _, n in counts:
        found = []
        for q in probs:
            h = (n - 1) * q
            a, b, t = value[at + int(h) + 1], value[at + min(int(h) + 1, n - 1) + 1], h - int(h)
            found.append(b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t)
        out.setdefault(unit, []).append(np.array(found))
        at += n
    return out


def _emit(columns: list[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names)


def statistics(
    panel: DataFrame, days: Days, spans: list[Span], features: list[str], edges: dict[int, list[np.ndarray]], weights: dict[int, np.ndarray] | None = None, target: Callable | None = None, kept: dict[int, list] | None = None
) -> DataFrame:
    """(unit, bag, i, j, v), summed over all training rows of each span: joint
    weights of bins i <= j (features end to end), sums of the weighted target
    (j -1) and, as bag -1, numbers of rows per bin. weights: of the dates, a row a
    bag. target(rows, span, mask): in place of y. kept: the symbols of each bag."""
    sc = panel.sparkSession.sparkContext
    sent, days_at = sc.broadcast((spans, edges, weights, target, kept)), days.at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, edges, weights, target, kept = sent.value
        for chunk in _chunks(batches):
            rows = Rows(chunk, days_at)
            own = {bag: pc.is_in(chunk.column("symbol"), pa.array(names, chunk.column("symbol").type)).to_numpy(zero_copy_only=False) for bag, names in (kept or {}).items()}
            out: list[list[np.ndarray]] = [[], [], [], [], []]

            def add(unit: int, bag: int, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> None:
                for column, part in zip(out, (np.full(len(i), unit), np.full(len(i), bag), i, j, v), strict=True):  # noqa: B023
                    column.append(part)

            for s in spans:
                m = rows.inside(s) & rows.there
                if not m.any():
                    continue
                sizes = [len(e) + 1 for e in edges[s.unit]]
                starts = np.concatenate(([0], np.cumsum(sizes)))
                codes = [np.searchsorted(e, rows.x[f][m], side="right") for f, e in zip(features, edges[s.unit], strict=True)]
                y = rows.y[m] if target is None else target(rows, s, m)
                for k, c in enumerate(codes):
                    n = np.bincount(c, minlength=sizes[k])
                    at = np.flatnonzero(n)
                    add(s.unit, -1, at + starts[k], at + starts[k], n[at].astype(float))
                for bag, by_day in enumerate([None] if weights is None else weights[s.unit]):
                    w = np.ones(len(y)) if by_day is None else by_day[rows.day[m] - s.lo].astype(float)
                    if bag in own:
                        w = w * own[bag][m]
                    for k, c in enumerate(codes):
                        v = np.bincount(c, w * y, sizes[k])
                        add(s.unit, bag, np.arange(sizes[k]) + starts[k], np.full(sizes[k], -1), v)
                        for q in range(k, len(codes)):
                            cell = np.bincount(c * sizes[q] + codes[q], w, sizes[k] * sizes[q])
                            at = np.flatnonzero(cell)
                            add(s.unit, bag, at // sizes[q] + starts[k], at % sizes[q] + starts[q], cell[at])
            yield from _emit(out, ["unit", "bag", "i", "j", "v"])

    return panel.mapInArrow(run, "unit long, bag long, i long, j long, v double").groupBy("unit", "bag", "i", "j").agg(F.sum("v").alias("v"))


def boosted(i: np.ndarray, j: np.ndarray, v: np.ndarray, sizes: list[int], rounds: int, rate: float) -> tuple[float, np.ndarray]:
    """(base, scores of all bins end to end) of a cyclic booster, one feature at a
    time in turn, from the statistics of one span and bag."""
    p = int(sum(sizes))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    gram, sums = np.zeros((p, p)), np.zeros(p)
    own = j < 0
    sums[i[own]] = v[own]
    gram[i[~own], j[~own]] = v[~own]
    gram[j[~own], i[~own]] = v[~own]
    weight = np.diag(gram).copy()
    total = weight[: sizes[0]].sum()
    base = float(sums[: sizes[0]].sum() / total) if total else 0.0
    left, scores = sums - base * weight, np.zeros(p)
    for _ in range(rounds):
        for a, b in zip(starts, starts[1:], strict=False):
            step = rate * left[a:b] / (weight[a:b] + 1.0)
            scores[a:b] += step
            left -= gram[:, a:b] @ step
    return base, scores


def fitted(stats: DataFrame, uses: dict[int, list[int]], sizes: dict[int, list[int]], rounds: int = 60, rate: float = 0.1) -> dict[int, dict]:
    """Per fold {bases, scores (a row a bag), counts (rows per bin)} from the
    statistics of its units. A group is one fold's and bag's statistics."""
    spark = stats.sparkSession
    held = spark.createDataFrame([(u, f) for f, units in uses.items() for u in units], "unit long, fold long")
    cells = stats.join(F.broadcast(held), "unit").groupBy("fold", "bag", "i", "j").agg(F.sum("v").alias("v"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (fold, bag) = key
        i, j, v = pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["v"].to_numpy()
        if bag < 0:
            scores = np.zeros(sum(sizes[fold]))
            scores[i] = v
            base = 0.0
        else:
            base, scores = boosted(i, j, v, sizes[fold], rounds, rate)
        return pd.DataFrame({"fold": [fold], "bag": [bag], "base": [base], "scores": [scores]})

    models: dict[int, dict] = {}
    for r in sorted(cells.groupBy("fold", "bag").applyInPandas(run, "fold long, bag long, base double, scores array<double>").collect(), key=lambda r: (r["fold"], r["bag"])):  # the models
        m = models.setdefault(r["fold"], {"bases": [], "scores": []})
        if r["bag"] < 0:
            m["counts"] = np.array(r["scores"])
        else:
            m["bases"].append(r["base"])
            m["scores"].append(np.array(r["scores"]))
    return models


def cell_of(x: dict[str, np.ndarray], pair: tuple, m: np.ndarray) -> np.ndarray:
    a, b, ea, eb = pair
    return np.searchsorted(ea, x[a][m], side="right") * (len(eb) + 1) + np.searchsorted(eb, x[b][m], side="right")


def pair_cells(panel: DataFrame, days: Days, spans: list[Span], features: list[str], grid: dict[int, list[np.ndarray]], target: Callable, top: int) -> dict[int, list[tuple]]:
    """Per fold the `top` pairs of features that explain most of target(): (a, b,
    edges of a and b, scores, counts), best first. The cells of all pairs of all
    folds are one pass and one aggregation, and are ranked there."""
    sent, days_at = panel.sparkSession.sparkContext.broadcast((spans, grid, target)), days.at
    pairs = [(a, b) for a in range(len(features)) for b in range(a + 1, len(features))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, grid, target = sent.value
        for chunk in _chunks(batches):
            rows = Rows(chunk, days_at)
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for s in spans:
                m = rows.inside(s) & rows.there
                if not m.any():
                    continue
                left = target(rows, s, m)
                for k, (a, b) in enumerate(pairs):
                    ea, eb = grid[s.unit][a], grid[s.unit][b]
                    c = cell_of(rows.x, (features[a], features[b], ea, eb), m)
                    n = np.bincount(c, minlength=(len(ea) + 1) * (len(eb) + 1))
                    at = np.flatnonzero(n)
                    for column, part in zip(out, (np.full(len(at), s.unit), np.full(len(at), k), at, n[at].astype(float), np.bincount(c, left, len(n))[at]), strict=True):
                        column.append(part)
            yield from _emit(out, ["unit", "pair", "cell", "n", "s"])

    cells = panel.mapInArrow(run, "unit long, pair long, cell long, n double, s double").groupBy("unit", "pair", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    shrunk = cells.withColumn("score", F.col("s") / (F.col("n") + 10.0))
    ranked = shrunk.groupBy("unit", "pair").agg(F.sum(F.expr("n * score * score")).alias("gain"), F.collect_list(F.struct("cell", "score", "n")).alias("cells"))
    ranked = ranked.withColumn("place", F.row_number().over(W.partitionBy("unit").orderBy(F.col("gain").desc(), "pair"))).where(F.col("place") <= top)
    found: dict[int, list[tuple]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["unit"], r["place"])):  # `top` pairs a fold
        a, b = pairs[r["pair"]]
        ea, eb = grid[r["unit"]][a], grid[r["unit"]][b]
        score, n = np.zeros((len(ea) + 1) * (len(eb) + 1)), np.zeros((len(ea) + 1) * (len(eb) + 1))
        for c in r["cells"]:
            score[c["cell"]], n[c["cell"]] = c["score"], c["n"]
        found.setdefault(r["unit"], []).append((a, b, ea, eb, score, n))
    return found
