"""Targets, folds, bootstraps and walk-forward training.

Models are fitted to histograms that Spark adds up (see histograms); the fold
calendar, the models and the regime tournament, all of the size of the folds, are
held on the driver and broadcast for scoring.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cs, scans, ts
from ..tables import written
from . import histograms as H


def build_target(panel: DataFrame, horizon: int = 1, neutral: bool = False, mode: str = "rank") -> DataFrame:
    """y_raw: return over the next `horizon` rows; y: optionally the beta residual,
    raw or as centred rank."""
    x = panel.withColumn("y_raw", F.try_divide(ts.lead("close", horizon), F.col("close")) - 1)
    x = x.withColumn("y", cs.residual("y_raw", "beta_60", active="all", min_points=3, fill_zero=False) if neutral else F.col("y_raw"))
    return x.withColumn("y", cs.rank_centred("y")) if mode == "rank" else x


def folds(dates: list, start, every: int = 20, horizon: int = 1, gap_share: float = 0.0, window: int = 0) -> list[dict]:
    """Retrain every k dates from start; training ends max(horizon, share of the
    window) dates before; window 0 grows."""
    dates = sorted(dates)
    first = next((i for i, d in enumerate(dates) if d >= start), len(dates))
    out = []
    for k, i in enumerate(range(first, len(dates), every)):
        end = i - max(horizon, int((window or i) * gap_share))
        begin = max(0, end - window) if window else 0
        if end > begin:
            out.append({"fold": k, "train_start": dates[begin], "train_end": dates[end - 1], "predict_start": dates[i], "predict_end": dates[min(i + every, len(dates)) - 1]})
    return out


def bootstrap_counts(dates: DataFrame, block: int, bags: int, seed: int = 7) -> DataFrame:
    """(bag, ts, n): how often overlapping blocks with hashed starts cover a date."""
    x = dates.select("ts").distinct().withColumn("i", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("ts")) - 1)
    n = x.count()
    spark = dates.sparkSession
    starts = spark.range(bags).select(F.col("id").cast("int").alias("bag"), F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // block)) - 1))).alias("b"))
    starts = starts.withColumn("s", F.pmod(F.xxhash64(F.lit(seed), "bag", "b"), F.lit(max(1, n - block + 1))).cast("int"))
    hit = starts.select("bag", F.explode(F.sequence(F.col("s"), F.least(F.col("s") + block - 1, F.lit(n - 1)))).alias("i")).groupBy("bag", "i").agg(F.count("*").cast("smallint").alias("n"))
    return hit.join(F.broadcast(x), "i").select("bag", "ts", "n")


def block_counts(spark: SparkSession, days: dict[int, int], block: int = 20, bags: int = 4, seed: int = 7) -> dict[int, np.ndarray]:
    """For each fold of so many days, a row a bag of what bootstrap_counts() says of
    its days. The starts of all folds' blocks are one small table."""
    x = spark.createDataFrame(sorted(days.items()), "fold long, n long").withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    x = x.where("n > 0").withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
    x = x.withColumn("s", F.pmod(F.xxhash64(F.lit(seed), "bag", "b"), F.greatest(F.lit(1), F.col("n") - block + 1)))
    out = {f: np.zeros((bags, n)) for f, n in days.items()}
    for r in x.select("fold", "bag", "s").collect():
        out[r["fold"]][r["bag"], r["s"] : r["s"] + block] += 1
    return out


def kept_symbols(panel: DataFrame, share: float, bags: int, seed: int = 7) -> DataFrame:
    """(bag, symbol): each bag's share of the symbols (rounded down, one at least),
    by a hash of bag and name."""
    names = panel.select("symbol").where("symbol IS NOT NULL").distinct().withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    w = W.partitionBy("bag")
    place = F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "bag", "symbol"), "symbol"))
    return names.withColumns({"_p": place, "_n": F.count("*").over(w)}).where(F.col("_p") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).select("bag", "symbol")


def bag_table(panel: DataFrame, bags: int = 4, block: int = 20, tail: float = 0.1, symbol_share: float = 1.0, others_validate: bool = False, seed: int = 7) -> DataFrame:
    """(bag, ts, symbol, n) of every row and bag: -1 for the last share of dates,
    the validation of all bags; else how often the bag has the date, 0 for symbols
    that it leaves out (with others_validate: -1)."""
    mask = validation_tail(panel, tail)
    counts = bootstrap_counts(mask.where("mask = 1"), block, bags, seed)
    days = mask.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1)))).join(counts, ["bag", "ts"], "left")
    x = panel.select("ts", "symbol").join(F.broadcast(days), "ts")
    own = kept_symbols(panel, symbol_share, bags, seed).withColumn("_own", F.lit(True))
    x = x.join(F.broadcast(own), ["bag", "symbol"], "left") if symbol_share < 1 else x.withColumn("_own", F.lit(True))
    n = F.when(F.col("mask") == -1, -1).when(F.col("_own"), F.coalesce("n", F.lit(0))).otherwise(-1 if others_validate else 0)
    return x.select("bag", "ts", "symbol", n.cast("smallint").alias("n"))


def validation_tail(dates: DataFrame, share: float = 0.1) -> DataFrame:
    """(ts, mask): -1 for the last share of dates, 1 before."""
    w = W.partitionBy(F.lit(1))
    i, n = F.row_number().over(w.orderBy("ts")), F.count("*").over(w)
    return dates.select("ts").distinct().select("ts", F.when(i > n - F.floor(n * share), -1).otherwise(1).cast("tinyint").alias("mask"))


def fold_rows(panel: DataFrame, calendar: list[dict]) -> DataFrame:
    """panel rows of each fold with a role, train or predict. The calendar meets
    the dates by range, a row per date and fold, and these meet the rows by equality."""
    c = F.broadcast(panel.sparkSession.createDataFrame(calendar))
    inside = F.col("ts").between(F.col("train_start"), F.col("train_end"))
    ahead = F.col("ts").between(F.col("predict_start"), F.col("predict_end"))
    dates = panel.select("ts").distinct().join(c, inside | ahead).select("ts", "fold", F.when(inside, "train").otherwise("predict").alias("role"))
    return panel.join(F.broadcast(dates), "ts")


def walk_forward(panel: DataFrame, features: list[str], calendar: list[dict], expert: str | None = None, share: float = 0.5, least: int = 50, least_expert: int = 30, state: str | None = None, raw: list[str] | None = None, bags: int = 1, pairs: int = 0, rebin: int = 1) -> tuple[DataFrame, DataFrame]:
    """(predictions(fold, ts, symbol, score), importance(fold, term, importance)) of
    trained(): see there."""
    found = trained(panel, features, calendar, expert, share, least, least_expert, state, raw, bags, pairs, rebin)
    scores = found.where("kind = 'score'").select("fold", "ts", "symbol", F.col("value").alias("score"))
    return scores, found.where("kind = 'importance'").select("fold", "term", F.col("value").alias("importance"))


class FoldModel:
    """What a fold has learned: scores of bins for each bag, tables of pairs, and
    boosters for labels, on the residuals."""

    def __init__(self, features: list[str], edges: list[np.ndarray], found: dict):
        self.features, self.edges, self.found = features, edges, found
        self.pairs: list[tuple] = []
        self.raw: list[str] = []
        self.experts: dict[int, tuple[list[np.ndarray], dict]] = {}
        self.share = 0.0

    def _sum(self, rows: H.Rows, m: np.ndarray, features: list[str], edges: list[np.ndarray], found: dict) -> np.ndarray:
        at, codes = 0, []
        for f, e in zip(features, edges, strict=True):
            codes.append(np.searchsorted(e, rows.x[f][m], side="right") + at)
            at += len(e) + 1
        return np.mean([base + sum(scores[c] for c in codes) for base, scores in zip(found["bases"], found["scores"], strict=True)], axis=0)

    def predict(self, rows: H.Rows, m: np.ndarray) -> np.ndarray:
        """Main effects and pairs."""
        out = self._sum(rows, m, self.features, self.edges, self.found)
        for a, b, ea, eb, score, _ in self.pairs:
            out = out + score[H.cell_of(rows.x, (self.features[a], self.features[b], ea, eb), m)]
        return out

    def mixed(self, rows: H.Rows, m: np.ndarray, label: np.ndarray) -> np.ndarray:
        """predict() and the share of each row's expert."""
        out = self.predict(rows, m)
        for name, (edges, found) in self.experts.items():
            own = label[m] == name
            if own.any():
                at = np.flatnonzero(m)[own]
                out[own] += self.share * self._sum(rows, at, self.raw, edges, found)
        return out

    def importance(self) -> list[tuple[str, float]]:
        """Terms with the mean of |score| over the training rows; a pair is `a & b`."""
        n, at, out = self.found["counts"], 0, []
        for f, e in zip(self.features, self.edges, strict=True):
            cut = slice(at, at + len(e) + 1)
            out.append((f, float(np.mean([(n[cut] * np.abs(s[cut])).sum() / n[cut].sum() for s in self.found["scores"]]))))
            at = cut.stop
        return out + [(f"{self.features[a]} & {self.features[b]}", float((c * np.abs(s)).sum() / c.sum())) for a, b, _, _, s, c in self.pairs]

    def shapes(self, ranges: list[tuple[float, float]]) -> list[tuple]:
        """(term, bag, bin, center, density, score); density is mass per unit."""
        n, at, out = self.found["counts"], 0, []
        for f, e, (low, high) in zip(self.features, self.edges, ranges, strict=True):
            cut = slice(at, at + len(e) + 1)
            bounds = np.concatenate(([low], e, [high]))
            width, mass = np.diff(bounds), n[cut] / n[cut].sum()
            pdf = np.divide(mass, width, out=np.full(len(mass), np.nan), where=width > 0)
            pdf = np.where(np.isnan(pdf), np.nanmedian(pdf) if (~np.isnan(pdf)).any() else 1.0, pdf)
            for bag, s in enumerate(self.found["scores"]):
                out += [(f, bag, k, *map(float, v)) for k, v in enumerate(zip(0.5 * (bounds[:-1] + bounds[1:]), pdf, s[cut], strict=True))]
            at = cut.stop
        return out


class Residual:
    """The target less what the model of the span's unit says."""

    def __init__(self, models: dict[int, FoldModel]):
        self.models = models

    def __call__(self, rows: H.Rows, span: H.Span, m: np.ndarray) -> np.ndarray:
        return rows.y[m] - self.models[span.unit].predict(rows, m)


def _scored(rows: DataFrame, days: H.Days, spans: list[H.Span], models: dict[int, FoldModel], known: bool) -> DataFrame:
    """(fold, ts, symbol, value) of all rows of the spans; known: training rows,
    with their own labels."""
    sent, at = rows.sparkSession.sparkContext.broadcast((spans, models)), days.at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, models = sent.value
        for chunk in batches:
            x = H.Rows(chunk, at)
            for s in spans:
                m = x.inside(s) & x.there if known else x.inside(s)
                if m.any():
                    value = models[s.unit].mixed(x, m, x.label if known else x.state)
                    keys = chunk.select(["ts", "symbol"]).filter(pa.array(m))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), s.unit)), *keys.columns, pa.array(value)], ["fold", "ts", "symbol", "value"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"fold long, ts {kinds['ts']}, symbol {kinds['symbol']}, value double")


def trained(
    panel: DataFrame,
    features: list[str],
    calendar: list[dict],
    expert: str | None = None,
    share: float = 0.5,
    least: int = 50,
    least_expert: int = 30,
    state: str | None = None,
    raw: list[str] | None = None,
    bags: int = 1,
    pairs: int = 0,
    rebin: int = 1,
    symbol_share: float = 1.0,
    rounds: int = 60,
) -> DataFrame:
    """(fold, kind, ts, symbol, term, bag, bin, x, density, value): kind score (out
    of sample), fitted (in sample), importance, or shape (a bin of a main effect).

    A global ensemble, and with `expert` one on its residuals for each label; the
    label of the row counts in sample, `state` (that known before, see hysteresis)
    out of sample. A label without an expert adds 0. The experts use the columns
    `raw` in place of the features, if given. Features that are NULL count as 0. A
    fold of fewer than `least` rows gives nothing. Edges of bins are those of the
    fold's training rows; rebin k: of the first in every k folds, 0: of the first
    fold, so that histories which grow are binned and counted once (see
    histograms). Bags have a block bootstrap of the dates and, with symbol_share, a
    part of the symbols each. A panel with epoch_no (see per_epoch) meets the folds of its epoch
    only, those from epoch_no x 10,000 on."""
    spark, raw, state = panel.sparkSession, raw or features, state or expert
    names = sorted({*features, *raw})
    labels = sorted(r[0] for r in panel.select(F.col(expert).cast("string")).distinct().collect() if r[0] is not None) if expert else []
    rows = written(H.prepared(panel, names, expert, state, labels), "training-rows")
    days = H.Days(rows)
    epoch = (lambda fold: fold // 10_000) if "epoch_no" in panel.columns else lambda fold: None
    train, ahead = ({c["fold"]: days.span(c[f"{k}_start"], c[f"{k}_end"]) for c in calendar} for k in ("train", "predict"))
    order = sorted(f for f, (lo, hi) in train.items() if lo <= hi)
    first: dict[int, int] = {}  # fold -> the fold whose edges it uses
    for e in {epoch(f) for f in order}:
        own = [f for f in order if epoch(f) == e]
        first |= {f: own[(k // rebin) * rebin if rebin else 0] for k, f in enumerate(own)}
    steps, cells = np.linspace(0, 1, 17)[1:-1].tolist(), np.linspace(0, 1, 7)[1:-1].tolist()
    q = H.quantiles(rows, days, [H.Span(f, *train[f], epoch(f)) for f in sorted(set(first.values()))], features, steps + cells)
    order = [f for f in order if first[f] in q]
    edges = {f: [np.unique(v[: len(steps)]) for v in q[first[f]]] for f in order}
    grid = {f: [np.unique(v[len(steps) :]) for v in q[first[f]]] for f in order}

    spans, uses, unit_edges, weights = [], {}, {}, None
    if bags > 1:
        spans = [H.Span(f, *train[f], epoch(f)) for f in order]
        uses, unit_edges, weights = {f: [f] for f in order}, edges, {}
        known = {f: days.known[train[f][0] : train[f][1] + 1] for f in order}
        counts = block_counts(spark, {f: int(k.sum()) for f, k in known.items()}, bags=bags)
        for f in order:
            weights[f] = np.zeros((bags, len(known[f])))
            weights[f][:, known[f]] = counts[f]
    else:
        for v in sorted({first[f] for f in order}):
            ranges, held = H.segments({f: train[f] for f in order if first[f] == v})
            at = len(spans)
            spans += [H.Span(at + k, lo, hi, epoch(v)) for k, (lo, hi) in enumerate(ranges)]
            unit_edges |= {at + k: edges[v] for k in range(len(ranges))}
            uses |= {f: [at + k for k in ks] for f, ks in held.items()}
    sizes = {f: [len(e) + 1 for e in edges[f]] for f in order}
    kept: dict[int, list] | None = None
    if bags > 1 and symbol_share < 1:
        kept = {}
        for r in kept_symbols(rows, symbol_share, bags).collect():  # a row a bag and symbol
            kept.setdefault(r["bag"], []).append(r["symbol"])
    found = H.fitted(H.statistics(rows, days, spans, features, unit_edges, weights, kept=kept), uses, sizes, rounds) if order else {}
    models = {f: FoldModel(features, edges[f], m) for f, m in found.items() if m["counts"][: sizes[f][0]].sum() >= least}
    inside = [H.Span(f, *train[f], epoch(f)) for f in sorted(models)]
    if pairs and inside:
        for f, best in H.pair_cells(rows, days, inside, features, grid, Residual(models), pairs).items():
            models[f].pairs = best
    if labels and inside:
        many = len(labels) + 1
        own = [H.Span(s.unit * many + k, s.lo, s.hi, s.epoch, k) for s in inside for k in range(1, many)]
        sq = H.quantiles(rows, days, own, raw, steps)
        own = [s for s in own if s.unit in sq]
        se = {u: [np.unique(v) for v in x] for u, x in sq.items()}
        ss = {u: [len(e) + 1 for e in x] for u, x in se.items()}
        stats = H.statistics(rows, days, own, raw, se, target=Residual({s.unit: models[s.unit // many] for s in own}))
        for u, m in H.fitted(stats, {s.unit: [s.unit] for s in own}, ss, rounds=30).items():
            if m["counts"][: ss[u][0]].sum() >= least_expert:
                model = models[u // many]
                model.raw, model.share = raw, share
                model.experts[u % many] = (se[u], m)

    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    out = []
    for kind, among, known in (("score", ahead, False), ("fitted", train, True)):
        x = _scored(rows, days, [H.Span(f, *among[f], epoch(f)) for f in sorted(models)], models, known)
        out.append(x.select("fold", F.lit(kind).alias("kind"), "ts", "symbol", *none("string", "term"), *none("long", "bag", "bin"), *none("double", "x", "density"), "value"))
    terms = [(f, "importance", t, None, None, None, None, v) for f, m in models.items() for t, v in m.importance()]
    low = _extremes(rows, days, spans, uses, features) if models else {}
    terms += [(f, "shape", t, bag, k, x, d, v) for f, m in models.items() for t, bag, k, x, d, v in m.shapes(low[f])]
    told = spark.createDataFrame(terms, "fold long, kind string, term string, bag long, bin long, x double, density double, value double")
    kinds = dict(rows.dtypes)
    out.append(told.select("fold", "kind", *none(kinds["ts"], "ts"), *none(kinds["symbol"], "symbol"), "term", "bag", "bin", "x", "density", "value"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def _extremes(rows: DataFrame, days: H.Days, spans: list[H.Span], uses: dict[int, list[int]], features: list[str]) -> dict[int, list[tuple[float, float]]]:
    """Per fold the smallest and largest training value of each feature, from those of its units."""
    at = [(int(days.at[d]), -1 if s.epoch is None else s.epoch, s.unit) for s in spans for d in range(s.lo, s.hi + 1)]
    units = rows.sparkSession.createDataFrame(at, "_at long, _e long, unit long")
    x = rows.where(~F.isnan("y")).withColumn("_e", F.col("_epoch") if spans[0].epoch is not None else F.lit(-1).cast("long")).join(F.broadcast(units), ["_at", "_e"])
    found = {r["unit"]: r for r in x.groupBy("unit").agg(*[g(f).alias(f"{k}{i}") for i, f in enumerate(features) for k, g in (("a", F.min), ("b", F.max))]).collect()}
    own = {f: [found[u] for u in us if u in found] for f, us in uses.items()}
    return {f: [(min(r[f"a{i}"] for r in rs), max(r[f"b{i}"] for r in rs)) for i in range(len(features))] for f, rs in own.items() if rs}


def shape_table(found: DataFrame) -> DataFrame:
    """The shapes of trained(), as shape_health() takes them."""
    return found.where("kind = 'shape'").select("fold", F.col("term").alias("feature"), "bag", "bin", "x", F.col("value").alias("score"), "density")


def per_epoch(panel: DataFrame, epochs: DataFrame, features: list[str], calendar: list[dict], **how) -> DataFrame:
    """(epoch, fold, ts, symbol, score): each epoch is trained on its own symbols
    over all dates, its predictions cut to its dates, and all are put together. An
    epoch's fold is a group of its own."""
    spans = [(str(r["snapshot_date"]), r["epoch_start"], r["epoch_end"]) for r in epochs.select("snapshot_date", "epoch_start", "epoch_end").distinct().orderBy("snapshot_date").collect()]  # a row an epoch
    day = lambda t: t.date() if hasattr(t, "date") else t
    rows = []
    for e, (_, start, end) in enumerate(spans):
        rows += [{**c, "fold": e * 10_000 + c["fold"]} for c in calendar if day(c["predict_end"]) >= start and day(c["predict_start"]) <= end]
    members = epochs.select("symbol", F.col("snapshot_date").cast("string").alias("epoch")).distinct()
    names = panel.sparkSession.createDataFrame([(e, s, a, b) for e, (s, a, b) in enumerate(spans)], "epoch_no long, epoch string, epoch_start date, epoch_end date")
    if not rows:
        return panel.select(F.lit("").alias("epoch"), F.lit(0).cast("long").alias("fold"), "ts", "symbol", F.lit(0.0).alias("score")).limit(0)
    own = panel.join(F.broadcast(members.join(names, "epoch").select("symbol", "epoch_no")), "symbol")
    scores = walk_forward(own, features, rows, **how)[0]
    scores = scores.withColumn("epoch_no", F.floor(F.col("fold") / 10_000)).join(F.broadcast(names), "epoch_no")
    cut = scores.where(F.col("ts").cast("date").between(F.col("epoch_start"), F.col("epoch_end")))
    return cut.select("epoch", (F.col("fold") % 10_000).alias("fold"), "ts", "symbol", "score")


def mixture(global_score: DataFrame, expert_score: DataFrame, share: float = 0.5) -> DataFrame:
    """global + share x expert; a missing expert is 0."""
    e = expert_score.select("ts", "symbol", F.col("score").alias("_e"))
    return global_score.join(e, ["ts", "symbol"], "left").select("ts", "symbol", (F.col("score") + share * F.coalesce("_e", F.lit(0.0))).alias("score"))


def tournament(raw: Iterable[tuple[int, dict[str, float]]], span: int = 5) -> list[tuple[int, str, dict[str, float]]]:
    """(fold, winner, smoothed scores) by EMA over folds; a candidate missing in a
    fold decays, its first value seeds it; ties go to the first name. The input
    is a few numbers a fold."""
    a, state, out = 2 / (span + 1), {}, []
    for fold, values in sorted(raw, key=lambda x: x[0]):
        for name in {*state, *values}:
            state[name] = values[name] if name not in state else (1 - a) * state[name] + a * values.get(name, 0.0)
        out.append((fold, max(sorted(state), key=state.get), dict(state)))
    return out


def hysteresis(labels: DataFrame, column: str, k: int = 3) -> DataFrame:
    """(ts, state): the label of the row before, switched only after k rows in a
    row ask for the same other one; a missing label changes nothing."""
    return scans.held(labels, column, k)


def scalar_ema(values: DataFrame, span: int = 5) -> DataFrame:
    """(fold, name, ema) per candidate over all folds from its first value, which
    seeds it; absent folds decay."""
    grid = values.select("fold").distinct().crossJoin(values.select("name").distinct()).join(values, ["fold", "name"], "left")
    first = F.min(F.when(F.col("value").isNotNull(), F.col("fold"))).over(W.partitionBy("name"))
    x = grid.withColumn("_first", first).where(F.col("fold") >= F.col("_first")).withColumn("_v", F.coalesce("value", F.lit(0.0)))
    return scans.exponential_means(x, {"_v": "ema"}, 2 / (span + 1), adjust=False, keys=["name"], order="fold").select("fold", "name", "ema")


def conditional_mi(panel: DataFrame, calendar: list[dict], features: list[str], candidates: list[str], target: str = "y_raw", bins: tuple[int, int, int] = (3, 5, 3), least: int = 4) -> DataFrame:
    """(fold, candidate, cmi): the mean over features of the conditional mutual
    information with the target given the candidate, all in quantile bins of the
    fold's training rows. Edges are one row a fold, counts a partial aggregation."""
    rows = fold_rows(panel.where(F.col(target).isNotNull()).select("ts", "symbol", F.col(target).alias("_y"), *features, *candidates), calendar).where("role = 'train'")
    parts = {"_y": bins[0], **{c: bins[1] for c in features}, **{c: bins[2] for c in candidates}}
    edges = rows.groupBy("fold").agg(*[cs.edges(c, q).alias(f"_e{i}") for i, (c, q) in enumerate(parts.items())])
    x = rows.join(F.broadcast(edges), "fold")
    code = {c: F.when(F.size(f"_e{i}") >= 3, cs.cut(c, f"_e{i}")).otherwise(-1) for i, c in enumerate(parts)}
    x = x.select("fold", code["_y"].alias("y"), F.array(*[F.struct(F.lit(c).alias("feature"), code[c].alias("x")) for c in features]).alias("f"), F.array(*[F.struct(F.lit(c).alias("candidate"), code[c].alias("g")) for c in candidates]).alias("c"))
    x = x.select("fold", "y", F.explode("f").alias("f"), "c").select("fold", "y", "f.*", F.explode("c").alias("c")).select("fold", "y", "feature", "x", "c.*")
    k = x.where("y >= 0 AND x >= 0 AND g >= 0").groupBy("fold", "candidate", "feature", "g", "x", "y").agg(F.count("*").cast("double").alias("n"))
    by = ("fold", "candidate", "feature", "g")
    tot = lambda *c: F.sum("n").over(W.partitionBy(*by, *c))
    k = k.withColumns({"_t": tot(), "_x": tot("x"), "_y": tot("y")})
    mi = k.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("n") / F.col("_t") * F.ln(F.col("n") * F.col("_t") / (F.col("_x") * F.col("_y")))).alias("mi"))
    per = mi.groupBy("fold", "candidate", "feature").agg((F.sum(F.when(F.col("n") >= least, F.col("n") * F.col("mi")).otherwise(0.0)) / F.sum("n")).alias("cmi"))
    return per.groupBy("fold", "candidate").agg(F.avg("cmi").alias("cmi"))


def tournament_walk_forward(panel: DataFrame, features: list[str], candidates: list[str], calendar: list[dict], regimes: int = 3, window: int = 60, hold: int = 3, span: int = 3, **how) -> tuple[DataFrame, list[dict]]:
    """(predictions(fold, ts, symbol, score), log): for each fold the market series
    with the highest smoothed conditional information wins. The features are made
    neutral on it over time, its quantiles on the training dates label the dates,
    and experts per label are trained on the residuals of the global model; out of
    sample the label is that of the date before, with hysteresis. The edges are
    kept while the winner stays. The log has a row a fold."""
    raw: dict[int, dict[str, float]] = {}
    for r in conditional_mi(panel, calendar, features, candidates).collect():  # folds x candidates numbers
        raw.setdefault(r["fold"], {})[r["candidate"]] = r["cmi"]
    log, last, edges = [], None, None
    out = None
    market = panel.groupBy("ts").agg(*[F.first(c, True).alias(c) for c in candidates])
    by_fold = {c["fold"]: c for c in calendar}
    for fold, winner, smooth in tournament(raw.items(), span):
        if winner != last:
            c = by_fold[fold]
            inside = market.where(F.col("ts").between(F.lit(c["train_start"]), F.lit(c["train_end"])))
            cuts = inside.agg(F.percentile(winner, F.lit([i / regimes for i in range(1, regimes)])).alias("e")).first()["e"]
            edges = cuts if cuts and all(b > a for a, b in zip(cuts, cuts[1:], strict=False)) else None
            last = winner
        log.append({"fold": fold, "winner": winner, "edges": edges, **{f"ema_cmi_{k}": v for k, v in smooth.items()}})
    for winner, edges in {(r["winner"], tuple(r["edges"] or ())) for r in log}:
        own = [by_fold[r["fold"]] for r in log if (r["winner"], tuple(r["edges"] or ())) == (winner, edges)]
        label = F.lit(regimes // 2) if not edges else sum((F.when(F.col(winner) >= e, 1).otherwise(0) for e in edges), F.lit(0))
        lab = market.select("ts", F.when(F.col(winner).isNotNull(), label).cast("string").alias("_label"))
        lab = lab.join(hysteresis(lab, "_label", hold).withColumnRenamed("state", "_state"), "ts")
        flat = {f"_n_{f}": ts.residual_on_market(f, winner, window, window // 4) for f in features}
        x = panel.join(F.broadcast(lab), "ts").withColumns(flat)
        got = walk_forward(x, list(flat), own, expert="_label", state="_state", raw=features, **how)[0]
        out = got if out is None else out.unionByName(got)
    return out, log


def shape_health(shapes: DataFrame, core: float = 0.05) -> DataFrame:
    """shapes(fold, feature, bag, bin, x, score, density) -> per (fold, feature):
    monotonicity (rank correlation of bin center and mean score, weighted by
    density), tail_core_ratio (largest |score| of bins below the core density over
    that of the others, 0 without one of them), curvature (sum of |second
    differences|), cross_bag_variance (variance between bags, summed by density),
    n_bins. Fewer than 3 bins have no monotonicity and no curvature."""
    by = ("fold", "feature")
    b = shapes.groupBy(*by, "bin").agg(F.avg("score").alias("s"), F.var_pop("score").alias("v"), F.min_by("x", "bag").alias("x"), F.min_by("density", "bag").alias("d"))
    w, every = W.partitionBy(*by).orderBy("bin"), W.partitionBy(*by)
    b = b.withColumns({"_rx": cs.rank_average("x", *by), "_rs": cs.rank_average("s", *by), "_d2": F.col("s") - 2 * F.lag("s").over(w) + F.lag("s", 2).over(w), "_sum": F.sum("d").over(every), "_n": F.count("*").over(every)})
    b = b.withColumn("_w", F.when(F.col("_sum") > 0, F.col("d") / F.col("_sum")).otherwise(1 / F.col("_n")))
    b = b.withColumns({"_mx": F.sum(F.col("_w") * F.col("_rx")).over(every), "_ms": F.sum(F.col("_w") * F.col("_rs")).over(every)})
    dx, ds = F.col("_rx") - F.col("_mx"), F.col("_rs") - F.col("_ms")
    spread = F.sqrt(F.sum(F.col("_w") * dx * dx) * F.sum(F.col("_w") * ds * ds))
    tail, inner = F.max(F.when(F.col("d") < core, F.abs("s"))), F.max(F.when(F.col("d") >= core, F.abs("s")))
    enough = F.count("*") >= 3
    return b.groupBy(*by).agg(
        F.when(enough, F.try_divide(F.sum(F.col("_w") * dx * ds), F.nullif(spread, F.lit(0.0)))).alias("monotonicity"),
        F.when((inner > 0) & tail.isNotNull(), tail / (inner + 1e-6)).otherwise(0.0).alias("tail_core_ratio"),
        F.when(enough, F.sum(F.abs("_d2"))).alias("curvature"),
        F.sum(F.col("d") * F.col("v")).alias("cross_bag_variance"),
        F.count("*").alias("n_bins"),
    )


def fold_performance(fitted: DataFrame, quantile: float = 0.2, beta: str | None = None, periods: int = 252) -> DataFrame:
    """fitted(fold, ts, symbol, score, y_raw) -> per fold the in-sample Sharpe ratio,
    total return and number of days of rank weights on both tails; with beta, the
    scores are first made neutral on it per date. Dates of fewer than 4 names, or
    without one of the sides, are left out; folds of fewer than 5 days are NULL."""
    by = ("fold", "ts")
    x = fitted.where("y_raw IS NOT NULL")
    x = x.withColumn("_p", cs.residual("score", beta, *by, active="all", min_points=3, fill_zero=False) if beta else F.col("score"))
    x = x.withColumns({"_n": F.count("*").over(W.partitionBy(*by)), "_r": cs.rank_first("_p", *by)})
    x = x.where("_n >= 4").withColumn("_side", F.when(F.col("_r") > F.col("_n") * (1 - quantile), 1).when(F.col("_r") <= F.col("_n") * quantile, -1))
    x = x.where("_side IS NOT NULL").withColumn("_s", F.when(F.col("_side") == 1, F.col("_r")).otherwise(F.col("_n") + 1 - F.col("_r")).cast("double"))
    x = x.withColumn("_w", F.col("_s") / F.sum("_s").over(W.partitionBy(*by, "_side")) * 0.5 * F.col("_side"))
    day = x.groupBy(*by).agg(F.sum(F.col("_w") * F.col("y_raw")).alias("r"), F.count_distinct("_side").alias("_k")).where("_k = 2")
    ok = F.count("*") >= 5
    return day.groupBy("fold").agg(
        F.when(ok, F.avg("r") / (F.stddev_samp("r") + 1e-12) * F.sqrt(F.lit(float(periods)))).alias("sharpe"),
        F.when(ok, F.product(1 + F.col("r")) - 1).alias("total_return"),
        F.count("*").alias("n_days"),
    )


def in_sample(pred: DataFrame, score: str = "score", target: str = "y") -> DataFrame:
    """Per fold: rank correlation and R2."""
    x = pred.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    x = x.withColumns({"_a": cs.rank_average(score, "fold"), "_b": cs.rank_average(target, "fold"), "_m": F.avg(target).over(W.partitionBy("fold"))})
    err = F.sum(F.pow(F.col(target) - F.col(score), 2))
    return x.groupBy("fold").agg(cs.correlation("_a", "_b").alias("ic"), (1 - F.try_divide(err, F.nullif(F.sum(F.pow(F.col(target) - F.col("_m"), 2)), F.lit(0.0)))).alias("r2"))


def forward_performance(weights: DataFrame, targets: DataFrame, periods: int = 252) -> DataFrame:
    """One row: total and Sharpe of sum w x y_raw per date; NULL below 5 dates."""
    day = weights.join(targets.select("ts", "symbol", "y_raw"), ["ts", "symbol"]).groupBy("ts").agg(F.coalesce(F.sum(F.col("weight") * F.col("y_raw")), F.lit(0.0)).alias("r"))
    ok = F.count("*") >= 5
    return day.agg(F.when(ok, F.sum("r")).alias("total"), F.when(ok, F.try_divide(F.avg("r"), F.nullif(F.stddev_samp("r"), F.lit(0.0))) * F.sqrt(F.lit(float(periods)))).alias("sharpe"))
