"""Training by mergeable histograms against the same models fitted on one machine."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tessera.ml import histograms as H
from tessera.ml import training as ml

from .brute_training import Booster, Ensemble

DAY = dt.datetime(2024, 1, 1)
DATES = [DAY + dt.timedelta(days=i) for i in range(120)]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    rows = [(d, s, *map(float, rng.normal(size=3)), "xyz"[i // 5 % 3]) for i, d in enumerate(DATES) for s in "ABCDEF"]
    pdf = pd.DataFrame(rows, columns=["ts", "symbol", "a", "b", "c", "label"])
    pdf["b"] = pdf["b"].round(1)  # ties
    pdf["c"] = np.where(pdf["c"] > 0, 1.0, 0.0)  # few bins
    pdf["y"] = pdf["a"] * pdf["b"] + np.where(pdf["label"] == "x", pdf["a"], -pdf["b"]) + rng.normal(size=len(pdf)) / 5
    pdf.loc[pdf.index % 17 == 0, "a"] = np.nan
    pdf.loc[pdf.index % 23 == 0, "y"] = np.nan
    pdf.loc[pdf["ts"] >= DATES[-2], "y"] = np.nan
    pdf.loc[pdf.index % 31 == 0, "label"] = None
    return pdf


@pytest.fixture(scope="module")
def panel(spark, frame):
    rows = [tuple(None if x != x or x is pd.NaT else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in r) for r in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, "ts timestamp, symbol string, a double, b double, c double, label string, y double")
    return df.withColumn("state", F.col("label"))


FEATURES = ["a", "b", "c"]


def local(frame, fold, bags, pairs, expert, edges=None, given=None, kept=None):
    """(scores, fitted, importance) of one fold, all of its history at once."""
    train = frame[(frame["ts"] >= fold["train_start"]) & (frame["ts"] <= fold["train_end"]) & frame["y"].notna()].sort_values(["ts", "symbol"])
    ahead = frame[(frame["ts"] >= fold["predict_start"]) & (frame["ts"] <= fold["predict_end"])].sort_values(["ts", "symbol"])
    x, xa, y = train[FEATURES].fillna(0.0).to_numpy(), ahead[FEATURES].fillna(0.0).to_numpy(), train["y"].to_numpy()
    model = Ensemble(bags, pairs)
    if given is not None:
        model.given = given(train["ts"].nunique())
    if kept is not None:
        model.rows = np.array([train["symbol"].isin(kept[b]).to_numpy() for b in range(bags)])
    model.fit(x, y, train["ts"].to_numpy())
    if edges is not None:
        model.bags = [Booster().fit(x, y, None, edges)]
    fitted, score = model.predict(x), model.predict(xa)
    if expert:
        res = y - fitted
        for label in sorted(train["label"].dropna().unique()):
            own, to = (train["label"] == label).to_numpy(), (ahead["label"] == label).to_numpy()
            if own.sum() >= 30:
                special = Booster(rounds=30).fit(x[own], res[own])
                fitted[own] += 0.5 * special.predict(x[own])
                score[to] += 0.5 * special.predict(xa[to])
    keys = lambda df: list(zip(df["ts"], df["symbol"], strict=True))
    return dict(zip(keys(ahead), score, strict=True)), dict(zip(keys(train), fitted, strict=True)), dict(model.importance(x, FEATURES)), model, x


@pytest.mark.parametrize(("bags", "pairs", "expert", "window", "share"), [(1, 0, False, 0, 1), (3, 2, False, 0, 1), (2, 0, False, 0, 0.6), (1, 1, True, 40, 1)])
def test_equal_to_local_models(spark, panel, frame, bags, pairs, expert, window, share):
    calendar = ml.folds(DATES, DATES[60], every=25, window=window)
    found = ml.trained(panel, FEATURES, calendar, expert="label" if expert else None, state="state", bags=bags, pairs=pairs, symbol_share=share).collect()
    kept = {b: [r["symbol"] for r in ml.kept_symbols(panel, share, bags).where(f"bag = {b}").collect()] for b in range(bags)} if share < 1 else None
    assert kept is None or {len(k) for k in kept.values()} == {3}
    for fold in calendar:
        score, fitted, importance, model, x = local(frame, fold, bags, pairs, expert, given=lambda n: ml.block_counts(spark, {0: n}, bags=bags)[0], kept=kept)
        own = [r for r in found if r["fold"] == fold["fold"]]
        got = {(r["ts"], r["symbol"]): r["value"] for r in own if r["kind"] == "score"}
        assert got.keys() == score.keys()
        assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in score.items())
        got = {(r["ts"], r["symbol"]): r["value"] for r in own if r["kind"] == "fitted"}
        assert got.keys() == fitted.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in fitted.items())
        assert {r["term"]: r["value"] for r in own if r["kind"] == "importance"} == pytest.approx(importance, abs=1e-9)
        want = [(f, bag, k, *v) for bag, m in enumerate(model.bags) for f, s in zip(FEATURES, m.shapes(x), strict=True) for k, v in enumerate(zip(s[0], s[2], s[1], strict=True))]
        shapes = sorted((r["term"], r["bag"], r["bin"], r["x"], r["density"], r["value"]) for r in own if r["kind"] == "shape")
        assert [s[:3] for s in shapes] == [w[:3] for w in sorted(want)]
        assert np.allclose([s[3:] for s in shapes], [w[3:] for w in sorted(want)], atol=1e-9)


def test_shared_edges(panel, frame):
    """Folds that share edges: rows are counted once, by segments."""
    calendar = ml.folds(DATES, DATES[60], every=25)
    got = {(r["fold"], r["ts"], r["symbol"]): r["value"] for r in ml.trained(panel, FEATURES, calendar, rebin=0).where("kind = 'score'").collect()}
    first = frame[(frame["ts"] <= calendar[0]["train_end"]) & frame["y"].notna()][FEATURES].fillna(0.0).to_numpy()
    edges = [np.unique(np.quantile(first[:, j], np.linspace(0, 1, 17)[1:-1])) for j in range(3)]
    want = {(f["fold"], *k): v for f in calendar for k, v in local(frame, f, 1, 0, False, edges)[0].items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_experts_on_other_columns(panel, frame):
    """Experts that read raw columns, on the residuals of a model of other ones."""
    x = panel.withColumn("d", F.coalesce("a", F.lit(0.0)) * 2 - F.coalesce("b", F.lit(0.0)))
    calendar = ml.folds(DATES, DATES[60], every=40)
    got = {(r["fold"], r["ts"], r["symbol"]): r["value"] for r in ml.trained(x, ["d"], calendar, expert="label", raw=["a", "c"]).where("kind = 'score'").collect()}
    pdf = frame.assign(d=frame["a"].fillna(0) * 2 - frame["b"].fillna(0))
    for f in calendar:
        train = pdf[(pdf["ts"] >= f["train_start"]) & (pdf["ts"] <= f["train_end"]) & pdf["y"].notna()]
        ahead = pdf[(pdf["ts"] >= f["predict_start"]) & (pdf["ts"] <= f["predict_end"])]
        of = lambda df, cols: df[cols].fillna(0.0).to_numpy()
        y = train["y"].to_numpy()
        model = Booster().fit(of(train, ["d"]), y)
        score, left = model.predict(of(ahead, ["d"])), y - model.predict(of(train, ["d"]))
        for label in "xyz":
            own, to = (train["label"] == label).to_numpy(), (ahead["label"] == label).to_numpy()
            score[to] += 0.5 * Booster(rounds=30).fit(of(train, ["a", "c"])[own], left[own]).predict(of(ahead, ["a", "c"])[to])
        assert all(got[f["fold"], t, s] == pytest.approx(v, abs=1e-9) for t, s, v in zip(ahead["ts"], ahead["symbol"], score, strict=True))


def test_bag_table(spark, panel):
    """Counts, validation tail and left-out symbols of every row and bag."""
    got = {(r["bag"], r["ts"], r["symbol"]): r["n"] for r in ml.bag_table(panel, 3, 10, 0.1, 0.5).collect()}
    other = {(r["bag"], r["ts"], r["symbol"]): r["n"] for r in ml.bag_table(panel, 3, 10, 0.1, 0.5, True).collect()}
    assert len(got) == len(other) == 3 * len(DATES) * 6
    counts = ml.block_counts(spark, {0: 108}, 10, 3)[0]
    table = {(r["bag"], r["ts"]): r["n"] for r in ml.bootstrap_counts(panel.where(F.col("ts") < DATES[108]), 10, 3).collect()}
    for b in range(3):
        kept = {r["symbol"] for r in ml.kept_symbols(panel, 0.5, 3).where(f"bag = {b}").collect()}
        assert len(kept) == 3
        for i, d in enumerate(DATES):
            assert i >= 108 or table.get((b, d), 0) == counts[b][i]
            for s in "ABCDEF":
                assert got[b, d, s] == (-1 if i >= 108 else counts[b][i] if s in kept else 0)
                assert other[b, d, s] == (-1 if i >= 108 or s not in kept else counts[b][i])


def test_segments():
    ranges, held = H.segments({0: (0, 9), 1: (0, 19), 2: (5, 29)})
    assert ranges == [(0, 4), (5, 9), (10, 19), (20, 29)]
    assert held == {0: [0, 1], 1: [0, 1, 2], 2: [1, 2, 3]}


def test_edges(panel, spark):
    """Too few rows, no rows, no target: no model and no crash."""
    calendar = ml.folds(DATES, DATES[60], every=25)
    assert ml.trained(panel, FEATURES, calendar, least=10_000).count() == 0
    assert ml.trained(panel.limit(0), FEATURES, calendar).count() == 0
    assert ml.trained(panel.withColumn("y", F.lit(None).cast("double")), FEATURES, calendar, expert="label").count() == 0


def test_mixture_keeps_rows_without_expert(spark):
    g = spark.createDataFrame([(DAY, "A", 1.0), (DAY, "B", 2.0)], "ts timestamp, symbol string, score double")
    e = spark.createDataFrame([(DAY, "B", 4.0), (DAY, "C", 9.0)], "ts timestamp, symbol string, score double")
    assert sorted((r["symbol"], r["score"]) for r in ml.mixture(g, e, 0.25).collect()) == [("A", 1.0), ("B", 3.0)]
