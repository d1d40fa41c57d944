"""Recursions, growing quantiles and global orders against plain loops."""

import random

import numpy as np
import pandas as pd
import pytest
from tessera.functions import ordered, scans
from tessera.ml import training as ml
from tessera.operators import factors


def series(spark, seed=0, n=900, keys="ab", gaps=0.3):
    rng = np.random.default_rng(seed)
    rows = [(k, i, None if rng.random() < gaps or 300 < i < 420 else float(rng.normal() * 10)) for k in keys for i in range(n)] + [("c", 0, None), ("d", 0, 1.5)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts long, x double"), pd.DataFrame(rows, columns=["symbol", "ts", "x"]).sort_values(["symbol", "ts"])


@pytest.mark.parametrize(("how", "adjust", "periods"), [({"halflife": 12}, True, 0), ({"halflife": 1}, True, 5), ({"alpha": 1 / 14}, False, 0), ({"alpha": 0.97}, False, 3), ({"alpha": 0.97}, True, 0)])
def test_exponential_means(spark, how, adjust, periods):
    df, pdf = series(spark)
    pdf["want"] = pdf.groupby("symbol")["x"].transform(lambda s: s.ewm(**how, adjust=adjust, min_periods=periods).mean())
    want = {(r.symbol, r.ts): None if pd.isna(r.want) else r.want for r in pdf.itertuples()}
    got = factors.ewms(df, {"x": "e"}, adjust=adjust, min_periods=periods, **how)
    assert got.columns == ["symbol", "ts", "x", "e"]
    rows = {(r["symbol"], r["ts"]): r["e"] for r in got.collect()}
    assert rows.keys() == want.keys()
    assert all(rows[k] == (None if v is None else pytest.approx(v, rel=1e-9, abs=1e-12)) for k, v in want.items())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_long_gap_keeps_the_mean(spark):
    rows = [("a", i, 5.0 if i < 3 else 7.0 if i == 40_000 else None) for i in [*range(5), *range(39_990, 40_003)]]
    rows = [("a", i, v) for i, (_, _, v) in enumerate(rows)] + [("b", i, 1.0 if i == 0 else None) for i in range(9000)]
    pdf = pd.DataFrame(rows, columns=["symbol", "ts", "x"])
    for adjust in (True, False):
        want = pdf.groupby("symbol")["x"].transform(lambda s, adjust=adjust: s.ewm(halflife=1, adjust=adjust).mean()).tolist()
        got = [r["e"] for r in factors.ewms(spark.createDataFrame(rows, "symbol string, ts long, x double"), {"x": "e"}, halflife=1, adjust=adjust).orderBy("symbol", "ts").collect()]
        assert got == pytest.approx(want)


def loop(labels, k):
    out, now, want, n = [], None, None, 0
    for label in [None, *labels[:-1]]:
        if label is not None:
            if now is None or label == now:
                now, want, n = label, None, 0
            else:
                want, n = label, n + 1 if label == want else 1
                if n >= k:
                    now, want, n = label, None, 0
        out.append(now)
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_held(spark, k):
    rng = random.Random(k)
    labels = [rng.choice("xxyz") if rng.random() < 0.8 else None for _ in range(30)] + [x for _ in range(40) for x in [rng.choice(["x", "y", None])] * rng.randrange(1, 7)]
    got = [r["state"] for r in ml.hysteresis(spark.createDataFrame(list(enumerate(labels)), "ts long, l string"), "l", k).orderBy("ts").collect()]
    assert got == loop(labels, k)


@pytest.mark.parametrize("n", [1, 15, 700])
def test_expanding_quantiles(spark, n):
    df, pdf = series(spark, n, n)
    df = df.selectExpr("symbol", "ts", "round(x) AS x")  # ties
    probs = {"lo": 0.25, "mid": 0.5, "hi": 0.9, "most": 1.0}
    got = {(r["symbol"], r["ts"]): r for r in scans.expanding_quantiles(df, "x", probs, 5, ["symbol"]).collect()}
    want = 0
    for key, own in pd.DataFrame([tuple(r) for r in df.collect()], columns=["symbol", "ts", "x"]).sort_values("ts").groupby("symbol"):
        x = own["x"].to_numpy(float)
        for i, t in enumerate(own["ts"]):
            before = x[:i][~np.isnan(x[:i])]
            if len(before) >= 5:
                want += 1
                assert [got[key, t][p] for p in probs] == pytest.approx(np.quantile(before, list(probs.values())).tolist())
    assert len(got) == want


@pytest.fixture
def many_parts(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_global_orders(spark, many_parts):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaab"), i, rng.random() if rng.random() < 0.2 else None, rng.randrange(5)) for i in range(2000)]
    df = spark.createDataFrame(rng.sample(rows, 2000), "k string, t long, v double, w long")
    pdf = pd.DataFrame(rows, columns=list("ktvw"))
    for keys in (["k"], []):
        want = (pdf.groupby("k")["v"] if keys else pdf["v"]).ffill()
        got = {r["t"]: r["v"] for r in ordered.last_known(df, keys, ["t"], ["v"]).collect()}
        assert got == {t: None if pd.isna(v) else v for t, v in zip(pdf["t"], want, strict=True)}
    assert all(r["position"] == r["t"] + 1 for r in ordered.numbered(df, ["t"]).collect())
    assert {r["t"]: r["s"] for r in ordered.running_sums(df, ["t"], {"w": "s"}).collect()} == dict(zip(pdf["t"], pdf["w"].cumsum(), strict=True))
    none = df.limit(0)
    assert ordered.numbered(none, ["t"]).count() == ordered.last_known(none, ["k"], ["t"], ["v"]).count() == ordered.running_sums(none, ["t"], {"w": "s"}).count() == 0


def test_smoothing_leaves_flat_dates_aside(spark):
    """Dates set aside keep their weights and the mean; memory is one date."""
    import datetime as dt

    from tessera.operators import weights

    day = dt.datetime(2024, 1, 1)
    rng = np.random.default_rng(2)
    raw = {(s, i): dict(zip("ABC", rng.normal(size=3).round(2), strict=True)) for s in "xy" for i in range(12)}
    aside = {("x", 3), ("x", 4), ("y", 0)}
    rows = [(s, day + dt.timedelta(days=i), k, float(v)) for (s, i), row in raw.items() for k, v in row.items() if not (k == "C" and i < 5)]
    df = spark.createDataFrame(rows, "strategy string, ts timestamp, symbol string, weight double")
    off = spark.createDataFrame([(s, day + dt.timedelta(days=i)) for s, i in aside], "strategy string, ts timestamp")
    got = {(r["strategy"], (r["ts"] - day).days, r["symbol"]): r["weight"] for r in weights.smoothed(df, 0.4, 5.0, off).collect()}
    for s in "xy":
        prev = None
        for i in range(12):
            x = np.array([0.0 if k == "C" and i < 5 else raw[s, i][k] for k in "ABC"])
            if (s, i) not in aside:
                if prev is not None:
                    x = 0.4 * x + 0.6 * prev
                    gross = np.abs(x).sum()
                    x = x * 5.0 / gross if 1e-8 < gross < 5.0 else x
                prev = x
            assert [got[s, i, k] for k in "ABC"] == pytest.approx(x.tolist())


def test_simplex_by_active_sets():
    """60 strategies: no direction gains; few: the best of all supports."""
    from itertools import combinations

    from tessera.operators import portfolio

    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 8, 60):
        for _ in range(5 if n < 60 else 3):
            x = rng.normal(size=(40, n)) * 0.02
            mu, cov = x.mean(axis=0) * rng.choice([0.1, 1, 10]), portfolio.shrunk(np.cov(x, rowvar=False).reshape(n, n))
            got = portfolio.simplex_mean_variance(mu, cov, 3.0)
            assert (got >= 0).all() and got.sum() == pytest.approx(1)
            slope = mu - 6 * cov @ got
            assert (slope <= slope[got > 1e-9].min() + 1e-9).all()
            if n <= 8:
                best = -np.inf
                for k in range(1, n + 1):
                    for idx in map(list, combinations(range(n), k)):
                        m = np.ones((k + 1, k + 1))
                        m[:k, :k], m[k, k] = 6 * cov[np.ix_(idx, idx)], 0
                        w = np.linalg.solve(m, np.append(mu[idx], 1))[:k]
                        if (w >= 0).all():
                            best = max(best, mu[idx] @ w - 3 * w @ cov[np.ix_(idx, idx)] @ w)
                assert mu @ got - 3 * got @ cov @ got == pytest.approx(best, abs=1e-10)
    assert portfolio.simplex_mean_variance(np.array([np.nan, 1.0]), np.eye(2)).tolist() == [0.5, 0.5]


def test_gram_by_blocks(spark):
    """Blocks and slabs smaller than the matrix; missing cells count for neither side."""
    from tessera.operators.gram import gram

    rng = np.random.default_rng(6)
    x = rng.normal(size=(37, 11)).round(3)
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 10] = np.nan
    x[0, 10] = 2.0
    cells = [(r, f"c{c}", float(x[r, c])) for r in range(37) for c in range(11) if not np.isnan(x[r, c])] + [(None, "c1", 1.0), (3, None, 1.0), (99, "c1", None)]
    got = {(r["a"], r["b"]): (r["n"], r["sa"], r["sb"], r["sab"]) for r in gram(spark.createDataFrame(cells, "r long, c string, v double"), "r", "c", "v", block=4, slab=10).collect()}
    want = {}
    for i in range(11):
        for j in range(11):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if both.any():
                a, b = x[both, i], x[both, j]
                want[f"c{i}", f"c{j}"] = (int(both.sum()), a.sum(), b.sum(), (a * b).sum())
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    assert gram(spark.createDataFrame([], "r long, c string, v double"), "r", "c", "v").count() == 0


def test_asof_spread_over_pieces(spark, many_parts):
    """The same rows whether a key is one task or many."""
    from tessera.operators import joins

    rng = random.Random(2)
    left = spark.createDataFrame([(rng.choice("aaaab"), rng.randrange(300), i) for i in range(500)] + [("z", 5, -1), ("a", None, -2)], "symbol string, ts long, n int")
    right = spark.createDataFrame([(rng.choice("aab"), rng.randrange(20, 300), rng.randrange(9), None if i % 5 else "x") for i in range(200)] + [("a", None, 1, "y")], "symbol string, ts long, v int, w string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(joins.asof_join(left, right, spread=True)) == rows(joins.asof_join(left, right, spread=False))
    market = right.groupBy("ts").agg({"v": "max"}).withColumnRenamed("max(v)", "v")
    assert rows(joins.asof_join(left, market, by=None)) == rows(joins.asof_join(left, market, by=None, spread=False))
