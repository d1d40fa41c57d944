"""Panel operators on small hand-made frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tessera.functions import cs, ts
from tessera.ml import training as ml
from tessera.operators import backtest, calendar, factors, joins, portfolio, reports, weights
from tessera.sources import market_api, storage
from tessera.streaming import market

from .brute_training import Booster

DAY = dt.datetime(2024, 1, 1)


def frame(spark, values, name="x"):
    rows = [(DAY + dt.timedelta(days=i), s, None if v is None else float(v)) for s, seq in values.items() for i, v in enumerate(seq)]
    return spark.createDataFrame(rows, f"ts timestamp, symbol string, {name} double")


def column(df, name, symbol="A"):
    return [r[name] for r in df.where(F.col("symbol") == symbol).orderBy("ts").collect()]


def test_windows_against_pandas(spark):
    x = [1.0, 2.0, None, 4.0, 8.0, None, None, 7.0, 9.0, 3.0]
    df = frame(spark, {"A": x})
    s = pd.Series(x, dtype=float)
    got = df.withColumns({"m": ts.mean("x", 3, 2), "s": ts.std("x", 4, 2), "k": ts.skew("x", 6, 3), "p": ts.pct_change("x"), "pp": ts.pct_change("x", pad_gaps=True), "f": ts.ffill("x", 1)})
    want = {"m": s.rolling(3, min_periods=2).mean(), "s": s.rolling(4, min_periods=2).std(), "k": s.rolling(6, min_periods=3).skew(), "p": s.pct_change(fill_method=None), "pp": s.ffill().pct_change(), "f": s.ffill(limit=1)}
    for name, w in want.items():
        assert pd.Series(column(got, name), dtype=float).to_numpy() == pytest.approx(w.to_numpy(), nan_ok=True), name


def test_ewm_against_pandas(spark):
    x = [1.0, None, 3.0, 2.0, None, 5.0]
    got = factors.ewm(frame(spark, {"A": x, "B": x[::-1]}), "x", "e", halflife=2)
    assert pd.Series(column(got, "e"), dtype=float).to_numpy() == pytest.approx(pd.Series(x, dtype=float).ewm(halflife=2).mean().to_numpy(), nan_ok=True)


def test_ranks_and_residual(spark):
    df = spark.createDataFrame([(DAY, s, y, x) for s, y, x in [("A", 1.0, 1.0), ("B", 1.0, 2.0), ("C", 4.0, 3.0), ("D", None, 4.0), ("E", 0.0, 5.0)]], "ts timestamp, symbol string, y double, x double")
    r = {q["symbol"]: q for q in df.withColumns({"p": cs.rank_pct("y"), "f": cs.rank_first("y"), "e": cs.residual("y", "x")}).collect()}
    assert [r[s]["p"] for s in "ABCDE"] == [0.625, 0.625, 1.0, None, 0.25]
    assert [r[s]["f"] for s in "ABCDE"] == [2, 3, 4, None, 1]
    assert sum(r[s]["e"] for s in "ABC") == pytest.approx(0) and r["D"]["e"] == 0 and r["E"]["e"] == 0


def test_no_look_ahead(spark):
    rng = np.random.default_rng(0)
    seq = {s: list(100 + rng.normal(size=90).cumsum()) for s in "ABCD"}
    full = frame(spark, seq, "close").withColumn("ret", ts.pct_change("close"))
    cut = frame(spark, {s: v[:70] for s, v in seq.items()}, "close").withColumn("ret", ts.pct_change("close"))
    make = lambda df: df.withColumns({"z": ts.zscore("ret", 20), "q": ts.quantile_before("ret", 0.25), "d": ts.delta("close")})
    for c in "zqd":
        assert column(make(full), c)[:70] == column(make(cut), c)


def test_asof_join(spark):
    left = frame(spark, {"A": [1.0, 2.0, 3.0]}, "l")
    right = spark.createDataFrame([(DAY + dt.timedelta(days=1), "A", 5.0), (DAY + dt.timedelta(days=1), "A", 6.0), (None, "A", 9.0)], "ts timestamp, symbol string, r double")
    assert column(joins.asof_join(left, right), "r") == [None, 6.0, 6.0]


def test_masks_and_epochs(spark):
    df = frame(spark, {"A": [0.0, 0.0, 1.0, 1.0, 1.0]}, "ret").withColumn("v", F.lit(1.0))
    assert column(calendar.launch_mask(df, ["v"], k=2), "v") == [None, None, None, 1.0, 1.0]
    assert column(calendar.launch_mask(df, ["v"], k=2, after_death=True), "v") == [1.0, 1.0, 1.0, 1.0, None]
    sets = calendar.active_sets(frame(spark, {"A": [1.0] * 4, "B": [1.0] * 2})).orderBy("start").collect()
    assert [r["symbols"] for r in sets] == [["A", "B"], ["A"]] and sets[0]["end"] == dt.date(2024, 1, 2)
    with pytest.raises(ValueError, match="nope"):
        calendar.require(df, "nope")


def test_weights_are_balanced(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, {f"S{i:02d}": list(rng.normal(size=5)) for i in range(20)}, "score")
    for mode in ("rank", "zscore", "raw", "equal"):
        day = weights.predictions_to_weights(df, 0.3, mode, 1.0).groupBy("ts").agg(F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross")).collect()
        assert all(abs(r["net"]) < 1e-9 and r["gross"] == pytest.approx(1) for r in day)
    capped = weights.balanced(df, cap=0.08, value="score").groupBy("ts").agg(F.sum("weight").alias("net"), F.max(F.abs("weight")).alias("top")).collect()
    assert all(abs(r["net"]) < 1e-9 and r["top"] <= 0.08 + 1e-9 for r in capped)
    one_side = weights.balanced(frame(spark, {"A": [1.0], "B": [2.0]}, "score"), value="score")
    assert {r["weight"] for r in one_side.collect()} == {0.0}


def test_optimiser():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 12)) * 0.02
    cov = portfolio.shrunk(np.cov(x, rowvar=False), "ledoit_wolf", returns=x)
    a = rng.normal(size=12) * 0.01
    w = portfolio.mean_variance(a, cov, 1.0, 1.0, 0.2)
    assert abs(w.sum()) < 1e-3 and np.abs(w).sum() <= 1 + 1e-6 and np.abs(w).max() <= 0.2 + 1e-6 and a @ w > 0
    s = portfolio.simplex_mean_variance(np.array([0.02, 0.01, -0.05]), np.eye(3) * 1e-3, 1.0)
    assert s.sum() == pytest.approx(1) and (s >= 0).all() and s[0] >= s[1] >= s[2]


def test_ledger():
    book = backtest.Ledger(1000.0, 0.0, 0.0)
    book.trade("A", 2.0, 100.0)
    book.trade("A", 2.0, 110.0)
    assert book.pos["A"][1] == pytest.approx(105)
    fill = book.trade("A", -3.0, 120.0)
    assert fill["pnl"] == pytest.approx(45) and book.cash == pytest.approx(1045)
    book.trade("A", -1.0, 120.0)
    assert book.pos["A"][0] == 0 and book.cash == pytest.approx(1060)
    short = backtest.Ledger(1000.0, 0.0, 10.0)
    assert short.trade("B", -1.0, 100.0)["price"] == pytest.approx(100 / 1.001)


def test_probabilistic_sharpe(spark):
    df = spark.createDataFrame([(float(x),) for x in np.random.default_rng(3).normal(0.01, 0.02, 200)], "r double")
    assert 0.99 < backtest.probabilistic_sharpe(df, "r", 0.0) <= 1
    assert backtest.probabilistic_sharpe(df.limit(2), "r") is None


def test_hysteresis_and_tournament(spark):
    rows = [(DAY + dt.timedelta(days=i), s) for i, s in enumerate("AAABABBBBA")]
    got = [r["state"] for r in ml.hysteresis(spark.createDataFrame(rows, "ts timestamp, l string"), "l", 3).orderBy("ts").collect()]
    assert got == [None, "A", "A", "A", "A", "A", "A", "A", "B", "B"]
    won = ml.tournament([(0, {"a": 1.0, "b": 0.5}), (1, {"b": 3.0})], span=3)
    assert [w for _, w, _ in won] == ["a", "b"] and won[1][2] == {"a": 0.5, "b": 1.75}


def test_folds_leave_a_gap():
    f = ml.folds(list(range(100)), 50, every=20, horizon=5)
    assert [(x["train_end"], x["predict_start"], x["predict_end"]) for x in f] == [(44, 50, 69), (64, 70, 89), (84, 90, 99)]


def test_booster_learns():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 3))
    y = np.where(x[:, 0] > 0, 1.0, -1.0) + 0.1 * rng.normal(size=800)
    m = Booster().fit(x[:600], y[:600])
    assert np.corrcoef(m.predict(x[600:]), y[600:])[0, 1] > 0.95 and m.importance(x).argmax() == 0


def test_spearman(spark):
    df = frame(spark, {s: [v] for s, v in zip("ABCDE", (1.0, 2.0, 3.0, 4.0, 5.0), strict=True)}).withColumn("y", -F.col("x"))
    assert reports.information_coefficient(df, "x", "y").first()["ic"] == pytest.approx(-1)


def fetch(symbol, start, end, limit):
    day = market_api.INTERVAL_MS["1d"]
    first = -(-start // day) * day
    return [(t, 1.0, 2.0, 0.5, "bad" if t == 0 else 1.5, 10.0) for t in range(first, end + 1, day)][:limit]


def fetch_with_gap(symbol, start, end, limit):
    if start == 4 * market_api.INTERVAL_MS["1d"]:
        raise market_api.BadRange
    return fetch(symbol, start, end, limit)


def test_market_kinds(spark):
    """Spot, open interest, funding and ratios come with their own columns."""
    day = market_api.INTERVAL_MS["1d"]
    for kind, columns in market_api.KINDS.items():
        df = market_api.history(spark, kind, fetch="tests.test_panel:fetch", symbols="A", start=str(day), end=str(3 * day), limit="2", pages="1")
        rows = df.orderBy("ts").collect()
        assert df.columns == ["symbol", "ts", *columns] and len(rows) == 3
        assert [rows[0][c] for c in columns] == [1.0, 2.0, 0.5, 1.5, 10.0][: len(columns)]


def test_bar_stream(spark, tmp_path):
    """Polls go on after the last bar of each symbol; none comes twice."""
    import time

    day = market_api.INTERVAL_MS["1d"]
    bars = market_api.bar_stream(spark, fetch="tests.test_panel:fetch", symbols="A,B", start="0", end=str(5 * day), limit="2")
    q = bars.writeStream.format("memory").queryName("bar_stream").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="0 seconds").start()
    for _ in range(60):
        if spark.table("bar_stream").count() >= 10:
            break
        time.sleep(1)
    q.stop()
    rows = spark.table("bar_stream").collect()
    assert len(rows) == len({(r["symbol"], r["ts"]) for r in rows}) == 10 and {r["close"] for r in rows} == {None, 1.5}


def test_market_history(spark):
    day = market_api.INTERVAL_MS["1d"]
    rows = list(market_api.pages(fetch, "A", 0, 9 * day, 4, day))
    assert [r[0] for r in rows] == [i * day for i in range(10)]
    calls = []

    def limited():
        calls.append(1)
        raise market_api.RateLimited

    with pytest.raises(market_api.RateLimited):
        market_api.with_retry(limited, sleep=lambda _: None)
    assert len(calls) == 3
    gaps = list(market_api.pages(lambda s, a, e, n: fetch_with_gap(s, a, e, n), "A", 0, 11 * day, 4, day))
    assert [r[0] // day for r in gaps] == [0, 1, 2, 3, 8, 9, 10, 11]  # one bad range loses only itself
    df = market_api.history(spark, "futures", fetch="tests.test_panel:fetch", symbols="A,B", start="0", end=str(9 * day), limit="4", pages="1")
    assert df.count() == 20 and df.where("close IS NULL").count() == 2


def test_storage(spark, tmp_path):
    bars = frame(spark, {"A": [1.0, 2.0], "B": [3.0, 4.0]}, "close")
    storage.save_bars(bars, f"{tmp_path}/bars")
    assert storage.load_bars(spark, f"{tmp_path}/bars").count() == 4
    assert storage.load_bars(spark, f"{tmp_path}/none").count() == 0
    epochs = spark.createDataFrame([(dt.date(2023, 10, 1), dt.date(2024, 1, 1), dt.date(2024, 3, 31), "A")], "snapshot_date date, epoch_start date, epoch_end date, symbol string")
    storage.save_panel(bars, f"{tmp_path}/panel", epochs)
    assert storage.load_panel(spark, f"{tmp_path}/panel", "2023-10-01").count() == 2
    assert storage.epoch_for(spark, f"{tmp_path}/panel", "2024-02-02")["n_symbols"] == 1
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "A_metrics_1.csv").write_text("ts,open_interest\n2024-01-01 00:00:00,5\n1704067200000,6\nx,7\n")
    got = storage.load_metrics(spark, f"{tmp_path}/m").collect()
    assert {(r["symbol"], r["ls_ratio"]) for r in got} == {("A", 1.0)} and len(got) == 2
    assert storage.load_config("a: 1\nb:\n  c: x\n") == {"a": 1, "b": {"c": "x"}}


def test_streaming_bars(spark, tmp_path):
    rows = [(i, DAY + dt.timedelta(minutes=7 * i), "A", float(i)) for i in range(20)]
    ticks = spark.createDataFrame(rows, "event_id long, ts timestamp, symbol string, value double")
    ticks.write.parquet(f"{tmp_path}/ticks")
    stream = market.replay(spark, f"{tmp_path}/ticks", ticks.schema)
    q = market.ohlcv(stream).writeStream.outputMode("complete").format("memory").queryName("bars_out").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: r["ts"]
    assert sorted(spark.table("bars_out").collect(), key=key) == sorted(market.ohlcv(ticks).collect(), key=key)
    text = ['{"s":"A","k":{"t":0,"o":"1","h":"2","l":"1","c":"2","v":"3","x":true}}', '{"s":"A","k":{"t":0,"x":false}}', "junk"]
    assert [r["close"] for r in market.closed_bars(spark.createDataFrame([(t,) for t in text], "value string")).collect()] == [2.0]


def test_streaming_orders(spark, tmp_path):
    bars = frame(spark, {"A": [10.0, 11.0, 12.0]}, "close")
    bars.write.parquet(f"{tmp_path}/bars")
    out = market.orders(market.replay(spark, f"{tmp_path}/bars", bars.schema), lambda c: 0.2)
    q = out.writeStream.outputMode("append").format("memory").queryName("orders_out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("orders_out").count() == 3


def test_entry_without_training_data_operators():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and "factor_panel" in names


def test_stores(spark, tmp_path):
    """Names, open-interest files, merged stores, weights and tables."""
    assert storage.bar_name("A", "1d") == "A_1d.parquet"
    (tmp_path / "oi").mkdir()
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        (tmp_path / "oi" / f"A-metrics-{day}.csv").write_text(f"create_time,sum_open_interest\n{day} 00:00:00,5\n{day} 00:00:00,7\n{day} 01:00:00,x\n")
    oi = storage.load_open_interest(spark, f"{tmp_path}/oi", "2024-01-02", "2024-01-02").orderBy("ts").collect()
    assert [r["open_interest"] for r in oi] == [5.0, None]
    assert [r["symbol"] for r in storage.discover_symbols(spark, f"{tmp_path}/oi").collect()] == ["A"]
    old, new = frame(spark, {"A": [1.0, 2.0, None]}, "v"), frame(spark, {"A": [None, 5.0]}, "v")
    got = storage.merge_metrics(old, new.where("v IS NOT NULL"), "2024-01-01", "2024-01-02", "v")
    assert column(got, "v") == [1.0, 5.0]
    w = frame(spark, {"A": [0.1, 0.2], "B": [0.3, None]}, "weight")
    storage.save_weights(w, w.where("symbol = 'A'"), f"{tmp_path}/w", "one")
    storage.save_weights(w, w, f"{tmp_path}/w", "two")
    assert storage.load_weights(spark, f"{tmp_path}/w", without=("two",)).count() == 2
    assert storage.load_weights(spark, f"{tmp_path}/w", "unmasked").count() == 8
    (tmp_path / "s").mkdir()
    for name, df in {"mom": w, "rev": w.where("symbol = 'B'"), "optimized_weights_x": w, "ebm_predictions": w}.items():
        calendar.to_wide(df, "weight", ["A", "B"]).toPandas().to_parquet(f"{tmp_path}/s/{name}.parquet", coerce_timestamps="us", index=False)
    found = storage.discover_weights(spark, f"{tmp_path}/s")
    assert {r["strategy"] for r in found.collect()} == {"mom", "rev"} and found.count() == 8 and found.where("weight = 0").count() == 4
    with pytest.raises(ValueError):
        storage.discover_weights(spark, f"{tmp_path}/s", ["none"])
    storage.save_table(w, f"{tmp_path}/t")
    storage.save_table(w, f"{tmp_path}/c", as_csv=True)
    assert sorted(storage.load_table(spark, f"{tmp_path}/t").collect(), key=str) == sorted(storage.load_table(spark, f"{tmp_path}/c", "ts timestamp, symbol string, weight double").collect(), key=str)


def panel_of(spark, seed=5, days=160, symbols="ABCDEFGH"):
    rng = np.random.default_rng(seed)
    rows = [(DAY + dt.timedelta(days=i), s, *map(float, rng.normal(size=2)), float(i % 7)) for i in range(days) for s in symbols]
    df = spark.createDataFrame(rows, "ts timestamp, symbol string, a double, b double, m double")
    return df.withColumns({"y_raw": F.col("a") * F.when(F.col("m") > 3, 1.0).otherwise(-1.0) * 0.01}).withColumn("y", F.col("y_raw"))


DATES = [DAY + dt.timedelta(days=i) for i in range(160)]


def test_training_models(spark, tmp_path):
    """Shapes, bags, pairs and experts; saved models; an epoch's own symbols."""
    x = panel_of(spark)
    c = ml.folds(DATES, DATES[100], every=30)
    found = ml.trained(x, ["a", "b"], c, bags=3, pairs=1).cache()
    assert {r["bag"] for r in ml.shape_table(found).select("bag").distinct().collect()} == {0, 1, 2}
    assert {r["term"] for r in found.where("kind = 'importance'").collect()} == {"a", "b", "a & b"}
    storage.save_models(found, f"{tmp_path}/m")
    assert {r["fold"] for r in storage.load_models(spark, f"{tmp_path}/m", 1).select("fold").distinct().collect()} == {0}
    by = x.withColumn("r", F.when(F.col("m") > 3, "up").otherwise("down"))
    corr = lambda df: df.join(x, ["ts", "symbol"]).agg(F.corr("score", "y")).first()[0]
    assert corr(ml.walk_forward(by, ["a", "b"], c, expert="r", share=1.0)[0]) > 0.8 > abs(corr(ml.walk_forward(by, ["a", "b"], c)[0])) + 0.4
    one = [(dt.date(2024, 1, 1), dt.date(2024, 4, 1), dt.date(2024, 5, 5), s) for s in "AB"]
    epochs = spark.createDataFrame(one + [(dt.date(2024, 4, 1), dt.date(2024, 5, 6), dt.date(2024, 6, 30), s) for s in "BCD"], "snapshot_date date, epoch_start date, epoch_end date, symbol string")
    got = ml.per_epoch(x, epochs, ["a", "b"], c, least=10).collect()
    assert {(r["epoch"], r["symbol"]) for r in got} == {("2024-01-01", "A"), ("2024-01-01", "B"), *(("2024-04-01", s) for s in "BCD")}
    assert all((r["ts"].date() <= dt.date(2024, 5, 5)) == (r["epoch"] == "2024-01-01") for r in got) and len(got) == len({(r["ts"], r["symbol"]) for r in got})


def test_tournament_training(spark):
    """The information per fold against brute force; the separator that matters wins."""
    x = panel_of(spark).withColumn("z", F.pmod(F.hash("ts"), F.lit(5)) + 0.0)
    c = ml.folds(DATES, DATES[100], every=30)
    got = {(r["fold"], r["candidate"]): r["cmi"] for r in ml.conditional_mi(x, c, ["a", "b"], ["m", "z"]).collect()}
    pdf = x.toPandas()

    def code(v, q):
        return pd.cut(v, np.unique(np.quantile(v, np.linspace(0, 1, q + 1))), labels=False, include_lowest=True).to_numpy()

    for f in c:
        t = pdf[(pdf["ts"] >= f["train_start"]) & (pdf["ts"] <= f["train_end"])]
        y = code(t["y_raw"], 3)
        for cand in ("m", "z"):
            r, per = code(t[cand], 3), []
            for name in ("a", "b"):
                k, total = code(t[name], 5), 0.0
                for label in np.unique(r):
                    joint = pd.crosstab(k[r == label], y[r == label]).to_numpy() / (r == label).sum()
                    outer = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
                    total += (r == label).mean() * (joint[joint > 0] * np.log(joint[joint > 0] / outer[joint > 0])).sum()
                per.append(total)
            assert got[f["fold"], cand] == pytest.approx(np.mean(per))
    scores, log = ml.tournament_walk_forward(x, ["a", "b"], ["m", "z"], c, regimes=2, hold=1, window=20)
    assert {r["winner"] for r in log} == {"m"} and len(log) == len(c)
    assert scores.count() == scores.select("ts", "symbol").distinct().count() == 60 * 8


def test_constant_dates(spark):
    """Correlations of a side without spread are NULL, and one name has no date."""
    df = frame(spark, {s: [1.0, v] for s, v in zip("ABCDE", (1.0, 2.0, 3.0, 4.0, 5.0), strict=True)}).withColumn("y", F.ascii("symbol").cast("double"))
    got = {r["ts"]: r["ic"] for r in reports.information_coefficient(df, "x", "y").collect()}
    assert got == {DAY: None, DAY + dt.timedelta(days=1): pytest.approx(1)}
    assert reports.information_coefficient(df.where("symbol = 'A'"), "x", "y").count() == 0
    imp = spark.createDataFrame([(f, t, 1.0) for f in range(4) for t in "ab"], "fold long, term string, importance double")
    assert {r["rank_corr"] for r in reports.stability(imp).collect()} == {None} and {r["corr"] for r in reports.fold_spearman(imp).collect()} == {None}


def test_scalar_ema(spark):
    """No overflow over thousands of folds; absent folds decay."""
    df = spark.createDataFrame([(i, "a", 1.0) for i in range(2000)] + [(3, "b", 2.0)], "fold long, name string, value double")
    got = {(r["fold"], r["name"]): r["ema"] for r in ml.scalar_ema(df).collect()}
    assert got[1999, "a"] == pytest.approx(1) and got[3, "b"] == 2.0 and got[4, "b"] == pytest.approx(2 * (1 - 1 / 3)) and (2, "b") not in got


def test_smoothing(spark):
    """From the second date on, a gross below the leverage is scaled up to it."""
    w = spark.createDataFrame([("s", DAY + dt.timedelta(days=i), k, v) for i, row in enumerate([(0.2, -0.2), (-0.2, 0.6)]) for k, v in zip("AB", row, strict=True)], "strategy string, ts timestamp, symbol string, weight double")
    got = weights.smoothed(w, 0.5, 1.0)
    assert column(got, "weight", "A") == pytest.approx([0.2, 0.0]) and column(got, "weight", "B") == pytest.approx([-0.2, 1.0])


def test_combinations(spark):
    """Every method keeps the caps and the grid."""
    rng = np.random.default_rng(8)
    x = frame(spark, {f"S{i}": list(rng.normal(size=50) * 0.02) for i in range(8)}, "ret")
    two = joins.aligned({n: weights.predictions_to_weights(x.withColumn("score", F.lit(k) * F.col("ret")), 0.3) for n, k in (("up", 1.0), ("down", -1.0))})
    for method in ("linear", "equal_weight", "mean_variance", "cross_signal_mv"):
        got = portfolio.combine(two.where("strategy = 'up'") if method == "linear" else two, x, method, cap=0.2, lookback=20)
        rows = got.collect()
        assert len(rows) == 400 and max(abs(r["weight"]) for r in rows) <= 0.2 + 1e-6, method
    with pytest.raises(ValueError):
        portfolio.combine(two, x, "none")


def test_broker_and_features(spark):
    """Lots, precision, equity, feature choice and a grid whose failures say why."""
    row = spark.range(1).select(portfolio.floor_to_step(F.lit(-1.27), 0.1).alias("a"), portfolio.round_to_precision(F.lit(1.256), 2).alias("b")).first()
    assert row["a"] == pytest.approx(-1.2) and row["b"] == pytest.approx(1.26)
    prices = frame(spark, {"A": [1.0, 3.0], "B": [2.0, 2.0]}, "close")
    held = spark.createDataFrame([("A", 2.0), ("B", -1.0), ("C", 9.0)], "symbol string, qty double")
    assert portfolio.account_equity(held, prices, 10.0).first()["equity"] == pytest.approx(14)
    df = spark.createDataFrame([(DAY, "A", 1.0, 2, "x", 0.5)], "ts timestamp, symbol string, f1 double, f2 int, label string, signal_a double")
    assert calendar.numeric_features(df) == ["f1", "f2"] and calendar.numeric_features(df, ("f1",)) == ["f2"] and calendar.numeric_features(df, (), ("f1",)) == ["f1"]

    def strategy(panel, k):
        if k == 2:
            raise ValueError("no such k")
        return panel.withColumn("close", F.col("close") * k)

    found = backtest.grid_search(prices, strategy, [{"k": 1}, {"k": 2}, {"k": 3}], lambda x: x.agg(F.sum("close").alias("total")))
    assert found == [({"k": 1}, {"total": 8.0}), ({"k": 2}, {"error": "no such k"}), ({"k": 3}, {"total": 24.0})]


def test_streaming_state(spark, tmp_path):
    """Doubled bars go, accounts are marked to market, sessions close."""
    rows = [(DAY, "A", 10.0), (DAY, "A", 10.0), (DAY + dt.timedelta(days=1), "A", 20.0), (DAY + dt.timedelta(days=2), "A", 20.0)]
    bars = spark.createDataFrame(rows, "ts timestamp, symbol string, close double")
    bars.coalesce(1).write.parquet(f"{tmp_path}/b")
    got = []
    stream = market.deduplicated(market.replay(spark, f"{tmp_path}/b", bars.schema))
    q = market.rebalance(stream, lambda df, i: got.extend(df.collect()), "0 seconds", f"{tmp_path}/c")
    q.processAllAvailable()
    q.stop()
    assert len(got) == 3
    out = market.orders(market.replay(spark, f"{tmp_path}/b", bars.schema), lambda c: 0.2, equity=1000.0)
    q = out.writeStream.outputMode("append").format("memory").queryName("marked").start()
    q.processAllAvailable()
    q.stop()
    qty = [r["qty"] for r in spark.table("marked").orderBy("ts").collect()]
    assert qty == pytest.approx([20.0, 0.2 * 1200 / 20 - 20])  # the gain of 200 counts
    ticks = spark.createDataFrame([(1, DAY), (1, DAY + dt.timedelta(minutes=29)), (1, DAY + dt.timedelta(minutes=60))], "user_id long, ts timestamp")
    assert sorted(r["n"] for r in market.sessions(ticks).collect()) == [1, 2]


# The reference inputs of the alpha pipeline and of the optimiser.


def test_alpha_pipeline(spark):
    """Three symbols of 100 days of random walks give a score each."""
    rng = np.random.default_rng(9)
    rows = [
        (DAY + dt.timedelta(days=i), s, float(p), float(p) * 1.01, float(p) * 0.99, 10.0 + i % 5, float(o), float(p) * 0.001, 1.0 + 0.1 * (i % 3), 0.0001 * (i % 4 - 1), 1.0)
        for s in "ABC"
        for i, (p, o) in enumerate(zip(100 + rng.normal(size=100).cumsum(), 1000 + rng.normal(size=100).cumsum(), strict=True))
    ]
    df = spark.createDataFrame(rows, "ts timestamp, symbol string, close double, high double, low double, volume double, open_interest double, basis double, volume_ratio double, funding_rate double, ls_ratio double")
    df = df.withColumn("ret", ts.pct_change("close"))
    df = df.withColumn("mkt", F.avg("ret").over(cs.section()))
    got = factors.live_scores(factors.factor_panel(df)).collect()
    assert {r["symbol"] for r in got} == set("ABC") and all(r["score"] is not None for r in got)


def test_optimizer_contract():
    scores = np.array([2.5, 0.5, -3.0])
    w = portfolio._linear(scores, 1.0, 0.4)
    assert abs(w.sum()) < 0.25 and np.abs(w).sum() <= 1 + 1e-9 and np.abs(w).max() <= 0.4 and w[0] > 0 > w[2]
