"""Partitioned streams, idempotent order sinks and tables that are published whole."""

import datetime as dt
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F
from tessera.sources import market_api, orders, storage

DAY = dt.datetime(2024, 1, 1)
STEP = market_api.INTERVAL_MS["1d"]


def fetch(symbol, start, end, limit):
    """Bars at whole days."""
    first = -(-start // STEP)
    return [(t * STEP, "1", "2", "0.5", "1.5", "10") for t in range(first, end // STEP + 1)][:limit]


def test_stream_partitions():
    reader = market_api.MarketStream({"fetch": "tests.test_sources:fetch", "symbols": "A,B", "start": "0", "end": str(10 * STEP + 5), "limit": "2", "pages": "2", "bars": "7"})
    first = reader.initialOffset()
    end = reader.latestOffset()
    assert end == {"A": 7 * STEP, "B": 7 * STEP}
    parts = reader.partitions(first, end)
    assert [(p.symbol, p.start // STEP, (p.end + 1) // STEP) for p in parts] == [("A", 0, 4), ("A", 4, 7), ("B", 0, 4), ("B", 4, 7)]
    assert [r[1] // STEP for p in parts if p.symbol == "A" for r in reader.read(p)] == list(range(7))
    assert reader.latestOffset() == {"A": 10 * STEP, "B": 10 * STEP}  # the bar from 10 on is still open
    again = market_api.MarketStream(reader.o)  # a restart that replays a batch
    assert [(p.symbol, p.start) for p in again.partitions(first, end)] == [(p.symbol, p.start) for p in parts]
    assert again.latestOffset() == {"A": 10 * STEP, "B": 10 * STEP}


def test_stream_survives_a_restart(spark, tmp_path):
    def run(end, want):
        bars = market_api.bar_stream(spark, fetch="tests.test_sources:fetch", symbols="A,B", start="0", end=str(end * STEP), limit="2", bars="3")
        q = bars.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="0 seconds").start()
        for _ in range(60):
            if q.exception() or q.recentProgress and os.path.exists(f"{tmp_path}/out/_spark_metadata") and spark.read.parquet(f"{tmp_path}/out").count() >= want:
                break
            time.sleep(0.5)
        q.stop()
        rows = spark.read.parquet(f"{tmp_path}/out").collect()
        assert len(rows) == len({(r["symbol"], r["ts"]) for r in rows}) == want

    run(5, 10)
    run(9, 18)


def post(order_id, symbol, side, qty):
    """A broker that takes each id once."""
    try:
        with open(f"{os.environ['BROKER']}/{order_id}", "x") as f:
            f.write(f"{symbol} {side} {qty}")
    except FileExistsError:
        return False


REPORTS = []


def report(*told):
    REPORTS.append(told)


@pytest.fixture
def broker(tmp_path, monkeypatch):
    folder = tmp_path / "broker"
    folder.mkdir()
    return folder


def test_orders_are_sent_once(spark, broker, tmp_path):
    rows = [("s", "A", DAY, 1.27), ("s", "B", DAY, -2.0), ("s", "C", DAY, 0.04), ("s", "D", DAY, None), ("t", "A", DAY, 1.27)]
    df = spark.createDataFrame(rows, "strategy string, symbol string, ts timestamp, qty double").repartition(3)
    os.environ["BROKER"] = str(broker)
    writer = orders.OrderWriter({"post": "tests.test_sources:post", "step": "0.1", "report": "tests.test_sources:report"})
    try:
        first = writer.write(iter(df.collect()))
        again = writer.write(iter(df.collect()))
        assert (first.sent, first.known, first.small) == (3, 0, 2) and (again.sent, again.known, again.small) == (0, 3, 2)
        assert sorted(p.read_text() for p in broker.iterdir()) == ["A BUY 1.2000000000000002", "A BUY 1.2000000000000002", "B SELL 2.0"]
        writer.commit([first, None, again])
        assert REPORTS[-1] == (None, 3, 3, 4, False)
    finally:
        os.environ.pop("BROKER")
    assert orders.lots(-1.27, 0.1) == pytest.approx(-1.2) and orders.lots(3.0, 0) == 3.0


def note(order_id, symbol, side, qty):
    """As post(), in the folder that the symbol names."""
    folder, name = symbol.rsplit("/", 1)
    try:
        with open(f"{folder}/{order_id}", "x") as f:
            f.write(f"{name} {side} {qty}")
    except FileExistsError:
        return False


def test_order_sinks(spark, broker, tmp_path):
    """Tables and streams; a replay of the whole stream sends nothing twice."""
    rows = [(f"{broker}/{s}", DAY + dt.timedelta(days=i), float(i + 1)) for i in range(4) for s in "AB"]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, qty double")
    orders.send(df.where(F.col("qty") < 3), "tests.test_sources:note")
    assert len(list(broker.iterdir())) == 4
    df.write.parquet(f"{tmp_path}/orders")
    for k in range(2):
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/orders")
        q = orders.send_stream(stream, "tests.test_sources:note", f"{tmp_path}/c{k}", "0 seconds")
        q.processAllAvailable()
        q.stop()
    assert sorted(p.read_text() for p in broker.iterdir()) == sorted(f"{s} BUY {i + 1.0}" for i in range(4) for s in "AB")


def test_panels_are_published_whole(spark, tmp_path):
    path = f"{tmp_path}/p"
    epochs = spark.createDataFrame([(dt.date(2023, 10, 1), dt.date(2024, 1, 1), dt.date(2024, 3, 31), s) for s in "AB"], "snapshot_date date, epoch_start date, epoch_end date, symbol string")
    bars = spark.createDataFrame([(DAY, s, float(i)) for i, s in enumerate("ABC")], "ts timestamp, symbol string, close double")
    storage.save_panel(bars.where("symbol = 'A'"), path, epochs.where("symbol = 'A'"))
    held = storage.load_panel(spark, path)
    assert held.count() == 1

    broken = bars.withColumn("close", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        storage.save_panel(broken, path, epochs)  # nothing is published
    assert storage.load_panel(spark, path).count() == 1 and storage.epoch_for(spark, path, "2024-02-02")["n_symbols"] == 1
    storage.save_panel(bars, path, epochs)
    assert storage.load_panel(spark, path).count() == 2 and storage.epoch_for(spark, path, "2024-02-02")["n_symbols"] == 2
    assert held.count() == 1  # a reader of the one before goes on
    storage.save_panel(bars, path, epochs)
    assert len([n for n in os.listdir(path) if n.startswith("v-")]) == 2


def test_weights_are_replaced(spark, tmp_path):
    w = spark.createDataFrame([(DAY, "A", 0.5), (DAY, "B", -0.5)], "ts timestamp, symbol string, weight double")
    for k in (1.0, 2.0):
        storage.save_weights(w.withColumn("weight", F.col("weight") * k), w.where("symbol = 'A'"), f"{tmp_path}/w", "one")
        storage.save_weights(w, w, f"{tmp_path}/w", "two")
    got = storage.load_weights(spark, f"{tmp_path}/w", "unmasked").collect()
    assert sorted((r["strategy"], r["symbol"], r["weight"]) for r in got) == [("one", "A", 1.0), ("one", "B", -1.0), ("two", "A", 0.5), ("two", "B", -0.5)]


def test_workers_import_the_package(tmp_path):
    """From another working directory and without a path in the environment."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from tessera.session import get_session
spark = get_session("elsewhere", 2, 2)
def run(batches):
    from tessera.ml import histograms
    for b in batches:
        yield b
print("rows", spark.range(3).mapInArrow(run, "id long").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 3" in done.stdout, done.stderr[-2000:]
