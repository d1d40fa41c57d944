"""Kneser-Ney counts over many shards: two levels of dealing, bounded maps."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from tessera.llm import kneser_ney as K


def texts_of(spark, seed=2, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(" ".join(rng.choices(words, [1 / (i + 1) for i in range(400)], k=rng.randrange(0, 60))),) for _ in range(n)]
    return spark.createDataFrame(rows, "t string").selectExpr("cast(t AS binary) AS t").repartition(5)


def scores(about, texts):
    model = K.Model(about)
    out = []
    for r in texts:
        data = np.frombuffer(r, np.uint8)
        out.append([float(x[0]) for x in model.score(*K.tokens(data, np.array([0, len(data)])))])
    return out, model


@pytest.mark.parametrize("order", [2, 3])
def test_two_levels(spark, monkeypatch, order):
    """The same counts and scores whether runs are dealt at once or by groups."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    texts = texts_of(spark)
    held = [bytes(r["t"]) for r in texts.collect()][:40]
    hot = [int(K.tokens(np.frombuffer(b"w0", np.uint8), np.array([0, 2]))[0][0])] if order == 3 else []
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        plain = K.train(texts, order, hot)
        monkeypatch.setattr(K, "ONE_LEVEL", 4)
        grouped = K.train(texts, order, hot)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert grouped["shards"] == plain["shards"] == 23
    assert {k: v for k, v in grouped.items() if k != "folder"} == {k: v for k, v in plain.items() if k != "folder"}
    want, _ = scores(plain, held)
    got, _ = scores(grouped, held)
    assert got == want
    monkeypatch.setattr(K, "MAPS", 7)
    few, model = scores(grouped, held)
    assert few == want and len(model.files) <= 7


def test_dealing_follows_the_triples():
    """5,000 shards cost about what 50 do, and give the same triples."""
    rng = np.random.default_rng(1)
    names = np.unique(rng.integers(3, 1 << 48, 60_000).astype(np.uint64))
    v = np.sort(rng.integers(0, len(names), 400_000))
    u, w = rng.integers(0, len(names), (2, len(v)))
    c = rng.integers(1, 9, len(v))

    def dealt(n, groups=0):
        began = time.process_time()
        out = list(K._dealt(names, u, v, w, c, n, groups, np.zeros(0, np.uint64)))
        return out, time.process_time() - began

    few, _ = dealt(50)
    many, took = dealt(5_000)
    grouped, _ = dealt(5_000, 71)
    assert len(few) == 50 and 4_900 < len(many) <= 5_000 and len(grouped) == 71 and took < 30
    want = sorted(zip(names[u].tolist(), names[v].tolist(), names[w].tolist(), c.tolist(), strict=True))
    for rows in (few, many, grouped):
        columns = [np.concatenate(x) for x in zip(*(K._columns_of(r.column("blob")[0].as_py()) for r in rows), strict=True)]
        assert sorted(zip(*(x.tolist() for x in columns), strict=True)) == want
    for r in many:
        assert set(K.shard_of(K._columns_of(r.column("blob")[0].as_py())[1], 5_000).tolist()) == {r.column("shard")[0].as_py()}
    import pyarrow as pa

    table = pa.Table.from_batches(grouped)
    again = list(K._regrouped(iter(table.to_batches()), 5_000, np.zeros(0, np.uint64)))
    columns = [np.concatenate(x) for x in zip(*(K._columns_of(r.column("blob")[0].as_py()) for r in again), strict=True)]
    assert sorted(zip(*(x.tolist() for x in columns), strict=True)) == want
