"""The pipeline over nulls, repeated ids, clashing columns and no rows at all."""

from __future__ import annotations

import pytest

EXTRA = "row long, t string, rid long, component_id long, kept boolean, lang_pred string, _hit_row long, _dedup_row long, part long, batch long"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


@pytest.fixture(scope="module")
def real(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows]


def folder(spark, path, docs, benchmark=True):
    full = [(*d, 1, "t", 2, 3, True, "xx", 4, 5, 6, 7) for d in docs]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{path}/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    (items if benchmark else items.limit(0)).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows(spark, tmp_path, real):
    import corpus_pipeline

    base = max(d[0] for d in real) + 1
    good = next(d for d in real if d[2] == "en" and d[1] and 80 < len(d[1].split()) < 400)
    odd = [
        (None, None, None, None, None),
        (None, "", "en", None, 0),
        (None, good[1], None, None, None),  # a copy without an id gives way to the one that has one
        (base, "x", "en", "s", 1),
        (base, good[1] + " and a few words more", "en", "s", 1),  # near copies under one id
        (base, good[1] + " and a few words more than that", "en", "s", 1),
        (base + 1, "word " * 50_000, "en", "s", 250_000),
    ]
    path = folder(spark, tmp_path / "a", [*real, *odd])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert out.count() <= before
        docs, before = out, out.count()
    packed = corpus_pipeline.run(spark, path).collect()
    assert packed and all(r["doc_id"] is not None for r in packed) and base + 1 not in {r["doc_id"] for r in packed}
    of_good = {r["doc_id"] for r in packed} & {good[0], base}
    assert of_good <= {min(good[0], base)}


def test_empty_tables(spark, tmp_path, real):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "b", [])).count() == 0
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "c", [(1, None, None, None, None)])).count() == 0
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "d", real[:60], benchmark=False)).count() > 0
