"""MinHash near-duplicates with odd sketches.

1. One pass hashes each whole text to its set of word shingles, SAMPLES
   MinHash values, BANDS band keys of ROWS values each, and an odd sketch: the
   samples (place, value) folded by parity into SKETCH_BITS bits. For two sets
   of similarity J the XOR of the sketches has about
   n/2 (1 - exp(-4 k (1 - J) / n)) ones (k samples, n bits). A second bitmap of
   PARITY_BITS folds the whole set: the ones of its XOR never exceed the number
   of shingles in which two sets differ, so it refutes pairs without error.
2. Texts with equal sets are one class, found by a 128-bit fingerprint with a
   partial aggregation: copies never meet in pairs.
3. In each bucket of a band every class is paired with the smallest one only
   (the hub). Pairs that pass the sketch test are confirmed on their full sets.
4. Only in buckets whose classes do not fall into one component yet are
   classes of different components paired: those outside the bucket's largest
   component with all others of about their size (a geometric step of 101 /
   percent on either side holds every size that the similarity allows), the
   sketch tests first. So no link between components is lost, and a large group
   of near copies costs links to its hub and pairs with strangers, never its own
   pairs.
5. Components by large-star / small-star.

With 40 bands of 5 rows, a pair at similarity 0.8 shares no bucket with
probability 1.2e-7. The sketch test passes up to MAX_ONES ones, 6.5 standard
deviations above the mean at 0.8.

Defined results: without words or text a document has an empty set, no links
and itself as component. A null doc_id has a null component, is kept and links
nothing; rows that repeat a doc_id are one document as to links. Columns other
than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, slices, table, text_bytes, word_hashes, written
from .graph import components

BANDS, ROWS, SKETCH_BITS, PARITY_BITS = 40, 5, 512, 1024
SAMPLES = BANDS * ROWS
MAX_ONES = 129
#: The ids of texts to confirm are broadcast up to this number (8 bytes each).
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240817)
_MUL = _rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_MUL2 = _rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)

_FEATURES = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f0", pa.int64()), ("f1", pa.int64()), ("sketch", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))]
)


def shingle_sets(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and their bounds."""
    n = len(bounds) - 1
    sets = []
    for i in range(n):
        w = h[bounds[i] : bounds[i + 1]]
        if not len(w):
            sets.append(w)
            continue
        k = min(width, len(w))
        s = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            s = s * np.uint64(0xD6E8FEB86659FD93) + w[j : len(w) - k + 1 + j]
        s = mixed(s)
        s.sort()
        keep = np.ones(len(s), bool)
        keep[1:] = s[1:] != s[:-1]
        sets.append(s[keep])
    ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), ends


def signatures(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(SAMPLES, rows) minima for rows that aren't empty."""
    low = sets.astype(np.uint32)
    high = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((SAMPLES, len(ends) - 1), np.uint32)
    for i in range(SAMPLES):
        v = low * _MUL[i]
        v += high * _MUL2[i]
        v += _ADD[i]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        out[i] = np.minimum.reduceat(v, ends[:-1])
    return out


def features_of(ids: np.ndarray, h: np.ndarray, bounds: np.ndarray, width: int) -> pa.RecordBatch:
    sets, ends = shingle_sets(h, bounds, width)
    sizes = np.diff(ends)
    full = np.flatnonzero(sizes)
    n = len(sizes)
    f = np.zeros((2, n), np.uint64)
    sketch = np.zeros((n, SKETCH_BITS // 64), np.uint64)
    bands = np.zeros((n, BANDS), np.uint64)
    places = np.repeat(np.arange(n), sizes) * PARITY_BITS + (mixed(sets ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(PARITY_BITS)).astype(np.int64)
    parity = np.packbits((np.bincount(places, minlength=n * PARITY_BITS) & 1).astype(np.uint8).reshape(n, PARITY_BITS), axis=1).view(np.uint64)
    if len(full):
        cut = np.append(ends[full], ends[-1])
        f[0, full] = np.add.reduceat(mixed(sets), cut[:-1])
        f[1, full] = np.add.reduceat(mixed(sets ^ np.uint64(0xA5A5A5A55A5A5A5A)), cut[:-1])
        sig = signatures(sets, cut)
        place = np.arange(SAMPLES, dtype=np.uint64)[:, None]
        at = mixed(sig.astype(np.uint64) | (place << np.uint64(32))) % np.uint64(SKETCH_BITS)
        bits = np.zeros((len(full), SKETCH_BITS), np.uint8)
        for i in range(SAMPLES):
            bits[np.arange(len(full)), at[i]] ^= 1
        sketch[full] = np.packbits(bits, axis=1).view(np.uint64)
        key = np.zeros((BANDS, len(full)), np.uint64)
        rows = sig.reshape(BANDS, ROWS, -1)
        for r in range(ROWS):
            key = key * np.uint64(0xD6E8FEB86659FD93) + rows[:, r].astype(np.uint64) + np.uint64(1)
        bands[full] = mixed(key + (np.arange(BANDS, dtype=np.uint64)[:, None] << np.uint64(40))).T
    lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * a.shape[1], pa.int32()), pa.array(a.ravel().view(np.int64)))
    return pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), lists(sketch), lists(parity), lists(bands)], schema=_FEATURES)


def features(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in slices(b.column(1), 1 << 20):
                yield features_of(b.column(0).slice(i, j - i), *word_hashes(data, offs), width)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t"))
    return picked.mapInArrow(run, "doc_id long, n_shingles long, f0 long, f1 long, sketch array<long>, parity array<long>, bands array<long>")


def _shingles(text: bytes, width: int) -> set:
    w = text.lower().split()
    k = min(width, len(w))
    return set(zip(*(w[j:] for j in range(k)), strict=False)) if k else set()


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "dup-ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t"))
    texts = written(texts.join(F.broadcast(ids) if few else ids, "id", "left_semi"), "dup-texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, set()
        for batch in batches:
            good = []
            for a, b in zip(batch.column("ta"), batch.column("tb"), strict=True):
                a = a.as_py()
                if a != last:
                    last, kept = a, _shingles(a, width)
                other = _shingles(b.as_py(), width)
                common = len(kept & other)
                good.append(100 * common >= percent * (len(kept) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. `percent`
    is a similarity of at least 80; the bands are made for that."""
    if percent < 80:
        raise ValueError("bands and sketch test are made for similarities of 80 % and more")
    feats = written(features(docs, width, id_col, text_col), "dup-features")
    some = feats.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(some.groupBy("f0", "f1").agg(F.min("doc_id").alias("rid"), F.min("n_shingles").alias("n")), "dup-classes")
    reps = some.join(classes.select("f0", "f1", "rid"), ["f0", "f1"]).where("doc_id = rid")

    keyed = reps.select("rid", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("rid").alias("hub")).where("c > 1")
    members = written(keyed.join(shared.select("key", "hub"), "key"), "dup-members")
    marks = written(reps.join(members.select("rid").distinct(), "rid", "left_semi").select("rid", "n_shingles", "sketch", "parity"), "dup-marks")

    def ones(p: str, q: str, bits: int) -> str:
        return "(" + " + ".join(f"bit_count({p}[{i}] ^ {q}[{i}])" for i in range(bits // 64)) + ")"

    similar = (
        f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND {ones('sa', 'sb', SKETCH_BITS)} <= {MAX_ONES}"
        f" AND {100 + percent} * {ones('pa', 'pb', PARITY_BITS)} <= {100 - percent} * (na + nb)"
    )
    side = lambda x: marks.select(F.col("rid").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("parity").alias(f"p{x}"))

    first = members.where("rid <> hub").select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct()
    first = first.join(side("a"), "a").join(side("b"), "b").where(similar).select("a", "b")
    links = written(confirmed(written(first, "dup-pairs"), docs, width, percent, id_col, text_col), "dup-links")
    comps = written(components(links), "dup-components")

    placed = members.join(comps.withColumnRenamed("id", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    placed = written(placed, "dup-placed")
    held = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    open_keys = held.groupBy("key").agg(F.max(F.struct("c", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    # Classes of one component need no more links: of the largest one in a bucket, only pairs with the others are looked at.
    open_ = placed.join(open_keys.select("key", F.col("most.component").alias("main")), "key").where("rid <> hub").join(marks, "rid")
    sized = open_.withColumn("step", F.floor(F.log("n_shingles") / F.lit(math.log(101 / percent))))
    others = sized.where("component <> main").withColumn("near", F.explode(F.expr("array(step - 1, step, step + 1)")))
    left = others.select("key", "near", F.col("rid").alias("a"), F.col("component").alias("ca"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"), F.col("parity").alias("pa"))
    right = sized.select("key", F.col("step").alias("near"), F.col("rid").alias("b"), F.col("component").alias("cb"), "main", F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"), F.col("parity").alias("pb"))
    second = left.join(right, ["key", "near"]).where("ca <> cb AND (cb = main OR a < b) AND " + similar).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = written(second, "dup-pairs")
    if second.isEmpty():
        final = comps
    else:
        more = confirmed(second, docs, width, percent, id_col, text_col)
        final = written(components(written(links.unionByName(more), "dup-links")), "dup-components")

    whole = classes.join(final.withColumnRenamed("id", "rid"), "rid", "left").select("f0", "f1", F.coalesce("component", "rid").alias("found"))
    # Classes of several texts are few; the empty set and rows without id meet none.
    out = feats.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("f0")).alias("f0"), "f1").join(whole, ["f0", "f1"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.expr("component_id IS NULL OR doc_id = component_id"))


def op8_minhash_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates (five-word
    shingles, similarity 0.8), the one with the smallest doc_id; a null doc_id
    comes after all others. Rows are told apart by numbers of their own, so
    different texts under one doc_id both stay and copies without doc_id go."""
    at = "_dedup_row"
    while at in docs.columns:
        at += "_"
    rows = written(docs.withColumn(at, F.monotonically_increasing_id()), "dedup-rows")
    groups = near_duplicates(rows, width=5, id_col=at).select(F.col("doc_id").alias("row"), "component_id")
    many = groups.groupBy("component_id").agg(F.count("*").alias("c")).where("c > 1")
    inside = groups.join(many, "component_id").join(rows.select(F.col(at).alias("row"), F.col("doc_id").alias("id")), "row")
    best = inside.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row")).alias("best"))
    gone = inside.join(best, "component_id").where("row <> best.row").select(F.col("row").alias(at))
    return rows.join(gone, at, "left_anti").select(*docs.columns)
