"""N-gram Jaccard join with set relations: exact, on full sets.

1. Counts. Shingle hashes are counted over all texts in a table of 2**FREQ_BITS
   cells, one vector a partition, merged in a tree. (cell's count, hash) is a
   global order of shingles, rare ones first, of fixed size whatever the corpus.
2. Sets. A set of n shingles that is at least `percent` similar to another shares
   one of its first n - ceil(percent n / 100) + 1 shingles in that order with it:
   these go to the index. Texts with equal sets are one class.
3. Index lists. In the list of a shingle every set has a place: its size and the
   position of the shingle in it. Sets of one place are a block, and the largest
   overlap that size and position allow holds for the block: blocks whose bound
   fails are skipped whole, before any of their members are looked at.
4. Answers. Every set is compared with one leader, the smallest id of the lists
   it is in with which it shares most of its prefix. The full overlap o(x, l)
   with the leader is kept. What links with its leader takes over the leader's
   answers: its component. Only lists that hold several components are searched
   on, and only between components. For two sets of one leader the answer is
   derived: o(x, l) + o(y, l) - |l| <= o(x, y) <= o(x, l) + |y| - o(y, l), and
   the same with x and y exchanged. Only pairs that these bounds and a bitmap of
   parities leave open are compared.
5. Components by large-star / small-star.

The parity bitmap of a set has PARITY_BITS bits; the ones of an XOR never exceed
the number of shingles in which two sets differ, so it refutes without error.
Nothing is sampled, capped or cut; a pair at the threshold is always found.

Defined results: without words or text a document has an empty set, no links and
itself as component. A null doc_id has a null component and links nothing; rows
that repeat a doc_id are one document as to links. Long texts are hashed in
pieces; a set needs some 24 bytes a shingle. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, slices, table, text_bytes, tree_sum, word_hashes, written
from .graph import components
from .near_dup import BROADCAST_IDS, PARITY_BITS, shingle_sets

FREQ_BITS = 19
#: Texts are hashed in slices of about this many bytes.
PIECE = 512 << 10
#: Size and position of an index entry in one long.
_PLACE = 1 << 31


def frequencies(docs: DataFrame, width: int, text_col: str = "text") -> np.ndarray:
    """Shingles of all texts counted in cells of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << FREQ_BITS, np.int64)
        for b in batches:
            for _, _, data, offs in slices(b.column(0), PIECE):
                sets, _ = shingle_sets(*word_hashes(data, offs), width)
                total += np.bincount((sets >> np.uint64(64 - FREQ_BITS)).astype(np.int64), minlength=1 << FREQ_BITS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = docs.select(text_bytes(text_col).alias("t")).mapInArrow(run, "counts binary")
    return tree_sum(written(vectors, "join-counts", "zstd"), 1 << FREQ_BITS)  # written: hashing and merging aren't in memory together


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values.view(np.int64)))


def _features_of(ids: pa.Array, h: np.ndarray, bounds: np.ndarray, width: int, percent: int, freq: np.ndarray) -> pa.RecordBatch:
    sets, ends = shingle_sets(h, bounds, width)
    sizes = np.diff(ends)
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    marks = np.zeros((2, n), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        at = ends[:-1][full]
        marks[0, full] = np.add.reduceat(mixed(sets), at)
        marks[1, full] = np.add.reduceat(mixed(sets ^ np.uint64(0xA5A5A5A55A5A5A5A)), at)
    places = owner * PARITY_BITS + (mixed(sets ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(PARITY_BITS)).astype(np.int64)
    parity = np.packbits((np.bincount(places, minlength=n * PARITY_BITS) & 1).astype(np.uint8).reshape(n, PARITY_BITS), axis=1).view(np.uint64)
    order = np.lexsort((sets, freq[(sets >> np.uint64(64 - FREQ_BITS)).astype(np.int64)], owner))
    lengths = np.where(sizes > 0, sizes - (percent * sizes + 99) // 100 + 1, 0)
    position = np.arange(len(sets)) - np.repeat(ends[:-1], sizes)
    prefix = sets[order][position < np.repeat(lengths, sizes)]
    columns = [ids, pa.array(sizes.astype(np.int64)), *(pa.array(m.view(np.int64)) for m in marks), _lists(parity.ravel(), np.full(n, PARITY_BITS // 64)), _lists(prefix, lengths)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "f0", "f1", "parity", "prefix"])


def features(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Size, fingerprint, parity bitmap and index prefix of each document's set."""
    sent = docs.sparkSession.sparkContext.broadcast(np.minimum(frequencies(docs, width, text_col), 0xFFFFFFFF).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in slices(b.column(1), PIECE):
                yield _features_of(b.column(0).slice(i, j - i), *word_hashes(data, offs), width, percent, sent.value)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t"))
    return picked.mapInArrow(run, "doc_id long, n_shingles long, f0 long, f1 long, parity array<long>, prefix array<long>")


def overlaps(pairs: DataFrame, docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pairs(a, b) with o, the shingles that the full sets share."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "join-ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t"))
    texts = written(texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").dropDuplicates(["id"]), "join-texts")
    # Sorted by a, so the set of a leader is made once for all that follow it.
    both = pairs.select("a", "b").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")

    def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, data, offs in slices(column):
            sets, ends = shingle_sets(*word_hashes(data, offs), width)
            yield from (sets[ends[k] : ends[k + 1]] for k in range(len(ends) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int64)
            for k, (a, other) in enumerate(zip(batch.column("a").to_pylist(), sets_of(batch.column("tb")), strict=True)):
                if a != last:
                    last, held = a, next(sets_of(batch.column("ta").slice(k, 1)))
                at = np.minimum(np.searchsorted(held, other), len(held) - 1)
                found[k] = np.count_nonzero(held[at] == other)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], ["a", "b", "o"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, o long")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id over all pairs of
    documents with 100 * intersection >= percent * union."""
    feats = written(features(docs, width, percent, id_col, text_col), "join-features")
    some = feats.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("f0", "f1").agg(F.min("doc_id").alias("rid"), F.min("n_shingles").alias("n"), F.first("parity").alias("parity"), F.first("prefix").alias("prefix"))
    classes = written(classes, "join-classes")

    entries = classes.select("rid", F.posexplode("prefix").alias("pos", "token"), "n").selectExpr("token", "rid", f"n * {_PLACE} + pos AS place")
    shared = entries.groupBy("token").agg(F.count("*").alias("c"), F.min("rid").alias("hub"), F.min_by("place", "rid").alias("hub_place")).where("c > 1")
    members = written(entries.join(shared.drop("c"), "token"), "join-members")

    def allowed(na: str, pa_: str, nb: str, pb: str) -> str:
        """Size and position leave an overlap of at least `percent`."""
        return f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb}) AND {100 + percent} * least({na} - {pa_}, {nb} - {pb}) >= {percent} * ({na} + {nb})"

    split = lambda place, n, p: {n: F.expr(f"{place} div {_PLACE}"), p: F.expr(f"{place} % {_PLACE}")}
    differ = " + ".join(f"bit_count(pa[{i}] ^ pb[{i}])" for i in range(PARITY_BITS // 64))
    similar = f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND {100 + percent} * ({differ}) <= {100 - percent} * (na + nb)"
    linked = f"{100 + percent} * o >= {percent} * (na + nb)"

    near = members.where("rid <> hub").withColumns(split("place", "n", "p") | split("hub_place", "hn", "hp")).where(allowed("n", "p", "hn", "hp"))
    best = near.groupBy("rid", "hub").agg(F.count("*").alias("c")).groupBy("rid").agg(F.max_by("hub", F.struct("c", -F.col("hub"))).alias("hub"))
    side = lambda x: classes.select(F.col("rid").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    first = best.select(F.col("hub").alias("a"), F.col("rid").alias("b")).join(side("a"), "a").join(side("b"), "b").where(similar)
    first = written(first.select("a", "b", "na", "nb"), "join-first")
    known = written(first.join(overlaps(first, docs, width, id_col, text_col), ["a", "b"]), "join-known")
    links = written(known.where(linked).select("a", "b"), "join-links")
    comps = written(components(links), "join-components")

    placed = members.join(comps.withColumnRenamed("id", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid")).drop("hub", "hub_place")
    placed = written(placed, "join-placed")
    held = placed.groupBy("token", "component").agg(F.count("*").alias("c"))
    open_lists = held.groupBy("token").agg(F.max(F.struct("c", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    # Sets of one component have each other's answers: of a list's largest component, only pairs with the others are looked at.
    open_ = written(placed.join(open_lists.select("token", F.col("most.component").alias("main")), "token"), "join-open")
    blocks = open_.groupBy("token", "place").agg(F.max(F.expr("component <> main")).alias("outside")).withColumns(split("place", "n", "p"))
    step = F.floor(F.log("n") / F.lit(math.log(101 / percent)))
    left = blocks.where("outside").select("token", F.col("place").alias("x"), F.col("n").alias("nx"), F.col("p").alias("px"), F.explode(F.array(step - 1, step, step + 1)).alias("step"))
    right = blocks.select("token", F.col("place").alias("y"), F.col("n").alias("ny"), F.col("p").alias("py"), step.alias("step"))
    meet = left.join(right, ["token", "step"]).where(allowed("nx", "px", "ny", "py")).select("token", "x", "y")
    ours = open_.where("component <> main").select("token", F.col("place").alias("x"), F.col("rid").alias("i"), F.col("component").alias("ci"))
    theirs = open_.select("token", F.col("place").alias("y"), F.col("rid").alias("j"), F.col("component").alias("cj"), "main")
    second = ours.join(meet, ["token", "x"]).join(theirs, ["token", "y"]).where("ci <> cj AND (cj = main OR i < j)").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    told = lambda x: known.select(F.col("b").alias(x), F.col("a").alias(f"l{x}"), F.col("o").alias(f"o{x}"), F.col("na").alias(f"m{x}"))
    second = second.join(side("a"), "a").join(side("b"), "b").where(similar).drop("pa", "pb").join(told("a"), "a", "left").join(told("b"), "b", "left")
    # A failed pair with a leader is known; two sets of one leader have bounds.
    second = second.where("NOT (la <=> b) AND NOT (lb <=> a)").withColumns(
        {"low": F.expr("CASE WHEN la = lb THEN oa + ob - ma ELSE 0 END"), "high": F.expr("CASE WHEN la = lb THEN least(oa + nb - ob, ob + na - oa) ELSE least(na, nb) END")}
    )
    second = written(second.where(f"{100 + percent} * high >= {percent} * (na + nb)").select("a", "b", "na", "nb", "low"), "join-second")
    if second.isEmpty():
        final = comps
    else:
        derived = second.where(linked.replace("o >=", "low >=")).select("a", "b")
        asked = second.where("NOT (" + linked.replace("o >=", "low >=") + ")").select("a", "b", "na", "nb")
        more = asked.join(overlaps(asked, docs, width, id_col, text_col), ["a", "b"]).where(linked).select("a", "b")
        final = written(components(written(links.unionByName(derived).unionByName(more), "join-links")), "join-components")

    whole = classes.join(final.withColumnRenamed("id", "rid"), "rid", "left").select("f0", "f1", F.coalesce("component", "rid").alias("found"))
    out = feats.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("f0")).alias("f0"), "f1").join(whole, ["f0", "f1"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))


def op13_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
