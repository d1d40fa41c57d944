"""Importance resampling towards a target distribution.

1. Pass one: each Arrow batch of texts is cut into lower-cased words, runs of 1
   to `n` words are hashed to BUCKETS buckets, and np.bincount adds them to one
   vector of the partition. treeReduce merges the vectors, for the corpus and
   for the target alike; they are BUCKETS numbers long, whatever the input.
2. The gain of each bucket, the log ratio of its smoothed shares, is broadcast
   (8 * BUCKETS bytes). Pass two gathers it for each feature and sums documents
   by np.bincount with the gains as weights.
3. Documents of at least MIN_WORDS words compete by weight plus Gumbel noise from
   a hash of their id, which draws without replacement in proportion to the
   weight's exponential. Ranks come from a range-partitioned global order.

Long texts are read in pieces that end between words, with the last n - 1 words
carried over, so memory follows the piece. Defined results: a null or empty text
has no features and weight 0; a null doc_id is hashed as the empty text and
comes after all others among ties; rows that repeat a doc_id compete each on
their own. An empty target gives gains from the corpus alone. Other columns are
not read and may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from .common import SLICE_BYTES, slices, table, text_bytes, tree_sum

BUCKETS, MIN_WORDS, SHARE, SEED = 10_000, 20, 10, 2024

#: Words are runs of letters, digits and all that isn't ASCII; A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _word_runs(data: bytes, piece: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about `piece` bytes."""
    at = 0
    while at < len(data):
        end = min(at + piece, len(data))
        while end < len(data) and _FOLD[data[end]] != 32:
            end += 1
        yield data[at:end].translate(_FOLD).split()
        at = end


def _features(text: bytes, n: int, piece: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs of 1 to n words that end in them), piece by piece."""
    tail: list[bytes] = []
    for words in _word_runs(text, piece):
        crcs = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words))]
        both = tail + words
        for k in range(2, n + 1):
            first = max(0, len(tail) - (k - 1))  # runs that end in this piece
            grams = zip(*(islice(both, first + j, None) for j in range(k)), strict=False)
            crcs.append(np.fromiter((zlib.crc32(b" ".join(g)) for g in grams), np.uint32))
        tail = both[max(0, len(both) - n + 1) :] if n > 1 else []
        yield len(words), np.concatenate(crcs) % np.uint32(BUCKETS)


def bucket_counts(docs: DataFrame, n: int = 1, text_col: str = "text") -> np.ndarray:
    """Features in each bucket over all texts: one vector a partition, merged in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text in b.column(0):
                for _, at in _features(text.as_py(), n):
                    total += np.bincount(at, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    return tree_sum(docs.select(text_bytes(text_col).alias("t")).mapInArrow(run, "counts binary"), BUCKETS)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: floor(1000 ln of the target's smoothed share over the corpus's)."""
    s, t = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((float(x) + 1) * s / ((float(y) + 1) * t))) for x, y in zip(target, corpus, strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, n: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value.astype(np.float64)  # sums of whole numbers below 2**53 are exact
        for b in batches:
            for i, j, data, offs in slices(b.column(1)):
                raw, words, owner, at = data.tobytes(), np.zeros(j - i, np.int64), [], []
                count, total = np.zeros(j - i, np.int64), np.zeros(j - i)
                for k in range(j - i):
                    for w, found in _features(raw[offs[k] : offs[k + 1]], n):
                        words[k] += w
                        owner.append(np.full(len(found), k))
                        at.append(found)
                if owner:
                    owner, at = np.concatenate(owner), np.concatenate(at)
                    count += np.bincount(owner, minlength=j - i)
                    total += np.bincount(owner, weights=g[at], minlength=j - i)
                weight = np.floor_divide(total.astype(np.int64), np.maximum(count, 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(words), pa.array(count), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resampled(
    docs: DataFrame, target: DataFrame, n: int = 1, percent: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; rank is null
    for those not drawn."""
    gain = gains(bucket_counts(docs, n, text_col), bucket_counts(target, n))
    rows = weighted(docs, gain, n, id_col, text_col)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    rows = rows.withColumns({"score": F.col("weight") + noise, "_in": F.col("n_words") >= min_words})
    rows = numbered(rows, [F.col("_in").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "_at", "resampled")
    eligible = rows.where("_in").count()
    drawn = percent * eligible // 100
    return rows.select("doc_id", "n_features", "weight", "score", F.when(F.col("_in") & (F.col("_at") <= drawn), F.col("_at")).alias("rank"))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
