"""Packing by optimal length buckets.

1. Encoded lengths of whole texts; a text longer than max_len becomes several
   sequences, all of max_len but the last, so nothing is cut off.
2. The global histogram of sequence lengths, at most max_len rows, goes to the
   driver, where dynamic programming chooses the n_buckets upper bounds that
   minimise the total padding.
3. Inside a bucket sequences are numbered and cut into batches of as many as fit
   the token budget at the bucket's padded length. The numbers come from counts
   by (bucket, cell), cells being hashes of the id; so a bucket that holds most
   sequences is still numbered by many tasks.

Defined results: an empty or null text has no tokens and no sequence. Rows that
repeat an id are packed each; a null id is an id like others. Ties in the
programme take the smaller bound. A budget below the longest bound is raised to
it, so a batch holds one sequence at least.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written
from .tokens import default_path, token_lengths

MAX_LEN, N_BUCKETS, BATCH_TOKENS = 4096, 8, 65_536
#: Sequences that a task numbers at once, about.
CELL_ROWS = 200_000


class Plan(NamedTuple):
    bounds: list[int]
    padding: int


def optimal_buckets(histogram: dict[int, int], n_buckets: int) -> Plan:
    """Upper bounds (some of the lengths that occur) with the least padding.

    cost[j] = best of the first j lengths; the row for one more bucket is a
    minimum over the last bucket's first length, vectorised over it. With L
    lengths: L^2 x n_buckets steps, L at most max_len."""
    lengths = np.array(sorted(k for k, c in histogram.items() if k > 0 and c > 0), np.int64)
    if not len(lengths):
        return Plan([], 0)
    counts = np.array([histogram[int(k)] for k in lengths], np.int64)
    n = len(lengths)
    docs = np.concatenate(([0], np.cumsum(counts)))
    toks = np.concatenate(([0], np.cumsum(counts * lengths)))
    cost = lengths * docs[1:] - toks[1:]
    cost = np.concatenate(([0], cost))  # one bucket
    back = []
    for _ in range(1, min(n_buckets, n)):
        new, arg = cost.copy(), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            i = np.arange(j)
            c = cost[:j] + lengths[j - 1] * (docs[j] - docs[i]) - (toks[j] - toks[i])
            k = int(c.argmin())
            new[j], arg[j] = c[k], k
        back.append(arg)
        cost = new
    bounds, j = [], n
    for arg in reversed(back):
        bounds.append(int(lengths[j - 1]))
        j = int(arg[j])
        if j == 0:
            break
    if j > 0:
        bounds.append(int(lengths[j - 1]))
    return Plan(sorted(set(bounds)), int(cost[n]))


def pack(lengths: DataFrame, max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """lengths(doc_id, n_tokens) -> one row per sequence: doc_id, part, start,
    n_tokens, bucket_len, batch, slot, padding."""
    lengths = written(lengths.select("doc_id", F.col("n_tokens").cast("long").alias("n")).where("n > 0"), "pack-lengths")
    # Full parts of long texts and the rest of each text, counted without making the rows.
    full = lengths.select(F.lit(max_len).cast("long").alias("len"), F.expr(f"n div {max_len}").alias("c"))
    rest = lengths.select(F.expr(f"n % {max_len}").alias("len"), F.lit(1).cast("long").alias("c"))
    histogram = full.unionByName(rest).where("len > 0 AND c > 0").groupBy("len").agg(F.sum("c").alias("c"))
    plan = optimal_buckets({r["len"]: r["c"] for r in histogram.collect()}, n_buckets)
    bounds = plan.bounds or [max_len]
    budget = max(batch_tokens, bounds[-1])

    seqs = lengths.selectExpr("doc_id", "n", f"explode(sequence(0L, (n - 1) div {max_len})) AS part")
    seqs = seqs.selectExpr("doc_id", "part", f"part * {max_len} AS start", f"least(n - part * {max_len}, {max_len}L) AS n_tokens")
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")) for b in bounds])
    total = lengths.count()
    cells = max(8, -(-total // CELL_ROWS))
    seqs = seqs.withColumn("bucket_len", bucket).withColumn("cell", F.pmod(F.xxhash64("doc_id", "part"), F.lit(cells)))
    sizes = written(seqs.groupBy("bucket_len", "cell").agg(F.count("*").alias("c")), "pack-cells")  # n_buckets x cells rows
    before = sizes.select("bucket_len", "cell", (F.sum("c").over(W.partitionBy("bucket_len").orderBy("cell")) - F.col("c")).alias("before"))
    at = F.row_number().over(W.partitionBy("bucket_len", "cell").orderBy(F.col("doc_id").asc_nulls_first(), "part")) - 1
    placed = seqs.withColumn("at", at).join(F.broadcast(before) if cells <= 100_000 else before, ["bucket_len", "cell"]).withColumn("at", F.col("at") + F.col("before"))
    return placed.selectExpr(
        "doc_id",
        "part",
        "start",
        "n_tokens",
        "bucket_len",
        f"at div ({budget} div bucket_len) AS batch",
        f"at % ({budget} div bucket_len) AS slot",
        "bucket_len - n_tokens AS padding",
    )


def packed(docs: DataFrame, vocabulary: str | None = None, **how) -> DataFrame:
    return pack(token_lengths(docs, vocabulary or default_path("byte_bpe_50k.tiktoken")), **how)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: where each sequence of each document goes."""
    return packed(docs)
