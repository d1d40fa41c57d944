"""Exact length histogram of a corpus in tokens.

Documents are aggregated by encoded length (a partial aggregation, so a hot
length is one row a task). Suffix sums over the histogram answer, for every
context limit: how many documents reach it, totals, tokens left after cutting
each document at the limit, and quantiles. The sums are taken in blocks of
lengths: within each block, and over the few block totals.

Defined results: a null or empty text has length 0. An empty table gives an
empty histogram. Rows that repeat an id count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written
from .tokens import default_path, token_lengths

BLOCK = 4096


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) of lengths(n_tokens)."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L that occurs: n_docs; docs_ge and tokens_ge of documents
    of L tokens or more; total_docs and total_tokens; kept_tokens, the total if
    every document is cut at L tokens; quantile, the share of documents of at
    most L tokens."""
    h = written(hist.withColumn("block", F.expr(f"n_tokens div {BLOCK}")), "lengths")
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    above = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    sums = sums.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t"),
        F.sum("d").over(every).alias("total_docs"),
        F.sum("t").over(every).alias("total_tokens"),
    )
    inside = W.partitionBy("block").orderBy(F.col("n_tokens").desc())
    out = h.join(sums, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("d")).alias("docs_ge"),
        (F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside) + F.col("t")).alias("tokens_ge"),
        "total_docs",
        "total_tokens",
    )
    return out.selectExpr(
        "*",
        "total_tokens - tokens_ge + n_tokens * docs_ge AS kept_tokens",
        "CAST(total_docs - docs_ge + n_docs AS DOUBLE) / total_docs AS quantile",
    )


def answers(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, kept_tokens, cut_docs) for any limits, also between the
    lengths that occur: the next longer length has the sums."""
    one = F.max("total_tokens").alias("total"), *[F.min_by(F.when(F.col("n_tokens") > x, F.struct("docs_ge", "tokens_ge")), F.when(F.col("n_tokens") > x, F.col("n_tokens"))).alias(f"s{i}") for i, x in enumerate(limits)]
    rows = ", ".join(f"{x}L, s{i}" for i, x in enumerate(limits))
    return sums.agg(*one).selectExpr("total", f"stack({len(limits)}, {rows}) AS (context_limit, s)").selectExpr(
        "context_limit",
        "total - coalesce(s.tokens_ge, 0L) + context_limit * coalesce(s.docs_ge, 0L) AS kept_tokens",
        "coalesce(s.docs_ge, 0L) AS cut_docs",
    )


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    lengths = token_lengths(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.tiktoken"))
    return suffix_sums(histogram(lengths))
