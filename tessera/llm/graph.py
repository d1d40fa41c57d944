"""Connected components over a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(id, component) of every id in links(a, b): component is the smallest id
    reachable. Alternating large-star and small-star steps, of which a
    logarithmic number suffice; each step pre-aggregates minima before its
    shuffle, so an id with very many links is one row a task, and ends in a
    table of the shared folder."""

    def stars(edges: DataFrame, large: bool) -> DataFrame:
        """edges(u, v) with u > v."""
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u > v").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.hash("u", "v").cast("long"))).first())

    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), tag)
    before = mark(edges)
    while before[0]:
        edges = written(stars(stars(edges, True), False), tag)
        now = mark(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
