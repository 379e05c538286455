"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each id of ``links`` (a, b), the smallest id that it reaches.

    Each round is written to the shared folder, so lineage stays short; rounds grow with the
    logarithm of the ids. A hub of many links is reduced to its smallest neighbour before any
    exchange and met again by a join that Spark can split.
    """
    pair = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialize(pair.distinct())
    seen = _fingerprint(edges)
    while seen[0]:
        last, edges = edges, materialize(_small_star(_large_star(edges)))
        forget(last)
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    own = edges.select("u", F.col("v").alias("component"))
    return own.select(F.col("u").alias("id"), "component").unionByName(own.select(F.col("component").alias("id"), "component").distinct())
