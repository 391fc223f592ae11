"""Connected components by alternating stars, as joins and minima per node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import cut


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node it is linked with, of every
    node on an edge of ``edges`` (two long columns). Each round links a node's
    neighbours with their smallest; rounds grow with the logarithm of the
    longest path. A round hands on no more rows than it got."""
    a, b = edges.columns
    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before, now = None, _print(e)
    while now != before:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        before, now = now, _print(e)
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def extended(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``node`` and ``label`` after more links (a, b): only labels that they join
    are followed further, so the cost is that of the new links."""
    of = lambda c: parts.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
    named = cut(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        "a", "b", F.coalesce("of_a", "a").alias("la"), F.coalesce("of_b", "b").alias("lb")))
    joined = components(named.select("la", "lb")).select(F.col("node").alias("label"), F.col("label").alias("least"))
    ends = named.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("la").alias("label")), F.struct(F.col("b").alias("node"), F.col("lb").alias("label")))).alias("e"))
    nodes = parts.union(ends.select("e.node", "e.label")).distinct()
    return nodes.join(joined, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
