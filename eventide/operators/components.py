"""Connected components of links, by stars: edges move to the smallest node that they reach, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.sources.shared import written


def _all_stars(edges: DataFrame) -> bool:
    """Whether every edge ends in the smallest node of its component: no node has two smaller ones, or smaller and larger ones."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("lo", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, component: of each node of links (a, b) but the smallest of its component, that smallest one.

    In a round every node first links its larger neighbours, then itself and its smaller ones, to the smallest node that it
    knows; edges go to the shared folder after each step. No round has more edges than the one before.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    while not _all_stars(edges):
        ways = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = written(edges.withColumnRenamed("lo", "u").join(low, "u").select("hi", F.col("m").alias("lo")).distinct(), "edges")
        low = edges.groupBy("hi").agg(F.min("lo").alias("m"))
        down = edges.join(low, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = written(down.union(low.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
