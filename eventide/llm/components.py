"""Connected components by stars: edges move to the smallest node that they reach, in rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import materialize, tidy

#: So many edges at most (16 bytes each) are finished by one task; of more, Spark makes stars until so few are left or all are stars.
LAST_EDGES = 400_000


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that it reaches over edges a - b."""
    root = np.arange(n)
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
    return root


def components(links: DataFrame) -> DataFrame:
    """node, label: for every node of links (a, b) the smallest node it is linked with, over any number of links.

    In a round every node first links its larger neighbours, then itself and its smaller ones, to the smallest node
    that it knows. A round has no more edges than the one before, and in the end one for each node but the smallest of
    its component. Edges go to the shared folder after each step. Repeated links, links of a node to itself and an
    empty table are allowed; nulls are left out.
    """
    links = links.select("a", "b").dropna().filter("a <> b")
    edges = materialize(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    while edges.count() > LAST_EDGES:
        ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("lo", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up + down > 1").isEmpty():
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(edges.select("lo", "lo").distinct())
        ways = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = edges.select(F.col("lo").alias("u"), "hi").join(low, "u").select("hi", F.col("m").alias("lo"))
        edges = materialize(up.distinct(), "edges")
        low = edges.groupBy("hi").agg(F.min("lo").alias("m"))
        down = edges.join(low, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = materialize(down.union(low.select("hi", F.col("m").alias("lo"))).distinct(), "edges")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*([x.to_numpy() for x in b.columns] for b in batches), strict=True)] or [np.zeros(0, np.int64)] * 2
        nodes, at = np.unique(np.concatenate(both), return_inverse=True)
        a, b = np.split(at, 2)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots(len(nodes), a, b)])], names=["node", "label"])

    return materialize(edges.coalesce(1).mapInArrow(tidy(finish), "node long, label long"), "labels")
