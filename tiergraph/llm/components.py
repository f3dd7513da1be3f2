"""Connected components of a link table by contraction and alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.llm.common import stored

#: Nodes that a task holds while it contracts its links.
MOST_NODES = 500_000


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of ``links`` (columns ``a``, ``b``).

    A round first contracts the links of each partition to stars, a bounded number of
    nodes at a time, and then hangs the neighbours of a node below the smallest one it
    knows, first the larger neighbours, then the smaller ones. Rounds end in a written
    table; their number grows with the logarithm of the longest path. A hub is a join
    key with many rows on one side only, which Spark splits.

    Returns ``node``, ``component`` for the nodes that have links.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    )
    while True:
        edges = stored(edges.mapInArrow(_contract, edges.schema))
        before = _state(edges)
        edges = stored(_small_star(_large_star(edges)))
        if _state(edges) == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}
    kind = None

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(parent)]
        return pa.RecordBatch.from_pydict({
            "u": pa.array([p[0] for p in pairs], kind), "v": pa.array([p[1] for p in pairs], kind),
        })

    for batch in batches:
        kind = batch.schema.field("u").type
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > MOST_NODES:
            yield stars()
            parent = {}
    if parent:
        yield stars()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    # Written first: a side that still aggregates would keep Spark from splitting a hub.
    least = stored(least.select("u", F.least("u", "m").alias("m")))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
