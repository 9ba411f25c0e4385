"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.runtime import discard, freed_shuffles, saved, ship

#: As many edges as one task finishes alone; more go through rounds of stars.
TASK_EDGES = 1 << 18


class Forest:
    """Union-find over 0..n-1; every root is the smallest of its set."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges replaced by stars around its components' smallest vertices."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(names))
        for x, y in zip(codes[: len(a)].tolist(), codes[len(a) :].tolist(), strict=True):
            forest.join(x, y)
        roots = np.array([forest.root(i) for i in range(len(names))], np.int64)
        own = np.flatnonzero(roots != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[roots[own]])], ["a", "b"])

    return edges.mapInArrow(contract, "a long, b long")


def roots(edges: DataFrame) -> DataFrame:
    """``vertex, component`` of the vertices of ``edges(a long, b long)`` but each component's smallest, which names it.

    Each partition contracts its own edges first.  What is left is finished in
    one task if that is at most ``TASK_EDGES`` edges, and by rounds of large
    and small stars otherwise: first the larger neighbours of each vertex, then
    its smaller ones, are hung on the smallest vertex around it, until few
    edges are left or nothing changes.  Every round is a saved table; minima
    are taken on the map side first.
    """
    spark = edges.sparkSession
    ship(spark)
    stars = saved(_contracted(edges.filter("a <> b").select("a", "b")).distinct(), "stars")
    before = None
    while True:
        with freed_shuffles(spark):
            size, total = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (size, total) == before or not size:
            break
        older = stars
        if size <= TASK_EDGES:
            stars = saved(_contracted(stars.coalesce(1)), "stars")
            discard(older)
            break
        before = (size, total)
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        stars = saved(small.filter("a <> b").distinct(), "stars")
        discard(older)
    return stars.select(F.col("a").alias("vertex"), F.col("b").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """``vertex, component`` for every vertex that has an edge to another; the component is its smallest vertex."""
    found = roots(edges)
    return found.unionByName(found.select(F.col("component").alias("vertex"), "component").distinct())
