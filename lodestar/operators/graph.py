"""Proximity graphs as tables ``graph(id, nbrs, dense_nbrs)`` and ``edges(src, dst, pos)``."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.distance import block_l2
from lodestar.operators.exact import matrix, nearest, nearest_lists
from lodestar.runtime import saved, ship


#: Components of candidates that are pruned at once.
PRUNED_VALUES = 1 << 21


def knn_graph(base: DataFrame, degree: int, dense: int = 0, kept: bool = False) -> DataFrame:
    """Exact nearest others of every node by (distance, id): all nodes are the query set, block by block.

    Those behind the first ``degree``, up to ``dense`` in all, are dense
    neighbours.  ``kept`` saves what was found, for more than one use.
    """
    found = nearest_lists(base, max(degree, dense), kept)
    every = F.transform("near", lambda x: x["id"])
    return found.select(F.col("qid").alias("id"), F.slice(every, 1, degree).alias("nbrs"), F.slice(every, degree + 1, max(0, dense - degree)).alias("dense_nbrs"))


def edges(graph: DataFrame, column: str = "nbrs") -> DataFrame:
    """``src, dst, pos``."""
    return graph.select(F.col("id").alias("src"), F.posexplode(column).alias("pos", "dst")).select("src", "dst", "pos")


def flat_graph(graph: DataFrame) -> DataFrame:
    """``id, nbrs``: base neighbours in order, then dense ones not seen before."""
    dense = F.coalesce("dense_nbrs", F.array().cast("array<long>"))
    return graph.select("id", F.array_distinct(F.concat(F.coalesce("nbrs", F.array().cast("array<long>")), dense)).alias("nbrs"))


def reverse_graph(graph: DataFrame) -> DataFrame:
    """``id, nbrs``: who points at each node that anyone points at, ascending."""
    return edges(graph).groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("nbrs"))


def with_reverse(graph: DataFrame) -> DataFrame:
    """The graph with reverse edges appended behind each node's own."""
    back = reverse_graph(graph).select("id", F.col("nbrs").alias("back"))
    both = F.array_distinct(F.concat("nbrs", F.coalesce("back", F.array().cast("array<long>"))))
    return graph.join(back, "id", "left").select("id", both.alias("nbrs"), "dense_nbrs")


def validate(graph: DataFrame, points: int, degree: int, dense_degree: int = 0) -> DataFrame:
    """``problem, nodes``: nodes that break a rule, for every rule."""
    out = lambda c: F.exists(c, lambda x: (x < 0) | (x >= points))
    rules = {
        "degree": F.size("nbrs") > degree,
        "dense degree": F.size("dense_nbrs") > dense_degree,
        "id range": out("nbrs") | out("dense_nbrs"),
        "self edge": F.array_contains("nbrs", F.col("id")),
        "repeated edge": F.size(F.array_distinct("nbrs")) < F.size("nbrs"),
    }
    row = graph.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name) for name, c in rules.items()])
    return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*[F.col(f"`{n}`") for n in rules]))).alias("problem", "nodes"))


def medoid(base: DataFrame) -> DataFrame:
    """``id, total``: the node with the smallest summed distance to all others, equal ones by id.

    A node's sum over all ``b`` is ``n |a - m|^2 - 2 (a - m) s + q`` with the mean ``m`` and
    ``s`` and ``q`` the sums of ``b - m`` and ``|b - m|^2``: two passes over the
    rows give these, a third each node's sum.
    """
    spark = base.sparkSession
    ship(spark)
    rows = base.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))

    def moments(mean: np.ndarray | float) -> tuple[int, np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, square = 0, None, 0.0
            for batch in batches:
                if batch.num_rows:
                    off = matrix(batch.column(0)) - mean
                    if total is not None and len(total) != off.shape[1]:
                        raise ValueError("vectors differ in dimension")
                    n, total, square = n + len(off), off.sum(0) + (0 if total is None else total), square + float((off * off).sum())
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([square])], ["n", "s", "q"])

        parts = rows.select("vector").mapInArrow(run, "n long, s array<double>, q double").collect()
        if len({len(r["s"]) for r in parts}) > 1:
            raise ValueError("vectors differ in dimension")
        return sum(r["n"] for r in parts), np.array([r["s"] for r in parts], float).sum(0), math.fsum(r["q"] for r in parts)

    n, total, _ = moments(0.0)
    mean = total / max(n, 1)
    n, total, square = moments(mean)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                off = matrix(batch.column(1)) - mean
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n * (off * off).sum(1) - 2 * (off * total).sum(1) + square)], ["id", "total"])

    return rows.mapInArrow(summed, "id long, total double").select("id", F.round("total", 6).alias("total")).orderBy("total", "id").limit(1)


def bfs_levels(graph: DataFrame, entry: int, most: int | None = None) -> DataFrame:
    """``id, level`` of every node within reach of the entry.

    One join of the frontier with the edges and one anti-join for each level;
    levels are saved tables, and every 16 become one, so the plan stays short.
    """
    links = saved(edges(graph).select("src", "dst").distinct(), "edges")
    frontier = graph.sparkSession.createDataFrame([(entry, 0)], "id long, level int")
    seen, level = frontier, 0
    while most is None or level < most:
        level += 1
        step = frontier.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = saved(step.join(seen, "id", "left_anti").withColumn("level", F.lit(level)), "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
        if level % 16 == 0:
            seen = saved(seen, "reached")
    return seen


def alpha_prune(base: DataFrame, candidates: DataFrame, degree: int, alpha: float = 1.2) -> DataFrame:
    """``id, nbrs``: of each node's candidates ``(id, nbrs)``, those not much nearer to a kept one.

    Nearest first; a candidate is dropped if ``alpha`` times its distance to a
    kept neighbour is not above its distance to the node.  Each node is one
    bounded group.
    """
    ship(base.sparkSession)
    wanted = candidates.select("id", F.explode("nbrs").alias("n")).filter("id <> n")
    v = base.select(F.col("id").alias("n"), F.col("vector").cast("array<double>").alias("nv"))
    own = base.select("id", F.col("vector").cast("array<double>").alias("vector"))
    # columns apart: lists of structs would be copied value by value
    near = wanted.join(v, "n").groupBy("id").agg(F.collect_list(F.struct("n", "nv")).alias("near"))
    rows = near.join(own, "id").select("id", "vector", F.col("near.n").alias("ns"), F.flatten("near.nv").alias("nvs"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts, x = batch.column(2).flatten().to_numpy(), batch.column(2).value_lengths().to_numpy(), matrix(batch.column(1))
            flat = batch.column(3).flatten().to_numpy()
            if len(flat) != len(ids) * x.shape[1]:
                raise ValueError("vectors differ in dimension")
            at, flat = np.cumsum(counts) - counts, flat.reshape(-1, x.shape[1])
            order, kept = np.argsort(counts, kind="stable"), [None] * len(x)
            while len(order):  # nodes of about as many candidates together
                some = order[: max(1, PRUNED_VALUES // max(1, counts[order[0]] * x.shape[1]))]
                some = some[counts[some] <= 2 * counts[some[0]]]
                order = order[len(some) :]
                for i, nbrs in zip(some.tolist(), pruned(x[some], ids, flat, at[some], counts[some], degree, alpha), strict=True):
                    kept[i] = nbrs
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.int64()))], ["id", "nbrs"])

    return rows.mapInArrow(prune, "id long, nbrs array<long>")


def pruned(own: np.ndarray, ids: np.ndarray, vectors: np.ndarray, at: np.ndarray, counts: np.ndarray, degree: int, alpha: float) -> list[list[int]]:
    """The kept ids of each node: node i's candidates are ``counts[i]`` of ``ids`` and ``vectors`` from ``at[i]``."""
    slot = np.arange(counts.max())[None]
    live = slot < counts[:, None]
    place = np.where(live, at[:, None] + slot, at[:, None])
    names, x = ids[place], vectors[place]
    apart = lambda one: np.add.accumulate((x - one[:, None]) ** 2, axis=2)[:, :, -1]
    d = apart(own)
    d[~live] = np.inf
    every, kept = np.arange(len(own)), [[] for _ in own]
    order = np.lexsort((names, d), axis=1)  # the first live one is next
    for _ in range(degree):
        if not live.any():
            break
        turn = np.take_along_axis(live, order, 1).argmax(1)
        best = order[every, turn]
        for i in np.flatnonzero(live[every, best]).tolist():
            kept[i].append(int(names[i, best[i]]))
        live &= alpha * apart(x[every, best]) > d
        live[every, best] = False
    return kept


def pruned_graph(base: DataFrame, degree: int, pool: int, alpha: float = 1.2, candidates: DataFrame | None = None, most: int = 0) -> DataFrame:
    """A navigable graph: pruned candidates (the ``pool`` nearest, if not given), reverse edges, and pruned again to the degree.

    ``most`` bounds a node's candidates with its reverse edges; 0 doesn't.
    """
    candidates = knn_graph(base, pool).select("id", "nbrs") if candidates is None else candidates
    first = alpha_prune(base, candidates, degree, alpha)
    both = with_reverse(saved(first, "pruned").withColumn("dense_nbrs", F.array().cast("array<long>")))
    again = alpha_prune(base, both.select("id", F.slice("nbrs", 1, most).alias("nbrs") if most else "nbrs"), degree, alpha)
    return again.withColumn("dense_nbrs", F.array().cast("array<long>"))


def refine_edges(base: DataFrame, train: DataFrame, most: int, pool: int) -> DataFrame:
    """``id, nbrs, ehs``: edges that training queries ask for, at most ``most`` for each node.

    The row nearest to a query ``train(qid, vector)`` is linked to the others
    among the query's ``pool`` nearest; ``ehs`` says how many queries ask for
    each edge.  Most asked first, then nearest to any query, then by id.
    """
    near = saved(nearest(base, train, pool), "asked")
    hub = near.filter("rank = 1").select("qid", F.col("id").alias("hub"))
    asked = near.filter("rank > 1").join(hub, "qid").groupBy("hub", "id").agg(F.count(F.lit(1)).cast("int").alias("eh"), F.min("rank").alias("near"))
    place = F.row_number().over(Window.partitionBy("hub").orderBy(F.desc("eh"), "near", "id"))
    kept = asked.withColumn("place", place).filter(F.col("place") <= most)
    lists = kept.groupBy(F.col("hub").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", F.col("id").alias("n"), "eh"))).alias("x"))
    return lists.select("id", F.transform("x", lambda x: x["n"]).alias("nbrs"), F.transform("x", lambda x: x["eh"]).alias("ehs"))


def validate_refine(refine: DataFrame, most: int) -> DataFrame:
    """``problem, nodes``: nodes whose refinement edges break a rule, for every rule."""
    rules = {"refine degree": F.size("nbrs") > most, "counts differ": F.size("nbrs") != F.size("ehs")}
    row = refine.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name) for name, c in rules.items()])
    return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*[F.col(f"`{n}`") for n in rules]))).alias("problem", "nodes"))


def production_graph(base: DataFrame, degree: int, dense: int, pool: int, alpha: float = 1.2, refine: DataFrame | None = None, tail: int = 0, most: int = 0) -> DataFrame:
    """``id, nbrs, dense_nbrs``: pruned base edges, refinement edges behind them, and the nearest others as dense ones.

    With refinement edges the last ``tail`` of the degree are theirs.  Dense
    neighbours are at most ``dense - degree``.
    """
    near = saved(knn_graph(base, max(pool, dense)).select("id", "nbrs"), "near")
    own = pruned_graph(base, degree - (tail if refine is not None else 0), pool, alpha, near.select("id", F.slice("nbrs", 1, pool).alias("nbrs")), most)
    rows = near.select("id", F.col("nbrs").alias("near")).join(own.select("id", "nbrs"), "id", "left")
    none = F.array().cast("array<long>")
    nbrs = F.coalesce("nbrs", none)
    if refine is not None:
        rows = rows.join(refine.select("id", F.col("nbrs").alias("asked")), "id", "left")
        nbrs = F.slice(F.array_distinct(F.concat(nbrs, F.filter(F.coalesce("asked", none), lambda x: x != F.col("id")))), 1, degree)
    rows = rows.withColumn("nbrs", nbrs)
    return rows.select("id", "nbrs", F.slice(F.array_except("near", "nbrs"), 1, max(0, dense - degree)).alias("dense_nbrs"))


def copied_neighbours(graph: DataFrame) -> DataFrame:
    """``id, nbrs``: base neighbours with the dense ones behind them, repeats and all."""
    none = F.array().cast("array<long>")
    return graph.select("id", F.concat(F.coalesce("nbrs", none), F.coalesce("dense_nbrs", none)).alias("nbrs"))


def entry_point(base: DataFrame, override: int | None = None) -> int:
    """The given entry, checked, or the medoid."""
    if override is not None:
        if not base.filter(F.col("id") == override).limit(1).count():
            raise ValueError("the entry point is not in the data")
        return override
    return medoid(base).first()["id"]

