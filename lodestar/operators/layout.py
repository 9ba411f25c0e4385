"""Replicated page layouts ``layout(page_id, slot, node_id)`` and what is derived from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.plans.config import partition_sizes
from lodestar.runtime import ship

LAYOUT = "page_id long, slot int, node_id long"


def singleton_layout(nodes: DataFrame) -> DataFrame:
    """Page i holds node i."""
    return nodes.select(F.col("id").alias("page_id"), F.lit(0).alias("slot"), F.col("id").alias("node_id"))


def replicated_layout(graph: DataFrame, capacity: int) -> DataFrame:
    """Page i holds node i and its first neighbours, up to the capacity."""
    held = F.slice(F.array_distinct(F.concat(F.array("id"), "nbrs")), 1, capacity)
    return graph.select(F.col("id").alias("page_id"), F.posexplode(held).alias("slot", "node_id"))


def ldg_layout(graph: DataFrame, capacity: int, scale: float = 1.0, rounds: int = 4, seed: int = 42) -> DataFrame:
    """A partition by streaming greedy placement, refined in rounds; with scale over 1, replicated primary pages first.

    The state is global by nature (page sizes and where each node lies), so
    the adjacency goes to one task; that bounds it by one worker's memory, as
    it does any in-memory partitioner.  Ties go to the lowest page; the result
    is the same for the same seed.
    """
    ship(graph.sparkSession)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        near = {int(i): [int(x) for x in n] for i, n in zip(ids, pdf["nbrs"], strict=True)}
        back: dict[int, list[int]] = {int(i): [] for i in ids}
        for i, n in near.items():
            for x in n:
                back.setdefault(x, []).append(i)
        n_pages, n_primary = partition_sizes(len(ids), capacity, scale)
        rng = np.random.default_rng(seed)
        pages: list[list[int]] = [[] for _ in range(n_pages)]
        stored = dict.fromkeys(near, 0)
        for p in range(n_primary):  # around node p, the least stored neighbours first
            reach, page = [int(ids[p % len(ids)])], pages[p]
            while reach and len(page) < capacity:
                node = reach.pop(0)
                if node in page:
                    continue
                page.append(node)
                stored[node] += 1
                reach += sorted(near[node], key=lambda x: (stored.get(x, 0), x))
        loose = [x for x in near if not stored[x]]
        home: dict[int, int] = {}
        rest = list(range(n_primary, n_pages))
        at = 0
        for node in loose:  # greedy fill: a node with those of its neighbours that have no page yet
            if node in home:
                continue
            while at < len(rest) and len(pages[rest[at]]) >= capacity:
                at += 1
            for x in [node, *near[node]]:
                if x in stored and not stored[x] and x not in home and at < len(rest) and len(pages[rest[at]]) < capacity:
                    home[x] = rest[at]
                    pages[rest[at]].append(x)
        for x in loose:
            if x not in home:
                p = min((q for q in rest if len(pages[q]) < capacity), key=lambda q: (len(pages[q]), q))
                home[x] = p
                pages[p].append(x)
        for _ in range(rounds):  # all pages but the primary ones are emptied, and the nodes come anew in another order
            for p in rest:
                pages[p] = []
            for x in rng.permutation(loose).tolist():
                ties: dict[int, int] = {}
                for y in [*near[x], *back.get(x, [])]:  # those that come later count where they last were
                    if y in home and y != x:
                        ties[home[y]] = ties.get(home[y], 0) + 1
                best, found = 0.0, None
                for p in sorted(ties):
                    value = ties[p] * (1 - len(pages[p]) / capacity)
                    if value > best:
                        best, found = value, p
                if found is None:
                    found = min((p for p in rest if len(pages[p]) < capacity), key=lambda p: (len(pages[p]), p))
                home[x] = found
                pages[found].append(x)
        rows = [(p, s, x) for p, page in enumerate(pages) for s, x in enumerate(page)]
        return pd.DataFrame(rows, columns=["page_id", "slot", "node_id"])

    return graph.select(F.lit(0).alias("one"), "id", "nbrs").groupBy("one").applyInPandas(place, LAYOUT)


def id_to_page(layout: DataFrame) -> DataFrame:
    """``node_id, page_id``: the lowest page that holds each node."""
    return layout.groupBy("node_id").agg(F.min("page_id").alias("page_id"))


def reorder_offsets(layout: DataFrame, block: int = 4096) -> DataFrame:
    """``page_id, begin, end``: where each page's nodes lie in the flat id list.

    Sums run within blocks of pages, and over the block totals.
    """
    sizes = layout.groupBy("page_id").agg(F.count(F.lit(1)).alias("held")).withColumn("block", F.floor(F.col("page_id") / block))
    upto = lambda w: F.coalesce(F.sum("held").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = sizes.groupBy("block").agg(F.sum("held").alias("held")).select("block", upto(Window.orderBy("block")).alias("before"))
    begin = F.col("before") + upto(Window.partitionBy("block").orderBy("page_id"))
    return sizes.join(totals, "block").select("page_id", begin.alias("begin"), (begin + F.col("held")).alias("end"))


def normalize(layout: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pages that begin with their own node, then the other nodes in order, once each and only known ones."""
    known = nodes.select(F.col("id").alias("node_id"))
    own = nodes.select(F.col("id").alias("page_id"), F.lit(-1).alias("slot"), F.col("id").alias("node_id"))
    rows = own.unionByName(layout.join(known, "node_id", "left_semi").join(nodes.select(F.col("id").alias("page_id")), "page_id", "left_semi").select("page_id", "slot", "node_id"))
    first = rows.groupBy("page_id", "node_id").agg(F.min("slot").alias("slot"))
    place = (F.row_number().over(Window.partitionBy("page_id").orderBy("slot", "node_id")) - 1).alias("slot")
    return first.select("page_id", place, "node_id")


def materialize(layout: DataFrame, graph: DataFrame, base: DataFrame, vectors: str = "target") -> DataFrame:
    """``page_id, target, nodes``: each page with its target's vector, and adjacency (and, with ``all``, vectors) by slot."""
    lists = graph.select(F.col("id").alias("node_id"), "nbrs")
    v = base.select(F.col("id").alias("node_id"), "vector")
    rows = layout.join(lists, "node_id")
    full = [] if vectors == "target" else ["vector"]
    if full:
        rows = rows.join(v, "node_id")
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("slot", "node_id", "nbrs", *full))).alias("nodes"))
    target = v.select(F.col("node_id").alias("first"), F.col("vector").alias("target"))
    return pages.join(target, F.element_at("nodes", 1)["node_id"] == F.col("first")).select("page_id", "target", "nodes")


def inspect_pages(pages: DataFrame) -> DataFrame:
    """``page_id, slot, node_id, degree, first_nbr`` of every slot of materialised pages."""
    return pages.select("page_id", F.explode("nodes").alias("x")).select("page_id", "x.slot", "x.node_id", F.size("x.nbrs").alias("degree"), F.element_at("x.nbrs", 1).alias("first_nbr"))


def validate(layout: DataFrame, points: int, capacity: int) -> DataFrame:
    """``problem, rows`` for every rule of a layout."""
    twice = layout.groupBy("page_id", "node_id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("repeated in page").alias("problem"), "rows")
    outside = layout.filter((F.col("node_id") < 0) | (F.col("node_id") >= points)).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("id range").alias("problem"), "rows")
    wide = layout.groupBy("page_id").count().filter(F.col("count") > capacity).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("over capacity").alias("problem"), "rows")
    return twice.unionByName(outside).unionByName(wide)


def validate_sidecar(layout: DataFrame, sidecar: DataFrame, pages_of: DataFrame, offsets: DataFrame) -> DataFrame:
    """``problem, rows``: layouts that differ, map entries whose page lacks the node, offsets that step back."""
    cols = ["page_id", "slot", "node_id"]
    differ = layout.select(cols).exceptAll(sidecar.select(cols)).unionByName(sidecar.select(cols).exceptAll(layout.select(cols)))
    lost = pages_of.select("node_id", "page_id").join(layout, ["page_id", "node_id"], "left_anti")
    back = offsets.filter(F.col("end") < F.col("begin"))
    out = [(differ, "layouts differ"), (lost, "page without node"), (back, "offsets step back")]
    made = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("problem"), "rows") for df, name in out]
    return made[0].unionByName(made[1]).unionByName(made[2])
