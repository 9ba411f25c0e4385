"""An index as a folder of tables: vectors, graph, layout, page map, offsets, quantisation and one row of metadata.

Refinement edges and quantisation may be absent.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import graph as graphs
from lodestar.operators import layout as layouts
from lodestar.operators import pq
from lodestar.plans.config import BuildConfig, DistanceKind
from lodestar.runtime import exists, ship, stored_bytes

FORMAT = "tables"
PARTS = ("vectors", "graph", "refine", "layout", "id_to_page", "reorder", "pq_pivots", "pq_codes", "meta")
OPTIONAL = ("refine", "pq_pivots", "pq_codes")


@dataclass(frozen=True)
class IndexPaths:
    """Where the tables of an index lie; a given table's path stands for its index."""

    prefix: str

    @classmethod
    def of(cls, path: str) -> IndexPaths:
        """From an index folder or one of its tables."""
        head, _, tail = path.rstrip("/").rpartition("/")
        return cls(head if tail in PARTS else path.rstrip("/"))

    def __getattr__(self, name: str) -> str:
        if name not in PARTS:
            raise AttributeError(name)
        return f"{self.prefix}/{name}"


@dataclass(frozen=True)
class Index:
    """The tables of an index, and its metadata."""

    tables: dict[str, DataFrame]
    meta: dict

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def default_kind(self) -> DistanceKind:
        """Quantised distances lead a search where the index has pivots and codes."""
        return DistanceKind.PQ if {"pq_pivots", "pq_codes"} <= set(self.tables) else DistanceKind.FULL


def build_index(base: DataFrame, path: str, config: BuildConfig, train: DataFrame | None = None, pruned: bool = True) -> Index:
    """Graph, layout, quantisation and metadata of ``base(id, vector, ...)``, each written once and read back.

    ``train(qid, vector)`` are queries that ask for refinement edges, up to
    ``r_ood`` for each node.  Without ``pruned`` the graph is the nearest
    neighbours and their reverse edges, and has no dense ones.  Quantisation needs
    the vectors only: its jobs run beside those of the graph.
    """
    spark = base.sparkSession
    shape = base.agg(F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if not shape[0]:
        raise ValueError("there are no vectors")
    if shape[1] != shape[2]:
        raise ValueError("vectors differ in dimension")
    config.checked(shape[2], shape[0])
    paths = IndexPaths(path)

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(getattr(paths, name))
        return spark.read.parquet(getattr(paths, name))

    vectors = kept("vectors", base)

    def quantised() -> None:
        pivots, _ = pq.train_centred(vectors, config.pq_subspaces, min(config.pq_centroids, shape[0]), config.pq_iterations)
        kept("pq_pivots", pq.pivot_frame(spark, pivots))
        kept("pq_codes", pq.encode(vectors, pivots))

    ship(spark)
    with ThreadPoolExecutor(1) as beside:
        codes = beside.submit(inheritable_thread_target(spark)(quantised))
        refine = None
        if train is not None and config.r_ood:
            refine = kept("refine", graphs.refine_edges(vectors, train, config.r_ood, min(config.l_ood, shape[0])))
        if pruned:
            made = graphs.production_graph(vectors, config.degree, config.dense, max(config.build_l, config.degree), config.alpha, refine, config.r_ood, config.candidates)
        else:
            made = graphs.with_reverse(graphs.knn_graph(vectors, config.degree))
        graph = kept("graph", made)
        entry = graphs.entry_point(vectors, config.entry)
        if config.partition_scale == 0:  # a page for each node, which it begins with
            layout = kept("layout", layouts.normalize(layouts.replicated_layout(graph, config.page_nodes), vectors.select("id")))
        else:
            layout = kept("layout", layouts.ldg_layout(graph, config.page_nodes, config.partition_scale, config.ldg_times))
        kept("id_to_page", layouts.id_to_page(layout))
        kept("reorder", layouts.reorder_offsets(layout))
        codes.result()
    kept("meta", spark.createDataFrame([(FORMAT, shape[0], shape[2], entry, config.degree, config.page_nodes)], "format string, points long, dim int, entry long, degree int, page_nodes int"))
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> Index:
    """An index, with its metadata checked against its tables."""
    paths = IndexPaths.of(path)
    tables = {name: spark.read.parquet(getattr(paths, name)) for name in PARTS if name not in OPTIONAL or exists(spark, getattr(paths, name))}
    rows = tables["meta"].collect()
    if len(rows) != 1:
        raise ValueError("an index has one row of metadata")
    meta = rows[0].asDict()
    if meta["format"] != FORMAT:
        raise ValueError(f"an index of format {meta['format']!r} can't be read")
    if meta["dim"] <= 0 or not 0 <= meta["entry"] < meta["points"] or meta["page_nodes"] <= 0:
        raise ValueError("the metadata contradict themselves")
    if tables["vectors"].count() != meta["points"]:
        raise ValueError("there are not as many vectors as the metadata say")
    broken = [r["problem"] for r in layouts.validate(tables["layout"], meta["points"], meta["page_nodes"]).collect() if r["rows"]]
    if {"pq_pivots", "pq_codes"} <= set(tables):
        broken += [r["problem"] for r in pq.validate(tables["pq_pivots"], tables["pq_codes"]).collect() if r["rows"]]
    if broken:
        raise ValueError("the index is broken: " + ", ".join(broken))
    return Index(tables, meta)


def inspect_files(spark: SparkSession, path: str) -> DataFrame:
    """``part, value``: metadata, bytes of every table, and sizes of quantisation and refinement where they are there."""
    paths, index = IndexPaths.of(path), load_index(spark, path)
    found = {f"meta {k}": str(v) for k, v in index.meta.items()}
    found |= {f"bytes {name}": str(stored_bytes(spark, getattr(paths, name))) for name in index.tables}
    if index.default_kind is DistanceKind.PQ:
        shape = index.pq_pivots.agg(F.max("chunk") + 1, F.max("centroid") + 1, F.max(F.size("center"))).first()
        found |= {f"pq {k}": str(v) for k, v in zip(("chunks", "centroids", "width"), shape, strict=True)}
    if "refine" in index.tables:
        nodes, edges, eh = index.refine.agg(F.count(F.lit(1)), F.sum(F.size("nbrs")), F.max(F.array_max("ehs"))).first()
        found |= {"refine nodes": str(nodes), "refine edges": str(edges or 0), "refine largest eh": str(eh or 0)}
    return spark.createDataFrame(list(found.items()), "part string, value string")


def inspect_page(index: Index, page_id: int) -> DataFrame:
    """``slot, node_id, degree, dense_degree`` of one page, in order."""
    sizes = index.graph.select(F.col("id").alias("node_id"), F.size("nbrs").alias("degree"), F.size("dense_nbrs").alias("dense_degree"))
    return index.layout.filter(F.col("page_id") == page_id).join(sizes, "node_id").select("slot", "node_id", "degree", "dense_degree").orderBy("slot")
