"""Product quantisation: training, encoding, lookup tables and two-stage search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.distance import adc_distances, adc_table, block_l2
from lodestar.operators.exact import matrix, nearest, rerank
from lodestar.runtime import ship

PIVOTS = "chunk int, centroid int, center array<double>"


def _split(x: np.ndarray, chunks: int) -> np.ndarray:
    if chunks <= 0 or x.shape[1] % chunks:
        raise ValueError("the dimension must be a multiple of the number of chunks")
    return x.reshape(len(x), chunks, -1)


def pivot_array(pivots: DataFrame) -> np.ndarray:
    """chunks x centroids x width; its size is chunks * centroids * width whatever the data's."""
    rows = pivots.orderBy("chunk", "centroid").collect()
    if not rows:
        raise ValueError("there are no pivots")
    chunks, centroids = rows[-1]["chunk"] + 1, rows[-1]["centroid"] + 1
    width = len(rows[0]["center"])
    if len(rows) != chunks * centroids or any(len(r["center"]) != width for r in rows):
        raise ValueError("the pivots are not a full table")
    return np.array([r["center"] for r in rows], np.float64).reshape(chunks, centroids, width)


def pivot_frame(spark, pivots: np.ndarray) -> DataFrame:
    """Pivots as a table."""
    rows = [(c, j, pivots[c, j].tolist()) for c in range(len(pivots)) for j in range(pivots.shape[1])]
    return spark.createDataFrame(rows, PIVOTS)


def train_init(base: DataFrame, chunks: int, centroids: int) -> DataFrame:
    """First centroids: of each chunk, those of the rows at positions ``floor(c * N / K)``; ids are positions 0 to N - 1."""
    n = base.count()
    if not n or centroids <= 0:
        raise ValueError("there must be rows and centroids")
    wanted = F.broadcast(base.sparkSession.range(centroids).select(F.col("id").cast("int").alias("centroid"), F.floor(F.col("id") * n / centroids).alias("at")))
    width = F.size("vector") / chunks
    picked = base.join(wanted, F.col("id") == F.col("at")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    part = F.slice(F.col("vector").cast("array<double>"), (F.col("chunk") * width + 1).cast("int"), width.cast("int"))
    return picked.select(F.col("chunk").cast("int").alias("chunk"), "centroid", part.alias("center"))


def _codes(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    parts = _split(x, len(pivots))
    return np.stack([block_l2(parts[:, c], pivots[c]).argmin(1) for c in range(len(pivots))], 1)


def lloyd_step(base: DataFrame, pivots: np.ndarray) -> tuple[np.ndarray, float]:
    """(new pivots, inertia): each task sums its rows by centroid; only those sums are collected.

    Equal distances go to the lower centroid; an empty cluster keeps its centre.
    """
    ship(base.sparkSession)
    chunks, centroids, width = pivots.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, cost = np.zeros_like(pivots), np.zeros((chunks, centroids), np.int64), 0.0
        for batch in batches:
            x = matrix(batch.column(0))
            parts, codes = _split(x, chunks), _codes(x, pivots)
            for c in range(chunks):
                np.add.at(total[c], codes[:, c], parts[:, c])
                n[c] += np.bincount(codes[:, c], minlength=centroids)
                gap = parts[:, c] - pivots[c, codes[:, c]]
                cost += float((gap * gap).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([cost])], ["total", "n", "cost"])

    found = base.select(F.col("vector").cast("array<double>")).mapInArrow(sums, "total binary, n binary, cost double")
    total, n, cost = np.zeros_like(pivots), np.zeros((chunks, centroids), np.int64), 0.0
    for row in found.toLocalIterator():
        total += np.frombuffer(row["total"], np.float64).reshape(pivots.shape)
        n += np.frombuffer(row["n"], np.int64).reshape(n.shape)
        cost += row["cost"]
    return np.where(n[..., None] > 0, total / np.maximum(n, 1)[..., None], pivots), cost


def train(base: DataFrame, chunks: int, centroids: int, iterations: int = 6) -> tuple[np.ndarray, list[float]]:
    """(pivots, inertia before each step)."""
    pivots, costs = pivot_array(train_init(base, chunks, centroids)), []
    for _ in range(iterations):
        pivots, cost = lloyd_step(base, pivots)
        costs.append(cost)
    return pivots, costs


def train_centred(base: DataFrame, chunks: int, centroids: int, iterations: int = 6) -> tuple[np.ndarray, list[float]]:
    """The same on vectors less their mean, which is added to the pivots again: distances are those of centred vectors and queries."""
    means = base.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("pos").collect()
    mean = [r["m"] for r in means]
    centred = base.select("id", F.zip_with(F.col("vector").cast("array<double>"), F.array(*map(F.lit, mean)), lambda x, m: x - m).alias("vector"))
    pivots, costs = train(centred, chunks, centroids, iterations)
    return pivots + np.array(mean).reshape(chunks, 1, -1), costs


def encode(base: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id, codes``: nearest centroid of every chunk, a map over the rows."""
    ship(base.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _codes(matrix(batch.column(1)), pivots).astype(np.int16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "codes"])

    return base.select("id", F.col("vector").cast("array<double>")).mapInArrow(run, "id long, codes array<smallint>")


def adc_tables(queries: DataFrame, pivots: np.ndarray, mean: np.ndarray | None = None) -> DataFrame:
    """``qid, chunk, centroid, distance`` for every query; a mean taken off at training comes off the query."""
    ship(queries.sparkSession)
    chunks, centroids, _ = pivots.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, j = np.divmod(np.arange(chunks * centroids), centroids)
        for batch in batches:
            for qid, q in zip(batch.column(0).to_pylist(), matrix(batch.column(1)), strict=True):
                table = adc_table(q if mean is None else q - mean, pivots)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(table.size, qid)), pa.array(c.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(table.ravel())], ["qid", "chunk", "centroid", "distance"])

    return queries.select("qid", F.col("vector").cast("array<double>")).mapInArrow(run, "qid long, chunk int, centroid int, distance double")


def adc_kernel(pivots: np.ndarray):
    """A distance kernel for blocks of queries against rows of codes."""

    def kernel(queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        codes = codes.astype(np.int64)
        return np.stack([adc_distances(adc_table(q, pivots), codes) for q in queries])

    return kernel


def adc_search(codes: DataFrame, queries: DataFrame, pivots: np.ndarray, l: int) -> DataFrame:
    """The first ``l`` rows of each query by approximate distance."""
    return nearest(codes.select("id", F.col("codes").cast("array<double>").alias("vector")), queries, l, kernel=adc_kernel(pivots))


def two_stage_search(base: DataFrame, codes: DataFrame, queries: DataFrame, pivots: np.ndarray, k: int, l: int) -> DataFrame:
    """A pool of ``l`` by approximate distance, then the k first of it by exact distance."""
    return rerank(adc_search(codes, queries, pivots, l), base, queries, k)


def warm_start(codes: DataFrame, queries: DataFrame, pivots: np.ndarray, mem_l: int, l_pool: int) -> DataFrame:
    """Seeds for a traversal: the best rows over all by approximate distance, at most the pool's size."""
    return adc_search(codes, queries, pivots, min(mem_l, l_pool))


def validate(pivots: DataFrame, codes: DataFrame) -> DataFrame:
    """``problem, rows``: how many rows break a rule of pivots or codes; every problem is named, also with 0."""
    shape = pivots.agg(F.max("chunk").alias("c"), F.max("centroid").alias("j"), F.max(F.size("center")).alias("w"))
    p = pivots.join(F.broadcast(shape))
    c = codes.join(F.broadcast(shape))
    count = lambda df, cond, name: df.agg(F.coalesce(F.sum(F.coalesce(cond, F.lit(True)).cast("long")), F.lit(0)).alias("rows")).select(F.lit(name).alias("problem"), "rows")
    return (
        count(p, F.size("center") != F.col("w"), "center width")
        .unionByName(count(c, F.size("codes") != F.col("c") + 1, "number of codes"))
        .unionByName(count(c, F.exists("codes", lambda x: (x < 0) | (x > F.col("j"))), "code range"))
    )

