"""Approximate nearest neighbours with multiprobe p-stable hashing.

``L`` tables hash a vector to ``M`` integers ``floor((a.v + b) / W)`` with
Gaussian ``a``.  A query visits, per table, its own bucket and perturbed ones
(each integer moved by -1, 0 or +1) in falling order of estimated success: the
probability that a neighbour at distance ``r`` falls there.  It stops when the
visited mass reaches what ``L`` independent tables need for the target recall.
``r`` and ``W`` are fitted on at most ``SAMPLE_ROWS`` rows; every row is
indexed.  Candidates of all tables are merged and reranked by exact distance.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.textkit import _STEP, _U, _mix
from lodestar.runtime import saved, ship

SAMPLE_ROWS = 2000
TABLES = 8
TARGET = 0.95
WIDTH = 1.4
ROWS_PER_PART = 200_000
BLOCK_QUERIES = 2048


@dataclass(frozen=True)
class Hashing:
    """Projections (tables x M x dim), offsets (tables x M), bucket width, and the fitted neighbour distance."""

    a: np.ndarray
    b: np.ndarray
    width: float
    radius: float

    @property
    def mass(self) -> float:
        """The probability mass to visit in each table."""
        return 1 - (1 - TARGET) ** (1 / len(self.a))

    def places(self, x: np.ndarray) -> np.ndarray:
        """rows x tables x M: where each vector lies, in bucket widths."""
        return (np.einsum("nd,tmd->ntm", x, self.a) + self.b) / self.width

    @staticmethod
    def codes(cells: np.ndarray) -> np.ndarray:
        """64-bit code of (table, bucket) for cells of shape ... x tables x M."""
        h = np.zeros(cells.shape[:-1], _U)
        for i in range(cells.shape[-1]):
            h = _mix(h + cells[..., i].astype(np.int64).view(_U) * _STEP[i % 16] + _U(i + 1))
        return _mix(h + np.arange(1, cells.shape[-2] + 1, dtype=_U) * _STEP[13])


def fit(sample: np.ndarray, rows: int, k: int, seed: int = 7) -> Hashing:
    """Hash functions for ``rows`` vectors, from a sample of them.

    More rows take more integers for each bucket.  The sample's neighbours are
    farther than those among all rows, which errs on the side of more probes.
    """
    x = sample[: min(len(sample), 400)]
    d2 = (sample**2).sum(1)[None] + (x**2).sum(1)[:, None] - 2 * x @ sample.T
    near = np.sqrt(np.maximum(np.partition(d2, min(k, len(sample) - 1), axis=1)[:, min(k, len(sample) - 1)], 0))
    radius = float(np.quantile(near, 0.75)) or float(near.max()) or 1e-6
    m = int(min(12, max(3, round(math.log2(max(rows, 2)) / 2.6))))
    rng = np.random.default_rng(seed)
    width = WIDTH * radius
    return Hashing(rng.standard_normal((TABLES, m, sample.shape[1])), rng.random((TABLES, m)) * width, width, radius)


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def probe_order(fraction: np.ndarray, scale: float, mass: float) -> list[tuple[tuple[int, int], ...]]:
    """Perturbations ((place, -1 or 1), ...) of one bucket in falling order of estimated success.

    ``fraction``: where the query lies within its bucket, in widths; ``scale``:
    widths for each standard deviation of a neighbour's offset.  Ends once
    the visited probability reaches ``mass``; then or when all are visited.
    """
    m = len(fraction)
    moves, stay = [], 1.0
    for i, f in enumerate(fraction.tolist()):
        low, high = -f * scale, (1 - f) * scale
        here = max(_normal(high) - _normal(low), 1e-12)
        stay *= here
        moves.append((-math.log(max(_normal(low) - _normal(low - scale), 1e-12) / here), i, -1))
        moves.append((-math.log(max(_normal(high + scale) - _normal(high), 1e-12) / here), i, 1))
    moves.sort()
    moves = [(max(s, 0.0), i, d) for s, i, d in moves]
    out: list[tuple[tuple[int, int], ...]] = [()]
    seen = stay
    heap = [(moves[0][0], (0,))]
    while heap and seen < mass:
        score, chosen = heapq.heappop(heap)
        if len({moves[j][1] for j in chosen}) == len(chosen):
            out.append(tuple(moves[j][1:] for j in chosen))
            seen += stay * math.exp(-score)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score + moves[last + 1][0], (*chosen, last + 1)))
            heapq.heappush(heap, (score - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
    return out


def probe_codes(hashing: Hashing, place: np.ndarray) -> np.ndarray:
    """Codes of all buckets one query visits; ``place``: tables x M."""
    cell = np.floor(place)
    out = []
    for t in range(len(place)):
        order = probe_order(place[t] - cell[t], hashing.width / hashing.radius, hashing.mass)
        cells = np.repeat(cell[t][None], len(order), 0)
        for row, moves in enumerate(order):
            for i, d in moves:
                cells[row, i] += d
        full = np.repeat(cells[:, None], len(place), 1)
        out.append(Hashing.codes(full)[:, t])
    return np.concatenate(out)


def usable(vectors: DataFrame, vector: str, dim: int | None = None) -> Column:
    """Whether a vector takes part: not null, finite throughout, not zero (and of the given dimension)."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine & (F.size(v) == dim) if dim else fine, F.lit(False))


def nearest(query: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest rows by exact distance, equal ones by smaller id."""
    d = np.sqrt(((x - query) ** 2).sum(1))
    if len(d) > k:
        pick = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        d, ids = d[pick], ids[pick]
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


_HITS = "query_id long, vec_id long, score double"


def _hits(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    q = np.concatenate([np.full(len(i), q, np.int64) for q, i, _ in rows] or [np.zeros(0, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([x[1] for x in rows] or [q])), pa.array(np.concatenate([x[2] for x in rows] or [q.astype(float)]))], ["query_id", "vec_id", "score"])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``query`` selects, its k nearest other rows found.

    Vectors that are null, zero, of a rarer dimension, or with null or
    non-finite components take no part, nor do rows without id.  Equal
    distances go by smaller id; repeated ids count once, with their nearest.  Buckets
    that hold more than a quarter part are split by id and visited part by
    part.  A query that finds fewer than k is answered exactly, over all rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    every = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), query.alias("asks")).filter(F.col("vec_id").isNotNull() & usable(vectors, "v"))
    sizes = every.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes["dim"], sizes["count"]
    every = every.filter(F.size("v") == dim)
    sample = every.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toPandas()
    hashing = fit(np.array(sample["v"].tolist()), n, k)
    # every part gives k rows for a query that visits it: no more parts than tasks
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * TABLES // ROWS_PER_PART))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            codes = Hashing.codes(np.floor(hashing.places(x)))
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(codes[:, t].view(np.int64)), batch.column(0), batch.column(1)], ["code", "vec_id", "v"])

    indexed = every.select("vec_id", "v").mapInArrow(index, "code long, vec_id long, v array<double>")
    # At most 4 * parts * TABLES buckets hold more than a quarter part; only these come to the driver.
    most = max(1, n // (4 * parts))
    big = {r["code"]: -(-r["count"] // most) for r in indexed.groupBy("code").count().filter(F.col("count") > most).collect()}

    def part_of(codes: np.ndarray, salts: np.ndarray) -> np.ndarray:
        return (_mix(codes.view(_U) + salts.astype(_U) * _STEP[11]) % _U(parts)).astype(np.int32)

    big_codes = np.array(sorted(big), np.int64)
    big_salts = np.array([big[x] for x in sorted(big)], np.int64)

    def salts_of(codes: np.ndarray) -> np.ndarray:
        if not len(big_codes):
            return np.ones(len(codes), np.int64)
        at = np.minimum(np.searchsorted(big_codes, codes), len(big_codes) - 1)
        return np.where(big_codes[at] == codes, big_salts[at], 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            salt = (_mix(ids.view(_U)) % salts_of(codes).astype(_U)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part_of(codes, salt)), *batch.columns], ["part", "code", "vec_id", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = hashing.places(_matrix(batch.column(1)))
            for row in range(len(places)):
                codes = np.unique(probe_codes(hashing, places[row])).view(np.int64)
                times = salts_of(codes)
                salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                codes = np.repeat(codes, times)
                part = part_of(codes, salt)
                order = np.argsort(part, kind="stable")
                starts = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array(codes[order]))
                own = batch.slice(row, 1).take(pa.array(np.zeros(len(starts), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(part[order][starts]), *own.columns, lists], ["part", "query_id", "q", "codes"])

    def rerank(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if held.num_rows and asked.num_rows:
            codes, ids, x = held["code"].to_numpy(), held["vec_id"].to_numpy(), _matrix(held["v"])
            order = np.argsort(codes, kind="stable")
            codes, ids, x = codes[order], ids[order], x[order]
            for q, vector, wanted in zip(asked["query_id"].to_pylist(), _matrix(asked["q"]), asked["codes"], strict=True):
                wanted = np.asarray(wanted.values)
                a, b = np.searchsorted(codes, wanted, "left"), np.searchsorted(codes, wanted, "right")
                pick = np.concatenate([np.arange(i, j) for i, j in zip(a, b, strict=True) if i < j] or [np.zeros(0, np.int64)])
                pick = pick[ids[pick] != q]
                if len(pick):
                    own = pick[np.unique(ids[pick], return_index=True)[1]]  # the same vector from several tables
                    found.append((q, *nearest(vector, x[own], ids[own], k)))
        return pa.Table.from_batches([_hits(found)])

    asking = every.filter(F.coalesce(F.col("asks"), F.lit(False))).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    probes = asking.mapInArrow(ask, "part int, query_id long, q array<double>, codes array<long>")
    dealt = indexed.mapInArrow(deal, "part int, code long, vec_id long, v array<double>")
    hits = dealt.groupBy("part").cogroup(probes.groupBy("part")).applyInArrow(rerank, _HITS)
    best = saved(_ranked(hits, k), "neighbours")

    short = asking.join(best.filter(F.col("rank") == min(k, n - 1)).select("query_id"), "query_id", "left_anti") if n > 1 else asking.limit(0)
    short = saved(short.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(1 << 20))), "lone-queries")
    lone = short.count()
    if not lone:
        return best
    blocks, found = -(-lone // BLOCK_QUERIES), []
    for i in range(blocks):  # each block of queries, of bounded size, against all rows
        own = short.filter(F.col("block") % blocks == i).select("query_id", "q").toPandas()
        if len(own):
            exact = every.select("vec_id", "v").mapInArrow(_against(own["query_id"].to_numpy(), np.array(own["q"].tolist()), k), _HITS)
            found.append(saved(_ranked(exact, k), "exact-neighbours").saved_path)
    exact = spark.read.schema(best.schema).parquet(*found)
    return best.join(short.select("query_id"), "query_id", "left_anti").unionByName(exact)


def _against(ids: np.ndarray, queries: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            rows = []
            for q, vector in zip(ids.tolist(), queries, strict=True):
                other = own != q
                rows.append((q, *nearest(vector, x[other], own[other], k)))
            yield _hits(rows)

    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query; partial limits run before the shuffle."""
    window = Window.partitionBy("query_id").orderBy("score", "vec_id")
    few = hits.withColumn("near", F.dense_rank().over(window)).filter(F.col("near") <= k).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return few.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
