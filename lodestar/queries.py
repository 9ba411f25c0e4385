"""The registered queries of the vector engine, and DuckDB SQL that gives the same rows.

Base: all of ``embeddings``.  Query set: its rows whose id is divisible by 50.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.distance import sql_l2
from lodestar.functions.labels import sanitize_label as clean_label
from lodestar.index import build_index
from lodestar.operators import beam, bench, exact, graph, layout, pq
from lodestar.plans.config import BeamPolicy, BuildConfig, CachePolicy, DistanceKind, FilterMode, SchedulerPolicy, SearchConfig, Sweep, choose_filter_mode, filter_costs
from lodestar.runtime import new_path, saved, shared_folder, ship, table
from lodestar.sources import vectors as files

K, RADIUS, L_SEARCH, L_POOL = 10, 1.4, 50, 100
DEGREE, CAPACITY = 8, 4
CHUNKS, CENTROIDS = 16, 16
LABELS = [1, 2]


def base_of(spark: SparkSession, d: str) -> DataFrame:
    """``id, vector, label`` of all rows."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def queries_of(spark: SparkSession, d: str) -> DataFrame:
    """``qid, vector`` of the query set."""
    return base_of(spark, d).filter(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), "vector")


def _ints(column: str):
    return F.concat_ws(",", F.transform(column, lambda x: x.cast("string"))).alias(column)


# --- SQL building blocks -------------------------------------------------
V = "V AS (SELECT vec_id AS id, embedding AS v, label FROM embeddings)"
Q = "Q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0)"


def _topk(source: str, k: int, name: str = "top") -> str:
    return f"{name} AS (SELECT * FROM (SELECT qid, id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INTEGER AS rank FROM {source}) WHERE rank <= {k})"


PAIRS = f"pairs AS (SELECT qid, id, label, {sql_l2('qv', 'v')} AS distance FROM Q, V)"
TOP = f"WITH {V}, {Q}, {PAIRS}, {_topk('pairs', K)}"
TOP_ROWS = "SELECT qid, rank, id, distance FROM top"
FILTERED = f"WITH {V}, {Q}, {PAIRS}, members AS (SELECT * FROM pairs WHERE label IN (1, 2)), {_topk('members', K)} {TOP_ROWS}"
EDGES = f"""{V}, near AS (SELECT a.id AS qid, b.id AS id, {sql_l2('a.v', 'b.v')} AS distance FROM V a, V b WHERE a.id <> b.id),
    {_topk('near', DEGREE, 'knn')}, E AS (SELECT qid AS src, id AS dst, rank FROM knn)"""
LAYOUT = f"{EDGES}, L AS (SELECT id AS page_id, 0 AS slot, id AS node_id FROM V UNION ALL SELECT src, rank, dst FROM E WHERE rank < {CAPACITY})"
WIDTH = 64 // CHUNKS
PIVOTS = f"""{V}, C AS (SELECT unnest(range(0, {CHUNKS})) AS chunk),
    J AS (SELECT j, CAST(floor(j * (SELECT count(*) FROM V) / {CENTROIDS}) AS BIGINT) AS at FROM (SELECT unnest(range(0, {CENTROIDS})) AS j)),
    P AS (SELECT chunk, j AS centroid, list_slice(v, chunk * {WIDTH} + 1, chunk * {WIDTH} + {WIDTH}) AS center FROM C, J JOIN V ON V.id = J.at)"""
ASSIGNED = f"""{PIVOTS}, S AS (SELECT id, chunk, list_slice(v, chunk * {WIDTH} + 1, chunk * {WIDTH} + {WIDTH}) AS part FROM V, C),
    A AS (SELECT id, chunk, part, centroid FROM (SELECT S.id, S.chunk, part, centroid, row_number() OVER (PARTITION BY S.id, S.chunk ORDER BY {sql_l2('part', 'center')}, centroid) AS n FROM S JOIN P ON S.chunk = P.chunk) WHERE n = 1)"""
ADC = f"""{ASSIGNED}, {Q}, T AS (SELECT qid, chunk, centroid, {sql_l2(f'list_slice(qv, chunk * {WIDTH} + 1, chunk * {WIDTH} + {WIDTH})', 'center')} AS distance FROM Q, P),
    far AS (SELECT T.qid, A.id, list_reduce(list(T.distance ORDER BY T.chunk), lambda p, q: p + q) AS distance FROM T JOIN A ON T.chunk = A.chunk AND T.centroid = A.centroid GROUP BY T.qid, A.id),
    {_topk('far', L_POOL, 'pool')}"""
TWO_STAGE = f"{ADC}, again AS (SELECT pool.qid, pool.id, {sql_l2('qv', 'v')} AS distance FROM pool JOIN Q ON pool.qid = Q.qid JOIN V ON pool.id = V.id), {_topk('again', K)}"
# an exhaustive walk over a connected graph visits, compares and measures every row once
WALKS = f"{V}, {Q}, walks AS (SELECT qid, 'third ' || (qid // 50 % 3) AS approx_kind, (SELECT count(*) FROM V) AS n FROM Q)"
RUNS = f"WITH {WALKS} SELECT approx_kind, count(*) AS queries, sum(n)::BIGINT AS n_hops, sum(n)::BIGINT AS n_cmps, sum(n)::BIGINT AS exact_evals, false AS range_stop"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- sources and sinks ----------------------------------------------------
def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.posexplode("vector").alias("pos", "x")).select("id", "pos", F.col("x").cast("double").alias("x"))


def _sql_components(value: str) -> str:
    return f"SELECT id, (p - 1)::INTEGER AS pos, ({value})::DOUBLE AS x FROM (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS id, unnest(embedding) AS e, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)"


def _round_trip(spark: SparkSession, d: str, kind: str, column=None) -> DataFrame:
    path = new_path(spark, kind)
    rows = base_of(spark, d).select("id", "vector")
    rows = rows.withColumn("vector", column(F.col("vector"))) if column else rows
    files.write_vectors(rows, path, kind)
    return _exploded(files.read_vectors(spark, path, kind))


@query(_sql_components("e"))
def source_text(spark, d):
    """Write and read a text file of vectors."""
    path = new_path(spark, "text")
    files.write_text(base_of(spark, d), path)
    return _exploded(files.read_text(spark, path))


@query(_sql_components("e"))
def source_fvecs(spark, d):
    """Write and read float rows."""
    return _round_trip(spark, d, "fvecs")


@query(_sql_components("floor((e::DOUBLE + 1.0) * 127.0)"))
def source_bvecs(spark, d):
    """Write and read byte rows."""
    return _round_trip(spark, d, "bvecs", lambda v: F.transform(v, lambda x: F.floor((x.cast("double") + 1.0) * 127.0).cast("float")))


@query(_sql_components("e"))
def source_bin(spark, d):
    """Write and read a counted file."""
    return _round_trip(spark, d, "bin")


@query("SELECT i::BIGINT AS id, round(cos(2 * pi() * i / 12.0), 6) + 0.0 AS x, round(sin(2 * pi() * i / 12.0), 6) + 0.0 AS y, i / 10.0::DOUBLE AS z FROM (SELECT unnest(range(0, 12)) AS i)")
def toy_vectors(spark, d):
    """The generated circle."""
    v = files.toy_vectors(spark, 12)
    return v.select("id", (F.round(F.col("vector")[0], 6) + 0.0).alias("x"), (F.round(F.col("vector")[1], 6) + 0.0).alias("y"), F.col("vector")[2].alias("z"))


@query(f"{TOP} SELECT (dense_rank() OVER (ORDER BY qid) - 1)::BIGINT AS qid, rank, id FROM top")
def ground_truth_text_roundtrip(spark, d):
    """True neighbours written as lines of ids and read back."""
    path = new_path(spark, "truth")
    files.write_truth(exact.nearest(base_of(spark, d), queries_of(spark, d), K), path)
    return files.read_truth(spark, path)


def _walks(spark, d):
    """Results and counters of an exhaustive walk, the runs of three settings standing for thirds of the queries."""
    found = saved(_exhaustive(spark, d), "walks")
    return found, found.filter("rank = 1").withColumn("approx_kind", F.concat(F.lit("third "), (F.col("qid") / 50).cast("long") % 3))


def _walks_and_truth(spark, d):
    """Results and counters of ``_walks``, and the truth as a saved table: its search needs no graph and runs beside that of the graph."""
    ship(spark)
    shared_folder(spark)
    with ThreadPoolExecutor(1) as beside:
        truth = beside.submit(inheritable_thread_target(spark)(lambda: saved(exact.nearest(base_of(spark, d), queries_of(spark, d), K), "truth")))
        found, walks = _walks(spark, d)
        return found, walks, truth.result()


def _folded(walks):
    return bench.accumulate(walks, ["approx_kind"], ["n_hops", "n_cmps", "exact_evals", "range_stop"])


def _runs(spark, d):
    found, walks, truth = _walks_and_truth(spark, d)
    recall = exact.recall(found, truth, K)
    rest = walks.join(recall, "qid").groupBy("approx_kind").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("recall"), 6).alias("average_recall"))
    return _folded(walks).join(rest, "approx_kind")


@query(f"{RUNS}, 1.0::DOUBLE AS average_recall FROM walks GROUP BY approx_kind")
def bench_tsv_roundtrip(spark, d):
    """A summary written as a tab-separated file and read by its header."""
    path = new_path(spark, "tsv")
    rows = _runs(spark, d).select("approx_kind", F.lit(K).alias("top_k"), F.lit(4).alias("beam_width"), F.lit(12).alias("l_search"), "queries", *[F.lit(1.5).alias(c) for c in bench.TIME_COLUMNS], "n_hops", "n_cmps", "exact_evals", "range_stop", "average_recall")
    bench.write_tsv(rows, path)
    return bench.read_tsv(spark, path).select("approx_kind", "queries", "n_hops", "n_cmps", "exact_evals", (F.col("range_stop") == 1).alias("range_stop"), "average_recall")


# --- distances and quantisation -------------------------------------------
@query(f"WITH {V}, {Q}, {PAIRS} SELECT qid, id, distance FROM pairs")
def l2_pairwise(spark, d):
    """Distances of the query set to all rows, block by block."""
    base = base_of(spark, d)
    return exact.nearest(base, queries_of(spark, d), max(1, base.count())).select("qid", "id", "distance")


@query(f"WITH {V}, {Q}, pairs AS (SELECT qid, id, list_reduce(list_transform(list_zip(qv, v), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE)), lambda p, q: p + q) AS distance FROM Q, V), {_topk('pairs', K)} {TOP_ROWS}")
def search_custom_distance(spark, d):
    """Exact search with the sum of absolute differences as distance."""

    def manhattan(queries: np.ndarray, base: np.ndarray) -> np.ndarray:
        total = np.zeros((len(queries), len(base)))
        for i in range(base.shape[1]):
            total += np.abs(queries[:, i][:, None] - base[:, i][None])
        return total

    return exact.nearest(base_of(spark, d), queries_of(spark, d), K, kernel=manhattan)


def _pivots(spark, d):
    return pq.pivot_array(pq.train_init(base_of(spark, d), CHUNKS, CENTROIDS))


@query(f"WITH {PIVOTS} SELECT chunk::INTEGER AS chunk, centroid::INTEGER AS centroid, (p - 1)::INTEGER AS pos, x::DOUBLE AS x FROM (SELECT chunk, centroid, unnest(center) AS x, unnest(range(1, len(center) + 1)) AS p FROM P)")
def pq_train_init(spark, d):
    """First centroids of every chunk."""
    return pq.train_init(base_of(spark, d), CHUNKS, CENTROIDS).select("chunk", "centroid", F.posexplode("center").alias("pos", "x"))


@query(f"""WITH {ASSIGNED}, parts AS (SELECT chunk, centroid, unnest(part) AS x, unnest(range(1, len(part) + 1)) AS p FROM A),
    means AS (SELECT chunk, centroid, p, avg(x::DOUBLE) AS x FROM parts GROUP BY ALL)
    SELECT P.chunk::INTEGER AS chunk, P.centroid::INTEGER AS centroid, (P.p - 1)::INTEGER AS pos, round(coalesce(means.x, P.x::DOUBLE), 5) AS x
    FROM (SELECT chunk, centroid, unnest(center) AS x, unnest(range(1, len(center) + 1)) AS p FROM P) P LEFT JOIN means ON P.chunk = means.chunk AND P.centroid = means.centroid AND P.p = means.p""")
def pq_train_lloyd1(spark, d):
    """Centroids after one step."""
    pivots, _ = pq.lloyd_step(base_of(spark, d), _pivots(spark, d))
    return pq.pivot_frame(spark, pivots).select("chunk", "centroid", F.posexplode("center").alias("pos", "x")).withColumn("x", F.round("x", 5))


@query()
def pq_train(spark, d):
    """Inertia before each training step."""
    _, costs = pq.train(base_of(spark, d), CHUNKS, CENTROIDS)
    return spark.createDataFrame(list(enumerate(costs)), "step int, inertia double")


@query(f"WITH {ASSIGNED} SELECT id, string_agg(centroid::VARCHAR, ',' ORDER BY chunk) AS codes FROM A GROUP BY id")
def pq_encode(spark, d):
    """Codes of every row."""
    return pq.encode(base_of(spark, d), _pivots(spark, d)).select("id", _ints("codes"))


@query(f"WITH {ADC} SELECT qid, chunk::INTEGER AS chunk, centroid::INTEGER AS centroid, distance FROM T")
def pq_adc_table(spark, d):
    """Lookup tables of the query set."""
    return pq.adc_tables(queries_of(spark, d), _pivots(spark, d))


def _adc(spark, d, l):
    base, pivots = base_of(spark, d), _pivots(spark, d)
    return base, pivots, pq.encode(base, pivots), l


@query(f"WITH {ADC} SELECT qid, rank, id, distance FROM pool")
def pq_adc_topk(spark, d):
    """The pool by approximate distance."""
    _, pivots, codes, l = _adc(spark, d, L_POOL)
    return pq.adc_search(codes, queries_of(spark, d), pivots, l)


@query(f"""WITH {V} SELECT 'center width' AS problem, {CENTROIDS}::BIGINT AS rows UNION ALL SELECT 'number of codes', count(*) FILTER (WHERE id % 7 = 0) FROM V
    UNION ALL SELECT 'code range', count(*) FILTER (WHERE id % 7 <> 0 AND id % 5 = 0) FROM V""")
def pq_validate(spark, d):
    """Rules of pivots and codes, on tables with short centres, missing codes and codes out of range."""
    base, pivots = base_of(spark, d), _pivots(spark, d)
    centres = pq.pivot_frame(spark, pivots).withColumn("center", F.when(F.col("chunk") == 1, F.slice("center", 1, WIDTH - 1)).otherwise(F.col("center")))
    wild = F.concat(F.array(F.lit(CENTROIDS).cast("smallint")), F.slice("codes", 2, CHUNKS - 1))
    codes = pq.encode(base, pivots).withColumn("codes", F.when(F.col("id") % 7 == 0, F.slice("codes", 1, CHUNKS - 1)).when(F.col("id") % 5 == 0, wild).otherwise(F.col("codes")))
    return pq.validate(centres, codes)


# --- graphs -----------------------------------------------------------------
def _graph(spark, d, degree=DEGREE, dense=0):
    return graph.knn_graph(base_of(spark, d), degree, dense, kept=True)


@query(f"WITH {EDGES} SELECT src, dst, (rank - 1)::INTEGER AS pos FROM E")
def knn_graph(spark, d):
    """Exact nearest others of every node."""
    return graph.edges(graph.knn_graph(base_of(spark, d), DEGREE))


def _dense(spark, d):
    """Nearest four as base neighbours, the even places among all as dense ones."""
    g = _graph(spark, d)
    return g.select("id", F.slice("nbrs", 1, 4).alias("nbrs"), F.filter("nbrs", lambda x, i: i % 2 == 0).alias("dense_nbrs"))


@query(f"WITH {EDGES} SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY rank) AS nbrs FROM E WHERE rank <= 4 OR rank % 2 = 1 GROUP BY src")
def flat_graph(spark, d):
    """Base neighbours, then dense ones not seen before."""
    return graph.flat_graph(_dense(spark, d)).select("id", _ints("nbrs"))


@query(f"WITH {EDGES} SELECT dst AS id, string_agg(src::VARCHAR, ',' ORDER BY src) AS nbrs FROM E GROUP BY dst")
def reverse_graph(spark, d):
    """Who points at each node."""
    return graph.reverse_graph(_graph(spark, d)).select("id", _ints("nbrs"))


@query(f"""WITH {V}, n AS (SELECT count(*) FILTER (WHERE id % 11 = 0) AS wide, count(*) FILTER (WHERE id % 11 = 1) AS dense, count(*) FILTER (WHERE id % 11 = 2) AS far,
        count(*) FILTER (WHERE id % 11 = 3) AS own, count(*) FILTER (WHERE id % 11 = 4) AS twice FROM V)
    SELECT 'degree' AS problem, wide AS nodes FROM n UNION ALL SELECT 'dense degree', dense FROM n UNION ALL SELECT 'id range', far FROM n UNION ALL SELECT 'self edge', own FROM n UNION ALL SELECT 'repeated edge', twice FROM n""")
def graph_validate(spark, d):
    """Rules of a graph, on one whose nodes break them in turn."""
    n, at = base_of(spark, d).count(), F.col("id") % 11
    few = F.slice("nbrs", 1, 3)
    nbrs = F.when(at == 0, F.slice("nbrs", 1, 5)).when(at == 2, F.concat(few, F.array(F.lit(n).cast("long")))).when(at == 3, F.concat(few, F.array("id"))).when(at == 4, F.concat(few, F.slice("nbrs", 1, 1))).otherwise(F.slice("nbrs", 1, 4))
    dense = F.when(at == 1, F.slice("nbrs", 5, 4)).otherwise(F.slice("nbrs", 5, 2))
    return graph.validate(_graph(spark, d).select("id", nbrs.alias("nbrs"), dense.alias("dense_nbrs")), n, 4, 2)


@query(f"WITH {EDGES} SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY part, rank) AS nbrs FROM (SELECT *, 0 AS part FROM E WHERE rank <= 4 UNION ALL SELECT *, 1 FROM E WHERE rank % 2 = 1) GROUP BY src")
def copied_neighbours(spark, d):
    """Base neighbours with dense ones behind them, repeats and all."""
    return graph.copied_neighbours(_dense(spark, d)).select("id", _ints("nbrs"))


REFINE_POOL, REFINE_MOST = 20, 3


@query(f"""WITH {V}, {Q}, {PAIRS}, {_topk('pairs', REFINE_POOL, 'asked')}, hubs AS (SELECT qid, id AS hub FROM asked WHERE rank = 1),
    counted AS (SELECT hub, id, count(*)::INTEGER AS eh, min(rank) AS near FROM asked JOIN hubs USING (qid) WHERE rank > 1 GROUP BY hub, id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY eh DESC, near, id) AS place FROM counted)
    SELECT hub AS id, string_agg(id::VARCHAR, ',' ORDER BY place) AS nbrs, string_agg(eh::VARCHAR, ',' ORDER BY place) AS ehs FROM placed WHERE place <= {REFINE_MOST} GROUP BY hub""")
def refine_edges(spark, d):
    """Edges that training queries ask for, and how many ask."""
    return graph.refine_edges(base_of(spark, d), queries_of(spark, d), REFINE_MOST, REFINE_POOL).select("id", _ints("nbrs"), _ints("ehs"))


@query(f"WITH {V} SELECT id, total FROM (SELECT a.id, round(sum({sql_l2('a.v', 'b.v')}), 6) AS total FROM V a, V b GROUP BY a.id) ORDER BY total, id LIMIT 1")
def medoid(spark, d):
    """The most central row."""
    return graph.medoid(base_of(spark, d))


@query(f"""WITH RECURSIVE {EDGES}, R(id, level) AS (SELECT 0::BIGINT, 0 UNION SELECT E.dst, R.level + 1 FROM R JOIN E ON R.id = E.src WHERE R.level < 12)
    SELECT id, min(level)::INTEGER AS level FROM R GROUP BY id""")
def bfs_levels(spark, d):
    """Distance in hops from node 0 of all nodes within reach; the SQL ends after twelve hops, beyond which tests hold it against brute force."""
    return graph.bfs_levels(_graph(spark, d), 0)


@query()
def rng_prune_graph(spark, d):
    """A pruned navigable graph; invariants are tested."""
    return graph.edges(graph.pruned_graph(base_of(spark, d), DEGREE, 32))


# --- page layouts -------------------------------------------------------------
def _layout(spark, d):
    g = _graph(spark, d)
    return g, layout.replicated_layout(g, CAPACITY)


@query(f"WITH {LAYOUT} SELECT page_id, slot::INTEGER AS slot, node_id FROM L")
def replicated_layout(spark, d):
    """Each node with its nearest on a page."""
    return _layout(spark, d)[1]


@query(f"WITH {LAYOUT} SELECT page_id, slot::INTEGER AS slot, node_id FROM L")
def index_roundtrip(spark, d):
    """A layout written with its graph and vectors, and read back."""
    path = new_path(spark, "index")
    base = base_of(spark, d)
    made = build_index(base, path, BuildConfig(degree=DEGREE, page_nodes=CAPACITY, pq_subspaces=CHUNKS, pq_centroids=CENTROIDS, pq_iterations=1, entry=0), pruned=False)
    return made.layout.select("page_id", "slot", "node_id")


@query()
def ldg_layout(spark, d):
    """A greedy partition; invariants are tested."""
    return layout.ldg_layout(_graph(spark, d), CAPACITY, scale=1.0)


@query(f"WITH {LAYOUT} SELECT node_id, min(page_id) AS page_id FROM L GROUP BY node_id")
def id_to_page(spark, d):
    """The first page of each node."""
    return layout.id_to_page(_layout(spark, d)[1])


@query(f"WITH {LAYOUT}, n AS (SELECT page_id, count(*) AS held FROM L GROUP BY page_id) SELECT page_id, (sum(held) OVER (ORDER BY page_id) - held)::BIGINT AS begin, (sum(held) OVER (ORDER BY page_id))::BIGINT AS \"end\" FROM n")
def reorder_offsets(spark, d):
    """Where each page's ids begin and end."""
    return layout.reorder_offsets(_layout(spark, d)[1])


@query(f"""WITH {LAYOUT}, shifted AS (SELECT page_id, slot, node_id FROM L WHERE slot > 0 UNION ALL SELECT page_id, 9, node_id FROM L), own AS (SELECT id AS page_id, -1 AS slot, id AS node_id FROM V),
    first AS (SELECT page_id, node_id, min(slot) AS slot FROM (SELECT * FROM own UNION ALL SELECT * FROM shifted) GROUP BY ALL)
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY slot, node_id) - 1)::INTEGER AS slot, node_id FROM first""")
def layout_normalize(spark, d):
    """Pages put in order again after their first slot was lost and all nodes were repeated."""
    _, pages = _layout(spark, d)
    broken = pages.filter("slot > 0").unionByName(pages.withColumn("slot", F.lit(9)))
    return layout.normalize(broken, base_of(spark, d))


_PAGES = f"{LAYOUT}, deg AS (SELECT src, count(*) AS degree, min_by(dst, rank) AS first_nbr FROM E GROUP BY src)"


def _materialized(spark, d):
    g, pages = _layout(spark, d)
    return layout.materialize(pages, g, base_of(spark, d))


@query(f"WITH {_PAGES} SELECT page_id, string_agg(node_id::VARCHAR, ',' ORDER BY slot) AS nodes, sum(degree)::BIGINT AS edges, (SELECT v[1]::DOUBLE FROM V WHERE V.id = page_id) AS target_x FROM L JOIN deg ON deg.src = node_id GROUP BY page_id")
def page_materialize(spark, d):
    """Pages with target vector and adjacency."""
    pages = _materialized(spark, d)
    total = F.aggregate("nodes", F.lit(0).cast("long"), lambda s, x: s + F.size(x["nbrs"]))
    return pages.select("page_id", F.concat_ws(",", F.transform("nodes", lambda x: x["node_id"].cast("string"))).alias("nodes"), total.alias("edges"), F.col("target")[0].cast("double").alias("target_x"))


@query(f"WITH {_PAGES} SELECT page_id, slot::INTEGER AS slot, node_id, degree::INTEGER AS degree, first_nbr FROM L JOIN deg ON deg.src = node_id")
def inspect_page(spark, d):
    """Every slot of every page."""
    return layout.inspect_pages(_materialized(spark, d))


@query(f"""WITH {V}, n AS (SELECT count(*) FILTER (WHERE id % 10 = 0) AS again, count(*) FILTER (WHERE id % 10 = 1) AS far, count(*) FILTER (WHERE id % 10 = 2) AS wide FROM V)
    SELECT 'repeated in page' AS problem, again AS rows FROM n UNION ALL SELECT 'id range', far FROM n UNION ALL SELECT 'over capacity', again + far + wide FROM n""")
def layout_validate(spark, d):
    """Rules of a layout, on one with repeated, unknown and too many nodes in some pages."""
    n = base_of(spark, d).count()
    g, pages = _layout(spark, d)
    more = F.when(F.col("id") % 10 == 0, F.col("id")).when(F.col("id") % 10 == 1, F.lit(n).cast("long")).when(F.col("id") % 10 == 2, F.element_at("nbrs", CAPACITY))
    added = g.select(F.col("id").alias("page_id"), F.lit(CAPACITY).alias("slot"), more.alias("node_id")).filter("node_id IS NOT NULL")
    return layout.validate(pages.unionByName(added), n, CAPACITY)


@query(f"WITH {LAYOUT} SELECT 'layouts differ' AS problem, 2 * count(*) AS rows FROM L WHERE page_id = 0 AND slot > 0 UNION ALL SELECT 'page without node', 0::BIGINT UNION ALL SELECT 'offsets step back', 0::BIGINT")
def sidecar_validate(spark, d):
    """A sidecar with one page in another order against its layout."""
    _, pages = _layout(spark, d)
    pages = saved(pages, "pages")
    other = pages.withColumn("slot", F.when((F.col("page_id") == 0) & (F.col("slot") > 0), F.col("slot") + 10).otherwise(F.col("slot")))
    return layout.validate_sidecar(pages, other, layout.id_to_page(pages), layout.reorder_offsets(pages))


# --- search -------------------------------------------------------------------
@query(f"{TOP} {TOP_ROWS}")
def ground_truth_topk(spark, d):
    """Exact nearest rows of the query set."""
    return exact.nearest(base_of(spark, d), queries_of(spark, d), K)


def _walkable(spark, d, **marks):
    """The flat graph of 16 nearest and reverse edges; ``marks`` are the columns of a filter, with which dense neighbours come."""
    rows = base_of(spark, d).withColumns(marks)
    return beam.load(_graph(spark, d, 16, 32 if marks else 0), rows, **{name: name for name in marks}, reverse=True)


_FOUND = ("qid", "rank", "id", "distance")


def _exhaustive(spark, d):
    flat = _walkable(spark, d)
    return beam.search(flat, queries_of(spark, d), 0, SearchConfig(top_k=K, l_search=len(flat.ids)))


@query(f"{TOP} {TOP_ROWS}")
def beam_search_exhaustive(spark, d):
    """A walk with a pool of all rows, which equals exact search."""
    return _exhaustive(spark, d).select(*_FOUND)


@query()
def beam_search(spark, d):
    """A walk with a bounded pool; recall is tested."""
    return beam.search(_walkable(spark, d), queries_of(spark, d), 0, SearchConfig(top_k=K, l_search=64))


@query(f"{TOP} {TOP_ROWS}")
def frontier_search(spark, d):
    """The join-based walk for graphs beyond one worker, exhaustive here."""
    base = base_of(spark, d)
    n, g = base.count(), saved(graph.with_reverse(_graph(spark, d, 16)), "walkable")
    return beam.frontier_search(g, base, queries_of(spark, d), 0, SearchConfig(top_k=K, l_search=n, beam_width=n))


@query(f"WITH {TWO_STAGE} {TOP_ROWS}")
def two_stage_topk(spark, d):
    """Approximate pool, exact rerank."""
    base, pivots, codes, l = _adc(spark, d, L_POOL)
    return pq.two_stage_search(base, codes, queries_of(spark, d), pivots, K, l)


@query(f"WITH {V}, {Q}, {PAIRS}, near AS (SELECT * FROM pairs WHERE distance <= {RADIUS}), {_topk('near', L_SEARCH)} {TOP_ROWS}")
def range_search(spark, d):
    """Rows within a squared radius."""
    return exact.range_search(base_of(spark, d), queries_of(spark, d), RADIUS, L_SEARCH)


@query(FILTERED)
def filter_pre(spark, d):
    """Filter, then search."""
    return exact.prefilter_search(base_of(spark, d), queries_of(spark, d), exact.LabelOr(LABELS), K)


@query(f"WITH {V}, {Q}, {PAIRS}, {_topk('pairs', L_POOL, 'pool')}, members AS (SELECT pool.qid, pool.id, pool.distance FROM pool JOIN V ON pool.id = V.id WHERE label IN (1, 2)), {_topk('members', K)} {TOP_ROWS}")
def filter_post(spark, d):
    """Search a pool, then filter."""
    return exact.postfilter_search(base_of(spark, d), queries_of(spark, d), exact.LabelOr(LABELS), K, L_POOL)[0]


@query(FILTERED)
def filter_in(spark, d):
    """Filter within an exhaustive walk."""
    flat = _walkable(spark, d, member=F.col("label").isin(LABELS))
    return beam.search(flat, queries_of(spark, d), 0, SearchConfig(top_k=K, l_search=len(flat.ids)), in_filter=True).select(*_FOUND)


SELECTOR = exact.LabelOr(LABELS, buckets=6)
BLOCK_ROWS = 16


@query(FILTERED)
def filter_in_approximate(spark, d):
    """Filter within an exhaustive walk that admits by an approximate check and verifies in the end."""
    flat = _walkable(spark, d, member=SELECTOR.predicate(), maybe=SELECTOR.approximate())
    return beam.search(flat, queries_of(spark, d), 0, SearchConfig(top_k=K, l_search=len(flat.ids)), in_filter=True).select(*_FOUND)


@query("SELECT vec_id AS id, label FROM embeddings WHERE label IN (1, 2)")
def filter_attributes(spark, d):
    """The same selector on a map from keys to lists of labels."""
    rows = base_of(spark, d).withColumn("attributes", F.create_map(F.lit(7), F.array(F.col("label").cast("long"))))
    return rows.filter(exact.LabelOr(LABELS, "attributes", key=7, buckets=6).predicate()).select("id", "label")


_S = f"""S AS (SELECT avg((label IN (1, 2))::INTEGER::DOUBLE) AS s, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE label IN (1, 2)))::DOUBLE / count(*) FILTER (WHERE label % 6 IN (1, 2)) AS p,
    count(*) FILTER (WHERE label IN (1, 2)) // {BLOCK_ROWS} AS pre, count(*) FILTER (WHERE label % 6 IN (1, 2)) // {8 * BLOCK_ROWS} AS within FROM embeddings)"""
_EQ = f"CASE WHEN s * {2 * DEGREE} / p <= {DEGREE} THEN {L_SEARCH} / s * {DEGREE} / {2 * DEGREE} ELSE {L_SEARCH} / p END"


@query(f"WITH {_S} SELECT s AS selectivity, p AS \"precision\", pre AS prefilter_reads, within AS infilter_reads FROM S")
def filter_estimates(spark, d):
    """What the selector estimates: its share of rows, the precision of its approximate check, and reads."""
    found = SELECTOR.estimates(base_of(spark, d), BLOCK_ROWS)
    return spark.createDataFrame([tuple(found.values())], "selectivity double, precision double, prefilter_reads long, infilter_reads long")


def _costs(spark, d):
    base = base_of(spark, d)
    n, found = base.count(), SELECTOR.estimates(base, BLOCK_ROWS)
    return n, filter_costs(found["selectivity"], found["precision"], found["prefilter_reads"], found["infilter_reads"], SearchConfig(top_k=K, l_search=L_SEARCH), n, DEGREE, 2 * DEGREE)


@query(f"""WITH {_S} SELECT 'pre' AS mode, (10 * (pre + {L_SEARCH}) + floor(s * n))::BIGINT AS cost FROM S
    UNION ALL SELECT 'in', (10 * floor(within + {_EQ}) + floor(({_EQ}) * ({DEGREE} + 0.05::DOUBLE * {2 * DEGREE})))::BIGINT FROM S
    UNION ALL SELECT 'post', (10 * floor({L_SEARCH} / s) + floor({DEGREE * L_SEARCH} / s))::BIGINT FROM S""")
def filter_plan_costs(spark, d):
    """Estimated cost of each filter mode."""
    _, costs = _costs(spark, d)
    return spark.createDataFrame([(m.value, c) for m, c in costs.items()], "mode string, cost long")


@query(FILTERED)
def filter_auto(spark, d):
    """The cheapest mode by the cost model, with pools wide enough to be exact."""
    n, costs = _costs(spark, d)
    mode = choose_filter_mode(costs)
    if mode is FilterMode.PRE:
        return filter_pre(spark, d)
    if mode is FilterMode.IN:
        return filter_in(spark, d)
    return exact.postfilter_search(base_of(spark, d), queries_of(spark, d), exact.LabelOr(LABELS), K, n)[0]


@query("SELECT vec_id AS id, label FROM embeddings WHERE label IN (1, 2)")
def filter_label_or(spark, d):
    """The rows that the selector admits."""
    base = base_of(spark, d)
    return base.filter(exact.LabelOr(LABELS).predicate()).select("id", "label")


@query(f"WITH {V}, {Q}, {PAIRS}, {_topk('pairs', L_POOL, 'pool')} SELECT qid, count(*) AS accessed, count(*) FILTER (WHERE label NOT IN (1, 2)) AS false_positives FROM pool JOIN V USING (id) GROUP BY qid")
def filter_false_positives(spark, d):
    """How many of a pool the filter drops."""
    _, marked = exact.postfilter_search(base_of(spark, d), queries_of(spark, d), exact.LabelOr(LABELS), K, L_POOL)
    return marked.groupBy("qid").agg(F.count(F.lit(1)).alias("accessed"), F.sum((~F.col("member")).cast("long")).alias("false_positives"))


@query(f"WITH {ADC} SELECT qid, rank, id, distance FROM pool WHERE rank <= 20")
def warm_start_seeds(spark, d):
    """Seeds over all rows by approximate distance."""
    _, pivots, codes, _ = _adc(spark, d, L_POOL)
    return pq.warm_start(codes, queries_of(spark, d), pivots, 20, L_POOL)


@query(f"WITH {TWO_STAGE}, joint AS (SELECT qid, id, min(distance) AS distance FROM (SELECT qid, id, distance FROM pool UNION ALL SELECT qid, id, distance FROM top) GROUP BY qid, id), {_topk('joint', 40, 'merged')} SELECT qid, rank, id, distance FROM merged")
def pool_merge(spark, d):
    """Two pools as one, the smaller distance of each id."""
    base, pivots, codes, l = _adc(spark, d, L_POOL)
    pool = saved(pq.adc_search(codes, queries_of(spark, d), pivots, l), "pool")
    top = exact.rerank(pool, base, queries_of(spark, d), K)
    return exact.pool_merge(pool.select("qid", "id", "distance").unionByName(top.select("qid", "id", "distance")), 40)


_BUDGET = 20_000


@query(f"""WITH {LAYOUT}, deg AS (SELECT src, 56 + 4 * count(*) AS bytes FROM E GROUP BY src),
    first AS (SELECT node_id, page_id, slot FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY page_id, slot) AS n FROM L) WHERE n = 1),
    summed AS (SELECT node_id, row_number() OVER (ORDER BY page_id, slot) AS place, bytes, sum(bytes) OVER (ORDER BY page_id, slot) AS upto FROM first JOIN deg ON src = node_id)
    SELECT node_id, place::INTEGER AS place, bytes::BIGINT AS bytes FROM summed WHERE upto <= {_BUDGET}""")
def graph_cache_page_layout(spark, d):
    """What a byte budget keeps, in page order."""
    g, pages = _layout(spark, d)
    return beam.cache_page_layout(pages, g, _BUDGET)


@query()
def graph_cache_entry_bfs(spark, d):
    """What a byte budget keeps, breadth first by page; the budget is tested."""
    g, pages = _layout(spark, d)
    held = beam.cache_entry_bfs(pages, beam.load(g, base_of(spark, d)), 0, _BUDGET)
    return spark.createDataFrame([(n, i + 1, b) for i, (n, b) in enumerate(held)], "node_id long, place int, bytes long")


# --- experiments ----------------------------------------------------------------
_RECALL = f"{TWO_STAGE}, {PAIRS}, {_topk('pairs', K, 'truth')}, hits AS (SELECT truth.qid, count(top.id) / count(*)::DOUBLE AS recall FROM truth LEFT JOIN top ON truth.qid = top.qid AND truth.id = top.id GROUP BY truth.qid)"


def _found_and_truth(spark, d, l=L_POOL):
    base, pivots, codes, _ = _adc(spark, d, l)
    queries = queries_of(spark, d)
    return saved(pq.two_stage_search(base, codes, queries, pivots, K, l), "found"), exact.nearest(base, queries, K)


@query(f"WITH {_RECALL} SELECT qid, recall FROM hits")
def recall_at_k(spark, d):
    """Recall of the two-stage search."""
    return exact.recall(*_found_and_truth(spark, d), K)


@query(f"{TOP} SELECT qid, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids FROM top GROUP BY qid")
def result_ids_string(spark, d):
    """Result ids in one string."""
    return exact.result_ids(ground_truth_topk(spark, d))


@query(f"{RUNS} FROM walks GROUP BY approx_kind")
def stats_accumulate(spark, d):
    """Counters of walks folded by sum and or."""
    _, walks = _walks(spark, d)
    return _folded(walks).join(walks.groupBy("approx_kind").agg(F.count(F.lit(1)).alias("queries")), "approx_kind")


@query(f"WITH {WALKS}, {PAIRS}, {_topk('pairs', K)} SELECT (SELECT count(*) FROM walks) AS queries, (SELECT sum(n) FROM walks)::BIGINT AS n_hops, (SELECT sum(n) FROM walks)::BIGINT AS n_cmps, (SELECT sum(n) FROM walks)::BIGINT AS exact_evals, 1.0::DOUBLE AS average_recall, (SELECT string_agg(id::VARCHAR, ',' ORDER BY rank) FROM top WHERE qid = (SELECT min(qid) FROM top)) AS first_query_result_ids")
def bench_summary(spark, d):
    """One row for a run: its queries' counters, mean recall and the first query's ids."""
    found, _, truth = _walks_and_truth(spark, d)
    return bench.bench_summary(found, truth, K).select("queries", "n_hops", "n_cmps", "exact_evals", "average_recall", "first_query_result_ids")


_GRID = Sweep(
    SearchConfig(top_k=4),
    values={"kind": [DistanceKind.FULL, DistanceKind.PQ], "beam_width": [2, 3], "l_search": [6], "graph_cache_budget_bytes": [0, 8192], "graph_cache_policy": [CachePolicy.ENTRY_BFS], "refine_k": [4], "defer_exact_until_refinement": [False, True], "scheduler_policy": [SchedulerPolicy.CONSERVATIVE, SchedulerPolicy.BOUNDED], "dynamic_beam_policy": [BeamPolicy.FIXED]},
)


@query("""SELECT (row_number() OVER (ORDER BY k, b, g, f, s) - 1)::BIGINT AS run, CASE k WHEN 0 THEN 'full' ELSE 'pq' END AS kind, (b + 2)::BIGINT AS beam_width, 6::BIGINT AS l_search, (g * 8192)::BIGINT AS graph_cache_budget_bytes,
    'entry_bfs' AS graph_cache_policy, 4::BIGINT AS refine_k, 0.0::DOUBLE AS refine_ratio, f = 1 AS defer_exact_until_refinement, CASE s WHEN 0 THEN 'conservative' ELSE 'bounded' END AS scheduler_policy, 0::BIGINT AS scheduler_policy_limit, 'fixed' AS dynamic_beam_policy
    FROM (SELECT unnest([0, 1]) AS k), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS g), (SELECT unnest([0, 1]) AS f), (SELECT unnest([0, 1]) AS s)""")
def sweep_grid(spark, d):
    """Every combination of a sweep's values."""
    return bench.sweep_grid(spark, _GRID)


def _sql_sweep() -> str:
    pools = ", ".join(f"pool{l} AS (SELECT * FROM ranked WHERE rank <= {l}), again{l} AS (SELECT p.qid, p.id, p.exact AS distance FROM pool{l} p), {_topk(f'again{l}', K, f'top{l}')}" for l in (10, 50, 100))
    parts = " UNION ALL ".join(f"SELECT {l} AS l_search, (SELECT round(avg(r), 6) FROM (SELECT count(t.id) / count(*)::DOUBLE AS r FROM truth LEFT JOIN top{l} t ON truth.qid = t.qid AND truth.id = t.id GROUP BY truth.qid)) AS average_recall" for l in (10, 50, 100))
    return f"WITH {ADC}, {PAIRS}, {_topk('pairs', K, 'truth')}, ranked AS (SELECT pool.qid, pool.id, pool.rank, pairs.distance AS exact FROM pool JOIN pairs ON pool.qid = pairs.qid AND pool.id = pairs.id), {pools} {parts}"


@query(_sql_sweep())
def sweep_recall(spark, d):
    """Mean recall of the two-stage search by pool size."""
    base, pivots, codes, _ = _adc(spark, d, L_POOL)
    queries = queries_of(spark, d)
    pool = saved(pq.adc_search(codes, queries, pivots, 100), "pool")
    truth = saved(exact.nearest(base, queries, K), "truth")
    out = None
    for l in (10, 50, 100):
        found = exact.rerank(pool.filter(F.col("rank") <= l), base, queries, K)
        row = exact.recall(found, truth, K).agg(F.round(F.avg("recall"), 6).alias("average_recall")).select(F.lit(l).alias("l_search"), "average_recall")
        out = row if out is None else out.unionByName(row)
    return out


_SUMS = "sum(n)::BIGINT AS n_hops, sum(n)::BIGINT AS n_cmps"


def _summed(walks, by):
    return bench.accumulate(walks.withColumn("approx_kind", by), ["approx_kind"], ["n_hops", "n_cmps"])


@query(f"WITH {WALKS} SELECT approx_kind, {K}::BIGINT AS top_k, {_SUMS} FROM walks GROUP BY approx_kind UNION ALL SELECT 'half ' || (qid // 50 % 2), NULL, {_SUMS} FROM walks GROUP BY ALL")
def bench_merge(spark, d):
    """Two summaries as one, a column missing in the second."""
    _, walks = _walks(spark, d)
    half = F.concat(F.lit("half "), (F.col("qid") / 50).cast("long") % 2)
    one = _summed(walks, F.col("approx_kind")).withColumn("top_k", F.lit(K).cast("long"))
    return bench.merge([one, _summed(walks, half)]).select("approx_kind", "top_k", "n_hops", "n_cmps")


@query(f"""WITH {WALKS}, a AS (SELECT approx_kind, {_SUMS} FROM walks WHERE qid % 100 = 0 GROUP BY approx_kind), b AS (SELECT approx_kind, {_SUMS} FROM walks GROUP BY approx_kind)
    SELECT b.approx_kind, a.n_hops AS baseline_n_hops, a.n_cmps AS baseline_n_cmps, b.n_hops AS candidate_n_hops, b.n_cmps AS candidate_n_cmps, b.n_hops - a.n_hops AS delta_n_hops, b.n_cmps - a.n_cmps AS delta_n_cmps
    FROM b JOIN a ON a.approx_kind = b.approx_kind""")
def bench_compare(spark, d):
    """Runs of all queries beside those of every second one."""
    _, walks = _walks(spark, d)
    kind = F.col("approx_kind")
    return bench.compare(_summed(walks.filter("qid % 100 = 0"), kind), _summed(walks, kind), ["n_hops", "n_cmps"], ["approx_kind"])


@query(f"WITH {LAYOUT} SELECT (SELECT count(*) FROM V) AS points, (SELECT max(len(v))::INTEGER FROM V) AS dim, (SELECT count(*) FROM E)::BIGINT AS edges, {DEGREE}::INTEGER AS max_degree, (SELECT count(DISTINCT page_id) FROM L) AS pages, {CAPACITY}::BIGINT AS max_page_nodes, (SELECT count(*) FROM L)::BIGINT AS stored_nodes")
def inspect_index(spark, d):
    """Sizes of an index."""
    g, pages = _layout(spark, d)
    return bench.inspect_index(base_of(spark, d), g, pages)


@query("SELECT page_id, lower(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g')) AS label FROM pages")
def sanitize_label(spark, d):
    """Page addresses as labels."""
    return table(spark, d, "pages").select("page_id", clean_label(F.col("url")).alias("label"))

