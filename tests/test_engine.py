"""Fixtures with known answers, invariants of stateful operators, and inputs that must be refused."""

import math
import shutil
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import queries, runtime
from lodestar.cli import main
from lodestar.functions.distance import block_l2, l2_squared
from lodestar.index import build_index, inspect_files, inspect_page, load_index
from lodestar.operators import beam, bench, exact, graph, layout, pq
from lodestar.plans import config as cfg
from lodestar.sources import vectors as files
from lodestar.streaming.queries import answer_stream

from .conftest import SMALL

TEXT = [[1, 0, 0], [0.8, 0.2, 0.1], [0, 1, 0.2], [-0.9, 0, 0.3], [0, -1, 0.4], [0.7, -0.1, 0], [0.6, 0.6, 0.1], [-0.6, 0.7, 0.2], [-0.8, -0.2, 0.3], [-0.2, -0.8, 0.4], [0.5, -0.7, 0.1], [0.9, -0.3, 0]]


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "id long, vector array<double>" + extra)


def asked(spark, *vectors):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "qid long, vector array<double>")


@pytest.fixture(scope="module")
def toy(spark):
    base = files.toy_vectors(spark, 12).cache()
    return base, graph.knn_graph(base, 4).cache()


def ids(df):
    return [r["id"] for r in df.orderBy("qid", "rank").collect()]


VARIANTS = [{}, {"defer_exact_until_refinement": True, "refine_k": 4}, {"mem_l": 4}, {"scheduler_policy": cfg.SchedulerPolicy.BOUNDED, "scheduler_policy_limit": 2, "dynamic_beam_policy": cfg.BeamPolicy.FIXED}]


@pytest.mark.parametrize("kind", ["full", "pq"])
@pytest.mark.parametrize("more", VARIANTS)
def test_toy_circle(spark, toy, kind, more):
    base, g = toy
    flat = beam.load(g, base) if kind == "full" else beam.encoded_graph(g, base, 3, 4)
    got = beam.search(flat, asked(spark, [0.95, 0.15, 0]), 0, cfg.SearchConfig(top_k=4, beam_width=3, l_search=8, **more))
    rows = got.collect()
    assert len(rows) == 4 and ids(got)[0] == 0
    assert all(r["n_cmps"] >= r["n_hops"] > 0 for r in rows)


def test_range_partial_stops_early(spark, toy):
    base, g = toy
    got = beam.search(beam.load(g, base), asked(spark, [0.95, 0.15, 0]), 0, cfg.SearchConfig(top_k=4, l_search=8, mem_l=1, range_partial=0.0))
    assert any(r["range_stop"] for r in got.collect()) or got.count() == 0


def test_bfs_levels_has_no_last_hop(spark, tmp_path):
    rows = [(i, [float(i)], 0) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    near = {i: sorted((j for j in range(80) if j != i), key=lambda j: (abs(i - j), j))[: queries.DEGREE] for i in range(80)}
    plain, ahead = {0: 0}, [0]
    for i in ahead:
        for j in near[i]:
            if j not in plain:
                plain[j] = plain[i] + 1
                ahead.append(j)
    assert max(plain.values()) > 12
    assert {r["id"]: r["level"] for r in queries.bfs_levels(spark, str(tmp_path)).collect()} == plain


def test_many_query_blocks(spark, monkeypatch):
    """Blocks of a few queries give the same rows, and a plan that doesn't grow with their number."""
    rng = np.random.default_rng(6)
    base = frame(spark, [(i, rng.normal(size=8).tolist()) for i in range(200)]).cache()
    wanted = base.select(F.col("id").alias("qid"), "vector")
    key = lambda df: sorted(map(tuple, df.collect()))
    one, centre = key(exact.nearest(base, wanted, 5, skip_self=True)), graph.medoid(base).first()
    monkeypatch.setattr(exact, "BLOCK_BYTES", 1 << 10)
    many = exact.nearest(base, wanted, 5, skip_self=True)
    assert key(many) == one and graph.medoid(base).first() == centre
    plan = many._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1 and plan.treeString().count("\n") < 10
    assert exact.nearest(base, wanted.limit(0), 5).count() == 0


def test_screened_search_equals_all_distances():
    """Copies, offsets far from zero, wide ranges, own rows and non-finite values: the first k of all distances, to the last bit."""
    rng = np.random.default_rng(8)
    near = rng.normal(size=(700, 6))
    near[100:400] = near[7]
    odd = near.copy()
    odd[5, 2], odd[9, 0] = np.nan, np.inf
    for base in (near, near * 1e-3 + 1e6, near * 10.0 ** rng.integers(-8, 9, (700, 1)), odd):
        ids, asked = rng.permutation(700), base[::9]
        for k, within, skip in ((1, None, False), (16, None, True), (16, 2.0, False), (128, None, True)):
            best = exact.Nearest(ids[::9], asked, k, within, skip)
            for i in range(0, 700, 290):
                best.add(ids[i : i + 290], base[i : i + 290])
            qid, rank, found, far = best.rows(0, len(asked))
            want = []
            for q, row in zip(ids[::9], block_l2(asked, base), strict=True):
                live = np.flatnonzero((row <= within if within is not None else np.ones(700, bool)) & ((ids != q) | (not skip)))
                order = live[np.lexsort((ids[live], row[live]))][:k]
                want += [(q, r + 1, ids[a], row[a].tobytes()) for r, a in enumerate(order)]
            assert [(*x, f.tobytes()) for *x, f in zip(qid, rank, found, far, strict=True)] == want


def test_queries_dealt_out(spark, monkeypatch):
    """Many queries and few rows: each task has its queries' k first, and no hits of single tasks are ranked; several blocks of rows, copies and a limit are the same to the last bit."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    x[50:90] = x[7]
    base = frame(spark, [(int(i), v.tolist()) for i, v in zip(rng.permutation(300), x, strict=True)]).cache()
    wanted = base.select(F.col("id").alias("qid"), "vector")
    key = lambda df: sorted((r["qid"], r["rank"], r["id"], r["distance"].hex()) for r in df.collect())
    settings = [{"k": 5, "skip_self": True}, {"k": 20, "within": 2.5}]
    few = [key(exact.nearest(base, wanted, **s)) for s in settings]
    links = {r["id"]: (r["nbrs"], r["dense_nbrs"]) for r in graph.knn_graph(base, 4, 9).collect()}
    monkeypatch.setattr(exact, "BLOCK_BYTES", 1 << 12)
    with monkeypatch.context() as m:
        m.delattr(exact, "ranked")
        assert key(exact.nearest(base, wanted, **settings[0])) == few[0]
    for size in (1 << 20, 1 << 13, 1 << 10):  # one block of rows, some, and more than of queries
        monkeypatch.setattr(exact, "ROWS_BYTES", size, raising=False)
        assert [key(exact.nearest(base, wanted, **s)) for s in settings] == few
        assert {r["id"]: (r["nbrs"], r["dense_nbrs"]) for r in graph.knn_graph(base, 4, 9).collect()} == links
    assert exact.nearest(base.limit(0), wanted, 5).count() == 0
    with pytest.raises(Exception, match="differ in dimension"):
        exact.nearest(base.withColumn("vector", F.slice("vector", 1, 5)), wanted, 5).count()


def test_screen_beyond_single_precision():
    """Norms that single precision can't hold, tiny ones, non-finite rows among the first, and rows by the thousand: the first k of all distances."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5000, 3))
    odd = x.copy()
    odd[:40, 1], odd[60, 0] = np.inf, np.nan
    for base in (x, x * 1e25, x * 1e-25, x * 1e160, np.round(x), odd, x + 1e4):
        ids, asked = rng.permutation(5000), base[::250]
        best = exact.Nearest(ids[::250], asked, 9, skip_self=True)
        best.add(ids, base)
        with np.errstate(all="ignore"):
            far = block_l2(asked, base)
        want = []
        for q, row in zip(ids[::250], far, strict=True):
            want += [int(ids[a]) for a in np.lexsort((ids, row)) if ids[a] != q][:9]
        assert best.rows(0, len(asked))[2].tolist() == want


def test_few_pairs_are_measured(monkeypatch):
    """Of thousands of rows a query measures little more than its k, also in a radius that holds all, and counts the same rows."""
    x = np.random.default_rng(11).normal(size=(20_000, 16))
    measured, plain = [], exact.row_l2
    monkeypatch.setattr(exact, "row_l2", lambda a, b: measured.append(len(a)) or plain(a, b))
    for k, within in ((16, None), (16, 1e6)):
        measured.clear()
        best = exact.Nearest(np.arange(300), x[:300], k, within, skip_self=True)
        best.add(np.arange(20_000), x)
        assert sum(measured) < 300 * 2 * k
        far = block_l2(x[:300], x)
        far[np.arange(300), np.arange(300)] = np.inf
        assert best.ids.tolist() == np.argsort(far, axis=1, kind="stable")[:, :k].tolist()


def test_index_is_quantised_beside_its_graph(spark, tmp_path, monkeypatch):
    """Quantisation needs the vectors only and doesn't wait for the graph; what goes wrong in it ends the build."""
    begun, train, near = threading.Event(), pq.train_centred, graph.knn_graph
    base = files.toy_vectors(spark, 12)
    config = cfg.BuildConfig(degree=3, page_nodes=3, pq_subspaces=3, pq_centroids=4, entry=0)
    monkeypatch.setattr(pq, "train_centred", lambda *a: begun.set() or train(*a))
    monkeypatch.setattr(graph, "knn_graph", lambda *a: near(*a) if begun.wait(20) else pytest.fail("the graph came first"))
    made = build_index(base, str(tmp_path / "index"), config, pruned=False)
    assert made.pq_codes.count() == 12 and made.layout.filter("slot = 0 AND page_id = node_id").count() == 12

    def broken(*a):
        raise ValueError("no pivots today")

    monkeypatch.setattr(pq, "train_centred", lambda *a: begun.set() or broken())
    with pytest.raises(ValueError, match="no pivots today"):
        build_index(base, str(tmp_path / "other"), config, pruned=False)


@pytest.mark.parametrize("name", ["stats_accumulate", "bench_summary", "bench_compare", "bench_tsv_roundtrip"])
def test_summaries_of_larger_graphs(spark, monkeypatch, name):
    """A graph of many query blocks is built at once from dealt-out queries, not block by block, and the summary is the same."""
    made, path = [], runtime.new_path
    key = lambda: sorted(map(repr, queries.QUERIES[name](spark, SMALL).collect()))
    few = key()
    monkeypatch.setattr(exact, "BLOCK_BYTES", 1 << 14)
    for module in (runtime, exact):
        monkeypatch.setattr(module, "new_path", lambda s, what: made.append(what) or path(s, what))
    assert key() == few
    assert "nearest" not in made and made.count("near") == 1


def test_reverse_edges_are_turned_as_the_graph_is_loaded(spark, monkeypatch):
    """The flat form of with_reverse(graph): repeated edges, nodes without a row, rows of unknown nodes, sparse ids; an error beyond the limit, and for a node with two rows."""
    rng = np.random.default_rng(6)
    for places in (np.arange(40), np.sort(rng.choice(10**12, 40, replace=False)) - 10**11):
        rows = [(int(places[i]), places[rng.integers(0, 40, 5)].tolist(), places[rng.integers(0, 40, 2)].tolist()) for i in rng.permutation(40)[:33]]
        links = spark.createDataFrame(rows, "id long, nbrs array<long>, dense_nbrs array<long>")
        base = spark.createDataFrame([(int(i), [float(i % 7), 1.0], bool(i % 3)) for i in rng.permutation(places)], "id long, vector array<double>, member boolean")
        got, want = beam.load(links, base, member="member", reverse=True), beam.load(graph.with_reverse(links), base, member="member")
        for name in ("ids", "starts", "nbrs", "vectors", "member", "dense_starts", "dense_nbrs"):
            assert getattr(got, name).tolist() == getattr(want, name).tolist()
    assert len(beam.load(links.limit(0), base, reverse=True).nbrs) == 0
    with pytest.raises(ValueError, match="two rows"):
        beam.load(links.unionByName(links), base)
    monkeypatch.setattr(beam, "TRAVELLING_BYTES", 8 * (33 * 5 + 40 * 2))
    assert len(beam.load(links, base).nbrs) == 33 * 5
    with pytest.raises(ValueError, match="too large to travel"):
        beam.load(links, base, reverse=True)


def test_a_graph_is_written_once(spark, monkeypatch):
    """Lists of dealt-out queries are whole where they are found: no shuffle groups them, no other table of the graph is written; repeated query ids share a list."""
    made, path = [], runtime.new_path
    monkeypatch.setattr(exact, "BLOCK_BYTES", 1 << 14)
    for module in (runtime, exact):
        monkeypatch.setattr(module, "new_path", lambda s, what: made.append(what) or path(s, what))
    with monkeypatch.context() as m:
        kind, plain = type(spark.range(1)), type(spark.range(1)).groupBy
        m.setattr(kind, "groupBy", lambda self, *by: pytest.fail("lists were grouped") if by else plain(self))
        flat = queries._walkable(spark, SMALL)
    assert made == ["near"] and np.diff(flat.starts).min() >= 16
    x = np.random.default_rng(8).normal(size=(90, 3))
    base = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]).cache()
    wanted = frame(spark, [(i // 3 % 7, v.tolist()) for i, v in enumerate(x)]).withColumnRenamed("id", "qid")
    key = lambda: sorted((r["qid"], r["rank"], r["id"], r["distance"].hex()) for r in exact.nearest(base, wanted, 40, skip_self=True).collect())
    few = key()
    monkeypatch.setattr(exact, "BLOCK_BYTES", 1 << 9)
    monkeypatch.delattr(exact, "ranked")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert key() == few
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_endless_walk_sends_what_is_measured(spark, monkeypatch):
    """Neither edges nor rows that no walk measures go to the tasks, and components that single precision holds go in it; finer ones are measured as they are."""
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or send(self, value))
    links = spark.createDataFrame([(i, [(i + 1) % 6]) for i in range(8)], "id long, nbrs array<long>")
    for step, kind in ((0.5, np.float32), (0.1, np.float64)):
        base = frame(spark, [(i, [i * step, 1.0], i % 2 == 0) for i in range(8)], ", member boolean")
        flat = beam.load(links, base, member="member")
        sent.clear()
        rows = beam.search(flat, asked(spark, [2.2, 1.0]), 0, cfg.SearchConfig(top_k=9, l_search=8)).collect()
        assert [x.tolist() for x in sent[0]] == [[0, 2, 4], [[i * step, 1.0] for i in (0, 2, 4)]] and sent[0][1].dtype == kind and len(sent) == 1
        assert {r["id"]: r["distance"] for r in rows} == {i: (2.2 - i * step) ** 2 for i in (0, 2, 4)}
        assert {(r["n_hops"], r["n_cmps"], r["exact_evals"]) for r in rows} == {(6, 6, 3)}


@pytest.mark.parametrize("name", ["bench_tsv_roundtrip", "bench_summary"])
def test_truth_is_searched_beside_the_graph(spark, monkeypatch, name):
    """The truth needs no graph and doesn't wait for it; what goes wrong in its search ends the query, and the session is as it was."""
    begun, near, search = threading.Event(), graph.knn_graph, exact.nearest
    monkeypatch.setattr(graph, "knn_graph", lambda *a, **b: near(*a, **b) if begun.wait(20) else pytest.fail("the graph came first"))
    monkeypatch.setattr(exact, "nearest", lambda base, asked, k, **b: (k == queries.K and begun.set()) or search(base, asked, k, **b))
    assert all(r["average_recall"] == 1 for r in queries.QUERIES[name](spark, SMALL).collect())

    def broken(base, asked, k, **b):
        begun.set()
        return search(base, asked, k, **b) if k != queries.K else (_ for _ in ()).throw(ValueError("no truth today"))

    monkeypatch.setattr(exact, "nearest", broken)
    with pytest.raises(ValueError, match="no truth today"):
        queries.QUERIES[name](spark, SMALL)
    assert spark.conf.get(runtime._FREED_SHUFFLES, "false") == "false"


def test_threads_free_shuffles_at_a_time(spark):
    """The setting is as before once the last of several threads is out, whichever was first."""
    value = lambda: spark.conf.get(runtime._FREED_SHUFFLES, "false")
    first, second = runtime.freed_shuffles(spark), runtime.freed_shuffles(spark)
    before = value()
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert value() == "true"
    second.__exit__(None, None, None)
    assert value() == before


def test_counters_need_no_recall(spark, monkeypatch):
    """Folding counters neither searches the truth nor measures recall, which it doesn't return."""
    monkeypatch.setattr(exact, "recall", lambda *a: pytest.fail("recall was measured"))
    assert sum(r["queries"] for r in queries.stats_accumulate(spark, SMALL).collect()) == 10


def test_medoid_far_from_zero(spark):
    """Sums of all distances, also where the rows' common offset is far larger than their spread."""
    x = np.random.default_rng(3).normal(size=(300, 5)) + 1e5
    x[40] = x[41] = x.mean(0)
    row = graph.medoid(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])).first()
    assert row["id"] == 40 and math.isclose(row["total"], block_l2(x, x).sum(1)[40], abs_tol=2e-6)
    flat = np.zeros((50_000, 8))
    flat[:, 0] = np.arange(50_000)  # the square of so many rows takes minutes
    made = spark.range(50_000).select("id", F.array(F.col("id").cast("double"), *[F.lit(0.0)] * 7).alias("vector"))
    assert graph.medoid(made).first()["id"] == 24_999


def test_pruning_of_many_nodes_at_once():
    """The same ids as node by node, with unequal numbers of candidates, copies and ties."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(60, 3)), 1)
    counts = rng.integers(1, 40, 25)
    ids = np.concatenate([rng.permutation(60)[:n] for n in counts])
    at = np.cumsum(counts) - counts
    got = graph.pruned(x[:25], ids, x[ids], at, counts, 6, 1.2)
    for i in range(25):
        own = ids[at[i] : at[i] + counts[i]]
        d = block_l2(x[[i]], x[own])[0]
        order, kept = list(np.lexsort((own, d))), []
        while order and len(kept) < 6:
            best = order.pop(0)
            kept.append(int(own[best]))
            order = [j for j in order if 1.2 * ((x[own[best]] - x[own[j]]) ** 2).cumsum()[-1] > d[j]]
        assert got[i] == kept


@pytest.mark.parametrize("in_filter", [False, True])
def test_endless_walk_counts_as_a_walk(spark, in_filter):
    """Rows and counters of walks node by node, where parts of the graph are out of reach."""
    rng = np.random.default_rng(5)
    n = 120
    rows = [(i, rng.normal(size=4).tolist(), i % 3 == 0, [int(x) for x in rng.integers(0, 90, 2)], [int(x) for x in rng.integers(0, n, 3)]) for i in range(n)]
    base = spark.createDataFrame([r[:3] for r in rows], "id long, vector array<double>, member boolean")
    links = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows], "id long, nbrs array<long>, dense_nbrs array<long>")
    flat = beam.replace(beam.load(links, base, member="member"), page=np.arange(n) // 7, cached=np.arange(n) % 5 == 0)
    config = cfg.SearchConfig(top_k=5, l_search=n)
    assert beam._endless(flat, config)
    got = sorted(map(tuple, beam.search(flat, asked(spark, *[r[1] for r in rows[:9]]), 3, config, in_filter=in_filter).collect()))
    want, sizes = [], set()
    for q in range(9):
        found, stats = beam.walk(flat, np.array(rows[q][1]), 3, config, in_filter)
        want += [(q, r + 1, int(flat.ids[a]), d, *stats.values()) for r, (d, a) in enumerate(found[:5])]
        sizes.add(stats["n_hops"])
    assert got == want and max(sizes) < n


def test_frontier_equals_exact(spark, toy):
    base, g = toy
    q = asked(spark, [0.95, 0.15, 0], [-1, 0, 0.6])
    got = beam.frontier_search(graph.with_reverse(g), base, q, 0, cfg.SearchConfig(top_k=4, l_search=12, beam_width=12))
    assert ids(got) == ids(exact.nearest(base, q, 4))


@pytest.fixture(scope="module")
def filtered(spark):
    base = frame(spark, [(i, [float(i), 0.0], v) for i, v in enumerate((7, 1, 7, 2))], ", label int").cache()
    g = spark.createDataFrame([(i, [(i + 1) % 4, (i + 2) % 4], [2] if i == 0 else []) for i in range(4)], "id long, nbrs array<long>, dense_nbrs array<long>").cache()
    return base, g, asked(spark, [2.05, 0])


def test_filter_modes(spark, filtered):
    base, g, q = filtered
    seven = exact.LabelOr([7])
    assert ids(exact.prefilter_search(base, q, seven, 2)) == [2, 0]
    assert ids(exact.postfilter_search(base, q, seven, 2, 4)[0]) == [2, 0]
    flat = beam.load(g, base.withColumn("member", seven.predicate()), member="member")
    within = beam.search(flat, q, 0, cfg.SearchConfig(top_k=2, beam_width=2, l_search=2, l_pool=4), in_filter=True)
    assert ids(within)[0] == 2 and within.count() == 2
    assert ids(exact.range_search(base, q, 0.1, 3)) == [2]
    assert seven.selectivity(base) == 0.5


@pytest.fixture(scope="module")
def rare(spark):
    """2,000 vectors, one in a hundred with the label; queries and the flat graph with its members."""
    rng = np.random.default_rng(5)
    base = frame(spark, [(i, v.tolist(), int(i % 100 == 7)) for i, v in enumerate(rng.standard_normal((2000, 16)))], ", label int").cache()
    g = graph.with_reverse(graph.knn_graph(base, 8, 16)).cache()
    return base, g, asked(spark, *rng.standard_normal((20, 16))), beam.load(g, base.withColumn("member", F.col("label") == 1), member="member")


@pytest.mark.parametrize("more", [{}, {"defer_exact_until_refinement": True, "refine_k": 20}])
def test_in_filter_with_rare_label(spark, rare, more):
    base, g, q, flat = rare
    truth = exact.prefilter_search(base, q, exact.LabelOr([1]), 10)
    found = beam.search(flat, q, 0, cfg.SearchConfig(top_k=10, l_search=20, **more), in_filter=True)
    assert ids(found) == ids(truth)
    assert beam.search(flat, q, 0, cfg.SearchConfig(top_k=30, l_search=30), in_filter=True).count() == 20 * 20


def test_in_filter_follows_dense_neighbours(spark):
    base = frame(spark, [(i, [float(i)], int(i == 3)) for i in range(4)], ", label int").withColumn("member", F.col("label") == 1)
    g = spark.createDataFrame([(0, [1], [3]), (1, [0, 2], []), (2, [1], []), (3, [2], [])], "id long, nbrs array<long>, dense_nbrs array<long>")
    one = cfg.SearchConfig(top_k=1, l_search=1)
    assert ids(beam.search(beam.load(g, base, member="member"), asked(spark, [0]), 0, one, in_filter=True)) == [3]
    assert [r["nodes"] for r in graph.validate(graph.knn_graph(base, 1, 3), 4, 1, 2).collect()] == [0] * 5
    assert beam.load(g, base).dense_nbrs is None


def test_filter_costs():
    c = cfg.SearchConfig(l_search=10, l_pool=20)
    costs = cfg.filter_costs(0.5, 1.0, 7, 3, c, 100, 8, 0)
    assert costs == {cfg.FilterMode.PRE: 320, cfg.FilterMode.IN: 210, cfg.FilterMode.POST: 360}
    assert cfg.choose_filter_mode(costs) is cfg.FilterMode.IN
    assert cfg.choose_filter_mode(costs, cfg.FilterMode.POST) is cfg.FilterMode.POST
    assert cfg.choose_filter_mode(dict.fromkeys(costs, 5)) is cfg.FilterMode.PRE


def test_ldg_partition(spark):
    near = {0: [1, 2], 1: [0, 2, 3], 2: [0, 1, 4], 3: [1, 4, 5], 4: [2, 3, 5], 5: [3, 4]}
    g = spark.createDataFrame([(i, n) for i, n in near.items()], "id long, nbrs array<long>")
    rows = layout.ldg_layout(g, 3, scale=1.0, rounds=2).collect()
    sizes = {}
    for r in rows:
        sizes[r["page_id"]] = sizes.get(r["page_id"], 0) + 1
    assert sorted(r["node_id"] for r in rows) == list(range(6))
    assert len(sizes) == 2 and all(1 <= n <= 3 for n in sizes.values())
    wide = layout.ldg_layout(g, 3, scale=2.0)
    assert {r["node_id"] for r in wide.collect()} == set(range(6))
    assert all(r["rows"] == 0 for r in layout.validate(wide, 6, 3).collect())


def test_partition_sizes():
    assert cfg.partition_sizes(10, 4) == (10, 10)
    assert cfg.partition_sizes(10, 4, 1.0) == (3, 0)
    assert cfg.partition_sizes(10, 4, 2.0) == (5, 3)
    with pytest.raises(ValueError):
        cfg.partition_sizes(0, 4)


def test_pages(spark):
    base = frame(spark, [(i, [float(i), i + 0.5]) for i in range(4)])
    g = spark.createDataFrame([(i, [(i + 1) % 4, (i + 2) % 4]) for i in range(4)], "id long, nbrs array<long>")
    pages = spark.createDataFrame([(p, s, n) for p, page in enumerate([[0, 1], [1, 2], [2, 0], [3, 0]]) for s, n in enumerate(page)], layout.LAYOUT)
    made = layout.materialize(pages, g, base, vectors="all").orderBy("page_id").collect()
    assert made[0]["target"] == [0.0, 0.5]
    assert [(x["node_id"], x["nbrs"], x["vector"]) for x in made[0]["nodes"]] == [(0, [1, 2], [0.0, 0.5]), (1, [2, 3], [1.0, 1.5])]
    assert {r["node_id"]: r["page_id"] for r in layout.id_to_page(pages).collect()} == {0: 0, 1: 0, 2: 1, 3: 3}


def test_build_and_load(spark, tmp_path):
    base = frame(spark, [(i, list(map(float, v))) for i, v in enumerate(TEXT)])
    made = build_index(base, str(tmp_path / "ix"), cfg.BuildConfig(degree=3, page_nodes=3, r_ood=1))
    assert (made.meta["points"], made.meta["dim"]) == (12, 3)
    near = made.graph.filter("id = 0").first()["nbrs"]
    assert len(set(near)) == len(near) and 0 not in near and all(0 <= x < 12 for x in near)
    assert made.id_to_page.filter("node_id = 0").first()["page_id"] == 0
    again = load_index(spark, str(tmp_path / "ix" / "layout"))
    got = beam.search(beam.load(again.graph, again.vectors), asked(spark, [1, 0.1, 0]), again.meta["entry"], cfg.SearchConfig(top_k=3, beam_width=2, l_search=5))
    assert got.count() == 3
    bad = again.layout.unionByName(spark.createDataFrame([(0, 9, 0)], layout.LAYOUT))
    bad.write.parquet(str(tmp_path / "bad"))
    made.layout.sparkSession.read.parquet(str(tmp_path / "bad")).write.mode("overwrite").parquet(str(tmp_path / "ix" / "layout"))
    with pytest.raises(ValueError, match="broken"):
        load_index(spark, str(tmp_path / "ix"))


def test_build_with_training_queries(spark, tmp_path):
    """Refinement edges are part of the graph, dense neighbours none of the base ones; what is absent has its default."""
    rng = np.random.default_rng(11)
    base = frame(spark, [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((120, 6)))]).cache()
    train = asked(spark, *rng.standard_normal((40, 6)) * 2)
    config = cfg.BuildConfig(degree=6, dense_degree=10, r_ood=2, l_ood=8, build_l=12, candidates=16, page_nodes=3, pq_centroids=8)
    made = build_index(base, str(tmp_path / "ix"), config, train)
    assert made.default_kind is cfg.DistanceKind.PQ
    assert all(r["nodes"] == 0 for r in graph.validate(made.graph, 120, 6, 4).collect())
    assert all(r["nodes"] == 0 for r in graph.validate_refine(made.refine, 2).collect())
    rows = {r["id"]: r for r in made.graph.collect()}
    assert all(set(r["nbrs"]) <= set(rows[r["id"]]["nbrs"]) and min(r["ehs"]) >= 1 for r in made.refine.collect())
    assert all(not set(r["nbrs"]) & set(r["dense_nbrs"]) and len(r["dense_nbrs"]) == 4 for r in rows.values())
    plain = build_index(base, str(tmp_path / "plain"), cfg.BuildConfig(degree=6, build_l=12, page_nodes=3))
    assert "refine" not in plain.tables and plain.graph.agg(F.max(F.size("nbrs"))).first()[0] <= 6
    seen = {r["part"]: r["value"] for r in inspect_files(spark, str(tmp_path / "ix")).collect()}
    assert seen["pq chunks"] == "3" and int(seen["bytes graph"]) > 0 and int(seen["refine edges"]) == sum(len(r["nbrs"]) for r in made.refine.collect())
    assert [r["slot"] for r in inspect_page(made, 5).collect()] == [0, 1, 2]
    shutil.rmtree(tmp_path / "ix" / "pq_codes")
    assert load_index(spark, str(tmp_path / "ix")).default_kind is cfg.DistanceKind.FULL
    meta = {**plain.meta, "format": "other"}
    spark.createDataFrame([tuple(meta.values())], "format string, points long, dim int, entry long, degree int, page_nodes int").write.mode("overwrite").parquet(str(tmp_path / "plain" / "meta"))
    with pytest.raises(ValueError, match="format"):
        load_index(spark, str(tmp_path / "plain"))


def test_centred_quantisation_is_a_translation(spark):
    rng = np.random.default_rng(12)
    base = frame(spark, [(i, (v + 100).tolist()) for i, v in enumerate(rng.standard_normal((60, 4)))]).cache()
    assert np.allclose(pq.train_centred(base, 2, 4)[0], pq.train(base, 2, 4)[0])


def test_approximate_membership(spark, rare):
    """A check that admits too much still ends with members only, the same ones."""
    base, g, q, _ = rare
    one = exact.LabelOr([1], buckets=1)
    assert one.estimates(base)["precision"] == pytest.approx(0.01) and exact.LabelOr([1], buckets=2).estimates(base)["precision"] == 1
    flat = beam.load(g, base.withColumns({"member": one.predicate(), "maybe": one.approximate()}), member="member", maybe="maybe")
    found = beam.search(flat, q, 0, cfg.SearchConfig(top_k=10, l_search=2000), in_filter=True)
    assert ids(found) == ids(exact.prefilter_search(base, q, one, 10))
    assert beam.pipe_search is beam.search


@pytest.mark.parametrize("change", [{"top_k": 0}, {"beam_width": 0}, {"l_search": 0}, {"refine_ratio": -1.0}, {"refine_ratio": math.inf}])
def test_search_config_refused(change):
    with pytest.raises(ValueError):
        cfg.SearchConfig(**change).checked()


@pytest.mark.parametrize("change", [{"degree": 0}, {"dense_degree": 2}, {"r_ood": 4}, {"build_l": 200}, {"alpha": 0.5}, {"entry": 12}, {"pq_subspaces": 2}])
def test_build_config_refused(change):
    with pytest.raises(ValueError):
        cfg.BuildConfig(**change).checked(3, 12)


def test_parsers():
    assert cfg.parse_list("1, 2") == [1, 2] and cfg.parse_list("yes,0", "bool") == [True, False]
    assert cfg.parse_list("pq,full", cfg.DistanceKind) == [cfg.DistanceKind.PQ, cfg.DistanceKind.FULL]
    assert cfg.parse_vector(" 1 2.5 ") == [1.0, 2.5]
    assert cfg.sanitize_label("My Run-1_é") == "my_run-1___" and cfg.sanitize_label("") == "experiment"
    for bad in ("", " , "):
        with pytest.raises(ValueError):
            cfg.parse_list(bad)
    with pytest.raises(ValueError):
        cfg.parse_enum(cfg.CachePolicy, "none")


def test_sweep_of_32_runs(spark):
    values = {"kind": [cfg.DistanceKind.FULL, cfg.DistanceKind.PQ], "beam_width": [2, 3], "l_search": [6], "graph_cache_budget_bytes": [0, 8192], "refine_k": [4], "defer_exact_until_refinement": [False, True], "scheduler_policy": [cfg.SchedulerPolicy.CONSERVATIVE, cfg.SchedulerPolicy.BOUNDED]}
    sweep = cfg.Sweep(cfg.SearchConfig(top_k=4), values=values)
    runs = sweep.runs()
    grid = bench.sweep_grid(spark, sweep).orderBy("run").collect()
    assert len(runs) == len(grid) == 32
    assert [(k.value, c.beam_width, c.defer_exact_until_refinement, c.scheduler_policy.value) for k, c in runs] == [(r["kind"], r["beam_width"], r["defer_exact_until_refinement"], r["scheduler_policy"]) for r in grid]


def test_bench_files(spark, toy, tmp_path):
    base, g = toy
    q = asked(spark, [1, 0, 0], [0, 1, 0.3], [-1, 0, 0.6])
    truth = exact.nearest(base, q, 2)
    assert [r["ids"].split(",")[0] for r in exact.result_ids(truth).orderBy("qid").collect()] == ["0", "3", "6"]
    flat = beam.load(g, base)
    rows = [bench.run_bench(spark, flat, q, 0, cfg.DistanceKind.FULL, cfg.SearchConfig(top_k=4, l_search=l), truth, 1) for l in (6, 8)]
    assert all(0 <= r["average_recall"] <= 1 and r["queries"] == 3 for r in rows)
    folder = bench.experiment_folder(str(tmp_path), "My run")
    bench.write_experiment(folder, rows, [[0, 1], [3, 2], [6, 5]])
    assert bench.experiment_folder(str(tmp_path), "My run").endswith("my_run_1")
    back = bench.read_tsv(spark, folder + "/summary.tsv")
    assert back.count() == 2 and back.columns == bench.TSV_COLUMNS
    both = bench.merge([back, back])
    assert both.count() == 4
    compared = bench.compare(back, back, ["n_hops", "average_recall", *bench.TIME_COLUMNS])
    assert compared.count() == 2 and all(r["delta_n_hops"] == 0 for r in compared.collect())
    text = bench.compare_markdown(compared, "a", "b").splitlines()
    assert text[4] == "- Matched runs: 2" and [x.count("|") for x in text[6:]] == [21] * 4
    with pytest.raises(ValueError):
        bench.compare_markdown(bench.compare(back.filter("l_search = 6"), back.filter("l_search = 8"), ["n_hops"]))
    (tmp_path / "twice.tsv").write_text("top_k\ttop_k\n1\t2\n")
    with pytest.raises(ValueError, match="twice"):
        bench.read_tsv(spark, str(tmp_path / "twice.tsv"))
    (tmp_path / "short.tsv").write_text("top_k\n1\n")
    with pytest.raises(ValueError, match="missing"):
        bench.read_tsv(spark, str(tmp_path / "short.tsv"))


@pytest.mark.parametrize("kind", ["text", "fvecs", "bvecs", "bin"])
def test_loaders(spark, tmp_path, kind):
    rows = frame(spark, [(0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0])])
    path = str(tmp_path / kind)
    if kind == "text":
        (tmp_path / "text").write_text("1 2 3\n\nabc\n 4\t5 6 x 9\n")
    else:
        files.write_vectors(rows, path, kind, parts=1)
    assert [r["vector"] for r in files.read_vectors(spark, path, kind).orderBy("id").collect()] == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]


def test_text_parts_of_unequal_size(spark, tmp_path):
    """Ids follow the parts' names, though Spark reads the largest first."""
    (tmp_path / "text").mkdir()
    for part, (low, high) in enumerate([(0, 3), (3, 200), (200, 210), (210, 600)]):
        (tmp_path / f"text/part-{part}.txt").write_text("".join(f"{i} 0.5\n" for i in range(low, high)))
    rows = files.read_text(spark, str(tmp_path / "text")).collect()
    assert sorted((r["id"], r["vector"][0]) for r in rows) == [(i, float(i)) for i in range(600)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # ranges of files
    try:
        rows = files.read_text(spark, str(tmp_path / "text")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["id"], r["vector"][0]) for r in rows) == [(i, float(i)) for i in range(600)]


def test_broken_files_refused(spark, tmp_path):
    (tmp_path / "ragged.txt").write_text("1 2\n3\n")
    (tmp_path / "empty.txt").write_text("\n")
    for name in ("ragged.txt", "empty.txt"):
        with pytest.raises(ValueError):
            files.read_text(spark, str(tmp_path / name))
    head = np.array([1, 2], "<u4").tobytes()
    (tmp_path / "long.bin").write_bytes(head + np.zeros(3, "<f4").tobytes())
    (tmp_path / "cut.fvecs").write_bytes(np.array([3], "<u4").tobytes() + np.zeros(2, "<f4").tobytes())
    for name, kind in (("long.bin", "bin"), ("cut.fvecs", "fvecs")):
        with pytest.raises(Exception, match="bytes|cut off"):
            files.read_vectors(spark, str(tmp_path / name), kind).collect()


def test_dimensions_must_agree(spark):
    with pytest.raises(ValueError):
        block_l2(np.zeros((1, 2)), np.zeros((1, 3)))
    bad = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="dimension"):
        bad.select(l2_squared("a", "b")).collect()
    assert spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>").select(l2_squared("a", "b")).first()[0] == 25.0


def test_quantiser_invariants(spark, toy):
    base, _ = toy
    pivots, costs = pq.train(base, 3, 4)
    assert all(b <= a + 1e-9 for a, b in zip(costs, costs[1:], strict=False))
    with pytest.raises(Exception, match="multiple"):
        pq.lloyd_step(base, np.zeros((2, 4, 1)))
    with pytest.raises(ValueError):
        pq.pivot_array(pq.pivot_frame(spark, pivots).limit(5))


def test_pruned_graph_and_recall(spark):
    rng = np.random.default_rng(3)
    points = rng.standard_normal((300, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    base = frame(spark, [(i, v.tolist()) for i, v in enumerate(points)]).cache()
    g = graph.pruned_graph(base, 12, 32).cache()
    assert all(r["nodes"] == 0 for r in graph.validate(g, 300, 12).collect())
    held_out = asked(spark, *(v / np.linalg.norm(v) for v in rng.standard_normal((20, 16))))
    flat, entry = beam.load(g, base), graph.entry_point(base)
    truth = exact.nearest(base, held_out, 10)
    mean = [exact.recall(beam.search(flat, held_out, entry, cfg.SearchConfig(top_k=10, l_search=l)), truth, 10).agg(F.avg("recall")).first()[0] for l in (16, 64, 300)]
    assert mean[0] <= mean[1] <= mean[2] == 1.0 and mean[1] > 0.9


def test_cache_budget(spark, toy):
    base, g = toy
    pages = layout.replicated_layout(g, 4)
    flat = beam.load(g, base)
    for budget in (0, 200, 10_000):
        held = beam.cache_entry_bfs(pages, flat, 0, budget)
        assert sum(b for _, b in held) <= budget and len({n for n, _ in held}) == len(held)
    assert held[0][0] == 0 and len(held) == 12
    with pytest.raises(ValueError):
        graph.entry_point(base, 99)
    paged, q = beam.PagedGraph(flat, pages, g, 0), asked(spark, [0.95, 0.15, 0])
    for policy in cfg.CachePolicy:
        bare, kept = (paged.under(cfg.SearchConfig(graph_cache_budget_bytes=b, graph_cache_policy=policy)) for b in (0, 10_000))
        one, two = (beam.search(x, q, 0, cfg.SearchConfig(top_k=4, l_search=8)).first() for x in (bare, kept))
        assert one["id"] == two["id"] == 0 and one["cache_hits"] == 0 and 0 < one["pages_touched"] <= one["n_hops"]
        assert two["cache_hits"] == two["n_hops"] and two["pages_touched"] == 0
    again = paged.under(cfg.SearchConfig(graph_cache_budget_bytes=10_000, graph_cache_policy=cfg.CachePolicy.PAGE_LAYOUT))
    assert again.cached is kept.cached


def test_queries_as_a_stream(spark, toy, tmp_path):
    base, _ = toy
    q = asked(spark, [1, 0, 0], [0, 1, 0.3])
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    run = answer_stream(stream, base, 3, str(tmp_path / "out"), str(tmp_path / "check"))
    run.processAllAvailable()
    run.stop()
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == ids(exact.nearest(base, q, 3))


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "toy")
    main(["build", "--out", path], spark)
    main(["search", "--index", path, "--query", "0.95 0.15 0", "--top_k", "4"], spark)
    main(["inspect", "--index", path], spark)
    (tmp_path / "q.txt").write_text("1 0 0\n0 1 0.3\n")
    main(["bench", "--index", path, "--queries", str(tmp_path / "q.txt"), "--kind", "full", "--generate_ground_truth", "--experiment_dir", str(tmp_path / "run")], spark)
    main(["compare", str(tmp_path / "run/summary.tsv"), str(tmp_path / "run/summary.tsv")], spark)
    assert "delta_qps" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["bench", "--index", path], spark)
