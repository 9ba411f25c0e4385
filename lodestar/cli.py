"""Command line: ``python -m lodestar.cli build | search | bench | ground-truth | inspect | merge | compare``."""

from __future__ import annotations

import argparse
import math
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar.index import build_index, inspect_files, inspect_page, load_index
from lodestar.operators import beam, bench, exact, pq
from lodestar.plans.config import BeamPolicy, BuildConfig, CachePolicy, DistanceKind, SchedulerPolicy, SearchConfig, Sweep, parse_enum, parse_list, parse_vector
from lodestar.sources.vectors import read_truth, read_vectors, toy_vectors, write_truth

FORMATS = ["text", "fvecs", "bvecs", "bin"]


def parser() -> argparse.ArgumentParser:
    """All commands and their options."""
    top = argparse.ArgumentParser(prog="lodestar")
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("--base")
    build.add_argument("--format", choices=[*FORMATS, "toy"], default="toy")
    build.add_argument("--out", required=True)
    for name in ("degree", "dense_degree", "r_ood", "l_ood", "build_l", "candidates", "page_nodes", "ldg_times", "pq_subspaces", "pq_centroids", "pq_iterations", "toy_points"):
        build.add_argument(f"--{name}", type=int, default=getattr(BuildConfig, name))
    build.add_argument("--partition_scale", type=float, default=0.0)
    build.add_argument("--alpha", type=float, default=BuildConfig.alpha)
    build.add_argument("--entry", type=int)
    build.add_argument("--train")
    build.add_argument("--train_format", choices=FORMATS, default="text")
    build.add_argument("--graph", choices=["pruned", "nearest"], default="pruned")
    search = commands.add_parser("search")
    run = commands.add_parser("bench")
    for one in (search, run):
        one.add_argument("--index", required=True)
        one.add_argument("--queries")
        one.add_argument("--format", choices=FORMATS, default="text")
        one.add_argument("--top_k", type=int, default=5)
    search.add_argument("--query", type=parse_vector)
    search.add_argument("--kind", type=lambda t: parse_enum(DistanceKind, t))
    for name in ("beam_width", "l_search", "l_pool", "mem_l", "refine_k"):
        search.add_argument(f"--{name}", type=int, default=getattr(SearchConfig, name))
    search.add_argument("--refine_ratio", type=float, default=0.0)
    search.add_argument("--range_partial", type=float, default=math.inf)
    for name, kind in (("kind", DistanceKind), ("beam_width", "int"), ("l_search", "int"), ("graph_cache_budget_bytes", "int"), ("graph_cache_policy", CachePolicy), ("refine_k", "int"), ("refine_ratio", "float"), ("defer_exact_until_refinement", "bool"), ("scheduler_policy", SchedulerPolicy), ("scheduler_policy_limit", "int"), ("dynamic_beam_policy", BeamPolicy)):
        run.add_argument(f"--{name}", type=lambda t, k=kind: parse_list(t, k))
    run.add_argument("--recall_at_k", type=int, default=0)
    truth = run.add_mutually_exclusive_group()
    truth.add_argument("--ground_truth")
    truth.add_argument("--generate_ground_truth", action="store_true")
    target = run.add_mutually_exclusive_group(required=True)
    target.add_argument("--experiment_dir")
    target.add_argument("--experiment_root")
    run.add_argument("--label", default="")
    exact_truth = commands.add_parser("ground-truth")
    for name in ("base", "queries", "out"):
        exact_truth.add_argument(f"--{name}", required=True)
    exact_truth.add_argument("--format", choices=FORMATS, default="text")
    exact_truth.add_argument("--top_k", type=int, default=5)
    look = commands.add_parser("inspect")
    look.add_argument("--index", required=True)
    look.add_argument("--page", type=int)
    merged = commands.add_parser("merge")
    merged.add_argument("inputs", nargs="+")
    merged.add_argument("--out", required=True)
    compared = commands.add_parser("compare")
    compared.add_argument("baseline")
    compared.add_argument("candidate")
    compared.add_argument("--out")
    return top


def _graph(index, kind: DistanceKind) -> beam.Graph:
    if kind is DistanceKind.FULL:
        return beam.load(index.graph, index.vectors)
    return beam.load(index.graph, index.vectors, index.pq_codes, pq.pivot_array(index.pq_pivots))


def _queries(spark: SparkSession, path: str, kind: str):
    return read_vectors(spark, path, kind).select(F.col("id").alias("qid"), "vector")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command."""
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("lodestar").getOrCreate()
    if a.command == "build":
        config = BuildConfig(**{k: getattr(a, k) for k in ("degree", "dense_degree", "r_ood", "l_ood", "build_l", "candidates", "alpha", "page_nodes", "ldg_times", "pq_subspaces", "pq_centroids", "pq_iterations", "toy_points", "partition_scale", "entry")})
        base = toy_vectors(spark, config.toy_points) if a.format == "toy" else read_vectors(spark, a.base, a.format)
        train = _queries(spark, a.train, a.train_format) if a.train else None
        print(build_index(base, a.out, config, train, pruned=a.graph == "pruned").meta)
    elif a.command == "search":
        index = load_index(spark, a.index)
        queries = spark.createDataFrame([(0, a.query)], "qid long, vector array<double>") if a.query else _queries(spark, a.queries, a.format)
        config = SearchConfig(top_k=a.top_k, beam_width=a.beam_width, l_search=a.l_search, l_pool=a.l_pool, mem_l=a.mem_l, refine_k=a.refine_k, refine_ratio=a.refine_ratio, range_partial=a.range_partial)
        beam.search(_graph(index, a.kind or index.default_kind), queries, index.meta["entry"], config).orderBy("qid", "rank").show(1000, False)
    elif a.command == "bench":
        index, queries = load_index(spark, a.index), _queries(spark, a.queries, a.format)
        truth = read_truth(spark, a.ground_truth) if a.ground_truth else exact.nearest(index.vectors, queries, a.recall_at_k or a.top_k) if a.generate_ground_truth else None
        sweep = Sweep(SearchConfig(top_k=a.top_k), index.default_kind, values={k: v for k, v in vars(a).items() if isinstance(v, list)})
        paged = {kind: beam.PagedGraph(_graph(index, kind), index.layout, index.graph, index.meta["entry"]) for kind in {kind for kind, _ in sweep.runs()}}
        rows = [bench.run_bench(spark, paged[kind].under(config), queries, index.meta["entry"], kind, config, truth, a.recall_at_k) for kind, config in sweep.runs()]
        folder = a.experiment_dir or bench.experiment_folder(a.experiment_root, a.label, a.index.rstrip("/").rpartition("/")[2], rows[0]["queries"])
        ids = None if truth is None else [list(map(int, r["ids"].split(","))) for r in exact.result_ids(truth).orderBy("qid").collect()]
        bench.write_experiment(folder, rows, ids)
        print(folder)
    elif a.command == "ground-truth":
        write_truth(exact.nearest(read_vectors(spark, a.base, a.format), _queries(spark, a.queries, a.format), a.top_k), a.out)
    elif a.command == "inspect":
        index = load_index(spark, a.index)
        bench.inspect_index(index.vectors, index.graph, index.layout).show(truncate=False)
        inspect_files(spark, a.index).show(100, truncate=False)
        if a.page is not None:
            inspect_page(index, a.page).show(1000, truncate=False)
    elif a.command == "merge":
        bench.write_tsv(bench.merge([bench.read_tsv(spark, x) for x in a.inputs]), a.out)
    else:
        measures = [*bench.TIME_COLUMNS, *[c for c in bench.COUNTERS if c not in bench.RUN_KEY], "average_recall"]
        rows = bench.compare(bench.read_tsv(spark, a.baseline), bench.read_tsv(spark, a.candidate), measures)
        if a.out:
            bench.write_tsv(rows, a.out)
        print(bench.compare_markdown(rows, a.baseline, a.candidate))
    return 0


if __name__ == "__main__":
    sys.exit(main())
