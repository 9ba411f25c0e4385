"""Experiments: statistics, summaries, sweeps, and the files and comparisons made of them."""

from __future__ import annotations

import os
import time
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import beam, exact
from lodestar.plans.config import SWEEP_AXES, DistanceKind, SearchConfig, Sweep, as_row, sanitize_label

# Columns of a summary file, in order.
CONFIG_COLUMNS = "approx_kind approx_backend top_k beam_width l_search graph_cache_budget_bytes graph_cache_policy refine_k refine_ratio defer_exact_until_refinement scheduler_policy scheduler_policy_limit dynamic_beam_policy queries".split()
TIME_COLUMNS = "elapsed_ms average_latency_ms qps".split()
COUNTERS = (
    "async_reads pages_completed resident_expansions approx_evals exact_evals n_ios n_cmps n_hops cpu_us io_us bytes_read page_resident_hits "
    "graph_replicated_hits graph_cache_hits graph_cache_misses graph_cache_expansions graph_cache_avoided_reads graph_cache_resident_bytes graph_cache_entries "
    "graph_cache_build_page_reads exact_from_page exact_from_payload refinement_candidates refinement_reads approximate_candidates refinement_bound "
    "refinement_already_exact refinement_exactified deferred_exact_candidates read_hits_in_pool read_waste_out_of_pool max_inflight_reads max_beam_width "
    "beam_width_increases scheduler_policy_limit_observed scheduler_pending_max scheduler_ready_unexpanded_max scheduler_limit_hits poll_calls drain_calls range_stop"
).split()
TSV_COLUMNS = [*CONFIG_COLUMNS, *TIME_COLUMNS, *COUNTERS, "average_recall", "first_query_result_ids"]
LARGEST = {"graph_cache_resident_bytes", "graph_cache_entries", "graph_cache_build_page_reads", "max_inflight_reads", "max_beam_width", "scheduler_policy_limit_observed", "scheduler_pending_max", "scheduler_ready_unexpanded_max"}
#: What makes two runs the same run; the second group only if asked for.
RUN_KEY = [c for c in CONFIG_COLUMNS if c != "approx_backend"]
FINER_KEY = ["mem_l", "l_pool", "range_partial"]
REQUIRED = [*CONFIG_COLUMNS[:1], "top_k", "beam_width", "l_search", "queries", *TIME_COLUMNS]


def fold(column: str) -> Column:
    """How a counter of single queries becomes one of a run."""
    if column == "range_stop":
        return F.bool_or(column).alias(column)
    return (F.max if column in LARGEST else F.sum)(column).alias(column)


def accumulate(stats: DataFrame, by: list[str], counters: list[str]) -> DataFrame:
    """Counters folded by group; partial folds run before the shuffle."""
    return stats.groupBy(*by).agg(*[fold(c) for c in counters])


def bench_summary(results: DataFrame, truth: DataFrame | None, k: int) -> DataFrame:
    """One row: queries, counters, mean recall (null without truth), and the first query's ids."""
    per_query = results.groupBy("qid").agg(F.max("n_hops").alias("n_hops"), F.max("n_cmps").alias("n_cmps"), F.max("exact_evals").alias("exact_evals"), F.max("cache_hits").alias("cache_hits"), F.max("pages_touched").alias("pages_touched"), F.bool_or("range_stop").alias("range_stop"))
    out = per_query.agg(F.count(F.lit(1)).alias("queries"), F.sum("n_hops").alias("n_hops"), F.sum("n_cmps").alias("n_cmps"), F.sum("exact_evals").alias("exact_evals"), F.sum("cache_hits").alias("cache_hits"), F.sum("pages_touched").alias("pages_touched"), F.bool_or("range_stop").alias("range_stop"))
    ids = exact.result_ids(results).agg(F.min_by("ids", "qid").alias("first_query_result_ids"))
    mean = exact.recall(results, truth, k).agg(F.round(F.avg("recall"), 6).alias("average_recall")) if truth is not None else ids.select(F.lit(None).cast("double").alias("average_recall"))
    return out.join(F.broadcast(ids)).join(F.broadcast(mean))  # single rows


def run_bench(spark: SparkSession, graph: beam.Graph, queries: DataFrame, entry: int, kind: DistanceKind, config: SearchConfig, truth: DataFrame | None, k: int = 0) -> dict:
    """One timed run as a row of the summary file; reads are counted as distinct pages of each query, other counters of disk reads are null."""
    began = time.perf_counter()
    found = beam.search(graph, queries, entry, config)
    rows = found.collect()
    elapsed = (time.perf_counter() - began) * 1000
    back = spark.createDataFrame(rows, found.schema)
    one = bench_summary(back, truth, k or config.top_k).first().asDict()
    asked = queries.count()
    made = as_row(config) | {"approx_kind": kind.value, "approx_backend": "pq" if graph.codes is not None else "full", "queries": asked, "elapsed_ms": elapsed, "average_latency_ms": elapsed / max(1, asked), "qps": asked / elapsed * 1000}
    made |= {"n_hops": one["n_hops"], "n_cmps": one["n_cmps"], "approx_evals": one["n_cmps"], "exact_evals": one["exact_evals"], "n_ios": one["pages_touched"] if graph.page is not None else None, "graph_cache_hits": one["cache_hits"] if graph.cached is not None else None, "graph_cache_expansions": one["cache_hits"] if graph.cached is not None else None, "range_stop": one["range_stop"], "average_recall": one["average_recall"], "first_query_result_ids": one["first_query_result_ids"]}
    made["defer_exact_until_refinement"] = int(made["defer_exact_until_refinement"])
    return {c: made.get(c) for c in TSV_COLUMNS}


def sweep_grid(spark: SparkSession, sweep: Sweep) -> DataFrame:
    """``run`` and the axes, one row for each combination in order: cross joins of the axes' few values."""
    grid = None
    for name in SWEEP_AXES:
        values = [getattr(v, "value", v) for v in sweep.axis(name)]
        own = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"`{name}_at` int, `{name}` {'string' if isinstance(values[0], str) else 'boolean' if isinstance(values[0], bool) else 'double' if isinstance(values[0], float) else 'long'}")
        size = F.lit(len(values))
        if grid is None:
            grid = own.select(F.col(f"{name}_at").cast("long").alias("run"), name)
        else:
            grid = grid.crossJoin(F.broadcast(own)).withColumn("run", F.col("run") * size + F.col(f"{name}_at")).drop(f"{name}_at")
    return grid.select("run", *SWEEP_AXES)


def write_tsv(rows: DataFrame, path: str) -> None:
    """A summary file: fixed six decimals, truth values as 0 and 1, recall -1 where there is none, nulls as 0."""
    types = dict(rows.dtypes)

    def text(name: str) -> Column:
        c = F.col(name)
        if name == "average_recall":
            c = F.coalesce(c, F.lit(-1.0))
        if types[name] in ("double", "float"):
            return F.format_string("%.6f", F.coalesce(c.cast("double"), F.lit(0.0)))
        if types[name] == "boolean":
            c = c.cast("int")
        return F.coalesce(c.cast("string"), F.lit("" if types[name] == "string" else "0"))

    rows.select(*[text(c).alias(c) for c in rows.columns]).coalesce(1).write.option("sep", "\t").option("header", True).option("quote", "\u0000").csv(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A summary file by its header: newer columns that it lacks are 0, older ones must be there; -1 recall is null."""
    header = spark.read.text(path).limit(1).collect()
    names = header[0][0].split("\t") if header else []
    if len(set(names)) < len(names):
        raise ValueError("a column is there twice")
    if missing := [c for c in REQUIRED if c not in names]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    raw = spark.read.option("sep", "\t").option("header", True).option("mode", "FAILFAST").schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    strings = {"approx_kind", "approx_backend", "graph_cache_policy", "scheduler_policy", "dynamic_beam_policy", "first_query_result_ids"}
    doubles = {"refine_ratio", "average_recall", *TIME_COLUMNS}
    out = []
    for name in TSV_COLUMNS:
        kind = "string" if name in strings else "double" if name in doubles else "long"
        c = F.col(name).cast(kind) if name in names else F.lit(None).cast(kind) if kind == "string" or name == "average_recall" else F.lit(0).cast(kind)
        out.append((F.when(c >= 0, c) if name == "average_recall" else c).alias(name))
    return raw.select(*out)


def merge(summaries: list[DataFrame]) -> DataFrame:
    """All rows of several summaries by column name; a column that one lacks is null there."""
    if not summaries:
        raise ValueError("there is nothing to merge")
    out = summaries[0]
    for more in summaries[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def compare(baseline: DataFrame, candidate: DataFrame, measures: list[str], key: list[str] = RUN_KEY, order: str | None = None) -> DataFrame:
    """Candidate rows beside the baseline row of the same key, with ``delta_<measure>`` (candidate less baseline).

    Of several baseline rows of a key the first counts (by ``order``, else by
    all measures); candidates without one are left out; a null measure is 0.
    Keys meet in an ordinary equi-join, which splits hot keys at run time.
    """
    first = baseline.groupBy(*key).agg(F.min(F.struct(*([order] if order else []), *measures)).alias("was"))
    on = None
    left = candidate.alias("c")
    right = first.select(*[F.col(k).alias(f"__{k}") for k in key], "was")
    for k in key:
        same = F.col(f"c.{k}").eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    zero = lambda c: F.coalesce(c, F.lit(0))
    deltas = [(zero(F.col(f"c.{m}")) - zero(F.col(f"was.{m}"))).alias(f"delta_{m}") for m in measures]
    return left.join(right, on).select(*[F.col(f"c.{k}").alias(k) for k in key], *[F.col(f"was.{m}").alias(f"baseline_{m}") for m in measures], *[F.col(f"c.{m}").alias(f"candidate_{m}") for m in measures], *deltas)


# Columns of a comparison in Markdown, and where they come from.
MARKDOWN = {
    "approx_kind": "approx_kind",
    "beam_width": "beam_width",
    "l_search": "l_search",
    "graph_cache_budget_bytes": "graph_cache_budget_bytes",
    "graph_cache_policy": "graph_cache_policy",
    "refine_k": "refine_k",
    "refine_ratio": "refine_ratio",
    "defer_exact": "defer_exact_until_refinement",
    "scheduler_policy": "scheduler_policy",
    "scheduler_limit": "scheduler_policy_limit",
    "dynamic_beam": "dynamic_beam_policy",
    "baseline_qps": "baseline_qps",
    "candidate_qps": "candidate_qps",
    "delta_qps": "delta_qps",
    "baseline_recall": "baseline_average_recall",
    "candidate_recall": "candidate_average_recall",
    "delta_recall": "delta_average_recall",
    "baseline_latency_ms": "baseline_average_latency_ms",
    "candidate_latency_ms": "candidate_average_latency_ms",
    "delta_latency_ms": "delta_average_latency_ms",
}


def compare_markdown(rows: DataFrame, baseline: str = "baseline", candidate: str = "candidate") -> str:
    """A small comparison as Markdown, rows in key order; no recall is -1; an error without any row."""
    found = rows.orderBy(*[c for c in RUN_KEY if c in rows.columns]).collect()
    if not found:
        raise ValueError("no run of the candidate has its like in the baseline")

    def text(name: str, v: object) -> str:
        v = -1.0 if v is None and name.endswith("recall") else v
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    lines = ["# Bench Comparison", "", f"- Baseline: `{baseline}`", f"- Candidate: `{candidate}`", f"- Matched runs: {len(found)}", ""]
    texts = {"approx_kind", "graph_cache_policy", "scheduler_policy", "dynamic_beam"}
    lines += ["| " + " | ".join(MARKDOWN) + " |", "| " + " | ".join("---" if c in texts else "---:" for c in MARKDOWN) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(text(c, r[own]) for c, own in MARKDOWN.items()) + " |" for r in found)]) + "\n"


def experiment_folder(root: str, label: str = "", stem: str = "index", queries: int = 0, now: datetime | None = None) -> str:
    """A new folder name: the label, or stem, number of queries and UTC time; ``_1``, ``_2`` ... where taken."""
    name = sanitize_label(label) if label else f"{sanitize_label(f'{stem}_q{queries}')}_{(now or datetime.now(UTC)):%Y%m%dT%H%M%SZ}"
    path, n = os.path.join(root, name), 0
    while os.path.exists(path):
        n += 1
        path = os.path.join(root, f"{name}_{n}")
    return path


def write_experiment(folder: str, rows: list[dict], truth: list[list[int]] | None = None) -> None:
    """``summary.tsv``, ``manifest.txt``, ``ground_truth.txt`` if given, and ``runs/run_000.txt`` ... of a finished sweep."""
    os.makedirs(os.path.join(folder, "runs"))
    text = lambda v: "0" if v is None else f"{v:.6f}" if isinstance(v, float) else str(int(v) if isinstance(v, bool) else v)
    shown = [{c: text(-1.0 if c == "average_recall" and r.get(c) is None else r.get(c)) for c in TSV_COLUMNS} for r in rows]
    with open(os.path.join(folder, "summary.tsv"), "w") as out:
        out.write("\n".join("\t".join(x) for x in [TSV_COLUMNS, *(list(r.values()) for r in shown)]) + "\n")
    with open(os.path.join(folder, "manifest.txt"), "w") as out:
        out.write(f"runs: {len(rows)}\nqueries: {rows[0]['queries'] if rows else 0}\n")
    if truth is not None:
        with open(os.path.join(folder, "ground_truth.txt"), "w") as out:
            out.writelines(" ".join(map(str, ids)) + "\n" for ids in truth)
    for i, r in enumerate(shown):
        with open(os.path.join(folder, "runs", f"run_{i:03d}.txt"), "w") as out:
            out.writelines(f"{k}: {v}\n" for k, v in r.items())


def inspect_index(base: DataFrame, graph: DataFrame, layout: DataFrame) -> DataFrame:
    """One row: points, dimension, edges, largest degree, pages, most nodes on a page, copies of nodes."""
    a = base.agg(F.count(F.lit(1)).alias("points"), F.max(F.size("vector")).alias("dim"))
    b = graph.agg(F.sum(F.size("nbrs")).alias("edges"), F.max(F.size("nbrs")).alias("max_degree"))
    pages = layout.groupBy("page_id").agg(F.count(F.lit(1)).alias("held"))
    c = pages.agg(F.count(F.lit(1)).alias("pages"), F.max("held").alias("max_page_nodes"), F.sum("held").alias("stored_nodes"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # single rows
