"""Settings of builds, searches and sweeps, and the checks made before a plan is built."""

from __future__ import annotations

import itertools
import math
import re
import sys
from dataclasses import dataclass, field, fields, replace
from enum import Enum


class DistanceKind(str, Enum):
    """Which distance leads a traversal."""

    PQ = "pq"
    FULL = "full"


class CachePolicy(str, Enum):
    """Which adjacency is kept when there is a byte budget."""

    ENTRY_BFS = "entry_bfs"
    PAGE_LAYOUT = "page_layout"


class SchedulerPolicy(str, Enum):
    """Read throttling; accepted for sweeps, without effect on results."""

    CONSERVATIVE = "conservative"
    BOUNDED = "bounded"
    AGGRESSIVE = "aggressive"


class BeamPolicy(str, Enum):
    """Beam sizing; accepted for sweeps, without effect on results."""

    ADAPTIVE = "adaptive"
    FIXED = "fixed"


class FilterMode(str, Enum):
    """Where an attribute filter is applied."""

    AUTO = "auto"
    PRE = "pre"
    IN = "in"
    POST = "post"


def parse_enum(kind: type[Enum], text: str) -> Enum:
    """The member of that value; an error names the choices."""
    try:
        return kind(text.strip().lower())
    except ValueError:
        raise ValueError(f"{text!r} is none of {', '.join(x.value for x in kind)}") from None


def parse_list(text: str, kind: str = "int") -> list:
    """Comma-separated values: ``int``, ``float``, ``bool``, or an enum class; an empty list is an error."""
    words = [w.strip() for w in text.split(",") if w.strip()]
    if not words:
        raise ValueError("the list is empty")
    if isinstance(kind, type) and issubclass(kind, Enum):
        return [parse_enum(kind, w) for w in words]
    if kind == "bool":
        known = {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}
        if bad := [w for w in words if w.lower() not in known]:
            raise ValueError(f"{bad[0]!r} is no truth value")
        return [known[w.lower()] for w in words]
    made = [int(w) if kind == "int" else float(w) for w in words]
    if kind == "int" and min(made) < 0:
        raise ValueError("numbers can't be negative")
    return made


def parse_vector(text: str) -> list[float]:
    """An inline query: floats separated by white space."""
    made = [float(w) for w in text.split()]
    if not made:
        raise ValueError("the vector is empty")
    return made


@dataclass(frozen=True)
class SearchConfig:
    """Knobs of one search; zero means unset where the text says so."""

    top_k: int = 5
    beam_width: int = 4
    l_search: int = 12
    l_pool: int = 0  # 0: l_search
    mem_l: int = 0  # 0: start at the entry point
    graph_cache_budget_bytes: int = 0
    graph_cache_policy: CachePolicy = CachePolicy.ENTRY_BFS
    refine_k: int = 0
    refine_ratio: float = 0.0
    defer_exact_until_refinement: bool = False
    scheduler_policy: SchedulerPolicy = SchedulerPolicy.CONSERVATIVE
    scheduler_policy_limit: int = 0
    dynamic_beam_policy: BeamPolicy = BeamPolicy.ADAPTIVE
    range_partial: float = math.inf

    @property
    def pool(self) -> int:
        """Pool size L."""
        return self.l_pool or self.l_search

    @property
    def capacity(self) -> int:
        """How many candidates are kept at all."""
        return max(8 * self.pool, 8 * self.beam_width, 2 * max(self.pool, self.refine_bound(10**9)))

    @property
    def scheduler_limit(self) -> int:
        """Reads in flight that the policy stands for."""
        times = {SchedulerPolicy.CONSERVATIVE: 1, SchedulerPolicy.BOUNDED: 2, SchedulerPolicy.AGGRESSIVE: 4}
        return self.scheduler_policy_limit or self.beam_width * times[self.scheduler_policy]

    def refine_bound(self, pool_size: int, least: int | None = None) -> int:
        """How many candidates get exact distances in a refinement."""
        wanted = self.refine_k or (math.ceil(self.pool * self.refine_ratio) if self.refine_ratio else self.pool)
        return min(max(wanted, self.top_k if least is None else least), pool_size)

    def checked(self, query_dim: int | None = None, index_dim: int | None = None) -> SearchConfig:
        """Itself, or a ``ValueError``."""
        if query_dim != index_dim:
            raise ValueError("the query's dimension is not the index's")
        for name in ("top_k", "beam_width", "l_search"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not math.isfinite(self.refine_ratio) or self.refine_ratio < 0:
            raise ValueError("refine_ratio must be finite and not negative")
        return self


@dataclass(frozen=True)
class BuildConfig:
    """Knobs of an index build."""

    degree: int = 4
    dense_degree: int = 0  # 0: twice the degree
    r_ood: int = 0  # edges of a node that training queries choose; without such queries there are none
    l_ood: int = 1500  # rows near a training query that it chooses among
    build_l: int = 64  # nearest rows that pruning starts from, at least the degree
    candidates: int = 128  # of a node, reverse edges included, when it is pruned again
    alpha: float = 1.2
    page_nodes: int = 4
    partition_scale: float = 0.0  # 0: the page capacity
    ldg_times: int = 4
    entry: int | None = None
    pq_subspaces: int = 3
    pq_centroids: int = 4
    pq_iterations: int = 6
    toy_points: int = 12

    @property
    def dense(self) -> int:
        """Dense degree in force."""
        return self.dense_degree or 2 * self.degree

    def checked(self, dim: int | None = None, points: int | None = None) -> BuildConfig:
        """Itself, or a ``ValueError``."""
        problems = [
            (min(self.degree, self.build_l, self.candidates, self.page_nodes, self.pq_subspaces, self.pq_centroids, self.pq_iterations, self.toy_points, self.l_ood) <= 0, "counts must be positive"),
            (0 < self.dense_degree < self.degree, "dense_degree must not be below degree"),
            (not 0 <= self.r_ood < self.degree, "r_ood must be below degree"),
            (self.build_l > self.candidates, "build_l must not exceed candidates"),
            (not self.alpha >= 1, "alpha must be 1 or more"),
            (self.partition_scale < 0 or 0 < self.partition_scale < 1, "partition_scale must be 0, or 1 and more"),
            (dim is not None and dim % self.pq_subspaces, "the dimension must be a multiple of pq_subspaces"),
            (points is not None and self.entry is not None and not 0 <= self.entry < points, "the entry point is not in the data"),
        ]
        for wrong, why in problems:
            if wrong:
                raise ValueError(why)
        return self


def partition_sizes(points: int, capacity: int, scale: float = 0.0) -> tuple[int, int]:
    """(pages, primary pages) of a replicated partition; scale 0 stands for the capacity."""
    if points <= 0 or capacity <= 0:
        raise ValueError("points and capacity must be positive")
    scale = scale or float(capacity)
    if scale == 1 or capacity == 1:
        return math.ceil(points / capacity), 0
    pages = math.ceil(points * scale / capacity)
    return pages, min(pages, max(0, (capacity * pages - points) // (capacity - 1)))


#: Order of the axes of a sweep, outermost first: (field of SearchConfig or ``kind``).
SWEEP_AXES = ("kind", "beam_width", "l_search", "graph_cache_budget_bytes", "graph_cache_policy", "refine_k", "refine_ratio", "defer_exact_until_refinement", "scheduler_policy", "scheduler_policy_limit", "dynamic_beam_policy")


@dataclass(frozen=True)
class Sweep:
    """Values for each axis; an empty list stands for the base value."""

    base: SearchConfig = field(default_factory=SearchConfig)
    kind: DistanceKind = DistanceKind.PQ
    values: dict[str, list] = field(default_factory=dict)

    def axis(self, name: str) -> list:
        """Values of one axis."""
        if name not in SWEEP_AXES:
            raise ValueError(f"{name} is no axis")
        return self.values.get(name) or [self.kind if name == "kind" else getattr(self.base, name)]

    def runs(self) -> list[tuple[DistanceKind, SearchConfig]]:
        """Every combination, the last axis changing fastest."""
        out = []
        for combo in itertools.product(*(self.axis(x) for x in SWEEP_AXES)):
            chosen = dict(zip(SWEEP_AXES, combo, strict=True))
            out.append((chosen.pop("kind"), replace(self.base, **chosen)))
        return out


def sanitize_label(text: str) -> str:
    """A label as part of a folder name: small letters, digits, ``_`` and ``-``; any other byte is a ``_``."""
    return re.sub(rb"[^a-z0-9_-]", b"_", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())).decode() or "experiment"


def as_row(config: SearchConfig) -> dict:
    """Plain values of a config, enums by value."""
    return {f.name: getattr(v := getattr(config, f.name), "value", v) for f in fields(config)}


def filter_costs(selectivity: float, precision: float, prefilter_reads: float, infilter_reads: float, config: SearchConfig, points: int, degree: int, dense: int, l_max: int = 0) -> dict[FilterMode, int]:
    """Estimated cost of each filter mode: ten for a read, one for a comparison, both whole numbers."""
    read, compare, share = 10, 1, 0.05
    s, p = max(selectivity, sys.float_info.epsilon), max(precision, sys.float_info.epsilon)
    l, most = config.l_search, l_max or config.pool
    if not dense:
        equal = float(l)
    elif s * dense / p <= degree:
        equal = l / s * degree / dense
    else:
        equal = l / p
    reads = {FilterMode.PRE: prefilter_reads + most, FilterMode.IN: infilter_reads + equal, FilterMode.POST: l / s}
    compares = {FilterMode.PRE: s * points, FilterMode.IN: equal * (degree + share * dense), FilterMode.POST: degree * l / s}
    return {m: read * int(reads[m]) + compare * int(compares[m]) for m in reads}


def choose_filter_mode(costs: dict[FilterMode, int], mode: FilterMode = FilterMode.AUTO) -> FilterMode:
    """The given mode, or the cheapest: pre before in before post where costs are equal."""
    if mode is not FilterMode.AUTO:
        return mode
    return min((FilterMode.PRE, FilterMode.IN, FilterMode.POST), key=lambda m: costs[m])
