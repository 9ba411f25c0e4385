"""Exact self-join of documents on the Jaccard similarity of their word shingles.

Documents with equal shingle sets form a *class*; only classes are joined.

1. One scan hashes the shingles, gives each document its size and class, and
   counts hashed shingles in a fixed number of slots over all classes.
2. Shingles are put in one global order: those in crowded slots last, else by
   hash.  Two sets that reach the threshold share a shingle among the first
   ``n - least overlap + 1`` of each (any common order has this property; this
   one keeps passages that many documents share out of these heads).  A second
   scan emits the heads; the classes that share a head shingle are a *tile*.
3. Small tiles give candidate pairs under the positional bound.  A large tile
   gives the pairs of each of its classes with its hub, the class that is in
   most large tiles.
4. A third scan gives the classes of tiles a bitmap signature: ``|A ^ B| >=
   popcount(a ^ b)`` bounds the overlap from above and screens the pairs.
   A fourth fetches the sorted shingle hashes of classes that are left,
   and pairs are intersected exactly: first one for each class, then those
   whose classes these links don't connect.
5. Large tiles that hold more than one component by then are cut into blocks,
   each within two neighbouring bands of sizes; signatures screen the pairs of
   different components there.  Of each class outside of a tile's largest
   component the pair that they rate best is intersected as before.  Tiles
   that are mixed even then get the members of the classes that have pairs
   left, intersect these where they lie, and give a forest of links.
6. Connected components of the links, on each class's smallest id.

Pairs that links already connect are left out; no other pair is, and no group
is capped.  What is written of a large tile follows the classes, not the pairs of a group.
Equality of shingles is equality of 64-bit hashes; of classes, of 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.components import Forest, roots
from lodestar.llm.slots import flags_over, id_filter, in_filter, partial_rows
from lodestar.llm.textkit import _STEP, _U, _mix, chunks, shingle_hashes, sorted_sets, string_buffers
from lodestar.runtime import discard, saved, ship, size_of, task_count, tidy

WIDTH, PERCENT = 5, 80
#: Counters of shingles: one for each ``BYTES_PER_SLOT`` of the table, within these bounds.
LEAST_SLOTS, MOST_SLOTS, BYTES_PER_SLOT = 1 << 20, 1 << 23, 128
LEAST_CROWD = 40
#: Classes of a tile that gives all its pairs.
SMALL_TILE = 64
#: Shingles of all sets in a tile that is not cut; blocks of cut tiles have half as many.
BLOCK = 1 << 21
#: Bits of a signature for each member, rounded up to a power of two.
BITS = 4
FLUSH = 500_000
HEAD_BYTES_PER_PART = 12 << 20
#: Bits of the largest filter of ids that goes to all tasks, at eight for an id; more ids are joined instead.
FILTER_BITS = 1 << 26

_KEY = np.dtype([("x", "<u8"), ("y", "<u8")])


def least_partner(n: np.ndarray, percent: int) -> np.ndarray:
    """The smallest set size that can reach the threshold with a set of n."""
    return -(-percent * n // 100)


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection of sets of n and m that reaches the threshold."""
    return -(-percent * (n + m) // (100 + percent))


def head_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles of a set of n hold one of every similar set's."""
    return n - least_overlap(n, least_partner(n, percent), percent) + 1


def class_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits for each row's set of hashes."""
    out = np.zeros(len(at) - 1, _KEY)
    size = np.diff(at).astype(_U)
    for name, step in (("x", _STEP[4]), ("y", _STEP[12])):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(_mix(values ^ step))])
        out[name] = _mix(total[at[1:]] - total[at[:-1]] + size * step)
    return out


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = string_buffers(column)
    for a, b in chunks(offsets):
        yield a, b, *sorted_sets(*shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width))


def _keys_column(keys: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys))]).cast(pa.binary())


def _keys_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _KEY)


class _Fresh:
    """Which rows' classes a task meets for the first time."""

    def __init__(self) -> None:
        self.seen: set[bytes] = set()

    def rows(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        raw = keys.tobytes()
        for i in np.flatnonzero(at[1:] > at[:-1]).tolist():
            key = raw[16 * i : 16 * i + 16]
            if key not in self.seen:
                self.seen.add(key)
                out[i] = True
        return out


def _sketched(rows: DataFrame, width: int, slots: int) -> DataFrame:
    """``doc_id, n, cls`` of every row, and ``range, packed`` rows of each task's slot counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, counts = _Fresh(), np.zeros(slots, np.uint32)
        names = ["doc_id", "n", "cls", "range", "packed"]
        for batch in batches:
            for a, b, values, at in _sets(batch.column(1), width):
                keys = class_keys(values, at)
                new = np.repeat(fresh.rows(keys, at), np.diff(at))
                np.add.at(counts, (values[new] & _U(slots - 1)).astype(np.int64), np.uint32(1))
                none = pa.nulls(b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), _keys_column(keys), none.cast(pa.int32()), none.cast(pa.binary())], names)
        where, packed = partial_rows(counts)
        none = pa.nulls(len(where))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), where, packed], names)

    return saved(rows.mapInArrow(tidy(scan), "doc_id long, n long, cls binary, range int, packed binary"), "shingle-classes")


def _pack(tokens: np.ndarray, rows: np.ndarray, places: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> bytes:
    used, own = np.unique(rows, return_inverse=True)
    head = np.array([len(tokens), len(used)], np.int64)
    return b"".join(x.tobytes() for x in (head, tokens, own.astype(np.uint32), places, keys[used], sizes[used]))


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, docs = np.frombuffer(raw, np.int64, 2).tolist()
    at, out = 16, []
    for kind, count in ((_U, n), (np.uint32, n), (np.uint16, n), (_KEY, docs), (np.int64, docs)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    return tuple(out)


def heads(values: np.ndarray, at: np.ndarray, crowded: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, their rows, their places) of each sorted set's head under the global order."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    late = crowded[(values & _U(len(crowded) - 1)).astype(np.int64)]
    early = np.concatenate([[0], np.cumsum(~late)])
    before = early[:-1] - early[at[:-1]][row]
    n_early = (early[at[1:]] - early[at[:-1]])[row]
    place = np.where(late, n_early + np.arange(len(values)) - at[:-1][row] - before, before)
    kept = place < head_length(n, percent)[row]
    return values[kept], row[kept], np.minimum(place[kept], 65535).astype(np.uint16)


def _head_blocks(rows: DataFrame, crowded: np.ndarray, parts: int, width: int, percent: int) -> DataFrame:
    """``part, blob``: the heads of all classes, packed for the range of tokens they belong to."""
    flags = rows.sparkSession.sparkContext.broadcast(np.packbits(crowded))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.unpackbits(flags.value).astype(bool)
        fresh, held, n_held, base = _Fresh(), [], 0, 0

        def flush() -> pa.RecordBatch:
            tokens, owner, places, keys, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            part = (_mix(tokens) % _U(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
            blobs = [_pack(tokens[own], owner[own], places[own], keys, sizes) for own in np.split(order, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part[order][cuts]), pa.array(blobs, pa.binary())], ["part", "blob"])

        for batch in batches:
            for _, _, values, at in _sets(batch.column(0), width):
                keys = class_keys(values, at)
                new = fresh.rows(keys, at)
                tokens, owner, places = heads(values, at, full, percent)
                mine = new[owner]
                if mine.any():
                    held.append((tokens[mine], owner[mine] + base, places[mine], keys, np.diff(at)))
                    n_held, base = n_held + int(mine.sum()), base + len(keys)
                if n_held > FLUSH:
                    yield flush()
                    held, n_held, base = [], 0, 0
        if held:
            yield flush()

    return rows.select("text").mapInArrow(tidy(emit), "part int, blob binary")


def _tile_pairs(tokens: np.ndarray, cls: np.ndarray, sizes: np.ndarray, places: np.ndarray, tile: np.ndarray, percent: int) -> np.ndarray:
    """Candidate pairs (as smaller * 2**32 + larger class number) within tiles sorted by size."""
    found, live = [], np.arange(len(tokens) - 1)
    step = 1
    while len(live):
        a, b = live, live + step
        same = (tile[a] == tile[b]) & (100 * sizes[a] >= percent * sizes[b])  # past its band, a row has no further partner
        a, b = a[same], b[same]
        left = np.minimum(sizes[a] - places[a], sizes[b] - places[b])  # this shingle and all behind it
        fit = left >= least_overlap(sizes[a], sizes[b], percent)
        low, high = np.minimum(cls[a], cls[b])[fit], np.maximum(cls[a], cls[b])[fit]
        found.append(low << 32 | high)
        if len(found) > 16:
            found = [np.unique(np.concatenate(found))]
        step += 1
        live = a[a + step < len(tokens)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _candidates(blocks: DataFrame, parts: int, percent: int) -> DataFrame:
    """``a, b`` of candidate pairs, and ``token, a, n`` of the classes in large tiles (then without b)."""

    def solve(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        pieces = [_unpack(x) for x in blobs]
        starts = np.cumsum([0, *(len(x[3]) for x in pieces)])
        tokens = np.concatenate([x[0] for x in pieces])
        doc = np.concatenate([x[1].astype(np.int64) + s for x, s in zip(pieces, starts, strict=False)])
        places = np.concatenate([x[2] for x in pieces]).astype(np.int64)
        keys, cls_of = np.unique(np.concatenate([x[3] for x in pieces]), return_inverse=True)
        sizes = np.concatenate([x[4] for x in pieces])[doc]
        cls = cls_of.astype(np.int64)[doc]
        order = np.argsort(tokens)
        tokens = tokens[order]
        twin = np.zeros(len(tokens), bool)
        twin[1:] = tokens[1:] == tokens[:-1]
        twin[:-1] |= twin[1:]
        order, tokens = order[twin], tokens[twin]
        cls, sizes, places = cls[order], sizes[order], places[order]
        order = np.lexsort((cls, sizes, tokens))
        tokens, cls, sizes, places = tokens[order], cls[order], sizes[order], places[order]
        if len(tokens):  # copies that several tasks emitted
            once = np.append(True, (tokens[1:] != tokens[:-1]) | (cls[1:] != cls[:-1]))
            tokens, cls, sizes, places = tokens[once], cls[once], sizes[once], places[once]
        first = np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)]
        tile = np.cumsum(first) - 1
        count = np.bincount(tile)[tile] if len(tile) else tile
        small, large = (count > 1) & (count <= SMALL_TILE), count > SMALL_TILE
        names = ["a", "b", "token", "n"]
        pairs = _tile_pairs(tokens[small], cls[small], sizes[small], places[small], tile[small], percent)
        for i in range(0, len(pairs), 1 << 17):
            own = pairs[i : i + (1 << 17)]
            none = pa.nulls(len(own)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([_keys_column(keys[own >> 32]), _keys_column(keys[own & 0xFFFFFFFF]), none, none], names)
        if large.any():
            yield pa.RecordBatch.from_arrays([_keys_column(keys[cls[large]]), pa.nulls(int(large.sum())).cast(pa.binary()), pa.array(tokens[large].view(np.int64)), pa.array(sizes[large])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now and blobs:
                    yield from solve(blobs)
                    blobs = []
                now = part
                blobs.append(blob.as_py())
        if blobs:
            yield from solve(blobs)

    dealt = blocks.repartitionById(parts, "part").sortWithinPartitions("part")
    return saved(dealt.mapInArrow(tidy(run), "a binary, b binary, token long, n long"), "candidates")


def bitmap_bits(n: int) -> int:
    """Bits of the signature of a set of n: ``BITS`` to twice as many for each member, a power of two."""
    return max(64, 1 << (BITS * n - 1).bit_length())


def bitmap(values: np.ndarray) -> np.ndarray:
    """The signature of a set, as 64-bit words."""
    bits = bitmap_bits(len(values))
    at = np.unique((values >> _U(20)) & _U(bits - 1)).astype(np.int64)
    out = np.zeros(bits // 64, _U)
    np.bitwise_or.at(out, at // 64, _U(1) << (at % 64).astype(_U))
    return out


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A signature of ``size`` words from a longer one: bits that fall together are or-ed."""
    while len(words) > size:
        half = len(words) // 2
        words = words[:half] | words[half:]
    return words


def overlap_bound(a: np.ndarray, b: np.ndarray, n: int, m: int) -> int:
    """At most so many members are shared: the signatures' differing bits differ in the sets too."""
    size = min(len(a), len(b))
    return (n + m - int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())) // 2


def shared_members(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _fetched(rows: DataFrame, wanted: DataFrame, width: int, name: str, value: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``cls, n`` and the binary ``name`` of the wanted classes (and a few others), from one document of each.

    ``wanted(cls, rep)`` is a saved table.
    """
    count = wanted.count()
    bits = max(1 << 16, 1 << (8 * count).bit_length())
    flags = None
    if bits <= FILTER_BITS:
        flags = rows.sparkSession.sparkContext.broadcast(id_filter(wanted.select("rep"), bits))
    else:
        rows = rows.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        for batch in batches:
            if flags is not None and batch.num_rows:
                batch = batch.filter(pa.array(in_filter(flags.value, batch.column(0).to_numpy())))
            for _, _, values, at in _sets(batch.column(1), width):
                keys = class_keys(values, at)
                own = np.flatnonzero(fresh.rows(keys, at))
                found = [value(values[at[i] : at[i + 1]]).tobytes() for i in own.tolist()]
                yield pa.RecordBatch.from_arrays([_keys_column(keys[own]), pa.array(np.diff(at)[own]), pa.array(found, pa.binary())], ["cls", "n", name])

    out = saved(rows.filter(F.col("doc_id").isNotNull()).mapInArrow(tidy(fetch), f"cls binary, n long, {name} binary"), name)
    if flags is not None:
        flags.destroy()
    return out


_PAIR = ("a", "b", "rep_a", "rep_b")
_PAIR_SCHEMA = "a binary, b binary, rep_a long, rep_b long"


def _within_bound(pairs: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures allow enough overlap."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            need = least_overlap(n, m, percent)
            words = [[np.frombuffer(x, _U) for x in batch.column(i).to_pylist()] for i in ("bits_a", "bits_b")]
            kept = [overlap_bound(x, y, i, j) >= k for x, y, i, j, k in zip(*words, n.tolist(), m.tolist(), need.tolist(), strict=True)]
            yield batch.select(_PAIR).filter(pa.array(kept, pa.bool_()))

    one = features.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    two = features.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select(*_PAIR, "n_a", "bits_a", "n_b", "bits_b").mapInArrow(tidy(check), _PAIR_SCHEMA)


def _intersected(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the threshold, by exact intersection."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                kept.append(shared_members(a, b) >= int(least_overlap(len(a), len(b), percent)))
            yield batch.select(_PAIR).filter(pa.array(kept, pa.bool_()))

    one = members.select(F.col("cls").alias("a"), F.col("members").alias("set_a"))
    two = members.select(F.col("cls").alias("b"), F.col("members").alias("set_b"))
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select(*_PAIR, "set_a", "set_b").mapInArrow(tidy(check), _PAIR_SCHEMA)


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose classes are in different components."""
    of = lambda side: labels.select(F.col("vertex").alias(f"rep_{side}"), F.col("component").alias(f"label_{side}"))
    both = pairs.join(of("a"), "rep_a", "left").join(of("b"), "rep_b", "left")
    return both.filter(F.coalesce("label_a", "rep_a") != F.coalesce("label_b", "rep_b")).select(*_PAIR)


def _links(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links among ``pairs`` that connect all that the links among them connect.

    First each class's pair with the class of most pairs, then the pairs whose
    classes the links found so far leave apart.
    """
    turned = pairs.select("a", "b", "rep_a", "rep_b", F.col("rep_a").alias("own"), F.col("rep_b").alias("other"))
    ends = turned.unionByName(turned.select("a", "b", "rep_a", "rep_b", F.col("other").alias("own"), F.col("own").alias("other")))
    degree = ends.groupBy(F.col("own").alias("other")).agg(F.count(F.lit(1)).alias("degree"))
    best = ends.join(degree, "other").groupBy("own").agg(F.max(F.struct("degree", "other", *_PAIR)).alias("best"))
    chosen = saved(best.select(*(f"best.{c}" for c in _PAIR)).distinct(), "chosen-pairs")
    first = saved(_intersected(chosen, members, percent), "links")
    labels = roots(_edges(first))
    rest = saved(_labelled(pairs, labels).join(chosen.select("a", "b"), ["a", "b"], "left_anti"), "other-pairs")
    second = saved(_intersected(rest, members, percent), "links")
    discard(chosen, rest)
    return first.unionByName(second)


def _hub_pairs(large: DataFrame, percent: int) -> DataFrame:
    """Every class of a large tile with the tile's hub, where their sizes can reach the threshold."""
    ranked = large.join(large.groupBy("cls").agg(F.count(F.lit(1)).alias("tiles")), "cls")
    hub = ranked.groupBy("token").agg(F.max(F.struct("tiles", "rep", "cls", "n")).alias("hub"))
    met = ranked.join(hub, "token").filter(F.col("cls") != F.col("hub.cls"))
    met = met.filter(100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
    first = F.col("cls") < F.col("hub.cls")
    one = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return met.select(one("cls", "hub.cls").alias("a"), one("hub.cls", "cls").alias("b"), one("rep", "hub.rep").alias("rep_a"), one("hub.rep", "rep").alias("rep_b")).distinct()


def _blocks_of_tiles(rows: DataFrame, percent: int) -> DataFrame:
    """``tile, side, cls, rep, n, label`` of large tiles cut block against block, from ``token, cls, rep, n, label``.

    A tile whose sets have up to ``BLOCK`` members together is one (side 2).  Of a larger one, each
    band of sizes is cut into blocks by hash; a block meets itself, the other
    blocks of its band and those of the next band (sides 0 and 1).
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)
    kept = ("cls", "rep", "n", "label")
    rows = rows.select("token", *kept, band.alias("band"))
    whole = rows.groupBy("token").agg(F.sum("n").alias("held"))
    sized = rows.join(whole, "token")
    small = sized.filter(F.col("held") <= BLOCK).select(F.col("token").cast("string").alias("tile"), F.lit(2).alias("side"), *kept)
    wide = sized.filter(F.col("held") > BLOCK)
    cut = wide.groupBy("token", "band").agg(F.ceil(F.sum("n") / (BLOCK // 2)).cast("int").alias("cuts"))
    near = lambda d, name: cut.select("token", (F.col("band") - d).alias("band"), F.col("cuts").alias(name))
    dealt = wide.join(cut, ["token", "band"]).join(near(1, "above"), ["token", "band"], "left").join(near(-1, "below"), ["token", "band"], "left")
    own = F.pmod(F.xxhash64("cls"), F.col("cuts")).cast("int")
    name = lambda b1, i, b2, j: F.concat_ws(":", "token", b1, i, b2, j)
    upto = lambda c: F.sequence(F.lit(0), F.coalesce(c, F.lit(0)) - 1)
    some = lambda c, made: F.when(F.coalesce(c, F.lit(0)) > 0, made).otherwise(F.array().cast("array<struct<tile:string,side:int>>"))
    here = F.transform(upto(F.col("cuts")), lambda j: F.struct(name(F.col("band"), F.least(j, F.col("own")), F.col("band"), F.greatest(j, F.col("own"))).alias("tile"), F.when(j == F.col("own"), 2).when(F.col("own") < j, 0).otherwise(1).alias("side")))
    up = some(F.col("above"), F.transform(upto(F.col("above")), lambda j: F.struct(name(F.col("band"), F.col("own"), F.col("band") + 1, j).alias("tile"), F.lit(0).alias("side"))))
    down = some(F.col("below"), F.transform(upto(F.col("below")), lambda j: F.struct(name(F.col("band") - 1, j, F.col("band"), F.col("own")).alias("tile"), F.lit(1).alias("side"))))
    spread = dealt.withColumn("own", own).withColumn("x", F.explode(F.concat(here, up, down))).select("x.tile", "x.side", *kept)
    return small.unionByName(spread)


def _mixed(rows: DataFrame, name: str) -> DataFrame:
    """The rows of groups that hold more than one component."""
    mixed = rows.groupBy(name).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select(name)
    return rows.join(mixed, name, "left_semi")


def bounded_pairs(bits: list[np.ndarray], n: np.ndarray, label: np.ndarray, first: np.ndarray, second: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of first x second whose labels differ and whose sizes and signatures allow a link."""
    for x, y, _ in _rated_pairs(bits, n, label, first, second, percent):
        yield x, y


def _rated_pairs(bits: list[np.ndarray], n: np.ndarray, label: np.ndarray, first: np.ndarray, second: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``bounded_pairs``, and the similarity that the signatures allow each pair at most."""
    first, second = first[np.argsort(n[first], kind="stable")], second[np.argsort(n[second], kind="stable")]
    words, i = np.array([len(x) for x in bits]), 0
    while i < len(first):
        j = i + int(np.searchsorted(n[first[i:]], 5 * n[first[i]] // 4, "right"))
        own = first[i : min(j, i + 256)]
        i += len(own)
        low, high = least_partner(n[own[0]], percent), 100 * n[own[-1]] // percent
        near = second[np.searchsorted(n[second], low) : np.searchsorted(n[second], high, "right")]
        for k in range(0, len(near), 8192):
            other = near[k : k + 8192]
            size = min(words[own].min(), words[other].min())
            left, right = (np.stack([folded(bits[x], size) for x in rows.tolist()]) for rows in (own, other))
            differ = np.zeros((len(own), len(other)), np.int64)
            for w in range(size):
                differ += np.bitwise_count(left[:, w][:, None] ^ right[:, w][None])
            both = n[own][:, None] + n[other][None]
            most = (both - differ) // 2
            fit = (most >= least_overlap(n[own][:, None], n[other][None], percent)) & (label[own][:, None] != label[other][None])
            x, y = np.nonzero(fit)
            yield own[x], other[y], most[x, y] / (both[x, y] - most[x, y])


def _sides(sides: np.ndarray, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows against rows that hold all pairs of different components: those outside of the largest against all."""
    names, codes = np.unique(label, return_inverse=True)
    outside = codes != np.bincount(codes).argmax()
    if (sides == 2).all():
        return [(np.flatnonzero(outside), np.arange(len(sides)))]
    first, second = sides == 0, sides == 1
    return [(np.flatnonzero(first & outside), np.flatnonzero(second)), (np.flatnonzero(first & ~outside), np.flatnonzero(second & outside))]


def _once(tiles: DataFrame) -> DataFrame:
    """The tiles of a saved table without those of the same rows as another: their pairs are the same."""
    kind = tiles.groupBy("tile").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("cls", "side").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64("side", "cls")).alias("y"))
    out = saved(tiles.join(kind.groupBy("rows", "x", "y").agg(F.min("tile").alias("tile")).select("tile"), "tile", "left_semi"), "tiles")
    discard(tiles)
    return out


def _mixed_tiles(large: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Blocks of large tiles that hold several components, each set of rows once."""
    own = labels.select(F.col("vertex").alias("rep"), F.col("component").alias("label"))
    rows = saved(large.join(own, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "labelled-tiles")
    mixed = saved(_mixed(rows, "token"), "mixed-tiles")
    blocks = saved(_blocks_of_tiles(mixed, percent), "tile-blocks")
    tiles = _once(saved(_mixed(blocks, "tile"), "tiles"))
    discard(rows, mixed, blocks)
    return tiles


_TILE = ("tile", "side", "cls", "rep", "n", "label")
_TILE_SCHEMA = "tile string, side int, cls binary, rep long, n long, label long"


def _held(held: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(held[c].to_numpy() for c in ("side", "cls", "rep", "n", "label"))


def _with(tiles: DataFrame, features: DataFrame, name: str) -> DataFrame:
    # small on disk, where repeated keys cost little, this table is large in memory: no broadcasts
    return tiles.join(features.select("cls", name).hint("merge"), "cls").select(*_TILE, name)


def _pairs_across(tiles: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """For each class outside of its tile's largest component, the pair of different components that the signatures rate best."""

    def screen(key: tuple, held: pa.Table) -> pa.Table:
        side, keys, rep, n, label = _held(held)
        bits = [np.frombuffer(x, _U) for x in held["bits"].to_pylist()]
        partner, rate = np.full(len(keys), -1), np.full(len(keys), -1.0)
        names, codes = np.unique(label, return_inverse=True)
        outside = codes != np.bincount(codes).argmax()
        for first, second in _sides(side, label):
            for x, y, found in _rated_pairs(bits, n, label, first, second, percent):
                order = np.argsort(found, kind="stable")  # the last of a row that is assigned is its best
                for one, two in ((x[order], y[order]), (y[order], x[order])):
                    best = found[order]
                    better = outside[one] & (best > rate[one])
                    partner[one[better]], rate[one[better]] = two[better], best[better]
        pairs = {(i, j) if keys[i] < keys[j] else (j, i) for i, j in enumerate(partner.tolist()) if j >= 0}
        columns = list(zip(*((keys[i], keys[j], rep[i], rep[j]) for i, j in pairs), strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], _PAIR)

    return saved(_with(tiles, features, "bits").groupBy("tile").applyInArrow(screen, _PAIR_SCHEMA).distinct(), "pairs-across")


def _links_within(tiles: DataFrame, features: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that connect what the tiles' classes of different components connect."""

    def screen(key: tuple, held: pa.Table) -> pa.Table:
        side, _, _, n, label = _held(held)
        bits = [np.frombuffer(x, _U) for x in held["bits"].to_pylist()]
        met = np.zeros(len(n), bool)
        for first, second in _sides(side, label):
            for x, y in bounded_pairs(bits, n, label, first, second, percent):
                met[x] = met[y] = True
        return held.select(_TILE).filter(pa.array(met))

    def link(key: tuple, held: pa.Table) -> pa.Table:
        side, _, rep, n, label = _held(held)
        sets = [np.frombuffer(x, _U) for x in held["members"].to_pylist()]
        bits = [bitmap(x) for x in sets]
        names, codes = np.unique(label, return_inverse=True)
        forest, now, found = Forest(len(names)), np.arange(len(names)), []
        for first, second in _sides(side, label):
            for x, y, rate in _rated_pairs(bits, n, label, first, second, percent):
                apart = now[codes[x]] != now[codes[y]]
                x, y, rate = x[apart], y[apart], rate[apart]
                order = np.argsort(-rate, kind="stable")
                for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
                    a, b = int(codes[i]), int(codes[j])
                    if forest.root(a) != forest.root(b) and shared_members(sets[i], sets[j]) >= int(least_overlap(len(sets[i]), len(sets[j]), percent)):
                        forest.join(a, b)
                        found.append((rep[i], rep[j]))
                now = np.array([forest.root(i) for i in range(len(names))])
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    left = _once(saved(_with(tiles, features, "bits").groupBy("tile").applyInArrow(screen, _TILE_SCHEMA), "tiles-left"))
    out = saved(_with(left, members, "members").groupBy("tile").applyInArrow(link, "a long, b long").distinct(), "links")
    discard(left)
    return out


def _edges_across(large: DataFrame, edges: DataFrame, features: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``edges``, and links among classes of large tiles that connect all that their links connect."""
    tiles = _mixed_tiles(large, roots(edges), percent)
    across = _pairs_across(tiles, features, percent)
    discard(tiles)
    edges = edges.unionByName(_edges(_links(across, members, percent)))
    discard(across)
    tiles = _mixed_tiles(large, roots(edges), percent)
    if tiles.limit(1).count():
        edges = edges.unionByName(_links_within(tiles, features, members, percent))
    discard(tiles)
    return edges


def _shared_ids(own: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the smallest id of a class and its ids that other classes have, too."""
    several = own.groupBy("doc_id").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high").select("doc_id")
    return own.join(several, "doc_id", "left_semi").join(classes, "cls").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``.

    Two documents link when ``100 * intersection >= percent * union`` of their
    sets of distinct ``width``-word shingles; ``component_id`` is the smallest
    ``doc_id`` within reach.  Fewer words than ``width`` are one shingle.  Null
    and empty texts have no shingle and link with nothing.  Rows without id
    link with nothing and have no component.  Rows of one id that have
    shingles are one document to the components.  Extra columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (size_of(docs) // BYTES_PER_SLOT).bit_length()))
    scanned = _sketched(rows, width, slots)
    own = scanned.filter(F.col("range").isNull()).select("doc_id", "n", "cls")
    named = own.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = saved(named.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "classes")
    load = (classes.agg(F.sum("n")).first()[0] or 0) // slots
    crowded = flags_over(scanned.filter(F.col("range").isNotNull()), slots, max(LEAST_CROWD, load + 8 * math.isqrt(load)))
    classes_of = lambda side: classes.select(F.col("cls").alias(side), F.col("rep").alias(f"rep_{side}"))
    rows = rows.filter(F.col("doc_id").isNotNull())
    parts = task_count(docs, HEAD_BYTES_PER_PART, floor=8)
    found = _candidates(_head_blocks(rows, crowded, parts, width, percent), parts, percent)
    large = saved(found.filter(F.col("b").isNull()).select("token", F.col("a").alias("cls"), "n").join(classes.select("cls", "rep"), "cls"), "large-tiles")
    pairs = found.filter(F.col("b").isNotNull()).select("a", "b").distinct().join(classes_of("a"), "a").join(classes_of("b"), "b")
    pairs = saved(pairs.unionByName(_hub_pairs(large, percent)).distinct(), "pairs")
    discard(found)
    ends = lambda frame: frame.select(F.col("a").alias("cls"), F.col("rep_a").alias("rep")).unionByName(frame.select(F.col("b").alias("cls"), F.col("rep_b").alias("rep")))
    wanted = saved(ends(pairs).unionByName(large.select("cls", "rep")).distinct(), "wanted")
    features = _fetched(rows, wanted, width, "bits", bitmap)
    close = saved(_within_bound(pairs, features, percent), "close-pairs")
    discard(pairs, wanted)
    wanted = saved(ends(close).unionByName(large.select("cls", "rep")).distinct(), "wanted")
    members = _fetched(rows, wanted, width, "members", np.ascontiguousarray)
    edges = _edges(_links(close, members, percent))
    discard(close, wanted)
    if large.limit(1).count():
        edges = _edges_across(large, edges, features, members, percent)
    edges = edges.unionByName(_shared_ids(named, classes))
    placed = classes.join(roots(edges), F.col("rep") == F.col("vertex"), "left").select("cls", F.coalesce("component", "rep").alias("component_id"))
    placed = saved(placed, "placed-classes")
    discard(members, features, large, classes)
    lone = own.filter((F.col("n") == 0) | F.col("doc_id").isNull())
    return (
        named.join(placed, "cls")
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        .unionByName(lone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    )
