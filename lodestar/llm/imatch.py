"""I-Match fingerprints: hashed sets of the terms within a band of inverse document frequency.

A *term* is a maximal run outside ``[\\x20\\x09-\\x0D]``, ASCII capitals
folded.  The *lexicon* holds every term whose share of documents lies within
the band; the band's lower share bounds the lexicon's size, because the shares
of all terms together are the mean number of distinct terms of a document:
``len(lexicon) <= mean distinct terms / low_share``.  The lexicon is drawn on
by ``SUBSETS`` randomised subsets; each hashes the document's sorted distinct
terms that fall into it.  Frequencies count all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.textkit import _U, _mix, chunks, sorted_sets, string_buffers, word_hashes
from lodestar.runtime import ship, task_count, tidy

#: Shares of documents between which a term belongs to the lexicon: idf from ln 5 to ln 1000.
LOW_SHARE, HIGH_SHARE = 0.001, 0.2
#: The share of the lexicon in each randomised subset; small subsets still agree after larger edits.
SUBSETS = (1 / 4,) * 8 + (1 / 16,) * 8 + (1 / 64,) * 16
EMPTY = "-" * 8
FLUSH_TERMS = 2_000_000


def _term_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct terms, row starts) by chunk."""
    data, offsets = string_buffers(column)
    for a, b in chunks(offsets):
        yield a, b, *sorted_sets(*word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``term, df``: in how many rows each term stands.  Counted within a task first, then summed."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = [], []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            both, n = np.concatenate(terms), np.concatenate(counts)
            order = np.argsort(both)
            both = both[order]
            at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
            return both[at], np.add.reduceat(n[order], at)

        for batch in batches:
            for _, _, values, _ in _term_sets(batch.column(0)):
                if len(values):
                    own, n = np.unique(values, return_counts=True)
                    terms.append(own)
                    counts.append(n)
                if sum(map(len, terms)) > FLUSH_TERMS:
                    own, n = merged()
                    terms, counts = [own], [n]
                    if len(own) > FLUSH_TERMS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["term", "df"])
                        terms, counts = [], []
        if terms:
            own, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["term", "df"])

    partial = docs.select(F.col("text").cast("string")).mapInArrow(count, "term long, df long")
    return partial.groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, low_share: float = LOW_SHARE, high_share: float = HIGH_SHARE) -> np.ndarray:
    """Sorted term hashes within the band; see above for the bound on their number."""
    n = docs.count()
    within = document_frequencies(docs).filter(F.col("df").between(low_share * n, high_share * n)).select("term")
    return np.sort(within.toPandas()["term"].to_numpy(np.int64).view(_U))


def fingerprints(column: pa.Array, terms: np.ndarray) -> list[str]:
    """One fingerprint for each text of a column.

    Eight hex digits for each subset, ``EMPTY`` for a subset with none of the
    text's terms.  A text without any lexicon term gets ``=`` and a hash of
    all its distinct terms, so that only equal term sets share it; null and
    empty texts have the empty set.
    """
    out: list[str] = []
    seeds = _mix(np.arange(1, len(SUBSETS) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    limits = [_U(int(share * 2**32)) for share in SUBSETS]
    for _, _, values, at in _term_sets(column):
        place = np.minimum(np.searchsorted(terms, values), max(len(terms) - 1, 0))
        inside = terms[place] == values if len(terms) else np.zeros(len(values), bool)
        kept = values[inside]
        starts = np.concatenate([[0], np.cumsum(inside)])[at]
        rows = len(at) - 1
        digits = np.full((rows, len(SUBSETS)), EMPTY, dtype="U8")
        for k, (seed, limit) in enumerate(zip(seeds, limits, strict=True)):
            drawn = _mix(kept ^ seed)
            chosen = (drawn & _U(0xFFFFFFFF)) < limit
            total = np.concatenate([np.zeros(1, _U), np.cumsum(np.where(chosen, _mix(drawn + seed), _U(0)))])
            n = np.concatenate([[0], np.cumsum(chosen)])
            value = _mix(total[starts[1:]] - total[starts[:-1]]) >> _U(32)
            for row in np.flatnonzero(n[starts[1:]] > n[starts[:-1]]):
                digits[row, k] = f"{value[row]:08x}"
        for row in range(rows):
            if starts[row] < starts[row + 1]:
                out.append("".join(digits[row]))
            else:
                out.append("=" + hashlib.sha1(values[at[row] : at[row + 1]].tobytes()).hexdigest()[:16])
    return out


def likeness(a: str, b: str) -> float:
    """Share of equal subset hashes among the subsets that either text has terms in; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    if a[0] == "=" or b[0] == "=":
        return 0.0
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
    filled = [x for x in pairs if x != (EMPTY, EMPTY)]
    return sum(x == y for x, y in filled) / len(filled) if filled else 0.0


Row = tuple[int, int, str]


def _packed(rows: list[Row]) -> bytes:
    sink = pa.BufferOutputStream()
    ids, hashes, texts = zip(*rows, strict=True)
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(texts, pa.large_string())], ["doc_id", "hash", "text"])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


def _unpacked(blob: bytes) -> list[Row]:
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
    return list(zip(*(table[c].to_pylist() for c in ("doc_id", "hash", "text")), strict=True))


_NULL_ID = -(1 << 63)
_LAST = (1 << 63) - 1
COARSE = 2048


class Ranges:
    """Ranges of (id, hash) pairs: each ends with one of ``bounds``, the last one with the largest pair."""

    def __init__(self, bounds: list[tuple[int, int]]):
        self.ids, self.hashes = (np.array([b[k] for b in bounds], np.int64) for k in (0, 1))

    def __len__(self) -> int:
        return len(self.ids) + 1

    def of(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The range of each pair: the number of bounds before it."""
        out, ends = np.searchsorted(self.ids, ids), np.searchsorted(self.ids, ids, "right")
        for first in np.unique(out[ends > out + 1]).tolist():  # ids with several bounds
            own = np.flatnonzero((out == first) & (ends > out + 1))
            out[own] += np.searchsorted(self.hashes[first : ends[own[0]]], hashes[own])
        return out


def id_ranges(rows: DataFrame, n: int) -> Ranges:
    """About n ranges of similar size for ``rows(doc_id, hash)``, each with at least one row.

    Every bound is a pair of the table and the last of its range.  Ids that
    fill several ranges are cut by the hash.  Many ranges are found in two
    steps, so that no plan holds more than ``COARSE`` quantiles; a few bytes
    for each range reach the driver.
    """

    def shares(k: int) -> list[float]:
        return [i / k for i in range(1, k)]

    def grouped(cuts: np.ndarray) -> DataFrame:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, batch.column(0).to_numpy()).astype(np.int32)), batch.column(0)], ["range", "doc_id"])

        return rows.select("doc_id").mapInArrow(deal, "range int, doc_id long").groupBy("range")

    first = min(n, COARSE)
    found = rows.agg(F.percentile_approx("doc_id", shares(max(2, first)), 20 * first).alias("at"), F.max("doc_id").alias("most")).first()
    if found["most"] is None:
        return Ranges([])
    within = -(-n // first)
    filled = {x: times * within for x, times in zip(*(y.tolist() for y in np.unique(found["at"], return_counts=True)), strict=True)}
    if within > 1:
        for r in grouped(np.array(sorted(filled), np.int64)).agg(F.percentile_approx("doc_id", shares(within), 20 * within).alias("at")).collect():
            for x in r["at"]:
                filled[x] = filled.get(x, 0) + 1
    hot = {x: times for x, times in filled.items() if times >= 3 * within or times >= 3 and within > 1 and times > within}
    cuts: dict[int, list[int]] = {}
    if hot:
        names, most = np.array(sorted(hot), np.int64), min(max(hot.values()), COARSE)
        for r in rows.filter(F.col("doc_id").isin(sorted(hot))).groupBy("doc_id").agg(F.percentile_approx("hash", shares(most), 20 * most).alias("at"), F.max("hash").alias("most")).collect():
            step = max(1, most // hot[r["doc_id"]])
            cuts[r["doc_id"]] = [x for x in sorted(set(r["at"][step - 1 :: step])) if x < r["most"]]
        before = grouped(names).agg(F.max(F.when(~F.col("doc_id").isin(sorted(hot)), F.col("doc_id"))).alias("last")).collect()
        filled.update({r["last"]: 1 for r in before if r["last"] is not None})
    bounds = []
    for x in sorted(filled):
        bounds += [(x, cut) for cut in cuts.get(x, [])]
        if x < found["most"]:
            bounds.append((x, _LAST))
    return Ranges(bounds)


def edited_fingerprints(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has the last third of the code points replaced by the
    beginning of the next document's, in descending ``doc_id`` order; after
    the last document comes the first.  Equal ids follow in descending order of
    a hash of the text, then of the text; null ids come last.  Texts travel
    once, in compressed blocks, to the range of ids they belong to; each range
    also gets the largest document of the range below from every block, so that
    order needs no single task.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    ranges = id_ranges(rows.select("doc_id", "hash"), 2 * task_count(docs))
    parts = len(ranges)
    shared = spark.sparkContext.broadcast(terms)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            part = ranges.of(ids, hashes)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
            to, halo, blobs = [], [], []
            for own in np.split(order, cuts[1:]):
                held = list(zip(ids[own].tolist(), hashes[own].tolist(), texts.take(pa.array(own)).to_pylist(), strict=True))
                here = int(part[own[0]])
                to += [here, (here + 1) % parts]
                halo += [False, True]
                blobs += [_packed(held), _packed([max(held)])]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(halo), pa.array(blobs, pa.binary())], ["part", "halo", "blob"])

    def finish(pairs: list[Row], after: Row) -> Iterator[pa.RecordBatch]:
        pairs.sort(reverse=True)
        lexicon_terms = shared.value
        following = [*pairs[1:], after]
        begin, size = 0, 0
        for end in range(1, len(pairs) + 1):
            size += len(pairs[end - 1][2])
            if size < 1 << 21 and end < len(pairs):
                continue
            texts = [x[2] for x in pairs[begin:end]]
            nexts = [x[2] for x in following[begin:end]]
            edited = []
            for own, follows in zip(texts, nexts, strict=True):
                third = len(own) // 3
                edited.append(own[: len(own) - third] + follows[:third])
            arrow = lambda x: pa.array(x, pa.large_string())
            mine, after_edit = fingerprints(arrow(texts), lexicon_terms), fingerprints(arrow(edited), lexicon_terms)
            theirs = [*mine[1:], *fingerprints(arrow(nexts[-1:]), lexicon_terms)]
            ids = [None if x[0] == _NULL_ID else x[0] for x in pairs[begin:end]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]), pa.array(mine), pa.array(after_edit), pa.array(map(likeness, mine, after_edit), pa.float64()), pa.array(map(likeness, mine, theirs), pa.float64())],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            begin, size = end, 0

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs, below = -1, [], []
        for batch in batches:
            for part, halo, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part != now:
                    if pairs:
                        yield from finish(pairs, max(below))
                    now, pairs, below = part, [], []
                (below if halo else pairs).extend(_unpacked(blob.as_py()))
        if pairs:
            yield from finish(pairs, max(below))

    dealt = rows.mapInArrow(deal, "part int, halo boolean, blob binary").repartitionById(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(tidy(compare), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
