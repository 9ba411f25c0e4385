"""Language identification with error-correcting output codes.

Every language has a codeword of -1 and +1; one binary n-gram classifier for
each bit predicts it from the hashed byte n-grams of the whole text.  Decoding
sums, for every codeword, the classifiers' logistic losses weighted by how
reliable each classifier was on the sample, takes the smallest, and flags a
text as ambiguous whose runner-up comes close.

Learned on at most about ``SAMPLE_ROWS`` labelled rows, or ``LEAST_ROWS`` of each
language where those are more: an equal share of each language, drawn by a hash
of the id over the whole table.  The classifiers' reliability is measured on a
fifth of them, which the n-gram weights don't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.textkit import string_buffers
from lodestar.runtime import ship, tidy

SAMPLE_ROWS = 6000
LEAST_ROWS = 100  # of each language, where it has as many
BITS = 15  # hashed n-grams: 2**15 slots
ORDERS = (2, 3, 4)
BLOCK = 1 << 17
AMBIGUOUS = 0.65  # a best language with less of the softmax of losses is ambiguous
UNDETERMINED = "und"
_SLOTS = 1 << BITS


def _fold_table() -> np.ndarray:
    """Capitals to small letters; other ASCII to a space; bytes of longer characters stay."""
    t = np.full(256, 0x20, np.uint32)
    t[0x61:0x7B] = t[0x41:0x5B] = np.arange(0x61, 0x7B)
    t[0x80:] = np.arange(0x80, 0x100)
    return t


_FOLD = _fold_table()


def blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, slots, starts of the rows' slots) over blocks of bytes.

    A long row is spread over several blocks; slots of n-grams that leave
    their row or have no letter are ``_SLOTS``.
    """
    longest = max(ORDERS)
    for begin in range(0, len(data), BLOCK):
        end = min(begin + BLOCK, len(data))
        b = _FOLD[data[begin : min(end + longest - 1, len(data))]]
        n = end - begin
        first = int(np.searchsorted(offsets, begin, "right")) - 1
        last = int(np.searchsorted(offsets, end, "left"))
        bounds = np.clip(offsets[first : last + 1], begin, None)
        room = np.minimum(np.repeat(offsets[first + 1 : last + 1], np.diff(np.clip(offsets[first : last + 1], begin, end))) - np.arange(begin, end), longest)
        h = np.zeros(n, np.uint32)
        blank = np.ones(n, bool)
        out = np.empty((n, len(ORDERS)), np.int32)
        k = 0
        for i in range(longest):
            own = np.zeros(n, np.uint32)
            part = b[i : i + n]
            own[: len(part)] = part
            h = (h ^ own) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            blank &= own == 0x20
            if i + 1 in ORDERS:
                slot = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int32)
                slot[blank | (room < i + 1)] = _SLOTS
                out[:, k] = slot
                k += 1
        yield first, last, out.ravel(), (np.clip(bounds[:-1], begin, end) - begin) * len(ORDERS)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def codewords(k: int) -> np.ndarray:
    """k rows of -1 and +1: the exhaustive code for few languages, else the best of some random ones."""
    if k <= 6:
        width = max(1, 2 ** (k - 1) - 1)
        return np.array([[1] * width] + [[1 if j >> (k - 1 - i) & 1 else -1 for j in range(width)] for i in range(1, k)], float)[:k]
    width = 15 + int(np.ceil(6 * np.log2(k)))
    rng, best, found = np.random.default_rng(k), None, -1
    for _ in range(60):
        code = rng.choice([-1.0, 1.0], (k, width))
        code[:, np.abs(code.sum(0)) == k] *= np.where(np.arange(k) % 2, -1, 1)[:, None]
        apart = width - np.abs(code @ code.T)[~np.eye(k, dtype=bool)].max()
        if apart > found:
            best, found = code, apart
    return best


@dataclass
class Model:
    """Languages, their codewords, each bit's n-gram weights, and each bit's weight in decoding."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """rows x bits: mean evidence of a row's n-grams, times the root of their number."""
        rows = len(offsets) - 1
        total, n = np.zeros((rows, self.weights.shape[1])), np.zeros(rows)
        for first, last, slots, starts in blocks(data, offsets):
            filled = np.diff(np.append(starts, len(slots))) > 0
            at = np.flatnonzero(filled)
            total[first + at] += np.add.reduceat(self.weights[slots], starts[at], axis=0)
            n[first + at] += np.add.reduceat(slots < _SLOTS, starts[at])
        return total / np.sqrt(np.maximum(n, 1))[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest codeword, its share of the softmax of losses, whether it is ambiguous)."""
        loss = np.stack([(np.logaddexp(0, -margins * word) * self.trust).sum(1) for word in self.code], 1)
        best = loss.argmin(1)
        score = 1 / np.exp(loss[np.arange(len(loss)), best][:, None] - loss).sum(1)
        return best, np.clip(score, 0, 1), score < AMBIGUOUS


def _part(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null without id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(docs: DataFrame, learnable: Column, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> Model | None:
    """Fit on a sample of the rows for which ``learnable`` holds and ``lang`` is not null; None without any."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.filter(learnable & F.col("lang").isNotNull()).select("doc_id", "lang", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    place = {x: i for i, x in enumerate(languages)}
    share = max(LEAST_ROWS, sample_rows // len(languages))
    limit = F.create_map(*(F.lit(x) for name in languages for x in (name, min(1.0, share / counts[name]))))[F.col("lang")]
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))
    common = [x for x in languages if counts[x] >= LEAST_ROWS // 4]  # of rarer ones, all rows are learned from
    own = rows.filter(drawn < limit).withColumn("apart", F.col("lang").isin(common) & (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(5)) == 0))
    sample = own.filter("not apart").select("lang", "text").repartition(6)
    judged = own.filter("apart").select("lang", "text").repartition(6)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, _, slots, starts in blocks(*string_buffers(batch.column(1))):
                ends = np.append(starts[1:], len(slots))
                for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    if a < b:
                        own = found.setdefault(langs[first + i], np.zeros(_SLOTS + 1, np.float32))
                        own += np.bincount(slots[a:b], minlength=_SLOTS + 1)
        for lang, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([own[:_SLOTS].tobytes()], pa.binary())], ["lang", "counts"])

    share_of = np.zeros((len(languages), _SLOTS))
    for row in sample.mapInArrow(count, "lang string, counts binary").toLocalIterator():
        share_of[place[row["lang"]]] += np.frombuffer(row["counts"], np.float32)
    share_of = (share_of + 0.5) / (share_of + 0.5).sum(1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((_SLOTS + 1, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        plus, minus = code[:, bit] > 0, code[:, bit] < 0
        if plus.any() and minus.any():
            weights[:_SLOTS, bit] = np.log(share_of[plus].mean(0)) - np.log(share_of[minus].mean(0))
    model = Model(languages, code, weights, np.ones(code.shape[1]))

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong, n = np.zeros(code.shape[1]), 0
        for batch in batches:
            truth = code[[place[x] for x in batch.column(0).to_pylist()]]
            wrong += ((model.margins(*string_buffers(batch.column(1))) * truth) <= 0).sum(0)
            n += len(truth)
        yield pa.RecordBatch.from_arrays([pa.array([wrong.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["wrong", "n"])

    if len(languages) > 1:
        found = judged.mapInArrow(errors, "wrong array<double>, n long").collect()
        if not sum(r["n"] for r in found):
            return model
        rate = (np.sum([r["wrong"] for r in found], axis=0) + 1) / (sum(r["n"] for r in found) + 2)
        trust = np.log((1 - np.minimum(rate, 0.49)) / np.minimum(rate, 0.49))
        model.trust = trust / trust.mean()
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred, score, ambiguous`` of every whole text; columns of these names are replaced.

    A text that is null or has no letter, or any text without a model, is
    ``und`` with score 0, not ambiguous.  Only ``text`` is looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    rest = docs.drop("lang_pred", "score", "ambiguous")
    place = rest.columns.index("text")
    shared = spark.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = batch.column(place)
            data, offsets = string_buffers(texts)
            if fitted is None or not len(texts):
                names, score, unsure = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            else:
                best, score, unsure = fitted.decode(fitted.margins(data, offsets))
                letters = np.concatenate([[0], np.cumsum((_FOLD[data] != 0x20) & (data < 0x80))])[offsets]
                names = [fitted.languages[i] for i in best.tolist()]
                for row in np.flatnonzero(letters[1:] == letters[:-1]).tolist():
                    if not _has_letter(texts[row].as_py()):
                        names[row], score[row], unsure[row] = UNDETERMINED, 0.0, False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    schema = T.StructType([*rest.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return rest.mapInArrow(tidy(label), schema)


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows whose id's crc32 is not 2 modulo 4, predict for all.

    Adds ``held_out`` (that remainder is 2; false without id) to what
    ``predict`` adds.  Rows without id are not learned from.
    """
    held_out = F.coalesce(_part(F.col("doc_id")) == 2, F.lit(False))
    model = train(docs, ~held_out & F.col("doc_id").isNotNull())
    return predict(docs, model).withColumn("held_out", held_out)
