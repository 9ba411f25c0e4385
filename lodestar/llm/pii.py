"""Personal data: exact base patterns, and further spans by a semi-Markov conditional random field.

The base spans (``base_spans``) are fixed patterns with checks.  The field is
trained on windows around them: a labelled segmentation of a window's tokens
into whole spans of a kind and single other tokens.  Features look at a whole
candidate span (digits, collapsed shape, checksum, number parts, neighbours);
dynamic programming over spans of at most ``LONGEST`` tokens chooses borders
and kinds together.  What it finds beside the base spans is added; base spans
stay as they are.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.runtime import ship, tidy

KINDS = ("email", "ip", "card", "phone")
# The base patterns.  Of the address the parts around the sign stand alone, and
# the numbers of an IP are cut out of dotted runs, so that long texts take linear time.  Nothing
# follows a repeated group, so that possessive repeats (no memory for each round) find the same.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Documents whose windows the field may learn from, and windows it learns from, at most (in expectation), and their characters.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_CHARS = 20_000, 1200, 400
EPOCHS, RATE, DECAY = 8, 0.2, 1e-4
LONGEST = 15
#: How far (in log odds) a span has to be ahead of leaving its tokens unlabelled.
AHEAD = 2.0
#: Digits of a candidate without ``@``; one of four numbers between dots may have fewer.
LEAST_DIGITS, MOST_DIGITS = 7, 24
#: Tokens that are segmented at once.  A longer stretch passes in pieces that overlap, so that a piece holds every candidate.
MOST_TOKENS = 512

_HIT = re.compile("[0-9@]")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
_PART = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.S)
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _digits_within(text: str, begin: int, end: int, most: int) -> int:
    """How many digits there are, counted up to more than ``most``."""
    n = 0
    for m in _RUN.finditer(text, begin, end):
        n += len(m[0])
        if n > most:
            break
    return n


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base matches, by kind and start: leftmost and not overlapping within a kind.

    A match that fails its kind's check is dropped without another try.
    """
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((0, begin, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):  # four parts make a match, the next four the next one
            start, end = m.span()
            while start < end:
                at = start
                for _ in range(3):
                    at = text.find(".", at, end) + 1
                    if not at:
                        break
                if not at:
                    break
                dot = text.find(".", at, end)
                stop = dot if dot >= 0 else end
                if all(_small(x) for x in text[start:stop].split(".")):
                    out.append((1, start, stop))
                start = stop + 1
        # 19 digits and as many separators are fewer than 40 characters
        out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= m.end() - m.start() < 40 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= _digits_within(text, *m.span(), 15) <= 15]
    return out


_DIGIT = re.compile("[0-9]")
_RUN = re.compile("[0-9]+")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches worth a look: chunks with a digit or ``@``, joined over single blanks, with the chunks beside them."""
    done, n = 0, len(text)

    def left(i: int) -> int:
        while i > done and not text[i - 1].isspace():
            i -= 1
        return i

    def right(i: int) -> int:
        while i < n and not text[i].isspace():
            i += 1
        return i

    hit = _HIT.search(text)
    while hit:
        begin, end = left(hit.start()), right(hit.end())
        while end < n and end + 1 < n and not text[end + 1].isspace() and _HIT.search(text, end + 1, right(end + 1)):
            end = right(end + 1)
        start = left(begin - 1) if begin > done + 1 else begin
        stop = right(end + 1) if end + 1 < n else end
        digits = _digits_within(text, begin, end, LEAST_DIGITS)
        if digits >= LEAST_DIGITS or text.count("@", begin, end) or digits >= 4 and text.count(".", begin, end) >= 3:
            yield start, stop
        done = end
        hit = _HIT.search(text, end)


def _side(c: str) -> str:
    return "none" if not c else "blank" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


def _shape(text: str) -> str:
    parts = (m[0] for m in islice(_PART.finditer(text), 28))
    return "".join("9" if p[0].isdigit() else "a" if p[0].isalpha() else " " if p[0].isspace() else p for p in parts)


def features(text: str, start: int, end: int, tokens: int, low: int = 0, high: int | None = None) -> list[str]:
    """What the field knows of a candidate span as a whole, within the window from ``low`` to ``high``."""
    around = text[start - 1 : start] if start > low else "", text[end : end + 1] if end < (len(text) if high is None else high) else ""
    text = text[start:end]
    parts = _RUN.findall(text)
    digits = "".join(parts)
    out = ["bias", f"digits={min(len(digits), 24)}", f"shape={_shape(text)}", f"tokens={tokens}", f"parts={'-'.join(str(min(len(p), 9)) for p in parts[:6])}", f"before={_side(around[0])}", f"after={_side(around[1])}", f"first={_side(text[0])}", f"last={_side(text[-1])}"]
    if "@" in text:
        out.append(f"at={text.count('@')},{'.' in text.rpartition('@')[2]}")
    letters = sum(c.isalpha() for c in text)
    out.append(f"letters={min(letters, 1)},{letters > len(digits)}")
    if 13 <= len(digits) <= 19 and not letters:
        out.append(f"luhn={luhn(digits)}")
    if len(parts) == 4 and text.count(".") == 3:
        out.append(f"octets={all(_small(p) for p in parts)}")
    return out


def lattice(text: str, low: int = 0, high: int | None = None, start: int | None = None, most: int | None = None) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
    """(token borders, candidate spans as (first border, last border, features)) of the window from ``low`` to ``high``.

    A candidate has enough digits, one ``@``, or four numbers and three dots;
    it begins and ends with something other than white space, and has at most
    ``LONGEST`` tokens.  ``start`` and ``most`` take that many of the window's
    tokens from there.
    """
    high = len(text) if high is None else high
    cuts = [low if start is None else start]
    cuts += [m.end() for m in islice(_TOKEN.finditer(text, cuts[0], high), most)]
    words = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    digits, ats, dots, runs = [0], [0], [0], [0]
    for w in words:
        n = sum(map(len, _RUN.findall(w)))
        digits.append(digits[-1] + n)
        runs.append(runs[-1] + (n == len(w)))
        ats.append(ats[-1] + (w == "@"))
        dots.append(dots[-1] + (w == "."))
    out = []
    for i, w in enumerate(words):
        if w.isspace() or not (w[0].isalnum() or w in "+(_%"):
            continue
        for j in range(i + 1, min(i + LONGEST, len(words)) + 1):
            if "\n" in words[j - 1]:
                break
            n, at = digits[j] - digits[i], ats[j] - ats[i]
            if n > MOST_DIGITS:
                break
            last = words[j - 1]
            if not (last[-1].isalnum()) or at > 1:
                continue
            if not at and n < LEAST_DIGITS and not (runs[j] - runs[i] == 4 and dots[j] - dots[i] == 3):
                continue
            if at and dots[j] == dots[i]:
                continue
            if not at and not (_DIGIT.match(w) or w in "+("):
                continue
            out.append((i, j, features(text, cuts[i], cuts[j], j - i, low, high)))
    return cuts, out


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


class Field:
    """Weights of (kind, feature) and of (kind before, kind) for spans that touch; other tokens weigh nothing."""

    def __init__(self) -> None:
        self.w: dict[tuple, float] = defaultdict(float)

    def score(self, kind: int, found: list[str]) -> float:
        w = self.w
        return sum(w.get((kind, f), 0.0) for f in found)

    def _edges(self, n: int, spans: list) -> list[list[tuple[int, int, float]]]:
        ends: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for s, (i, j, found) in enumerate(spans):
            for kind in range(len(KINDS)):
                ends[j].append((i, s * len(KINDS) + kind, self.score(kind, found)))
        return ends

    def best(self, n: int, spans: list) -> list[tuple[int, int, float]]:
        """(kind, span number, lead over no label) of the best segmentation.

        State: whether the token before ends a span; touching spans pay ``("touch",)``.
        """
        ends, touch = self._edges(n, spans), self.w.get(("touch",), 0.0)
        free, held = [0.0] + [-math.inf] * n, [-math.inf] * (n + 1)
        back_free, back_held = [False] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            back_free[j] = held[j - 1] > free[j - 1]
            free[j] = max(free[j - 1], held[j - 1])
            for i, edge, score in ends[j]:
                near = held[i] + touch > free[i]
                value = (held[i] + touch if near else free[i]) + score
                if value > held[j]:
                    held[j], back_held[j] = value, (i, edge, near, score)
        out, j, inside = [], n, held[n] > free[n]
        while j > 0:
            if inside:
                i, edge, inside, score = back_held[j]
                out.append((edge % len(KINDS), edge // len(KINDS), score))
                j = i
            else:
                inside, j = back_free[j], j - 1
        return out[::-1]

    def step(self, n: int, spans: list, gold: dict[tuple[int, int], int], rate: float) -> None:
        """One gradient step on the log likelihood of a window's true segmentation."""
        ends, touch = self._edges(n, spans), self.w[("touch",)]
        minus = -math.inf
        free, held = [0.0] + [minus] * n, [minus] * (n + 1)
        for j in range(1, n + 1):
            free[j] = _log_sum([free[j - 1], held[j - 1]])
            if ends[j]:
                held[j] = _log_sum([_log_sum([free[i], held[i] + touch]) + s for i, _, s in ends[j]])
        later_free, later_held = [minus] * n + [0.0], [minus] * n + [0.0]
        starts: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for j in range(n + 1):
            for i, _, s in ends[j]:
                starts[i].append((j, s))
        for i in range(n - 1, -1, -1):
            spans_on = _log_sum([later_held[j] + s for j, s in starts[i]]) if starts[i] else minus
            later_free[i] = _log_sum([later_free[i + 1], spans_on])
            later_held[i] = _log_sum([later_free[i + 1], spans_on + touch])
        total = later_free[0]
        for j in range(n + 1):
            for i, edge, s in ends[j]:
                kind, number = edge % len(KINDS), edge // len(KINDS)
                a, b, found = spans[number]
                p = math.exp(min(0.0, _log_sum([free[i], held[i] + touch]) + s + later_held[j] - total))
                slope = (gold.get((a, b)) == kind) - p
                if abs(slope) > 1e-4:
                    for f in found:
                        self.w[(kind, f)] += rate * (slope - DECAY * self.w[(kind, f)])


def _varied(window: str, spans: list[Span], rng: random.Random) -> tuple[str, list[Span]]:
    """A window with some true spans rewritten as people also write them.

    Phones without country code, cards with dots or slashes, IPs with blanks
    behind their dots, addresses with blanks around the sign.
    """
    out, at, kept = [], 0, []
    length = 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        text = window[a:b]
        if kind == 3 and rng.random() < 0.4 and (m := re.match(r"\+[0-9]{1,3}[ .-]*(?=[(0-9])", text)) and len(_digits(text[m.end() :])) >= LEAST_DIGITS:
            text = text[m.end() :]
        elif kind == 2 and rng.random() < 0.4:
            text = re.sub("[ -]", rng.choice("./"), text) if re.search("[ -]", text) else "/".join(text[k : k + 4] for k in range(0, len(text), 4))
        elif kind == 1 and rng.random() < 0.4:
            text = text.replace(".", ". ")
        elif kind == 0 and rng.random() < 0.3:
            text = text.replace("@", " @ ")
        out += [window[at:a], text]
        length += a - at
        kept.append((kind, length, length + len(text)))
        length += len(text)
        at = b
    return "".join([*out, window[at:]]), kept


def train(docs: DataFrame, seed: int = 5) -> Field:
    """Fit the field on windows of a bounded sample of the documents; without any window it adds nothing."""
    ship(docs.sparkSession)
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spots = [], []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                for a, b in windows(text):
                    if b - a <= SAMPLE_CHARS:
                        texts.append(text[a:b])
                        spots.append(",".join(f"{k}:{s - a}:{e - a}" for k, s, e in spans if a <= s and e <= b))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(spots, pa.string())], ["window", "spans"])

    found = docs.filter(F.col("text").isNotNull() & (drawn < share)).select(F.col("text").cast("string")).mapInArrow(collect, "window string, spans string").distinct()
    order = F.xxhash64("window")
    kept = [r for part in (found.filter("spans <> ''"), found.filter("spans = ''")) for r in part.orderBy(order, "window").limit(SAMPLE_WINDOWS // 2).collect()]
    rng, field, examples = random.Random(seed), Field(), []
    for row in kept:
        spans = [tuple(map(int, s.split(":"))) for s in row["spans"].split(",") if s]
        for text, own in [(row["window"], spans), *([_varied(row["window"], spans, rng)] if spans else [])]:
            cuts, candidates = lattice(text)
            gold = {(cuts.index(a), cuts.index(b)): k for k, a, b in own if a in cuts and b in cuts}
            if candidates:
                examples.append((len(cuts) - 1, candidates, gold))
    for epoch in range(EPOCHS):
        rng.shuffle(examples)
        for n, candidates, gold in examples:
            field.step(n, candidates, gold, RATE / (1 + epoch))
    field.w = {k: v for k, v in field.w.items() if abs(v) > 1e-3}
    return field


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Spans that the field finds clear of all base spans.

    A window of more than ``MOST_TOKENS`` tokens is segmented piece by piece.
    What a piece finds within its last ``LONGEST`` tokens is left to the next
    one, which begins as many tokens earlier or at the end of what was found.
    """
    out = []
    if not field.w:
        return out
    starts, ends = _merged(base)

    def covered(a: int, b: int) -> bool:
        k = bisect_left(starts, b) - 1
        return k >= 0 and ends[k] > a

    for begin, end in windows(text):
        at = begin
        while at < end:
            cuts, candidates = lattice(text, begin, end, at, MOST_TOKENS)
            last = len(cuts) - 1
            keep, at = (last, end) if cuts[-1] >= end else (last - LONGEST, cuts[last - 2 * LONGEST])
            candidates = [c for c in candidates if not covered(cuts[c[0]], cuts[c[1]])]
            for kind, number, lead in field.best(last, candidates) if candidates else ():
                i, j, _ = candidates[number]
                if j <= keep and lead >= AHEAD:
                    out.append((kind, cuts[i], cuts[j]))
                    at = max(at, cuts[j])
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with the personal data of every whole text, positions in code points.

    ``n_email, n_ip, n_card, n_phone`` count base spans; ``base_spans`` and
    ``spans`` (base and added) are ``kind:start:end`` by kind, then start,
    comma-joined.  Null and empty texts have none.  Columns of these names are
    replaced; others pass.  A map without shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    made = [f"n_{k}" for k in KINDS] + ["base_spans", "spans"]
    rest = docs.drop(*made)
    place = rest.columns.index("text")
    shared = spark.sparkContext.broadcast(dict(field.w))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Field()
        fitted.w = shared.value
        for batch in batches:
            counts, base_text, all_text = [], [], []
            for text in batch.column(place).to_pylist():
                base = base_spans(text or "")
                counts.append([sum(s[0] == k for s in base) for k in range(len(KINDS))])
                base_text.append(_joined(base))
                all_text.append(_joined(base + added_spans(text or "", base, fitted)))
            numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers, pa.array(base_text, pa.string()), pa.array(all_text, pa.string())], [*batch.schema.names, *made])

    schema = T.StructType([*rest.schema, *(T.StructField(x, T.LongType()) for x in made[:4]), *(T.StructField(x, T.StringType()) for x in made[4:])])
    return rest.mapInArrow(tidy(scan), schema)


def replaced(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans by their first kind."""
    out, end = [], 0
    for a, b, kind in sorted((a, b, KINDS[k]) for k, a, b in spans):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with every span of ``text``, base or added, replaced by its kind; a null text stays null.

    One pass over the texts, without the columns of ``find``.
    """
    ship(docs.sparkSession)
    place = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(dict(field.w))

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Field()
        fitted.w = shared.value
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for row, text in enumerate(texts):
                base = base_spans(text or "")
                if spans := base + added_spans(text or "", base, fitted):
                    texts[row] = replaced(text, spans)
            columns = list(batch.columns)
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(tidy(replace), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """``doc_id``, counts, SHA-256 of the joined base spans, and all spans."""
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def fingerprint(text: str) -> str:
    """SHA-256 of one text's joined base spans."""
    return hashlib.sha256(_joined(base_spans(text)).encode()).hexdigest()
