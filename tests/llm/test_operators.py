"""The operators against brute force on small tables, and their defined results for odd rows."""

import base64
import hashlib
import math
import os
import random
import re
import signal
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from lodestar.llm import components, imatch, langid, lengths, mixing, ngramjoin, pii, pstable, sentencepieces, slots, textkit, tokenfile, units, warc
from lodestar.llm import queries as q
from lodestar.llm.bytebpe import encoder
from lodestar.llm.pieces import piece_table
from lodestar.runtime import new_path

from .conftest import LONG, SMALL

BPE = Tokenizer.from_file(q.BYTE_BPE)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


# units
@pytest.mark.parametrize("name", ["pieces", "byte_bpe"])
def test_more_units_in_a_row_than_the_cache_holds(monkeypatch, name):
    usual = piece_table(q.PIECES)[1] if name == "pieces" else encoder(q.BYTE_BPE)
    column = pa.array(["a few words first", " ".join(f"id{i % 90} {i % 7}" for i in range(300)), None, "id3 and words", " ".join(map(str, range(90)))])
    want = [(a, b, ids.tolist(), at.tolist()) for a, b, ids, at in usual.batches(column)]
    monkeypatch.setattr(units, "MAX_CACHED_UNITS", 20)
    small = units.UnitEncoder(usual.encode, usual.white, usual.mark_first, usual.split)

    def late(*_):
        raise TimeoutError("the table of units is full")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(30)
    try:
        got = [(a, b, ids.tolist(), at.tolist()) for a, b, ids, at in small.batches(column)]
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    assert got == want and small.index.n <= 20


# 1: language identification
def test_language_accuracy(spark, texts):
    rows = q.op1_language_id(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    long_ones = [r for r in rows if r["held_out"] and len(texts[r["doc_id"]]["text"]) > 60]
    assert np.mean([r["lang_pred"] == texts[r["doc_id"]]["lang"] for r in long_ones]) > 0.9


def test_language_odd_rows(spark, odd, none):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        blank = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == blank and (not blank or r["score"] == 0)
    assert langid.identify(none).count() == 0
    unlabelled = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 9, 40])
def test_codewords_are_apart(k):
    code = langid.codewords(k)
    assert set(np.unique(code)) <= {-1.0, 1.0}
    apart = [(a != b).sum() for a, b in combinations(code, 2)]
    assert not apart or min(apart) >= max(1, code.shape[1] // 5)


def test_decoding_against_plain_arithmetic(spark, documents, texts):
    """Mean evidence of each classifier from n-gram slots one by one, then loss-weighted decoding, without arrays."""
    model = langid.train(documents, F.lit(True))
    got = {r["doc_id"]: r for r in langid.predict(documents, model).collect()}

    def slots_of(raw):
        fold = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in raw]
        for start in range(len(fold)):
            h, blank = 0, True
            for n, c in enumerate(fold[start : start + 4], 1):
                h = (h ^ c) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
                blank &= c == 32
                if n > 1 and not blank:
                    yield (h * 0x85EBCA6B & 0xFFFFFFFF) >> 17

    for d, r in list(texts.items())[:40]:
        found = list(slots_of((r["text"] or "")[:3000].encode()))
        if not found or len(r["text"]) > 3000 or got[d]["lang_pred"] == "und":
            continue
        margins = [sum(float(model.weights[s, b]) for s in found) / math.sqrt(len(found)) for b in range(model.code.shape[1])]
        losses = [sum(math.log1p(math.exp(-m * c)) * t for m, c, t in zip(margins, word, model.trust, strict=True)) for word in model.code]
        best = min(range(len(losses)), key=losses.__getitem__)
        assert got[d]["lang_pred"] == model.languages[best]
        assert got[d]["score"] == pytest.approx(1 / sum(math.exp(losses[best] - x) for x in losses), abs=1e-4)


def test_short_texts(spark, documents, texts):
    """Held-out texts of at most 60 characters count, too; those with a letter get a language."""
    rows = [r for r in langid.identify(documents).collect() if len(texts[r["doc_id"]]["text"] or "") <= 60]
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in rows)
    lettered = [r for r in rows if r["lang_pred"] != "und" and r["lang"] is not None]
    assert not lettered or np.mean([r["lang_pred"] == r["lang"] for r in lettered]) >= 0.7


def test_prediction_sees_only_text(spark, documents):
    model = langid.train(documents, F.lit(True))
    mixed = documents.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "doc_id": -F.col("doc_id")})
    key = lambda df: {r["text"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()}
    assert key(documents) == key(mixed)


# 2 and tokenizers
def unigram():
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(q.PIECES, "rb").read())
    proto.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_segmentation_is_the_best_by_score(texts):
    """The library's n-best search over the same pieces and scores gives the same best segmentation of words."""
    table, _ = piece_table(q.PIECES)
    library = unigram()
    words = sorted({w for r in texts.values() for w in r["text"].split(" ") if w and "\n" not in w and len(w) < 24})[:1500]
    score = lambda ids: sum(table.scores[np.flatnonzero(table.ids == i)[0]] for i in ids)
    for word, ids in zip(words, table.segment(["▁" + w for w in words]), strict=True):
        best = library.nbest_encode_as_ids(word, 1)[0]
        assert ids == best or score(ids) == pytest.approx(score(best))


def test_pieces_round_trip(spark, odd, none, documents):
    model = sentencepiece.SentencePieceProcessor(model_file=q.PIECES)
    rows = sentencepieces.encode_pieces(documents, q.PIECES).collect()
    assert all(r["round_trip"] and r["n_pieces"] == len(r["piece_ids"]) for r in rows)
    assert all(model.decode(r["piece_ids"]) == r["text"] for r in rows[:50])
    coded = sentencepieces.encode_pieces(odd, q.PIECES)
    back = sentencepieces.decode_pieces(coded, q.PIECES).collect()
    for r in back:
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")
        assert r["round_trip"] == ("▁" not in (r["text"] or ""))
    assert sentencepieces.encode_pieces(none, q.PIECES).count() == 0


TRICKY = st.lists(st.sampled_from([*"ab.'! \n\t\r 　 é世|<>0", "<|endoftext|>", "don't", "  "]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TRICKY, min_size=1, max_size=5))
def test_byte_bpe_equals_the_library(found):
    for a, b, ids, at in encoder(q.BYTE_BPE).batches(pa.array(found)):
        for i in range(b - a):
            assert ids[at[i] : at[i + 1]].tolist() == BPE.encode(found[a + i], add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(TRICKY, min_size=1, max_size=5))
def test_pieces_decode_to_the_text(found):
    table, coder = piece_table(q.PIECES)
    for a, b, ids, at in coder.batches(pa.array(found)):
        raw, offsets = table.decode(ids, at)
        assert [raw[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(b - a)] == found[a:b]


# 3: WARC
def test_warc(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = q.op3_warc(spark, SMALL).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        raw = (pages[r["page_id"]] or "").encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    first = {}
    for page in sorted(pages):
        first.setdefault(pages[page] or "", page)
    assert all(r["refers_to"] == (None if first[pages[r["page_id"]] or ""] == r["page_id"] else first[pages[r["page_id"]] or ""]) for r in rows)
    assert all((r["record_type"] == "response") == (r["refers_to"] is None) for r in rows)
    order = [(r["url_key"], r["captured_at"]) for r in warc.capture_history(spark.read.parquet(f"{SMALL}/pages.parquet")).collect()]
    assert order == sorted(order) and len(order) == len(pages)


def test_warc_many_revisits_without_broadcast(spark, monkeypatch):
    """Joined by salted keys: the same records, and pages of one id or none in more than one task."""
    rows = [(i % 50 if i % 2 else (None if i % 4 else 7), f"http://h{i % 9}.com/{i}", f"page {i % 60}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    key = lambda: Counter((r["page_id"], r["record_type"], r["refers_to"], r["url_key"]) for r in warc.capture_history(pages).collect())
    want = key()
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", 0)
    assert key() == want and sum(n for (_, kind, _, _), n in want.items() if kind == "revisit") > 100


@pytest.mark.parametrize("name", ["op3_warc", "op10_ngram_join"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    rel = con.sql(q.ORACLES[name])
    key = lambda rows: sorted(rows, key=repr)
    assert key(map(tuple, q.QUERIES[name](spark, SMALL).select(rel.columns).collect())) == key(rel.fetchall())


def test_warc_revisits_and_odd_rows(spark):
    rows = [(5, "http://b.com/x y", "same"), (2, "http://a.com/", "same"), (9, None, "same"), (3, "u\r\nEvil: 1", None), (1, "http://a.com/", ""), (None, "http://a.com/", "same"), (None, "z", "alone"), (4, "http://é.com/ü", "é" * 70000), (2, "http://a.com/", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("at", F.lit(1))
    got = warc.capture_history(pages).collect()
    found = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert found == Counter([(5, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (9, "revisit", 2, 4), (3, "revisit", 1, 0), (1, "response", None, 0), (None, "response", None, 4), (None, "response", None, 5), (4, "response", None, 140000)])
    assert warc.capture_history(pages.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=6), max_size=9))
def test_loser_tree(runs):
    runs = [sorted((x, i) for x in run) for i, run in enumerate(runs)]
    assert list(warc.loser_tree_merge(runs, key=lambda r: r)) == sorted(x for run in runs for x in run)


# 4: mixing
def test_mixing_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    rel = con.sql(q.ORACLES["op4_mix_sources"])
    df = q.op4_mix_sources(spark, SMALL)
    assert sorted(map(tuple, df.select(rel.columns).collect())) == sorted(rel.fetchall())
    keys = [r["shuffle_key"] for r in df.collect()]
    assert keys == sorted(keys)


def test_mixing_meets_its_targets(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 15000, "a").otherwise("b").alias("source"))
    rates = mixing.repetition_rates(docs, weights={"a": 1.0, "b": 3.0})
    assert {r["source"]: round(r["rate"], 6) for r in rates.collect()} == {"a": round(0.25 * 20000 / 15000, 6), "b": 3.0}
    mixed = mixing.mix(docs, rates, seed=3).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in mixed}
    assert abs(n["a"] - 5000) < 300 and abs(n["b"] - 15000) < 500
    per_doc = mixing.mix(docs.filter("source = 'b'"), rates, seed=3).groupBy("doc_id").count().collect()
    counts = Counter(r["count"] for r in per_doc)
    assert abs(counts[3] / 5000 - 0.224) < 0.03  # P(N = 3) at mean 3


def test_mixing_large_means_and_odd_rows(spark, odd, none):
    one = spark.createDataFrame([(i, "t", "s") for i in range(50)], "doc_id long, text string, source string")
    rates = spark.createDataFrame([("s", 900.0)], "source string, rate double")
    n = mixing.mix(one, rates).count()
    assert abs(n / 50 - 900) < 30
    rates = mixing.repetition_rates(odd, temperature=0.0, total=400)
    assert {r["source"] for r in rates.collect()} == {"a", "b", None}
    got = mixing.mix(odd, rates)
    assert got.filter("text is null").count() > 0 and set(odd.columns) <= set(got.columns)
    assert mixing.mix(none, mixing.repetition_rates(none)).count() == 0
    zero = mixing.repetition_rates(odd, weights={"a": 1.0})
    assert {r["source"] for r in mixing.mix(odd, zero).collect()} <= {"a"}


def test_mixing_many_sources_without_broadcast(spark, documents, monkeypatch):
    rates = mixing.repetition_rates(documents)
    want = sorted((r["doc_id"], r["copy"]) for r in mixing.mix(documents, rates).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted((r["doc_id"], r["copy"]) for r in mixing.mix(documents, rates).collect()) == want


# 5: nearest neighbours
def brute(vectors, queries, k=10):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for i in queries:
        d = np.sqrt(((x - np.array(vectors[i], float)) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_nearest_recall_and_distances(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    truth = brute(rows, [i for i in rows if i % 100 == 0])
    got = defaultdict(list)
    for r in q.op5_nearest(spark, SMALL).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(truth) and all(len(x) == 10 for x in got.values())
    hits = sum(len({i for i, _ in got[k]} & {i for i, _ in truth[k]}) for k in truth)
    assert hits / (10 * len(truth)) >= 0.9
    for k, found in got.items():
        assert found == sorted(found, key=lambda x: (x[1], x[0]))
        for i, d in found:
            assert d == pytest.approx(float(np.sqrt(((np.array(rows[i], float) - np.array(rows[k], float)) ** 2).sum())), abs=1e-12)


def test_nearest_odd_rows(spark):
    good = [(i, [float(i % 7 + 1), float(i // 7)], 1) for i in range(40)]
    same = [(100 + i, [5.0, 5.0], 1) for i in range(300)]
    bad = [(1000, None, 1), (1001, [0.0, 0.0], 1), (1002, [1.0, None], 1), (1003, [1.0, float("nan")], 1), (1004, [float("inf"), 1.0], 1), (1005, [1.0, 2.0, 3.0], 1), (1006, [], 1), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(good + same + bad, "vec_id long, embedding array<double>, part int")
    got = defaultdict(list)
    for r in pstable.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == {0, 100, 200, 300}
    assert got[100] == [39, *range(101, 110)] and got[200] == [39, *range(100, 109)]  # row 39 is the same vector
    few = pstable.search(df.filter("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert [r["vec_id"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3]
    assert pstable.search(df.filter("vec_id >= 1000"), F.lit(True)).count() == 0
    assert pstable.search(df.filter("vec_id = 7"), F.lit(True)).count() == 0


def test_lone_queries_are_answered_exactly(spark):
    rows = [(i, [float(i % 50), 1.0]) for i in range(1, 500)] + [(0, [1e6, 1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = pstable.search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [i for i, _ in brute(dict(rows), [0])[0]]


# 6: I-Match
def edited(texts):
    order = sorted(texts, reverse=True)
    out = {}
    for i, d in enumerate(order):
        own, follow = texts[d]["text"] or "", texts[order[(i + 1) % len(order)]]["text"] or ""
        third = len(own) // 3
        out[d] = own[: len(own) - third] + follow[:third]
    return out


def test_imatch(spark, documents, texts):
    rows = {r["doc_id"]: r for r in q.op6_imatch(spark, SMALL).collect()}
    want = edited(texts)
    assert set(rows) == set(texts)
    for d, r in rows.items():
        assert r["n_chars"] == len(texts[d]["text"]) and r["edited_sha256"] == hashlib.sha256(want[d].encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    order = sorted(texts, reverse=True)
    terms = imatch.lexicon(documents)
    alone = imatch.fingerprints(pa.array([texts[d]["text"] for d in order]), terms)
    after = imatch.fingerprints(pa.array([want[d] for d in order]), terms)
    for i, d in enumerate(order):
        assert rows[d]["fingerprint"] == alone[i] and rows[d]["edited_fingerprint"] == after[i]
        assert rows[d]["near_next"] == imatch.likeness(alone[i], alone[(i + 1) % len(order)])
    assert np.mean([r["near_edited"] for r in rows.values()]) > 2 * np.mean([r["near_next"] for r in rows.values()])


def test_document_frequencies(spark, documents, texts):
    df = Counter(w for r in texts.values() for w in set(re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(r["text"]))))
    found = Counter(r["df"] for r in imatch.document_frequencies(documents).collect())
    assert found == Counter(df.values())


def test_imatch_ranges_in_two_steps(spark, documents, monkeypatch):
    terms = imatch.lexicon(documents)
    want = sorted(map(tuple, imatch.edited_fingerprints(documents, terms).collect()))
    monkeypatch.setattr(imatch, "COARSE", 3)
    rows = documents.select("doc_id", F.xxhash64("text").alias("hash"))
    ranges = imatch.id_ranges(rows, 12)
    assert len(ranges) > 8 and set(ranges.ids.tolist()) <= {r[0] for r in rows.collect()}
    assert sorted(map(tuple, imatch.edited_fingerprints(documents, terms).collect())) == want


@pytest.mark.parametrize("coarse", [2048, 4])
def test_imatch_splits_hot_ids(spark, monkeypatch, coarse):
    """An id, and rows without one, with half of all texts: several ranges, none without rows, and the same order."""
    monkeypatch.setattr(imatch, "COARSE", coarse)
    rng = random.Random(3)
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(9)) + f" {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    keyed = docs.select(F.coalesce("doc_id", F.lit(imatch._NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    ranges = imatch.id_ranges(keyed.select("doc_id", "hash"), 12)
    found = [tuple(r) for r in keyed.collect()]
    part = ranges.of(np.array([r[0] for r in found]), np.array([r[1] for r in found]))
    held = Counter(part.tolist())
    assert set(held) == set(range(len(ranges))) and max(held.values()) <= 150
    order = sorted(found, reverse=True)
    assert [int(p) for _, p in sorted(zip(found, part, strict=True), reverse=True)] == sorted(part.tolist(), reverse=True)
    want = Counter()
    for i, (_, _, own) in enumerate(order):
        third = len(own) // 3
        want[hashlib.sha256((own[: len(own) - third] + order[(i + 1) % len(order)][2][:third]).encode()).hexdigest()] += 1
    monkeypatch.setattr(imatch, "task_count", lambda df: 6)
    assert Counter(r["edited_sha256"] for r in imatch.edited_fingerprints(docs, np.zeros(0, np.uint64)).collect()) == want


def test_fingerprints_against_plain_sets(documents, texts):
    """Which texts share a subset's hash, by sets of words: the lexicon, the draws and the sums come out as sets would."""
    n = len(texts)
    words = {d: set(re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(r["text"] or ""))) for d, r in texts.items()}
    df = Counter(w for own in words.values() for w in own)
    known = sorted(w for w in df if imatch.LOW_SHARE * n <= df[w] <= imatch.HIGH_SHARE * n)
    terms = imatch.lexicon(documents)
    assert len(terms) == len(known)
    single = dict(zip(known, imatch.fingerprints(pa.array(known), terms), strict=True))
    whole = dict(zip(texts, imatch.fingerprints(pa.array([r["text"] for r in texts.values()]), terms), strict=True))
    cut = lambda x, k: x[8 * k : 8 * k + 8]
    for k, share in enumerate(imatch.SUBSETS):
        chosen = {w for w in known if cut(single[w], k) != imatch.EMPTY}
        assert abs(len(chosen) / len(known) - share) < 4 * math.sqrt(share / len(known))
        by_set, by_hash = defaultdict(set), defaultdict(set)
        for d, own in words.items():
            if own & set(known):
                by_set[frozenset(own & chosen)].add(d)
                by_hash[cut(whole[d], k)].add(d)
        assert sorted(map(sorted, by_set.values())) == sorted(map(sorted, by_hash.values()))
    bare = defaultdict(set)
    for d, own in words.items():
        if not own & set(known):
            bare[frozenset(own)].add(whole[d])
    assert all(len(x) == 1 and next(iter(x))[0] == "=" for x in bare.values()) and len(set.union(set(), *bare.values())) == len(bare)


def test_imatch_odd_rows(spark, odd, none):
    rows = imatch.edited_fingerprints(odd, imatch.lexicon(odd)).collect()
    assert len(rows) == odd.count() and sum(r["doc_id"] is None for r in rows) == 2
    by_text = defaultdict(set)
    assert {r["fingerprint"] for r in rows if r["n_chars"] == 0} == {"=da39a3ee5e6b4b0d"}
    for r in rows:
        by_text[r["doc_id"]].add(r["fingerprint"])
    assert len(by_text[3]) == 1
    assert imatch.edited_fingerprints(none, imatch.lexicon(none)).count() == 0
    single = odd.filter("doc_id = 7")
    assert imatch.edited_fingerprints(single, imatch.lexicon(single)).first()["near_next"] == 1.0


# 7: token files
def test_token_files(spark, texts):
    rows = q.op7_token_ids(spark, SMALL).collect()
    start = 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = [*BPE.encode(texts[r["doc_id"]]["text"], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_are_as_described(spark, documents):
    """Several stripes, run-length encoding, row indexes and Bloom filters, and a filter that skips by them."""
    path = new_path(spark, "tokens")
    many = documents.select((F.col("doc_id") * 3).alias("doc_id"), "text").repartition(1)
    tokenfile.write_tokens(many, path, q.BYTE_BPE, stripe_bytes=1 << 16)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = [x.getPath() for x in root.getFileSystem(conf).listStatus(root) if x.getPath().getName().endswith(".orc")]
    last = None
    for file in sorted(files, key=lambda x: int(re.match(r"part-(\d+)", x.getName())[1])):
        reader = jvm.org.apache.orc.OrcFile.createReader(file, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000 and reader.getCompressionKind().toString() == "NONE"
        names = list(reader.getSchema().getFieldNames())
        for stripe in reader.getStripes():
            footer = reader.rows().readStripeFooter(stripe)
            kinds = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
            own = 1 + names.index("doc_id")
            assert (own, "ROW_INDEX") in kinds and (own, "BLOOM_FILTER_UTF8") in kinds
            assert footer.getColumns(own).getKind().toString() == "DIRECT_V2"
        numbers = reader.getStatistics()[1 + names.index("doc_id")]
        assert last is None or numbers.getMinimum() > last
        last = numbers.getMaximum()
    rows = {r["doc_id"]: r for r in tokenfile.read_tokens(spark, path).collect()}
    some = sorted(rows)[17]
    one = tokenfile.read_tokens(spark, path).filter(F.col("doc_id") == some)
    assert one.collect() == [rows[some]] and "EqualTo(doc_id" in one._jdf.queryExecution().executedPlan().toString()
    assert tokenfile.read_tokens(spark, path).filter(F.col("doc_id") == some + 1).count() == 0


@pytest.mark.parametrize("write", ["tokens", "mix"])
def test_hot_ids_are_spread(spark, write):
    """Half of all rows under one id, a quarter without one: no task gets more than a fair share by much."""
    docs = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 5).when(F.col("id") % 4 == 1, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    if write == "mix":
        rates = spark.createDataFrame([("s", 1.0)], "source string, rate double")
        sizes = mixing.mix(docs, rates).groupBy(F.spark_partition_id()).count().collect()
    else:
        path = new_path(spark, "tokens")
        tokenfile.write_tokens(docs, path, q.BYTE_BPE)
        rows = tokenfile.read_tokens(spark, path)
        starts = sorted((r["start"], r["n_tokens"]) for r in rows.collect())
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and len(starts) == 4000
        sizes = spark.read.orc(path).groupBy(F.input_file_name()).count().collect()
    held = [r["count"] for r in sizes]
    assert len(held) == 4 and max(held) < 0.4 * sum(held)


def test_token_files_odd_rows(spark, odd, none):
    path = new_path(spark, "tokens")
    tokenfile.write_tokens(odd, path, q.BYTE_BPE)
    rows = tokenfile.read_tokens(spark, path).collect()
    assert len(rows) == odd.count() and sum(r["doc_id"] is None for r in rows) == 2
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert all(r["token_ids"][-1] == 2 and len(r["token_ids"]) == r["n_tokens"] for r in rows)
    assert [r["token_ids"] for r in rows if r["doc_id"] == 1] == [[2]]
    path = new_path(spark, "tokens")
    tokenfile.write_tokens(none, path, q.BYTE_BPE)
    assert tokenfile.token_digest(tokenfile.read_tokens(spark, path)).count() == 0


# 8: personal data
BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_base(text):
    def fine(kind, found):
        digits = re.sub("[^0-9]", "", found)
        return kind == 0 or kind == 1 and all(int(p) <= 255 for p in found.split(".")) or kind == 2 and 13 <= len(digits) <= 19 and pii.luhn(digits) or kind == 3 and 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k in range(4) for m in re.finditer(BASE[k], text) if fine(k, m[0])]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a1..@@-+ 25()é%", max_size=40) | st.text(alphabet="0123456789 -+.", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_base(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_personal_data(spark, texts):
    added = 0
    for r in q.op8_personal_data(spark, SMALL).collect():
        base = plain_base(texts[r["doc_id"]]["text"])
        assert r["base_sha256"] == hashlib.sha256(pii._joined(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in range(4)]
        spans = [s for s in r["spans"].split(",") if s]
        assert {f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base} <= set(spans) and len(set(spans)) == len(spans)
        added += len(spans) - len(base)
    assert added < 20


def test_field_finds_what_the_patterns_drop(spark):
    """Two card numbers in one run fail as one match; the field finds both."""
    rng = random.Random(1)

    def card():
        head = "".join(rng.choice("0123456789") for _ in range(15))
        return head + next(c for c in "0123456789" if pii.luhn(head + c))

    rows = [(i, f"pay {card()} now, mail x{i}@mail.example.com or call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} at 10.0.0.{i % 250} version {i}.2") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = pii.train(docs)
    a, b = card(), card()
    text = f"please pay {a} {b} today"
    found = pii.added_spans(text, pii.base_spans(text), field)
    assert [(k, text[s:e]) for k, s, e in found] == [(2, a), (2, b)]
    assert pii.added_spans("chapter 12 of 2024, version 4.0", [], field) == []


@pytest.fixture(scope="module")
def trained(spark):
    """A field that has seen all four kinds among plain numbers."""
    rng = random.Random(8)

    def number(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def line(i):
        kinds = [f"mail x{i}@mail.example.com", f"host 10.{i % 250}.0.{i % 199}", f"pay {with_check(number(15))}", f"pay {blocks(with_check(number(15)))}", f"call +1 407 555 {number(4)}", f"order {number(9)}", f"date {number(4)}-{number(2)}-{number(2)} {number(2)}:{number(2)}", f"room {number(3)}, version {number(1)}.{number(2)}"]
        return (i, " and ".join(rng.sample(kinds, 3)))

    return pii.train(spark.createDataFrame([line(i) for i in range(2000)], "doc_id long, text string"))


def with_check(head):
    return head + next(c for c in "0123456789" if pii.luhn(head + c))


def blocks(digits, by=" "):
    return by.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def test_added_spans_by_kind(trained):
    """Variants that the patterns miss: most are found whole, as their kind; plain numbers stay."""
    rng = random.Random(9)
    found = Counter()
    for i in range(100):
        card = blocks(with_check("".join(rng.choice("0123456789") for _ in range(15))), "./"[i % 2])
        planted = {0: f"x{i}@mail.example.com".replace("@", " @ "), 1: f"10. {i}. 0. {i % 9}", 2: card, 3: f"407 555 {rng.randrange(1000, 9999)}"}
        for kind, own in planted.items():
            text = f"see {own} and more"
            assert not any(s[0] == kind for s in pii.base_spans(text))
            found[kind] += (kind, 4, 4 + len(own)) in pii.added_spans(text, pii.base_spans(text), trained)
    assert all(found[k] >= 60 for k in range(4)), found
    clean = [f"order {rng.randrange(10**8, 10**9)} of 2024-03-{i % 28 + 1:02d} 12:30, room {i}, version {i}.2.{i % 7}" for i in range(100)]
    assert sum(len(pii.added_spans(t, [], trained)) for t in clean) <= 5


def test_long_stretches_pass_in_pieces(trained, monkeypatch):
    """Pieces find what one window finds; memory doesn't follow the length of a text."""
    rng = random.Random(10)
    text = " ".join(rng.choice([f"x{i} @ mail.example.com", f"10. {i}.0. 7", f"{i}-{i % 7}", f"+1 407 555 {1000 + i}", str(i * i)]) for i in range(900))
    monkeypatch.setattr(pii, "MOST_TOKENS", 10**9)
    whole = pii.added_spans(text, pii.base_spans(text), trained)
    monkeypatch.setattr(pii, "MOST_TOKENS", 64)
    assert len(whole) > 20 and set(pii.added_spans(text, pii.base_spans(text), trained)) == set(whole)
    monkeypatch.setattr(pii, "MOST_TOKENS", 512)
    for unit in ("123456 ", "1-2-3-", "1.2.3.4."):
        text = unit * (30_000 // len(unit))
        tracemalloc.start()
        pii.added_spans(text, pii.base_spans(text) if unit != "1.2.3.4." else [], trained)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 << 20, (unit, peak)
    assert pii.base_spans("12 34 " * 500_000) == pii.base_spans("1.2-3." * 500_000) == []


def test_best_segmentation_is_the_best(spark):
    """The dynamic program against all segmentations."""
    rng = random.Random(2)
    for _ in range(30):
        n = 6
        spans = [(i, j, [f"f{i}{j}"]) for i in range(n) for j in range(i + 1, min(i + 3, n) + 1)]
        field = pii.Field()
        field.w.update({(k, f): rng.uniform(-2, 2) for k in range(4) for _, _, (f,) in spans})
        field.w[("touch",)] = rng.uniform(-1, 1)

        def every(at, touching, spans=spans, field=field, n=n):
            if at == n:
                yield 0.0
                return
            for rest in every(at + 1, False):
                yield rest
            for i, j, f in spans:
                if i == at:
                    for k in range(4):
                        for rest in every(j, True):
                            yield rest + field.score(k, f) + (field.w[("touch",)] if touching else 0)

        got = field.best(n, spans)
        value, end = 0.0, None
        for kind, number, _ in got:
            i, j, f = spans[number]
            value += field.score(kind, f) + (field.w[("touch",)] if end == i else 0)
            end = j
        assert value == pytest.approx(max(every(0, False)))


def test_personal_data_odd_rows(spark, odd, none):
    field = pii.train(odd)
    rows = pii.find(odd, field).collect()
    assert len(rows) == odd.count() and all(r["base_spans"] == "" for r in rows)
    assert pii.find(none, pii.train(none)).count() == 0
    docs = spark.createDataFrame([(1, "a@b.com 10.1.2.3"), (2, None), (3, "é +1 (407) 555-7710!")], "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, pii.Field()).collect()}
    assert clean == {1: "<EMAIL> <IP>", 2: None, 3: "é <PHONE>!"}


# 9: lengths
def test_length_histogram(spark, texts):
    own = sorted(len(BPE.encode(r["text"], add_special_tokens=False).ids) for r in texts.values())
    sums = q.op9_token_counts(spark, SMALL)
    for r in sums.collect():
        x = r["length"]
        assert (r["docs"], r["docs_over"], r["tokens_over"]) == (own.count(x), sum(n > x for n in own), sum(n for n in own if n > x))
        assert r["tokens_truncated"] == sum(min(n, x) for n in own) and r["tokens_total"] == sum(own)
    assert lengths.truncated_total(sums, 100).first()[0] == sum(min(n, 100) for n in own)
    got = {r["share"]: r["length"] for r in lengths.quantiles(sums, [0.5, 1.0]).collect()}
    assert got == {0.5: own[-(-len(own) // 2) - 1], 1.0: own[-1]}


def test_lengths_odd_rows(odd, none):
    sums = lengths.suffix_sums(lengths.histogram(lengths.encoded_lengths(odd, q.BYTE_BPE)))
    assert {r["length"]: r["docs"] for r in sums.collect()}[0] == 3
    assert lengths.suffix_sums(lengths.histogram(lengths.encoded_lengths(none, q.BYTE_BPE))).count() == 0


# 10: n-gram join
def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_components(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    up = {d: d for d in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in texts}


def components_of(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def family(seed, n, words=60, noise=0.02):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    return [" ".join(w if rng.random() > noise else f"x{rng.randrange(10**6)}" for w in base) for _ in range(n)]


def test_join_on_documents(spark, texts):
    assert components_of(q.op10_ngram_join(spark, SMALL)) == plain_components({d: r["text"] for d, r in texts.items()})


@pytest.mark.parametrize("tile, block", [(128, 1 << 21), (4, 1 << 21), (4, 1000)])
def test_join_on_near_copies(spark, monkeypatch, tile, block):
    """Families around the threshold, a passage that all share, copies; small and large tiles, whole and cut."""
    passage = " ".join(f"p{i}" for i in range(30))
    made = [t for f in range(6) for t in family(f, 25, words=40 + 10 * f, noise=0.01 + 0.01 * f)]
    made = [f"{t} {passage}" if i % 2 else t for i, t in enumerate(made)]
    made += made[:10] + [passage] * 20
    texts = {3 * i + 1: t for i, t in enumerate(made)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(ngramjoin, "SMALL_TILE", tile)
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "LEAST_CROWD", 10**6)
    assert components_of(ngramjoin.jaccard_components(docs)) == plain_components(texts)


def test_join_with_crowded_shingles(spark, monkeypatch):
    texts = dict(enumerate(t for f in range(4) for t in family(f, 30, noise=0.03)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(ngramjoin, "LEAST_CROWD", 3)
    assert components_of(ngramjoin.jaccard_components(docs)) == plain_components(texts)


def test_join_odd_rows(odd, none):
    rows = ngramjoin.jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == got[4] == (3, 3) and got[7] == (1, 7)
    assert got[5][0] == len(shingles(LONG))
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None]
    assert ngramjoin.jaccard_components(none).count() == 0


def test_join_rows_of_one_id(spark):
    """Rows of one id are one document: its texts' classes are one component."""
    a, b, c = ("one two three four five six seven", "red green blue white black grey", "north south east west up down")
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (9, c), (4, c), (6, ""), (6, c)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(docs).collect())
    assert got == Counter([(3, 3, 3), (5, 3, 3), (5, 2, 3), (7, 2, 3), (9, 2, 4), (4, 2, 4), (6, 0, 6), (6, 2, 4)])


def test_join_by_ids_beyond_the_filter(spark, monkeypatch):
    texts = dict(enumerate(t for f in range(4) for t in family(f, 12, noise=0.02)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(ngramjoin, "FILTER_BITS", 1)
    assert components_of(ngramjoin.jaccard_components(docs)) == plain_components(texts)


def test_pairs_within_bounds_lose_no_link():
    """Every pair of different labels that links is among the bounded ones, in one block and between two."""
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(1, 2**63, n, dtype=np.uint64)) for n in (30, 60, 61, 200)]
    sets = [np.unique(np.concatenate([x[rng.random(len(x)) > loss], rng.integers(1, 2**63, int(len(x) * loss), dtype=np.uint64)])) for x in base for loss in (0.02, 0.05, 0.1, 0.15) * 8]
    n, label = np.array([len(x) for x in sets]), rng.integers(0, 4, len(sets))
    bits = [ngramjoin.bitmap(x) for x in sets]
    links = {(i, j) for i, j in combinations(range(len(sets)), 2) if label[i] != label[j] and ngramjoin.shared_members(sets[i], sets[j]) >= ngramjoin.least_overlap(n[i], n[j], 80)}
    for sides in (np.full(len(sets), 2), rng.integers(0, 2, len(sets))):
        found = set()
        for first, second in ngramjoin._sides(sides, label):
            for x, y in ngramjoin.bounded_pairs(bits, n, label, first, second, 80):
                found |= {(min(p), max(p)) for p in zip(x.tolist(), y.tolist(), strict=True)}
        want = links if (sides == 2).all() else {(i, j) for i, j in links if sides[i] != sides[j]}
        assert len(want) > 50 and want <= found and len(found) < len(sets) ** 2 / 3


def test_tiles_write_less_than_pairs(spark, monkeypatch):
    """Two families of one tile that no link joins yet: written are rows by class, and links that make a forest."""
    monkeypatch.setattr(ngramjoin, "BLOCK", 1500)
    rng = np.random.default_rng(9)
    heart = np.arange(1, 10, dtype=np.uint64) << np.uint64(50)
    sets = [np.unique(np.concatenate([heart, rng.integers(1, 2**63, 1, dtype=np.uint64)])) for _ in range(120)]
    own = [(b"%016d" % i, i, 10, i // 60, ngramjoin.bitmap(x).tobytes(), x.tobytes()) for i, x in enumerate(sets)]
    features = spark.createDataFrame([(k, n, b) for k, _, n, _, b, _ in own], "cls binary, n long, bits binary")
    members = spark.createDataFrame([(k, n, m) for k, _, n, _, _, m in own], "cls binary, n long, members binary")
    large = spark.createDataFrame([(t, k, n, i) for k, i, n, _, _, _ in own for t in (1, 2, 3)], "token long, cls binary, n long, rep long")
    labels = spark.createDataFrame([(i, 60 * f) for _, i, _, f, _, _ in own if i % 60], "vertex long, component long")
    tiles = ngramjoin._mixed_tiles(large, labels, 80)
    held = tiles.count()
    assert held == 120  # three tokens of the same classes are one tile
    assert 0 < ngramjoin._pairs_across(tiles, features, 80).count() <= 60  # of 3,600 pairs
    assert ngramjoin._links_within(tiles, features, members, 80).count() == 1


def test_exactly_at_the_threshold(spark):
    """4 of 5 shingles shared links; 7 of 9 doesn't."""
    w = [f"w{i}" for i in range(20)]
    texts = {1: " ".join(w[:8]), 2: " ".join(w[:9]), 11: " ".join(w[10:20]) + " a", 12: " ".join(w[10:20]) + " b c"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = components_of(ngramjoin.jaccard_components(docs))
    assert got == plain_components(texts) and got[2] == (5, 1)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(1, 400), st.data())
def test_bounds_hold(n, m, data):
    shared = data.draw(st.integers(0, min(n, m)))
    rng = np.random.default_rng(n * 1000 + m)
    pool = rng.integers(1, 2**63, n + m - shared, dtype=np.uint64)
    a, b = np.unique(pool[:n]), np.unique(pool[n - shared :])
    true = len(np.intersect1d(a, b))
    assert ngramjoin.shared_members(a, b) == true
    assert ngramjoin.overlap_bound(ngramjoin.bitmap(a), ngramjoin.bitmap(b), len(a), len(b)) >= true


def test_set_hashes_follow_words():
    texts = ["a b c d e f", "A B\tc\nd e  f", "a b c d e", "", None, "x", "a b c d e f a b c d e f"]
    data, offsets = textkit.string_buffers(pa.array(texts))
    values, at = textkit.sorted_sets(*textkit.shingle_hashes(data, offsets))
    sets = [set(values[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]
    assert sets[0] == sets[1] and [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert sets[2] < sets[0] < sets[6]


@pytest.mark.parametrize("alone", [1 << 18, 0])
def test_components(spark, monkeypatch, alone):
    monkeypatch.setattr(components, "TASK_EDGES", alone)
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1080)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["vertex"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_slots(spark):
    counts = np.zeros(slots.RANGE * 4, np.int64)
    counts[[0, 5, slots.RANGE, 4 * slots.RANGE - 1]] = [1, 70000, 3, 2]
    where, packed = slots.partial_rows(counts)
    rows = list(zip(where.to_pylist(), packed.to_pylist(), strict=True))
    parts = spark.createDataFrame(rows + rows, "range int, packed binary")
    assert np.flatnonzero(slots.flags_over(parts, len(counts), 4)).tolist() == [5, slots.RANGE, 4 * slots.RANGE - 1]


def test_all_ten_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", x)[1]) for x in q.QUERIES) == list(range(1, 11))
    assert os.path.exists(q.BYTE_BPE) and public_tokenizers.path("byte_bpe_50k.json") == q.BYTE_BPE
