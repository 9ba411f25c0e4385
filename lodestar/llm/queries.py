"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import imatch, langid, lengths, mixing, ngramjoin, pii, pstable, sentencepieces, tokenfile, warc
from lodestar.runtime import new_path, table

#: Vocabulary files are read where they are installed; every operator takes the path as a parameter.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepieces.encode_pieces(docs, PIECES).select("doc_id", "n_pieces", "piece_ids", "round_trip")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives, reads them back, and merges the captures by URL key and time.

    The URL key, and where the record lies, stay out: names of archives are new in every run.
    """
    return warc.capture_history(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured_at")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many documents as there are, sources weighted by the root of their size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, mixing.repetition_rates(docs), seed=42)
    return mixed.select("doc_id", "source", "text", F.round("rate", 9).alias("rate"), "copy", "shuffle_key")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for each vector whose id is divisible by 100."""
    return pstable.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    docs = table(spark, sf_dir, "documents")
    return imatch.edited_fingerprints(docs, imatch.lexicon(docs))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token files, reads them back and digests what was read."""
    path = new_path(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, BYTE_BPE)
    return tokenfile.token_digest(tokenfile.read_tokens(spark, path))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of every whole text, and those that the field adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs, pii.train(docs)))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suffix sums of the exact histogram of encoded lengths."""
    found = lengths.encoded_lengths(table(spark, sf_dir, "documents"), BYTE_BPE)
    return lengths.suffix_sums(lengths.histogram(found))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of 5-word shingles, and its component of links of 0.8 and more."""
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_sentencepiece, op3_warc, op4_mix_sources, op5_nearest, op6_imatch, op7_token_ids, op8_personal_data, op9_token_counts, op10_ngram_join)}

_DIGIT = "('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4)) & 31"

ORACLES: dict[str, str] = {
    "op3_warc": f"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
        d AS (SELECT *, sha1(payload) AS h FROM p)
        SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({_DIGIT})::BIGINT + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to, 1704067200 + page_id % 31536000 AS captured_at
        FROM d
    """,
    "op10_ngram_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ),
        tokens AS (SELECT doc_id, len(w) AS held, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM words),
        runs AS (
            SELECT doc_id, held, p, t || ' ' || lead(t, 1) OVER o || ' ' || lead(t, 2) OVER o || ' ' || lead(t, 3) OVER o || ' ' || lead(t, 4) OVER o AS x
            FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY p)
        ),
        members AS (
            SELECT DISTINCT doc_id, x FROM runs WHERE p <= held - 4
            UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4
        ),
        sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY x)) AS k FROM members GROUP BY doc_id),
        classes AS (SELECT min(doc_id) AS id, any_value(n) AS n, k FROM sets GROUP BY k),
        shingles AS (SELECT id, n, x FROM classes JOIN members ON id = doc_id),
        links AS (
            SELECT a.id AS a, b.id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.id < b.id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
            GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT id, id AS other FROM classes UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
        least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
        SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
        FROM documents d LEFT JOIN sets s ON d.doc_id = s.doc_id LEFT JOIN classes c ON s.k = c.k LEFT JOIN least l ON c.id = l.id
    """,
    "op4_mix_sources": """
        WITH RECURSIVE sizes AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
        rates AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM sizes),
        steps AS (
            SELECT source, rate, 0 AS k, -rate AS lp, exp(-rate) AS c FROM rates
            UNION ALL
            SELECT source, rate, k + 1, lp + ln(rate) - ln((k + 1)::DOUBLE), c + exp(lp + ln(rate) - ln((k + 1)::DOUBLE))
            FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 40)
        ),
        drawn AS (SELECT *, ('0x' || substr(md5('42|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
        counted AS (
            SELECT d.doc_id, d.source, d.text, s.rate, count(*) FILTER (WHERE s.c <= d.u) AS copies
            FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source GROUP BY ALL
        )
        SELECT doc_id, source, text, round(rate, 9) AS rate, copy::INTEGER AS copy, md5('42-order|' || doc_id || '|' || copy || '|' || md5(coalesce(text, ''))) AS shuffle_key
        FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)
    """,
}
