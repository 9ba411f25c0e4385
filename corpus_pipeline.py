"""From raw documents to token ids: language, near duplicates, personal data, mixing, SentencePiece.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the
stage before kept; each result is written as Parquet and read again.  Stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import langid, mixing, ngramjoin, pii, sentencepieces
from lodestar.llm.queries import PIECES
from lodestar.runtime import discard, freed_shuffles, saved, table

#: A document whose best language has less of the softmax of decoding losses has no language.
LEAST_LANGUAGE_SCORE = 0.5
MIX_TEMPERATURE, MIX_SEED = 0.5, 42


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a determined language, ``lang`` set to it; null, empty and letterless texts go."""
    found = langid.identify(docs)
    kept = found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links: that of smallest id.

    Where ids repeat, rows of equal id and text are one (the smallest row
    stays), and texts of one id are documents of their own, named by a hash of
    id and text: of those of a component's smallest id, the smallest name
    stays.  Rows without id stay.
    """
    named = docs.filter(F.col("doc_id").isNotNull())
    with freed_shuffles(spark):
        repeated = named.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if not repeated:
        placed = ngramjoin.jaccard_components(docs)
        gone = placed.filter(F.col("component_id") < F.col("doc_id")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = named.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "text", "row.*")
    once = saved(once.withColumn("__name", F.xxhash64("doc_id", "text")), "rows-once")
    placed = ngramjoin.jaccard_components(once.select(F.col("__name").alias("doc_id"), "text")).withColumnRenamed("doc_id", "__name")
    first = placed.join(once.select("__name", "doc_id"), "__name").groupBy("component_id").agg(F.min(F.struct("doc_id", "__name")).alias("first"))
    kept = once.join(first.select(F.col("first.__name").alias("__name")), "__name", "left_semi").select(docs.columns)
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; ``n_chars`` counted again."""
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards target weights of their sources, globally shuffled."""
    rates = mixing.repetition_rates(docs, temperature=MIX_TEMPERATURE)
    return mixing.mix(docs, rates, seed=MIX_SEED).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every remaining document's pieces, which spell its text again."""
    return sentencepieces.encode_pieces(docs, PIECES).select("doc_id", "lang", "source", "n_pieces", "piece_ids", "round_trip")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: SQL can't express the stages; tests/llm hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
